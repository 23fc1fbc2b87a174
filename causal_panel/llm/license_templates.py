"""License scans by template-markup matching.

A template is the wording of a licence or notice with two kinds of marks:
``[? words ?]`` may be missing, and ``{1-12}`` stands for that many words of any
kind (names, years, holders). Marks may be nested in optional regions. A
template becomes an automaton over words; it accepts a place in a text if the
words there are its mandatory wording exactly, with nothing else than the marks
allow in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text

#: Phrases whose places are counted in every text, with their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_DISCLAIMER = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed In no event shall the copyright {1-4} be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[? {1-1} ?] Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[? {1-1} ?] Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)

#: (label, whole wording of a licence or of the notice that it asks for). Case and punctuation of the wording do not matter.
TEXTS = (
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software "
            "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions The above copyright notice "
            "and this permission notice [? including the next paragraph ?] shall be included in all copies or substantial portions of the Software "
            "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT IN NO EVENT SHALL THE {1-6} BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN AN ACTION "
            "OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc", "Permission to use copy modify and [? or ?] distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies THE SOFTWARE IS PROVIDED AS IS AND {1-4} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
            "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS IN NO EVENT SHALL {1-4} BE LIABLE FOR ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE DATA OR PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER TORTIOUS ACTION ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("bsd-2-clause", _REDISTRIBUTION + _DISCLAIMER),
    ("bsd-3-clause", _REDISTRIBUTION + "[? {1-1} ?] Neither the name of {1-12} nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission " + _DISCLAIMER),
    ("apache-2.0", "Licensed under the Apache License Version 2.0 the License you may not use this [? {1-2} ?] file except in compliance with the License You may obtain a "
                   "copy of the License at {1-12} Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an "
                   "AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied See the License for the specific language governing permissions "
                   "and limitations under the License"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation either version {1-2} of the License or at your option any later version"),
    ("unlicense", "This is free and unencumbered software released into the public domain Anyone is free to copy modify publish use compile sell or distribute this "
                  "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

_LICENSED = "[? licensed ?] [? released ?] [? distributed ?] [? available ?] under [? a ?] [? the ?] [? terms of the ?]"

#: (label, reference to a licence by its name); of the words in front only "under" is mandatory, so a plain mention is none.
REFERENCES = (
    ("apache-2.0", f"{_LICENSED} Apache License [? version ?] 2.0"),
    ("apache-2.0", f"{_LICENSED} Apache License v2.0"),
    ("apache-2.0", f"{_LICENSED} Apache [? version ?] 2.0 License"),
    ("mit", f"{_LICENSED} MIT License"),
    ("isc", f"{_LICENSED} ISC License"),
    ("bsd-2-clause", f"{_LICENSED} BSD 2 clause License"),
    ("bsd-2-clause", f"{_LICENSED} 2 clause BSD License"),
    ("bsd-3-clause", f"{_LICENSED} BSD 3 clause License"),
    ("bsd-3-clause", f"{_LICENSED} 3 clause BSD License"),
    ("bsd", f"{_LICENSED} BSD License"),
    ("gpl-3.0", f"{_LICENSED} GNU General Public License [? GPL ?] [? either ?] version 3 [? of the License ?]"),
    ("gpl-2.0", f"{_LICENSED} GNU General Public License [? GPL ?] [? either ?] version 2 [? of the License ?]"),
    ("lgpl", f"{_LICENSED} GNU Lesser General Public License"),
    ("agpl", f"{_LICENSED} GNU Affero General Public License"),
    ("mpl-2.0", f"{_LICENSED} Mozilla Public License [? version ?] 2.0"),
    ("mpl-2.0", f"{_LICENSED} Mozilla Public License v2.0"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License [? v ?] [? version ?] 2.0"),
    *((f"cc-{parts.replace(' ', '-').lower()}", f"{_LICENSED} CC {parts} [? 1.0 ?] [? 2.0 ?] [? 2.5 ?] [? 3.0 ?] [? 4.0 ?]") for parts in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND")),
    ("cc0", f"{_LICENSED} CC0 [? 1.0 ?]"),
    ("cc", f"{_LICENSED} Creative Commons [? {{1-8}} ?] License"),
)
NEGATIONS = frozenset("not never nor isn t cannot without".split())  # a reference after one of these is none
FOLLOWED = {"by": {"sa", "nc", "nd"}, "sa": {"nc", "nd"}, "nc": {"sa", "nd"}, "nd": {"sa", "nc"}}  # words that go on with a name: the longer one is meant

TEMPLATES = tuple((label, "text", wording) for label, wording in TEXTS) + tuple((label, "reference", wording) for label, wording in REFERENCES)

_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text before A-Z are lowered
_mark = re.compile(r"\[\?|\?\]|\{\d+-\d+\}|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_lower = {c: c + 32 for c in range(65, 91)}


@dataclass
class Automaton:
    """Word automaton of a template: from state to (word, next); word None is any word, word "" needs no word."""

    label: str
    kind: str = "text"
    moves: list[list[tuple[str | None, int]]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def reach(self, states: set[int]) -> set[int]:
        """The states and all that follow without a word."""
        todo, found = list(states), set(states)
        while todo:
            for word, to in self.moves[todo.pop()]:
                if word == "" and to not in found:
                    found.add(to)
                    todo.append(to)
        return found

    def first_words(self) -> set[str | None]:
        return {word for s in self.reach({0}) for word, _ in self.moves[s] if word != ""}

    def longest(self, words: list[str], start: int) -> int:
        """Words of the longest accepted run from ``start``, -1 if none is accepted."""
        end, best, now, at = len(self.moves) - 1, -1, self.reach({0}), start
        while now:
            if end in now:
                best = at - start
            if at == len(words):
                break
            now = self.reach({to for s in now for word, to in self.moves[s] if word is None or word == words[at]})
            at += 1
        return best


def compile_template(label: str, template: str, kind: str = "text") -> Automaton:
    """The automaton of a template; its last state accepts. Optional and ``{a-b}`` regions must be closed and a >= 1."""
    auto, now, begun = Automaton(label, kind), 0, []
    for mark in _mark.findall(template):
        if mark == "[?":
            begun.append(now)
            inner = auto.state()
            auto.moves[now].append(("", inner))
            now = inner
        elif mark == "?]":
            after = auto.state()
            auto.moves[now].append(("", after))
            auto.moves[begun.pop()].append(("", after))
            now = after
        elif mark[0] == "{":
            least, most = map(int, mark[1:-1].split("-"))
            steps = []
            for _ in range(most):
                to = auto.state()
                auto.moves[now].append((None, to))
                steps.append(now := to)
            for step in steps[least - 1:-1]:
                auto.moves[step].append(("", now))
        else:
            to = auto.state()
            auto.moves[now].append((mark.translate(_lower), to))
            now = to
    if begun:
        raise ValueError(f"open optional region in {template!r}")
    return auto


class Scanner:
    """All templates at once: automata by the words that they can begin with."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...]):
        self.starts: dict[str | None, list[Automaton]] = {}
        wording: list[set[str]] = []
        for label, kind, template in templates:
            auto = compile_template(label, template, kind)
            for word in auto.first_words():
                self.starts.setdefault(word, []).append(auto)
            depth, mandatory = 0, set()
            for mark in _mark.findall(template.translate(_lower)):
                depth += (mark == "[?") - (mark == "?]")
                if not depth:
                    mandatory.add(mark)
            wording.append(mandatory)
        rare = {"license", "licensed", "permission", "redistribution", "unencumbered", "cc", "cc0"}
        if any(not (w & rare) for w in wording):
            raise ValueError(f"every template needs one of {sorted(rare)} in its mandatory wording")
        self.hint = re.compile("licen|permission|redistribution|unencumbered|(?<![a-z0-9])cc")

    def matches(self, words: list[str]) -> list[tuple[str, str, int, int]]:
        """(label, kind, first word, words) of every accepted place, the longest run of each automaton that ends there.

        A reference is none after a negation, nor where its name goes on to that
        of another licence; of references that end at one place the first begins it.
        """
        found: dict[tuple[str, str, int], tuple[str, str, int, int]] = {}
        anywhere = self.starts.get(None, ())
        for at, word in enumerate(words):
            for auto in (*self.starts.get(word, ()), *anywhere):
                n = auto.longest(words, at)
                if n <= 0:
                    continue
                if auto.kind == "reference":
                    after = words[at + n] if at + n < len(words) else ""
                    if NEGATIONS & set(words[max(0, at - 2):at + n]) or after in FOLLOWED.get(words[at + n - 1], ()):
                        continue
                found.setdefault((auto.label, auto.kind, at + n), (auto.label, auto.kind, at, n))
        return list(found.values())


SCANNED = (
    "doc_id string, n_words long, base array<struct<label string, start long>>, "
    "matches array<struct<label string, kind string, start long, n_words long>>"
)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, base, matches) of every row of ``docs``.

    ``base`` has the places of the BASE phrases, ``matches`` what the templates
    accept. A null or empty text has no words and no places. Rows are taken one
    by one, so repeated rows, null ids and other columns make no difference.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = _word.findall(text or "")
                base, found = [], []
                if text and scanner.hint.search(text.lower()):
                    words = [w.translate(_lower) for w in words]
                    base = [(label, at) for phrase, label in BASE.items() for at, w in enumerate(words)
                            if w == phrase[0] and tuple(words[at:at + len(phrase)]) == phrase]
                    found = scanner.matches(words)
                rows.append((len(words), [{"label": x, "start": s} for x, s in base], [{"label": x, "kind": kind, "start": s, "n_words": n} for x, kind, s, n in found]))
            out = pd.DataFrame(rows, columns=["n_words", "base", "matches"], index=frame.index)
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    return docs.select(as_text("doc_id"), "text").mapInPandas(run, SCANNED).withColumn("doc_id", F.col("doc_id").cast("long"))


def summarize(scanned: DataFrame) -> DataFrame:
    """Per row the counts, places and labels; score 1 with a whole text, 0.8 with a reference, 0.6 with a base phrase alone, else 0."""
    labels = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in columns)))), ",")
    starts = F.transform("base", lambda x: x["start"])
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "matches").alias("labels"),
        F.when(F.exists("matches", lambda m: m["kind"] == "text"), 1.0).when(F.size("matches") > 0, 0.8).when(F.size("base") > 0, 0.6).otherwise(0.0).alias("score"), "matches",
    )
