"""Phrase mining against plain counts of all phrases."""

import random
import re
from collections import Counter

from causal_panel.llm import phrase_mining as mining

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, longest=4):
    """f(phrase) per language, the empty phrase being every word."""
    counts = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            counts[lang or "und", ""] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    counts[lang or "und", " ".join(words[k:k + size])] += 1
    return counts


def brute_collocations(rows, rule):
    counts = brute_counts(rows, rule.longest)
    candidates = {k: a for k, a in counts.items() if " " in k[1] and a >= rule.support}
    inside = Counter()
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                key = lang, " ".join(words[k:k + size])
                inside[key] = max(inside[key], a)
    out = {}
    for (lang, phrase), a in candidates.items():
        if 100 * inside[lang, phrase] >= rule.inside_percent * a:
            continue
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, counts[lang, ""], -score)
        for lang, found in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:rule.top], 1)
    )


def drawn(rng, n):
    vocabulary = ["New", "york", "a", "été", "Ж", "b\x1cc", "x y", "#", "日本", "ÀB"] + [f"w{k}" for k in range(30)]
    said = ["New york city hall", "a b a b a", "San Salvador", "w1 w2 w3 w4 w5"]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(said) if rng.random() < 0.3 else rng.choice(vocabulary))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n", " ; "]))
        rows.append((rng.choice([None, doc]), "".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(7, None, "en"), (8, "", None), (9, " ... ", "fr"), (9, " ... ", "fr")]


def test_collocations_match_plain_counts(spark):
    rng = random.Random(2)
    rows = drawn(rng, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    # A threshold the sample cannot meet leaves everything to the border; a small bitmap shares bits.
    for rule in (mining.PhraseRule(support=5, bits=16, sample_support=1), mining.PhraseRule(support=8, bits=16, sample_support=10**9), mining.PhraseRule(support=3, bits=16, top=5, longest=3)):
        frequent = mining.frequent_phrases(docs, rule)
        counts = brute_counts(rows, rule.longest)
        found = sorted((r.lang, r.phrase, r.n) for r in frequent.collect())
        assert found == sorted((*k, n) for k, n in counts.items() if n >= rule.support or k[1] == "")  # each phrase once
        assert sorted(map(tuple, mining.collocations(frequent, rule).collect())) == brute_collocations(rows, rule)


def test_the_border_closes_from_any_proposal(spark):
    """What a set proposes, too little or too much, decides the passes and not the phrases."""
    rows = drawn(random.Random(4), 120)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    expected = {k for k, n in brute_counts(rows).items() if n >= 6 and k[1]}
    empty = mining.Proposed(16)
    hashes = [int(mining.phrase_hash(*x)[0].view("i8")) for x in (("en", "w1 w2"), ("en", "nothing here"), ("de", "a"))]
    wild = empty.with_hashes(spark.createDataFrame([(h,) for h in hashes], "h long"))
    assert wild.holds(mining.phrase_hash("en", "w1 w2")).all() and wild.bitmap.sum() and not empty.bitmap.any()
    for proposed in (empty, wild, mining.Proposed(16, mining.np.full(1 << 13, 255, "u1"))):
        closed, frequent = mining.close(docs, 6, proposed, 4, 4)
        for lang, phrase in expected:
            h = mining.phrase_hash(lang, phrase)
            assert frequent.holds(h).all() and (phrase.count(" ") == 3 or closed.holds(h).all())


def test_words_of_one_hash_are_told_apart():
    words = mining.Words("en", ["Ab cd. ab  ef".encode(), b"cd\tab"])
    names = [words.ids()[1][k] for k in words.ids()[0]]
    words.hashes = words.hashes & mining.np.uint64(0)
    assert [words.ids()[1][k] for k in words.ids()[0]] == names == [b"ab", b"cd", b"ab", b"ef", b"cd", b"ab"]
    assert words.pieces.tolist() == [0, 0, 1, 1, 2, 2]


def test_large_counts_are_exact(spark):
    big = 2**62
    frequent = spark.createDataFrame([("en", "", 2**62), ("en", "a", big + 5), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, n long")
    (row,) = mining.collocations(frequent).collect()
    assert tuple(row) == ("en", 1, "a b", big - 1, big + 5, big, big, 2000000 * (big - 1) // (2 * big + 5))


def test_ties_go_by_score_then_count_then_phrase(spark):
    text = "b c. " * 40 + "a d. " * 40 + "e f. " * 50 + "é z. " * 40
    rows = [(1, text, "en")]
    found = mining.collocations(mining.frequent_phrases(spark.createDataFrame(rows, SCHEMA), mining.PhraseRule(bits=16)))
    assert [r.phrase for r in sorted(found.collect(), key=lambda r: r.rank)] == ["e f", "a d", "b c", "é z"]


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "Lorem ipsum dolor " * 60_000, "en"), (2, "x" * 300_000 + " y", "en")]
    extra = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], SCHEMA + ", n int, phrase string, rank int")
    found = mining.collocations(mining.frequent_phrases(extra, mining.PhraseRule(bits=16)))
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, mining.PhraseRule())
    for empty in ([], [(1, None, None)]):
        docs = spark.createDataFrame(empty, SCHEMA)
        assert mining.collocations(mining.frequent_phrases(docs, mining.PhraseRule(bits=16))).count() == 0
