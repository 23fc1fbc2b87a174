"""Pages, conversations, packing, embeddings and the pipeline on small tables, against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causal_panel.llm import chat_format, epsilon_grid, packing, page_text
from causal_panel.llm.queries import tokenizer_path

# -- pages


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
@settings(deadline=None)
def test_common_lines_are_a_longest_common_subsequence(a, b):
    found, rest = page_text.common_lines(a, b), iter(b)
    assert len(found) == longest_common(a, b) and found == sorted(set(found))
    assert all(any(a[i] == y for y in rest) for i in found)


@pytest.mark.parametrize(("source", "lines"), [
    ('<head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><article><h1>A &amp; B</h1><p>one\n two<p>three<br>four</article><footer>f</footer>', ["A & B", "one two", "three four"]),
    ('<main><header><h1>T</h1></header><p>x <span class="ad">buy</span> y<aside>side</aside></main><section id="comments"><p>me too</section>', ["T", "x y"]),
    ('<div class="cookie-notice"><div>ok</div></div><p>a</p><form><input>q</form><script>var t="</p>";</script><p>b<!-- c --> d', ["a", "b d"]),
    ('<article><p><b>bold never closed<br><p>x < y &lt;z&gt; &#233;</article>', ["bold never closed", "x < y <z> é"]),
    ("", []), ("plain", ["plain"]), ("<p>" * 3000 + "deep", ["deep"]),
])
def test_page_lines(source, lines):
    assert [line for line, _ in page_text.page_lines(source)] == lines


@pytest.mark.parametrize("name", ["page has-sidebar", "no-ads", "with-navbar", "form-page", "layout--no-banner"])
def test_wrappers_with_a_name_in_their_class_keep_the_article(name):
    story = '<div class="site-footer">About us</div><main><h2 id="related-work">Related work</h2><section id="social-effects"><p>Effects.</p></section><p id="share-prices">Prices.</p></main>'
    for source in (f'<div class="{name}">{story}</div>', f'<form id="aspnetForm"><div id="{name}">{story}</div></form>', f'<span class="{name}">{story}</span>'):
        assert page_text.page_lines(source) == [(x, True) for x in ("Related work", "Effects.", "Prices.")]
    assert page_text.page_lines(f'<div class="{name}"><h1>Title</h1><p>Story.</p></div>') == [("Title", False), ("Story.", False)]
    whole = '<div class="comments"><article>Nice!</article></div><div class="a sidebar b">Menu</div><form>Mail</form><article><div class="ad">Buy</div><p>Story.</p><form>Vote</form></article>'
    assert page_text.page_lines(whole) == [("Story.", True)]


@pytest.mark.parametrize("source, lines", [
    ("<article><p data-x=it's>Hello it's me and more</p><p>Two.</p></article>", ["Hello it's me and more", "Two."]),
    ('<main><p title="a > b" class=\'x\'>One &amp; two</p><p ">Three.</p><a href=/x?y=1&z="q">four</a></main>', ["One & two", "Three.", "four"]),
    ('<article><p data-note="class=ad">Kept.</p><p data-x="unclosed>Lost</p></article>', ["Kept."]),
    ('<div class="widget"><article><p>Story.</p></article></div><div class="widget">Tags</div>', ["Story."]),
    ('<article><h2 id="banner">Banner years</h2><section id="related"><p>Near.</p></section><div class="notice">Note</div><div class="social"><p>Life.</p></div></article>', ["Banner years", "Near.", "Life."]),
    ('<main><div class="social"><p>Society.</p></div><div role="navigation">Menu</div></main>', ["Society."]),
    ('<div role="banner">Top</div><div class="sidebar">Side</div><p>Body.</p>', ["Body."]),
    ("<article>" + "<b =" * 20_000 + "x</article>", None),
])
def test_attributes_and_whole_names(source, lines):
    found = [line for line, _ in page_text.page_lines(source)]
    assert lines is None or found[:len(lines)] == lines and (len(found) == len(lines) or "unclosed" in source)


def test_lines_that_neighbours_share_are_deleted(spark):
    page = lambda k: f"<div>Our Site</div><div>Home | Products</div><p>Story {k} begins.</p><p>It ends {k}.</p><div>All rights reserved</div>"
    rows = [(k, f"https://a.example.org/news/{k:03d}", page(k)) for k in range(40)]
    rows += [(100, "https://b.example.org/x", page(1)), (101, "https://c.example.org/y", page(2)), (102, "https://c.example.org/z", page(2))]
    rows += [(103, "https://d.example.org/1", "<article><p>same</p><p>p1</p></article>"), (104, "https://d.example.org/2", "<article><p>same</p><p>p2</p></article>")]
    rows += [(105, None, None), (106, "::not an address[", "<p>t</p>"), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("x")).withColumn("path", F.lit(1))
    got = defaultdict(list)
    for r in page_text.extract_pages(docs.repartition(5)).collect():
        got[r.page_id].append(r.text)
    assert all(got[k] == [f"Story {k} begins.\nIt ends {k}."] * (2 if k == 5 else 1) for k in range(40))
    whole = "Our Site\nHome | Products\nStory {0} begins.\nIt ends {0}.\nAll rights reserved"
    assert got[100] == [whole.format(1)] and got[101] == got[102] == [whole.format(2)]  # alone on its host; a copy is no template
    assert got[103] == ["same\np1"] and got[104] == ["same\np2"] and got[105] == [""] and got[106] == ["t"]
    assert page_text.extract_pages(docs.limit(0)).count() == 0


# -- conversations


@given(st.lists(st.tuples(st.text(alphabet="as<>/[]INST\\\n é", max_size=12), st.text(alphabet="as<>/[]INST\\\n é😀", max_size=30)), max_size=5))
@settings(deadline=None)
def test_formatted_turns_read_back(turns):
    turns = [*turns, ("assistant", "</s>[INST] ok [/INST]")]
    assert chat_format.read_back("".join(chat_format.render(*t)[0] for t in turns)) == turns
    for role, text in turns:
        formatted, start, end = chat_format.render(role, text)
        assert chat_format.unescape(formatted[start:end]) == text and not any(c in chat_format.escape(text) for c in chat_format.CONTROL)


def test_every_reply_is_one_example(spark):
    rng, rows = random.Random(1), []
    for conv in [*range(30), None]:
        rows += [(conv, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["hi\nthere", "", None, "</s>", "x\\" * 3, "é😀"])) for t in range(rng.randint(1, 9))]
    rows += [(50, None, "user", "b"), (50, 0, "user", "a"), (50, 0, "user", "a"), (60, 0, "user", "u"), *[(61, k, "assistant", "r" * k) for k in range(300)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"example": F.lit(1), "loss": F.lit("x")})
    examples = chat_format.prefix_examples(turns)
    wanted = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        wanted[conv].append((role or "", text or ""))
    seen = defaultdict(list)
    for e in examples.collect():
        turns_of, replies = wanted[e.conv_id], [k for k, (role, _) in enumerate(wanted[e.conv_id]) if role == "assistant"]
        n = replies[e.example] + 1 if e.example < len(replies) else len(turns_of)
        assert chat_format.read_back(e.formatted) == turns_of[:n] and e.n_turns == n and e.last == (n == len(turns_of))
        reply = chat_format.unescape(e.formatted[e.loss_start:e.loss_end]) if e.loss_start >= 0 else None
        assert reply == (turns_of[n - 1][1] if e.example < len(replies) else None)
        seen[e.conv_id].append(len(e.formatted))
    for d in chat_format.conversation_digests(examples).collect():
        turns_of = wanted[d.conv_id]
        loss = "".join(text for role, text in turns_of if role == "assistant")
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_of).encode()).hexdigest() and d.n_turns == len(turns_of)
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and d.formatted_chars == sum(seen[d.conv_id])
    assert set(seen) == set(wanted)
    assert chat_format.conversation_digests(chat_format.prefix_examples(turns.limit(0))).count() == 0


# -- packing


def spans(plan, histogram):
    """(offset, length) by sequence, as the runs of a plan say."""
    placed, out = sorted(plan.placed), defaultdict(list)
    for k, (length, rank, first, offset, per) in enumerate(placed):
        end = placed[k + 1][1] if k + 1 < len(placed) and placed[k + 1][0] == length else histogram[length]
        for i in range(end - rank):
            out[first + i // per].append((offset + i % per * length, length))
    return out


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25), st.sampled_from([1, 4, 50]), st.sampled_from([0, 8, 20, 64]))
@settings(deadline=None, max_examples=200)
def test_plans_place_every_piece_without_gaps(histogram, groups, small):
    rule = packing.PackRule(capacity=64, groups=groups, small=small)
    plan = packing.Plan(histogram, rule)
    sequences, placed = spans(plan, histogram), defaultdict(int)
    assert set(sequences) == set(range(plan.sequences))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
            placed[length] += 1
        assert at <= 64
    assert placed == histogram


def test_plans_come_near_the_least_number_of_sequences():
    rng, histogram = random.Random(2), defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, int(rng.lognormvariate(6.4, 1.1)) + 1)] += 1
    plan = packing.Plan(dict(histogram), packing.PackRule())
    assert plan.sequences <= 1.004 * -(-sum(n * c for n, c in histogram.items()) // 2048)


def test_packed_documents_hold_the_ids_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    odd = ["", None, "Hello, WORLD!!", "a\xa0b c\x1cd \x85e", "İstanbul ΣΑΣ naïve café é", "x<|endoftext|>y <|startoftext|> z", "don't you'll 12three ４", "word " * 9000,
           "***### %%%", "ñandú,&&& los.*** 'quoted'", "tab\tline\r\nfeed\x0b\x0c", "　全角 文字", *(" ".join(rng.choice("alpha Beta gamma, delta. EPSILON!").strip() or "q" for _ in range(rng.randint(1, 400))) for _ in range(30))]
    rows = [(k, t) for k, t in enumerate(odd)] + [(7, odd[7]), (None, "no id"), (2, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit(1), "bucket": F.lit(2), "rank": F.lit(3)})
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    plain, wanted = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted += [(doc, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0
    kept = packing.token_pieces(docs, tokenizer_path(), with_ids=True).filter("doc_id = 7").orderBy("piece").collect()
    assert [len(r.ids) for r in kept] == [r.length for r in kept]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_new_words_of_a_batch_are_encoded_in_a_few_calls_of_the_model(kind):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    parts = ["an", "Ter", "ö", "ÿes", "ß", "k", "İx", "ﬁ", "ō", "'s", "4", "<|ENDOFTEXT|>", "!", "...", "é", "—", "(", "\x1c", "\xa0"]
    weights = [9, 9, 5, 5, 2, 9, *[0.2] * 13]
    texts = ["", None, " \t two  gaps\x0b", *(rng.choice(" \n\r").join("".join(rng.choices(parts, weights, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 300))) for _ in range(90)), None, "\f"]
    plain = Tokenizer.from_file(tokenizer_path())
    wanted = [plain.encode(text or "", add_special_tokens=False).ids for text in texts]
    tokenizer = packing.WordTokenizer(tokenizer_path())
    tokenizer.model, tokenizer.BATCH, tokenizer.LIMIT, tokenizer.CORES = None, 9000, 700, 300  # no call for a single word

    def encoded(array):
        found = []
        for ids, counts in tokenizer.encode(array):
            found += [part.tolist() for part in np.split(ids, np.cumsum(counts))[:-1]]
        return found

    array = pa.array(texts, kind)
    assert encoded(array) == wanted and encoded(array.slice(7, 50)) == wanted[7:57] and encoded(array[:0]) == []
    assert tokenizer.old and encoded(pa.array([None, None], kind)) == [[], []]
    tokenizer = packing.WordTokenizer(tokenizer_path())
    tokenizer.last[:] = False  # a model without a mark at the end of words
    assert encoded(array) == wanted


# -- embeddings


def brute_links(ids, vectors, least=0.95):
    usable = {i: np.array(v, float) / max(map(abs, v)) for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, label = [0] * len(ids), list(ids)
    for i, v in usable.items():
        for j, w in usable.items():
            if j < i and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(zip(ids, links, label))


@pytest.mark.parametrize("rule", [epsilon_grid.GridRule(), epsilon_grid.GridRule(block=16, leaf=4, branches=2, kept=3, grid=2)], ids=["default", "small blocks"])
def test_links_are_those_of_all_pairs(spark, rule):
    rng, vectors = np.random.default_rng(4), []
    for _ in range(8):
        center = rng.normal(size=6)
        vectors += [(center + rng.normal(size=6) * rng.choice([0.05, 0.2, 0.4])).tolist() for _ in range(14)]
    vectors += [vectors[0]] * 25 + [[2 * x for x in vectors[0]], None, [], [0.0] * 6, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1.0, 2.0], [1.0, 2.01], [1e-200] * 6, [1e200] * 6]
    ids = [int(i) * 3 for i in rng.permutation(len(vectors))]
    table = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    got = epsilon_grid.similar_vectors(table.withColumn("vector", F.lit(1)).withColumn("rep", F.lit(2)), rule)
    assert sorted(map(tuple, got.collect())) == brute_links(ids, vectors)


def test_embeddings_without_usable_vectors(spark):
    table = spark.createDataFrame([(1, None), (2, []), (3, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, epsilon_grid.similar_vectors(table).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert epsilon_grid.similar_vectors(table.limit(0)).count() == 0
