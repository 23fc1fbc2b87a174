"""Personal data against Python's own matching of the plain patterns, and the other kinds by examples."""

import hashlib
import random
import re

from causal_panel.llm import personal_data as personal
from causal_panel.llm import queries

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((kind, m.start(), m.end()))
    return spans


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = {r.doc_id: r.spans for r in personal.find_personal_data(docs).collect()}
    return [[(s.kind, s.start, s.end) for s in rows[k]] for k in range(len(texts))], [[s for s in rows[k] if s.base] for k in range(len(texts))]


def test_base_kinds_match_the_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["a@b.c", "x.y%z@d-e.f.g", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "0000.1.2.3", "9.9.9.9.9.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4" * 30, "+1 (743) 555-3824", "+49 30 1234 5678 9",
            "+", "12", "é", "日本", "😀", " ", "\n", ".", "-", "--", "  ", "a", "+1+2", "(", ")", "_", "c@d@e.f", "1-2-3", "99999999999.1.1.1", "+12"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randrange(0, 25))) for _ in range(600)] + [None, ""]
    _, base = found(spark, texts)
    assert [[(s.kind, s.start, s.end) for s in spans] for spans in base] == [brute_base(t) for t in texts]


def test_long_runs_cost_no_more_than_others(spark):
    make = lambda n: ["a" * n, "9" * n, "1." * n, "1 " * n, "a@" * n, ".a" * n, "+1" * n, "+1 " + " " * n, "a@b" + ".c" * n, "1-" * n, "DE89 " * (n // 5), "1.2.3.4 " * (n // 10)]
    _, base = found(spark, make(1000))  # the plain patterns take time that grows with the square
    assert [[(s.kind, s.start, s.end) for s in spans] for spans in base] == [brute_base(t) for t in make(1000)]
    _, base = found(spark, make(200_000))
    assert [len(spans) for spans in base] == [0, 0, 50_000, 0, 0, 0, 0, 0, 1, 0, 0, 20_000]
    assert [(s.start, s.end) for s in base[-1][-2:]] == [(8 * 19_998, 8 * 19_998 + 7), (8 * 19_999, 8 * 19_999 + 7)]


def test_other_kinds_need_checksums_or_words_nearby(spark):
    cases = {
        "Pay to DE89 3704 0044 0532 0130 00 today": ["iban"], "DE88 3704 0044 0532 0130 00": [], "GB29NWBK60161331926819.": ["iban"], "FR76 3000 6000 0112 3456 7890 189": ["iban"],
        "SSN: 123-45-6789": ["ssn"], "part no 123-45-6789": [], "social security 000-45-6789": [], "tax 1-123-45-6789": [],
        "call (743) 555-3824 now": ["tel"], "+1 (743) 555-3824": ["phone"], "(143) 555-3824": [],
        "born 1984-02-29 in": ["birth"], "released 1984-02-29": [], "geboren am 1984-13-29": [],
    }
    kinds, _ = found(spark, list(cases))
    assert [[k for k, _, _ in spans] for spans in kinds] == list(cases.values())
    (iban,) = [s for s in kinds[0] if s[0] == "iban"]
    assert list(cases)[0][iban[1]:iban[2]] == "DE89 3704 0044 0532 0130 00"


def test_scores_follow_checks_and_context(spark):
    docs = spark.createDataFrame([(1, "host 10.0.0.1"), (2, "see 10.0.0.1")], SCHEMA)
    scores = {r.doc_id: r.spans[0].score for r in personal.find_personal_data(docs).collect()}
    assert scores == {1: 80, 2: 50}


def test_query_digests_and_places(spark, tmp_path):
    text = "Äé 😀 a@b.cd, 10.0.0.1 and +1 (743) 555-3824"
    spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, "y")], SCHEMA + ", spans string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(map(tuple, queries.QUERIES["op13_span_scores"](spark, str(tmp_path)).collect()), key=str)
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(text))
    one = (1, 1, 1, 0, 1, hashlib.sha256(spans.encode()).hexdigest(), spans)
    assert rows == sorted([one, one, (None, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")], key=str)


def test_masked_texts(spark):
    text = "Mail a@b.cd or +1 (743) 555-3824, 4111 1111 1111 1111."
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None), (4, "")], SCHEMA)
    masked = {r.doc_id: r.text for r in personal.masked(personal.find_personal_data(docs)).collect()}
    assert masked == {1: "Mail [EMAIL] or [PHONE], [CARD].", 2: "nothing", 3: None, 4: ""}
    assert personal.find_personal_data(docs.limit(0)).count() == 0


def test_running_totals(spark):
    numbers = [random.Random(k).choices(range(9), k=k) for k in (0, 1, 255, 256, 257, 1000)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n array<long>").select(personal.running(personal.F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == [[sum(n[:k + 1]) for k in range(len(n))] for n in numbers]
