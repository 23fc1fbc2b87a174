"""Personal data in texts: patterns propose spans, checksums and other tests confirm them, words nearby adjust their scores.

Built-in functions only. A pattern's matches and what lies between them (the text
split at the pattern) give the places of all matches in one pass over the text,
without a row per match. Patterns use possessive quantifiers where what follows
could not match anyway, and let a match begin only where its run of characters
begins or the match before it ended: the matches are those of the plain pattern,
but long runs cost no more than others.

Base kinds (email, ip, card, phone) are kept whenever their test holds. The
others need a score of ``cut``: their prior, more for a checksum that holds, and
more for a word nearby that goes with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_BEFORE, NEAR_AFTER = 40, 20  # code points looked at for context, as far as the neighbouring match of the kind
BLOCK = 256  # of the arrays that are summed up


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` finds candidates in texts that hold ``needs``; ``test`` confirms the
    candidate text. ``prior`` is its score, of 100, to which ``bonus`` comes if
    ``context`` is found around it (in lower case).
    """

    name: str
    pattern: str
    needs: str
    test: Callable[[Column], Column]
    prior: int
    context: str
    bonus: int = 30
    base: bool = False


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(value: Column) -> Column:
    """Whether the digits in a text pass the Luhn test."""
    from_right = _characters(F.reverse(_digits(value)))

    def weighed(digit: Column, at: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(at % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(from_right, weighed), F.lit(0), lambda total, d: total + d) % 10 == 0


def mod_97(value: Column) -> Column:
    """Remainder of an account number of letters and digits by 97; its first four characters count last."""
    turned = F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))
    # A to Z are 10 to 35.
    step = lambda left, c: F.when(F.ascii(c) < 58, left * 10 + F.ascii(c) - 48).otherwise(left * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_characters(turned), F.lit(0), step)


def _ip(value: Column) -> Column:
    return ~F.exists(F.split(value, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) > 3) | (F.right(part, F.lit(3)).cast("int") > 255))


def _long_enough(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


def _iban(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (mod_97(bare) == 1)


def _social(value: Column) -> Column:
    return value.rlike(r"^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}\z") & ~value.rlike("^(000|666)|-00-|-0000")


def _date(value: Column) -> Column:
    return value.rlike(r"^(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z")


_DASHED = r"(?:(?<![0-9])|\G)[0-9]++(?:-[0-9]++)++"
_DIGIT = "[0-9]"

#: Base kinds first: results list spans by kind in this order.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), 80, "mail|correo|courriel|contact|kontakt", 10, base=True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _DIGIT, _ip, 50, r"(^|[^a-z])ip([^a-z]|$)|host|server|address|adress|direcci", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _DIGIT, lambda v: _long_enough(v, 13, 19) & luhn(v), 60, "card|visa|credit|karte|carte|tarjeta", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", lambda v: _long_enough(v, 9, 15), 60, "phone|tel|call|mobil|fax|anruf|llama", base=True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _DIGIT, _iban, 80, "iban|account|bank|konto|compte|cuenta", 10),
    Kind("ssn", _DASHED, _DIGIT, _social, 40, r"(^|[^a-z])ssn([^a-z]|$)|social security|tax"),
    Kind("tel", r"(?:\+[0-9]{1,3}[\x20.-]?)?\([2-9][0-9]{2}\)[\x20.-]?[2-9][0-9]{2}[\x20.-][0-9]{4}", r"\(", lambda v: ~v.startswith("+"), 60, "phone|tel|call|mobil|fax|anruf|llama"),
    Kind("birth", _DASHED, _DIGIT, _date, 30, r"(^|[^a-z])born([^a-z]|$)|birth|(^|[^a-z])dob([^a-z]|$)|geboren|geburt|naissance|nacid|nacimiento"),
)
CUT = 60

SPAN = "array<struct<kind: string, start: bigint, end: bigint, score: int, base: boolean>>"


def running(numbers: Column) -> Column:
    """Running totals of an array, in blocks, so that what is copied does not grow with the square of its length."""
    add = lambda totals, x: F.concat(totals, F.array(F.coalesce(F.element_at(totals, F.when(F.size(totals) > 0, -1).otherwise(F.lit(None))), F.lit(0).cast("long")) + x))
    within = lambda xs: F.aggregate(xs, F.array().cast("array<bigint>"), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda total, x: total + x))
    shifted = F.zip_with(within(sums), F.zip_with(sums, F.transform(blocks, within), lambda s, t: F.struct(s.alias("s"), t.alias("t"))),
                         lambda upto, pair: F.transform(pair["t"], lambda x: x + upto - pair["s"]))
    return F.when(F.size(numbers) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


def _spans(kind: Kind, values: str, gaps: str, ends: str) -> Column:
    """The confirmed spans of a kind, from its matches, the text between them and their ends."""
    near = lambda i: F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR_BEFORE)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR_AFTER))))
    score = lambda i: F.lit(kind.prior) + F.when(near(i).rlike(kind.context), kind.bonus).otherwise(0)

    def span(value: Column, i: Column) -> Column:
        end = F.get(ends, i)
        return F.struct(
            F.lit(kind.name).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), F.when(kind.test(value), score(i)).alias("score"), F.lit(kind.base).alias("base")
        )

    kept = lambda s: s["score"].isNotNull() if kind.base else F.coalesce(s["score"], F.lit(0)) >= CUT
    return F.filter(F.transform(values, span), kept)


def find_personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text, spans) of every row of ``docs`` (doc_id, text); spans have kind, start, end, score and base.

    Places are code points from 0, ends exclusive; spans come by kind, then by
    start. A null text has no spans and stays null; repeated rows and null ids
    are rows like any other; other columns, whatever their names, are ignored.
    An empty table gives an empty table. Spans of different kinds may overlap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    shared = {k.pattern: f"{k.name}_values" for k in reversed(kinds)}  # kinds with one pattern share its matches
    nothing = F.array().cast("array<string>")
    found = [F.col("doc_id"), F.col("text")]
    for pattern, values in shared.items():
        needs = next(k.needs for k in kinds if k.pattern == pattern)
        may = text.rlike(needs)
        found.append(F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(nothing).alias(values))
        found.append(F.when(may, F.split(text, pattern, -1)).otherwise(nothing).alias(f"{values}_gaps"))
    rows = docs.select(*found)
    lengths = lambda values: F.transform(values, lambda v, i: (F.length(v) + F.length(F.get(f"{values}_gaps", i))).cast("long"))
    rows = rows.select("*", *[lengths(v).alias(f"{v}_lengths") for v in shared.values()])
    rows = rows.select("*", *[running(F.col(f"{v}_lengths")).alias(f"{v}_ends") for v in shared.values()])
    spans = F.concat(*[_spans(k, shared[k.pattern], f"{shared[k.pattern]}_gaps", f"{shared[k.pattern]}_ends") for k in kinds])
    return rows.select("doc_id", "text", spans.cast(SPAN).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(found: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; of overlapping spans the one that begins first, and among these the longest."""
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(done: Column, span: Column) -> Column:
        parts = F.concat(done["parts"], F.array(F.substr("text", (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))))
        return F.when(span["start"] >= done["at"], F.struct(span["end"].alias("at"), parts.alias("parts"))).otherwise(done)

    finish = lambda done: F.concat(F.array_join(done["parts"], ""), F.substr("text", (done["at"] + 1).cast("int")))
    return found.select("doc_id", F.aggregate(ordered, start, put, finish).alias("text"))
