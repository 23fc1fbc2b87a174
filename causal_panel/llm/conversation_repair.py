"""Conversation structure repair by depth-first branch and bound.

A conversation should read system?, user, assistant, user, assistant, ... The
cheapest edits that make it so are searched depth first from an explicit stack.
What is left of a conversation costs at least the sum of what each of its rows
costs by itself (suffix lower bounds); the best complete edits so far, as (cost,
audit), end every path that cannot get below them; and a table per node (rows
read, role written last) keeps the best way there, which dominates all others.
When the stack is empty the incumbent is optimal.

An audit has the initial of every edit in order: Delete, Insert, Keep, Rerole.
What an Insert or a Rerole writes follows from the role before it, so rows and
audit give the repaired conversation.

No conversation need fit one task. Its rows (without texts) are sorted into
ranges and searched in segments of ``SEGMENT`` rows from every role a segment can
start after to every one it can end with; the segments of a conversation are
then folded in order. Only reading a conversation's rows out again, edited, goes
through them one after the other, and holds one row at a time.
"""

from __future__ import annotations

import hashlib
import math
import os.path
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text
from causal_panel.session import staged

SEGMENT = 64
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3  # more, for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = STATES = range(4)  # what was written last
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GOOD_PAIRS = {"su", "ua", "au"}

BLANK = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
FINE, GONE, CUT = 0, 1, 2  # a row's fault: none, must be deleted, truncated


def written(state: int) -> int:
    """What an inserted or reroled turn is after ``state``: an assistant after a user, else a user."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state after a row with this initial is kept after ``state``; None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    return AFTER[initial] if AFTER.get(initial) == written(state) else None


def least_cost(initial: str, fault: int) -> int:
    """What a row costs at least, wherever it stands."""
    if fault == GONE:
        return COSTS["D"]
    stays = COSTS["K" if initial in AFTER else "R"] + (TRUNCATED if fault == CUT else 0)
    return min(stays, COSTS["D"])


def cheapest_edits(rows: list[tuple[str, int]], entry: int = START, exits: tuple[int, ...] = (START, ASSISTANT)) -> tuple[float, str]:
    """(cost, audit) of the cheapest edits of rows (initial, fault) that lead from ``entry`` to one of ``exits``.

    Of equally cheap ones the ASCII-least audit; (inf, "") where no edits lead there.
    """
    n = len(rows)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + least_cost(*rows[i])
    best_cost, best_audit = math.inf, ""
    dominant: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        reach = cost + bound[i]
        if reach > best_cost or reach == best_cost and audit > best_audit[:len(audit)]:
            continue
        known = dominant.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        dominant[i, state] = (cost, audit)
        if i == n and state in exits and (cost, audit) < (best_cost, best_audit):
            best_cost, best_audit = cost, audit
        other = written(state)
        branches = [(i, other, cost + COSTS["I"], audit + "I")]
        if i < n:
            initial, fault = rows[i]
            branches.append((i + 1, state, cost + COSTS["D"], audit + "D"))
            if fault != GONE:
                more = cost + (TRUNCATED if fault == CUT else 0)
                branches.append((i + 1, other, more + COSTS["R"], audit + "R"))
                stays = kept(state, initial)
                if stays is not None:
                    branches.append((i + 1, stays, more + COSTS["K"], audit + "K"))
        # The most promising branch is taken off the stack first.
        stack.extend(sorted(branches, key=lambda b: (b[2] + bound[b[0]], b[3]), reverse=True))
    return best_cost, best_audit


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20: dropped (0), emptied (1),
    without ``.!?`` (2), repeated (3), said by a user (4). Null roles and texts, and null ids in what is hashed, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    die = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), die.alias("die"))
    text = F.when(F.col("die") == 1, "").when(F.col("die") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("die") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("die") == 3, 2).otherwise(1)))
    return rows.where("die <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select(
        as_text("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")
    ).withColumn("digest", F.md5("text"))


ORDER = ("conv_id", "turn", "role", "digest")  # nulls first; equal rows are one row with a count


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join on keys among which null is a value like any other."""
    right = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys], how)
    return joined.drop(*[f"other_{k}" for k in keys])


def skeleton(turns: DataFrame) -> DataFrame:
    """Rows without texts: (conv_id, turn, role, digest, initial, times, blank, truncated, first).

    Equal rows of one turn are one row with ``times``; ``first`` says that no
    earlier turn has its role and text.
    """
    blank: Column = ~F.col("text").rlike(BLANK)
    flat = _rows(turns).select(*ORDER, blank.alias("blank"), (~blank & ~F.col("text").rlike(FINISHED)).alias("truncated"))
    counted = flat.groupBy(*ORDER).agg(F.count("*").alias("times"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    counted = staged(counted.withColumn("initial", F.substring("role", 1, 1)), "turns")
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    firsts = firsts.select("conv_id", F.col("least.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    return staged(_same(counted, firsts, ORDER, "left").withColumn("first", F.col("first").isNotNull()), "turns")


SEGMENTS = (
    "conv_id string, part int, block int, whole boolean, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string,"
    " first_turn string, last_turn string, low string, turns long, costs array<long>, audits array<string>"
)
NEVER = -1  # the cost of what no edits reach


class _Segment:
    """Rows of one conversation that follow each other, and their counts."""

    def __init__(self, conv: str | None, block: int):
        self.conv, self.block, self.rows = conv, block, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.low = None  # low: the first that is not null

    def add(self, turn: str | None, initial: str, blank: bool, truncated: bool, repeated: bool) -> None:
        fault = GONE if blank or repeated else CUT if truncated else FINE
        self.blank += bool(blank)
        self.duplicate += bool(repeated and not blank)
        self.truncated += fault == CUT
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in GOOD_PAIRS
        else:
            self.first_turn = turn
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
        self.rows.append((initial, fault))
        self.last_turn = turn

    def record(self, part: int, whole: bool) -> tuple:
        if whole:
            solved = [cheapest_edits(self.rows)]
        else:
            solved = [cheapest_edits(self.rows, entry, (leave,)) for entry in STATES for leave in STATES]
        costs = [NEVER if c == math.inf else int(c) for c, _ in solved]
        return (
            self.conv, part, self.block, whole, self.blank, self.duplicate, self.truncated, self.illegal, self.rows[0][0], self.rows[-1][0],
            self.first_turn, self.last_turn, self.low, self.turns, costs, [a for _, a in solved],
        )


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a range of sorted rows. A conversation that neither begins nor ends the range lies in it whole."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    records, segment, first, part = [], None, True, 0
    for frame in frames:
        part = int(frame["part"].iloc[0]) if len(frame) else part
        for conv, turn, initial, times, blank, truncated, is_first in zip(*(frame[c] for c in ("conv_id", "turn", "initial", "times", "blank", "truncated", "first"))):
            if segment is None or segment.conv != conv:
                if segment is not None:
                    records.append(segment.record(part, whole=not first and segment.block == 0))
                    first = False
                segment = _Segment(conv, 0)
            for k in range(times):
                if len(segment.rows) == SEGMENT:
                    records.append(segment.record(part, whole=False))
                    segment = _Segment(conv, segment.block + 1)
                segment.add(turn, initial, blank, truncated, not is_first or k > 0)
        if len(records) > 2000:
            yield pd.DataFrame(records, columns=names)
            records = []
    if segment is not None:
        records.append(segment.record(part, whole=False))
    yield pd.DataFrame(records, columns=names)


REPAIRS = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Fold:
    """The segments of one conversation, in order: counts, and per state the cheapest edits that lead there.

    What the edits of all states begin with is settled, so only their ends are kept apart.
    """

    def __init__(self, conv: str | None):
        self.conv, self.counts, self.turns, self.low, self.high = conv, [0, 0, 0, 0], 0, None, None
        self.last = None  # initial and turn of the row before
        self.settled: list[str] = []
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, row) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += getattr(row, name)
        self.turns += row.turns
        if self.last is not None:
            self.counts[3] += self.last[0] + row.first_initial not in GOOD_PAIRS
            self.turns -= row.first_turn is not None and self.last[1] == row.first_turn
        self.last = (row.last_initial, row.last_turn)
        self.low = row.low if self.low is None else self.low
        self.high = row.last_turn  # nulls come first
        if row.whole:
            self.ways, self.settled = {START: (row.costs[0], row.audits[0])}, []
            return
        after: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in self.ways.items():
            for leave in STATES:
                more, edits = row.costs[entry * len(STATES) + leave], row.audits[entry * len(STATES) + leave]
                if more != NEVER:
                    way = (cost + int(more), audit + edits)
                    after[leave] = min(after.get(leave, way), way)
        common = os.path.commonprefix([audit for _, audit in after.values()])
        self.settled.append(common)
        self.ways = {state: (cost, audit[len(common):]) for state, (cost, audit) in after.items()}

    def record(self) -> tuple:
        cost, audit = min(self.ways[state] for state in (START, ASSISTANT) if state in self.ways)
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return self.conv, gaps, *self.counts, cost, "".join(self.settled) + audit


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, fold = [c.split()[0] for c in REPAIRS.split(", ")], None
    for frame in frames:
        records = []
        for row in frame.itertuples(index=False):
            if fold is None or fold.conv != row.conv_id:
                if fold is not None:
                    records.append(fold.record())
                fold = _Fold(row.conv_id)
            fold.add(row)
        yield pd.DataFrame(records, columns=names)
    if fold is not None:
        yield pd.DataFrame([fold.record()], columns=names)


def structure_repairs(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``turns``.

    Columns conv_id, turn, role and text are read, others ignored. A null role or
    text is one space; null ids are one conversation; null turns come first. Rows
    of one turn follow by role, then by the text's md5; equal rows are repeats.
    Each row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (does not end in ``.!?``). ``illegal`` are neighbours that are not
    su, ua or au by their initials, ``gaps`` turns missing between the first and
    the last. An empty table gives an empty table.
    """
    kind = turns.schema["conv_id"].dataType
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = skeleton(turns).repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    ranged = ranged.select("conv_id", as_text("turn"), "initial", "times", "blank", "truncated", "first", F.spark_partition_id().alias("part"))
    segments = staged(ranged.mapInPandas(_segments, SEGMENTS), "segments")
    dealt = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "block")
    return dealt.mapInPandas(_folded, REPAIRS).withColumn("conv_id", F.col("conv_id").cast(kind))


def _with_audits(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.lit(None).cast("string")
    heads = repairs.select(as_text("conv_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("digest"), F.col("audit").alias("text"))
    rows = _rows(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    dealt = heads.unionByName(rows).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return dealt.select("conv_id", "kind", "role", "text")


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Per frame: (conv_id, edit, role, text) of every edit; a conversation begins with the edit ''."""
    conv, state, edits = None, START, iter(())
    names = {USER: "user", ASSISTANT: "assistant"}

    def inserted() -> Iterator[tuple]:
        """The Inserts that come next, and the edit after them."""
        nonlocal state
        for edit in edits:
            if edit != "I":
                yield edit, None
                return
            state = written(state)
            yield edit, (conv, "I", names[state], "")

    ahead: Iterator[tuple] = iter(())
    for frame in chain(frames, [None]):
        out = []
        rows = zip(*(frame[c] for c in ("conv_id", "kind", "role", "text"))) if frame is not None else [(None, 0, None, "")]
        for next_conv, kind, role, text in rows:
            if kind == 0:  # what is inserted after the last row of the conversation before
                out.extend(row for _, row in inserted() if row)
                conv, state, edits = next_conv, START, iter(text)
                if frame is not None:
                    out.append((conv, "", None, None))
                continue
            for edit, row in inserted():
                if row:
                    out.append(row)
                elif edit == "D":
                    out.append((conv, "D", role, text))
                else:
                    initial = role[:1]
                    stays = kept(state, initial) if edit == "K" else None
                    state = written(state) if edit == "R" else stays
                    out.append((conv, edit, names[state] if edit == "R" else role, text))
        yield out


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, from place 0 on; edits are Keep, Rerole and Insert by their initials."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = 0
        for rows in _edited(frames):
            out = []
            for conv, edit, role, text in rows:
                if edit and edit != "D":
                    out.append((conv, place, edit, role, text))
                    place += 1
                elif not edit:
                    place = 0
            yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"])

    kind = turns.schema["conv_id"].dataType
    repaired = _with_audits(turns, repairs).mapInPandas(run, "conv_id string, place long, edit string, role string, text string")
    return repaired.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_digests(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each repaired conversation's ``role:text``, joined by newlines, fed row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest, fed = None, None, False
        for rows in _edited(frames):
            out = []
            for row_conv, edit, role, text in rows:
                if not edit:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, fed = row_conv, hashlib.sha256(), False
                elif edit != "D":
                    digest.update(("\n" * fed + role + ":" + text).encode())
                    fed = True
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv_id", "repaired_sha256"])

    kind = turns.schema["conv_id"].dataType
    digests = _with_audits(turns, repairs).mapInPandas(run, "conv_id string, repaired_sha256 string")
    return digests.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair_summary(original: DataFrame, turns: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of every conversation of ``original`` as it stands in ``turns``; zeros and an empty repair where nothing of it is left."""
    repairs = staged(structure_repairs(turns), "repairs")
    done = _same(repairs, repaired_digests(turns, repairs), ("conv_id",), "left")
    rows = _same(original.select("conv_id").distinct(), done, ("conv_id",), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
