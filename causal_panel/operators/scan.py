"""Running folds over an order, without a task for a whole group.

Rows are dealt to ranges of (group, order), so a group may span many ranges and
a range hold many groups. Each range is folded where it lies, as it is written;
what it adds up to, a row per range and group, is folded along the ranges, and
every row adds what came before its range. Spark draws the bounds of the ranges
from the data and adaptive execution merges small ones, so their size follows
the data. Any associative fold fits; there are sums, largest, smallest and last
values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import staged


@dataclass(frozen=True)
class Fold:
    """How values are folded: running inside a range, over a range's rows, along ranges, and both put together."""

    running: Callable[[np.ndarray], np.ndarray]
    range_total: Callable[[str], Column]
    join: Callable[[Column, Column], Column]
    zero: bool = False  # missing values count as nothing, and so does an empty start


FOLDS = {
    "sum": Fold(np.add.accumulate, F.sum, lambda a, b: a + b, zero=True),
    "max": Fold(np.maximum.accumulate, F.max, F.greatest),
    "min": Fold(np.minimum.accumulate, F.min, F.least),
    "last": Fold(lambda x: x, lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place"))), lambda before, inside: F.coalesce(inside, before)),
}


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys among which NULL is a value like any other; the keys of ``left`` are kept."""
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_other_{k}" for k in keys])


def _filled(how: str, values: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running fold of the valid values, and from where on there is one."""
    seen = np.maximum.accumulate(np.where(valid, np.arange(len(values)), -1))
    if how == "sum":
        return FOLDS[how].running(values), np.ones(len(values), bool)
    if not valid.any():
        return values, valid
    # A gap repeats the valid value before it, or else the first one, which changes no maximum, minimum or last value.
    return FOLDS[how].running(values[np.maximum(seen, valid.argmax())]), seen >= 0


def _array(column: pa.ChunkedArray | pa.Array, zero: bool) -> tuple[np.ndarray, np.ndarray]:
    valid = np.asarray(pc.is_valid(column))
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return np.asarray(pc.fill_null(column, 0)), valid
    values = np.empty(len(column), object)
    values[:] = [0 if zero and v is None else v for v in column.to_pylist()]
    return values, valid


def _folded(by: Sequence[str], folds: dict[str, tuple[str, str]], inclusive: bool, schema: StructType):
    """Sorted rows of a range with the folds of their group's rows in it, and their place."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, carried = 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changed = np.zeros(n, bool)
            for k in by:
                column = batch.column(k)
                here, there = column[1:], column[:-1]
                differ = np.asarray(pc.fill_null(pc.not_equal(here, there), False))
                changed[1:] |= differ | (np.asarray(pc.is_null(here)) != np.asarray(pc.is_null(there)))
            first = tuple(batch.column(k)[0].as_py() for k in by)
            if key is None or first != key:
                carried = {}
            starts = [0, *np.flatnonzero(changed).tolist()]
            key = tuple(batch.column(k)[n - 1].as_py() for k in by)
            out = [batch.column(c) for c in names if c in batch.schema.names]
            out.append(pa.array(np.arange(place, place + n)))
            place += n
            for name, (how, value) in folds.items():
                values, valid = _array(batch.column(value), FOLDS[how].zero)
                result, known = np.empty(n, values.dtype), np.zeros(n, bool)
                for a, b in zip(starts, [*starts[1:], n]):
                    part, ok = values[a:b], valid[a:b]
                    before = carried.get(name) if a == 0 else None
                    if before is not None or how == "sum":  # what came before in this range goes in front
                        before = 0 if before is None else before
                        part, ok = np.concatenate([np.array([before], values.dtype), part]), np.concatenate([[True], ok])
                        total, has = _filled(how, part, ok)
                        shown = slice(1, None) if inclusive else slice(0, -1)
                        result[a:b], known[a:b] = total[shown], has[shown]
                    else:
                        total, has = _filled(how, part, ok)
                        if inclusive:
                            result[a:b], known[a:b] = total, has
                        else:
                            result[a + 1:b], known[a + 1:b] = total[:-1], has[:-1]
                    last = total[-1] if has[-1] else None
                carried[name] = last
                kind = batch.schema.field(value).type
                out.append(pa.array(result, kind, mask=~known) if result.dtype != object else pa.array([v if k else None for v, k in zip(result, known)], kind))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def range_scan(
    df: DataFrame, order: Sequence[str | Column], folds: dict[str, tuple[str, str]], by: Sequence[str] = (), inclusive: bool = False, totals: bool = False
) -> DataFrame:
    """``df`` with the folds (name -> (how, column)) of the rows before each row in its group, or up to it if ``inclusive``.

    ``totals`` adds ``name_all``, the fold of the whole group. Missing values are
    skipped; where nothing came before, a sum is 0 and others are missing. Rows
    that are equal in ``order`` follow in any order. Groups may be missing, as
    large as they like, and as many.
    """
    if any(how not in FOLDS for how, _ in folds.values()):
        raise ValueError(f"folds are {sorted(FOLDS)}")
    taken = {"_place", "_range", *folds, *(f"{n}_all" for n in folds if totals)} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist")
    extra = [StructField(name, df.schema[value].dataType) for name, (_, value) in folds.items()]
    schema = StructType([*df.schema.fields, StructField("_range", LongType()), StructField("_place", LongType()), *extra])
    keys = [*[F.col(k) for k in by], *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id().cast("long"))
    rows = staged(ranged.mapInArrow(_folded(by, folds, inclusive, schema), schema), "scan")

    sums = rows.groupBy(*by, "_range").agg(*[FOLDS[how].range_total(value).alias(f"_{name}") for name, (how, value) in folds.items()])
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a group
    whole = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    before = [along[how](f"_{name}").over(lower).alias(f"_{name}_off") for name, (how, _) in folds.items()]
    alls = [along[how](f"_{name}").over(whole).alias(f"{name}_all") for name, (how, _) in folds.items() if totals]
    # Written, so that its size is known before it is joined.
    offsets = staged(sums.select(*by, "_range", *before, *alls), "scan-offsets")

    joined = match(rows, offsets, [*by, "_range"])
    columns = [F.col(c) for c in df.columns]
    for name, (how, value) in folds.items():
        off, inside = F.col(f"_{name}_off"), F.col(name)
        if FOLDS[how].zero:
            off, inside = F.coalesce(off, F.lit(0).cast(df.schema[value].dataType)), F.coalesce(inside, F.lit(0).cast(df.schema[value].dataType))
        columns.append(FOLDS[how].join(off, inside).cast(df.schema[value].dataType).alias(name))
    zeroed = lambda name, how: F.coalesce(f"{name}_all", F.lit(0)) if FOLDS[how].zero else F.col(f"{name}_all")
    if totals:
        columns += [zeroed(name, how).cast(df.schema[value].dataType).alias(f"{name}_all") for name, (how, value) in folds.items()]
    return joined.select(*columns)
