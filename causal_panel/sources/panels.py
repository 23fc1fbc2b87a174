"""Reading raw records into an hourly panel, and auditing what was read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.scalar import latest
from ..operators.scan import match
from ..spec import PanelSpec

MISSING_TOKEN = "NaN"


def psv_schema(spec: PanelSpec) -> T.StructType:
    """Columns of one raw record file, in file order."""
    reals = [T.StructField(c, T.FloatType()) for c in (*spec.channels, *spec.statics)]
    return T.StructType([*reals, T.StructField(spec.label, T.FloatType())])


STEM = r"([^/]*)\.psv$"  # of a path


def read_psv_panel(
    spark: SparkSession, path: str | list[str], spec: PanelSpec, site: str | None = None, glob: str = "p*.psv", entity_pattern: str = STEM
) -> DataFrame:
    """Many pipe-separated files, one per entity, as one table; folders are searched to any depth.

    The entity is what the group of ``entity_pattern`` matches in the path, by
    default the file stem. Small files are packed into tasks by
    ``spark.sql.files.maxPartitionBytes`` / ``openCostInBytes``; write the panel
    to Parquet once (``build_panel``, ``ingest.refresh_panel``) rather than rereading the files.
    """
    rows = (
        spark.read.option("sep", "|")
        .option("header", True)
        .option("nullValue", MISSING_TOKEN)
        .option("enforceSchema", False)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .schema(psv_schema(spec))
        .csv(path)
    )
    entity = F.regexp_extract(F.col("_metadata.file_path"), entity_pattern, 1)
    # The remaining columns drop NaN written in other spellings as well.
    clean = [F.nanvl(F.col(c), F.lit(None).cast("float")).alias(c) for c in (*spec.channels, *spec.statics)]
    sited = [F.lit(site).alias(spec.site)] if spec.site else []
    return rows.select(*clean, F.col(spec.label).cast("tinyint").alias(spec.label), entity.alias(spec.entity), *sited)


def with_hour(rows: DataFrame, spec: PanelSpec, clock: str = "ICULOS") -> DataFrame:
    """0-based integer hour from a 1-based clock, and single precision at rest."""
    narrowed = {n: F.col(n).cast("float") for n, t in rows.dtypes if t == "double"}
    hour = {spec.order: F.col(clock).cast("int") - 1}
    return rows.withColumns({**narrowed, **hour})


def build_panel(
    spark: SparkSession, sources: dict[str, str], spec: PanelSpec, out: str, force: bool = False
) -> DataFrame:
    """Raw files of every site -> one Parquet panel partitioned by site.

    An existing panel is reused unless ``force`` is set.
    """
    if not force and is_complete(spark, out):
        return spark.read.parquet(out)
    frames = []
    for site, path in sources.items():
        if not _matches(spark, path, "p*.psv"):
            raise FileNotFoundError(f"no .psv files in {path}")
        frames.append(with_hour(read_psv_panel(spark, path, spec, site), spec))
    rows = union_all(frames)
    # Hash on (entity, hour) so that one endless entity does not fill one file.
    placed = rows.repartition(spec.site, spec.entity, F.floor(F.col(spec.order) / 16_384))
    placed.sortWithinPartitions(spec.site, spec.entity, spec.order).write.mode("overwrite").partitionBy(spec.site).parquet(out)
    return spark.read.parquet(out)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def ingest_audit(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows, entities, positive entities and their share, per site when there is one."""
    by = [spec.site] if spec.site else []
    entities = panel.groupBy(*by, spec.entity).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(spec.label).alias("_label")
    )
    return entities.groupBy(*by).agg(
        F.sum("_rows").cast("bigint").alias("hours"),
        F.count(F.lit(1)).cast("bigint").alias("entities"),
        F.sum("_label").cast("bigint").alias("positive_entities"),
        F.avg("_label").alias("positive_rate"),
    )


def densify(
    records: DataFrame,
    entity: str,
    timestamp: str,
    values: dict[str, Column],
    chunk: int = 16_384,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Irregular timestamped records -> one row per entity and hour, gaps included.

    ``values`` maps a channel name to an expression that is NULL where a record
    does not carry the channel; the latest one within an hour wins. Output:
    ``entity, h`` (timestamp), ``idx`` (hours since the entity's first), channels,
    and whatever columns ``attach`` adds to a table of hours with records: they
    hold for the hours without records that follow, too.

    Records collapse to hours before they are shuffled, and an hour goes on to
    the next one with records. Gaps are cut into runs, which are spread over
    tasks and filled last, so a very active or very long-lived entity is neither
    collected nor expanded in one place, and only hours with records travel.
    """
    at, idx = F.col(timestamp), F.col("idx")
    hour = F.date_trunc("hour", at)
    hourly = records.groupBy(entity, hour.alias("h")).agg(*[latest(c, at).alias(n) for n, c in values.items()])
    spans = records.groupBy(entity).agg(F.min(hour).alias("_first"), F.max(hour).alias("_last"))
    spans = spans.select(entity, "_first", hours_between("_first", "_last").alias("_end"))
    nth = lambda i: F.col("_first") + F.make_dt_interval(F.lit(0), i)
    # A missing entity has hours, but no values.
    known = [F.when(F.col(entity).isNotNull(), F.col(c)).alias(c) for c in values]
    seen = match(hourly, spans, [entity]).withColumn("idx", hours_between("_first", "h")).where(F.col("h") == nth(idx))
    seen = seen.select(entity, "_first", "_end", "idx", F.lit(1).alias("_kind"), *known)
    # Later runs begin with an hour of their own, whether or not it has records.
    starts = spans.where(F.col("_end") >= chunk).withColumn("_run", F.explode(F.sequence(F.lit(1), F.floor(F.col("_end") / F.lit(chunk)).cast("int"))))
    empty = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in values]
    starts = starts.select(entity, "_first", "_end", (F.col("_run") * chunk).alias("idx"), F.lit(0).alias("_kind"), *empty)
    marked = seen.unionByName(starts).withColumn("_run", F.floor(idx / F.lit(chunk)).cast("int"))
    inside = Window.partitionBy(entity, "_run").orderBy("idx", "_kind")
    stop = F.least(F.col("_end") + 1, (F.col("_run") + 1) * chunk)
    stretches = marked.withColumn("_stop", F.coalesce(F.lead("idx").over(inside), stop)).where(F.col("_stop") > idx)
    stretches = stretches.withColumn("h", nth(idx)).drop("_kind", "_end")
    if attach is not None:
        stretches = attach(stretches)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or few rows would be put into few tasks
    rows = stretches.repartition(parts, entity, "_run").withColumn("_at", F.explode(F.sequence(idx, F.col("_stop") - 1)))
    held = [c for c in stretches.columns if c not in (entity, "h", "idx", "_first", "_run", "_stop", *values)]
    return rows.select(
        entity, nth(F.col("_at")).alias("h"), F.col("_at").alias("idx"), *[F.when(F.col("_at") == idx, F.col(c)).alias(c) for c in values], *held
    )


def hours_between(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(HOUR, {start}, {end})").cast("int")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path``."""
    return _exists(spark, f"{path}/_SUCCESS")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def _matches(spark: SparkSession, path: str, glob: str) -> bool:
    fs, target = _filesystem(spark, f"{path}/{glob}")
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def content_digest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One SHA-256 per folder, rolled up over the sorted digests of its files.

    Contents are hashed where they are read; only 64 hex digits per file travel
    on. The roll-up is two-level (by leading hex digits of the file name's hash)
    so that no single row has to hold every file's digest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    digests = files.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"),
        F.sha2("content", 256).alias("digest"),
        F.col("length"),
    )
    shelf = F.substring(F.sha2(F.col("file").cast("binary"), 256), 1, 3)
    ordered = lambda a, b: F.sort_array(F.collect_list(F.struct(F.col(a), F.col(b))))
    joined = lambda a, b: F.sha2(
        F.array_join(F.transform(ordered(a, b), lambda s: F.concat_ws(":", s[a], s[b])), "\n").cast("binary"), 256
    )
    shelves = digests.groupBy("folder", shelf.alias("shelf")).agg(
        joined("file", "digest").alias("digest"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )
    return shelves.groupBy("folder").agg(
        F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), joined("shelf", "digest").alias("digest")
    )
