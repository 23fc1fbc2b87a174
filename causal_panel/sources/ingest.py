"""Incremental ingest: a panel follows its raw files, and a manifest says which of them it holds.

The manifest stands next to the panel and has path, length, modification time
and digest of every file. A run lists the files, reads those the manifest does
not know as they are, and writes again only the partitions of their entities.
It is written last: a run that fails is made up for by the next.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged
from ..spec import PanelSpec
from .panels import STEM, _exists, _filesystem, read_psv_panel, union_all, with_hour

BUCKET = "_bucket"  # of an entity: with the site, the partition of its rows


def manifest_path(out: str) -> str:
    return out.rstrip("/") + "-manifest"


def listed_files(spark: SparkSession, sources: Mapping[str, str], glob: str, entity_pattern: str, buckets: int) -> DataFrame:
    """(site, path, entity, bucket, length, modified) of every raw file; contents are not read."""
    def of(site: str, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        entity = F.regexp_extract("path", entity_pattern, 1)
        return files.select(
            F.lit(site).alias("site"), "path", entity.alias("entity"), F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int").alias(BUCKET),
            "length", F.col("modificationTime").alias("modified"),
        )

    return reduce(DataFrame.unionByName, [of(*source) for source in sources.items()])


def _digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.sha2("content", 256).alias("digest"))


def refresh_panel(
    spark: SparkSession, sources: Mapping[str, str], spec: PanelSpec, out: str, glob: str = "p*.psv", entity_pattern: str = STEM, clock: str = "ICULOS", buckets: int = 64
) -> DataFrame:
    """(site, entity, path, change): bring the panel at ``out`` up to date and say which files were ``read`` or are ``gone``.

    Files of the same length and modification time as before are not opened; one
    that was only touched is hashed and not read. An entity has one file. The
    paths of new files pass through the driver, which Spark's own listing of
    them does as well. ``read_panel`` reads the result.
    """
    now = staged(listed_files(spark, sources, glob, entity_pattern, buckets), "raw-files")
    known = _exists(spark, manifest_path(out))
    before = spark.read.parquet(manifest_path(out)) if known else now.withColumn("digest", F.lit("")).limit(0)
    before = staged(before, "manifest")
    same = ["site", "path", "length", "modified"]
    fresh = now.join(before, same, "left_anti")
    paths = [r.path for r in fresh.select("path").collect()]
    digests = _digests(spark, paths) if paths else now.select("path", F.lit("").alias("digest")).limit(0)
    hashed = staged(fresh.join(digests, "path"), "new-files")
    manifest = now.join(before.select(*same, "digest"), same).unionByName(hashed)

    new = hashed.join(before.select("site", "path", "digest"), ["site", "path", "digest"], "left_anti")
    gone = before.join(now.select("site", "path"), ["site", "path"], "left_anti")
    named = lambda files, change: files.select("site", "entity", BUCKET, "path", F.lit(change).alias("change"))
    changes = staged(named(new, "read").unionByName(named(gone, "gone")), "changes")
    if not changes.isEmpty():
        _rewrite(spark, sources, spec, out, changes, entity_pattern, clock)
    if not known or not fresh.isEmpty() or not changes.isEmpty():
        staged(manifest, "manifest").write.mode("overwrite").parquet(manifest_path(out))
    return changes.drop(BUCKET)


def _rewrite(spark, sources, spec: PanelSpec, out: str, changes: DataFrame, entity_pattern: str, clock: str) -> None:
    """Write the partitions of changed entities again: their rows from new files, all others' as they were."""
    site = spec.site or "site"
    keys = [F.col("site").alias(site), F.col("entity").alias(spec.entity)]
    touched = changes.select(F.col("site").alias(site), BUCKET).distinct()
    parts = []
    for name in sources:
        paths = [r.path for r in changes.where((F.col("site") == name) & (F.col("change") == "read")).select("path").collect()]
        if paths:
            rows = with_hour(read_psv_panel(spark, paths, spec, name, "*", entity_pattern), spec, clock)
            parts.append(rows if spec.site else rows.withColumn(site, F.lit(name)))
    if parts:
        bucket = changes.select(*keys, BUCKET).distinct()
        parts = [union_all(parts).join(bucket, [site, spec.entity])]
    if _exists(spark, out):
        held = spark.read.parquet(out)
        parts.append(held.join(touched, [site, BUCKET], "left_semi").join(changes.select(*keys).distinct(), [site, spec.entity], "left_anti"))
    rows = staged(union_all(parts), "panel-partitions")  # what is read here is overwritten below
    placed = rows.repartition(site, BUCKET, spec.entity, F.floor(F.col(spec.order) / 16_384)).sortWithinPartitions(site, BUCKET, spec.entity, spec.order)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(site, BUCKET).parquet(out)
    # At most buckets x sites: partitions that nothing is left of.
    for r in touched.join(rows.select(site, BUCKET).distinct(), [site, BUCKET], "left_anti").collect():
        fs, path = _filesystem(spark, f"{out}/{site}={r[site]}/{BUCKET}={r[BUCKET]}")
        fs.delete(path, True)


def read_panel(spark: SparkSession, out: str, spec: PanelSpec) -> DataFrame:
    panel = spark.read.parquet(out).drop(BUCKET)
    return panel if spec.site else panel.drop("site")
