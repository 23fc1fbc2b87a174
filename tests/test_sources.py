import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from causal_panel.operators import splits
from causal_panel.operators.timeline import index_rows
from causal_panel.sources.ingest import read_panel, refresh_panel
from causal_panel.sources.panels import build_panel, content_digest, densify, ingest_audit, read_psv_panel
from causal_panel.spec import LABS, STATICS, VITALS, PanelSpec, clinical_spec

SPEC = clinical_spec()
HEADER = "|".join((*VITALS, *LABS, *STATICS, "SepsisLabel"))


def write(folder, name, hours):
    lines = [HEADER]
    for h in range(hours):
        lines.append("|".join(["80.5" if h == 1 else "NaN", *["NaN"] * 33, "70", "1", "NaN", "NaN", "-3.5", str(h + 1), str(int(h >= 2))]))
    (folder / name).write_text("\n".join(lines) + "\n")


def test_psv_panel(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    write(a, "p000001.psv", 4), write(a, "p000002.psv", 1), write(b, "p100001.psv", 3), write(a, "notes.psv", 2)
    raw = read_psv_panel(spark, str(a), SPEC, "A")
    assert raw.count() == 5 and raw.where("HR is not null").count() == 1 and raw.where(F.isnan("HR")).count() == 0
    out = str(tmp_path / "panel")
    panel = build_panel(spark, {"A": str(a), "B": str(b)}, SPEC, out)
    assert {r["hour"] for r in panel.where("patient_id = 'p000001'").collect()} == {0, 1, 2, 3}
    audit = {r["hospital"]: r for r in ingest_audit(panel, SPEC).collect()}
    assert (audit["A"]["hours"], audit["A"]["entities"], audit["A"]["positive_entities"]) == (5, 2, 1)
    write(a, "p000003.psv", 2)
    assert build_panel(spark, {"A": str(a), "B": str(b)}, SPEC, out).count() == 8
    assert build_panel(spark, {"A": str(a), "B": str(b)}, SPEC, out, force=True).count() == 10
    with pytest.raises(FileNotFoundError):
        build_panel(spark, {"A": str(tmp_path / "none")}, SPEC, str(tmp_path / "other"))
    first = content_digest(spark, str(a)).first()["digest"]
    write(a, "p000003.psv", 1)
    assert content_digest(spark, str(a)).first()["digest"] != first


def test_refresh_reads_only_what_changed(spark, tmp_path):
    a, b, out = tmp_path / "a", tmp_path / "b", str(tmp_path / "panel")
    a.mkdir(), b.mkdir()
    for k in range(6):
        write(a, f"p{k}.psv", k + 1)
    write(b, "p0.psv", 2)
    sources = {"A": str(a), "B": str(b)}

    def refresh():
        changes = refresh_panel(spark, sources, SPEC, out, buckets=4)
        held = read_panel(spark, out, SPEC).groupBy("hospital", "patient_id").count().collect()
        return sorted((r.site, r.entity, r.change) for r in changes.collect()), {(r[0], r[1]): r[2] for r in held}

    changes, held = refresh()
    assert len(changes) == 7 and held == {**{("A", f"p{k}"): k + 1 for k in range(6)}, ("B", "p0"): 2}
    before = {p: p.stat() for p in Path(out).rglob("*.parquet")}
    assert refresh() == ([], held) and before == {p: p.stat() for p in Path(out).rglob("*.parquet")}

    # An old file that would be noticed if it were read: same length and time, no rows that parse.
    old = a / "p1.psv"
    stat, text = old.stat(), old.read_text()
    old.write_text("#" * len(text))
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    write(a, "p9.psv", 3), write(a, "p2.psv", 7), (a / "p3.psv").unlink()
    os.utime(a / "p4.psv", ns=(1, 10**18))  # touched only
    changes, held = refresh()
    assert changes == [("A", "p2", "read"), ("A", "p3", "gone"), ("A", "p9", "read")]
    assert held == {("A", "p0"): 1, ("A", "p1"): 2, ("A", "p2"): 7, ("A", "p4"): 5, ("A", "p5"): 6, ("A", "p9"): 3, ("B", "p0"): 2}
    for path in [*a.glob("*.psv"), *b.glob("*.psv")]:
        path.unlink()
    write(b, "p5.psv", 1)
    assert refresh()[1] == {("B", "p5"): 1} and refresh()[0] == []


def test_index_rows_across_blocks(spark):
    rows = [("a", h) for h in (0, 3, 10, 11, 25, 40)] + [("b", 7)]
    spec = PanelSpec(order="h", vitals=("x",))
    found = index_rows(spark.createDataFrame(rows, "entity string, h int"), spec, block=8).orderBy("entity", "h").collect()
    assert [r["idx"] for r in found] == [0, 1, 2, 3, 4, 5, 0]


def test_splits_and_folds(spark):
    rows = [(f"e{e}", h, int(e % 5 == 0 and h > 2), "A" if e < 80 else "B") for e in range(100) for h in range(4)]
    panel = spark.createDataFrame(rows, "entity string, h int, y int, site string")
    assigned = splits.make_splits(panel, "entity", "y", "site", "A", 3)
    assert assigned.count() == 100 and splits.overlapping_entities(assigned, "entity").count() == 0
    sizes = {r["split"]: r["count"] for r in assigned.groupBy("split").count().collect()}
    assert sizes == {"train": 56, "val": 12, "test": 12, "external": 20}
    folds = panel.join(splits.grouped_folds(panel, "entity", "y", 4, 1), "entity")
    rates = [r["r"] for r in folds.groupBy("fold").agg(F.avg("y").alias("r")).collect()]
    assert len(rates) == 4 and max(rates) - min(rates) < 0.05
    by_row = splits.row_split(panel, ["entity", "h"], 1)
    assert by_row.where("split = 'train'").count() == 300 and by_row.count() == 400
    kept = splits.downsample_negatives(panel, "y", ["entity", "h"], 25, 1)
    assert kept.where("y = 1").count() == 20 and kept.where("y = 0").count() == 95


def _records(spark, rows):
    return spark.createDataFrame(rows, "e string, at string, a double, b double").select("e", F.col("at").cast("timestamp_ntz").alias("at"), "a", "b")


def _dense(records, chunk, attach=None):
    return densify(records, "e", "at", {c: F.col(c) for c in ("a", "b")}, chunk, attach)


@pytest.mark.parametrize("chunk", [3, 4, 100])
def test_hours_between_records_are_filled(spark, chunk):
    day = "2024-01-01"
    records = _records(spark, [
        ("x", f"{day} 01:10:00", 1.0, None), ("x", f"{day} 01:40:00", None, 2.0), ("x", f"{day} 01:50:00", 3.0, None), ("x", f"{day} 04:00:00", 4.0, None),
        ("x", f"{day} 15:30:00", None, 5.0), ("y", f"{day} 07:59:59", 6.0, None), (None, f"{day} 02:00:00", 7.0, 8.0), (None, f"{day} 04:00:00", 7.0, 8.0),
        ("z", None, 9.0, 9.0), ("y", None, 9.0, 9.0),
    ])
    found = {(r.e, r.idx): (r.h.hour, r.a, r.b) for r in _dense(records, chunk).collect()}
    held = {("x", 0): (3.0, 2.0), ("x", 3): (4.0, None), ("x", 14): (None, 5.0), ("y", 0): (6.0, None)}
    # A missing entity has hours, but nothing is looked up by it; records without a time are in no hour.
    spans = [("x", 1, 15), ("y", 7, 1), (None, 2, 3)]
    assert found == {(e, i): (h + i, *held.get((e, i), (None, None))) for e, h, n in spans for i in range(n)}
    assert _dense(records, chunk).count() == 19


def test_hours_without_records_do_not_travel(spark):
    """What is joined to hours is joined to those with records; filling the gaps is the last step, without shuffles or joins behind it."""
    records = _records(spark, [("x", "2024-01-01 01:00:00", 1.0, None), ("x", "2024-01-01 05:00:00", 2.0, None), ("y", "2024-01-01 01:00:00", 3.0, None)])
    people = spark.createDataFrame([("x", "A"), ("x", "B")], "e string, site string")
    rows = _dense(records, 3, lambda hours: hours.join(people, "e"))
    assert sorted((r.e, r.idx, r.site, r.a) for r in rows.collect()) == sorted(("x", i, s, {0: 1.0, 4: 2.0}.get(i)) for i in range(5) for s in "AB")
    for plan in (rows, _dense(records, 3)):
        above = plan._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
        assert "Join" not in above and "Repartition" not in above
