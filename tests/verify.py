"""Compare registered queries with their SQL, as the driver does.

    python tests/verify.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(pdf):
    """Rows as a sorted list of tuples, columns by name."""
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False, name=None):
        rows.append(tuple(None if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA else v for v in row))
    return sorted(rows, key=repr_key)


def repr_key(row):
    return tuple("" if v is None else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in row)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (list, tuple)) or hasattr(a, "tolist"):
        a, b = list(a), list(b)
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, dict):
        return a == b
    try:
        return float(a) == float(b)
    except (TypeError, ValueError):
        return str(a) == str(b)


def compare(spark_pdf, duck_pdf) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    return "" if not bad else f"{len(bad)} rows differ, e.g. {bad[0]}"


def run(sf: str, names: list[str], spark) -> dict[str, str]:
    import __spark_entry__ as entry

    con, found = connect(sf), {}
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            t1 = time.time() - t
            verdict = compare(got, con.execute(oracles[name]).df()) if name in oracles else ""
            note = f"{len(got)} rows" + ("" if name in oracles else ", no SQL")
        except Exception as exc:  # report and go on
            t1, verdict, note = time.time() - t, f"{type(exc).__name__}: {str(exc)[:600]}", ""
        found[name] = verdict
        print(f"{'ok  ' if not verdict else 'FAIL'} {name:32s} {t1:6.2f}s {note} {verdict}", flush=True)
    return found


if __name__ == "__main__":
    from causal_panel.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    result = run(sf_dir, sys.argv[2:], local_session(8))
    failed = [n for n, v in result.items() if v]
    print(f"{len(result) - len(failed)} of {len(result)} agree; failed: {failed}")
