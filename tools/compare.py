"""Runs registered queries next to their SQL twins and compares rows, types and values.

  python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb  # noqa: E402

from lotwise.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{plain(k)}:{plain(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


FAMILY = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
          "DATE": "date", "FLOAT": "float"}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def check(q, spark, con, folder):
    """(status, message): status is ok, rows or FAIL."""
    from lotwise.plans.registry import runner

    t0 = time.time()
    try:
        df = runner(q)(spark, folder)
        cols = sorted(df.columns)
        rows = [[r[c] for c in cols] for r in df.collect()]
        types = {f.name: f.dataType.simpleString() for f in df.schema}
    except Exception as e:  # noqa: BLE001
        return "FAIL", f"spark {str(e)[:900]}"
    dt = time.time() - t0
    if q.sql is None:
        return "rows", f"{len(rows)} rows, no SQL twin, {dt:.1f}s"
    try:
        cur = con.execute(q.sql)
        dcols = [d[0] for d in cur.description]
        dtypes = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in cur.description}
        data = cur.fetchall()
    except Exception as e:  # noqa: BLE001
        return "FAIL", f"duckdb {str(e)[:700]}"
    if sorted(dcols) != cols:
        return "FAIL", f"columns {cols} vs {sorted(dcols)}"
    ix = [dcols.index(c) for c in cols]
    left = sorted("|".join(plain(v) for v in r) for r in rows)
    right = sorted("|".join(plain(r[i]) for i in ix) for r in data)
    tdiff = {c: (types[c], dtypes[c]) for c in cols if types[c] != dtypes[c] and not types[c].startswith(("array", "struct", "map"))}
    if left == right and not tdiff:
        return "ok", f"{len(left)} rows, {dt:.1f}s" + ("   EMPTY" if not left else "")
    diff = [(x, y) for x, y in zip(left, right) if x != y][:3]
    return "FAIL", f"{len(left)} vs {len(right)} rows; types {tdiff}; cols {cols}; {diff}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    from lotwise.plans import load_all

    reg = load_all()
    names = a.names or [n for n, q in reg.items() if not a.module or q.build.__module__.endswith(a.module)]
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for n in names:
        status, text = check(reg[n], spark, con, folder)
        if status == "FAIL":
            bad.append(n)
        print(f"{status:5s} {n}: {text}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
