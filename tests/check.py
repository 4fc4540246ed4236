"""Run registered queries next to their SQL: ``python tests/check.py [sf] [substring ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, sf_dir):
    """(ok, message, number of rows)."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None, "rows only", len(got)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows_of(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return False, f"columns {got_names} vs {want_names}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; e.g. {[r for r in got if r not in want][:2]} / {[r for r in want if r not in got][:2]}"[:1500], len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return False, f"{len(bad)} differ {sorted(got_names)}: {bad[:3]}"[:1500], len(got)
    return True, "ok", len(got)


if __name__ == "__main__":
    from barloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark, con = build_session("check"), duck(sf_dir)
    bad = 0
    names = [n for n in entry.queries() if not keys or any(n.startswith(k) for k in keys)]
    for n in names:
        t = time.time()
        try:
            ok, msg, rows = compare(spark, con, n, sf_dir)
        except Exception as ex:  # report and go on
            ok, msg, rows = False, f"{type(ex).__name__}: {str(ex)[:900]}", -1
        flag = {True: "ok  ", None: "rows", False: "FAIL"}[ok]
        if ok is not True or rows == 0 or "-v" in keys:
            print(f"{flag} {n} rows={rows} {time.time() - t:.1f}s {msg if ok is not True else ''}", flush=True)
        bad += ok is False
    print(f"{len(names)} checked, {bad} failed")
