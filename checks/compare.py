"""Run registered queries against their SQL twins: ``python -m checks.compare [names...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

from tidecast.session import local_session

from . import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = _normal(df.columns, df.collect())
    took = time.time() - start
    if name not in ORACLES:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL, {took:.1f}s"
    start = time.time()
    cur = con.execute(ORACLES[name])
    want = _normal([c[0] for c in cur.description], cur.fetchall())
    sql_took = time.time() - start
    note = f"{len(got[1])} rows, {took:.1f}s / {sql_took:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}"
    kinds = [{type(v).__name__ for r in side[1] for v in (r[i],) if v is not None} for side in (got, want) for i in range(len(got[0]))]
    k = len(got[0])
    if kinds[:k] != kinds[k:]:
        note += f" TYPES {dict(zip(got[0], zip(kinds[:k], kinds[k:])))}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, first {got[0]}: {bad[0][0]} != {bad[0][1]}; {note}"
    return len(got[1]) > 0, note


def main(names: list[str]) -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = local_session(8, "checks"), connect(sf_dir), []
    for name in names or list(QUERIES):
        try:
            ok, note = check(spark, con, name, sf_dir)
        except Exception as e:  # report and go on to the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
