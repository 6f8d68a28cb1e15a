"""Compare registered queries with their SQL on DuckDB.

usage: check_oracles.py [--sf DIR] [--slow SECONDS] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import logging
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelmill.plans import catalog  # noqa: E402
from voxelmill.session import local_session  # noqa: E402


def normal(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(normal(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--new", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = duckdb.connect()
    for f in os.listdir(args.sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{args.sf}/{f}'")
    bad = 0
    picked = [n for n in catalog.QUERIES if not args.names or any(n == p or (p.endswith('*') and n.startswith(p[:-1])) for p in args.names)]
    for name in picked:
        t0 = time.time()
        try:
            got = catalog.QUERIES[name](spark, args.sf).toPandas()
            t1 = time.time()
            if name not in catalog.ORACLES:
                print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(catalog.ORACLES[name]).df()
            t2 = time.time()
            gc, gr = rows(got)
            wc, wr = rows(want)
            types = "" if [str(got[c].dtype) for c in gc] == [str(want[c].dtype) for c in wc] else \
                " TYPES " + str([(c, str(got[c].dtype), str(want[c].dtype)) for c in gc if c in want and str(got[c].dtype) != str(want[c].dtype)])
            if gc != wc:
                bad += 1
                print(f"FAIL {name} columns {gc} != {wc}", flush=True)
            elif gr != wr:
                bad += 1
                diff_a = [x for x in gr if x not in set(wr)][:3]
                diff_b = [x for x in wr if x not in set(gr)][:3]
                print(f"FAIL {name} rows {len(gr)} vs {len(wr)}; spark only {diff_a}; sql only {diff_b}{types}", flush=True)
            else:
                print(f"ok   {name} {len(gr)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s{types}{' EMPTY' if not gr else ''}", flush=True)
        except Exception as exc:  # report and go on
            bad += 1
            print(f"ERR  {name} {type(exc).__name__} {str(exc)[:600]}", flush=True)
    print(f"{len(picked)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
