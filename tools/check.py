"""Compare the registered queries with their SQL counterparts: ``python tools/check.py [sf_dir] [prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trendlab.catalog import REGISTRY  # noqa: E402
from trendlab.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: [(v is not None, str(v)) for v in t])


def main(argv):
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    spark = local_session()
    bad = []
    for key, query in REGISTRY.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            t0 = time.time()
            frame = query.run(spark, sf_dir)
            got = normal([tuple(r) for r in frame.collect()], frame.columns)
            t1 = time.time()
            sql = query.oracle()
            if sql is None:
                print(f"--   {key}: {len(got)} rows, no SQL, {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(sql)
            want = normal(cur.fetchall(), [d[0] for d in cur.description])
            t2 = time.time()
        except Exception as exc:  # noqa: BLE001
            bad.append(key)
            print(f"ERR  {key}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            continue
        same = got == want
        print(f"{'ok  ' if same else 'DIFF'} {key}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s", flush=True)
        if not same:
            bad.append(key)
            print("     columns", sorted(frame.columns), "rows", len(got), len(want))
            shown = 0
            for a, b in zip(got, want, strict=False):
                if a != b:
                    print("     spark", a, "\n     sql  ", b)
                    shown += 1
                    if shown >= 3:
                        break
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
