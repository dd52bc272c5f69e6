"""Run registered queries and their SQL on the same tables and compare the rows.

    python tools/check.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, bool):
        return ("b", value)
    if hasattr(value, "asDict"):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(normal(v) for v in value.values())
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(normal(r[i]) for i in order) for r in rows)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from cohortmill.queries.catalog import ORACLES, QUERIES
    from cohortmill.session import tuned_session
    spark = tuned_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    chosen = [q for q in QUERIES if not args.names or any(q.startswith(n) for n in args.names)]
    for name in chosen:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - begin
            if name not in ORACLES:
                print(f"rows  {name:36s} {sum(got.values()):8d} {spent:6.2f}s", flush=True)
                if not got:
                    bad.append(name)
                continue
            cursor = con.execute(ORACLES[name])
            types = {d[0]: str(d[1]) for d in cursor.description}
            want_names, want = rows_of(list(types), cursor.fetchall())
            notes = [f"{c}:{t}" for c, t in types.items() if t.startswith(("HUGEINT", "DECIMAL"))]
            same = got_names == want_names and got == want
            print(f"{'ok   ' if same else 'DIFF '} {name:36s} {sum(got.values()):8d} {spent:6.2f}s {' '.join(notes)}",
                  flush=True)
            if not same or not got:
                bad.append(name)
                print("   columns", got_names, want_names) if got_names != want_names else None
                for label, rows in (("spark only", got - want), ("sql only", want - got)):
                    print(f"   {label}: {sum(rows.values())}", list(rows)[:3])
        except Exception as error:
            bad.append(name)
            print(f"FAIL  {name:36s} {type(error).__name__}: {str(error)[:1200]}", flush=True)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} agree", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
