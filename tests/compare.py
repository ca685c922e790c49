"""Run registered queries and compare them with DuckDB on the same tables.

    python tests/compare.py [--sf 0.01] [name or prefix* ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql):
    got_names = spark_df.columns
    got = normal(got_names, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = normal(want_names, res.fetchall())
    problems = []
    loose = [
        f"{r[0]} {r[1]}" for r in con.execute(f"DESCRIBE {sql}").fetchall() if r[1].startswith(("HUGEINT", "DECIMAL"))
    ]
    if loose:
        problems.append(f"SQL types to cast: {loose}")
    fractional = {f.name for f in spark_df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    fractional_sql = {r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall() if r[1] in ("DOUBLE", "FLOAT")}
    if fractional != fractional_sql:
        problems.append(f"fractional on one side only: {sorted(fractional ^ fractional_sql)}")
    if sorted(got_names) != sorted(want_names):
        problems.append(f"columns {sorted(got_names)} <> {sorted(want_names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} <> {len(want)}")
    if not problems and got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(bad)} rows differ, e.g.\n    spark {bad[0][0]}\n    sql   {bad[0][1]}")
    return problems, len(got)


def main(args):
    import __spark_entry__ as entry
    from rankspark.session import local_session

    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = []
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in oracles:
                problems, rows = differences(df, con, oracles[n])
            else:
                problems, rows = [], len(df.collect())
        except Exception:
            text = traceback.format_exc()
            problems, rows = [text[:150] + " ... " + text[-700:]], -1
        kind = "sql" if n in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {n:28s} {kind:4s} {rows:8d} rows {time.time() - t:6.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
        failed += [n] if problems else []
    print(f"{len(names) - len(failed)} of {len(names)} pass; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
