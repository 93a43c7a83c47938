"""Run registered queries against their SQL: python tools/check.py [sf_dir] [name ...]"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from floodlens.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return f"{type(value).__name__}:{value}"


def oracle(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    return names, types, res.fetchall()


def compare(df, sf, sql):
    names, types, rows = oracle(sf, sql)
    got = [tuple(r) for r in df.collect()]
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"], len(got)
    duck = dict(zip(names, types))
    for n in names:
        pair = (spark_types[n], duck[n])
        same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}.get(pair[0])
        if same != pair[1] and pair[0] not in ("timestamp",):
            problems.append(f"type of {n}: {pair}")
    order = sorted(names)
    a = sorted([tuple(normal(r[df.columns.index(n)]) for n in order) for r in got])
    b = sorted([tuple(normal(r[names.index(n)]) for n in order) for r in rows])
    if len(a) != len(b):
        problems.append(f"rows: spark {len(a)} sql {len(b)}")
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        problems.append(f"values differ in {len(set(a) - set(b))} rows\n   cols  {order}\n   spark {only_a}\n   sql   {only_b}")
    return problems, len(got)


def main():
    from floodlens.plans.catalogue import QUERIES, SQL
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    picked = args or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in picked:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf)
            if name in SQL:
                problems, n = compare(df, sf, SQL[name])
            else:
                problems, n = [], len(df.collect())
        except Exception as e:
            problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        bad += bool(problems)
        kind = "sql " if name in SQL else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name:28s} rows {n:7d} {time.perf_counter() - start:6.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print(f"{len(picked) - bad} of {len(picked)} good", flush=True)


if __name__ == "__main__":
    main()
