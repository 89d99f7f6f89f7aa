"""Run registered queries next to their SQL twins and compare the results exactly."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


TIMES: dict[str, tuple[float, float]] = {}
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp": "TIMESTAMP", "tinyint": "TINYINT",
}


def compare(spark, con, name, query, sql, sf_dir) -> list[str]:
    """Differences between a query and its twin; empty when they agree."""
    df = query(spark, sf_dir)
    start = time.time()
    got = df.collect()
    middle = time.time()
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    wanted = answer.fetchall()
    TIMES[name] = (middle - start, time.time() - middle)
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = dict(zip(names, [str(d[1]) for d in answer.description]))
    for field in df.schema.fields:
        ours = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if ours != kinds[field.name]:
            problems.append(f"type of {field.name}: {ours} != {kinds[field.name]}")
    if len(got) != len(wanted):
        problems.append(f"rows {len(got)} != {len(wanted)}")
    a, b = _rows(df.columns, got), _rows(names, wanted)
    if a != b:
        extra, absent = list((a - b).elements()), list((b - a).elements())
        problems.append(f"{len(extra)} rows differ; ours {str(sorted(map(str, extra))[:2])[:1500]} theirs {str(sorted(map(str, absent))[:2])[:1500]}")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from mailsieve.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    twins = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            if name in twins:
                problems = compare(spark, con, name, query, twins[name], sf_dir)
            else:
                problems = []
                print(f"   {name}: rows {len(query(spark, sf_dir).collect())}")
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s (run, twin: {', '.join(f'{t:.1f}' for t in TIMES.get(name, ()))}) {' ; '.join(problems)}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
