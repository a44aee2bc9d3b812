"""Compare registered queries with their SQL over the same tables.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(value):
    """One spelling per value: numbers as floats, dates as ISO text."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else what differs."""
    got = query(spark, sf_dir)
    names, mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    theirs_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} vs {theirs_names}"
    if mine == theirs:
        return None
    only = [r for r in mine if r not in set(theirs)][:2]
    other = [r for r in theirs if r not in set(mine)][:2]
    return f"rows {len(mine)} vs {len(theirs)}; spark only {only}; sql only {other}"


def main():
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from ledgerlab.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, checks[name]) if name in checks else f"no SQL, {query(spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None and not problem.startswith("no SQL")
        print(f"{"ok " if problem is None else 'BAD' if not problem.startswith('no SQL') else '-- '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
