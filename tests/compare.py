"""Runs the registered queries and their SQL side by side and compares the rows.

    python -m tests.compare [folder] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "SMALLINT": "smallint",
    "TINYINT": "tinyint", "HUGEINT": "hugeint",
}


def compare(spark, folder, queries, out=print):
    """Names of the queries that differ; ``queries`` maps names to functions."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sqls, bad = entry.oracle_sql(), []
    for name, fn in queries.items():
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = df.collect()
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            out(f"ERROR {name}: {str(e)[:1500]}")
            continue
        took = time.time() - start
        if name not in sqls:
            out(f"rows  {name}: {len(rows)} rows {took:.2f}s")
            continue
        try:
            cur = con.execute(sqls[name])
            names = [d[0] for d in cur.description]
            types = [str(d[1]) for d in cur.description]
            wanted = cur.fetchall()
        except Exception as e:
            bad.append(name)
            out(f"SQLERR {name}: {str(e)[:1200]}")
            continue
        notes = []
        mine = dict(df.dtypes)
        if sorted(names) != sorted(df.columns):
            notes.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
        else:
            for n, t in zip(names, types):
                if KINDS.get(t, t) != mine[n]:
                    notes.append(f"type {n}: {mine[n]} vs {t}")
            a, b = bag(rows, df.columns), bag(wanted, names)
            if len(a) != len(b):
                notes.append(f"rows {len(a)} vs {len(b)}")
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                notes.append(f"values {sorted(names)} {diff}")
        if notes:
            bad.append(name)
            out(f"DIFF  {name}: {len(rows)} rows {took:.2f}s " + " | ".join(notes)[:1500])
        else:
            empty = "" if rows else " EMPTY"
            out(f"ok    {name}: {len(rows)} rows {took:.2f}s{empty}")
    return bad


if __name__ == "__main__":
    from vouchlens.session import local_session

    session = local_session("compare", "8")
    session.sparkContext.setLogLevel("ERROR")
    args = sys.argv[1:]
    where = args[0] if args else "/root/testdata/sf0.01"
    import __spark_entry__

    chosen = {
        n: q
        for n, q in __spark_entry__.queries().items()
        if not args[1:] or any(n.startswith(p) for p in args[1:])
    }
    failed = compare(session, where, chosen)
    print(f"{len(chosen)} queries, {len(failed)} bad: {failed}")
    sys.exit(1 if failed else 0)
