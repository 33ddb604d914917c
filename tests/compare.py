"""Run registered queries beside their SQL and compare the rows.

    python -m tests.compare [--sf DIR] [--only name,name] [--quick]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v) if not hasattr(v, "asDict") else repr(v.asDict())


def family(spark_type: str, duck_type: str) -> bool:
    same = {
        "int": "INTEGER",
        "bigint": "BIGINT",
        "double": "DOUBLE",
        "string": "VARCHAR",
        "date": "DATE",
        "boolean": "BOOLEAN",
        "float": "FLOAT",
    }
    return same.get(spark_type, "?") == duck_type or (spark_type.startswith("timestamp") and duck_type.startswith("TIMESTAMP"))


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    took = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{len(got)} rows only ({took:.1f}s)"
    t0 = time.time()
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(rel.columns) != columns:
        return False, f"columns {columns} vs {sorted(rel.columns)}"
    want = [tuple(plain(v) for v in row) for row in rel.select(*[f'"{c}"' for c in columns]).fetchall()]
    note = ", ".join(f"{c}: {t} vs {types[c]}" for c, t in sorted(df.dtypes) if not family(t, types[c]))
    if sorted(got) == sorted(want):
        return not note, f"{len(got)} rows ({took:.1f}s, sql {time.time() - t0:.1f}s)" + (f" TYPES {note}" if note else "")
    only_a, only_b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return False, f"{len(got)} vs {len(want)} rows\n   {columns}\n   spark {only_a}\n   sql   {only_b} {note}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--prefix", default="")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from riskgrid.session import local_session

    spark = local_session(8)
    con = connect(args.sf)
    sql = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if args.only and name not in args.only.split(","):
            continue
        if args.prefix and not name.startswith(tuple(args.prefix.split(","))):
            continue
        try:
            ok, text = compare(spark, con, args.sf, name, fn, sql.get(name))
        except Exception as exc:  # report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(("ok  " if ok else "BAD "), name, text, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
