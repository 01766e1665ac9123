"""Run registered queries against their DuckDB SQL on the same Parquet files
and compare column names, row counts and an order-insensitive value digest.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    body = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, body


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "sec": round(t1 - t0, 2)}
    rel = con.sql(sql)
    dcols = list(rel.columns)
    drows = rel.fetchall()
    sc, sb = digest(scols, srows)
    dc, db = digest(dcols, drows)
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "sec": round(t1 - t0, 2)}
    if sc != dc:
        res.update(status="schema", spark_cols=sc, oracle_cols=dc)
    elif len(sb) != len(db):
        res["status"] = "rowcount"
    elif sb != db:
        bad = next(i for i in range(len(sb)) if sb[i] != db[i])
        res.update(status="values", spark=sb[bad], oracle=db[bad])
    else:
        res["status"] = "ok"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from dashframe.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            res = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            res = {"name": name, "status": "error", "error": repr(exc)[:400]}
        if res["status"] not in ("ok", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{len(names or qs) - bad} ok/rows-only, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
