"""Run registered queries next to their DuckDB text and compare rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from fjelldoc.sources.tables import BASE


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)), sorted(cols)


_FAMILY = {"int": "int", "bigint": "bigint", "double": "double", "string": "string", "boolean": "boolean"}
_DUCK = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    res = con.execute(sql)
    duck_types = {d[0]: _DUCK.get(str(d[1]), str(d[1])) for d in res.description}
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    types = dict(df.dtypes)
    bad = {c: (types[c], duck_types[c]) for c in got_cols if _FAMILY.get(types[c], types[c]) != duck_types[c]}
    if bad:
        return f"types (spark, duckdb): {bad}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"cols {got_cols}\n   spark {str(g)[:700]}\n   duck  {str(w)[:700]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from fjelldoc.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = build_session()
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                t1 = time.time()
                diff = compare(df, con, sqls[name])
                n = ""
            else:
                rows = df.collect()
                diff, n = None, f"rows-only {len(rows)}"
        except Exception as e:  # report and go on with the next query
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", ""
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t0:.1f}s {n} {diff or ''}", flush=True)
    print(f"{bad} failing of {len(qs)}; oracles {len(sqls)}")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1:])
