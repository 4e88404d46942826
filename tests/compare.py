"""Compare a registered query with its SQL oracle: columns, row count, values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x) for x in t)
    )


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "int", "long", "smallint", "hugeint", "tinyint", "uint", "ubigint")):
        return "i:" + t
    return t


def compare(name, df, con, sql):
    """(ok, message)"""
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} != {bad[0][1]} cols {got_cols}"
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    wide = [c for c, t in types.items() if "huge" in t or "decimal" in t]
    nulls = [c for i, c in enumerate(got_cols) if got and all(r[i] is None for r in got)]
    note = (f" WIDE {wide}" if wide else "") + (f" ALLNULL {nulls}" if nulls else "")
    dt = dict(df.dtypes)
    tmap = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    mism = [(c, dt[c], str(dict((d[0], d[1]) for d in cur.description)[c])) for c in dt
            if tmap.get(dt[c]) and tmap[dt[c]] != str(dict((d[0], d[1]) for d in cur.description)[c]).lower()
            and str(dict((d[0], d[1]) for d in cur.description)[c]).lower() != {"double": "number", "string": "string"}.get(dt[c])]
    return bool(got) or True, f"{len(got)} rows{note}" + (f" TYPES {mism}" if mism else "")


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as E
    from hydrospark.session import get_spark

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    runs = tempfile.TemporaryDirectory(prefix="compare-")
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                             "spark.driver.memory": "8g", "spark.checkpoint.dir": runs.name})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = E.oracle_sql()
    fails = []
    for n, fn in E.queries().items():
        if wanted and not any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if n in oracles:
                ok, msg = compare(n, df, con, oracles[n])
            else:
                rows = df.collect()
                ok, msg = True, f"{len(rows)} rows, no oracle; first {rows[:1]}"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            fails.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("FAILED:", fails)
    spark.stop()
