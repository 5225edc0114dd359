"""Compare queries with their SQL, or look at their rows: python tests/oracle.py [SF_DIR] [NAME...]"""

import decimal
import glob
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return int(f) if f.is_integer() and abs(f) < 2**53 else round(f, 9) if math.isfinite(f) else str(f)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None if all is well, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} {sorted(cols)}"
    if got == want:
        return None if got else "no rows"
    a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows, {len(want)} expected; only here {a}; only there {b}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or qs:
        began = time.time()
        try:
            bad = compare(spark, con, name, qs[name], sqls.get(name), sf)
        except Exception as e:
            bad = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if bad is None else 'BAD '} {name} {time.time() - began:.1f} s{'' if name in sqls else ' (no SQL)'} {bad or ''}", flush=True)
