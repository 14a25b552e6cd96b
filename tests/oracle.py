"""Compares registered queries with their SQL: python tests/oracle.py SF_DIR [NAME...]"""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


def compare(spark, name, sf_dir, queries, oracles):
    """None if both sides agree, else what differs."""
    df = queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = canonical(tuple(r) for r in df.select(*columns).toLocalIterator())
    if name not in oracles:
        return None if df.columns else "no columns"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(oracles[name])
    theirs_columns = [d[0] for d in got.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} and {sorted(theirs_columns)}"
    at = [theirs_columns.index(c) for c in columns]
    theirs = canonical(tuple(r[i] for i in at) for r in got.fetchall())
    kinds = {d[0]: str(d[1]) for d in got.description}
    if any(kinds[c] in ("HUGEINT", "INTEGER") and t == "bigint" for c, t in df.dtypes):
        return f"types {df.dtypes} and {kinds}"
    if mine != theirs:
        return f"{len(mine)} and {len(theirs)} rows; {next(((a, b) for a, b in zip(mine, theirs) if a != b), '')}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or q:
        began = time.time()
        try:
            said = compare(spark, n, sys.argv[1], q, o)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(n, f"{time.time() - began:.1f}s", said or ("ok" if n in o else "ran"), flush=True)
