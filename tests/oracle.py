"""Run queries next to their SQL and compare the rows.

Usage: python tests/oracle.py [folder] [name ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, db, name, query, sql, folder):
    """None if equal, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not want:
        return "no rows"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"{len(got)} rows, expected {len(want)}; extra {str(extra)[:700]}; missing {str(missing)[:700]}"
    types = {n: (KINDS.get(t, t), kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]}
    return f"types {types}" if types else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db, oracles = connect(folder), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, name, query, oracles[name], folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
