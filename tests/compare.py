"""Run registered queries against their SQL: ``python tests/compare.py [sf] [name ...]``."""

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def one(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        return repr(v)
    lines = sorted("|".join(one(r[i]) for i in order) for r in rows)
    return sorted(columns), len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return got[1], None
    rel = con.execute(sql)
    want = canonical(rel.fetchall(), [c[0] for c in rel.description])
    if got[:3] == want[:3]:
        return got[1], True
    return got[1], (got[:2], want[:2], [a for a in got[3] if a not in set(want[3])][:2], [b for b in want[3] if b not in set(got[3])][:2])


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            n, ok = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as e:
            n, ok = -1, str(e)[:1500]
        bad += ok not in (True, None)
        print(f"{name:24s} {n:8d} {time.time() - t:6.2f}s", {True: "ok", None: "rows only"}.get(ok if ok in (True, None) else 0, ok), flush=True)
    print("bad:", bad, "missing sql:", [q for q in queries if q not in oracles])
