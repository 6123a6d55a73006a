"""Run queries next to their SQL twins: ``python tests/compare.py [sf] [key ...]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tagwright")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tagwright-tests-"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    got = spark_df if hasattr(spark_df, "num_rows") else spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} != {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    types = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    types = [(n, a.replace("large_", ""), b.replace("large_", "")) for n, a, b in types]
    off = [x for x in types if x[1] != x[2]]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    a = sorted(zip(*[got.column(n).to_pylist() for n in names]), key=key)
    b = sorted(zip(*[want.column(n).to_pylist() for n in names]), key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; first: {str(bad[0][0])[:300]} | {str(bad[0][1])[:300]}"
    return f"types {off}" if off else None


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, sqls = entry.queries(), entry.oracle_sql()
    spark, con = session(), oracle(sf_dir)
    failed = []
    for key in sys.argv[2:] or queries:
        start, spent = time.time(), 0.0
        try:
            df = queries[key](spark, sf_dir).toArrow()
            spent = time.time() - start
            if key in sqls:
                text = difference(df, con, sqls[key])
            else:
                text = None
                print(f"     rows only: {df.num_rows}")
        except Exception as e:
            text = "".join(traceback.format_exception_only(e))[:1500]
        print(f"{'ok  ' if text is None else 'FAIL'} {key} {spent:.1f}s of {time.time() - start:.1f}s {text or ''}", flush=True)
        if text:
            failed.append(key)
    print("failed:", failed)


if __name__ == "__main__":
    main()
