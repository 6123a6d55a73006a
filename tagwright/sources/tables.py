"""Driver tables and the listing view built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runs unchanged in Spark SQL and DuckDB. The document count is a scalar subquery, so nothing is cross joined.
LISTINGS_SQL = """
WITH p AS (
  SELECT p_partkey, p_name, p_type, p_size, p_retailprice,
         p_partkey % (SELECT count(*) FROM documents) AS doc_key,
         CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0
              THEN 'Brand' || substr(p_brand, 7)
              ELSE 'House ' || substr(p_brand, 7) END AS brand_txt
  FROM part)
SELECT p.p_partkey AS item_id,
       CASE WHEN p.p_partkey % 50 >= 40 THEN 'test' ELSE 'train' END AS split,
       CASE WHEN p.p_partkey % 5 IN (0, 1) THEN p.brand_txt || ' ' ELSE '' END || p.p_name ||
       CASE WHEN p.p_partkey % 4 = 0 THEN ' 14 Karat gold'
            WHEN p.p_partkey % 4 = 1 THEN ' 10 oz bottle' ELSE '' END AS name,
       CAST(1 + p.p_size % 5 AS INT) AS item_condition_id,
       CASE WHEN p.p_partkey % 37 = 0 THEN NULL
            WHEN p.p_partkey % 41 = 0 THEN 'Handmade/Others'
            ELSE p.p_type || '/' || split_part(p.p_name, ' ', 1) || '/' || split_part(p.p_name, ' ', 2)
       END AS category_name,
       CASE WHEN p.p_partkey % 5 IN (0, 2) THEN NULL ELSE p.brand_txt END AS brand_name,
       CASE WHEN p.p_partkey % 101 = 0 THEN 0.0
            ELSE round(p.p_retailprice / 10 - 88 + 4 * (p.p_size % 5) + 2 * length(p.p_type), 2)
       END AS price,
       CAST(p.p_size % 2 AS INT) AS shipping,
       CASE WHEN p.p_partkey % 11 = 0 THEN NULL
            WHEN p.p_partkey % 13 = 0 THEN 'No description yet'
            WHEN p.p_partkey % 5 = 2 AND p.p_partkey % 3 = 0 THEN p.brand_txt || ' ' || d.text
            ELSE d.text END AS item_description
FROM p JOIN documents d ON d.doc_id = p.doc_key
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Repartition a file scan that has fewer splits than the cluster has cores; larger scans pass unchanged.

    Text lengths differ widely, so a few partitions per core even out the tasks.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return scan.repartition(3 * cores, key)
    return scan


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing table, train and test rows told apart by ``split``."""
    return spark.sql(
        LISTINGS_SQL.replace("FROM part", "FROM {part}").replace("documents", "{documents}"),
        part=spread(table(spark, sf_dir, "part"), "p_partkey"),
        documents=spread(table(spark, sf_dir, "documents"), "doc_id"),
    )
