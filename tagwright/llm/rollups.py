"""Token totals maintained by deltas.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of changes is turned into deltas
against what the touched documents gave before: an insert adds, a delete takes the old count away, a revised count does
both. Only the touched documents are looked up, the corpus is never counted again.

A batch has an id and is written in three steps below ``root``: the new state of its documents, its summed deltas, and
last a line in the list of commits. Reads use committed batches only. A batch that is sent again after its commit
changes nothing; one that died half-way is written anew over its own folders. So a batch counts exactly once. Batches
come in the order of their ids: an id below a committed one is refused, as its changes would be older than what stands.

State lies in buckets of document ids, and a commit reads the buckets it touches. After every few batches the last
contribution of each document and the totals are written together as a *base*, and what they replace is deleted, so
neither a commit nor a read goes through the whole history. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.storage import remove

KEYS = ["source", "lang", "tokenizer"]
BUCKETS = 64
BATCHES = 8  # batches behind the last base before the next one is written
_STATE = "doc_id bigint, tokenizer string, source string, lang string, docs bigint, tokens bigint, batch bigint, bucket int"
_DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint, batch bigint"


class TokenRollup:
    """Totals kept in the shared folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, batches: int = BATCHES):
        self.spark, self.root, self.batches = spark, root.rstrip("/"), batches
        for name in ("commits", "bases"):
            spark.createDataFrame([], "batch bigint").write.mode("append").parquet(f"{self.root}/{name}")

    def _ids(self, name: str) -> list[int]:
        """Batch ids in a list of commits or bases: one number each."""
        rows = self.spark.read.schema("batch bigint").parquet(f"{self.root}/{name}")
        base = rows.agg(F.max("batch")).first()[0] if name == "bases" else None
        return [base] if base is not None else sorted(r[0] for r in rows.distinct().collect())

    def _add(self, name: str, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).write.mode("append").parquet(f"{self.root}/{name}")

    def committed(self) -> DataFrame:
        """Ids of the committed batches."""
        return self.spark.read.schema("batch bigint").parquet(f"{self.root}/commits").distinct()

    def _rows(self, kind: str, schema: str) -> DataFrame:
        """Rows of the last base and of the batches committed since."""
        bases = self._ids("bases")
        since = [b for b in self._ids("commits") if not bases or b > bases[-1]]
        rows = self.spark.createDataFrame([], schema)
        for folder, ids in ((f"base-{kind}", bases), (kind, since)):
            if ids:
                read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{folder}")
                rows = rows.unionByName(read.parquet(*[f"{self.root}/{folder}/batch={b}" for b in ids]))
        return rows

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """The last committed contribution of every document and tokenizer; ``docs`` is 0 after a delete."""
        rows = self._rows("state", _STATE)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        last = rows.groupBy("doc_id", "tokenizer").agg(
            F.max_by(F.struct("source", "lang", "docs", "tokens"), "batch").alias("s"))
        return last.select("doc_id", "tokenizer", "s.*")

    def _write_state(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.partitionBy(
            "bucket").mode("overwrite").parquet(path)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` as batch ``batch``; False if it was committed before, an error if a later one was.

        ``changes``: ``doc_id``, ``op`` (insert, delete or revise), ``source``, ``lang``, ``tokenizer``, ``tokens``. An
        insert of a document that is there revises it, a revision of one that is not inserts it, and a delete of one
        that is not does nothing. Of several changes to a document and tokenizer a delete wins, then the largest count.
        Rows with a null document id or tokenizer, which no later batch could name, or an unknown op are left out; null
        counts are 0; null sources and languages are groups of their own. A batch without changes is committed like any
        other. Other columns are not looked at.
        """
        done = self._ids("commits")
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}, which is committed")
        known = F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull() & F.col("op").isin("insert", "delete", "revise")
        ranked = F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
                          F.col("source"), F.col("lang"))
        asked = changes.where(known).select(F.col("doc_id").cast("bigint"), "tokenizer", ranked.alias("r"))
        asked = asked.groupBy("doc_id", "tokenizer").agg(F.max("r").alias("r"))
        new = asked.select(
            "doc_id", "tokenizer", F.col("r.source").alias("source"), F.col("r.lang").alias("lang"),
            F.when(F.col("r.gone"), 0).otherwise(1).cast("bigint").alias("docs"),
            F.when(F.col("r.gone"), 0).otherwise(F.col("r.tokens")).cast("bigint").alias("tokens"))
        path = f"{self.root}/state/batch={batch}"
        self._write_state(new, path)
        new = self.spark.read.schema(_STATE).parquet(path)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        old = self.state(touched).join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        signed = new.where("docs > 0").select(*KEYS, "docs", "tokens").unionByName(
            old.where("docs > 0").select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        deltas = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        self._add("commits", batch)
        bases = self._ids("bases")
        if len([b for b in [*done, batch] if not bases or b > bases[-1]]) >= self.batches:
            self._compact(batch)
        return True

    def _compact(self, batch: int) -> None:
        """Write the state and totals up to ``batch`` as one base, then delete what it replaces."""
        bases = self._ids("bases")
        old = [b for b in self._ids("commits") if b <= batch and (not bases or b > bases[-1])]
        self._write_state(self.state().where("docs > 0"), f"{self.root}/base-state/batch={batch}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/base-deltas/batch={batch}")
        self._add("bases", batch)
        for kind, ids in (("", old), ("base-", bases)):
            for b in ids:
                remove(self.spark, f"{self.root}/{kind}state/batch={b}")
                remove(self.spark, f"{self.root}/{kind}deltas/batch={b}")

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``docs``, ``tokens`` over all committed batches; empty groups are left out."""
        sums = self._rows("deltas", _DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")
