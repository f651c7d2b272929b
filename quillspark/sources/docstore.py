"""A document store as a Parquet table keyed by ``doc_id``.

Nulls: a row without an id or a text is rejected on write. Reading a store that has no files raises Spark's
missing-path error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.runtime import materialize

SCHEMA = "doc_id long, text string"


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only

    def _write(self, documents: DataFrame, mode: str) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").write.mode(mode).parquet(self.path)

    def bulk_load(self, documents: DataFrame) -> None:
        """Replace the store; files are ordered by id, so point lookups skip most of them."""
        self._write(documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "overwrite")

    def add(self, documents: DataFrame) -> None:
        """Put documents: a known id gets the new text, so an id is never there twice. Documents of new ids only, which is
        measured, are appended; else the store is written anew."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        new = upsert(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").limit(0), documents.filter("doc_id IS NOT NULL AND text IS NOT NULL"))
        new = materialize(new)
        if self.rows().join(new, "doc_id", "left_semi").isEmpty():
            self._write(new, "append")
        else:
            self.bulk_load(materialize(upsert(self.rows(), new)))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def get(self, doc_id: int) -> DataFrame:
        """The document of one id, or no row; the filter reaches the scan."""
        return get(self.rows(), doc_id)

    def scan(self) -> DataFrame:
        return scan(self.rows())

    def keys(self) -> DataFrame:
        return keys(self.rows())

    def size(self) -> int:
        return self.rows().count()


def get(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.filter(F.col("doc_id") == doc_id)


def scan(documents: DataFrame) -> DataFrame:
    """All documents in order of their ids."""
    return documents.orderBy("doc_id")


def keys(documents: DataFrame) -> DataFrame:
    """Ids only; no other column is read."""
    return documents.select("doc_id")


def upsert(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """``documents`` with rows of ``changes`` put over those of equal id; of repeated ids in one side one row stays, by the largest text."""
    rows = documents.select("doc_id", "text", F.lit(0).alias("_turn")).unionByName(changes.select("doc_id", "text", F.lit(1).alias("_turn")))
    best = rows.groupBy("doc_id").agg(F.max(F.struct("_turn", "text")).alias("_best"))
    return best.select("doc_id", F.col("_best.text").alias("text"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``ordinal``, their place from 0 in order of ``key``, without bringing them into one task.

    Rows are range-partitioned and written once; a row's place is its number in its partition plus the sizes of
    the partitions before, of which there is one small row each.
    """
    placed = materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("ordinal", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_before")
