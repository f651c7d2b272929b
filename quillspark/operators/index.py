"""Postings, segments and statistics.

Documents fall into segments by their ordinal; each flush makes one segment, and as soon as ``merge`` segments
exist, neighbours merge in pairs. The layout of the segments is thus a function of three numbers.
Empty documents have no postings but count in every N.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import codec
from quillspark.functions.analysis import Analyzer, standard
from quillspark.runtime import broadcast_if_small
from quillspark.sources.docstore import numbered

FLUSH, MERGE = 1000, 8


def layout(n_docs: int, flush: int = FLUSH, merge: int = MERGE) -> list[int]:
    """Sizes of the segments after adding ``n_docs`` documents and a last flush."""
    sizes: list[int] = []
    for at in range(0, n_docs, flush):
        sizes.append(min(flush, n_docs - at))
        if len(sizes) == merge:
            if merge % 2:
                raise ValueError("only an even number of segments merges in pairs")
            sizes = [sizes[k] + sizes[k + 1] for k in range(0, merge, 2)]
    return sizes


def merged_once(segments: DataFrame) -> DataFrame:
    """Neighbours 2i and 2i+1 become segment i; ids of the second follow those of the first."""
    sizes = segments.groupBy("segment_id").agg(F.count("*").alias("_n"))
    first = sizes.filter("segment_id % 2 = 0").select((F.col("segment_id") + 1).alias("segment_id"), F.col("_n").alias("_shift"))
    return segments.join(broadcast_if_small(first, 1_000_000), "segment_id", "left").select(
        (F.col("segment_id") / 2).cast("int").alias("segment_id"), (F.col("local_id") + F.coalesce("_shift", F.lit(0))).alias("local_id"), *[c for c in segments.columns if c not in ("segment_id", "local_id")]
    )


def flushed(documents: DataFrame, flush: int = FLUSH) -> DataFrame:
    """``documents`` with ``segment_id`` and ``local_id`` before any merge."""
    return numbered(documents, "doc_id").withColumn("segment_id", F.floor(F.col("ordinal") / flush).cast("int")).withColumn("local_id", F.col("ordinal") % flush).drop("ordinal")


def segmented(documents: DataFrame, flush: int = FLUSH, merge: int = MERGE) -> DataFrame:
    """``documents`` with ``segment_id`` and ``local_id`` after all merges; ranges of ordinals join as a small table."""
    rows = numbered(documents, "doc_id")
    n = rows.count()
    starts, at = [], 0
    for k, size in enumerate(layout(n, flush, merge)):
        starts.append((k, at, at + size))
        at += size
    # At most ``merge`` segments exist, so the ranges are literals.
    seg = F.lit(None).cast("int")
    low = F.lit(None).cast("long")
    for k, a, b in reversed(starts):
        inside = F.col("ordinal") < b
        seg, low = F.when(inside & (F.col("ordinal") >= a), k).otherwise(seg), F.when(inside & (F.col("ordinal") >= a), F.lit(a).cast("long")).otherwise(low)
    return rows.withColumn("segment_id", seg).withColumn("local_id", F.col("ordinal") - low).drop("ordinal")


def _listed(positional: bool):
    """Rows ``(row, tokens)`` of a batch -> ``(row, term, tf[, positions])``, each row by itself."""

    def run(batches):
        for b in batches:
            tokens = b.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
            coded = tokens.flatten().dictionary_encode()
            of, code = np.repeat(np.arange(len(b)), n), np.asarray(coded.indices)
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((place, code, of))
            of, code, place = of[order], code[order], place[order].astype(np.int32)
            first = np.ones(len(of), bool)
            first[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(of)) if len(starts) else starts
            columns = [b.column(0).take(pa.array(of[starts])), coded.dictionary.take(pa.array(code[starts])), pa.array((ends - starts).astype(np.int32))]
            if positional:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), pa.array(place)))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "term", "tf", "positions"][: len(columns)])

    return run


def _in_rows(documents: DataFrame, analyzer: Analyzer, keep: tuple[str, ...], positional: bool) -> DataFrame:
    """A document is one row, so its terms are counted where the row is, and nothing is shuffled."""
    names = [*keep, "doc_id"]
    rows = documents.select(F.struct(*names).alias("row"), analyzer(F.col("text")).alias("tokens"))
    schema = T.StructType([rows.schema["row"], T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
    if positional:
        schema = schema.add("positions", T.ArrayType(T.IntegerType()))
    made = rows.mapInArrow(_listed(positional), schema)
    return made.select(*(F.col(f"row.{c}").alias(c) for c in keep), "term", F.col("row.doc_id").alias("doc_id"), "tf", *(["positions"] if positional else []))


def postings(documents: DataFrame, analyzer: Analyzer = standard, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, term, doc_id, tf, positions)``, for documents of different ids."""
    return _in_rows(documents, analyzer, keep, True)


def frequencies(documents: DataFrame, analyzer: Analyzer = standard, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, term, doc_id, tf)``, without positions."""
    return _in_rows(documents, analyzer, keep, False)


def term_stats(documents: DataFrame, analyzer: Analyzer = standard) -> DataFrame:
    """``(term, df, idf)`` with idf = log10(N / df), N counting all documents."""
    n = documents.count()
    distinct = documents.select(F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))
    return distinct.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log10(F.lit(float(n)) / F.col("df")))


def inverted_lists(documents: DataFrame, analyzer: Analyzer = standard) -> DataFrame:
    """``(segment_id, term, doc_ids)`` for segmented documents; lists are sorted local ids, at most a segment long."""
    distinct = documents.select("segment_id", "local_id", F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))
    return distinct.groupBy("segment_id", "term").agg(F.sort_array(F.collect_list("local_id")).alias("doc_ids"))


def segment_df(documents: DataFrame, analyzer: Analyzer = standard) -> DataFrame:
    """``(segment_id, term, df)`` for segmented documents; counted, no list is built."""
    return documents.select("segment_id", F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term")).groupBy("segment_id", "term").agg(F.count("*").alias("df"))


def encoded_lists(lists: DataFrame) -> DataFrame:
    """``(segment_id, term, delta_hex, fixed_hex)`` of inverted lists."""
    return lists.select("segment_id", "term", codec.delta_vbyte_hex(F.col("doc_ids")).alias("delta_hex"), codec.fixed_hex(F.col("doc_ids")).alias("fixed_hex"))


def write_postings(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Segment files: one folder for each segment, terms in order, so a term's filter skips row groups."""
    # Ranges, not hashes: a term that many documents hold is spread over several files.
    rows.repartitionByRange("segment_id", "term", "doc_id").sortWithinPartitions("segment_id", "term", "doc_id").write.mode(mode).partitionBy("segment_id").parquet(path)
