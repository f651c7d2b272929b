"""Retrieval: full scan, keyword, AND, OR, phrase, and deletion by query.

Query words are analysed like texts; a word that analyses to nothing is skipped, and a query without any word
left, an empty one included, finds nothing. Results are ids; documents join last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import Analyzer, standard


def query_terms(spark: SparkSession, keywords: list[str], analyzer: Analyzer = standard, whole: bool = False) -> list[str]:
    """The first token of each keyword, or with ``whole`` all its tokens, in order and with repetitions."""
    if not keywords:
        return []
    rows = spark.createDataFrame(list(enumerate(keywords)), "k int, text string").select("k", analyzer(F.col("text")).alias("tokens")).collect()
    out: list[str] = []
    for r in sorted(rows, key=lambda r: r.k):
        out += r.tokens if whole else r.tokens[:1]
    return out


def _none(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id").filter(F.lit(False))


def full_scan(documents: DataFrame, query: str, analyzer: Analyzer = standard) -> DataFrame:
    """Ids of documents whose tokens hold all tokens of the query; each document is read once, nothing is shuffled."""
    terms = sorted(set(query_terms(documents.sparkSession, [query], analyzer, whole=True)))
    if not terms:
        return _none(documents)
    tokens = analyzer(F.col("text"))
    return documents.filter(F.size(F.array_intersect(tokens, F.array(*map(F.lit, terms)))) == len(terms)).select("doc_id")


def _holding(documents: DataFrame, terms: list[str], analyzer: Analyzer) -> Column:
    return F.size(F.array_intersect(analyzer(F.col("text")), F.array(*map(F.lit, terms))))


def keyword(documents: DataFrame, word: str, analyzer: Analyzer = standard) -> DataFrame:
    return search_or(documents, [word], analyzer)


def search_and(documents: DataFrame, keywords: list[str], analyzer: Analyzer = standard) -> DataFrame:
    terms = sorted(set(query_terms(documents.sparkSession, keywords, analyzer)))
    return documents.filter(_holding(documents, terms, analyzer) == len(terms)).select("doc_id") if terms else _none(documents)


def search_or(documents: DataFrame, keywords: list[str], analyzer: Analyzer = standard) -> DataFrame:
    terms = sorted(set(query_terms(documents.sparkSession, keywords, analyzer)))
    return documents.filter(_holding(documents, terms, analyzer) > 0).select("doc_id") if terms else _none(documents)


def posting_and(postings: DataFrame, terms: list[str]) -> DataFrame:
    """AND over an index: the filter on terms reaches the scan, and one count for each document is shuffled."""
    if not terms:
        return postings.select("doc_id").filter(F.lit(False))
    once = sorted(set(terms))
    hits = postings.filter(F.col("term").isin(once)).groupBy("doc_id").agg(F.collect_set("term").alias("seen"))  # at most the terms of the query
    return hits.filter(F.size("seen") == len(once)).select("doc_id")


def posting_or(postings: DataFrame, terms: list[str]) -> DataFrame:
    if not terms:
        return postings.select("doc_id").filter(F.lit(False))
    return postings.filter(F.col("term").isin(terms)).select("doc_id").distinct()


def phrase(documents: DataFrame, words: list[str], analyzer: Analyzer = standard, positional: bool = True) -> DataFrame:
    """Ids of documents that hold the words at consecutive positions, after stop words are gone; repeated words
    take a place each. Without positions in the index the search is not supported."""
    if not positional:
        raise NotImplementedError("a phrase search needs a positional index")
    terms = query_terms(documents.sparkSession, words, analyzer, whole=True)
    if not terms:
        return _none(documents)
    once = sorted(set(terms))

    # The tokens are bound to a variable, so a text is split once however many starts are tried; rows without all
    # the words are told by one intersection.
    def found(ts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ts) - len(terms))
        there = (F.size(ts) >= len(terms)) & (F.size(F.array_intersect(ts, F.array(*map(F.lit, once)))) == len(once))
        return F.when(there, F.exists(starts, lambda i: _all(F.get(ts, i + k) == t for k, t in enumerate(terms)))).otherwise(False)

    return documents.filter(F.exists(F.array(analyzer(F.col("text"))), found)).select("doc_id")


def posting_phrase(postings: DataFrame, terms: list[str]) -> DataFrame:
    """A phrase over positional postings, ``(term, doc_id, positions)`` or ``(term, doc_id, pos)``: starts implied by each
    word's places meet by document and start."""
    if not terms:
        return postings.select("doc_id").filter(F.lit(False))
    slots = F.lit(None).cast("array<int>")
    for t in set(terms):
        slots = F.when(F.col("term") == t, F.array(*(F.lit(k) for k, x in enumerate(terms) if x == t))).otherwise(slots)
    hits = postings.filter(F.col("term").isin(terms))
    if "positions" in postings.columns:
        hits = hits.select("doc_id", "term", F.explode("positions").alias("pos"))
    hits = hits.select("doc_id", "pos", F.explode(slots).alias("k")).distinct()
    starts = hits.groupBy("doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
    return starts.filter(F.col("n") == len(terms)).select("doc_id").distinct()


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_documents(ids: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.join(ids, "doc_id", "left_semi")


def deleted(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents but for those found (beyond the search engine's own operations)."""
    return documents.join(ids, "doc_id", "left_anti")
