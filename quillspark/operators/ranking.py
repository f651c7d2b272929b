"""TF-IDF cosine ranking, PageRank and their blend.

With raw term counts, idf = log10(N / df) and query weights count * idf, a document's score is the dot product
over the length of its vector, both over the query's terms it holds; the query's own length is not divided out.
A document that holds only terms of every document scores 0 and is still found. Ties go by id.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.analysis import Analyzer, standard
from quillspark.functions.porter import Stemming
from quillspark.operators.search import query_terms
from quillspark.runtime import broadcast_if_small, materialize, small

DAMPING = 0.85


def tfidf(documents: DataFrame, keywords: list[str], analyzer: Analyzer = standard, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, doc_id, score)`` of all documents that hold a term of the query. A document is one row."""
    counts = Counter(query_terms(documents.sparkSession, keywords, analyzer))
    terms = sorted(counts)
    if not terms:
        return documents.select(*keep, "doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    tokens = F.filter(analyzer(F.col("text")), lambda t: t.isin(terms))

    def tf_of(t: str) -> Column:
        return F.size(F.filter(F.col("_t"), lambda x: x == t))

    tf = [tf_of(t) for t in terms]
    n = documents.count()  # from the files' own counts; only hits are kept
    hits = documents.select(*keep, "doc_id", tokens.alias("_t")).filter(F.size("_t") > 0)
    rows = materialize(hits.select(*keep, "doc_id", *(c.alias(f"_tf{k}") for k, c in enumerate(tf))))
    stats = rows.agg(*(F.count_if(F.col(f"_tf{k}") > 0).alias(f"df{k}") for k in range(len(terms)))).first()
    idf = [log10(n / stats[f"df{k}"]) if stats[f"df{k}"] else 0.0 for k in range(len(terms))]
    dot, square = F.lit(0.0), F.lit(0.0)
    for k, t in enumerate(terms):
        w = F.col(f"_tf{k}") * F.lit(idf[k])
        dot, square = dot + w * F.lit(counts[t] * idf[k]), square + w * w
    return rows.select(*keep, "doc_id", F.when(square > 0, dot / F.sqrt(square)).otherwise(0.0).alias("score"))


def query_weights(found: DataFrame, counts: Counter, n_docs: int) -> dict[str, tuple[int, float]]:
    """term -> (its count in the query, idf) of the query's terms that ``found(term, doc_id, tf)`` holds."""
    return {r.term: (counts[r.term], log10(n_docs / r.n)) for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}


def of_postings(found: DataFrame, weights: dict[str, tuple[int, float]]) -> DataFrame:
    """``(doc_id, score)`` from the postings of a query's terms alone, one row for each term and document."""
    n, idf = F.lit(0), F.lit(0.0)
    for t, (count, value) in weights.items():
        n, idf = F.when(F.col("term") == t, count).otherwise(n), F.when(F.col("term") == t, value).otherwise(idf)
    parts = found.select("doc_id", (F.col("tf") * idf).alias("_v"), (n * idf).alias("_q"))
    sums = parts.groupBy("doc_id").agg(F.sum(F.col("_v") * F.col("_q")).alias("_dot"), F.sum(F.col("_v") * F.col("_v")).alias("_square"))
    return sums.select("doc_id", F.when(F.col("_square") > 0, F.col("_dot") / F.sqrt("_square")).otherwise(0.0).alias("score"))


def tfidf_stemmed(documents: DataFrame, keywords: list[str], analyzer: Analyzer = standard) -> DataFrame:
    """``tfidf`` with tokens and query words stemmed."""
    stemming = Stemming(analyzer)
    counts = Counter(stemming.query(documents.sparkSession, keywords))
    found = materialize(stemming.places(documents, list(counts)).groupBy("term", "doc_id").agg(F.count("*").alias("tf")))
    return of_postings(found, query_weights(found, counts, documents.count()))


BEST_FIRST = (("score", False), ("doc_id", True))
"""How results compare: columns, and whether they rise."""


def top(scored: DataFrame, k: int | None, order: tuple[tuple[str, bool], ...] = BEST_FIRST) -> DataFrame:
    """The first ``k`` rows in ``order``; all for None, none for 0."""
    return scored if k is None else scored.orderBy(*(F.asc(c) if rises else F.desc(c) for c, rises in order)).limit(k)


def top_per_segment(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each segment; of tied rows the larger id. Limits apply before rows of a segment meet."""
    w = Window.partitionBy("segment_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def out_degree(edges: DataFrame) -> DataFrame:
    """``(src, out_degree)``, parallel edges counted."""
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int, cut_every: int = 5, hub_edges: int = 1_000_000) -> DataFrame:
    """``(id, rank)`` after synchronous rounds of 0.15 + 0.85 * sum(rank(src) / out_degree(src)) from 1.0.

    Parallel edges and self-links count, dangling mass is not shared out. Edges whose ends are no nodes, or
    null, are left out. Parallel edges fold into one weighted edge first; the weighted edges are partitioned by
    source once for all rounds, but for those of hubs, sources of more than ``hub_edges`` targets, and a hot
    target's contributions are summed before they are shuffled. The ranks are written to the shared folder every
    few rounds.
    """
    ids = materialize(nodes.select("id").filter("id IS NOT NULL").distinct())
    good = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    folded = good.groupBy("src", "dst").agg(F.count("*").alias("n"))
    weighted = materialize(folded.join(folded.groupBy("src").agg(F.sum("n").alias("d")), "src").select("src", "dst", (F.col("n") / F.col("d")).alias("w")))
    hubs = materialize(weighted.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > hub_edges).select("src"))
    parts = [weighted.repartition("src").persist()]
    if not small(hubs, 0):
        # Their number is bounded by edges / hub_edges; their edges stay where they are and their ranks are broadcast.
        few = small(hubs, 1_000_000)
        known = F.broadcast(hubs) if few else hubs
        parts = [weighted.join(known, "src", "left_anti").repartition("src").persist(), weighted.join(known, "src", "left_semi").persist()]
    ranks = ids.withColumn("rank", F.lit(1.0))
    for k in range(1, iterations + 1):
        of = ranks.select(F.col("id").alias("src"), "rank")
        sent = parts[0].join(of, "src").select(F.col("dst").alias("id"), (F.col("rank") * F.col("w")).alias("v"))
        if len(parts) > 1:
            hub_ranks = of.join(known, "src", "left_semi")
            hub_ranks = F.broadcast(hub_ranks) if few else hub_ranks
            sent = sent.unionByName(parts[1].join(hub_ranks, "src").select(F.col("dst").alias("id"), (F.col("rank") * F.col("w")).alias("v")))
        # Every node sends itself 0, so nodes without incoming edges stay, without a join.
        sent = sent.unionByName(ids.withColumn("v", F.lit(0.0)))
        ranks = sent.groupBy("id").agg((F.lit(1 - DAMPING) + F.lit(DAMPING) * F.sum("v")).alias("rank"))
        if k % cut_every == 0 or k == iterations:
            ranks = materialize(ranks)
    for p in parts:
        p.unpersist()
    return ranks


def page_rank_scores(ranks: DataFrame) -> DataFrame:
    """``(id, score)`` with score = (rank - least) / largest."""
    m = ranks.agg(F.min("rank").alias("low"), F.max("rank").alias("high")).first()
    return ranks.select("id", ((F.col("rank") - F.lit(m.low)) / F.lit(m.high)).alias("score"))


def blended(scored: DataFrame, ranks: DataFrame, weight: float, k: int | None) -> DataFrame:
    """TF-IDF plus ``weight`` times the page's rank score; a document without a rank has 0 for it."""
    both = scored.join(ranks.select(F.col("id").alias("doc_id"), F.col("score").alias("_pr")), "doc_id", "left")
    return top(both.select("doc_id", (F.col("score") + F.lit(float(weight)) * F.coalesce("_pr", F.lit(0.0))).alias("score")), k)


ASKED = 100_000
"""So many terms of queries are compared with every document at most by one broadcast table."""


SCORED = 500
"""Documents are scored so many at a time."""


class _Asked:
    """The queries as arrays: for each term, which queries have it and with what weight."""

    def __init__(self, weights: pa.Table, asked: pa.Table):
        ids = asked.column("query_id").to_pylist()
        self.ids, self.most = np.array(ids, np.int64), np.array(asked.column("_k").to_pylist(), np.int64)
        self.share = np.array(asked.column("_weight").to_pylist(), np.float64)
        number = {q: k for k, q in enumerate(ids)}
        rows = sorted((t, number[q], n, x) for q, t, n, x in zip(*(weights.column(c).to_pylist() for c in ("query_id", "term", "_n", "_idf"))) if q in number)
        self.terms = pa.array(sorted({r[0] for r in rows}), pa.string())
        names = self.terms.to_pylist()
        self.start = np.searchsorted([r[0] for r in rows], names) if rows else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(rows)))
        self.query, self.count = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)
        self.idf = np.array([rows[k][3] for k in self.start], np.float64)

    def scored(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of all hits of a batch ``(doc_id, words, rank)``."""
        words = b.column(1)
        term = np.asarray(pc.fill_null(pc.index_in(words.flatten(), self.terms), -1)).astype(np.int64)
        row = np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(words)))
        row, term = row[term >= 0], term[term >= 0]
        places, tf = np.unique(row * max(len(self.terms), 1) + term, return_counts=True)
        row, term = places // max(len(self.terms), 1), places % max(len(self.terms), 1)
        v = tf * self.idf[term]
        many = self.size[term]
        at = np.repeat(self.start[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row, v, idf = np.repeat(row, many), np.repeat(v, many), np.repeat(self.idf[term], many)
        pairs, where = np.unique(row * len(self.ids) + self.query[at], return_inverse=True)
        dot, square = np.bincount(where, v * self.count[at] * idf, len(pairs)), np.bincount(where, v * v, len(pairs))
        query, row = pairs % max(len(self.ids), 1), pairs // max(len(self.ids), 1)
        rank = np.asarray(b.column(2).fill_null(0.0))[row]
        score = np.divide(dot, np.sqrt(square), out=np.zeros(len(pairs)), where=square > 0) + self.share[query] * rank
        return query, np.asarray(b.column(0))[row], np.round(score, 12)

    def first(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first hits of each query by score, then by document."""
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.most[query]
        return query[keep], doc[keep], score[keep]


def ranked_queries(documents: DataFrame, queries: DataFrame, ranks: DataFrame, analyzer: Analyzer = standard, default_k: int = 5) -> DataFrame:
    """``(query_id, doc_id, score)``: the first ``top_k`` documents of every row of ``queries(query_id, terms, top_k,
    page_rank_weight)`` by the blended score, then id; null: ``default_k`` and 1.

    Each document is scored for all queries where its row is, and a task puts out no more than the first documents of each
    query, so what is shuffled grows with tasks and queries, not with hits. Queries of more than ``ASKED`` terms in all are
    an error.
    """
    spark = documents.sparkSession
    words = queries.select("query_id", F.explode("terms").alias("_w")).select("query_id", F.get(analyzer(F.col("_w")), F.lit(0)).alias("term"))
    wanted = materialize(words.filter("term IS NOT NULL").groupBy("query_id", "term").agg(F.count("*").alias("_n")))
    if not small(wanted, ASKED):
        raise ValueError(f"the queries have more than {ASKED} terms")
    terms = sorted(r.term for r in wanted.select("term").distinct().collect())
    hits = documents.select("doc_id", F.filter(analyzer(F.col("text")), lambda t: t.isin(terms)).alias("words")).filter(F.size("words") > 0)
    hits = materialize(hits.join(ranks.select(F.col("id").alias("doc_id"), F.col("score").alias("rank")), "doc_id", "left").select("doc_id", "words", "rank"))
    df = hits.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    weights = wanted.join(F.broadcast(df), "term").withColumn("_idf", F.log10(F.lit(documents.count()) / F.col("_df")))
    asked = queries.select("query_id", F.coalesce("top_k", F.lit(default_k)).alias("_k"), F.coalesce("page_rank_weight", F.lit(1.0)).alias("_weight"))
    shared = spark.sparkContext.broadcast(_Asked(weights.toArrow(), asked.toArrow()))

    def run(batches):
        asked, best = shared.value, None
        for b in (b.slice(k, SCORED) for b in batches for k in range(0, len(b), SCORED)):
            found = asked.scored(b)
            best = asked.first(*(found if best is None else (np.concatenate(x) for x in zip(best, found))))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "doc_id", "score"])

    first = hits.mapInArrow(run, "query_id long, doc_id long, score double").withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return first.join(F.broadcast(asked), "query_id").filter(F.col("_rn") <= F.col("_k")).select("query_id", "doc_id", F.round("score", 6).alias("score"))
