"""How characteristic a term is of its record, by a parsimonious language model (problem 2).

A record's terms are a mixture of its own model and the background, the term distribution of the whole
collection. Expectation-maximisation moves mass to the terms that the background explains badly:

    e = tf * own / (own + (1 / LAMBDA - 1) * background),   own = e / sum(e)

The converged probabilities are the weights; a term the background explains fully ends at 0.

Background counts are exact over all records. They are combined within batches before anything is shuffled, and
broadcast if they are few, which is measured; else only the frequent part, of at most 1 / SHARE terms, is
broadcast, and rare terms join by themselves: no text is shuffled. Both ways give the same numbers.

Defined results: null and empty texts have no terms; equal rows have equal results, each counted in the
background; a row without an id has no result but counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.textform import form
from quillspark.runtime import materialize, small

LETTERS = re.compile(r"[^\W\d_]+")
LAMBDA, ROUNDS, EPSILON = 0.1, 100, 1e-9
VOCABULARY = 1_000_000
"""So many distinct terms are broadcast at most."""
SHARE = 5e-6
"""Beyond, terms with at least this share of all places are broadcast."""


def terms_of(text: str) -> Counter:
    """Terms of a whole text, maximal runs of letters in its form and lower case, with their counts."""
    return Counter(LETTERS.findall(form(text).lower()))


def parsimonious(tf: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Converged probabilities of a record's terms.

    At the optimum the terms kept are those with the largest tf / background, and own = tf / v - ground with one v
    for all of them. The rounds start there, so they converge at once instead of creeping towards zeros.
    """
    ground = (1 / LAMBDA - 1) * background
    order = np.argsort(-tf / ground, kind="stable")
    v = np.cumsum(tf[order]) / (1 + np.cumsum(ground[order]))
    kept = np.flatnonzero(tf[order] > v * ground[order])
    own = np.maximum(tf / v[kept[-1]] - ground, 0)
    own /= own.sum()
    for _ in range(ROUNDS):
        e = tf * own / (own + ground)
        new = e / e.sum()
        if np.abs(new - own).max() < EPSILON:
            return new
        own = new
    return own


def background(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(term, cf, df)``: places and records of every term, over all records."""

    def run(batches):
        for b in batches:
            cf: dict[str, int] = {}
            df: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                for w, n in terms_of(t).items() if t else ():
                    cf[w] = cf.get(w, 0) + n
                    df[w] = df.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(cf), pa.string()), pa.array(list(cf.values()), pa.int64()), pa.array(list(df.values()), pa.int64())], names=["term", "cf", "df"])

    counted = documents.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(run, "term string, cf long, df long")
    return counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


ONCE = (1, 1)


class Wanted:
    """Which of the terms that the model keeps are put out; weights are always those of the whole record."""

    def __init__(self, least_tf: int = 1, least_df: int = 1, most_df: int | None = None, pattern: str | None = None, least_weight: float | None = None):
        self.least_tf, self.least_df, self.most_df = least_tf, least_df, most_df
        self.pattern = pattern
        self.least_weight = least_weight
        """Only terms of a weight above this; None: also those that the background explains fully."""

    def test(self):
        match = re.compile(self.pattern).fullmatch if self.pattern else None
        return lambda w, n, df: n >= self.least_tf and df >= self.least_df and (self.most_df is None or df <= self.most_df) and (match is None or match(w) is not None)


_NAMES = ["doc_id", "term", "tf", "df", "weight"]
_SCHEMA = "doc_id long, term string, tf int, df long, weight double"


def _scored(rows, stats, total: int, wanted: Wanted) -> pa.RecordBatch:
    """``rows`` of (id, terms with counts, lookup beside ``stats``): each record is modelled and its terms with enough
    weight are tested; a record that has no term to put out whatever its weight is left out before."""
    out: list[tuple] = []
    test = wanted.test()
    for i, counts, more in rows:
        known = [(w, n, stats.get(w) or (ONCE if more is None else more[w])) for w, n in counts.items()]
        chosen = [k for k, (w, n, s) in enumerate(known) if test(w, n, s[1])]
        if not chosen:
            continue
        p = parsimonious(np.fromiter((n for _, n, _ in known), np.float64, len(known)), np.fromiter((s[0] for *_, s in known), np.float64, len(known)) / total)
        out += [(i, known[k][0], known[k][1], known[k][2][1], float(p[k])) for k in chosen if wanted.least_weight is None or p[k] > wanted.least_weight]
    cols = list(zip(*out)) if out else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64()))], names=_NAMES)


_BAG = "doc_id long, common array<struct<term: string, tf: int>>, rare array<struct<term: string, tf: int>>"


def term_weights(documents: DataFrame, wanted: Wanted | None = None, id_column: str = "doc_id", text: str = "text", broadcast_terms: int = VOCABULARY) -> DataFrame:
    """``(doc_id, term, tf, df, weight)`` of the wanted terms of every record; ``df`` counts records."""
    spark = documents.sparkSession
    wanted = wanted or Wanted()
    stats = materialize(background(documents, text))
    total = stats.agg(F.sum("cf")).first()[0] or 1
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # A term that is not looked up stands in one place of all: only the others have to be sent.
    several = stats.filter("cf > 1")
    whole = small(several, broadcast_terms)
    known = several if whole else stats.filter(F.col("cf") >= max(SHARE * total, total / broadcast_terms))
    shared = spark.sparkContext.broadcast(pa_bytes(known.toArrow()))
    if whole:

        def run(batches):
            have = _lookup(shared.value)
            for b in batches:
                yield _scored(((i, terms_of(t), None) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t), have, total, wanted)

        return rows.mapInArrow(run, _SCHEMA)

    def bags(batches):
        have = _lookup(shared.value)
        for b in batches:
            made = [(i, terms_of(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t]
            parts = [[[{"term": w, "tf": n} for w, n in c.items() if (w in have) is common] for _, c in made] for common in (True, False)]
            kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int64()), *(pa.array(p, kind) for p in parts)], names=["doc_id", "common", "rare"])

    # Texts stay where they are; each record's terms are written once, and only its rare ones join. Equal ids are told apart
    # by the record's place, and a record has as many rare terms as it has, so their list is bounded by its text.
    bag = materialize(rows.mapInArrow(bags, _BAG).withColumn("row", F.monotonically_increasing_id()))
    rare = bag.select("row", F.explode("rare").alias("r")).select("row", F.col("r.term").alias("term"), F.col("r.tf").alias("tf")).join(stats, "term")
    listed = rare.groupBy("row").agg(F.collect_list(F.struct("term", "tf", "cf", "df")).alias("rare"))
    both = bag.select("row", "doc_id", "common").join(listed, "row", "left").select("doc_id", "common", "rare")

    def run_both(batches):
        have = _lookup(shared.value)
        for b in batches:
            ids, common, rare_ = (b.column(k).to_pylist() for k in range(3))
            bags_ = ((i, {x["term"]: x["tf"] for x in (*c, *(r or ()))}, {x["term"]: (x["cf"], x["df"]) for x in r or ()}) for i, c, r in zip(ids, common, rare_))
            yield _scored(bags_, have, total, wanted)

    return both.mapInArrow(run_both, _SCHEMA)


def pa_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


_KEPT: list = [None, None]


def _lookup(data: bytes) -> dict[str, tuple[int, int]]:
    """term -> (cf, df); built once for each broadcast in a worker."""
    if _KEPT[0] is not data:
        t = pa.ipc.open_stream(data).read_all()
        _KEPT[:] = [data, dict(zip(t.column("term").to_pylist(), zip(t.column("cf").to_pylist(), t.column("df").to_pylist())))]
    return _KEPT[1]
