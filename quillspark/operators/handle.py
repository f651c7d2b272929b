"""An index one can open, add to, merge and query: written segments bound to an analyzer.

A segment is two sorted Parquet tables, each in a folder of the segment's own, postings ``(term, local_id, doc_id, tf[, positions])`` and
documents ``(local_id, doc_id, text)``. A manifest, written anew by each change, names the live segments in order, so a
change that fails leaves the index as it was, and readers keep the manifest they opened. Merging reads written
postings: ids of the second segment follow those of the first, and no text is analysed again.

Queries seek terms in the postings: the filter reaches the scan, and files and row groups without the term are skipped.
Defined results: rows without an id are left out; null and empty texts are documents without postings, which
count in N; a repeated id is another document; a search without any term left finds nothing.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import analysis, porter
from quillspark.operators import index, ranking, search
from quillspark.runtime import materialize
from quillspark.sources.docstore import numbered

ANALYZERS = {"naive": analysis.naive, "punctuation": analysis.punctuation, "standard": analysis.standard}
_MANIFEST = "analyzer string, stemmed boolean, positional boolean, flush int, merge int, batch long, place int, folder string, n_docs long"


@dataclass(frozen=True)
class Settings:
    """How texts become terms, whether places are kept, and after how many documents and segments it flushes and merges."""

    analyzer: str = "standard"
    stemmed: bool = False
    positional: bool = True
    flush: int = index.FLUSH
    merge: int = index.MERGE


class Index:
    """The index in a folder; ``segments`` are ``(folder, number of documents)`` in order."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings, version: int, segments: list[tuple[str, int]], batch: int = -1):
        self.spark, self.path, self.settings, self.version, self.segments = spark, path.rstrip("/"), settings, version, segments
        self.batch = batch
        """The last batch of a stream that was added, or -1."""

    # Opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: Settings = Settings()) -> Index:
        if settings.analyzer not in ANALYZERS:
            raise ValueError(f"{settings.analyzer}: no such analyzer")
        if settings.flush < 1 or settings.merge < 2 or settings.merge % 2:
            raise ValueError("an index flushes after one document or more and merges an even number of segments in pairs")
        made = cls(spark, path, settings, -1, [])
        made._commit([])
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        files, folder = _folder(spark, f"{path.rstrip('/')}/manifest")
        versions = [int(f.getPath().getName().removeprefix("v")) for f in files.listStatus(folder) if files.exists(_path(spark, f"{f.getPath()}/_SUCCESS"))]
        version = max(versions)
        rows = sorted(spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest/v{version}").collect(), key=lambda r: r.place)
        r = rows[0]
        return cls(spark, path, Settings(r.analyzer, r.stemmed, r.positional, r.flush, r.merge), version, [(x.folder, x.n_docs) for x in rows if x.folder], r.batch)

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        files, folder = _folder(spark, f"{path.rstrip('/')}/manifest")
        return files.exists(folder)

    def _commit(self, segments: list[tuple[str, int]]) -> None:
        s = self.settings
        rows = [(s.analyzer, s.stemmed, s.positional, s.flush, s.merge, self.batch, k, f, n) for k, (f, n) in enumerate([*segments, (None, 0)])]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/v{self.version + 1}")
        old = {f for f, _ in self.segments} - {f for f, _ in segments}
        self.version, self.segments = self.version + 1, segments
        for f in old:
            for what in ("documents", "postings"):
                files, folder = _folder(self.spark, f"{self.path}/{what}/folder={f}")
                files.delete(folder, True)

    # Reading

    def num_segments(self) -> int:
        return len(self.segments)

    def size(self) -> int:
        return sum(n for _, n in self.segments)

    def _read(self, what: str, schema: str, only: int | None) -> DataFrame:
        if only is not None and not 0 <= only < len(self.segments):
            raise IndexError(f"segment {only} of {len(self.segments)}")
        out = None
        for k, (f, _) in enumerate(self.segments):
            files, folder = _folder(self.spark, f"{self.path}/{what}/folder={f}")
            if only in (None, k) and files.exists(folder):  # documents without any term leave no postings
                one = self.spark.read.schema(schema).parquet(f"{self.path}/{what}/folder={f}").select(F.lit(k).alias("segment_id"), "*")
                out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], f"segment_id int, {schema}")

    def postings(self, segment: int | None = None) -> DataFrame:
        """``(segment_id, term, local_id, doc_id, tf[, positions])`` of all segments or one."""
        return self._read("postings", "term string, local_id long, doc_id long, tf int" + (", positions array<int>" if self.settings.positional else ""), segment)

    def documents(self, segment: int | None = None) -> DataFrame:
        """``(segment_id, local_id, doc_id, text)`` of all segments or one."""
        return self._read("documents", "local_id long, doc_id long, text string", segment)

    # Writing

    def _analysed(self, rows: DataFrame) -> DataFrame:
        """Postings of ``rows(chunk, local_id, doc_id, text)``; words are stemmed once each, not at every place."""
        analyzer = ANALYZERS[self.settings.analyzer]
        if not self.settings.stemmed:
            return (index.postings if self.settings.positional else index.frequencies)(rows, analyzer, ("chunk", "local_id"))
        tokens = porter.stem_tokens(rows.select("chunk", "local_id", "doc_id", F.posexplode(analyzer(F.col("text"))).alias("pos", "term")))
        kept = [F.sort_array(F.collect_list("pos")).alias("positions")] if self.settings.positional else []
        return tokens.groupBy("chunk", "term", "local_id", "doc_id").agg(F.count("*").cast("int").alias("tf"), *kept)

    def add_batch(self, documents: DataFrame, batch: int) -> Index:
        """``add`` of one batch of a stream; a batch that comes again was added already and changes nothing."""
        if batch <= self.batch:
            return self
        before, self.batch = self.batch, batch
        try:
            return self.add(documents)
        except BaseException:
            self.batch = before
            raise

    def add(self, documents: DataFrame) -> Index:
        """Add ``documents(doc_id, text)`` in order of their ids: a segment for each ``flush`` of them, merging in pairs whenever
        there are ``merge`` segments; parts that end up in one segment are written once."""
        s = self.settings
        rows = numbered(documents.select("doc_id", "text").filter("doc_id IS NOT NULL"), "doc_id")
        n = rows.count()
        if not n:
            return self
        # Each segment to be is a list of sources in order: live segments, or chunks of the new documents.
        plan: list[list[tuple[str, int, int]]] = [[("live", k, m)] for k, (_, m) in enumerate(self.segments)]
        for c in range(-(-n // s.flush)):
            plan.append([("new", c, min(s.flush, n - c * s.flush))])
            if len(plan) >= s.merge:
                plan = [[x for p in plan[k : k + 2] for x in p] for k in range(0, len(plan), 2)]
        chunked = rows.select(F.floor(F.col("ordinal") / s.flush).cast("int").alias("chunk"), (F.col("ordinal") % s.flush).alias("local_id"), "doc_id", "text")
        return self._rewrite(plan, chunked, self._analysed(chunked))

    def merge_all(self) -> Index:
        """Merge neighbours 2i and 2i + 1 of all segments; of an odd number the last stays."""
        live = [[("live", k, m)] for k, (_, m) in enumerate(self.segments)]
        return self._rewrite([[x for p in live[k : k + 2] for x in p] for k in range(0, len(live), 2)], None, None)

    def _rewrite(self, plan: list[list[tuple[str, int, int]]], documents: DataFrame | None, postings: DataFrame | None) -> Index:
        segments: list[tuple[str, int]] = []
        moved: dict[str, list[tuple[int, int, int, str]]] = {"live": [], "new": []}
        for sources in plan:
            if len(sources) == 1 and sources[0][0] == "live":
                segments.append(self.segments[sources[0][1]])
                continue
            folder, at = uuid.uuid4().hex, 0
            for kind, k, m in sources:
                moved[kind].append((k, at, len(segments), folder))
                at += m
            segments.append((folder, at))
        parts: dict[str, list[DataFrame]] = {"documents": [], "postings": []}
        for kind, what, rows in (("new", "documents", documents), ("new", "postings", postings), ("live", "documents", None), ("live", "postings", None)):
            if not moved[kind]:
                continue
            if kind == "live":
                rows = (self.documents() if what == "documents" else self.postings()).withColumnRenamed("segment_id", "chunk")
            # One small row for each source: chunks of this call and live segments.
            to = self.spark.createDataFrame([(k, a, f) for k, a, _, f in moved[kind]], "chunk int, _shift long, folder string")
            parts[what].append(rows.join(F.broadcast(to), "chunk").withColumn("local_id", F.col("local_id") + F.col("_shift")).drop("chunk", "_shift"))
        for what, order in (("documents", ["local_id"]), ("postings", ["term", "local_id"])):
            if parts[what]:
                rows = parts[what][0] if len(parts[what]) == 1 else parts[what][0].unionByName(parts[what][1])
                # Ranges spread a term that many documents hold over several files, each with its own bounds.
                rows = rows.repartitionByRange("folder", *order).sortWithinPartitions("folder", *order)
                rows.write.mode("append").partitionBy("folder").parquet(f"{self.path}/{what}")
        self._commit(segments)
        return self

    # Queries

    def terms(self, words: list[str], whole: bool = False) -> list[str]:
        """The words of a query as the index has them."""
        analyzer = ANALYZERS[self.settings.analyzer]
        return porter.Stemming(analyzer).query(self.spark, words, whole) if self.settings.stemmed else search.query_terms(self.spark, words, analyzer, whole)

    def seek(self, terms: list[str], segment: int | None = None) -> DataFrame:
        return self.postings(segment).filter(F.col("term").isin(sorted(set(terms))))

    def keyword(self, word: str) -> DataFrame:
        return self.any_of([word])

    def any_of(self, words: list[str]) -> DataFrame:
        return search.posting_or(self.postings(), self.terms(words))

    def all_of(self, words: list[str]) -> DataFrame:
        return search.posting_and(self.postings(), self.terms(words))

    def phrase(self, words: list[str]) -> DataFrame:
        if not self.settings.positional:
            raise NotImplementedError("a phrase search needs a positional index")
        return search.posting_phrase(self.postings(), self.terms(words, whole=True))

    def tfidf(self, words: list[str], k: int | None = None) -> DataFrame:
        """``(doc_id, score)`` by the postings of the query's terms alone; N is in the manifest."""
        counts = Counter(self.terms(words))
        found = materialize(self.seek(list(counts)).select("term", "doc_id", "tf"))
        weights = ranking.query_weights(found, counts, self.size())
        return ranking.top(ranking.of_postings(found, weights), k)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
