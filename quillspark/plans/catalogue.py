"""The query catalogue of the core and equivalent SQL for each query that SQL can express.

Every query runs over whole tables. Doubles are rounded on both sides, as sums may add up in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import analysis, codec, porter, wordbreak
from quillspark.operators import handle, hotkeys, index, orphans, ranking, search
from quillspark.runtime import materialize, own_folder, table
from quillspark.sources import docstore

FLUSH, MERGE = 100, 8
QUERY = ["results", "room", "results", "survey"]
ROUNDS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(analysis.STOP_WORDS)
PUNCT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B,.;?!]+'), lambda t: t <> '')"
KEPT = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B,.;?!]+'), lambda t: t <> '' AND t NOT IN ({STOP}))"
TOK = f"tok AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, {KEPT} AS ts FROM documents) WHERE len(ts) > 0)"
SEG = f"seg AS (SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {FLUSH} AS INTEGER) AS segment_id, (row_number() OVER (ORDER BY doc_id) - 1) % {FLUSH} AS local_id FROM documents)"
SEGTOK = f"segtok AS (SELECT DISTINCT segment_id, local_id, doc_id, unnest({KEPT}) AS term FROM seg)"


# Analysis


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B]+'), lambda t: t <> ''), ' ') AS tokens FROM documents")
def tokens_naive(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(analysis.naive(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({PUNCT}, ' ') AS tokens FROM documents")
def tokens_punct(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(analysis.punctuation(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({KEPT}, ' ') AS tokens FROM documents")
def tokens_stopped(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(analysis.standard(F.col("text")), " ").alias("tokens"))


@query(f"WITH {TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tok")
def token_positions(spark, d):
    return analysis.positions(docs(spark, d))


@query(f"WITH {TOK} {porter.duckdb_sql('SELECT DISTINCT term FROM tok')}")
def porter_vocab(spark, d):
    return porter.stemmed(analysis.positions(docs(spark, d)).select("term").distinct())


@query(f"WITH {TOK}, st AS ({porter.duckdb_sql('SELECT DISTINCT term FROM tok')}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, stem AS term FROM tok JOIN st USING (term)")
def tokens_stemmed(spark, d):
    return porter.stem_tokens(analysis.positions(docs(spark, d))).select("doc_id", "pos", "term")


@query(r"SELECT doc_id, CAST(try_cast(trim(split_part(text, chr(10), 1)) AS BIGINT) AS VARCHAR) AS first_id, trim(string_split(text, chr(10))[2]) AS second_line FROM documents")
def doc_first_line_id(spark, d):
    return docs(spark, d).select("doc_id", analysis.first_line_id(F.col("text")).cast("string").alias("first_id"), analysis.second_line(F.col("text")).alias("second_line"))


@query()
def wordbreak_tokens(spark, d):
    """Every word of every document: its stretches between line ends and punctuation without blanks, cut by the corpus's
    own counts of all words (tests compare with brute force). One row for each stretch; a document without words has one, empty."""
    counts = docs(spark, d).select(F.explode(analysis.punctuation(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    breaker = wordbreak.word_break(spark, materialize(counts), fold_case=False)  # runs and dictionary are in lower case
    rows = docs(spark, d).select("doc_id", F.posexplode_outer(wordbreak.runs(F.col("text"))).alias("run", "input")).fillna({"run": 0, "input": ""})
    return rows.withColumn("words", F.array_join(breaker("input"), " "))


# Document store


@query("SELECT doc_id, text FROM documents")
def docstore_scan(spark, d):
    return docstore.scan(docs(spark, d))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 104")
def docstore_get(spark, d):
    return docstore.get(docs(spark, d), 104)


@query("SELECT doc_id FROM documents")
def docstore_keys(spark, d):
    return docstore.keys(docs(spark, d))


@query("SELECT count(*) AS n FROM documents")
def docstore_size(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND text IS NOT NULL THEN concat(text, ' (revised)') ELSE text END AS text FROM documents")
def docstore_upsert(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text", "lang")
    return docstore.upsert(rows.select("doc_id", "text"), rows.filter("lang = 'en'").select("doc_id", F.concat("text", F.lit(" (revised)")).alias("text")))


# Index


@query(f"WITH {TOK} SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY ALL")
def postings(spark, d):
    return index.frequencies(docs(spark, d)).select("term", "doc_id", F.col("tf").cast("int").alias("tf"))


@query(f"WITH {TOK} SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(pos, ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def positional_postings(spark, d):
    return index.postings(docs(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(f"WITH {SEG}, {SEGTOK} SELECT segment_id, term, string_agg(local_id, ' ' ORDER BY local_id) AS doc_ids FROM segtok GROUP BY ALL")
def inverted_lists_segment(spark, d):
    lists = index.inverted_lists(index.flushed(docs(spark, d), FLUSH))
    return lists.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), " "))


@query(f"WITH {SEG} SELECT segment_id, count(*) AS n_docs FROM seg GROUP BY ALL")
def num_docs_per_segment(spark, d):
    return index.flushed(docs(spark, d), FLUSH).groupBy("segment_id").agg(F.count("*").alias("n_docs"))


@query(f"WITH {SEG}, {SEGTOK} SELECT segment_id, term, count(*) AS df FROM segtok GROUP BY ALL")
def df_per_segment(spark, d):
    return index.segment_df(index.flushed(docs(spark, d), FLUSH))


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY ALL")
def df_global(spark, d):
    return index.term_stats(docs(spark, d)).select("term", "df")


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, round(log10((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 6) AS idf FROM tok GROUP BY ALL")
def term_stats_idf(spark, d):
    return index.term_stats(docs(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {SEG} SELECT doc_id, segment_id, local_id FROM seg")
def segments_flushed(spark, d):
    return index.flushed(docs(spark, d).select("doc_id"), FLUSH)


MERGED = f"""
WITH RECURSIVE sim AS (
  SELECT 0 AS done, CAST([] AS BIGINT[]) AS sizes
  UNION ALL
  SELECT done + {FLUSH}, CASE WHEN len(sizes) + 1 = {MERGE} THEN list_transform(range(0, {MERGE // 2}), lambda i: list_append(sizes, least({FLUSH}, n - done))[2 * i + 1] + list_append(sizes, least({FLUSH}, n - done))[2 * i + 2])
    ELSE list_append(sizes, least({FLUSH}, n - done)) END
  FROM sim, (SELECT count(*) AS n FROM documents) WHERE done < n
), final AS (SELECT sizes FROM sim ORDER BY done DESC LIMIT 1),
parts AS (SELECT CAST(k - 1 AS INTEGER) AS segment_id, coalesce(list_sum(sizes[1:k - 1]), 0) AS a, list_sum(sizes[1:k]) AS b FROM (SELECT sizes, unnest(range(1, len(sizes) + 1)) AS k FROM final)),
num AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)
SELECT doc_id, segment_id, CAST(o - a AS BIGINT) AS local_id FROM num JOIN parts ON o >= a AND o < b
"""


@query(MERGED)
def segments_merged(spark, d):
    return index.segmented(docs(spark, d).select("doc_id"), FLUSH, MERGE)


@query(f"WITH {SEG}, sizes AS (SELECT segment_id, count(*) AS n FROM seg GROUP BY ALL) SELECT doc_id, CAST(seg.segment_id // 2 AS INTEGER) AS segment_id, CASE WHEN seg.segment_id % 2 = 1 THEN local_id + (SELECT n FROM sizes s WHERE s.segment_id = seg.segment_id - 1) ELSE local_id END AS local_id FROM seg")
def segments_merged_once(spark, d):
    return index.merged_once(index.flushed(docs(spark, d).select("doc_id"), FLUSH)).select("doc_id", "segment_id", "local_id")


@query(f"WITH {SEG} SELECT segment_id, local_id, doc_id, text FROM seg")
def document_iterator(spark, d):
    return index.flushed(docs(spark, d), FLUSH).select("segment_id", "local_id", "doc_id", "text").orderBy("segment_id", "local_id")


# Retrieval


def _holding(*terms: str) -> str:
    return " AND ".join(f"list_contains({KEPT}, '{t}')" for t in terms)


@query(f"SELECT doc_id FROM documents WHERE {_holding('results', 'survey')}")
def full_scan_search(spark, d):
    return search.full_scan(docs(spark, d), "the results of a survey")


@query(f"WITH {TOK} SELECT DISTINCT t.doc_id, d.text FROM tok t JOIN documents d USING (doc_id) WHERE term = 'survey'")
def search_keyword(spark, d):
    rows = docs(spark, d)
    return search.with_documents(search.keyword(rows, "Survey"), rows)


@query("SELECT doc_id FROM documents WHERE false")
def search_keyword_stopword_empty(spark, d):
    return search.keyword(docs(spark, d), "the")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE term IN ('results', 'room', 'survey') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def search_and(spark, d):
    return search.search_and(docs(spark, d), ["results", "room", "of", "survey", "room"])


@query(f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term IN ('results', 'survey')")
def search_or(spark, d):
    return search.search_or(docs(spark, d), ["results", "results", "survey", "the"])


@query("SELECT doc_id FROM inverted_index WHERE term IN ('results', 'survey') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def index_search_and(spark, d):
    return search.posting_and(table(spark, d, "inverted_index", "term", "doc_id"), ["results", "survey"])


@query("SELECT DISTINCT doc_id FROM inverted_index WHERE term IN ('results', 'survey')")
def index_search_or(spark, d):
    return search.posting_or(table(spark, d, "inverted_index", "term", "doc_id"), ["results", "survey"])


def _phrase(terms: list[str], tok: str = TOK) -> str:
    joins = " ".join(f"JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    return f"WITH {tok} SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE t0.term = '{terms[0]}'"


@query(_phrase(["staff", "login"]))
def search_phrase2(spark, d):
    return search.phrase(docs(spark, d), ["staff", "login"])


@query(_phrase(["webmaster", "site", "map"]))
def search_phrase3(spark, d):
    return search.phrase(docs(spark, d), ["webmaster", "site", "map"])


@query(_phrase(["print", "page"]))
def search_phrase_stopgap(spark, d):
    return search.phrase(docs(spark, d), ["print", "this", "page"])


@query(_phrase(["share", "|", "mail", "|"]))
def search_phrase_repeat(spark, d):
    return search.phrase(docs(spark, d), ["share", "|", "mail", "|"])


@query(_phrase(["is", "in", "the"], "tok AS (SELECT DISTINCT doc_id, term, pos FROM inverted_index)"))
def index_search_phrase(spark, d):
    places = table(spark, d, "inverted_index", "term", "doc_id", "pos").filter(F.col("term").isin("is", "in", "the"))
    return search.posting_phrase(places, ["is", "in", "the"])


STOK = f"{TOK}, st AS ({porter.duckdb_sql('SELECT DISTINCT term FROM tok')}), stok AS (SELECT doc_id, pos, stem AS term FROM tok JOIN st USING (term))"


def _stems(*words: str) -> str:
    """The stems of words, told by the other dialect's own cascade."""
    return "(SELECT stem FROM (" + porter.duckdb_sql("SELECT unnest([" + quoted(words) + "]) AS term") + "))"


def _places(spark, d, words: list[str]):
    stemming = porter.Stemming()
    terms = stemming.query(spark, words)
    return stemming.places(docs(spark, d), terms), terms


@query(f"WITH {STOK} SELECT DISTINCT doc_id FROM stok WHERE term IN {_stems('surveys')}")
def search_keyword_stemmed(spark, d):
    return search.posting_or(*_places(spark, d, ["Surveys"]))


@query(f"WITH {STOK} SELECT doc_id FROM stok WHERE term IN {_stems('result', 'rooms', 'survey')} GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def search_and_stemmed(spark, d):
    return search.posting_and(*_places(spark, d, ["result", "rooms", "survey", "of", "results"]))


@query(f"WITH {STOK} SELECT DISTINCT doc_id FROM stok WHERE term IN {_stems('visiting', 'tested')}")
def search_or_stemmed(spark, d):
    return search.posting_or(*_places(spark, d, ["visiting", "tested", "the"]))


@query(f"WITH {STOK} SELECT DISTINCT a.doc_id FROM stok a JOIN stok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term IN {_stems('terms')} AND b.term IN {_stems('use')}")
def search_phrase_stemmed(spark, d):
    return search.posting_phrase(*_places(spark, d, ["term", "of", "using"]))


@query(f"SELECT doc_id FROM documents WHERE NOT ({_holding('survey')})")
def documents_deleted(spark, d):
    rows = docs(spark, d)
    return search.deleted(rows, search.keyword(rows, "survey")).select("doc_id")


# An index that is written, opened and queried

MERGED_SEG = "seg AS (" + MERGED.strip() + "), segpos AS (SELECT segment_id, local_id, doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT segment_id, local_id, doc_id, " + KEPT + " AS ts FROM seg JOIN documents USING (doc_id)) WHERE len(ts) > 0)"


def _opened(spark, d, **settings) -> handle.Index:
    """An index over all documents, added in two parts, and opened anew."""
    path, rows = own_folder(spark), docs(spark, d)
    half = rows.count() // (2 * FLUSH) * FLUSH  # a whole number of segments, so that the layout is that of one part
    parts = docstore.numbered(rows, "doc_id")
    made = handle.Index.create(spark, path, handle.Settings(flush=FLUSH, merge=MERGE, **settings))
    made.add(parts.filter(F.col("ordinal") < half)).add(parts.filter(F.col("ordinal") >= half))
    return handle.Index.open(spark, path)


@query(f"WITH {MERGED_SEG} SELECT CAST(max(segment_id) + 1 AS BIGINT) AS n_segments, count(*) AS n_docs FROM seg")
def num_segments(spark, d):
    opened = _opened(spark, d, positional=False)
    return spark.createDataFrame([(opened.num_segments(), opened.size())], "n_segments long, n_docs long")


@query(f"WITH {MERGED_SEG} SELECT segment_id, local_id, term, CAST(count(*) AS INTEGER) AS tf FROM segpos GROUP BY ALL")
def segments_merged_postings(spark, d):
    """Postings as they stand in the segments after all merges."""
    return _opened(spark, d, positional=False).postings().select("segment_id", "local_id", "term", "tf")


@query(f"WITH {MERGED_SEG} SELECT term, doc_id, string_agg(pos, ' ' ORDER BY pos) AS positions FROM segpos WHERE segment_id = 1 GROUP BY ALL")
def segment_positional(spark, d):
    """One segment's lists with places, read sequentially."""
    opened = _opened(spark, d)
    if opened.num_segments() < 2:
        return spark.createDataFrame([], "term string, doc_id long, positions string")
    return opened.postings(1).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {MERGED_SEG}, m AS (SELECT CAST(segment_id // 2 AS INTEGER) AS segment_id, segment_id AS old, local_id, doc_id FROM seg) SELECT m.segment_id, m.local_id + CASE WHEN old % 2 = 1 THEN (SELECT count(*) FROM seg s WHERE s.segment_id = old - 1) ELSE 0 END AS local_id, m.doc_id, text FROM m JOIN documents USING (doc_id)")
def segments_merged_documents(spark, d):
    """Documents of the segments after one more merge of all of them."""
    return _opened(spark, d, positional=False).merge_all().documents()


@query(f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term = 'survey'")
def opened_keyword(spark, d):
    return _opened(spark, d, positional=False).keyword("Survey")


@query(f"WITH {TOK} SELECT doc_id FROM tok WHERE term IN ('results', 'room', 'survey') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def opened_and(spark, d):
    return _opened(spark, d, positional=False).all_of(["results", "room", "of", "survey", "room"])


@query(f"WITH {STOK} SELECT DISTINCT doc_id FROM stok WHERE term IN {_stems('visiting', 'tested')}")
def opened_or_stemmed(spark, d):
    return _opened(spark, d, stemmed=True).any_of(["visiting", "tested", "the"])


@query(_phrase(["staff", "login"]))
def opened_phrase(spark, d):
    return _opened(spark, d).phrase(["staff", "login"])


# Ranking

RANKED = f"""
{TOK}, q AS (SELECT * FROM (VALUES ('results', 2), ('room', 1), ('survey', 1)) AS v(term, n)),
n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, log10((SELECT n FROM n) / count(*)) AS idf FROM tf GROUP BY term),
scored AS (SELECT doc_id, CASE WHEN sum(tf * idf * tf * idf) > 0 THEN sum(tf * idf * q.n * idf) / sqrt(sum(tf * idf * tf * idf)) ELSE 0.0 END AS score FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY doc_id)
"""


def _scored(spark, d):
    return ranking.tfidf(docs(spark, d), QUERY)


def _even(score: str = "score"):
    """Scores to 12 places, which levels the last bits of sums that add up in another order: equal scores stay ties."""
    return F.round(score, 12)


def _first(scored: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top(scored.withColumn("score", _even()), k).withColumn("score", F.round("score", 6))


@query(f"WITH {RANKED} SELECT doc_id, round(score, 6) AS score FROM scored")
def tfidf_all(spark, d):
    return _scored(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {RANKED} SELECT doc_id, round(score, 6) AS score FROM scored")
def opened_tfidf(spark, d):
    """The same from written postings: no text is read."""
    return _opened(spark, d, positional=False).tfidf(QUERY).withColumn("score", F.round("score", 6))


@query(f"WITH {RANKED}, t AS (SELECT doc_id, score FROM scored ORDER BY round(score, 12) DESC, doc_id LIMIT 10) SELECT t.doc_id, round(t.score, 6) AS score, d.text FROM t JOIN documents d USING (doc_id)")
def tfidf_topk(spark, d):
    """The ten best documents of the query; texts join after the limit."""
    return docs(spark, d).join(F.broadcast(_first(_scored(spark, d))), "doc_id").select("doc_id", "score", "text")


@query(f"WITH {RANKED.replace(chr(39) + 'results' + chr(39) + ', 2', chr(39) + 'results' + chr(39) + ', 1')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 12) DESC, doc_id LIMIT 10")
def tfidf_single_query(spark, d):
    return _first(ranking.tfidf(docs(spark, d), ["results", "room", "the", "survey"]))


@query(f"WITH {SEG}, {RANKED} SELECT segment_id, doc_id, round(score, 6) AS score FROM scored JOIN seg USING (doc_id) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY round(score, 12) DESC, doc_id DESC) <= 3")
def tfidf_topk_per_segment(spark, d):
    scored = ranking.tfidf(index.flushed(docs(spark, d), FLUSH), QUERY, keep=("segment_id",))
    return ranking.top_per_segment(scored.withColumn("score", _even()), 3).withColumn("score", F.round("score", 6))


@query(
    "WITH " + RANKED.strip().replace(TOK, STOK).replace("FROM tok WHERE term IN (SELECT term FROM q)", "FROM stok WHERE term IN (SELECT term FROM q)")
    .replace("q AS (SELECT * FROM (VALUES ('results', 2), ('room', 1), ('survey', 1)) AS v(term, n))", f"q AS (SELECT stem AS term, count(*) AS n FROM ({porter.duckdb_sql('SELECT unnest([' + quoted(QUERY) + ']) AS term')}) GROUP BY ALL)")
    + " SELECT doc_id, round(score, 6) AS score FROM scored"
)
def tfidf_stemmed(spark, d):
    return ranking.tfidf_stemmed(docs(spark, d), QUERY).withColumn("score", F.round("score", 6))


# Link graph

EDGES = "e AS (SELECT link_id, src, dst FROM id_graph QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY loaded_at DESC NULLS LAST, src DESC NULLS LAST, dst DESC NULLS LAST) = 1), nodes AS (SELECT DISTINCT id FROM url_map WHERE id IS NOT NULL)"
GOOD = "g AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"
RANK = f"""
WITH RECURSIVE {EDGES}, {GOOD}, w AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS w FROM g GROUP BY src, dst),
r AS (SELECT 0 AS k, id, CAST(1.0 AS DOUBLE) AS rank FROM nodes
  UNION ALL SELECT k + 1, id, 0.15 + 0.85 * sum(v) FROM (
    SELECT r.k, w.dst AS id, r.rank * w.w AS v FROM r JOIN w ON w.src = r.id WHERE r.k < {ROUNDS} UNION ALL SELECT r.k, r.id, 0.0 FROM r WHERE r.k < {ROUNDS}
  ) GROUP BY k, id)
"""


def _edges(spark, d):
    """Each link once, by the line that was loaded last."""
    lines = table(spark, d, "id_graph", "link_id", "src", "dst", "loaded_at").groupBy("link_id").agg(F.max(F.struct("loaded_at", "src", "dst")).alias("last"))
    return lines.select(F.col("last.src").cast("long").alias("src"), F.col("last.dst").cast("long").alias("dst"))


def _ranks(spark, d):
    return ranking.page_rank(table(spark, d, "url_map", "id"), _edges(spark, d), ROUNDS)


@query(f"WITH {EDGES} SELECT CAST(src AS BIGINT) AS src, count(*) AS out_degree FROM e WHERE src IS NOT NULL GROUP BY src")
def edge_outdegree(spark, d):
    return ranking.out_degree(_edges(spark, d).filter("src IS NOT NULL"))


@query(RANK + f"SELECT id, round(rank, 6) AS rank FROM r WHERE k = {ROUNDS}")
def pagerank_raw(spark, d):
    return _ranks(spark, d).withColumn("rank", F.round("rank", 6))


SCORES = f"SELECT id, (rank - min(rank) OVER ()) / max(rank) OVER () AS score FROM r WHERE k = {ROUNDS}"


@query(RANK + f"SELECT id, round(score, 6) AS score FROM ({SCORES})")
def pagerank_scores(spark, d):
    return ranking.page_rank_scores(_ranks(spark, d)).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id")


def _blend(weight: float) -> str:
    return RANK.replace("WITH RECURSIVE ", f"WITH RECURSIVE {RANKED.strip()}, ") + (
        f"SELECT doc_id, round(scored.score + {weight} * coalesce(p.score, 0), 6) AS score FROM scored LEFT JOIN ({SCORES}) p ON p.id = doc_id ORDER BY round(scored.score + {weight} * coalesce(p.score, 0), 12) DESC, doc_id LIMIT 10"
    )


def _blended(spark, d, weight):
    both = ranking.blended(_scored(spark, d), ranking.page_rank_scores(_ranks(spark, d)), weight, None)
    return _first(both)


@query(_blend(2.0))
def search_blended(spark, d):
    return _blended(spark, d, 2.0)


@query(f"WITH {RANKED} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 12) DESC, doc_id LIMIT 10")
def search_blended_w0(spark, d):
    return _blended(spark, d, 0.0)


RANKED_QUERIES = RANK.replace("WITH RECURSIVE ", f"""WITH RECURSIVE {TOK},
q AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, ({KEPT})[1] AS term FROM (SELECT query_id, unnest(terms) AS text FROM search_queries)) WHERE term IS NOT NULL GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, log10((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY term),
scored AS (SELECT query_id, doc_id, CASE WHEN sum(tf * idf * tf * idf) > 0 THEN sum(tf * idf * q.n * idf) / sqrt(sum(tf * idf * tf * idf)) ELSE 0.0 END AS score FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY ALL),
""") + f"""SELECT query_id, doc_id, round(score, 6) AS score FROM (
  SELECT query_id, doc_id, top_k, round(scored.score + coalesce(page_rank_weight, 1) * coalesce(p.score, 0), 12) AS score
  FROM scored JOIN search_queries USING (query_id) LEFT JOIN ({SCORES}) p ON p.id = doc_id
) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= coalesce(top_k, 5)"""  # fmt: skip


@query(RANKED_QUERIES)
def search_queries_blended(spark, d):
    """The first documents of every row of search_queries, with its own number and weight."""
    return ranking.ranked_queries(docs(spark, d), table(spark, d, "search_queries"), ranking.page_rank_scores(_ranks(spark, d)))


# Codec

GAP = "list_transform(range(1, len(l) + 1), lambda i: l[i] - CASE WHEN i = 1 THEN 0 ELSE l[i - 1] END)"
VBYTE = "array_to_string(list_transform(gaps, lambda g: concat(" + ", ".join(f"CASE WHEN g >= {1 << (7 * k)} THEN printf('%02X', CAST(((g >> {7 * k}) & 127) | 128 AS BIGINT)) ELSE '' END" for k in range(4, 0, -1)) + ", printf('%02X', CAST(g & 127 AS BIGINT)))), '')"
LISTS = f"lists AS (SELECT segment_id, term, list(local_id ORDER BY local_id) AS l FROM segtok GROUP BY ALL), coded AS (SELECT *, {GAP} AS gaps FROM lists)"


def _lists(spark, d):
    return index.inverted_lists(index.flushed(docs(spark, d), FLUSH))


@query(f"WITH {SEG}, {SEGTOK}, {LISTS} SELECT segment_id, term, {VBYTE} AS delta_hex FROM coded")
def vbyte_encode_postings(spark, d):
    return index.encoded_lists(_lists(spark, d)).select("segment_id", "term", "delta_hex")


@query(f"WITH {SEG}, {SEGTOK}, {LISTS} SELECT segment_id, term, array_to_string(list_transform(l, lambda v: printf('%08X', CAST(v AS BIGINT))), '') AS fixed_hex FROM lists")
def naive_encode_postings(spark, d):
    return index.encoded_lists(_lists(spark, d)).select("segment_id", "term", "fixed_hex")


@query(f"WITH {SEG}, {SEGTOK} SELECT segment_id, term, string_agg(local_id, ' ' ORDER BY local_id) AS doc_ids FROM segtok GROUP BY ALL")
def vbyte_roundtrip(spark, d):
    decoded = codec.delta_vbyte_decode(codec.delta_vbyte(F.col("doc_ids")))
    return _lists(spark, d).select("segment_id", "term", F.array_join(decoded.cast("array<string>"), " ").alias("doc_ids"))


@query(f"WITH {SEG}, {SEGTOK}, {LISTS} SELECT CAST(sum(len({VBYTE}) // 2) AS BIGINT) AS delta_bytes, CAST(sum(4 * len(l)) AS BIGINT) AS fixed_bytes FROM coded")
def compression_ratio(spark, d):
    return index.encoded_lists(_lists(spark, d)).agg((F.sum(F.length("delta_hex")) / 2).cast("long").alias("delta_bytes"), (F.sum(F.length("fixed_hex")) / 2).cast("long").alias("fixed_bytes"))


# Keys that hold most rows, and references to records that do not exist


@query("SELECT term FROM inverted_index WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 0.02 * (SELECT count(*) FROM inverted_index)")
def p5_found(spark, d):
    counts = materialize(hotkeys.key_counts(table(spark, d, "inverted_index", "term"), "term"))
    return hotkeys.hot_keys(counts, "term", counts.agg(F.sum("n_rows")).first()[0] or 0, 0.02)


@query("SELECT term, count(*) AS n_rows, count(DISTINCT doc_id) AS n_items, count(DISTINCT (doc_id, pos)) AS n_places FROM inverted_index GROUP BY term")
def p5_term_counts(spark, d):
    return hotkeys.key_counts(table(spark, d, "inverted_index", "segment_id", "term", "doc_id", "pos"), "term", "doc_id", "pos", "segment_id")


P6 = """
WITH ends AS (
  SELECT link_id, 'src' AS end_name, src AS id, seen_at FROM id_graph WHERE src IS NOT NULL UNION SELECT link_id, 'dst', dst, seen_at FROM id_graph WHERE dst IS NOT NULL
), judged AS (
  SELECT link_id, end_name, seen_at,
    CASE WHEN id NOT IN (SELECT id FROM url_map WHERE id IS NOT NULL) THEN 'missing' WHEN seen_at IS NULL THEN NULL
      WHEN bool_or(coalesce(first_seen <= seen_at, true) AND coalesce(seen_at < removed_at, true)) THEN NULL
      WHEN bool_or(coalesce(first_seen <= seen_at, true)) THEN 'removed' ELSE 'later' END AS kind
  FROM ends LEFT JOIN url_map USING (id) GROUP BY link_id, end_name, id, seen_at
)
SELECT DISTINCT link_id, end_name, kind, coalesce(strftime(seen_at, '%Y-%m'), 'unknown') AS period FROM judged WHERE kind IS NOT NULL
"""


@query(P6)
def p6_found(spark, d):
    return orphans.dangling_ends(table(spark, d, "id_graph", "link_id", "src", "dst", "seen_at"), table(spark, d, "url_map", "id", "first_seen", "removed_at"))


@query(P6.replace("SELECT DISTINCT link_id, end_name, kind,", "SELECT end_name, kind,").replace("AS period FROM judged WHERE kind IS NOT NULL", "AS period, count(DISTINCT link_id) AS n FROM judged WHERE kind IS NOT NULL GROUP BY ALL"))
def p6_report(spark, d):
    return p6_found(spark, d).groupBy("end_name", "kind", "period").agg(F.count("*").alias("n"))


LIVE = "(SELECT id FROM url_map WHERE id IS NOT NULL AND removed_at IS NULL)"


def _direct(child: str, column: str, parent: str, key: str, dated: str | None) -> str:
    period = f"coalesce(strftime({dated}, '%Y-%m'), 'unknown')" if dated else "'unknown'"
    known = LIVE if parent == "url_map" else f"(SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"
    return (
        f"SELECT '{child}' AS table_name, '{column}' AS reference, {period} AS period, 'direct' AS state, count(*) AS n FROM {child} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN {known} GROUP BY ALL HAVING count(*) > 0"
    )


def _inherited(child: str, dated: str | None) -> str:
    period = f"coalesce(strftime({dated}, '%Y-%m'), 'unknown')" if dated else "'unknown'"
    return (
        f"SELECT '{child}', 'doc_id', {period} AS period, 'inherited', count(*) AS n FROM {child} WHERE doc_id IN "
        f"(SELECT doc_id FROM documents WHERE doc_id NOT IN {LIVE}) GROUP BY ALL HAVING count(*) > 0"
    )


@query(
    " UNION ALL ".join(
        [
            _direct("id_graph", "src", "url_map", "id", "seen_at"), _direct("id_graph", "dst", "url_map", "id", "seen_at"),
            _direct("documents", "doc_id", "url_map", "id", "loaded_at"), _direct("page_scores", "doc_id", "documents", "doc_id", "scored_at"),
            _direct("page_scores", "query_id", "search_queries", "query_id", "scored_at"), _direct("inverted_index", "doc_id", "documents", "doc_id", None),
            _inherited("page_scores", "scored_at"), _inherited("inverted_index", None),
        ]
    )
)
def p6_cascade(spark, d):
    """Pages that are gone leave their links and documents as orphans, and these their scores and postings."""
    entity = orphans.Entity
    tables = {
        "url_map": entity(table(spark, d, "url_map", "id", "removed_at").filter("removed_at IS NULL"), "id"),
        "documents": entity(table(spark, d, "documents", "doc_id", "loaded_at"), "doc_id", "loaded_at"),
        "search_queries": entity(table(spark, d, "search_queries", "query_id"), "query_id"),
        "id_graph": entity(table(spark, d, "id_graph", "src", "dst", "seen_at"), None, "seen_at"),
        "page_scores": entity(table(spark, d, "page_scores", "query_id", "doc_id", "scored_at"), None, "scored_at"),
        "inverted_index": entity(table(spark, d, "inverted_index", "doc_id"), None),
    }
    refers = orphans.Relation
    relations = [
        refers("id_graph", "src", "url_map"), refers("id_graph", "dst", "url_map"), refers("documents", "doc_id", "url_map"),
        refers("page_scores", "doc_id", "documents"), refers("page_scores", "query_id", "search_queries"), refers("inverted_index", "doc_id", "documents"),
    ]
    return orphans.Cascade(tables, relations).report()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
