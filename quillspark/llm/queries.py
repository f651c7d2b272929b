"""Queries of this subpackage, ``pN_...`` for problem N, over a folder of tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import boilerplate, encoding, fusion, neardup, packing, splitting, termweight, textform
from quillspark.runtime import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "documents", "doc_id", "text", "source"))


def p1_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "documents", "doc_id", "text", "source"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_duplicates(table(spark, d, "documents", "doc_id", "text", "source"), width=3, similarity=0.6, least_words=20)
    return neardup.expanded(links, members)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents", "doc_id", "text", "source")
    return neardup.every_group(pages, *neardup.near_duplicates(pages))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.lookalike_pairs(materialize(textform.lookalike_keys(table(spark, d, "documents", "doc_id", "text"))))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return textform.with_form(table(spark, d, "documents", "doc_id", "text"), fold_case=True).select("doc_id", "form")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # The model's own terms, those of positive converged weight, and of them the ones the counts allow.
    wanted = termweight.Wanted(least_tf=5, least_df=2, most_df=9, pattern="[a-z]{4,}", least_weight=0.0)
    return termweight.term_weights(table(spark, d, "documents", "doc_id", "text"), wanted).select("doc_id", "term")


def p2_weights(spark: SparkSession, d: str) -> DataFrame:
    return termweight.term_weights(table(spark, d, "documents", "doc_id", "text")).withColumn("weight", F.round("weight", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "search_queries")
    return fusion.top(fusion.query_ranking(table(spark, d, "page_scores"), asked), asked, "query_id", "doc_id", "top_k", 5).select("query_id", "doc_id")


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = fusion.query_ranking(table(spark, d, "page_scores"), table(spark, d, "search_queries"))
    return ranked.select("query_id", "doc_id", F.round("points", 9).alias("points"))


def p7_borda(spark: SparkSession, d: str) -> DataFrame:
    """The same with averaged ties and the mean place for missing scores."""
    ranked = fusion.query_ranking(table(spark, d, "page_scores"), table(spark, d, "search_queries"), "average", "middle")
    return ranked.select("query_id", "doc_id", F.round("points", 9).alias("points"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encoded(table(spark, d, "documents", "doc_id", "text"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.filled(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "token_limits"))


def p9_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "token_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_main_text, p2_found, p2_weights, p3_found, p3_groups, p4_found, p4_forms, p7_found, p7_ranking, p7_borda,
        p8_ids, p9_containers, p9_fill_report, p10_pieces,
    )
    return {f.__name__: f for f in found}


# The share of a query's documents with a lower score; NaN and null are lower than all.
P7 = """
WITH latest AS (
  SELECT query_id, doc_id, CASE WHEN isnan(tf_idf_score) THEN NULL ELSE tf_idf_score END AS a, CASE WHEN isnan(current_pr) THEN NULL ELSE current_pr END AS b
  FROM page_scores WHERE query_id IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY scored_at DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST) = 1
), placed AS (
  SELECT l.query_id, l.doc_id, top_k, coalesce(page_rank_weight, 1) AS w,
    CASE WHEN a IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY l.query_id ORDER BY a NULLS FIRST) - 1) / count(*) OVER (PARTITION BY l.query_id) END AS pa,
    CASE WHEN b IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY l.query_id ORDER BY b NULLS FIRST) - 1) / count(*) OVER (PARTITION BY l.query_id) END AS pb
  FROM latest l JOIN search_queries q ON l.query_id = q.query_id
)
"""


_MEAN = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY l.query_id ORDER BY {0} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY l.query_id, {0}) - 1) / 2) / count({0}) OVER (PARTITION BY l.query_id) WHEN count({0}) OVER (PARTITION BY l.query_id) > 0 THEN (count({0}) OVER (PARTITION BY l.query_id) - 1) / (2 * count({0}) OVER (PARTITION BY l.query_id)) ELSE 0 END"
P7_BORDA = (
    P7.split(", placed AS")[0]
    + f"SELECT l.query_id, doc_id, round({_MEAN.format('a')} + coalesce(page_rank_weight, 1) * {_MEAN.format('b')}, 9) AS points FROM latest l JOIN search_queries q ON l.query_id = q.query_id"
)


def _formed(column: str) -> str:
    """The form of problem 4 in SQL, as far as the tables go: full-width forms, ligatures, ignorable characters, blanks,
    separate accents and look-alike letters. Other compatibility forms are left as they are."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    blanks = "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs") + "\t"
    like = "".join(chr(c) for c in textform.TWIN)
    twins = "".join(textform.TWIN.values())
    ignored = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in textform.IGNORABLE)
    out = f"regexp_replace({column}, '[{ignored}]', '', 'g')"
    out = f"translate({out}, '{wide}', '{plain}')"
    for c in range(0xFB00, 0xFB07):
        out = f"replace({out}, '{chr(c)}', '{unicodedata.normalize('NFKC', chr(c))}')"
    # Twins under accents: accents apart, twins replaced, composed again.
    composed = [c for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)) if len(unicodedata.normalize("NFD", chr(c))) > 1 and ord(unicodedata.normalize("NFD", chr(c))[0]) in textform.TWIN]
    for c in composed:
        out = f"replace({out}, '{chr(c)}', '{unicodedata.normalize('NFD', chr(c))}')"
    out = f"nfc_normalize(translate({out}, '{like}', '{twins}'))"
    return f"replace(replace(translate({out}, '{blanks}', '{' ' * len(blanks)}'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


P2 = f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower({_formed('text')}), '\\p{{L}}+')) AS term FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)
SELECT doc_id, term FROM counted JOIN (SELECT term FROM counted GROUP BY term HAVING count(*) BETWEEN 2 AND 9) USING (term) WHERE tf >= 5 AND regexp_full_match(term, '[a-z]{{4,}}')
"""
# The model's optimum in closed form: terms by tf / background, kept as long as they lie above the level v of those before.
P2_WEIGHTS = f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower({_formed('text')}), '\\p{{L}}+')) AS term FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
stats AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM counted GROUP BY term),
grounded AS (SELECT *, {1 / termweight.LAMBDA - 1} * cf / (SELECT sum(cf) FROM stats) AS ground FROM counted JOIN stats USING (term)),
levelled AS (SELECT *, sum(tf) OVER w / (1 + sum(ground) OVER w) AS v, row_number() OVER w AS k FROM grounded WINDOW w AS (PARTITION BY doc_id ORDER BY tf / ground DESC, term ROWS UNBOUNDED PRECEDING)),
best AS (SELECT doc_id, arg_max(v, k) AS v FROM levelled WHERE tf > v * ground GROUP BY doc_id),
raw AS (SELECT doc_id, term, tf, df, greatest(tf / best.v - ground, 0) AS own FROM levelled JOIN best USING (doc_id))
SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, df, round(own / sum(own) OVER (PARTITION BY doc_id), 6) AS weight FROM raw
"""
P4_FORMS = f"SELECT doc_id, replace(replace(lower({_formed('text')}), 'ß', 'ss'), 'ς', 'σ') AS form FROM documents"
P4 = f"""
WITH formed AS (SELECT doc_id, text, {_formed('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM formed a JOIN formed b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id WHERE regexp_matches(a.form, '\\p{{L}}')
"""


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force in ``tests/llm``."""
    return {
        "p2_found": P2,
        "p2_weights": P2_WEIGHTS,
        "p4_found": P4,
        "p4_forms": P4_FORMS,
        "p7_found": P7 + "SELECT query_id, doc_id FROM placed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pa + w * pb DESC, doc_id) <= coalesce(top_k, 5)",
        "p7_ranking": P7 + "SELECT query_id, doc_id, round(pa + w * pb, 9) AS points FROM placed",
        "p7_borda": P7_BORDA,
    }
