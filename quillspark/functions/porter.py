"""Porter stemming as a cascade of built-in expressions.

One list of steps is written in plain SQL over a word ``w``, with two dialect-dependent calls: a regular
expression test and the extraction of a matched suffix. A word-initial ``y`` is a consonant and is upper case
for the duration. Words of up to two characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import Analyzer, positions, standard
from quillspark.runtime import broadcast_if_small, materialize

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M0, M1 = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}"
EXACTLY_1 = f"^({C})?{V}{C}({V})?$"
VOWEL = f"^({C})?[aeiouy]"
CVC = f"^{C}[aeiouy][^aeiouwxy]$"
DOUBLE_Y = "([^aeiouy](yy)+|[aeiou]y(yy)+)$"

# Suffixes and what replaces them, where the stem before them holds a vowel and a consonant.
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
SHORT_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

Match = Callable[[str, str], str]


def _longest(suffixes) -> str:
    return "(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"


def steps(match: Match, extract: Match) -> list[tuple[str, str]]:
    """Named expressions, each over the columns before it; the first reads ``term``, the last gives ``stem``."""
    stem = lambda n, k: f"substr({n}, 1, length({n}) - {k})"

    def replaced(word: str, suffix: str, table: dict[str, str]) -> str:
        to = " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in table.items())
        cut = f"substr({word}, 1, length({word}) - length({suffix}))"
        return f"CASE WHEN {suffix} <> '' AND {match(cut, M0)} THEN concat({cut}, CASE {suffix} {to} ELSE '' END) ELSE {word} END"

    out = [("w0", "CASE WHEN substr(term, 1, 1) = 'y' THEN concat('Y', substr(term, 2)) ELSE term END")]
    plural = f"CASE WHEN {match('w0', 'sses$')} THEN {stem('w0', 2)} WHEN {match('w0', 'ies$')} THEN {stem('w0', 2)} WHEN {match('w0', '[^s]s$')} THEN {stem('w0', 1)} ELSE w0 END"
    out.append(("w1", plural))
    out.append(("cut", f"CASE WHEN {match('w1', 'eed$')} THEN '' WHEN {match('w1', 'ed$')} THEN {stem('w1', 2)} WHEN {match('w1', 'ing$')} THEN {stem('w1', 3)} ELSE '' END"))
    out.append(("stripped", f"cut <> '' AND {match('cut', VOWEL)}"))
    last2 = "substr(cut, length(cut), 1) = substr(cut, length(cut) - 1, 1)"
    double = f"length(cut) > 1 AND {last2} AND ({match('cut', '[^aeiouy]$')} OR {match('cut', DOUBLE_Y)})"
    tail = (
        f"CASE WHEN {match('cut', '(at|bl|iz)$')} THEN concat(cut, 'e') "
        f"WHEN {double} THEN CASE WHEN {match('cut', '[lsz]$')} THEN cut ELSE {stem('cut', 1)} END "
        f"WHEN {match('cut', EXACTLY_1)} AND {match('cut', CVC)} THEN concat(cut, 'e') ELSE cut END"
    )
    out.append(("w2", f"CASE WHEN {match('w1', 'eed$')} THEN CASE WHEN {match(stem('w1', 3), M0)} THEN {stem('w1', 1)} ELSE w1 END WHEN stripped THEN {tail} ELSE w1 END"))
    out.append(("w3", f"CASE WHEN {match('w2', 'y$')} AND {match(stem('w2', 1), VOWEL)} THEN concat({stem('w2', 1)}, 'i') ELSE w2 END"))
    out.append(("s4", extract("w3", _longest(DOUBLE_SUFFIXES))))
    out.append(("w4", replaced("w3", "s4", DOUBLE_SUFFIXES)))
    out.append(("s5", extract("w4", _longest(SHORT_SUFFIXES))))
    out.append(("w5", replaced("w4", "s5", SHORT_SUFFIXES)))
    out.append(("s6", f"CASE WHEN {match('w5', '[st]ion$')} THEN 'ion' ELSE {extract('w5', _longest(LAST_SUFFIXES))} END"))
    cut6 = "substr(w5, 1, length(w5) - length(s6))"
    out.append(("w6", f"CASE WHEN s6 <> '' AND {match(cut6, M1)} THEN {cut6} ELSE w5 END"))
    bare = stem("w6", 1)
    out.append(("w7", f"CASE WHEN {match('w6', 'e$')} AND ({match(bare, M1)} OR ({match(bare, M0)} AND NOT {match(bare, CVC)})) THEN {bare} ELSE w6 END"))
    out.append(("w8", f"CASE WHEN {match('w7', 'll$')} AND {match('w7', M1)} THEN {stem('w7', 1)} ELSE w7 END"))
    out.append(("stem", "CASE WHEN length(term) <= 2 THEN term WHEN substr(term, 1, 1) = 'y' AND substr(w8, 1, 1) = 'Y' THEN concat('y', substr(w8, 2)) ELSE w8 END"))
    return out


def spark_steps() -> list[tuple[str, str]]:
    return steps(lambda e, p: f"({e}) RLIKE '{p}'", lambda e, p: f"regexp_extract({e}, '{p}', 1)")


def duckdb_sql(source: str) -> str:
    """A SELECT of ``(term, stem)`` over ``source``, a query with a column ``term``, in the other dialect."""
    sql, n = source, 0
    for name, e in steps(lambda e, p: f"regexp_matches({e}, '{p}')", lambda e, p: f"regexp_extract({e}, '{p}', 1)"):
        n += 1
        sql = f"SELECT *, {e} AS {name} FROM ({sql}) AS p{n}"
    return f"SELECT term, stem FROM ({sql}) AS p"


def stemmed(words: DataFrame) -> DataFrame:
    """``(term, stem)`` for each row of ``words(term)``, written to the shared folder.

    One projection for each step, so no expression is evaluated twice; written, because a filter on the stem
    would be pushed through all steps and grow with each.
    """
    df = words.select("term")
    for name, e in spark_steps():
        df = df.withColumn(name, F.expr(e))
    return materialize(df.select("term", "stem"))


def stem_tokens(tokens: DataFrame, broadcast_words: int = 2_000_000) -> DataFrame:
    """``tokens`` with ``term`` stemmed. Only the distinct words run through the cascade; they join back, by
    broadcast if their measured number allows."""
    vocabulary = broadcast_if_small(stemmed(tokens.select("term").distinct()), broadcast_words)
    return tokens.join(vocabulary, "term").withColumn("term", F.col("stem")).drop("stem")


class Stemming:
    """A tokenizer and the stemmer as one analyzer: for queries, for the places of their terms, for whole texts."""

    def __init__(self, analyzer: Analyzer = standard):
        self.analyzer = analyzer

    def query(self, spark: SparkSession, words: list[str], whole: bool = False) -> list[str]:
        """The stem of the first token of each word, or with ``whole`` of all its tokens, in order and with repetitions."""
        if not words:
            return []
        rows = spark.createDataFrame(list(enumerate(words)), "k int, text string").select("k", F.posexplode(self.analyzer(F.col("text"))).alias("pos", "term"))
        tokens = sorted(rows.collect(), key=lambda r: (r.k, r.pos))
        stems = {r.term: r.stem for r in stemmed(spark.createDataFrame([(t,) for t in {r.term for r in tokens}], "term string")).collect()}
        return [stems[r.term] for r in tokens if whole or r.pos == 0]

    def tokens(self, documents: DataFrame) -> DataFrame:
        """``(doc_id, pos, term)`` of all tokens, stemmed."""
        return stem_tokens(positions(documents, self.analyzer))

    def places(self, documents: DataFrame, terms: list[str]) -> DataFrame:
        """``(doc_id, pos, term)`` of the given stems only. The distinct words are stemmed, those of other stems are dropped, and
        the few left join the tokens, so no more than the hits leaves the scan."""
        tokens = positions(documents, self.analyzer)
        words = stemmed(tokens.select("term").distinct()).filter(F.col("stem").isin(sorted(set(terms))))
        return tokens.join(broadcast_if_small(materialize(words), 200_000), "term").select("doc_id", "pos", F.col("stem").alias("term"))
