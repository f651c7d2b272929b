"""Analyzers as column functions: text to ordered tokens.

Positions are ordinals after stop words are gone. Tokens keep order and duplicates. Empty and null texts give an
empty list; no empty token is ever produced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
# The stop words of Japanese word break.
JAPANESE_STOP_WORDS = "と 》 《 が だ て を は に た 。 」 「 … も で か ん う その ？ ます です ！ よ お ｜ この ―― ぬ な ね まで だけ じゃ って ながら という でも し など けど たり らしい じ".split()

PUNCTUATION = r"[\s\x0B,.;?!]+"
BLANKS = r"[\s\x0B]+"

Analyzer = Callable[[Column], Column]


def split_tokens(text: Column, pattern: str) -> Column:
    """Lower-cased parts of ``text`` between matches of ``pattern``, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), pattern), lambda t: t != "")


def naive(text: Column) -> Column:
    """Lower case, split at blanks."""
    return split_tokens(text, BLANKS)


def punctuation(text: Column) -> Column:
    """Lower case, split at blanks and ``, . ; ? !``, stop words kept."""
    return split_tokens(text, PUNCTUATION)


def without_stop_words(tokens: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """Tokens but for stop words; order and duplicates stay."""
    return F.filter(tokens, lambda t: ~t.isin(list(stop)))


def standard(text: Column) -> Column:
    """Punctuation tokens without stop words."""
    return without_stop_words(punctuation(text))


def positions(documents: DataFrame, analyzer: Analyzer = standard, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, term)``: one row for each token."""
    return documents.select(F.col(id_column).alias("doc_id"), F.posexplode(analyzer(F.col(text))).alias("pos", "term"))


def first_line_id(text: Column) -> Column:
    """The integer on the first line of a text; null if there is none."""
    return F.trim(F.split(text, "\n")[0]).try_cast("bigint")


def second_line(text: Column) -> Column:
    """The trimmed second line; null without one."""
    return F.trim(F.get(F.split(text, "\n"), F.lit(1)))
