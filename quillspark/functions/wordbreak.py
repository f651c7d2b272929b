"""Words of unspaced text by the most probable segmentation under a dictionary.

A right-to-left scan keeps, for each suffix, its best score, the sum of log(freq / total); a whole suffix that
is a word wins a tie, else the shortest first word. A segmentation must score above ``floor``. Stop words go
after the segmentation. Texts that hold punctuation or have no segmentation give null, empty ones an empty list.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import BLANKS, JAPANESE_STOP_WORDS, STOP_WORDS, split_tokens
from quillspark.runtime import small

FORBIDDEN = re.compile(r"[,.;?!]")
FLOOR = -10_000.0
JAPANESE_FLOOR = -1_000.0
WORDS = 5_000_000
"""A dictionary has at most so many words."""
RUN = 256
"""A run has at most so many words: of words that a dictionary counts at least once in 10**16, it never falls below ``FLOOR``."""
HEAD = 4
KEPT = 128
"""Results of inputs of up to so many characters are kept, for a bounded number of them."""


class Heads(dict):
    """By the next ``HEAD`` characters of a text: the words that can begin there, ``((length, score), ...)`` of those
    within the head and the lengths of those beyond it, both rising; kept for a bounded number of heads."""

    def __init__(self, log_p: dict[str, float]):
        super().__init__()
        self.log_p = log_p
        lengths: dict[str, set[int]] = {}
        for w in log_p:
            if len(w) > HEAD:
                lengths.setdefault(w[:HEAD], set()).add(len(w))
        self.beyond = {h: tuple(sorted(x)) for h, x in lengths.items()}

    def __missing__(self, head: str):
        if len(self) > 300_000:
            self.clear()
        within = tuple((k, p) for k in range(1, len(head) + 1) if (p := self.log_p.get(head[:k])) is not None)
        found = self[head] = (within, self.beyond.get(head, ()))
        return found


def segment(text: str, log_p: dict[str, float], longest: int, floor: float = FLOOR, heads: Heads | None = None) -> list[str] | None:
    heads = Heads(log_p) if heads is None else heads
    n = len(text)
    best = [-math.inf] * n + [0.0]
    step = [0] * n
    for i in range(n - 1, -1, -1):
        score, length = floor, 0
        within, beyond = heads[text[i : i + HEAD]]
        for k, p in within:
            s = p + best[i + k]
            if s > score or s == score and length and i + k == n:
                score, length = s, k
        for k in beyond:
            if k > longest or i + k > n:
                break
            p = log_p.get(text[i : i + k])
            if p is not None:
                s = p + best[i + k]
                if s > score or s == score and length and i + k == n:
                    score, length = s, k
        if length:
            best[i], step[i] = score, length
    if n and not step[0]:
        return None
    out, i = [], 0
    while i < n:
        out.append(text[i : i + step[i]])
        i += step[i]
    return out


def runs(text: Column, most: int = RUN) -> Column:
    """All words of ``text`` without blanks, in order: a string for each stretch between line ends and ``, . ; ? !``,
    or several for a stretch of more than ``most`` words."""
    stretches = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\n\r,.;?!]+")
    words = F.filter(F.transform(stretches, lambda x: split_tokens(x, BLANKS)), lambda w: F.size(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most)), lambda k: F.array_join(F.slice(w, k, most), ""))))


def word_break(spark: SparkSession, dictionary: DataFrame, stop=STOP_WORDS, fold_case: bool = True, floor: float = FLOOR):
    """A column function ``text -> array<string>`` for ``dictionary(word, freq)``, whose size is checked and which
    is broadcast; of a repeated word the largest count holds, and all its counts are in the total."""
    if not small(dictionary, WORDS):
        raise ValueError(f"the dictionary has more than {WORDS} words")
    total = float(dictionary.agg(F.sum("freq")).first()[0] or 1)
    table = dictionary.groupBy("word").agg(F.max("freq").alias("freq")).toArrow()
    shared = spark.sparkContext.broadcast({w: math.log(f / total) for w, f in zip(table.column("word").to_pylist(), table.column("freq").to_pylist()) if w and f})
    stops = frozenset(stop)

    @F.pandas_udf("array<string>")
    def broken(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        log_p = shared.value
        longest, heads = max(map(len, log_p), default=0), Heads(log_p)
        kept: dict[str, list[str] | None] = {}  # lines of menus and footers come again and again

        def one(t):
            if t is None or FORBIDDEN.search(t):
                return None
            if t in kept:
                return kept[t]
            words = segment(t.lower() if fold_case else t, log_p, longest, floor, heads)
            found = None if words is None else [w for w in words if w not in stops]
            if len(t) <= KEPT:
                if len(kept) > 100_000:
                    kept.clear()
                kept[t] = found
            return found

        for texts in batches:
            yield texts.map(one, na_action=None)

    return broken


def japanese_word_break(spark: SparkSession, dictionary: DataFrame):
    return word_break(spark, dictionary, JAPANESE_STOP_WORDS, False, JAPANESE_FLOOR)
