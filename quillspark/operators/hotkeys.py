"""Per-key results without imbalance when a few keys hold most rows (problem 5).

Every result is an algebraic aggregate, so Spark combines it in bounded hash tables on the map side, which spill
when full, and only one compact state for each key and partition is shuffled. Exact distinct counts are made
algebraic too: items fall into words of 64, and a key's state for a word is the bits of the items seen, so a key
that holds a third of all rows is spread over its words before its few sums meet.

Where the table names a part of each item, such as its segment, a key's rows of one part are counted where they are read and
shuffle as three numbers; only where a part of a key was read in several places do its rows take the general way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import broadcast_if_small, materialize, small

HELD = 200_000
"""So many rows of a key's part are held at most while more of them follow."""


def _bit(number: Column) -> Column:
    """The bit of ``number`` in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))


def _word(number: Column) -> Column:
    return F.shiftright(number, 6)


def _general(df: DataFrame, key: str, i: Column, p: Column) -> DataFrame:
    places = df.groupBy(key, i.alias("_i"), _word(p).alias("_p")).agg(F.count("*").alias("_n"), F.bit_or(_bit(p)).alias("_places"))
    words = places.groupBy(key, _word(F.col("_i")).alias("_w")).agg(
        F.sum("_n").alias("_n"), F.bit_or(_bit(F.col("_i"))).alias("_items"), F.sum(F.when(F.col("_i").isNotNull(), F.bit_count("_places"))).alias("_places")
    )
    return words.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.sum(F.bit_count("_items")).alias("n_items"), F.sum("_places").alias("n_places"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _tallied(b: pa.RecordBatch) -> pa.RecordBatch:
    """``(key, part, n_rows, n_items, n_places)`` of the rows ``(key, part, item, place)`` of one batch."""
    coded = b.column(0).dictionary_encode()
    has_item, has_place = (~np.asarray(b.column(k).is_null()) for k in (2, 3))
    key, part, item, place = (np.asarray(c.fill_null(v)) for c, v in zip((coded.indices, *b.columns[1:4]), (-1, np.iinfo(np.int64).min, 0, 0)))
    order = np.lexsort((place, has_place, item, has_item, part, key))
    key, part, item, place, has_item, has_place = (x[order] for x in (key, part, item, place, has_item, has_place))
    first = _runs(key, part)
    new_item = first | _runs(has_item, item)
    new_place = (new_item | _runs(has_place, place)) & has_item & has_place
    starts = np.flatnonzero(first)
    sums = [np.add.reduceat(x, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64) for x in (np.ones(len(key), bool), new_item & has_item, new_place)]
    back = b.take(pa.array(order[starts], pa.int64()))
    return pa.RecordBatch.from_arrays([back.column(0), back.column(1), *map(pa.array, sums)], names=["key", "part", "n_rows", "n_items", "n_places"])


def _tallies(batches):
    """Batches of rows -> their counts; the last key and part of a batch waits for the next one, as it may go on."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
        n = len(b)
        if not n:
            continue
        same = np.flatnonzero(~np.asarray((_equal(b, 0) & _equal(b, 1))))
        cut = int(same[-1]) + 1 if len(same) else 0
        if n - cut > HELD:
            cut = n
        if cut < n:
            held = b.slice(cut)
        if cut:
            yield _tallied(b.slice(0, cut))
    if held is not None:
        yield _tallied(held)


def _equal(b: pa.RecordBatch, k: int) -> np.ndarray:
    """Whether each row has the last row's value of a column."""
    c, last = b.column(k), b.column(k)[len(b) - 1]
    return np.asarray(c.is_null()) if not last.is_valid else np.asarray(pc.equal(c, last).fill_null(False))


def key_counts(df: DataFrame, key: str, item: str | None = None, place: str | None = None, part: str | None = None) -> DataFrame:
    """Counts of every key, null included: ``(key, n_rows[, n_items][, n_places])``.

    ``n_rows``: rows as they stand. ``n_items``: distinct non-null integer items. ``n_places``: distinct
    pairs of item and non-negative integer place, so repeated rows count once; needs ``item``. ``part``: an integer column
    that is the same in all rows of an item.
    """
    if item is None:
        return df.groupBy(key).agg(F.count("*").alias("n_rows"))
    i = F.col(item).cast("long")
    zero = F.lit(0)
    if place is None:
        words = df.groupBy(key, _word(i).alias("_w")).agg(F.count("*").alias("_n"), F.bit_or(_bit(i)).alias("_items"))
        return words.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.bit_count("_items")), zero).cast("long").alias("n_items"))
    p = F.col(place).cast("long")
    names = ("n_rows", "n_items", "n_places")
    if part is None:
        counts = _general(df, key, i, p)
    else:
        rows = df.select(F.col(key).alias("key"), F.col(part).cast("long").alias("part"), i.alias("item"), p.alias("place"))
        kind = dict(df.select(key).dtypes)[key]
        told = rows.mapInArrow(_tallies, f"key {kind}, part long, n_rows long, n_items long, n_places long")
        met = materialize(told.groupBy("key", "part").agg(F.count("*").alias("_read"), *(F.sum(c).alias(c) for c in names)))
        counts = met.filter("_read = 1").groupBy("key").agg(*(F.sum(c).alias(c) for c in names))
        again = met.filter("_read > 1").select(F.col("key").alias("_k"), F.col("part").alias("_p"))
        if not small(again, 0):
            known = broadcast_if_small(again, 200_000)
            again = rows.join(known, F.col("key").eqNullSafe(F.col("_k")) & F.col("part").eqNullSafe(F.col("_p")), "left_semi")
            counts = counts.unionByName(_general(again, "key", F.col("item"), F.col("place")))
        counts = counts.groupBy(F.col("key").alias(key)).agg(*(F.sum(c).alias(c) for c in names))
    return counts.select(key, "n_rows", *(F.coalesce(c, zero).cast("long").alias(c) for c in names[1:]))


def hot_keys(counts: DataFrame, key: str, total: int, share: float) -> DataFrame:
    """Keys, not null, that hold at least ``share`` of ``total`` rows; at most ``1 / share`` rows."""
    return counts.filter(F.col(key).isNotNull() & (F.col("n_rows") >= share * total)).select(key)
