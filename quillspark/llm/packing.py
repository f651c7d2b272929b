"""Containers of fixed capacity filled with whole texts by minimum bin slack (problem 9).

Texts, and pieces of longer ones, fall into blocks by a hash of their id; a block has about ``BLOCK`` of them whatever the
size of the collection, so blocks are packed independently and in parallel, and lose at most one partly filled container
each. In a block, each container starts with the largest text left; a subset-sum table over the lengths still
available, held as the bits of one integer, finds the fullest feasible combination for the rest, which is then
removed.

Defined results: a text longer than the capacity is split into full containers and a rest, and no other text is
split; a text without tokens takes no room and stands in a container of its block; equal rows are packed each.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.encoding import FOLDER, token_counts
from quillspark.runtime import materialize

BLOCK = 20_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used no more often than ``counts`` has it, whose sum is the largest that fits ``room``.

    ``lengths`` are the distinct ones in ascending order; longer ones are tried first.
    """
    if room in counts:
        return [room]
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    full = 1 << room
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        s = lengths[k]
        for _ in range(min(counts[s], room // s)):
            more = reach | ((reach << s) & mask)
            if more == reach:
                break
            steps.append((s, reach))
            reach = more
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, []
    for s, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(s)
            at -= s
    return chosen


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item, from 0; items of size 0 are in container 0."""
    waiting: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        if sizes[k] > capacity:
            raise ValueError("an item exceeds the capacity")
        waiting.setdefault(sizes[k], []).append(k)
    bin_of = [0] * len(sizes)
    waiting.pop(0, None)
    lengths = sorted(waiting)
    counts = {s: len(w) for s, w in waiting.items()}
    number = 0

    def take(s: int) -> None:
        bin_of[waiting[s].pop()] = number
        counts[s] -= 1
        if not counts[s]:
            del counts[s]
            del lengths[bisect_right(lengths, s) - 1]

    while lengths:
        first = lengths[-1]
        take(first)
        if capacity > first and lengths:
            for s in fullest(lengths, counts, capacity - first):
                take(s)
        number += 1
    return bin_of


def containers(counted: DataFrame, settings: list[tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """Containers for ``counted(doc_id, n_tokens)`` at each ``(setting_name, capacity)``.

    One row for each text, or piece of a text longer than the capacity:
    ``(setting_name, capacity, container_id, doc_id, piece_no, start_token, n_tokens)``.
    """
    counted = materialize(counted)
    n, c = F.coalesce("n_tokens", F.lit(0)), F.col("capacity")
    totals = counted.agg(*(F.sum(F.greatest(F.ceil(n / F.lit(cap)), F.lit(1))).alias(f"_{k}") for k, (_, cap) in enumerate(settings))).first() if settings else []
    given = F.array(
        *(
            F.struct(F.lit(s).alias("setting_name"), F.lit(cap).cast("long").alias("capacity"), F.lit(max(1, -(-(m or 0) // block))).cast("long").alias("blocks"))
            for (s, cap), m in zip(settings, totals)
        )
    )
    pieces = counted.select("doc_id", "n_tokens", F.inline(given)).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / c) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece_no") * c
    pieces = pieces.select("setting_name", "capacity", "blocks", "doc_id", "piece_no", start.alias("start_token"), F.least(n - start, c).alias("n_tokens"))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("blocks"))).drop("blocks")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        made = pack(t.column("n_tokens").to_pylist(), t.column("capacity")[0].as_py())
        base = t.column("block")[0].as_py() << 32
        ids = pa.array([base + m for m in made], pa.int64())
        return pa.table([t.column(x) if x else ids for x in ("setting_name", "capacity", None, "doc_id", "piece_no", "start_token", "n_tokens")], names=["setting_name", "capacity", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"])

    return pieces.groupBy("setting_name", "block").applyInArrow(run, "setting_name string, capacity long, container_id long, doc_id long, piece_no int, start_token long, n_tokens long")


def filled(documents: DataFrame, limits: DataFrame, prefix: str = "fill_", folder: str = FOLDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Containers for every ``prefix`` setting of ``limits``; texts are measured once for each tokenizer named there."""
    settings = limits.filter(F.col("setting_name").startswith(prefix) & (F.col("capacity") > 0)).select("setting_name", "tokenizer", "capacity").distinct().collect()
    out = None
    for tokenizer in sorted({s.tokenizer for s in settings}):
        made = containers(token_counts(documents, tokenizer, folder, id_column, text), sorted((s.setting_name, s.capacity) for s in settings if s.tokenizer == tokenizer))
        out = made if out is None else out.unionByName(made)
    if out is None:
        return documents.sparkSession.createDataFrame([], "setting_name string, capacity long, container_id long, doc_id long, piece_no int, start_token long, n_tokens long")
    return out


def fill_report(containers_: DataFrame) -> DataFrame:
    """How full the containers of each setting are: ``(setting_name, n_containers, n_tokens, room, fill)``."""
    one = containers_.groupBy("setting_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("capacity"))
    per = one.groupBy("setting_name").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("capacity").alias("room"))
    return per.withColumn("fill", F.round(F.col("n_tokens") / F.col("room"), 6))
