"""Token ids of whole texts by a public byte-level vocabulary (problem 8), shared by packing and splitting.

The rank file is read once on the driver, from a folder that is a parameter, and broadcast; its size is fixed.
Long texts are split before encoding at positions where the pattern always splits: a single space between two
characters that are no blanks. Ids are thus those of the unsplit text.

Defined results: null and empty texts give an empty list; strings that spell special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART = 20_000
"""Texts of more characters are split before encoding."""


class Vocabulary:
    """A rank file as an encoder, with the byte length of every id."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(text) <= PART:
            return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int32)
        return np.concatenate([np.asarray(self.encoding.encode_to_numpy(p, disallowed_special=()), dtype=np.int32) for p in parts(text, PART)])

    def decode(self, ids) -> bytes:
        """The exact bytes behind ``ids``, also where a character is cut."""
        return b"".join(self.encoding.decode_single_token_bytes(int(i)) for i in ids)


def parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where the pattern splits in any case."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER):
    """A function for workers that gives the vocabulary ``name``, built once a process."""
    if not name.startswith("byte_bpe"):
        raise ValueError(f"{name}: only byte-level rank files are supported")
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    key = f"{folder}/{name}"

    def get() -> Vocabulary:
        if key not in _LOADED:
            _LOADED[key] = Vocabulary(data.value)
        return _LOADED[key]

    return get


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row."""
    get = vocabulary(documents.sparkSession, tokenizer, folder)

    def run(batches):
        v = get()
        for b in batches:
            made = [v.ids(t) for t in b.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; 0 for null and empty texts."""
    get = vocabulary(documents.sparkSession, tokenizer, folder)

    def run(batches):
        v = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v.ids(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
