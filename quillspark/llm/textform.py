"""One consistent form for texts that look alike (problem 4).

The form is compatibility normalisation in composed form, with look-alike letters of Greek and Cyrillic
replaced by their Latin twins, every kind of blank mapped to the plain space and default-ignorable
characters removed; full case folding is optional, because case is a visible difference.

Defined results: null gives null; an empty text gives an empty text; the form of a form is itself.
Lines stay lines: ``\\n`` is kept, ``\\r\\n`` and a lone ``\\r`` become ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.runtime import broadcast_if_small, materialize

# Letters of Greek and Cyrillic that are drawn like a Latin letter, each followed by that letter.
LOOKALIKES = (
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj ԛq ԝw һh ӏl ԁd"
)
TWIN = {ord(p[0]): p[1] for p in LOOKALIKES.split()}

# Ranges of default-ignorable code points (Unicode, DerivedCoreProperties).
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

_IGNORED = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in IGNORABLE)
_BLANKS = "".join(f"\\U{c:08x}" for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")
_DROP = re.compile(f"[{_IGNORED}]+")
_BLANK = re.compile(f"[\t\x0b\x0c\x85  {_BLANKS}]")
_LIKE = re.compile("[" + "".join(chr(c) for c in TWIN) + "]")
# Characters that are in the form wherever they stand; most texts hold no others, which one scan tells.
_PLAIN = "".join(chr(c) for c in (*range(0xA1, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022) if c != 0xAD and unicodedata.normalize("NFKC", chr(c)) == chr(c))
_OTHER = re.compile(f"[^\\n -~{_PLAIN}]")
_COMPOSED = "".join(chr(c) for c in (*range(0x370, 0x530), *range(0x1F00, 0x2000)) if ord(unicodedata.normalize("NFD", chr(c))[0]) in TWIN)
_ANY_LIKE = re.compile(f"[{_COMPOSED}]")
_MARKS = re.compile("[̀-ͯ]")
_CR = re.compile("\r\n?")


def _twin(m: re.Match) -> str:
    return TWIN[ord(m[0])]


def form(text: str | None, fold_case: bool = False) -> str | None:
    """The one form of ``text``; with ``fold_case`` also of its case."""
    if text is None:
        return None
    if "\r" in text:
        text = _CR.sub("\n", text)
    if text.isascii():
        text = _BLANK.sub(" ", text) if "\t" in text or "\x0b" in text or "\x0c" in text else text
        return text.lower() if fold_case else text
    if not fold_case and _OTHER.search(text) is None:
        return text
    text = _DROP.sub("", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = _DROP.sub("", unicodedata.normalize("NFKC", text))
    if _ANY_LIKE.search(text):
        # Twins are replaced under their accents too, so an accented twin composes to the Latin letter.
        text = unicodedata.normalize("NFKC", _LIKE.sub(_twin, unicodedata.normalize("NFD", text)))
    elif _MARKS.search(text):
        text = unicodedata.normalize("NFKC", text)
    text = _BLANK.sub(" ", text)
    if fold_case:
        # Folding may take a text out of the form, so both are repeated until nothing changes.
        for _ in range(4):
            folded = form(text.casefold())
            if folded == text:
                break
            text = folded
    return text


def _per_value(texts: pa.Array, f) -> list:
    """``f`` of every text of a batch, called once for each distinct value."""
    coded = texts.dictionary_encode()
    made = [f(t) for t in coded.dictionary.to_pylist()]
    return [None if k is None else made[k] for k in coded.indices.to_pylist()]


def _map_form(column: str, out: str, fold_case: bool):
    def run(batches):
        for b in batches:
            made = pa.array(_per_value(b.column(b.schema.get_field_index(column)), lambda t: form(t, fold_case)), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], schema=pa.schema([*b.schema, pa.field(out, pa.string())]))

    return run


def with_form(df: DataFrame, column: str = "text", out: str = "form", fold_case: bool = False) -> DataFrame:
    """``df`` with the column ``out``: the form of ``column``; every other column stays, whatever its name.

    Batches go through Arrow; each distinct value of a batch is formed once, as texts are too large to shuffle for it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(_map_form(column, out, fold_case), schema)


_LETTER = re.compile(r"[^\W\d_]")


def _look_keys(text: str) -> tuple[bytes, bytes] | None:
    f = form(text)
    if not _LETTER.search(f):
        return None
    return tuple(hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()[:16] for x in (f, text))


def lookalike_keys(df: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """For each row with a text that holds a letter: ``(doc_id, form_key, text_key)``, both keys 16 bytes of SHA-256.

    Only keys leave the scan, so the texts are never shuffled.
    """

    def run(batches):
        for b in batches:
            kept = [(i, k) for i, k in zip(b.column(0).to_pylist(), _per_value(b.column(1), _look_keys)) if k is not None and i is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in kept], pa.int64()), *(pa.array([k[j] for _, k in kept], pa.binary()) for j in (0, 1))], names=["doc_id", "form_key", "text_key"]
            )

    return df.select(F.col(id_column).alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, form_key binary, text_key binary")


SALTED = 10_000
"""The rows of one string meet in blocks of about so many."""


def lookalike_pairs(keys: DataFrame, salted: int = SALTED) -> DataFrame:
    """Pairs of ids whose texts look the same but are different strings.

    Classes of equal strings are formed first and paired by their form, then their members join: equal strings never meet.
    A string that a third of all rows share is one counted row a partition unless a look-alike of it exists; then
    its rows are spread over blocks, each with the look-alikes, and the work is that of the pairs put out.
    """
    classes = keys.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    # Least and largest string of a form tell whether it has several; combined before the shuffle, whatever their number.
    several = keys.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("form_key")
    classes = materialize(classes.join(broadcast_if_small(several, 200_000), "form_key", "left_semi"))
    blocks = F.ceil(F.col("n") / salted)
    members = keys.select("doc_id", "text_key").join(broadcast_if_small(classes.select("text_key", "n"), 200_000), "text_key")
    members = materialize(members.select("doc_id", "text_key", F.pmod(F.xxhash64("doc_id"), blocks).alias("salt")).distinct())
    parts = classes.select("form_key", "text_key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("salt"))
    a = parts.select("form_key", F.col("text_key").alias("key_a"), F.col("salt").alias("salt_a"))
    b = parts.select("form_key", F.col("text_key").alias("key_b"), F.col("salt").alias("salt_b"))
    met = a.join(b, "form_key").filter("key_a < key_b").drop("form_key")
    of_a = members.select(F.col("text_key").alias("key_a"), F.col("salt").alias("salt_a"), F.col("doc_id").alias("x"))
    of_b = members.select(F.col("text_key").alias("key_b"), F.col("salt").alias("salt_b"), F.col("doc_id").alias("y"))
    both = met.join(of_a, ["key_a", "salt_a"]).join(of_b, ["key_b", "salt_b"]).filter("x <> y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
