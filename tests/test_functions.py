"""Analyzers, stemmer, word break and codec against known values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.functions import analysis, codec, porter, wordbreak


def tokens(spark, analyzer, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.t for r in df.select("i", analyzer(F.col("text")).alias("t")).orderBy("i").collect()]


def test_punctuation_tokens(spark):
    cases = {
        "Ferry 7 leaves harbour;wharf,quay": ["ferry", "7", "leaves", "harbour", "wharf", "quay"],
        "\tGLASS\n\nof\r\nWater?!": ["glass", "water"],
        "e-mail@host:80 (draft) 50% #3": ["e-mail@host:80", "(draft)", "50%", "#3"],
        "who's there": ["who's"],
        "it, was. not; so? very! own": [],
        "naïve ÉTÉ Ünder": ["naïve", "été", "ünder"],
        "?bridge .tunnel": ["bridge", "tunnel"],
        "": [], "   ": [], ";": [], None: [],
    }
    assert tokens(spark, analysis.standard, *cases) == list(cases.values())


def test_stop_words_keep_order_and_repetitions(spark):
    assert tokens(spark, analysis.standard, "lamp over lamp under the desk, lamp") == [["lamp", "lamp", "desk", "lamp"]]
    assert len(analysis.STOP_WORDS) == 127


def test_naive_tokens_and_positions(spark):
    assert tokens(spark, analysis.naive, " A  Kite, red. ", "") == [["a", "kite,", "red."], []]
    df = spark.createDataFrame([(1, "maps of the old canals"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.term) for r in analysis.positions(df).collect()] == [(1, 0, "maps"), (1, 1, "old"), (1, 2, "canals")]


def test_first_lines(spark):
    df = spark.createDataFrame([(" 12 \nhttp://a\nbody",), ("x",), (None,)], "text string")
    got = df.select(analysis.first_line_id(F.col("text")).alias("i"), analysis.second_line(F.col("text")).alias("u")).collect()
    assert [(r.i, r.u) for r in got] == [(12, "http://a"), (None, None), (None, None)]


# Words and their stems by the published algorithm.
STEMS = """caresses caress ponies poni cats cat agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat
hopping hop fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit
vietnamization vietnam decisiveness decis sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr hopeful hope
goodness good revival reviv allowance allow airliner airlin replacement replac adoption adopt bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll yes ye say sai is is""".split()


def test_porter(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame([(w,) for w in [*pairs, ""]], "term string")
    got = {r.term: r.stem for r in porter.stemmed(df).collect()}
    assert got == pairs | {"": ""}


def test_stem_tokens_joins_back(spark):
    df = spark.createDataFrame([(1, 0, "cats"), (1, 1, "cats"), (2, 0, "hopping")], "doc_id long, pos int, term string")
    for limit in (1, 100):
        assert sorted((r.doc_id, r.pos, r.term) for r in porter.stem_tokens(df, limit).collect()) == [(1, 0, "cat"), (1, 1, "cat"), (2, 0, "hop")]


# Lists and their codes.
@pytest.mark.parametrize(
    ("values", "digits"),
    [
        ([1, 2, 3, 4, 5, 6], "010101010101"), ([128, 384, 896, 1920, 3968], "81008200840088009000"), ([2147483647], "87FFFFFF7F"), ([16384], "818000"),
        ([16383], "FF7F"), ([131], "8103"), ([127], "7F"), ([0], "00"), ([3, 5, 8, 13, 20], "0302030507"), ([0, 0, 0, 0], "00000000"), ([], ""),
    ],
)
def test_delta_vbyte(spark, values, digits):
    df = spark.createDataFrame([(values,)], "v array<int>")
    code = codec.delta_vbyte(F.col("v"))
    r = df.select(F.hex(code).alias("h"), codec.delta_vbyte_decode(code).alias("back"), codec.fixed_decode(codec.fixed(F.col("v"))).alias("f")).first()
    assert (r.h, r.back, r.f) == (digits, values, values)


def test_slices_decode_anew(spark):
    df = spark.createDataFrame([("0200" "8400" "8800",)], "h string")
    code = F.unhex(F.lit("82008400" + "8800"))
    assert df.select(codec.delta_vbyte_decode(code).alias("v")).first().v == [256, 768, 1792]
    assert df.select(codec.delta_vbyte_decode(code, 2, 2).alias("v")).first().v == [512]
    assert df.select(codec.delta_vbyte_decode(code, F.lit(2)).alias("v")).first().v == [512, 1536]
    assert df.select(codec.delta_vbyte_decode(code, 2, 0).alias("v")).first().v == []
    assert df.select(codec.delta_vbyte_decode(F.lit(None).cast("binary")).alias("v")).first().v is None
    with pytest.raises(PySparkException):
        df.select(codec.delta_vbyte_decode(code, 0, 1)).collect()


def test_falling_values_are_an_error(spark):
    df = spark.createDataFrame([([3, 1],)], "v array<int>")
    with pytest.raises(PySparkException):
        df.select(codec.delta_vbyte_hex(F.col("v"))).collect()
    assert spark.createDataFrame([(None,)], "v array<int>").select(codec.delta_vbyte_hex(F.col("v")).alias("h")).first().h is None


def brute(text, log_p, floor=wordbreak.FLOOR):
    best = None
    n = len(text)
    for cuts in range(1 << max(0, n - 1)):
        words, start = [], 0
        for i in range(n):
            if i == n - 1 or cuts >> i & 1:
                words.append(text[start : i + 1])
                start = i + 1
        if all(w in log_p for w in words):
            score = sum(log_p[w] for w in words)
            if score > floor and (best is None or score > best + 1e-9):
                best = score
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=9), st.dictionaries(st.text("ab", min_size=1, max_size=4), st.floats(-9, -0.1), max_size=6))
def test_segments_have_the_best_score(text, log_p):
    got = wordbreak.segment(text, log_p, max(map(len, log_p), default=0))
    want = brute(text, log_p) if text else 0.0
    assert (got is None) == (want is None)
    if got is not None:
        assert "".join(got) == text and abs(sum(log_p[w] for w in got) - want) < 1e-6


def test_word_break(spark):
    words = spark.createDataFrame([("a", 1), ("i", 1), ("ai", 3), ("cat", 5), ("dog", 5), ("to", 50), ("be", 50), ("or", 40), ("not", 30)], "word string, freq long")
    f = wordbreak.word_break(spark, words)
    df = spark.createDataFrame([(0, "ai"), (1, "CatDog"), (2, "tobeornottobe"), (3, ""), (4, "b"), (5, "cat.dog"), (6, "cat dog"), (7, None)], "i int, t string")
    got = [r.w for r in df.select("i", f("t").alias("w")).orderBy("i").collect()]
    assert [None if w is None else list(w) for w in got] == [["ai"], ["cat", "dog"], [], [], None, None, None, None]


def test_japanese_word_break(spark):
    words = spark.createDataFrame([("図書館", 40), ("図書", 5), ("館", 5), ("新しい", 20), ("建物", 20), ("は", 90), ("だ", 90)], "word string, freq long")
    f = wordbreak.japanese_word_break(spark, words)
    df = spark.createDataFrame([(0, "図書館は新しい建物だ"), (1, "未知"), (2, ""), (3, None)], "i int, t string")
    got = [r.w for r in df.select("i", f("t").alias("w")).orderBy("i").collect()]
    assert [None if w is None else list(w) for w in got] == [["図書館", "新しい", "建物"], None, [], None]


def test_word_break_of_whole_texts(spark, tmp_path):
    from quillspark.plans import catalogue

    many = [f"w{k}" for k in range(600)]
    texts = ["1. One small ship sails over a wide sea at x\nand  back, to Port!", " ".join(many), "z" * 3000 + " " + "longestofallthewords" * 2, "İ ΑΣ\r\nŞ", "...", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(catalogue.wordbreak_tokens(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.run))
    inputs = {i: [r.input for r in got if r.doc_id == i] for i in range(len(texts))}
    assert inputs[0] == ["1", "onesmallshipsailsoverawideseaatx", "andback", "toport"]
    assert "".join(inputs[1]) == "".join(many) and len(inputs[1]) == 3
    assert inputs[2] == ["z" * 3000 + "longestofallthewords" * 2] and inputs[4] == inputs[5] == inputs[6] == [""]
    assert all(r.words is not None for r in got)
    assert [r.words for r in got if r.doc_id == 0] == ["1", "one small ship sails wide sea x", "back", "port"]
    assert " ".join(r.words for r in got if r.doc_id == 1).split() == many
    assert [r.words for r in got if r.doc_id == 2] == ["z" * 3000 + " " + "longestofallthewords" * 2]
