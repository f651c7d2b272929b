"""Index, retrieval, ranking, graph, hot keys and orphans against brute force on small tables."""

import random
from collections import Counter, defaultdict
from datetime import datetime as dt
from math import log10

import pytest
from pyspark.sql import functions as F

from quillspark.functions import porter
from quillspark.operators import hotkeys, index, orphans, ranking, search
from quillspark.sources import docstore, files


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


WORDS = "amber basalt cedar delta ember fjord garnet the of".split()


def made_up(rng, n):
    return [None, "", "the of"] + [" ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def kept(text):
    return [w.strip(",.") for w in (text or "").split() if w.strip(",.") not in ("the", "of")]


def test_boolean_search_against_all_texts(spark):
    rng = random.Random(1)
    texts = made_up(rng, 40)
    d, p = table(spark, texts), index.postings(table(spark, texts))
    for words in (["cedar"], ["cedar", "ember"], ["ember", "cedar", "ember", "the"], ["Fjord,"], ["opal"], ["opal", "delta"]):
        terms = {w.strip(",").lower() for w in words} - {"the"}
        every, some = ([k for k, t in enumerate(texts) if f(w in kept(t) for w in terms)] for f in (all, any))
        assert ids(search.search_and(d, words)) == ids(search.full_scan(d, " ".join(words))) == ids(search.posting_and(p, sorted(terms))) == every
        assert ids(search.search_or(d, words)) == ids(search.posting_or(p, sorted(terms))) == some
        assert ids(search.deleted(d, search.search_or(d, words))) == [k for k in range(len(texts)) if k not in some]
    for nothing in ([], [""], ["the"], ["the", ","]):
        assert ids(search.search_and(d, nothing)) == ids(search.search_or(d, nothing)) == ids(search.phrase(d, nothing)) == []
    assert ids(search.full_scan(d, "")) == ids(search.keyword(d, "of")) == ids(search.posting_and(p, [])) == ids(search.posting_or(p, [])) == []
    many = [f"w{k}" for k in range(80)]
    wide = index.postings(table(spark, [" ".join(many), " ".join(many[1:])]))
    assert ids(search.posting_and(wide, many)) == [0]


def test_phrases_against_all_places(spark):
    rng = random.Random(2)
    texts = made_up(rng, 60) + ["delta delta", "cedar of the ember cedar ember", "cedar, ember. cedar"]
    d, p = table(spark, texts), index.postings(table(spark, texts))
    for words in (["cedar", "ember"], ["delta", "delta"], ["cedar", "ember", "cedar"], ["cedar", "ember", "cedar", "ember"], ["amber", "the", "basalt"], ["opal", "cedar"]):
        terms = [w for w in words if w != "the"]
        want = [k for k, t in enumerate(texts) if any(kept(t)[i : i + len(terms)] == terms for i in range(len(kept(t))))]
        assert ids(search.phrase(d, words)) == ids(search.posting_phrase(p, search.query_terms(spark, words, whole=True))) == want
    with pytest.raises(NotImplementedError):
        search.phrase(d, [], positional=False)


def test_stemmed_search(spark):
    d = table(spark, ["Bridges were painted", "she paints a bridge daily", "painting; bridged, bridge", "a bridge", None, "repaint"])
    stemming = porter.Stemming()
    assert stemming.query(spark, ["Painting", "the", "bridges of"]) == ["paint", "bridg"] and stemming.query(spark, []) == []
    p = stemming.places(d, ["paint", "bridg"])
    assert ids(search.posting_or(p, ["paint"])) == [0, 1, 2] and ids(search.posting_and(p, ["paint", "bridg"])) == [0, 1, 2]
    assert ids(search.posting_phrase(p, ["paint", "bridg"])) == [1, 2] and ids(search.posting_phrase(p, ["bridg", "bridg"])) == [2]
    assert sorted((r.doc_id, r.pos, r.term) for r in stemming.tokens(d).filter("doc_id = 1").collect()) == [(1, 0, "paint"), (1, 1, "bridg"), (1, 2, "daili")]
    assert stemming.places(d, []).count() == 0


def plain_tfidf(texts, words):
    n, query = len(texts), Counter(words)
    df = {w: sum(w in kept(t) for t in texts) for w in query}
    out = {}
    for k, t in enumerate(texts):
        tf = {w: kept(t).count(w) for w in query if w in kept(t)}
        if tf:
            v = {w: f * log10(n / df[w]) for w, f in tf.items()}
            length = sum(x * x for x in v.values()) ** 0.5
            out[k] = sum(x * query[w] * log10(n / df[w]) for w, x in v.items()) / length if length else 0.0
    return out


@pytest.mark.parametrize("query", [["cedar"], ["cedar", "ember", "cedar"], ["amber", "the", "opal", "fjord"], ["opal"], ["the"], []])
def test_tfidf_against_a_plain_one(spark, query):
    texts = made_up(random.Random(3), 50)
    want = plain_tfidf(texts, [w for w in query if w != "the"])
    for scored in (ranking.tfidf(table(spark, texts), query), ranking.tfidf_stemmed(table(spark, texts), query)):
        got = {r.doc_id: r.score for r in scored.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    first = [r.doc_id for r in ranking.top(ranking.tfidf(table(spark, texts), query).withColumn("score", F.round("score", 9)), 4).collect()]
    assert first == sorted(want, key=lambda k: (-round(want[k], 9), k))[:4]
    assert ranking.top(ranking.tfidf(table(spark, texts), query), 0).count() == 0
    last = ranking.top(ranking.tfidf(table(spark, texts), query).withColumn("score", F.round("score", 9)), 4, (("score", True), ("doc_id", False)))
    assert [r.doc_id for r in last.collect()] == sorted(want, key=lambda k: (round(want[k], 9), -k))[:4]


def test_a_term_of_every_text_scores_nothing(spark):
    got = {r.doc_id: r.score for r in ranking.tfidf(table(spark, ["cedar ember", "cedar"]), ["cedar"]).collect()}
    assert got == {0: 0.0, 1: 0.0}


def test_segments(spark):
    assert index.layout(20, 10, 8) == [10, 10] and index.layout(40, 10, 4) == [20, 20] and index.layout(100, 10, 10) == [20] * 5
    assert index.layout(0) == [] and index.layout(25, 10, 4) == [10, 10, 5]
    d = table(spark, ["cedar ember opal", "cedar Jade", "cedar jade opal", "cedar opal Ember", "opal ember cedar", "", "cedar Ember"])
    f = index.flushed(d, 3)
    assert sorted((r.doc_id, r.segment_id, r.local_id) for r in f.collect()) == [(k, k // 3, k % 3) for k in range(7)]
    df = {(r.segment_id, r.term): r.doc_ids for r in index.inverted_lists(f).collect()}
    assert df[0, "cedar"] == [0, 1, 2] and df[1, "ember"] == [0, 1] and df[2, "cedar"] == [0]
    m = index.merged_once(f)
    assert sorted((r.doc_id, r.segment_id, r.local_id) for r in m.collect()) == [(k, 0 if k < 6 else 1, k % 6) for k in range(7)]
    s = index.segmented(d.select("doc_id"), 1, 4)
    assert Counter(r.segment_id for r in s.collect()) == Counter({k: n for k, n in enumerate(index.layout(7, 1, 4))})
    assert {r.term: r.df for r in index.term_stats(d).collect()} == {"cedar": 6, "ember": 4, "opal": 4, "jade": 2}
    assert {(r.segment_id, r.term): r.df for r in index.segment_df(f).collect()} == {k: len(v) for k, v in df.items()}


def test_positions_in_postings(spark):
    d = table(spark, ["kelp moss fern of kelp. Reed fern the kelp"])
    assert {r.term: r.positions for r in index.postings(d).collect()} == {"kelp": [0, 3, 6], "moss": [1], "fern": [2, 5], "reed": [4]}


def test_segment_files(spark, tmp_path):
    d = index.flushed(table(spark, ["cat dog", "dog", "bird"]), 2)
    index.write_postings(index.postings(d, keep=("segment_id",)), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r.segment_id, r.term, r.doc_id) for r in back.collect()) == [(0, "cat", 0), (0, "dog", 0), (0, "dog", 1), (1, "bird", 2)]


def test_document_store(spark, tmp_path):
    store = docstore.DocumentStore(spark, str(tmp_path / "store"))
    store.bulk_load(table(spark, ["b", "a", None]))
    store.add(spark.createDataFrame([(9, "z")], "doc_id long, text string"))
    assert store.size() == 3 and store.get(9).first().text == "z" and store.get(5).first() is None
    assert [r.doc_id for r in store.scan().collect()] == [0, 1, 9] and store.keys().columns == ["doc_id"]
    with pytest.raises(PermissionError):
        docstore.DocumentStore(spark, store.path, read_only=True).add(table(spark, ["x"]))
    store.add(spark.createDataFrame([(9, "y"), (10, "ten"), (10, "ten"), (11, None), (None, "x")], "doc_id long, text string"))
    assert store.size() == 4 and store.get(9).first().text == "y" and store.get(10).count() == 1
    store.add(spark.createDataFrame([(9, "z")], "doc_id long, text string"))
    store.add(spark.createDataFrame([], "doc_id long, text string"))
    new = docstore.upsert(store.rows(), spark.createDataFrame([(1, "new"), (2, "two")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in new.collect()} == {0: "b", 1: "new", 2: "two", 9: "z", 10: "ten"}


def test_file_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for n in (10, 2, 1):
        (tmp_path / "c" / f"{n}").write_text(f"{n}\nhttp://h/{n}\nbody {n}")
    assert [r.ordinal for r in files.folder(spark, str(tmp_path / "c")).orderBy("ordinal").collect()] == [1, 2, 10]
    assert sorted((r.doc_id, r.url) for r in files.web_documents(spark, str(tmp_path / "c")).collect()) == [(1, "http://h/1"), (2, "http://h/2"), (10, "http://h/10")]
    opened = files.index_folder(spark, str(tmp_path / "c"), str(tmp_path / "i"))
    assert opened.size() == 3 and ids(opened.phrase(["body", "10"])) == [10]
    (tmp_path / "u.tsv").write_text("7\thttp://h/7\n\n8 http://h/8\nx\n")
    assert sorted(((r.id, r.url) for r in files.urls(spark, str(tmp_path / "u.tsv")).collect()), key=str) == [(7, "http://h/7"), (8, "http://h/8"), (None, None)]
    (tmp_path / "g.tsv").write_text("1\t2\n1 2\n\n3\t1\n")
    assert sorted((r.src, r.dst) for r in files.edges(spark, str(tmp_path / "g.tsv")).collect()) == [(1, 2), (1, 2), (3, 1)]
    (tmp_path / "d.txt").write_text("﻿The 5\ncat 2\n")
    assert sorted((r.word, r.freq) for r in files.dictionary(spark, str(tmp_path / "d.txt")).collect()) == [("cat", 2), ("the", 5)]
    (tmp_path / "j.txt").write_bytes("7 学生\n2 の\n".encode("gbk"))
    assert sorted((r.word, r.freq) for r in files.japanese_dictionary(spark, str(tmp_path / "j.txt")).collect()) == [("の", 2), ("学生", 7)]


@pytest.mark.parametrize("hubs", [1_000_000, 1])
def test_page_rank(spark, hubs):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 2), (3, 0), (None, 1), (1, 77)], "src long, dst long")
    r = ranking.page_rank(nodes, edges, 2, hub_edges=hubs)
    assert [round(x["rank"], 9) for x in r.orderBy("id").collect()] == [round(x, 9) for x in (1.885416666666666, 0.695416666666667, 1.269166666666667, 0.15, 0.15)]
    s = ranking.page_rank_scores(r).orderBy(F.desc("score"), "id").collect()
    assert [x.id for x in s] == [0, 2, 1, 3, 4] and round(s[0].score, 9) == round(0.920441988950276, 9) and s[-1].score == 0.0
    assert {x.src: x.out_degree for x in ranking.out_degree(edges.filter("src IS NOT NULL")).collect()} == {0: 2, 1: 2, 2: 1, 3: 3}


def test_blend(spark):
    scored = spark.createDataFrame([(0, 0.5), (1, 0.4), (7, 0.9)], "doc_id long, score double")
    ranks = spark.createDataFrame([(0, 0.1), (1, 0.9)], "id long, score double")
    assert [r.doc_id for r in ranking.blended(scored, ranks, 0, None).orderBy(F.desc("score")).collect()] == [7, 0, 1]
    assert [(r.doc_id, round(r.score, 6)) for r in ranking.blended(scored, ranks, 1, 2).collect()] == [(1, 1.3), (7, 0.9)]


def test_key_counts(spark):
    random.seed(5)
    rows = [(random.choice(["a"] * 6 + ["b", None]), random.choice([None, *range(300)]), random.choice([None, *range(200)])) for _ in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "term string, doc_id long, pos int").withColumn("n_rows", F.lit(1))
    want_items, want_places, n = defaultdict(set), defaultdict(set), Counter()
    for t, i, p in rows:
        n[t] += 1
        if i is not None:
            want_items[t].add(i)
            if p is not None:
                want_places[t].add((i, p))
    got = {r.term: (r.n_rows, r.n_items, r.n_places) for r in hotkeys.key_counts(df, "term", "doc_id", "pos").collect()}
    assert got == {t: (n[t], len(want_items[t]), len(want_places[t])) for t in n}
    parted = df.withColumn("part", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") / 30).cast("int"))).repartition(3)
    for order in (["part", "term"], ["doc_id"]):
        rows_ = hotkeys.key_counts(parted.sortWithinPartitions(*order), "term", "doc_id", "pos", "part").collect()
        assert {r.term: (r.n_rows, r.n_items, r.n_places) for r in rows_} == got
    assert hotkeys.key_counts(parted.limit(0), "term", "doc_id", "pos", "part").count() == 0
    assert {r.term: r.n_items for r in hotkeys.key_counts(df, "term", "doc_id").collect()} == {t: len(want_items[t]) for t in n}
    assert [r.term for r in hotkeys.hot_keys(hotkeys.key_counts(df, "term"), "term", len(rows), 0.5).collect()] == ["a"]
    assert hotkeys.key_counts(df.limit(0), "term", "doc_id", "pos").count() == 0


def test_dangling_ends(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (2, dt(2023, 1, 1), dt(2023, 6, 1)), (2, dt(2024, 1, 1), None), (2, dt(2024, 1, 1), None), (3, dt(2025, 1, 1), None), (None, None, None)],
        "id long, first_seen timestamp_ntz, removed_at timestamp_ntz",
    )
    t = dt(2023, 7, 9)
    links = spark.createDataFrame(
        [(1, 1, 2, t, 0), (1, 1, 2, t, 5), (2, 9, 3, t, 0), (3, None, 2, dt(2023, 6, 1), 0), (4, 9, 2, None, 0), (5, 2, 2, dt(2024, 2, 2), 0)],
        "link_id long, src long, dst long, seen_at timestamp_ntz, id long",
    )
    got = sorted((r.link_id, r.end_name, r.kind, r.period) for r in orphans.dangling_ends(links, pages).collect())
    assert got == [(1, "dst", "removed", "2023-07"), (2, "dst", "later", "2023-07"), (2, "src", "missing", "2023-07"), (3, "dst", "removed", "2023-06"), (4, "src", "missing", "unknown")]
    assert orphans.dangling_ends(links.limit(0), pages).count() == 0


def test_cascade_inherits(spark):
    E, R = orphans.Entity, orphans.Relation
    nodes = E(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 5), (7, 7)], "id long, parent long"), "id")
    leaves = E(spark.createDataFrame([(1, 6, dt(2024, 5, 1)), (2, 3, None), (3, 42, None), (4, None, None)], "leaf long, node long, at timestamp_ntz"), None, "at")
    c = orphans.Cascade({"nodes": nodes, "leaves": leaves}, [R("nodes", "parent", "nodes"), R("leaves", "node", "nodes")])
    assert sorted(r.k for r in c.lost["nodes"].collect()) == [4, 5, 6]
    got = sorted((r.table_name, r.reference, r.period, r.state, r.n) for r in c.report().collect())
    assert got == [
        ("leaves", "node", "2024-05", "inherited", 1), ("leaves", "node", "unknown", "direct", 1), ("nodes", "parent", "unknown", "direct", 1), ("nodes", "parent", "unknown", "inherited", 2),
    ]


def test_ranked_queries_agree_with_one_query_each(spark):
    texts = ["cat dog cat", "dog bird", "cat", "bird bird fish", None, "", "dog cat bird"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = spark.createDataFrame([(0, 0.1), (1, 0.9), (6, 0.4)], "id long, score double")
    rows = [(1, ["cat", "cat", "dog"], None, None), (2, ["Bird"], 2, 0.0), (3, ["the", "fish", None], 3, 2.0), (4, [], 5, 1.0), (5, None, 5, 1.0), (6, ["dog"], 0, 1.0)]
    queries = spark.createDataFrame(rows, "query_id long, terms array<string>, top_k int, page_rank_weight double")
    got = {(r.query_id, r.doc_id, r.score) for r in ranking.ranked_queries(documents, queries, ranks).collect()}
    want = set()
    for i, terms, k, w in rows:
        one = ranking.blended(ranking.tfidf(documents, [t for t in terms or [] if t]), ranks, 1.0 if w is None else w, 5 if k is None else k)
        want |= {(i, r.doc_id, round(r.score, 6)) for r in one.collect()}
    assert got == want and {x[0] for x in got} == {1, 2, 3}


def test_intermediate_tables(spark, monkeypatch):
    import os

    from quillspark import runtime

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder.removeprefix("file://")))
    with runtime.scope():
        assert runtime.materialize(spark.range(5)).count() == 5
        assert set(os.listdir(folder.removeprefix("file://"))) - before
    assert set(os.listdir(folder.removeprefix("file://"))) == before

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Cluster)


def test_index_handle(spark, tmp_path):
    from quillspark.operators.handle import Index, Settings

    path = str(tmp_path / "index")
    texts = ["the tests, cases appeared", "a case", None, "", "test of the case", "cat dog cat", "dog", "cat dog cat"]
    Index.create(spark, path, Settings(stemmed=True, flush=2, merge=4))
    made = Index.open(spark, path)
    assert made.num_segments() == made.size() == 0 and made.keyword("cat").count() == made.tfidf(["cat"]).count() == 0
    made.add(table(spark, texts[:5]))
    assert [n for _, n in made.segments] == [2, 2, 1] and made.num_segments() == 3
    later = spark.createDataFrame([(5 + k, t, "clash") for k, t in enumerate(texts[5:])] + [(None, "cat", "x")], "doc_id long, text string, term string")
    made.add(later)
    again = Index.open(spark, path)
    assert again.segments == made.segments and again.settings == made.settings
    assert [n for _, n in again.segments] == [4, 3, 1] and again.size() == 8
    assert sorted((r.segment_id, r.local_id, r.doc_id, r.text) for r in again.documents().collect()) == [(0 if k < 4 else 1 if k < 7 else 2, k if k < 4 else k - 4 if k < 7 else 0, k, t) for k, t in enumerate(texts)]
    assert sorted((r.term, r.local_id, r.tf, r.positions) for r in again.postings(1).collect()) == [("case", 0, 1, [1]), ("cat", 1, 2, [0, 2]), ("dog", 1, 1, [1]), ("dog", 2, 1, [0]), ("test", 0, 1, [0])]
    assert ids(again.keyword("Cats")) == [5, 7] and ids(again.any_of(["cases", "dogs"])) == [0, 1, 4, 5, 6, 7]
    assert ids(again.all_of(["dog", "the", "cats"])) == [5, 7] and ids(again.phrase(["testing", "cases"])) == [0, 4] and ids(again.phrase(["the"])) == []
    merged = again.merge_all()
    assert [n for _, n in merged.segments] == [7, 1] and ids(merged.phrase(["cat", "dog", "cat"])) == [5, 7]
    one = [(r.doc_id, round(r.score, 9)) for r in merged.tfidf(["cat", "dogs"], 2).collect()]
    assert one == [(r.doc_id, round(r.score, 9)) for r in ranking.top(ranking.tfidf_stemmed(table(spark, texts), ["cat", "dogs"]), 2).collect()]
    plan = merged.seek(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,cat)" in plan
    with pytest.raises(IndexError):
        merged.postings(2)
    with pytest.raises(NotImplementedError):
        Index.create(spark, str(tmp_path / "plain"), Settings(positional=False)).phrase(["cat"])
    with pytest.raises(ValueError):
        Index.create(spark, str(tmp_path / "odd"), Settings(merge=3))
