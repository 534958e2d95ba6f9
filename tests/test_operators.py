"""Operators on hand-made tables: ties, empty sides, nulls; and the properties that the rankings must have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import batches, bm25, dedupe, dense, fusion, graph, metrics, mining, packing
from loomwork.plans import catalogue
from loomwork.sources import ordinals, python_source, readers, sinks
from loomwork.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicate_rules(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("b", 5, "z"), ("", 6, "e"), (None, 7, "n")], "k string, o int, v string"
    )
    o, ok = F.col("o"), F.col("v").isNotNull()
    assert rows(dedupe.last_by(df, "k", o).select("k", "o")) == [("a", 2), ("b", 5)]
    assert rows(dedupe.first_by(df, "k", o).select("k", "o")) == [("a", 1), ("b", 5)]
    assert rows(dedupe.last_valid(df, "k", o, ok).select("k", "v")) == [("a", "x"), ("b", "z")]
    assert dedupe.keep_first(df, {"k": F.col("k")}, o).count() == 4
    assert dedupe.first_by(df.limit(0), "k", o).collect() == []


def test_bm25_by_hand(spark):
    docs = bm25.tokens(
        spark.createDataFrame([(1, "a b a"), (2, "b"), (3, ""), (4, "c c")], "doc_id long, t string"),
        "doc_id",
        F.split("t", " "),
    )
    docs = docs.withColumn("toks", F.array_remove("toks", ""))
    queries = spark.createDataFrame([(9, ["a", "a", "c"]), (8, ["nothing"])], "query_id long, toks array<string>")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in bm25.search(docs, queries, 3).collect()}
    raw = {t: np.log(4 - n + 0.5) - np.log(n + 0.5) for t, n in {"a": 1, "b": 2, "c": 1}.items()}
    weight = lambda f, n: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 1.5))
    want = {1: 2 * raw["a"] * weight(2, 3), 4: raw["c"] * weight(2, 2)}
    assert got[9, 1] == (
        1, pytest.approx(want[1], abs=1e-6)
    ) and got[9, 2] == (4, pytest.approx(want[4], abs=1e-6)) and got[9, 3] == (2, 0.0)
    assert [got[8, i][0] for i in (1, 2, 3)] == [1, 2, 3]


def test_bm25_of_negative_scores(spark):
    """Terms in nearly all of a few documents have negative weights: documents without a shared term come before."""
    texts = ["a b c", "a b", "a b", "a c b", "a b", "z", "a b c", "a", "b a", "y"]
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, toks array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["a", "z"]), (3, ["none"])], "query_id long, toks array<string>")
    n, mean_len = len(texts), sum(len(t.split()) for t in texts) / len(texts)
    df = {t: sum(t in x.split() for x in texts) for t in "abczy"}
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    weight = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    part = lambda t, x: weight[t] * x.count(t) * 2.5 / (
        x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean_len)
    )
    for limit in (1, 3, 10):
        got = {}
        for r in bm25.search(docs, asked, limit).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for q, terms in ((1, ["a"]), (2, ["a", "z"]), (3, [])):
            every = [
                (round(sum(part(t, x.split()) for t in terms if t in x.split()), 6) + 0.0, i) for i,
                x in enumerate(texts)
            ]
            want = sorted(every, key=lambda e: (-e[0], e[1]))[:limit]
            assert [d for d, _ in got[q]] == [i for _, i in want] and [s for _, s in got[q]] == pytest.approx(
                [s for s, _ in want], abs=2e-6
            )


def test_full_depth_and_max_sim(spark):
    rng = np.random.default_rng(2)
    x, names = np.round(rng.normal(size=(50, 4)), 1), rng.choice(list("abc"), 50)
    df = spark.createDataFrame(
        [(i, v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, names, strict=True))] + [(90, None, "a")],
        "doc_id long, embedding array<double>, name string",
    ).repartition(3)
    asked = df.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id").unionByName(
        spark.createDataFrame(
            [(91, [1.0, 0.0, 0.0, 0.0], "none")], "query_id long, embedding array<double>, name string"
        ),
    )
    got = {r.query_id: r.first_rank for r in dense.first_relevant(df, asked, "name", exclude_self=True).collect()}
    for q in range(0, 50, 7):
        order = sorted((i for i in range(50) if i != q), key=lambda i: (-round(round(float(x[q] @ x[i]), 9), 6), i))
        assert got[q] == 1 + next(at for at, i in enumerate(order) if names[i] == names[q])
    assert got[91] is None and len(got) == 9
    sims = {(r.query_set, r.doc_set): r.score for r in dense.max_sim(df, df, "name", "doc_id", "embedding").collect()}
    assert sims == pytest.approx(
        {
            (a, b): sum(
                max(float(x[i] @ x[j]) for j in np.flatnonzero(names == b)) for i in np.flatnonzero(names == a)
            ) for a in "abc" for b in "abc"
        },
        abs=1e-5,
    )
    places = {(r.query_id, r.doc_id): r.position for r in fusion.rank_positions(dense.scores(df, asked)).collect()}
    assert len(places) == 50 * 9 and sorted(p for (q, _), p in places.items() if q == 7) == list(range(50))


def test_dense_ties_and_nulls(spark):
    docs = spark.createDataFrame(
        [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.0, 1.0]), (7, None)], "doc_id long, embedding array<float>"
    )
    asked = spark.createDataFrame(
        [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (6, None)], "query_id long, embedding array<float>"
    )
    got = [(r.query_id, r.rank, r.doc_id) for r in dense.search(docs, asked, 2).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 5), (5, 1, 3), (5, 2, 5)]
    assert rows(dense.search(docs, asked, 1, exclude_self=True).where("query_id = 5").select("doc_id")) == [(3,)]
    assert dense.search(docs, asked.limit(0), 2).collect() == [] and dense.search(docs.limit(0), asked, 2).collect() == []


def test_fusion(spark):
    ranked = lambda r: spark.createDataFrame(r, "query_id long, doc_id long, rank int")
    d, s = ranked([(1, 10, 1), (1, 11, 2)]), ranked([(1, 11, 1), (1, 12, 2)])
    got = [(r.doc_id, r.rank, r.rrf_score) for r in fusion.merge(d, s).orderBy("rank").collect()]
    assert [g[0] for g in got] == [11, 10, 12] and got[0][2] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    flip = {r.doc_id: r.rrf_score for r in fusion.merge(s, d).collect()}
    assert flip == {g[0]: g[2] for g in got}
    own = spark.createDataFrame([(1, 10)], "query_id long, doc_id long")
    assert [r.rrf_score for r in fusion.weighted_neighbours(d, s, own, 5).where("doc_id = 11").collect()] == [got[0][2]]


def test_metrics(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "B"), (1, 2, " a "), (2, 7, "x"), (3, 1, "n")], "query_id long, rank int, name string"
    )
    expected = spark.createDataFrame([(1, "A"), (2, "X"), (3, "z")], "query_id long, expected string")
    m = metrics.summary(metrics.first_ranks(ranked, expected, 10)).first()
    assert (m.n_queries, m.misses, m.hit_at_1, m.hit_at_3, m.hit_at_10) == (
        3, 1, 0.0, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6)
    )
    assert m.hit_at_1 <= m.hit_at_3 <= m.hit_at_5 <= m.hit_at_10 and m.mrr <= m.hit_at_10
    assert metrics.summary(metrics.first_ranks(ranked, expected, 5)).first().misses == 2
    none = metrics.summary(metrics.first_ranks(ranked, expected.limit(0), 5)).first()
    assert none.n_queries == 0 and none.mrr == 0.0 and none.mean_first_rank is None
    assert [
        r.k for r in metrics.at_ks(metrics.first_ranks(ranked, expected, 10), [5, 5, 0, 1]).orderBy("k").collect()
    ] == [1, 5]
    called = metrics.from_callback(
        spark.createDataFrame([(1, "q")], "query_id long, query string"),
        lambda q, k: [f"{q}{i}" for i in range(k)],
        [1, 2],
    )
    assert rows(called) == [(1, 1, "q0"), (1, 2, "q1")]


def test_windowed_negatives(spark):
    ranked = spark.createDataFrame([(1, d, d) for d in range(1, 9)], "query_id long, doc_id long, rank int")
    texts = spark.createDataFrame(
        [(1, "pos"), (2, "early"), (3, "x"), (4, " "), (5, "x"), (6, "early"), (7, "pos"), (8, "y")],
        "doc_id long, text string",
    )
    positives = spark.createDataFrame([(1, 1, "pos")], "query_id long, doc_id long, text string")
    got = mining.windowed_negatives(ranked, texts, positives, 2, 3).first().negatives
    assert got == ["x", "early", "y"]
    assert mining.sliced_negatives(
        ranked.withColumn("query_id", F.lit(1).cast("long")), texts, 1, 4
    ).first().negatives == ["x", "x", "early"]


def test_mmr():
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])
    assert mining.mmr_order(x, 2, 1.0)[0] == 2 and mining.mmr_order(x, 4, 0.5)[1] == 3
    assert sorted(mining.mmr_order(x, 4, 0.5)) == [0, 1, 2, 3]


def test_splits(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    assert mining.split(df, "k", 0.1, 1).where("is_validation").count() == 10
    assert mining.split(df.limit(2), "k", 0.9, 1).where("is_validation").count() == 1
    with pytest.raises(ValueError):
        mining.split(df, "k", 1.0, 1)
    assert mining.sample(df, "k", 500, 1).count() == 101
    questions = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "k long, q array<string>")
    assert mining.split_questions(questions, "k", "q", exact=False).count() == 3
    with pytest.raises(Exception, match="has not 3"):
        mining.split_questions(questions, "k", "q").collect()


def greedy(near, size):
    """Batches anchor by anchor, on lists."""
    used, out = set(), []
    for anchor in sorted(near):
        free = [x for x in dict.fromkeys(near[anchor]) if x != anchor and x not in used][: size - 1]
        if anchor not in used and free:
            out += [(len({b for b, _, _ in out}), i, x) for i, x in enumerate([anchor, *free])]
            used.update([anchor, *free])
    return sorted((b, i, x) for b, i, x in out)


@pytest.mark.parametrize("seed", range(3))
def test_neighbour_batches_by_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    near = {
        int(i): [int(x) for x in rng.integers(0, 60, rng.integers(0, 7))] for i in rng.choice(60, 45, replace=False)
    }
    df = spark.createDataFrame(list(near.items()), "id long, neighbours array<long>")
    assert rows(mining.neighbour_batches(df, 4)) == numbered_batches(near, 4)
    assert mining.neighbour_batches(df.limit(0), 4).collect() == []


def numbered_batches(near, size):
    batch, out = -1, []
    for _, place, x in sorted(greedy(near, size)):
        batch += place == 0
        out.append((batch, place, x))
    return sorted(out)


def test_neighbour_batches(spark):
    near = spark.createDataFrame(
        [(1, [2, 3]), (2, [1]), (3, [1, 4]), (4, [3, 5]), (5, [4])], "id long, neighbours array<long>"
    )
    assert rows(mining.neighbour_batches(near, 2)) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]


def test_packing(spark):
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate([4, 4, 4, 30, 1, 9, 1])], "f string, i int, c int")
    got = {r.i: r.shard for r in packing.pack(df, ["f"], ["i"], "c", 10).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4]


def test_ordinals(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.id for r in ordinals.numbered(df, ["k"], "n").orderBy("n").collect()]
    assert got == [r.id for r in df.orderBy("k").collect()]
    assert rows(ordinals.sharded(df, ["k"], 3).groupBy("shard").count()) == [(0, 334), (1, 334), (2, 332)]
    assert ordinals.numbered(df.limit(0), ["k"], "n").collect() == []


def test_planners(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    tries = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("x", True)], "k string, ok boolean")
    assert rows(
        batches.redo(inputs, tries, "k", F.col("ok")).select("k", "reason")
    ) == [("b", "invalid"), ("c", "missing")]
    assert rows(batches.orphans(tries, inputs, "k")) == [("x",)]
    old_out, old_err = spark.createDataFrame([("p", 1)], "k string, o int"), spark.createDataFrame(
        [("a", 2), ("q", 3)], "k string, o int"
    )
    new = spark.createDataFrame(
        [("a", 10, True), ("b", 11, False), ("b", 12, False), ("c", 13, False), ("c", 14, True)],
        "k string, o int, ok boolean",
    )
    outputs, errors = batches.merge_retry(old_out, old_err, new, "k", F.col("ok"), F.col("o"))
    assert rows(outputs) == [("a", 10), ("c", 14), ("p", 1)] and rows(errors) == [("b", 12), ("q", 3)]
    pools = spark.createDataFrame(
        [(1, "abc", ["abd", "xyz"], ["abc"]), (2, "q", [], None)], "i int, t string, s array<string>, c array<string>"
    )
    assert rows(
        batches.closest_candidates(pools, "i", "t", ["s", "c"]).select(
            "i", "pool", "place", "distance"
        ).where("pool is not null"),
    ) == [(1, 1, 0, 0)]


def test_pagerank_and_clusters(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r.rank for r in graph.pagerank(n, e, str(tmp_path)).collect()}
    m = np.zeros((5, 5))
    for s, t in [(0, 1), (1, 2), (2, 0), (3, 0)]:
        m[t, s] = 1
    m[:, 4] = 0.2
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.03 + 0.85 * m @ r
    assert [got[x] for x in "abcde"] == pytest.approx(r.tolist(), abs=1e-4) and sum(got.values()) == pytest.approx(1, abs=1e-6)
    with pytest.raises(RuntimeError, match="still move"):
        graph.pagerank(n, e, str(tmp_path), iterations=2)
    near = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8)], "a long, b long")
    points = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8, 9)], "id long")
    got = {r.id: r.cluster for r in graph.dbscan(near, points, 3, str(tmp_path)).collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "1", 7: "-1", 8: "-1", 9: "-1"}
    assert tuple(graph.cluster_counts(graph.dbscan(near, points, 3, str(tmp_path))).first()) == (1, 3)


def test_python_sources(spark, tmp_path):
    pkg = tmp_path / "pkg"
    pkg.mkdir()
    (pkg / "__init__.py").write_text("")
    (pkg / "a.py").write_text("from .b import helper\nimport json as j\n\nclass A:\n    async def run(self):\n        self.go()\n        helper()\n        j.dumps({})\n\n    def go(self):\n        only()\n\n\ndef only():\n    A()\n")
    (pkg / "b.py").write_text("def helper():\n    x.go()\n")
    (pkg / "test_a.py").write_text("from pkg.a import A\n\nclass TestA:\n    def test_it(self):\n        A()\n")
    (pkg / "bad.py").write_text("def (")
    facts = python_source.source_facts(python_source.python_files(spark, str(pkg)))
    kinds = {r.full_name: r.kind for r in facts.where("fact = 'definition'").collect()}
    assert kinds["pkg.a.A.run"] == "async_method" and kinds["pkg.a.only"] == "function" and kinds["pkg.a.A"] == "class"
    calls = {(r.caller, r.symbol): r.callee for r in python_source.calls_with_targets(facts).collect()}
    assert calls["pkg.a.A.run", "self.go"] == "pkg.a.A.go" and calls["pkg.a.A.run", "helper"] == "pkg.b.helper" and calls["pkg.a.only", "A"] == "pkg.a.A"
    assert calls["pkg.a.A.run", "j.dumps"] is None and calls["pkg.b.helper", "x.go"] == "pkg.a.A.go"
    assert [r.full_name for r in facts.where("fact = 'test'").collect()] == ["pkg.test_a.TestA.test_it"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "in" / "a.jsonl").write_text('{"k": 3}\n[1]\nbroken\n')
    lines = readers.lines(spark, str(tmp_path / "in"), glob="*.jsonl")
    assert [(r.file[-7:], r.line) for r in lines.orderBy("file", "line").collect()] == [
        ("a.jsonl", 1), ("a.jsonl", 2), ("a.jsonl", 3), ("b.jsonl", 1), ("b.jsonl", 3)
    ]
    assert rows(readers.jsonl(lines, "k int", "objects").select("k")) == [(1,), (2,), (3,)]
    with pytest.raises(Exception, match="a.jsonl:3"):
        readers.jsonl(lines, "k int").collect()
    assert readers.lines(spark, str(tmp_path / "none"), missing_ok=True).collect() == []
    df = spark.range(10)
    sinks.write_jsonl_chunks(df, str(tmp_path / "chunks"), ["id"], 4, 7)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == ["chunk=7", "chunk=8", "chunk=9"]
    sinks.write_shards(df, str(tmp_path / "shards"), ["id"], 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10
    sinks.write_typed(df.limit(0), str(tmp_path / "typed"), "id long")
    assert spark.read.parquet(str(tmp_path / "typed")).columns == ["id"]
    with pytest.raises(KeyError):
        readers.require_columns(df, ["nope"])
    with pytest.raises(Exception, match="null in v"):
        readers.no_nulls(df.select(F.lit(None).cast("string").alias("v")), ["v"]).collect()
    names = sinks.archive_names(
        spark.createDataFrame([("a.txt",), ("b.txt",)], "name string"),
        spark.createDataFrame([("a.txt",), ("a_1.txt",)], "name string"),
    )
    assert rows(names) == [("a.txt", "a_2.txt"), ("b.txt", "b.txt")]


def test_markdown_tree(spark, tmp_path):
    for name, text in {"x": "---\nname: n\n---\nbody", "y": "Привет", "z": ""}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    got = readers.with_content_id(readers.markdown_tree(spark, str(tmp_path))).collect()
    assert [
        (r.relative_path, r.metadata["name"], r.body) for r in got
    ] == [("x/SKILL.md", "n", "body")] and got[0].custom_id.startswith("sm-")


def test_latest_by_key_stream(spark, tmp_path):
    schema = "k string, o int"
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.latest_by_key(stream, "k", "o", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k", "o")) == [("a", 2), ("b", 1)]


def drained(stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return rows(stream.sparkSession.table(name))


def test_other_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"custom_id": "x", "error": null, "response": {"status_code": 200}}\nbroken\n{"custom_id": "y", "error": {"code": 1}}\n')
    got = drained(ingest.response_stream(spark, str(tmp_path / "in")), "responses")
    assert got == [("x", None, '{"status_code":200}'), ("y", '{"code":1}', None)]
    schema = "k string, ts timestamp, v double"
    data = [
        ("a", "2024-01-01 01:00:00", 1.0),
        ("a", "2024-01-01 02:00:00", 2.0),
        ("b", "2024-01-02 01:00:00", 4.0),
        ("a", "2024-01-02 03:00:00", 8.0),
    ]
    spark.createDataFrame(
        data, "k string, ts string, v double"
    ).withColumn("ts", F.col("ts").cast("timestamp")).select("k", "ts", "v").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    counts = drained(
        ingest.windowed_counts(stream(), "ts", "k", "v").withColumn(
            "window_start", F.col("window_start").cast("string")
        ),
        "counts",
        "complete",
    )
    assert counts == [
        ("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-02 00:00:00", "a", 1, 8.0), ("2024-01-02 00:00:00", "b", 1, 4.0)
    ]
    assert [
        (k, v) for k, _, v in drained(ingest.first_seen(stream(), "k", "ts", "3 days"), "firsts")
    ] == [("a", 1.0), ("b", 4.0)]


@pytest.mark.parametrize("dense_rows", [0, 1300])
def test_dbscan_of_all_vectors(spark, tmp_path, monkeypatch, dense_rows):
    """Groups without a vector divisible by 100, and one of more than 1,000, against brute force."""
    monkeypatch.setattr(graph, "BLOCK", 300)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 24))
    x = np.concatenate(
        [
            centres[rng.integers(0, 30, 200)] + rng.normal(scale=0.9, size=(200, 24)),
            centres[0] + rng.normal(scale=0.3, size=(dense_rows, 24)),
            rng.normal(size=(150, 24)),
        ],
    )
    ids = rng.permutation(3000)[: len(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.round(unit @ unit.T, 6) >= 0.6
    core = hit.sum(1) >= 4
    label = {int(i): int(i) for i in ids[core]}
    while True:
        low = {int(ids[a]): min(label[int(i)] for i in ids[hit[a] & core]) for a in np.flatnonzero(core)}
        if low == label:
            break
        label = low
    want = {int(ids[a]): str(min([label[int(i)] for i in ids[hit[a] & core]], default=-1)) for a in range(len(ids))}
    df = spark.createDataFrame(
        [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None)], "id long, v array<double>"
    ).repartition(3)
    got = {r.id: r.cluster for r in graph.dbscan_vectors(df, 0.6, 4, str(tmp_path)).collect()}
    assert got == want | {5000: "-1"} and len(set(want.values())) > 3


def test_mmr_of_whole_labels(spark):
    data = "/root/testdata/sf0.01"
    groups = {}
    for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect():
        groups.setdefault(r.label, []).append(r)
    want = {
        (k, g[at].vec_id, pick) for k,
        g in groups.items() for pick,
        at in enumerate(mining.mmr_order(np.array([r.embedding for r in g], float), 5, 0.5), 1)
    }
    assert {tuple(r) for r in catalogue.queries()["mmr_select"](spark, data).collect()} == want
    with pytest.raises(ValueError):
        mining.diverse_subset_of_large(
            spark.createDataFrame([(1, 1, [1.0])], "k int, i int, v array<double>"), "k", "i", "v", 2
        )
