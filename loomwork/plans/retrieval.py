"""Queries on ranked retrieval, metrics and training sets.

Query texts are all rows of benchmark. Vector queries are the embeddings whose vec_id is divisible by 100, against all
rows. Where both meet, the vector 100 * i stands for benchmark item i and the vector d for document d, a pairing of our
own, since the tables have none: the sparse side covers all documents and items, the dense side all vectors, and the
fusion takes what only one of them has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import bm25, dense, fusion, metrics, mining
from ..session import shared_folder
from ..sources import readers, sinks
from .registry import Registry

QUERIES = query = Registry()
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: x NOT IN ({STOP}))"


def fill(sql: str, **values: object) -> str:
    """Put values for {name} marks; other braces stay."""
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", str(value))
    return sql


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"

BM25 = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({TOKENS}) AS tok FROM {{docs}}),
tf AS MATERIALIZED (SELECT doc_id, tok, count(*) AS f FROM tok GROUP BY ALL),
len AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(f), 0) AS len FROM {{docs}} d LEFT JOIN tf ON tf.doc_id = d.doc_id GROUP BY d.doc_id),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
raw AS MATERIALIZED (SELECT tok, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY tok),
idf AS MATERIALIZED (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, tok, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS tok FROM {{items}}) GROUP BY ALL),
score AS MATERIALIZED (SELECT query_id, doc_id, round(sum(qn * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN q USING (tok) JOIN idf USING (tok) JOIN len USING (doc_id), stats GROUP BY ALL)"""
ALL = fill(BM25, docs="documents", items="benchmark")
WEIGHTS = ALL[: ALL.index("q AS (")].rstrip().removesuffix(",")
TOP = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {} QUALIFY rank <= {}"
PAIRS = f"dense AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({DOT.format(a='q.embedding', b='d.embedding')}, 6) AS score, d.label, q.label AS own FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"


def doc_tokens(df: DataFrame, key: str) -> DataFrame:
    return bm25.tokens(df, key, tx.words(F.col("text")))


def benchmark(load) -> DataFrame:
    return load("benchmark").withColumnRenamed("item_id", "query_id")


def asked(load) -> DataFrame:
    return load("embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def vectors(load) -> DataFrame:
    return load("embeddings").withColumnRenamed("vec_id", "doc_id")


@query(f"WITH {WEIGHTS} SELECT n::BIGINT AS n_docs, round(avg_len, 6) AS avg_len FROM stats")
def corpus_stats(load):
    """E13."""
    return bm25.corpus_stats(doc_tokens(load("documents"), "doc_id")).select(
        "n_docs", F.round("avg_len", 6).alias("avg_len")
    )


@query(f"WITH {WEIGHTS} SELECT tok, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def bm25_idf(load):
    """weights of all terms."""
    return bm25.idf(doc_tokens(load("documents"), "doc_id")).select("tok", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {ALL} {TOP.format('score', 10)}")
def bm25_topk(load):
    """The top 10 documents of each benchmark item among those that share a term."""
    return bm25.search(
        doc_tokens(load("documents"), "doc_id"), doc_tokens(benchmark(load), "query_id"), 10, fill_zero=False
    )


@query(
    f"WITH {fill(BM25, docs='(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)', items='benchmark')}, filled AS (SELECT b.item_id AS query_id, l.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN len l LEFT JOIN score s ON s.query_id = b.item_id AND s.doc_id = l.doc_id) {TOP.format('filled', 200)}",
)
def bm25_fill_zero(load):
    """pools of 200 turns for each item, filled with turns of score 0."""
    turns = load("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return bm25.search(doc_tokens(turns, "doc_id"), doc_tokens(benchmark(load), "query_id"), 200)


@query(
    f"WITH {ALL}, top AS ({TOP.format('score', 3)}) SELECT query_id, rank, top.doc_id, md5(d.text) AS digest FROM top JOIN documents d ON d.doc_id = top.doc_id",
)
def bm25_lookup(load):
    """Ranked documents with their texts."""
    top = bm25.search(
        doc_tokens(load("documents"), "doc_id"), doc_tokens(benchmark(load), "query_id"), 3, fill_zero=False
    )
    return bm25.lookup(top, load("documents"), "doc_id", ["text"]).select(
        "query_id", "rank", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest")
    )


@query(f"WITH {PAIRS} {TOP.format('dense', 10)}")
def dense_topk(load):
    """Exact dot products."""
    return dense.search(vectors(load), asked(load), 10)


@query("""WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(1 - list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: power(q.embedding[i]::DOUBLE - d.embedding[i]::DOUBLE, 2))), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)
""" + TOP.format("p", 10))
def dense_l2_score(load):
    """1 - squared distance, as a store without a set metric ranks."""
    return dense.search(vectors(load), asked(load), 10, metric="l2")


@query(
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS head FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(" + DOT.format(a="embedding", b="embedding") + ")) AS v FROM embeddings)",
)
def l2_normalize(load):
    """F17."""
    v = load("embeddings").select("vec_id", vx.normalize(F.col("embedding")).alias("v"))
    return v.select(
        "vec_id", F.round(vx.dot(F.col("v"), F.col("v")), 6).alias("squared"), F.round(F.get("v", 0), 6).alias("head")
    )


@query("SELECT label, i::INTEGER AS i, round(sum(x * w) / greatest(sum(w), 1e-9), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS w FROM embeddings) GROUP BY ALL")
def mean_pool(load):
    """masked means of each label's vectors."""
    rows = load("embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("double"))
    return dense.mean_pool(rows, "label", "embedding", "mask").select(
        "label", F.posexplode("pooled").alias("i", "x")
    ).select("label", "i", F.round("x", 6).alias("x"))


@query(f"""WITH s AS (SELECT a.label AS query_label, b.label AS doc_label, a.vec_id, max({DOT.format(a='a.embedding', b='b.embedding')}) AS m FROM embeddings a, embeddings b GROUP BY ALL)
SELECT query_label, doc_label, round(sum(m), 6) AS score FROM s GROUP BY ALL""")
def maxsim(load):
    """F8: labels as token sets of all their vectors."""
    v = load("embeddings")
    return dense.max_sim(v, v, "label", "vec_id", "embedding").select(
        F.col("query_set").alias("query_label"), F.col("doc_set").alias("doc_label"), "score"
    )


@query(
    f"WITH {PAIRS} SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1)::BIGINT AS position FROM dense",
)
def rank_positions(load):
    """places from 0 of all documents."""
    every = dense.scores(vectors(load), asked(load))
    return fusion.rank_positions(every).select("query_id", "doc_id", F.col("position").cast("long").alias("position"))


RRF = "SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, round(coalesce({w} / (60 + d.rank), 0) + coalesce({v} / (60 + s.rank), 0), 9) AS rrf_score, d.rank AS dr, s.rank AS sr FROM d FULL JOIN s ON d.query_id = s.query_id AND d.doc_id = s.doc_id"
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST, doc_id)"
DENSE_PAIRED = f"dp AS (SELECT q.vec_id // 100 AS query_id, d.vec_id AS doc_id, round({DOT.format(a='q.embedding', b='d.embedding')}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"


def paired_vectors(load) -> DataFrame:
    return load("embeddings").where("vec_id % 100 = 0").select(
        (F.col("vec_id") / 100).cast("long").alias("query_id"), "embedding"
    )


def both_sides(load, pool: int, fill_zero: bool = True) -> tuple[DataFrame, DataFrame]:
    """The best `pool` of both sides: all vectors for the paired ones, all documents for all items."""
    d = dense.search(vectors(load), paired_vectors(load), pool)
    s = bm25.search(
        doc_tokens(load("documents"), "doc_id"), doc_tokens(benchmark(load), "query_id"), pool, fill_zero=fill_zero
    )
    return d, s


def whole_lists(load) -> tuple[DataFrame, DataFrame]:
    """Full lists on both sides, without a window that holds a list: all scores are sorted as one."""
    d = dense.scores(vectors(load), paired_vectors(load))
    docs, items = doc_tokens(load("documents"), "doc_id"), doc_tokens(benchmark(load), "query_id")
    hit = bm25.score(docs, items).withColumnRenamed("score", "s__")
    every = items.select("query_id").join(docs.select("doc_id")).join(hit, ["query_id", "doc_id"], "left")
    s = every.select("query_id", "doc_id", F.round(F.coalesce("s__", F.lit(0.0)), 6).alias("score"))
    return tuple(fusion.rank_positions(x).withColumn("rank", F.col("position") + 1) for x in (d, s))


SPARSE_ALL = "sa AS (SELECT i.item_id AS query_id, l.doc_id, coalesce(x.score, 0.0) AS score FROM benchmark i CROSS JOIN len l LEFT JOIN score x ON x.query_id = i.item_id AND x.doc_id = l.doc_id)"
HYBRID = f"WITH {ALL}, {DENSE_PAIRED}, {SPARSE_ALL}, d AS ({TOP.format('dp', '{pool}')}), s AS ({TOP.format('sa', '{pool}')}), f AS ({RRF.format(w='{w}', v='{v}')})"


@query(
    f"{fill(HYBRID, pool=20, w='1.0', v='1.0')} SELECT query_id, doc_id, rrf_score, {RANKED} AS rank FROM f QUALIFY rank <= 20",
)
def rrf_merge(load):
    """two lists of 20, cut to 20."""
    return fusion.merge(*both_sides(load, 20), limit=20).select("query_id", "doc_id", "rrf_score", "rank")


@query(
    f"{fill(HYBRID, pool=1000000, w='1.0', v='1.0')} SELECT query_id, doc_id, rrf_score, {RANKED} AS rank FROM f QUALIFY rank <= 50",
)
def rrf_full(load):
    """full lists on both sides."""
    return fusion.merge(*whole_lists(load), limit=50).select("query_id", "doc_id", "rrf_score", "rank")


@query(
    f"{fill(HYBRID, pool=50, w='0.7', v='0.3')} SELECT query_id, doc_id, rrf_score, {RANKED} AS rank FROM f WHERE doc_id <> query_id QUALIFY rank <= 10",
)
def rrf_weighted_exclude(load):
    """weights; the pair of equal ids contributes nothing but holds its places."""
    d, s = both_sides(load, 50)
    own = d.select("query_id").union(s.select("query_id")).distinct().withColumn("doc_id", F.col("query_id"))
    return fusion.weighted_neighbours(d, s, own, 10, (0.7, 0.3)).select("query_id", "doc_id", "rrf_score", "rank")


@query(
    f"{fill(HYBRID, pool=10, w='1.0', v='1.0')}, x AS (SELECT f.query_id, f.doc_id, rrf_score, d.score AS semantic_score, s.score AS sparse_score, md5(coalesce(docs.text, '')) AS digest, row_number() OVER (PARTITION BY f.query_id ORDER BY rrf_score DESC, dr NULLS LAST, sr NULLS LAST, f.doc_id) AS rank_ FROM f LEFT JOIN d USING (query_id, doc_id) LEFT JOIN s USING (query_id, doc_id) LEFT JOIN documents docs ON docs.doc_id = f.doc_id QUALIFY rank_ <= 10) SELECT * EXCLUDE (rank_), rank_ AS rank FROM x",
)
def hybrid_topk(load):
    """Both sides cut at 10, then fused, with scores and texts."""
    d, s = both_sides(load, 10)
    docs = load("documents")
    d, s = (bm25.lookup(x, docs, "doc_id", ["text"]) for x in (d, s))
    return fusion.merge_with_texts(d, s, ["text"], 10).select(
        "query_id",
        "doc_id",
        "rrf_score",
        "semantic_score",
        "sparse_score",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        "rank",
    )


def label_ranks(load, depth: int) -> DataFrame:
    """First ranks, within depth, of a vector of the query's label, the query itself left out."""
    ranked = dense.search(vectors(load), asked(load), depth, exclude_self=True).join(
        vectors(load).select("doc_id", F.col("label").cast("string").alias("name")), "doc_id"
    )
    expected = asked(load).select("query_id", F.col("label").cast("string").alias("expected"))
    return metrics.first_ranks(ranked.select("query_id", "rank", "name"), expected, depth)


FIRST = f"WITH {PAIRS}, r AS (SELECT query_id, label = own AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense WHERE query_id <> doc_id), f AS (SELECT query_id, min(rank) FILTER (WHERE hit AND rank <= {{}}) AS r FROM r GROUP BY query_id)"
AVG = "round(avg(CASE WHEN r <= {0} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{0}"


def summary_sql(depth: int, ks: tuple[int, ...]) -> str:
    return f"{FIRST.format(depth)} SELECT count(*)::BIGINT AS n_queries, count(*) FILTER (WHERE r IS NULL)::BIGINT AS misses, {', '.join(AVG.format(k) for k in ks)}, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(r), 6) AS mean_first_rank FROM f"


@query(summary_sql(10, (1, 3, 5, 10)))
def hit_mrr_at10(load):
    """E5."""
    return metrics.summary(label_ranks(load, 10))


@query(summary_sql(10**9, (1, 3, 5)))
def mrr_full_depth(load):
    """E7."""
    return metrics.summary(dense.first_relevant(vectors(load), asked(load), "label", exclude_self=True), (1, 3, 5))


@query(summary_sql(5, (1, 3, 5)))
def mrr_at5(load):
    """E8."""
    return metrics.summary(label_ranks(load, 5), (1, 3, 5))


@query(
    f"{FIRST.format(20)} SELECT k, count(*) FILTER (WHERE r <= k)::BIGINT AS hits, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN r <= k THEN 1.0 / r ELSE 0.0 END), 6) AS mrr_at_k, round(avg(CASE WHEN r <= k THEN 1.0 / log2(r + 1) ELSE 0.0 END), 6) AS ndcg_at_k FROM f, (VALUES (1), (2), (5), (20)) t(k) GROUP BY k",
)
def metrics_ks(load):
    """E6, G21."""
    return metrics.at_ks(label_ranks(load, 20), [5, 1, 2, 20, 20, 0])


@query(
    f"{FIRST.format(10)}, s AS (SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS h, round(avg(coalesce(1.0 / r, 0)), 6) AS m FROM f) SELECT 'eval/embedding/exact/hit_at_1' AS metric, h AS value FROM s UNION ALL SELECT 'eval/embedding/exact/mrr', m FROM s",
)
def metrics_flat(load):
    """E9."""
    return metrics.flatten(metrics.summary(label_ranks(load, 10), (1,)).select("hit_at_1", "mrr"), "embedding", "exact")


MINED = f"{fill(HYBRID, pool=200, w='1.0', v='1.0')}, l AS (SELECT query_id, doc_id, {RANKED} AS rank FROM f)"


@query(f"""{MINED}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM l WHERE doc_id <> query_id), t AS (SELECT a.query_id, trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) AS text, min(a.pos) AS pos FROM a JOIN documents d USING (doc_id) WHERE a.pos >= 6 GROUP BY ALL),
k AS (SELECT t.query_id, t.text, row_number() OVER (PARTITION BY t.query_id ORDER BY pos) AS n FROM t JOIN documents own ON own.doc_id = t.query_id WHERE t.text <> '' AND t.text <> trim(own.text, ' ' || chr(9) || chr(10) || chr(13)) QUALIFY n <= 32)
SELECT query_id, count(*)::BIGINT AS n_negatives, md5(string_agg(text, chr(1) ORDER BY n)) AS digest FROM k GROUP BY query_id""")
def mine_negatives_a(load):
    """Pools of 200 on both sides fused, from place 6 on 32 distinct texts; the document with the
    item's own number stands for its positive."""
    docs = load("documents").select("doc_id", "text")
    positives = load("benchmark").select(F.col("item_id").alias("query_id")).join(
        docs.withColumn("query_id", F.col("doc_id")), "query_id"
    ).select("query_id", "doc_id", "text")
    out = mining.mine(*both_sides(load, 200), docs, positives)
    return out.select(
        "query_id",
        F.size("negatives").cast("long").alias("n_negatives"),
        F.md5(F.array_join("negatives", "\x01").cast("binary")).alias("digest"),
    )


HEADS = "(SELECT doc_id, left(text, 120) AS text FROM documents)"


def sliced_sql(docs: str) -> str:
    """Negatives of one field: the top 37 of both sides fused, places 6 to 37 without the query's own number."""
    hybrid = fill(
        f"WITH {fill(BM25, docs=docs, items='benchmark')}{HYBRID.removeprefix(f'WITH {ALL}')}",
        pool=37,
        w="1.0",
        v="1.0",
    )
    return f"""{hybrid}, l AS (SELECT query_id, doc_id, {RANKED} AS rank FROM f), a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM l WHERE doc_id <> query_id)
SELECT query_id, count(*)::BIGINT AS n, md5(string_agg(d.text, chr(1) ORDER BY pos)) AS digest FROM a JOIN {docs} d USING (doc_id) WHERE pos BETWEEN 6 AND 37 AND trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY query_id"""


@query(f"""SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.n, 0) AS n_text, coalesce(x.digest, md5('')) AS text_digest, coalesce(y.n, 0) AS n_head, coalesce(y.digest, md5('')) AS head_digest
FROM ({sliced_sql('documents')}) x FULL JOIN ({sliced_sql(HEADS)}) y ON x.query_id = y.query_id""")
def mine_negatives_b(load):
    """K2: of each of two fields (whole texts, their heads) the top 37 of both sides, five dropped, 32 places kept with
    repeats."""
    texts = load("documents").select("doc_id", "text", F.left("text", F.lit(120)).alias("head"))
    asked_of, items = paired_vectors(load), doc_tokens(benchmark(load), "query_id")
    d = dense.search(vectors(load), asked_of, 37)
    fields = {
        f: (d, bm25.search(bm25.tokens(texts, "doc_id", tx.words(F.col(f))), items, 37)) for f in ("text", "head")
    }
    out = mining.mine_fields(fields, texts)
    told = lambda f: (
        F.size(f"negative_{f}").cast("long").alias(f"n_{f}"),
        F.md5(F.array_join(f"negative_{f}", "\x01").cast("binary")).alias(f"{f}_digest"),
    )
    return out.select("query_id", *told("text"), *told("head"))


@query(
    f"WITH {PAIRS}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense WHERE query_id <> doc_id) SELECT 'q' || query_id AS anchor, 'p' || query_id AS positive, 'd' || doc_id AS negative FROM r WHERE rank = 1",
)
def triples(load):
    """Anchor, positive and the first negative."""
    top = dense.search(vectors(load), asked(load), 5, exclude_self=True).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")
    )
    rows = top.select(
        F.concat(F.lit("q"), "query_id").alias("question"),
        F.concat(F.lit("p"), "query_id").alias("positive"),
        F.transform("r", lambda r: F.concat(F.lit("d"), r["doc_id"])).alias("negatives"),
    )
    return mining.triples(rows)


SMALL = "g AS (SELECT vec_id // 10 AS grp, vec_id, embedding FROM embeddings)"


def small_groups(load) -> DataFrame:
    """All vectors, each ten of consecutive ids as the few questions of a row."""
    return load("embeddings").select(F.floor(F.col("vec_id") / 10).alias("grp"), "vec_id", "embedding")


RAW = f"{DOT.format(a='a.embedding', b='b.embedding')} / sqrt({DOT.format(a='a.embedding', b='a.embedding')}) / sqrt({DOT.format(a='b.embedding', b='b.embedding')})"
COSINE = f"round({RAW}, 9)"


@query(
    f"WITH {SMALL} SELECT a.grp, a.vec_id AS a, b.vec_id AS b, round({RAW}, 6) AS similarity FROM g a JOIN g b ON a.grp = b.grp AND a.vec_id <= b.vec_id",
)
def group_similarity(load):
    """K6."""
    return mining.similarity(small_groups(load), "grp", "vec_id", "embedding").select(
        "grp", "a", "b", F.round("similarity", 6).alias("similarity")
    )


def picks_sql(groups: str, key: str, n: int) -> str:
    """Maximal marginal relevance by unrolled picks, over groups g (key, vec_id, embedding)."""
    value = "round(0.5 * rel - 0.5 * near, 9)"
    parts = [
        groups,
        f"s AS MATERIALIZED (SELECT a.{key} AS k, a.vec_id AS a, b.vec_id AS b, {COSINE} AS s FROM g a JOIN g b ON a.{key} = b.{key})",
        "n0 AS MATERIALIZED (SELECT k, a, round(avg(s), 9) AS rel, 0.0::DOUBLE AS near FROM s GROUP BY ALL)",
        "c1 AS MATERIALIZED (SELECT k, a FROM n0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY rel DESC, a) = 1)",
    ]
    for i in range(1, n):
        near = "s.s" if i == 1 else f"greatest(n{i - 1}.near, s.s)"
        parts.append(
            f"n{i} AS MATERIALIZED (SELECT n{i - 1}.k, n{i - 1}.a, rel, {near} AS near FROM n{i - 1} JOIN c{i} ON c{i}.k = n{i - 1}.k AND c{i}.a <> n{i - 1}.a JOIN s ON s.k = n{i - 1}.k AND s.a = n{i - 1}.a AND s.b = c{i}.a)",
        )
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT k, a FROM n{i} QUALIFY row_number() OVER (PARTITION BY k ORDER BY {value} DESC, a) = 1)",
        )
    rows = " UNION ALL ".join(
        f"SELECT k AS {key}, a AS vec_id, {i}::INTEGER AS pick FROM c{i}" for i in range(1, n + 1)
    )
    return f"WITH {', '.join(parts)} {rows}"


@query(picks_sql(SMALL, "grp", 2))
def mmr_first_two(load):
    """K5: the first two picks of each small group."""
    return mining.diverse_subset(small_groups(load), "grp", "vec_id", "embedding", 2)


@query(picks_sql("g AS (SELECT label, vec_id, embedding FROM embeddings)", "label", 5))
def mmr_select(load):
    """K5: five picks among all vectors of a label."""
    return mining.diverse_subset_of_large(load("embeddings"), "label", "vec_id", "embedding", 5)


@query(f"""WITH RECURSIVE {PAIRS}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense WHERE query_id <> doc_id QUALIFY rank <= 6),
g AS MATERIALIZED (SELECT query_id AS id, list(doc_id ORDER BY rank) AS near, row_number() OVER (ORDER BY query_id) AS i FROM r GROUP BY query_id),
w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, -1::BIGINT AS batch, []::BIGINT[] AS members
UNION ALL SELECT i, CASE WHEN len(took) > 1 THEN list_concat(used, took) ELSE used END, CASE WHEN len(took) > 1 THEN batch + 1 ELSE batch END, CASE WHEN len(took) > 1 THEN took ELSE [] END
FROM (SELECT g.i, w.used, w.batch, CASE WHEN list_contains(w.used, g.id) THEN [] ELSE list_concat([g.id], list_filter(g.near, lambda x: NOT list_contains(w.used, x))[1:3]) END AS took FROM w JOIN g ON g.i = w.i + 1))
SELECT batch, (generate_subscripts(members, 1) - 1)::BIGINT AS place, unnest(members) AS id FROM w WHERE len(members) > 0""")
def neighbour_batches(load):
    """K3, K4: greedy batches of four from the nearest vectors of the queries."""
    near = dense.search(vectors(load), asked(load), 6, exclude_self=True).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("neighbours")
    )
    return mining.neighbour_batches(near.withColumnRenamed("query_id", "id"), 4)


def index_sql(field: str) -> str:
    source = f"(SELECT doc_id, {field} AS text FROM documents)"
    return f"(WITH {fill(WEIGHTS.replace('documents', source))} SELECT '{field}' AS field, (SELECT count(*) FROM tf)::BIGINT AS n_postings, (SELECT count(*) FROM len)::BIGINT AS n_docs, (SELECT sum(len) FROM len)::BIGINT AS n_terms, (SELECT count(*) FROM embeddings)::BIGINT AS n_vectors)"


@query(f"SELECT * FROM {index_sql('text')} UNION ALL SELECT * FROM {index_sql('source')}")
def field_indexes(load):
    """For each field a text index and a vector collection, written and read back; their sizes."""
    spark = load("labels").sparkSession
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    v = load("embeddings")
    sinks.write_collection(v.withColumn("field", F.explode(F.array(F.lit("text"), F.lit("source")))), f"{root}/vectors")
    out = None
    for field in ("text", "source"):
        docs = bm25.tokens(load("documents"), "doc_id", tx.words(F.col(field)))
        sinks.write_index(bm25.postings(docs), docs.select("doc_id", F.size("toks").alias("len")), f"{root}/{field}")
        postings, own = readers.text_index(spark, f"{root}/{field}")
        sizes = postings.agg(F.count("*").alias("n_postings")).join(
            own.agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_terms"))
        )
        row = sizes.join(
            readers.collection(spark, f"{root}/vectors", field).agg(F.count("*").alias("n_vectors"))
        ).select(F.lit(field).alias("field"), "*")
        out = row if out is None else out.unionByName(row)
    return out
