"""Queries on duplicate rules, joins, planners, sets, chunks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batches, dedupe, mining, packing
from ..sources import ordinals, sinks
from .registry import Registry

QUERIES = query = Registry()
VALID = "value > 50"


def events(load):
    return load("events").select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_by_key(load):
    """J1."""
    return dedupe.last_by(events(load), "user_id", F.col("event_id"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_by_key(load):
    """J3."""
    return dedupe.first_by(events(load), "user_id", F.col("event_id"))


@query(
    f"SELECT user_id, event_id, event_type, value FROM events WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
)
def first_valid(load):
    """J2."""
    return dedupe.first_valid(events(load), "user_id", F.col("event_id"), F.expr(VALID))


@query(
    f"SELECT user_id, event_id, event_type, value FROM events WHERE {VALID} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def last_valid(load):
    """J4."""
    return dedupe.last_valid(events(load), "user_id", F.col("event_id"), F.expr(VALID))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY source, replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 'ß', 'ss')")
def keep_first_caseless(load):
    """The first row of each (source, text), trimmed and caseless, with the size of its group."""
    docs = load("documents").select("doc_id", "source", "text")
    keys = {"source": F.col("source"), "text": tx.fold(tx.trim(F.col("text")))}
    kept = dedupe.keep_first(docs, keys, F.col("doc_id")).select(
        "doc_id", keys["source"].alias("s"), F.md5(keys["text"].cast("binary")).alias("t")
    )
    sizes = docs.groupBy(
        keys["source"].alias("s"), F.md5(keys["text"].cast("binary")).alias("t")
    ).agg(F.count("*").alias("n"))
    return kept.join(sizes, ["s", "t"]).select("doc_id", "n")


@query("SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def ordered_distinct(load):
    """J6."""
    return dedupe.ordered_distinct(load("documents"), "source", F.col("doc_id"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def rows_by_key(load):
    """All rows of an id in order."""
    return dedupe.in_order(
        events(load), "user_id", F.col("event_id"), F.col("event_type")
    ).select("user_id", F.array_join("items", ",").alias("types"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_records(load):
    """Records joined to the left, missing ones with defaults."""
    labels = load("labels").withColumn("known", F.lit(True))
    return load("documents").join(labels, "doc_id", "left").select(
        "doc_id",
        F.coalesce("quality", F.lit(-1).cast(labels.schema["quality"].dataType)).alias("quality"),
        F.col("known").isNull().alias("missing"),
    )


@query("SELECT state, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_output' WHEN l.quality = 0 THEN 'invalid_output' ELSE 'ok' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY state")
def inner_join_counters(load):
    """The state of each input, counted, over responses made of the labels."""
    payload = F.concat(
        F.lit('{"summary": "s", "seed_questions": ['),
        F.when(F.col("quality") == 0, F.lit("1")).otherwise(F.lit('"q"')),
        F.lit("]}"),
    )
    response = F.to_json(
        F.struct(
            F.lit(200).alias("status_code"),
            F.struct(
                F.array(F.struct(F.struct(payload.alias("content")).alias("message"))).alias("choices")
            ).alias("body"),
        ),
    )
    key = F.col("doc_id").cast("string").alias("custom_id")
    inputs = load("documents").select(key, F.lit("{}").alias("body"), F.col("doc_id").alias("o"))
    outputs = load("labels").select(
        key, F.lit(None).cast("string").alias("error"), response.alias("response"), F.col("doc_id").alias("o")
    )
    records = load("documents").select(
        key,
        F.lit("p").alias("relative_path"),
        F.lit("c").alias("content"),
        F.create_map(F.lit("name"), F.lit("n"), F.lit("description"), F.lit("d")).alias("metadata"),
        F.col("doc_id").alias("o"),
    )
    return batches.state_counts(
        batches.retriever_rows(inputs, outputs, records, "o", {"summary": "string", "seed_questions": "strings"})
    ).select("state", "n")


@query("SELECT c_custkey, CASE WHEN max(o_orderkey) IS NULL THEN 'missing' ELSE 'invalid' END AS reason FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING coalesce(max((o_totalprice > 200000)::INT), 0) = 0")
def redo_anti(load):
    """Customers without a large order, with the reason."""
    attempts = load("orders").withColumnRenamed("o_custkey", "c_custkey")
    return batches.redo(load("customer").select("c_custkey"), attempts, "c_custkey", F.col("o_totalprice") > 200000)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 99)")
def retry_semi(load):
    """D5."""
    e = load("events")
    return batches.retry(e.select("event_id", "user_id"), e.where("value > 99"), "user_id")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphans(load):
    """D6."""
    return batches.orphans(load("labels"), load("documents").where("lang = 'en'"), "doc_id")


@query("""WITH old_err AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'), new AS (SELECT user_id, event_id, value > 50 AS good FROM events WHERE event_type = 'view'),
won AS (SELECT DISTINCT user_id FROM new WHERE good), still AS (SELECT user_id, max(event_id) AS event_id FROM new WHERE NOT good AND user_id NOT IN (SELECT user_id FROM won) GROUP BY user_id)
SELECT 'error' AS side, user_id, event_id FROM old_err WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT 'error', user_id, event_id FROM still
UNION ALL SELECT 'output', user_id, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'output', user_id, event_id FROM new WHERE good""")
def retry_merge(load):
    """Outputs and errors after a retry."""
    e = load("events")
    kind = lambda k: e.where(F.col("event_type") == k).select("user_id", "event_id")
    new = e.where("event_type = 'view'").select("user_id", "event_id", "value")
    outputs, errors = batches.merge_retry(
        kind("purchase"), kind("click"), new, "user_id", F.col("value") > 50, F.col("event_id")
    )
    return errors.select(F.lit("error").alias("side"), "*").unionByName(
        outputs.select(F.lit("output").alias("side"), "*")
    )


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS last_id FROM (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id) a
JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' AND value > 50 GROUP BY user_id) b ON a.user_id = b.user_id""")
def scenario_join(load):
    """The first row of one side with the last valid row of the other."""
    e = load("events")
    left = e.where("event_type = 'view'").select(
        F.col("user_id").alias("custom_id"), F.col("event_id").alias("first_id"), F.col("event_id").alias("o")
    )
    right = e.where("event_type = 'click'").select(
        F.col("user_id").alias("custom_id"), F.col("event_id").alias("last_id"), "value", F.col("event_id").alias("o")
    )
    return batches.scenario_rows(left, right, "o", F.col("value") > 50).select(
        F.col("custom_id").alias("user_id"), "first_id", "last_id"
    )


@query("SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL)::BIGINT AS in_both, count(*) FILTER (WHERE b IS NULL)::BIGINT AS only_left, count(*) FILTER (WHERE a IS NULL)::BIGINT AS only_right FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT vec_id AS b FROM embeddings) ON a = b")
def id_overlap(load):
    """I1 to I3."""
    return batches.id_overlap(load("documents"), load("embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


@query("SELECT coalesce(d.doc_id, v.vec_id) AS id, coalesce(d.lang, cast(v.label AS VARCHAR)) AS value FROM documents d FULL JOIN embeddings v ON d.doc_id = v.vec_id")
def full_outer_merge(load):
    """Both sides, values of the left one first."""
    v = load("embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return load("documents").select("doc_id", "lang").join(v, "doc_id", "full").select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.col("label").cast("string")).alias("value")
    )


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled' FROM labels")
def resume_union(load):
    """What isn't done yet, and what is."""
    labels = load("labels")
    return batches.remaining(
        load("documents").select("doc_id", "lang"), labels, "doc_id"
    ).unionByName(labels.select("doc_id", F.lit("labelled").alias("lang")))


@query("SELECT p_partkey, CASE WHEN levenshtein(lower(p_name), lower(p_type)) <= levenshtein(lower(p_name), lower(p_brand)) THEN 0 ELSE 1 END AS pool, least(levenshtein(lower(p_name), lower(p_type)), levenshtein(lower(p_name), lower(p_brand)))::INTEGER AS distance FROM part")
def nearest_candidate(load):
    """The closest of two pools."""
    rows = load("part").select(
        "p_partkey", "p_name", F.array("p_type").alias("seed"), F.array("p_brand").alias("scenario")
    )
    return batches.closest_candidates(
        rows, "p_partkey", "p_name", ["seed", "scenario"]
    ).select("p_partkey", "pool", "distance")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user')::BIGINT AS from_user, count(*) FILTER (WHERE role <> 'user')::BIGINT AS from_others, CASE WHEN count(*) FILTER (WHERE role = 'user') > count(*) FILTER (WHERE role <> 'user') THEN 'user' ELSE 'others' END AS winner FROM conversations GROUP BY conv_id")
def source_tally(load):
    """E10."""
    return batches.source_tally(load("conversations"), "conv_id", F.col("role") == "user", ("user", "others"))


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'custom_id' WHEN event_type = 'click' THEN 'method' ELSE NULL END AS fault FROM events")
def shape_check(load):
    """The first rule that a request breaks."""
    r = load("events").select(
        "event_id",
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("custom_id"),
        F.when(F.col("event_type") == "click", "GET").otherwise("POST").alias("method"),
        F.lit("/v1").alias("url"),
        F.col("props").alias("body"),
    )
    return batches.shape_faults(r).select("event_id", "fault")


@query("SELECT lang AS file, count(DISTINCT source)::BIGINT AS n_urls, count(DISTINCT source) = 1 AS single FROM documents GROUP BY lang")
def single_endpoint(load):
    """C14."""
    return batches.endpoints(load("documents").select(F.col("lang").alias("file"), F.col("source").alias("url")))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50)::BIGINT AS succeeded, count(*) FILTER (WHERE NOT coalesce(value > 50, false))::BIGINT AS failed FROM events GROUP BY event_type")
def success_error_split(load):
    """C17, B15."""
    e = load("events").withColumn("response", F.when(F.col("value") > 50, F.lit("r")))
    good, bad = batches.split_outcomes(e, F.lit(None), F.col("response"))
    both = good.select("event_type", F.lit(True).alias("ok")).unionByName(
        bad.select("event_type", F.lit(False).alias("ok"))
    )
    return sinks.run_summary(F.col("event_type"), both, F.col("ok"), "m").select(
        F.col("source_file").alias("event_type"), "succeeded", "failed"
    )


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def prefix_limit(load):
    """A prefix in input order."""
    return load("documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS chunk FROM orders")
def chunk_ids(load):
    """H6, B2: chunks of 500 rows in order."""
    return ordinals.chunked(load("orders").select("o_orderkey"), ["o_orderkey"], 500)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // ceil(count(*) OVER () / 7.0)::BIGINT)::BIGINT AS shard FROM orders")
def equal_shards(load):
    """B6."""
    return ordinals.sharded(load("orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
p AS (SELECT source, doc_id, i, n_chars AS held, 0::BIGINT AS shard FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN p.held > 0 AND p.held + d.n_chars > 20000 THEN d.n_chars ELSE p.held + d.n_chars END, CASE WHEN p.held > 0 AND p.held + d.n_chars > 20000 THEN p.shard + 1 ELSE p.shard END FROM p JOIN d ON d.source = p.source AND d.i = p.i + 1)
SELECT source, doc_id, shard FROM p""")
def budget_pack(load):
    """Shards of at most 20,000 characters in each source."""
    return packing.pack(
        load("documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000
    ).select("source", "doc_id", "shard")


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('7-' || c_custkey), c_custkey) <= (SELECT greatest(1, floor(count(*) * 0.2)) FROM customer) AS is_validation FROM customer")
def split_by_hash(load):
    """K7."""
    return mining.split(load("customer").select("c_custkey"), "c_custkey", 0.2, 7)


@query("SELECT c_custkey FROM customer ORDER BY md5('3-' || c_custkey), c_custkey LIMIT 50")
def sample_hash(load):
    """K9: a sample of 50 rows."""
    return mining.sample(load("customer").select("c_custkey"), "c_custkey", 50, 3)


@query("""SELECT conv_id, text AS question, CASE WHEN i <= 2 THEN 'train' ELSE 'validation' END AS part FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 3 AND i <= 3""")
def split_per_key(load):
    """K8: two questions for training, one for validation; conversations with fewer are left out."""
    rows = load("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r")
    ).select("conv_id", F.transform("r", lambda r: r["text"]).alias("questions"))
    return mining.split_questions(rows, "conv_id", "questions", exact=False)


@query("SELECT c.conv_id, c.text AS question, 'conv ' || c.conv_id AS expected FROM conversations c WHERE trim(c.text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def question_pairs(load):
    """K13."""
    rows = load("conversations").groupBy("conv_id").agg(F.collect_list("text").alias("q")).withColumn(
        "name", F.concat(F.lit("conv "), "conv_id")
    )
    return mining.question_pairs(rows, "name", "q").select(
        F.substring("expected", 6, 30).cast("long").alias("conv_id"), "question", "expected"
    )


@query("SELECT d.event_type AS document, d.i AS document_index, count(*)::BIGINT AS n FROM (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS i FROM events GROUP BY event_type) d JOIN events e ON e.event_type = d.event_type GROUP BY ALL")
def retrieval_tables(load):
    """Documents in the order they first appear, and the queries on them."""
    docs, asked = mining.retrieval_tables(load("events"), "event_id", "event_type", F.col("event_id"))
    return asked.join(docs, "document_index").groupBy("document", "document_index").agg(F.count("*").alias("n"))
