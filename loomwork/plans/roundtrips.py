"""Queries on readers, writers and small operators: tables are written to the shared folder in the format under test and
read back by the operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..functions import text as tx
from ..operators import batches, dense, fusion, graph, metrics, mining
from ..session import shared_folder
from ..sources import python_source, readers, sinks
from .registry import Registry

QUERIES = query = Registry()
SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def session(load) -> SparkSession:
    return load("region").sparkSession


def place(load) -> tuple[SparkSession, str]:
    """The session, and a new folder in the one that driver and executors share."""
    spark = session(load)
    return spark, f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


def questions(load) -> DataFrame:
    """(conv_id, questions): the non-null texts of each conversation in order."""
    rows = load("conversations").where("text is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r")
    )
    return rows.select("conv_id", F.transform("r", lambda r: r["text"]).alias("questions"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_strict(load):
    """A2, B1: JSON lines written and read strictly, line by line of each file."""
    spark, root = place(load)
    sinks.write_jsonl(load("conversations").select("conv_id", "turn", "role", "text"), root)
    return readers.jsonl(
        readers.lines(spark, root), "conv_id long, turn long, role string, text string"
    ).drop("file", "line")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def raw_lines(load):
    """A4: non-blank lines of a file with blank ones, and of one that isn't there."""
    spark, root = place(load)
    rows = load("orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit("  ")).alias("value")
    )
    rows.write.text(root)
    return readers.lines(spark, [root, f"{root}-none"], missing_ok=True).select(
        F.col("value").cast("long").alias("o_orderkey")
    )


@query("SELECT row_number() OVER (ORDER BY part, s_suppkey) AS place, s_suppkey, part FROM (SELECT s_suppkey, 'a' AS part FROM supplier UNION ALL SELECT s_suppkey, 'b' FROM supplier)")
def scan_order(load):
    """A5: several paths in the order of path and line."""
    spark, root = place(load)
    ids = load("supplier").select(F.col("s_suppkey").cast("string").alias("value"), F.col("s_suppkey").alias("k"))
    for part in ("b", "a"):
        ids.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{root}/{part}")
    every = readers.lines(spark, [f"{root}/b", f"{root}/a"])
    from ..sources.ordinals import numbered

    rows = numbered(every, ["file", "line"], "n")
    return rows.select(
        (F.col("n") + 1).alias("place"),
        F.col("value").cast("long").alias("s_suppkey"),
        F.regexp_extract("file", r"/([ab])/[^/]*$", 1).alias("part"),
    )


@query("SELECT DISTINCT 'lang=' || lang AS folder FROM documents")
def listing(load):
    """The files below a folder, by their folders."""
    spark, root = place(load)
    load("documents").select("lang", F.col("doc_id").cast("string").alias("value")).write.partitionBy("lang").text(root)
    return readers.listing(spark, root, "*.txt", True).select(
        F.regexp_extract("path", r"/([^/]+)/[^/]*$", 1).alias("folder")
    ).distinct()


@query("SELECT n_name || '/SKILL.md' AS relative_path, n_name AS name, 'Nation ' || n_nationkey AS description, 'Body of ' || n_name AS body, 'sm-' || left(sha256(n_name || '/SKILL.md'), 24) AS custom_id FROM nation WHERE n_nationkey % 5 > 1")
def skill_tree(load):
    """Documents of a tree; those of another script or without a word are left out."""
    spark, root = place(load)
    for r in load("nation").collect():  # the 25 rows of a fixed table
        text = f"---\nname: {r.n_name}\ndescription: Nation {r.n_nationkey}\n---\nBody of {r.n_name}"
        sinks.write_text(
            spark, f"{root}/{r.n_name}/SKILL.md", {0: text + " ж", 1: "--- !"}.get(r.n_nationkey % 5, text)
        )
        sinks.write_text(spark, f"{root}/{r.n_name}/OTHER.md", "not read")
    rows = readers.with_content_id(readers.markdown_tree(spark, root))
    return rows.select(
        "relative_path",
        F.col("metadata")["name"].alias("name"),
        F.col("metadata")["description"].alias("description"),
        "body",
        "custom_id",
    )


@query("SELECT event_id, event_type AS name, cast(user_id AS VARCHAR) AS user, '' AS nothing, '{\"b\":1,\"v\":[2]}' AS nested FROM events")
def records_coerced(load):
    """Records with metadata of any JSON values, as texts."""
    spark, root = place(load)
    meta = F.concat(
        F.lit('{"name": "'),
        "event_type",
        F.lit('", "user": '),
        F.col("user_id").cast("string"),
        F.lit(', "nothing": null, "nested": {"b": 1, "v": [2]}}'),
    )
    line = F.concat(
        F.lit('{"relative_path": "p", "content": "c", "record_index": '),
        F.col("event_id").cast("string"),
        F.lit(', "metadata": '),
        meta,
        F.lit("}"),
    )
    load("events").select(line.alias("value")).write.text(root)
    m = F.col("metadata")
    rows = readers.records(readers.lines(spark, root)).where(m["description"] == "")
    return rows.select(
        F.col("record_index").alias("event_id"),
        m["name"].alias("name"),
        m["user"].alias("user"),
        m["nothing"].alias("nothing"),
        m["nested"].alias("nested"),
    )


@query("SELECT cast(doc_id AS VARCHAR) AS doc_id, lang, cast(n_chars AS VARCHAR) AS n_chars FROM documents")
def strict_points(load):
    """Parquet columns as text; all must be there."""
    spark, root = place(load)
    load("documents").write.parquet(root)
    return readers.data_points(spark.read.parquet(root), ["doc_id", "lang", "n_chars"])


@query(
    f"SELECT doc_id, coalesce(nullif(trim(lang, {SPACE}), ''), source) AS positive FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality = 1",
)
def training_rows(load):
    """Rows with a question and a positive, the second choice where the first is blank."""
    rows = load("documents").join(load("labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, "q").otherwise(" ").alias("question"),
        tx.first_non_blank(F.col("lang"), F.col("source")).alias("summary"),
    )
    return readers.training_rows(rows).select("doc_id", F.col("summary").alias("positive"))


@query("SELECT doc_id, 'parquet' AS source FROM documents UNION ALL SELECT doc_id, 'jsonl' FROM labels")
def source_choice(load):
    """Parquet rows before those of JSON lines, these where there are no others."""
    a = load("documents").select("doc_id", F.lit("parquet").alias("source"))
    b = load("labels").select("doc_id", F.lit("jsonl").alias("source"))
    return readers.summary_rows(a, b).unionByName(readers.summary_rows(None, b))


@query(
    f"SELECT conv_id, count(*) FILTER (WHERE trim(text, {SPACE}) <> '')::BIGINT AS n, md5(coalesce(string_agg(text, chr(1) ORDER BY turn) FILTER (WHERE trim(text, {SPACE}) <> ''), '')) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
)
def validated_rows(load):
    """Validated questions written and read back, blank ones left out; no cache is an empty one."""
    spark, root = place(load)
    sinks.write_jsonl(
        questions(load).select(
            F.col("conv_id").cast("string").alias("custom_id"),
            F.concat("questions", F.array(F.lit(" \t"))).alias("filtered_questions"),
        ),
        root,
    )
    rows = readers.validated_cache(spark, root).unionByName(readers.validated_cache(spark, f"{root}-none"))
    return rows.select(
        F.col("custom_id").cast("long").alias("conv_id"),
        F.size("filtered_questions").cast("long").alias("n"),
        F.md5(F.array_join("filtered_questions", "\x01").cast("binary")).alias("digest"),
    )


@query("SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg('s' || text, chr(1) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def scenario_file(load):
    """Scenario rows written sorted by id, read with checks."""
    spark, root = place(load)
    pairs = F.transform("questions", lambda q: F.struct(F.concat(F.lit("s"), q).alias("scenario"), q.alias("question")))
    sinks.write_jsonl(
        questions(load).select(F.col("conv_id").cast("string").alias("custom_id"), pairs.alias("scenario_output")),
        root,
        ["custom_id"],
    )
    rows = readers.scenario_rows(readers.lines(spark, root))
    said = F.transform("scenario_output", lambda p: p["scenario"])
    return rows.select(
        F.col("custom_id").cast("long").alias("conv_id"),
        F.size("scenario_output").cast("long").alias("n"),
        F.md5(F.array_join(said, "\x01").cast("binary")).alias("digest"),
    )


@query("SELECT vec_id AS id, 'v' || label AS document, embedding[1]::DOUBLE AS head, label AS label FROM embeddings")
def collection(load):
    """A vector collection of two fields, one of them written anew, the other read."""
    spark, root = place(load)
    rows = load("embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("v"), "label").alias("document"), "embedding", "label"
    )
    sinks.write_collection(
        rows.withColumn("field", F.lit("summary")).unionByName(rows.withColumn("field", F.lit("description"))), root
    )
    sinks.write_collection(rows.limit(3).withColumn("field", F.lit("description")), root)
    return readers.collection(spark, root, "summary").select(
        "id", "document", F.get("embedding", 0).cast("double").alias("head"), "label"
    )


@query("SELECT n_nationkey, 'Find ' || n_name || ' in 7 steps, true.' AS prompt FROM nation")
def yaml_and_template(load):
    """A prompt from a template file and a YAML mapping."""
    spark, root = place(load)
    sinks.write_text(spark, f"{root}/c.yaml", "steps: 7\nflag: true\n")
    sinks.write_text(spark, f"{root}/t.txt", "Find {{ name }} in {{steps}} steps, {{ flag }}.{{ none }}")
    config = readers.yaml_config(spark, f"{root}/c.yaml")
    values = {k: F.lit(str(v).lower()) for k, v in config.items()}
    return load("nation").select(
        "n_nationkey",
        tx.render(readers.whole_text(spark, f"{root}/t.txt"), {"name": F.col("n_name"), **values}).alias("prompt"),
    )


MODULES = {
    "__init__.py": "",
    "a.py": "import json as j\nfrom .b import helper\n\nclass A:\n    async def run(self):\n        helper()\n\ndef only():\n    A()\n",
    "b.py": "def helper():\n    pass\n",
    "test_a.py": "class TestA:\n    def test_it(self):\n        pass\n\ndef test_two():\n    pass\n",
    "bad.py": "def (",
}


@query("""SELECT * FROM (VALUES ('pkg.a', 'definition', 'pkg.a.A', 'class', NULL, NULL), ('pkg.a', 'definition', 'pkg.a.A.run', 'async_method', NULL, NULL), ('pkg.a', 'definition', 'pkg.a.only', 'function', NULL, NULL),
('pkg.a', 'import', NULL, NULL, 'helper', 'pkg.b.helper'), ('pkg.a', 'import', NULL, NULL, 'j', 'json'), ('pkg.a', 'call', 'pkg.a.A.run', 'async_method', 'helper', NULL), ('pkg.a', 'call', 'pkg.a.only', 'function', 'A', NULL),
('pkg.b', 'definition', 'pkg.b.helper', 'function', NULL, NULL), ('pkg.test_a', 'definition', 'pkg.test_a.TestA', 'class', NULL, NULL), ('pkg.test_a', 'definition', 'pkg.test_a.TestA.test_it', 'method', NULL, NULL),
('pkg.test_a', 'definition', 'pkg.test_a.test_two', 'function', NULL, NULL), ('pkg.test_a', 'test', 'pkg.test_a.TestA.test_it', NULL, NULL, NULL), ('pkg.test_a', 'test', 'pkg.test_a.test_two', NULL, NULL, NULL)) t(module_name, fact, full_name, kind, symbol, target)""")
def package_scan(load):
    """Definitions, imports, calls and tests of the Python files of a folder, a broken one left out."""
    spark, root = place(load)
    for name, text in MODULES.items():
        sinks.write_text(spark, f"{root}/pkg/{name}", text or "#")
    facts = python_source.source_facts(python_source.python_files(spark, f"{root}/pkg"))
    return facts.select(
        "module_name",
        "fact",
        "full_name",
        F.when(F.col("fact") != "test", F.col("kind")).alias("kind"),
        "symbol",
        "target",
    )


@query("SELECT 3 + (row_number() OVER (ORDER BY o_orderkey) - 1) // 4000 AS chunk, o_orderkey FROM orders")
def jsonl_chunks(load):
    """B2: numbered chunks of JSON lines, read back with their numbers."""
    spark, root = place(load)
    sinks.write_jsonl_chunks(load("orders").select("o_orderkey"), root, ["o_orderkey"], 4000, 3)
    return spark.read.text(root).select(
        F.col("chunk").cast("long").alias("chunk"),
        F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"),
    )


@query("""WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
p AS (SELECT lang, doc_id, i, n_chars AS held, 0::BIGINT AS shard FROM d WHERE i = 1 UNION ALL SELECT d.lang, d.doc_id, d.i, CASE WHEN p.held > 0 AND p.held + d.n_chars > 30000 THEN d.n_chars ELSE p.held + d.n_chars END, CASE WHEN p.held > 0 AND p.held + d.n_chars > 30000 THEN p.shard + 1 ELSE p.shard END FROM p JOIN d ON d.lang = p.lang AND d.i = p.i + 1)
SELECT lang, shard, doc_id FROM p""")
def jsonl_budget(load):
    """JSON lines in shards of a budget, read back with their shards."""
    spark, root = place(load)
    sinks.write_jsonl_budget(
        load("documents").select("lang", "doc_id", "n_chars"), root, ["doc_id"], "n_chars", 30000, ["lang"]
    )
    rows = spark.read.schema("value string, lang string, shard long").text(root)
    return rows.select("lang", "shard", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query("SELECT cast(vec_id AS VARCHAR) AS id, label::DOUBLE AS label FROM embeddings UNION ALL SELECT 'columns of none', 2.0")
def typed_parquet(load):
    """Parquet of a given schema, kept where no row is written."""
    spark, root = place(load)
    rows = load("embeddings").select(F.col("vec_id").alias("id"), "label")
    sinks.write_typed(rows, f"{root}/some", "id string, label double")
    sinks.write_typed(rows.limit(0), f"{root}/none", "id string, label double")
    none = spark.read.parquet(f"{root}/none")
    told = spark.range(1).select(F.lit("columns of none").alias("id"), F.lit(float(len(none.columns))).alias("label"))
    return spark.read.parquet(f"{root}/some").unionByName(none).unionByName(told)


@query("SELECT s_suppkey, s_name AS name, s_name || ' of ' || s_nationkey AS description, cast(s_nationkey AS VARCHAR) AS nation FROM supplier")
def retriever_file(load):
    """Retriever rows written with all fields and read back."""
    spark, root = place(load)
    none = F.lit(None).cast("array<string>")
    rows = load("supplier").select(
        F.col("s_suppkey").cast("string").alias("custom_id"),
        F.lit("m").alias("markdown_content"),
        none.alias("seed_questions"),
        F.lit("s").alias("summary"),
        F.col("s_name").alias("name"),
        F.concat_ws(" of ", "s_name", F.col("s_nationkey").cast("string")).alias("description"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("metadata"),
    )
    sinks.write_retriever_rows(rows, root)
    from .. import schemas

    got = readers.jsonl(readers.lines(spark, root), schemas.SUMMARY_ROW)
    return got.select(
        F.col("custom_id").cast("long").alias("s_suppkey"),
        "name",
        "description",
        F.col("metadata")["nation"].alias("nation"),
    )


@query("SELECT shard, count(*)::BIGINT AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // ceil(count(*) OVER () / 4.0)::BIGINT AS shard FROM customer) GROUP BY shard")
def parquet_shards(load):
    """Equal Parquet shards, read back."""
    spark, root = place(load)
    sinks.write_shards(load("customer").select("c_custkey"), root, ["c_custkey"], 4)
    return spark.read.parquet(root).groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count("*").alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")
    )


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_partkey AS k FROM lineitem UNION ALL SELECT DISTINCT l_suppkey FROM lineitem))::BIGINT AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))::BIGINT AS n_edges")
def graph_export(load):
    """Nodes and edges of a graph, written and read back."""
    spark, root = place(load)
    lines = load("lineitem")
    nodes = lines.select(
        F.concat(F.lit("p"), "l_partkey").alias("node")
    ).union(lines.select(F.concat(F.lit("s"), "l_suppkey"))).distinct()
    sinks.write_graph(nodes, lines.select("l_partkey", "l_suppkey").distinct(), root)
    read = spark.read.parquet
    return read(f"{root}/nodes").agg(F.count("*").alias("n_nodes")).join(
        read(f"{root}/edges").agg(F.count("*").alias("n_edges"))
    )


@query("SELECT * FROM (VALUES ('there', 'first text'), ('moved', 'b.txt,b_1.txt,b_2.txt')) t(what, value)")
def text_artifacts(load):
    """Small text files: one written and one removed again; one moved beside others of its name."""
    spark, root = place(load)
    sinks.write_text(spark, f"{root}/kept.txt", "first text")
    sinks.write_text(spark, f"{root}/gone.txt", "x")
    sinks.write_text(spark, f"{root}/gone.txt", "")
    for name in ("done/b.txt", "done/b_1.txt", "b.txt"):
        sinks.write_text(spark, f"{root}/{name}", name)
    sinks.move_to_done(spark, [f"{root}/b.txt"], f"{root}/done")
    there = readers.listing(spark, root, "*.txt").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"))
    moved = readers.listing(spark, f"{root}/done").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"))
    kept = there.where("n = 'kept.txt'").select(
        F.lit("there").alias("what"), F.lit(readers.whole_text(spark, f"{root}/kept.txt")).alias("value")
    )
    return kept.unionByName(
        moved.agg(
            F.array_join(F.array_sort(F.collect_list("n")), ",").alias("value")
        ).select(F.lit("moved").alias("what"), "value"),
    )


@query("SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * d.embedding[i]::DOUBLE)), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0")
def score_cache(load):
    """Scores of all pairs, computed once for the same content."""
    spark, root = place(load)
    docs = load("embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = load("embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    compute = lambda: dense.scores(docs, asked)

    def never() -> DataFrame:
        raise AssertionError("computed twice")

    sinks.cached_scores(spark, root, [docs, asked], compute)
    return sinks.cached_scores(spark, root, [docs, asked], never)


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_filter(load):
    """C4: rows with all required metadata, and the others with what they lack."""
    entry = lambda c, ok: F.when(ok, F.col(c).cast("string")).otherwise(" ")
    meta = F.create_map(
        F.lit("quality"),
        F.coalesce(entry("quality", F.col("quality").isNotNull()), F.lit("")),
        F.lit("toxic"),
        F.coalesce(entry("toxic", F.col("toxic") == 0), F.lit("")),
    )
    rows = load("documents").join(load("labels"), "doc_id", "left").select("doc_id", meta.alias("m"))
    kept, dropped = batches.required_metadata(rows, "m", ["quality", "toxic"])
    return kept.select("doc_id", F.lit("kept").alias("state")).unionByName(
        dropped.select("doc_id", F.col("lacking").alias("state"))
    )


def requests(load) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inputs of all documents, outputs of all labels (invalid where the quality is 0), records of English documents."""
    key = F.col("doc_id").cast("string").alias("custom_id")
    text = F.concat(
        F.lit('{"summary": "s'),
        F.col("doc_id").cast("string"),
        F.lit('", "seed_questions": ['),
        F.when(F.col("quality") == 0, F.lit("1")).otherwise(F.lit('"q"')),
        F.lit("]}"),
    )
    usage = F.struct(F.col("toxic").cast("long").alias("total_tokens"))
    body = F.struct(
        F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"), usage.alias("usage")
    )
    chat = F.to_json(
        F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content"))).alias("messages"))
    )
    inputs = load("documents").select(key, chat.alias("body"), F.col("doc_id").alias("o"))
    outputs = load("labels").select(
        key,
        F.lit(None).cast("string").alias("error"),
        F.to_json(F.struct(F.lit(200).alias("status_code"), body.alias("body"))).alias("response"),
        F.col("doc_id").alias("o"),
    )
    meta = F.create_map(
        F.lit("name"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("n")).otherwise(F.lit(" ")),
        F.lit("description"),
        F.col("lang"),
    )
    records = load("documents").where("lang = 'en'").select(
        key,
        F.concat(F.lit("p"), "doc_id").alias("relative_path"),
        F.col("lang").alias("content"),
        meta.alias("metadata"),
        F.col("doc_id").alias("o"),
    )
    return inputs, outputs, records


SUMMARY = {"summary": "string", "seed_questions": "strings"}


@query("""SELECT d.doc_id, d.source AS asked, l.toxic::BIGINT AS total_tokens, CASE WHEN l.quality <> 0 THEN 's' || d.doc_id END AS summary, CASE WHEN lang = 'en' THEN 'p' || d.doc_id ELSE '' END AS relative_path,
CASE WHEN lang = 'en' THEN lang ELSE '' END AS content, CASE WHEN lang = 'en' THEN lang ELSE '' END AS description FROM documents d LEFT JOIN labels l USING (doc_id)""")
def batch_join(load):
    """Inputs with their outputs and records; usage of the last output, payload of the first valid one."""
    rows = batches.join_batches(*requests(load), "o", SUMMARY)
    return rows.select(
        F.col("custom_id").cast("long").alias("doc_id"),
        F.get("messages", 0)["content"].alias("asked"),
        F.col("usage")["total_tokens"].alias("total_tokens"),
        F.get_json_object("payload", "$.summary").alias("summary"),
        "relative_path",
        "content",
        F.col("metadata")["description"].alias("description"),
    )


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_output' WHEN l.quality = 0 THEN 'invalid_output' WHEN lang <> 'en' OR n_chars % 2 = 1 THEN 'missing_metadata' ELSE 'ok' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def retriever_states(load):
    """The state of each input, where rows without a name or a description count as lacking metadata."""
    return batches.retriever_rows(*requests(load), "o", SUMMARY, require_metadata=True).select(
        F.col("custom_id").cast("long").alias("doc_id"), "state"
    )


@query("SELECT l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def suffix_join(load):
    """Rows joined by the numbers at the ends of their ids."""
    a = load("labels").select(F.concat(F.lit("sm-"), "doc_id").alias("custom_id"))
    b = load("documents").select(
        F.concat(F.lit("summary-row-"), "doc_id").alias("custom_id"), "lang", F.col("doc_id").alias("o")
    )
    b = b.unionByName(b.select("custom_id", F.lit("stale").alias("lang"), (F.col("o") - 1_000_000).alias("o")))
    return batches.join_by_suffix(a, b, "o").select(tx.decode_id("sm", F.col("custom_id")).alias("doc_id"), "lang")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS rrf_score, coalesce(a.t, b.t) AS text FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, lang AS t FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, source AS t FROM documents WHERE doc_id % 2 = 0) b USING (doc_id)")
def merge_results(load):
    """Two ranked lists in full, texts of the first side before those of the second."""

    def side(condition: str, text: str) -> DataFrame:
        rows = load("documents").where(condition).select(
            F.lit(0).cast("long").alias("query_id"),
            "doc_id",
            (-F.col("doc_id")).alias("score"),
            F.col(text).alias("text"),
        )
        return fusion.rank_positions(rows).withColumn("rank", F.col("position") + 1)

    out = fusion.merge_with_texts(side("doc_id % 3 <> 0", "lang"), side("doc_id % 2 = 0", "source"), ["text"], 1 << 40)
    return out.select("doc_id", "rrf_score", "text")


@query("""SELECT '{"summary":{"exact":{"hit_at_1":' || h || ',"n":' || n || '}}}' AS json FROM (SELECT count(*)::DOUBLE AS n, avg(quality)::DECIMAL(9, 1)::DOUBLE * 0 + 1.0 AS h FROM labels)""")
def metrics_nested(load):
    """Metrics as nested objects."""
    rows = load("labels").agg(F.lit(1.0).alias("hit_at_1"), F.count("*").cast("double").alias("n"))
    return metrics.nested(metrics.flatten(rows, "summary", "exact"))


@query("SELECT doc_id, text IS NULL AS missing, md5(coalesce(text, '')) AS digest FROM documents")
def scrubbed(load):
    """Invalid bytes become U+FFFD, valid texts stay."""
    dirty = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("EDA080"))).cast("string")
    clean = F.regexp_replace(tx.scrub(dirty), "\uFFFD+$", "")
    return load("documents").select(
        "doc_id",
        F.col("text").isNull().alias("missing"),
        F.md5(F.coalesce(clean, F.lit("")).cast("binary")).alias("digest"),
    )


@query("SELECT * FROM (VALUES ('Yes', true), ('off', false), ('', false), ('maybe', false), ('1', true)) t(word, flag)")
def flags(load):
    """G16."""
    words = ["Yes", "off", "", "maybe", "1"]
    return session(load).createDataFrame(
        [(w, tx.parse_bool(w, strict=False)) for w in words], "word string, flag boolean"
    )


@query("SELECT doc_id, 'sm-' || doc_id AS custom_id, 'POST' AS method, lang AS model, source AS asked, 50::BIGINT AS max_tokens, n_words::BIGINT AS n_tokens FROM (SELECT *, len(regexp_extract_all(lower(source || ' ' || lang), '[\\p{L}\\p{N}_]+')) AS n_words FROM documents)")
def request_lines(load):
    """Request lines, well-formed, and the words of their messages."""
    line = payload.request_line(
        tx.encode_id("sm", F.col("doc_id")), F.col("lang"), F.col("lang"), F.col("source"), F.lit(50)
    )
    rows = load("documents").select("doc_id", line.alias("line")).select(
        "doc_id", F.from_json("line", "custom_id string, method string, url string, body string").alias("r")
    ).select("doc_id", "r.*")
    fine = batches.shape_faults(rows).where("fault is null")
    told = F.get_json_object("body", "$.max_tokens").cast("long")
    return fine.select(
        "doc_id",
        "custom_id",
        "method",
        F.get_json_object("body", "$.model").alias("model"),
        payload.first_user_text(F.col("body")).alias("asked"),
        told.alias("max_tokens"),
        payload.message_tokens(F.col("body")).cast("long").alias("n_tokens"),
    )


@query("SELECT event_id, 'method' AS fault FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 1")
def first_fault(load):
    """The first request of a file that breaks a rule."""
    method = F.when(F.col("event_type") == "click", "GET").otherwise("POST")
    rows = load("events").select(
        "event_id",
        F.lit("id").alias("custom_id"),
        method.alias("method"),
        F.lit("/v1").alias("url"),
        F.lit("{}").alias("body"),
    )
    return batches.first_fault(rows, F.col("event_id")).select("event_id", "fault")


@query("""SELECT page_id, 'p' || page_id AS stem, '.tar.gz' AS two, '.gz' AS suffix, 'd/p' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '_' || page_id % 3 END || '.x' AS shard,
2::BIGINT AS n_paths, page_id % 2 = 0 AS inside FROM pages""")
def path_helpers(load):
    """Stems, suffixes and names of shards, lists of paths, and paths that stay inside their root."""
    p = F.concat(F.lit("d/p"), "page_id")
    listed = F.when(F.col("page_id") % 2 == 0, F.lit('["a", " ", "b/c"]')).otherwise(F.lit("a, ,b/c"))
    steps = F.when(F.col("page_id") % 2 == 0, F.lit("a/./../b")).otherwise(F.lit("a/../../a/b"))
    two = F.concat(tx.suffix(tx.stem(F.lit("x/a.b.tar.gz"))), tx.suffix(F.lit("x/a.b.tar.gz")))
    return load("pages").select(
        "page_id",
        tx.stem(F.concat(p, F.lit(".md"))).alias("stem"),
        two.alias("two"),
        tx.suffix(F.lit("x/a.b.tar.gz")).alias("suffix"),
        tx.shard_path(F.concat(p, F.lit(".x")), F.col("page_id") % 3).alias("shard"),
        F.size(tx.path_list(listed)).cast("long").alias("n_paths"),
        tx.stays_inside(steps).alias("inside"),
    )


@query("SELECT n_nationkey, n_name AS source_name, cast(n_regionkey AS VARCHAR) AS region, '{\"name\":\"' || n_name || '\"}' AS json FROM nation")
def base_metadata(load):
    """Metadata of a record under its own names, with a copy as JSON."""
    m = tx.base_metadata(F.create_map(F.lit("name"), F.col("n_name")), region=F.col("n_regionkey"))
    rows = load("nation").select("n_nationkey", m.alias("m"))
    return rows.select(
        "n_nationkey",
        F.col("m")["source_name"].alias("source_name"),
        F.col("m")["region"].alias("region"),
        F.col("m")["source_metadata_json"].alias("json"),
    )


@query("SELECT n_nationkey, 'Sum up.' || chr(10) || '<<' || chr(10) || n_name || chr(10) || '>>' AS document, n_name || ': of ' || n_regionkey || chr(10) || '  1. a' || n_nationkey || chr(10) || '  2. b' AS question FROM nation")
def prompts(load):
    """Prompts for a document and for the questions of a row."""
    document = tx.document_prompt(F.lit("Sum up."), F.col("n_name"), ("<<", ">>"))
    items = F.array(F.concat(F.lit("a"), "n_nationkey"), F.lit("b"))
    question = tx.question_prompt(
        "{{name}}: {{ description }}\n{{questions}}", F.col("n_name"), F.concat(F.lit("of "), "n_regionkey"), items
    )
    return load("nation").select("n_nationkey", document.alias("document"), question.alias("question"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'c' || n_regionkey END AS text FROM nation")
def field_selector(load):
    """The text of a field named in any case; other names are errors."""
    rows = load("nation").select(
        "n_nationkey", F.col("n_name").alias("summary"), F.concat(F.lit("c"), "n_regionkey").alias("description")
    )
    pick = lambda name, even: rows.where((F.col("n_nationkey") % 2 == 0) == F.lit(even)).select(
        "n_nationkey", F.col(tx.choose_field(name)).alias("text")
    )
    return pick("Summary ", True).unionByName(pick("description", False))


@query("SELECT conv_id, list_extract(q, ('0x' || left(md5('12-' || conv_id), 8))::BIGINT % len(q) + 1) AS picked FROM (SELECT conv_id, list(text ORDER BY turn) AS q FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)")
def pick_one(load):
    """One question of each row in an epoch."""
    return questions(load).select(
        "conv_id", mining.pick_one(F.col("questions"), F.col("conv_id"), 11, 1).alias("picked")
    )


@query("SELECT total, per::INTEGER AS per, greatest(1, ceil(total / (per * 2.0)))::INTEGER AS accumulation FROM (VALUES (64, 8), (64, 5), (4, 8), (100, 50)) t(total, per)")
def batch_sizes(load):
    """K15."""
    rows = [(total, *mining.batch_size(total, per, 2)) for total, per in ((64, 8), (64, 5), (4, 8), (100, 50))]
    return session(load).createDataFrame(rows, "total int, per int, accumulation int")


@query("SELECT item_id AS query_id, r::INTEGER AS rank, item_id || '-' || r AS name FROM benchmark, (VALUES (1), (2), (3)) t(r)")
def callback(load):
    """The names that a caller's function retrieves for each query."""
    pairs = load("benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("query"))
    return metrics.from_callback(pairs, lambda q, k: [f"{q}-{i + 1}" for i in range(k)], [1, 3])


@query("SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c_acctbal > 5000 THEN 'class' ELSE 'method' END AS kind FROM customer WHERE c_acctbal > 0) WHERE kind = 'class' GROUP BY kind")
def nodes_of_kind(load):
    """C16."""
    nodes = load("customer").where("c_acctbal > 0").select(
        F.when(F.col("c_acctbal") > 5000, "class").otherwise("method").alias("kind")
    )
    return graph.of_kind(nodes, "class").groupBy("kind").agg(F.count("*").alias("n"))
