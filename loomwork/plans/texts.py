"""Queries on text functions, ingestion rules and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frontmatter, payload
from ..functions import text as tx
from ..sources import readers
from .registry import Registry

QUERIES = query = Registry()
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
KEPT = f"list_filter({WORDS}, lambda x: x NOT IN ({STOP}))"
FOLD = "replace(lower({}), 'ß', 'ss')"
SPACES = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"


@query(
    f"SELECT doc_id, len(t)::BIGINT AS n_tokens, list_aggregate(t, 'string_agg', ' ') AS tokens FROM (SELECT doc_id, {KEPT} AS t FROM documents)",
)
def tokenize_words(load):
    """words without stop words."""
    t = tx.words(F.col("text"))
    return load("documents").select("doc_id", t.alias("t")).select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.when(F.size("t") > 0, F.array_join("t", " ")).alias("tokens"),
    )


@query(
    f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS digest FROM (SELECT doc_id, {SPACES.format(FOLD.format('text'))} AS t FROM documents)",
)
def tokenize_whitespace(load):
    """caseless runs between white space."""
    return load("documents").select("doc_id", tx.whitespace_tokens(F.col("text")).alias("t")).select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("digest"),
    )


@query(
    f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS digest FROM (SELECT doc_id, {SPACES.format('lower(text)')} AS t FROM documents)",
)
def tokenize_lower(load):
    """lower-cased runs between white space."""
    return load("documents").select("doc_id", tx.whitespace_tokens(F.col("text"), False).alias("t")).select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("digest"),
    )


@query(f"SELECT doc_id, (len({WORDS}) - len({KEPT}))::BIGINT AS n_stopwords FROM documents")
def stopword_filter(load):
    """how many words the stop list takes away."""
    return load("documents").select(
        "doc_id",
        (F.size(tx.words(F.col("text"), False)) - F.size(tx.words(F.col("text")))).cast("long").alias("n_stopwords"),
    )


@query(
    "SELECT doc_id, regexp_matches(text, '[" + "".join(
        f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in tx.SCRIPTS
    ) + "]') AS other_script FROM documents",
)
def script_filter(load):
    """Texts with characters of other scripts."""
    return load("documents").select("doc_id", tx.has_other_script(F.col("text")).alias("other_script"))


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS n_tokens FROM documents WHERE len({WORDS}) BETWEEN 1 AND 2000")
def token_length_filter(load):
    """Neither empty nor too long, by words."""
    n = F.size(tx.words(F.col("text"), False))
    return load("documents").where(tx.token_count_ok(n, 2000)).select("doc_id", n.cast("long").alias("n_tokens"))


@query(r"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)")
def url_normalize(load):
    """Paths of page URLs."""
    return load("pages").select("page_id", tx.url_path(F.col("url")).alias("path"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>\s*(.*?)\s*</title>', 1) AS title FROM pages WHERE regexp_matches(html, '(?s)<title>\s*(.*?)\s*</title>')""")
def delimited_block(load):
    """What stands between two marks."""
    found = tx.between_marks(F.col("html"), "<title>", "</title>")
    return load("pages").where(
        F.col("html").rlike(r"(?s)<title>\s*(.*?)\s*</title>")
    ).select("page_id", found.alias("title"))


@query(r"""SELECT conv_id, turn, CASE WHEN starts_with(t, '|') THEN ltrim(ltrim(substr(t, 2), chr(10)), ' ' || chr(9)) ELSE t END AS normal FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations)""")
def normalize_text(load):
    """Quotes around the text (put on here as JSON) come off again, so does a leading pipe."""
    quoted = F.substring(F.to_json(F.struct(F.col("text").alias("t"))), 6, 1_000_000_000)
    return load("conversations").where("text is not null").select(
        "conv_id", "turn", tx.normalize_field(F.regexp_replace(quoted, r"\}$", "")).alias("normal")
    )


@query("SELECT conv_id, count(*)::BIGINT AS n_questions, md5(string_agg(text, chr(1) ORDER BY turn)) AS digest FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id")
def coerce_list(load):
    """Questions as a JSON list in a text."""
    rows = load("conversations").where(~tx.is_blank(F.col("text"))).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r")
    )
    json = F.to_json(F.transform("r", lambda r: r["text"]))
    items = tx.non_blank_items(tx.string_list(json))
    return rows.select(
        "conv_id",
        F.size(items).cast("long").alias("n_questions"),
        F.md5(F.array_join(items, "\x01").cast("binary")).alias("digest"),
    )


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def read_jsonl_objects(load):
    """A1, A3: JSON lines to typed rows, others than objects left out."""
    lines = load("events").select(
        F.lit("props").alias("file"), F.col("event_id").alias("line"), F.col("props").alias("value")
    )
    return readers.jsonl(lines, "k bigint", "objects").where("k is not null").select(
        F.col("line").alias("event_id"), "k"
    )


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false WHEN event_id % 5 = 0 THEN false ELSE true END AS valid FROM events")
def strict_payload(load):
    """Exactly the declared keys, each of its type; here a third key or a number for a text makes a payload invalid."""
    text = F.concat(F.lit("v"), "event_id")
    extra = F.when(F.col("event_id") % 3 == 0, F.lit("x"))
    number = F.when(F.col("event_id") % 5 == 0, F.lit(True))
    json = F.concat(
        F.lit('{"summary": '),
        F.when(number, F.lit("7")).otherwise(F.concat(F.lit('"'), text, F.lit('"'))),
        F.lit(', "seed_questions": ["a", "b"]'),
        F.when(extra.isNotNull(), F.lit(', "x": 1')).otherwise(""),
        F.lit("}"),
    )
    return load("events").select(
        "event_id", payload.is_valid(json, {"summary": "string", "seed_questions": "strings"}).alias("valid")
    )


@query("SELECT user_id, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total_tokens, sum(1)::BIGINT AS n FROM events GROUP BY user_id")
def json_usage(load):
    """Token counts out of response bodies, summed."""
    response = F.concat(
        F.lit('{"status_code": 200, "body": {"usage": {"total_tokens": '),
        F.get_json_object("props", "$.k"),
        F.lit("}}}"),
    )
    u = payload.usage(response)
    return load("events").groupBy("user_id").agg(
        F.sum(u["total_tokens"]).alias("total_tokens"), F.sum(u["prompt_tokens"] + 1).alias("n")
    )


@query("SELECT conv_id, turn, text AS content FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND role <> 'user'")
def response_content(load):
    """The assistant's text of a response row; an error or a blank text gives none."""
    message = F.to_json(
        F.struct(
            F.lit(200).alias("status_code"),
            F.struct(
                F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")
            ).alias("body"),
        ),
    )
    error = F.when(F.col("role") == "user", "failed")
    return load("conversations").select(
        "conv_id", "turn", payload.content(error, message).alias("content")
    ).where("content is not null")


@query("SELECT conv_id, coalesce(min_by(text, turn) FILTER (WHERE role = 'user'), '') AS first_user FROM conversations GROUP BY conv_id")
def first_user_message(load):
    """The first user message of a request body."""
    chat = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
    )
    body = load("conversations").groupBy("conv_id").agg(chat.alias("messages")).select(
        "conv_id", F.to_json(F.struct("messages")).alias("body")
    )
    return body.select("conv_id", payload.first_user_text(F.col("body")).alias("first_user"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def sanitize_name(load):
    """G14."""
    return load("part").select("p_partkey", tx.sanitize_name(F.concat_ws(" ", "p_name", "p_brand")).alias("name"))


@query("SELECT p_partkey, 'sm-' || p_partkey AS custom_id, p_partkey AS decoded FROM part")
def id_roundtrip(load):
    """G15."""
    return load("part").select("p_partkey", tx.encode_id("sm", F.col("p_partkey")).alias("custom_id")).select(
        "p_partkey", "custom_id", tx.decode_id("sm", F.col("custom_id")).alias("decoded")
    )


@query("SELECT p_partkey, left(sha256(p_name), 24) AS fragment FROM part")
def sha_fragment(load):
    """G20."""
    return load("part").select("p_partkey", tx.sha_fragment(F.col("p_name")).alias("fragment"))


@query("SELECT p_partkey, 'Part ' || p_name || ' by ' || p_brand || '.' AS prompt FROM part")
def render_template(load):
    """Unknown names vanish."""
    return load("part").select(
        "p_partkey",
        tx.render(
            "Part {{ name }} by {{brand}}{{ nothing }}.", {"name": F.col("p_name"), "brand": F.col("p_brand")}
        ).alias("prompt"),
    )


@query("SELECT conv_id, string_agg('  ' || i || '. ' || text, chr(10) ORDER BY i) AS listed FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def numbered_list(load):
    """G11."""
    rows = load("conversations").where("text is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r")
    )
    return rows.select("conv_id", tx.numbered_list(F.transform("r", lambda r: r["text"])).alias("listed"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short FROM conversations")
def shorten_text(load):
    """H8."""
    return load("conversations").select("conv_id", "turn", tx.shorten(F.col("text")).alias("short"))


@query("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' WHEN d.lang <> '' THEN d.lang ELSE d.source END AS chosen FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def fallback_text(load):
    """The first candidate that isn't blank."""
    j = load("documents").join(load("labels"), "doc_id", "left")
    return j.select(
        "doc_id",
        tx.first_non_blank(F.when(F.col("quality") == 1, " good "), F.col("lang"), F.col("source")).alias("chosen"),
    )


@query(
    "SELECT item_id, 'Find it:' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS query FROM benchmark"
)
def instruction_prefix(load):
    """C11."""
    return load("benchmark").select("item_id", tx.with_instruction(F.lit("Find it:"), F.col("text")).alias("query"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL)::BIGINT AS lacking FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def required_metadata(load):
    """C4: rows without a required field, counted."""
    j = load("documents").join(load("labels"), "doc_id", "left")
    return j.agg(
        F.count("*").alias("n"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("lacking")
    )


@query("SELECT p_partkey, levenshtein(lower(p_name), lower(p_type))::INTEGER AS distance FROM part")
def edit_distance(load):
    """G12 (ASCII names, since DuckDB counts bytes)."""
    return load("part").select("p_partkey", tx.edit_distance(F.col("p_name"), F.col("p_type")).alias("distance"))


@query("SELECT doc_id, coalesce(cast(l.quality AS VARCHAR), '') AS quality, lang, '' AS absent FROM documents d LEFT JOIN labels l USING (doc_id)")
def lenient_points(load):
    """Columns as text, null as empty, absent columns added."""
    j = load("documents").join(load("labels"), "doc_id", "left")
    return readers.data_points(
        j, ["doc_id", "quality", "lang", "absent"], lenient=True
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def strict_scan(load):
    """Required columns, no null cell."""
    return readers.no_nulls(readers.require_columns(load("documents"), ["doc_id", "text"]), ["doc_id", "text"])


@query("SELECT conv_id, turn, coalesce(nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), ''), 'row-' || (row_number() OVER (ORDER BY conv_id, turn) - 1)) AS name FROM conversations")
def default_row_names(load):
    """Row-<i> where a name is blank."""
    return readers.default_names(
        load("conversations").select("conv_id", "turn", F.col("text").alias("name")), "name", ["conv_id", "turn"]
    )


@query(
    "SELECT coalesce(max(cast(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT)), 0)::BIGINT AS last_index FROM supplier"
)
def last_index(load):
    """The largest number of names of a pattern."""
    names = load("supplier").select(F.regexp_replace("s_name", r"^.*?(\d+)$", "batch_$1").alias("n"))
    return readers.last_index(names, "n", "batch")


@query("SELECT f.f AS lang, count(d.doc_id)::BIGINT AS n FROM (VALUES ('en'), ('de'), ('xx')) f(f) LEFT JOIN documents d ON d.lang = f.f GROUP BY f.f")
def counts_by_field(load):
    """Counts of given fields, 0 where there is nothing."""
    return readers.counts_by_field(load("documents"), "lang", ["en", "de", "xx"])


@query("SELECT doc_id, '---' AS fence, lang AS name, source AS description, text AS body FROM documents")
def frontmatter(load):  # noqa: F811
    """G1: metadata and body of documents with front matter put before their text."""
    from ..functions import frontmatter as fm

    raw = F.concat(F.lit("---\nname: "), "lang", F.lit("\ndescription: "), "source", F.lit("\n---\n"), "text")
    docs = load("documents").select("doc_id", fm.parse(raw).alias("p"))
    return docs.select(
        "doc_id",
        F.lit("---").alias("fence"),
        F.col("p.metadata")["name"].alias("name"),
        F.col("p.metadata")["description"].alias("description"),
        F.col("p.body").alias("body"),
    )
