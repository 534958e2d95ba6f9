"""Requests and responses of batch jobs: strict payloads, messages, usage. JVM-side JSON and VARIANT functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Keys and types of the structs in arrays that a payload may declare.
ITEMS = {"scenarios": ["question", "scenario"]}


def is_object(json: Column) -> Column:
    return F.json_object_keys(json).isNotNull() & F.try_parse_json(json).isNotNull()


def _kind(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def _all_of(items: Column, schema: str) -> Column:
    return F.forall(items, lambda v: F.schema_of_variant(v) == schema)


def is_valid(json: Column, keys: dict) -> Column:
    """Whether the text is a JSON object with exactly these keys, each of its type and, where declared, its length.

    A repeated key counts once; the VARIANT parser rejects it, so such a text is invalid. Numbers are not strings.
    """
    ok = is_object(json) & (
        F.array_sort(F.array_distinct(F.json_object_keys(json))) == F.array(*map(F.lit, sorted(keys)))
    )
    for key, want in keys.items():
        kind, length = want if isinstance(want, tuple) else (want, None)
        path = f"$.{key}"
        if kind == "string":
            ok &= _kind(json, path) == "STRING"
            continue
        items = F.try_variant_get(F.try_parse_json(json), path, "array<variant>")
        shape = F.coalesce(
            _all_of(
                items, "STRING" if kind == "strings" else f"OBJECT<{', '.join(f'{n}: STRING' for n in ITEMS[kind])}>"
            ),
            F.lit(False),
        )
        ok &= shape & (F.size(items) == length if length is not None else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def content(error: Column, response: Column) -> Column:
    """The assistant's text of a response row: no error, status 200, a first choice whose content is a non-blank string.

    error: null when there was none. response: JSON. Null where the row holds no such text.
    """
    text = F.get_json_object(response, "$.body.choices[0].message.content")
    kind = _kind(response, "$.body.choices[0].message.content") == "STRING"
    fine = error.isNull() & (
        F.get_json_object(response, "$.status_code") == "200"
    ) & (_kind(response, "$.status_code") != "STRING") & kind & ~tx.is_blank(text)
    return F.when(fine, text)


def usage(response: Column) -> Column:
    """Token counts of a response: a struct, 0 for counts that are absent; null if any level above is missing."""
    at = "$.body.usage"
    count = lambda k: F.coalesce(F.get_json_object(response, f"{at}.{k}").try_cast("bigint"), F.lit(0))
    there = F.coalesce(_kind(response, at).startswith("OBJECT"), F.lit(False))
    return F.when(there, F.struct(*(count(k).alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens"))))


def messages(body: Column) -> Column:
    """The message objects of a request body (JSON), as role and content; others than objects are left out."""
    items = F.try_variant_get(F.try_parse_json(body), "$.messages", "array<variant>")
    objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce(
        F.transform(
            objects,
            lambda v: F.struct(
                F.try_variant_get(v, "$.role", "string").alias("role"),
                F.when(
                    F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING",
                    F.try_variant_get(v, "$.content", "string"),
                ).alias("content"),
            ),
        ),
        F.array().cast("array<struct<role: string, content: string>>"),
    )


def first_user_text(body: Column) -> Column:
    """The content of the first user message that is a string; empty if there is none."""
    said = F.filter(messages(body), lambda m: (m["role"] == "user") & m["content"].isNotNull())
    return F.coalesce(F.get(said, 0)["content"], F.lit(""))


def request_line(
    custom_id: Column,
    model: Column,
    system: Column,
    user: Column,
    max_tokens: Column | None = None,
    response_format: Column | None = None,
    url: str = "/v1/chat/completions",
) -> Column:
    """A request as JSON text; max_tokens and response_format (JSON text) appear only where they are given."""
    chat = F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    fields = [model.alias("model"), chat.alias("messages")]
    if max_tokens is not None:
        fields.append(max_tokens.alias("max_tokens"))
    if response_format is not None:
        fields.append(F.try_parse_json(response_format).alias("response_format"))
    return F.to_json(
        F.struct(
            custom_id.alias("custom_id"),
            F.lit("POST").alias("method"),
            F.lit(url).alias("url"),
            F.struct(*fields).alias("body"),
        ),
    )


def message_tokens(body: Column) -> Column:
    """Words of all messages, the default measure of a request's size; 0 for a malformed body."""
    return F.aggregate(
        messages(body), F.lit(0), lambda n, m: n + F.size(tx.words(m["content"], remove_stopwords=False))
    )


def metadata_map(json: Column) -> Column:
    """A JSON object as map<string,string>: null is empty, nested values stay JSON, name and description always exist."""
    raw = F.coalesce(
        F.from_json(F.when(is_object(json), json), "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    full = F.transform_values(raw, lambda _, v: F.coalesce(v, F.lit("")))
    missing = lambda m, k: F.when(F.map_contains_key(m, k), m).otherwise(
        F.map_concat(m, F.create_map(F.lit(k), F.lit("")))
    )
    return missing(missing(full, "name"), "description")
