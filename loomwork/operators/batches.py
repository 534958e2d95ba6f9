"""Joins and planners over batches of requests, responses and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload
from ..functions import text as tx
from . import dedupe


def shape_faults(requests: DataFrame) -> DataFrame:
    """requests (custom_id, method, url, body as JSON) with `fault`: the first rule that a row breaks, or null."""
    rules = [
        ("custom_id", tx.is_blank(F.col("custom_id"))),
        ("method", ~F.col("method").eqNullSafe("POST")),
        ("url", tx.is_blank(F.col("url"))),
        ("body", ~F.coalesce(payload.is_object(F.col("body")), F.lit(False))),
    ]
    return requests.withColumn("fault", F.coalesce(*(F.when(bad, name) for name, bad in rules)))


def first_fault(requests: DataFrame, order: Column) -> DataFrame:
    """The first row that breaks a rule, as one row; empty if all are well-formed."""
    return shape_faults(requests).where("fault is not null").orderBy(order).limit(1)


def endpoints(requests: DataFrame, file: str = "file") -> DataFrame:
    """Distinct request paths of each file, and whether there is exactly one."""
    return requests.groupBy(file).agg(
        F.count_distinct(tx.url_path(F.col("url"))).alias("n_urls")
    ).withColumn("single", F.col("n_urls") == 1)


def split_outcomes(rows: DataFrame, error: Column, response: Column) -> tuple[DataFrame, DataFrame]:
    """Successes (no error and a response) and the others."""
    good = error.isNull() & response.isNotNull()
    return rows.where(good), rows.where(~good)


def join_batches(inputs: DataFrame, outputs: DataFrame, records: DataFrame, order: str, keys: dict) -> DataFrame:
    """Inputs with their outputs and records, by custom_id.

    Inputs and records: the last row of an id. Usage comes from the last output row, the payload from the first valid
    one. Inputs without an output or a record stay; a missing record has empty texts and metadata.
    inputs (custom_id, body), outputs (custom_id, error, response), records (custom_id, relative_path, content,
    metadata), each with the ordinal `order`.
    """
    o = F.col(order)
    left = dedupe.last_by(inputs, "custom_id", o).select("custom_id", payload.messages(F.col("body")).alias("messages"))
    text = payload.content(F.col("error"), F.col("response"))
    out = outputs.where(dedupe.has_id("custom_id")).withColumn("payload", F.when(payload.is_valid(text, keys), text))
    out = out.groupBy("custom_id").agg(
        F.max_by(payload.usage(F.col("response")), o).alias("usage"),
        F.min_by("payload", F.when(F.col("payload").isNotNull(), o)).alias("payload"),
    )
    own = dedupe.last_by(records, "custom_id", o).select("custom_id", "relative_path", "content", "metadata")
    bare = F.create_map(F.lit("name"), F.lit(""), F.lit("description"), F.lit(""))
    return left.join(out, "custom_id", "left").join(own, "custom_id", "left").select(
        "custom_id",
        "messages",
        "usage",
        "payload",
        F.coalesce("relative_path", F.lit("")).alias("relative_path"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("metadata", bare).alias("metadata"),
    )


# fixed values: the marks around a document in a request
MARKS = ("----- SKILL.md markdown -----", "----- end -----")


def retriever_rows(
    inputs: DataFrame, outputs: DataFrame, records: DataFrame, order: str, keys: dict, require_metadata: bool = False
) -> DataFrame:
    """Inputs with the state of each: `ok`, `missing_output`, `invalid_output` or, if asked for, `missing_metadata`.

    One pass serves the retriever rows (ok), the counters (states) and the redo plan (the rest).
    """
    o = F.col(order)
    left = dedupe.last_by(inputs, "custom_id", o)
    text = payload.content(F.col("error"), F.col("response"))
    good = payload.is_valid(text, keys)
    out = outputs.where(dedupe.has_id("custom_id")).withColumn("payload", F.when(good, text)).groupBy("custom_id").agg(
        F.count("*").alias("n_outputs"), F.min_by("payload", F.when(F.col("payload").isNotNull(), o)).alias("payload")
    )
    own = dedupe.last_by(records, "custom_id", o).select("custom_id", "metadata")
    joined = left.join(out, "custom_id", "left").join(own, "custom_id", "left")
    lacking = F.coalesce(
        tx.is_blank(F.try_element_at("metadata", F.lit("name"))) | tx.is_blank(
            F.try_element_at("metadata", F.lit("description"))
        ),
        F.lit(True),
    )
    state = F.when(F.col("n_outputs").isNull(), "missing_output").when(F.col("payload").isNull(), "invalid_output")
    state = state.when(lacking, "missing_metadata") if require_metadata else state
    return joined.withColumn(
        "missing_record", F.col("metadata").isNull()
    ).withColumn("state", state.otherwise("ok")).withColumn("markdown_content", tx.between_marks(payload.first_user_text(F.col("body")), *MARKS))


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.count_if("missing_record").alias("missing_records"))


def redo(inputs: DataFrame, attempts: DataFrame, key: str, valid: Column) -> DataFrame:
    """Inputs without a valid attempt, with `reason`: `missing` (no attempt at all) or `invalid`."""
    seen = attempts.groupBy(key).agg(F.max(valid.cast("int")).alias("ok__"))
    return inputs.join(seen, key, "left").where(F.coalesce("ok__", F.lit(0)) == 0).withColumn(
        "reason", F.when(F.col("ok__").isNull(), "missing").otherwise("invalid")
    ).drop("ok__")


def retry(inputs: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Inputs whose id failed."""
    return inputs.join(failed.select(key), key, "left_semi")


def orphans(failed: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Failed ids that no input has."""
    return failed.select(key).distinct().join(inputs, key, "left_anti")


def merge_retry(
    old_outputs: DataFrame, old_errors: DataFrame, retried: DataFrame, key: str, good: Column, order: Column
) -> tuple[DataFrame, DataFrame]:
    """Outputs: the old ones and all new successes. Errors: the old ones whose id wasn't retried, and of each id that
    still fails the last failure."""
    outputs = old_outputs.unionByName(retried.where(good).select(*old_outputs.columns))
    won = retried.where(good).select(key).distinct()
    still = dedupe.last_by(retried.where(~good), key, order).join(won, key, "left_anti")
    errors = old_errors.join(
        retried.select(key).distinct(), key, "left_anti"
    ).unionByName(still.select(*old_errors.columns))
    return outputs, errors


def join_by_suffix(rows: DataFrame, others: DataFrame, order: str, key: str = "custom_id") -> DataFrame:
    """rows with the columns of the others whose id ends in the same number, the last of several; an id without a partner
    is an error when the row is read."""
    number = lambda: F.regexp_extract(key, r"(\d+)$", 1)
    own = dedupe.last_by(others.withColumn("suffix__", number()), "suffix__", F.col(order)).drop(order, key)
    joined = rows.withColumn("suffix__", number()).join(own.withColumn("there__", F.lit(True)), "suffix__", "left")
    told = F.raise_error(F.concat(F.lit("no partner for "), F.col(key))).cast("string")
    return joined.withColumn(
        key, F.when(F.col("there__").isNull(), told).otherwise(F.col(key))
    ).drop("suffix__", "there__")


def required_metadata(rows: DataFrame, metadata: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose metadata has something under all of these keys, and the others with `lacking`, the first that is blank."""
    lacking = F.coalesce(*(F.when(tx.is_blank(F.try_element_at(metadata, F.lit(k))), k) for k in keys))
    marked = rows.withColumn("lacking", lacking)
    return marked.where("lacking is null").drop("lacking"), marked.where("lacking is not null")


def source_tally(rows: DataFrame, key: str, first: Column, names: tuple[str, str]) -> DataFrame:
    """Rows of each key from two sources, and which gave more; the second on a tie."""
    a, b = names
    sums = rows.groupBy(key).agg(F.count_if(first).alias(f"from_{a}"), F.count_if(~first).alias(f"from_{b}"))
    return sums.withColumn("winner", F.when(F.col(f"from_{a}") > F.col(f"from_{b}"), a).otherwise(b))


def scenario_rows(summaries: DataFrame, scenarios: DataFrame, order: str, valid: Column) -> DataFrame:
    """Rows of ids that both sides have: of the summaries the first row, of the scenarios the last valid one."""
    left = dedupe.first_by(summaries, "custom_id", F.col(order)).drop(order)
    return left.join(dedupe.last_valid(scenarios, "custom_id", F.col(order), valid).drop(order), "custom_id")


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids in both, only in a, only in b."""
    both = a.select(key).distinct().withColumn("a__", F.lit(1)).join(
        b.select(key).distinct().withColumn("b__", F.lit(1)), key, "full"
    )
    return both.agg(
        F.count_if(F.col("a__").isNotNull() & F.col("b__").isNotNull()).alias("in_both"),
        F.count_if(F.col("b__").isNull()).alias("only_left"),
        F.count_if(F.col("a__").isNull()).alias("only_right"),
    )


def remaining(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't done yet."""
    return every.join(done.select(key), key, "left_anti")


def closest_candidates(rows: DataFrame, key: str, text: str, pools: list[str]) -> DataFrame:
    """For each row the pool entry of the smallest edit distance: (key, pool, place, match, distance).

    pools are array columns of the row itself, so nothing is joined. Ties: the earlier pool, then the earlier place.
    """
    def measured(pool: str, number: int) -> Column:
        return F.transform(
            F.coalesce(pool, F.array().cast("array<string>")),
            lambda x, i: F.struct(
                tx.edit_distance(F.col(text), x).alias("distance"),
                F.lit(number).alias("pool"),
                i.alias("place"),
                x.alias("match"),
            ),
        )

    entries = F.flatten(F.array(*(measured(p, n) for n, p in enumerate(pools))))
    best = F.array_min(entries)
    return rows.select(key, best.alias("b")).select(
        key,
        F.col("b.pool").alias("pool"),
        F.col("b.place").alias("place"),
        F.col("b.match").alias("match"),
        F.col("b.distance").alias("distance"),
    )
