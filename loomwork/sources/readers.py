"""Readers. Every JSONL reader attaches (file, line), the order on which first and last rules rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import frontmatter, payload
from ..functions import text as tx

LINES = "file string, line bigint, value string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lines(
    spark: SparkSession,
    paths: str | list[str],
    glob: str | None = None,
    recursive: bool = False,
    missing_ok: bool = False,
    whole: bool = True,
) -> DataFrame:
    """Non-blank lines as (file, line, value), lines counted from 1 in each file.

    Files are read whole, one task or more each, which numbers their lines without a shuffle. With whole=False the
    text is split like any other and `line` is null, for files too large for a task's memory.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], LINES)
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    file = F.col("_metadata.file_path")
    if not whole:
        return reader.text(paths).select(
            file.alias("file"), F.lit(None).cast("bigint").alias("line"), "value"
        ).where(~tx.is_blank(F.col("value")))
    text = reader.text(paths, wholetext=True).select(
        file.alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")
    )
    return text.select(
        "file", (F.col("at") + 1).cast("bigint").alias("line"), "value"
    ).where(~tx.is_blank(F.col("value")))


def jsonl(rows: DataFrame, schema: str, mode: str = "strict") -> DataFrame:
    """Parse (file, line, value) rows. strict: a line that isn't JSON is an error naming file and line. objects: others
    than JSON objects are dropped."""
    value = F.col("value")
    if mode == "objects":
        return rows.where(payload.is_object(value)).select(
            "file", "line", F.from_json(value, schema).alias("j")
        ).select("file", "line", "j.*")
    told = F.concat(F.lit("not JSON: "), "file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")))
    checked = F.when(
        ~tx.is_blank(value) & F.try_parse_json(value).isNull(), F.raise_error(told).cast("string")
    ).otherwise(value)
    return rows.select("file", "line", F.from_json(checked, schema).alias("j")).select("file", "line", "j.*")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns; an error if one is missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise KeyError(f"missing columns: {', '.join(gone)}")
    return df.select(*columns)


def no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, failing at run time on a null cell of those columns."""
    check = lambda c: F.when(
        F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)
    ).otherwise(F.col(c)).alias(c)
    return df.select(*(check(c) if c in columns else c for c in df.columns))


def strict_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Required columns only, each cell filled. The projection reaches the scan."""
    return no_nulls(require_columns(spark.read.parquet(path), columns), columns)


def data_points(df: DataFrame, columns: list[str], lenient: bool = False) -> DataFrame:
    """Columns as text, null and NaN as empty. A missing column is an error, or empty if lenient."""
    cell = lambda c: F.when(tx.is_missing(F.col(c)), "").otherwise(F.col(c).cast("string"))
    if not lenient:
        require_columns(df, columns)
    return df.select(*((cell(c) if c in df.columns else F.lit("")).alias(c) for c in columns))


def training_rows(df: DataFrame, question: str = "question", positive: str = "summary") -> DataFrame:
    """Rows that have a question and a positive text; the number of dropped rows is observed as `dropped`."""
    from pyspark.sql import Observation

    keep = ~tx.is_blank(F.col(question)) & ~tx.is_blank(F.col(positive))
    watch = Observation("training_rows")
    out = df.observe(watch, F.count_if(~keep).alias("dropped")).where(keep)
    out.observation = watch
    return out


def default_names(df: DataFrame, name: str, order: list[str | Column]) -> DataFrame:
    """Blank names become row-0, row-1, ... by the place in the given order."""
    from .ordinals import numbered

    return numbered(df, order, "default__").withColumn(
        name, F.coalesce(tx.not_blank(F.col(name)), F.concat(F.lit("row-"), F.col("default__").cast("string")))
    ).drop("default__")


def summary_rows(parquet: DataFrame | None, json: DataFrame | None) -> DataFrame:
    """Parquet rows if there are any, else those of JSONL; one must be given."""
    if parquet is None and json is None:
        raise ValueError("neither Parquet nor JSONL rows are given")
    return parquet if parquet is not None else json


def markdown_tree(spark: SparkSession, root: str, file_name: str = "SKILL.md", most_tokens: int = 63_000) -> DataFrame:
    """(relative_path, content, metadata, body) of the documents below root that are in a Latin script and of a fit
    length. Invalid bytes become U+FFFD. Sort by relative_path where the order matters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", file_name).load(root)
    base = root.rstrip("/").removeprefix("file:")
    content = F.make_valid_utf8(F.col("content").cast("string"))
    rows = raw.select(
        F.regexp_replace(F.regexp_extract("path", "^(?:[a-z]+:/*)?(/.*)$", 1), f"^{base}/", "").alias("relative_path"),
        content.alias("content"),
    )
    rows = rows.where(
        ~tx.has_other_script(F.col("content")) & tx.token_count_ok(
            F.size(tx.words(F.col("content"), False)), most_tokens
        ),
    )
    return rows.withColumn("parsed", frontmatter.parse(F.col("content"))).select(
        "relative_path", "content", "parsed.metadata", "parsed.body"
    )


def with_content_id(df: DataFrame, key: str = "relative_path") -> DataFrame:
    """A custom_id from the content key, the same whatever else is in the table."""
    return df.withColumn("custom_id", F.concat(F.lit("sm-"), tx.sha_fragment(F.col(key))))


def whole_text(spark: SparkSession, path: str) -> str:
    """The text of one small file, read on the driver from any store that Spark reads."""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def yaml_config(spark: SparkSession, path: str) -> dict:
    """A YAML mapping; an error for anything else."""
    import yaml

    found = yaml.safe_load(whole_text(spark, path))
    if not isinstance(found, dict):
        raise ValueError(f"not a mapping: {path}")
    return found


def listing(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path) of the files in a folder, of all below it if recursive; sort by path where the order matters."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path")


def records(rows: DataFrame) -> DataFrame:
    """Records of JSON lines (file, line, value): texts, and metadata of any JSON values as map<string,string>."""
    found = jsonl(rows, schemas.RECORD.replace("map<string,string>", "string"))
    return found.withColumn("metadata", payload.metadata_map(F.col("metadata")))


def validated_rows(rows: DataFrame) -> DataFrame:
    """Validated questions of JSON lines, blank questions left out."""
    return jsonl(rows, schemas.VALIDATED_ROW).withColumn(
        "filtered_questions", tx.non_blank_items(F.coalesce("filtered_questions", F.array().cast("array<string>")))
    )


def validated_cache(spark: SparkSession, path: str) -> DataFrame:
    """The validated rows written so far; none where nothing is written yet."""
    return validated_rows(lines(spark, path, missing_ok=True))


def scenario_rows(rows: DataFrame) -> DataFrame:
    """Scenario rows of JSON lines, sorted by custom_id. A line without an id, or whose scenarios aren't pairs of texts, is
    an error that names file and line."""
    scenarios = F.to_json(
        F.struct(F.try_variant_get(F.try_parse_json("value"), "$.scenario_output", "variant").alias("scenario_output"))
    )
    wrong = tx.is_blank(F.get_json_object("value", "$.custom_id")) | ~payload.is_valid(
        scenarios, {"scenario_output": "scenarios"}
    )
    told = F.concat(
        F.lit("not a scenario row: "), "file", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?"))
    )
    checked = rows.withColumn("value", F.when(wrong, F.raise_error(told).cast("string")).otherwise(F.col("value")))
    return jsonl(checked, schemas.SCENARIO_ROW).orderBy("custom_id")


def text_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings (doc_id, tok, tf) and documents (doc_id, len) of an index of write_index(); documents written without a
    length have that of their postings."""
    postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
    if "len" not in docs.columns:
        sizes = postings.groupBy("doc_id").agg(F.sum("tf").alias("len"))
        docs = docs.join(sizes, "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    return postings, docs


def collection(spark: SparkSession, path: str, field: str) -> DataFrame:
    """All records of one field of a vector collection of write_collection(); the field's folder alone is read."""
    return spark.read.parquet(path).where(F.col("field") == field).drop("field")


def last_index(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """The largest number of the names prefix_<number>, 0 if there is none, as one row (last_index)."""
    found = F.regexp_extract(column, rf"^{prefix}_(\d+)$", 1).try_cast("bigint")
    return names.agg(F.coalesce(F.max(found), F.lit(0).cast("bigint")).alias("last_index"))


def counts_by_field(rows: DataFrame, field: str, fields: list[str]) -> DataFrame:
    """Rows of each of the given fields, 0 where there are none."""
    every = rows.sparkSession.createDataFrame([(f,) for f in fields], f"{field} string")
    return every.join(
        rows.groupBy(field).agg(F.count("*").alias("n")), field, "left"
    ).select(field, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
