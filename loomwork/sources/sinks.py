"""Writers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.packing import pack
from .ordinals import chunked, sharded
from .readers import exists


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON line (value); invalid UTF-8 is replaced, null fields are left out."""
    return df.select(F.make_valid_utf8(F.to_json(F.struct("*"))).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str | Column] | None = None, single_file: bool = False) -> None:
    """JSON lines; sorted if an order is given, and then in one file only if asked to."""
    df = df.orderBy(*order) if order else df
    (to_json(df).coalesce(1) if single_file else to_json(df)).write.mode("overwrite").text(path)


def write_jsonl_chunks(df: DataFrame, path: str, order: list[str | Column], size: int, start: int = 0) -> None:
    """Folders chunk=<start>, chunk=<start + 1>, ... of `size` rows each."""
    rows = chunked(df, order, size, "chunk", start)
    rows.select(
        "chunk", F.to_json(F.struct(*df.columns)).alias("value")
    ).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def write_jsonl_budget(
    df: DataFrame, path: str, order: list[str], cost: str, budget: int, group: list[str] | None = None
) -> None:
    """Folders shard=0, shard=1, ... (in folders of their group, where one is named) of JSON lines whose costs stay
    within the budget; a row beyond it has a shard to itself."""
    group = group or []
    rows = pack(df, group, order, cost, budget)
    value = F.to_json(F.struct(*(c for c in df.columns if c not in group))).alias("value")
    rows.select(*group, "shard", value).repartition(*group, "shard").write.mode("overwrite").partitionBy(*group, "shard").text(path)


def write_retriever_rows(df: DataFrame, path: str) -> None:
    """Retriever rows as JSON lines sorted by id, with all fields of the schema that the readers expect."""
    from pyspark.sql.types import _parse_datatype_string

    write_jsonl(df.select(*(f.name for f in _parse_datatype_string(schemas.SUMMARY_ROW).fields)), path, ["custom_id"])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark reaches; an empty text removes the file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not text:
        store.delete(target, False)
        return
    out = store.create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def move_to_done(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Move files into a folder under names that are free there (see archive_names()); their new paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    done = path(folder)
    store = done.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(done)
    taken = [(f.getPath().getName(),) for f in store.listStatus(done)]
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in paths], "name string")
    target = {r.name: r.target for r in archive_names(names, spark.createDataFrame(taken, "name string")).collect()}
    out = []
    for p in paths:
        out.append(f"{folder}/{target[p.rsplit('/', 1)[-1]]}")
        if not store.rename(path(p), path(out[-1])):
            raise OSError(f"cannot move {p}")
    return out


def cached_scores(
    spark: SparkSession, folder: str, inputs: list[DataFrame], compute: Callable[[], DataFrame]
) -> DataFrame:
    """A table that compute() makes of the inputs, written once for the same content of them: the folder's name is a
    digest of all their rows, so that other rows of the same number never meet an old table."""
    marks = []
    for df in inputs:
        row = df.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64(*df.columns)),
            F.sum(F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(1 << 31))),
        ).first()
        marks.append("-".join(str(v or 0) for v in row))
    path = f"{folder}/scores-{hashlib.sha256('/'.join(marks).encode()).hexdigest()[:32]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_shards(df: DataFrame, path: str, order: list[str | Column], shards: int) -> None:
    """Parquet in `shards` folders of equal size."""
    sharded(df, order, shards).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def write_typed(df: DataFrame, path: str, schema: str) -> None:
    """Parquet of exactly that schema, kept for an empty frame too."""
    from pyspark.sql.types import _parse_datatype_string

    want = _parse_datatype_string(schema)
    df.select(*(F.col(f.name).cast(f.dataType) for f in want.fields)).write.mode("overwrite").parquet(path)


def write_index(postings: DataFrame, docs: DataFrame, path: str) -> None:
    """A text index as two Parquet tables, postings laid out by term so that a query's terms prune row groups."""
    postings.repartitionByRange("tok").sortWithinPartitions("tok").write.mode("overwrite").parquet(f"{path}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/docs")


def write_collection(df: DataFrame, path: str, field: str = "field") -> None:
    """A vector collection, one folder for each field; rewriting replaces only the fields that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(field).parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def run_summary(source: Column, rows: DataFrame, succeeded: Column, model: str) -> DataFrame:
    """source_file, total_requests, succeeded, failed, model of a run, one row for each source."""
    return rows.groupBy(source.alias("source_file")).agg(
        F.count("*").alias("total_requests"),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(~succeeded).alias("failed"),
    ).withColumn("model", F.lit(model))


def archive_names(names: DataFrame, taken: DataFrame, column: str = "name") -> DataFrame:
    """(name, target): the name itself, or stem_<n> with the first free number, for files that move to a folder where
    the names `taken` exist."""
    stem, suffix = F.regexp_extract(column, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(column, r"^(.*?)(\.[^.]*)?$", 2)
    own = names.select(column, stem.alias("stem"), suffix.alias("suffix"))
    used = taken.select(
        F.regexp_extract(column, r"^(.*?)(_\d+)?(\.[^.]*)?$", 1).alias("stem"),
        F.regexp_extract(column, r"(\.[^.]*)?$", 1).alias("suffix"),
        F.col(column).alias("full"),
    )
    lists = used.groupBy("stem", "suffix").agg(F.collect_set("full").alias("full"))
    tries = lambda s: F.transform(  # noqa: E731, ARG005
        F.sequence(F.lit(0), F.size("full")),
        lambda i: F.when(i == 0, F.concat("stem", "suffix")).otherwise(
            F.concat("stem", F.lit("_"), i.cast("string"), "suffix")
        ),
    )
    found = F.get(F.filter(tries(None), lambda t: ~F.array_contains("full", t)), 0)
    return own.join(lists, ["stem", "suffix"], "left").select(
        column, F.when(F.col("full").isNull(), F.col(column)).otherwise(found).alias("target")
    )
