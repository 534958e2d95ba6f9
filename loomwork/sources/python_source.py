"""Python sources as tables: definitions, imports, calls and test functions, from syntax trees. Nothing is imported."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "module_name string, fact string, full_name string, kind string, qualname string, class_name string, lineno int, end_lineno int, symbol string, target string"
FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.expr) -> str | None:
    """a.b.c of a name or an attribute chain; null for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def imports(tree: ast.Module, module: str, package: bool) -> dict[str, str]:
    """Local name to absolute target. Star imports and names of the package itself (`from . import x`) are left out."""
    known = {}
    base = module.split(".") if package else module.split(".")[:-1]
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                known |= {n.asname or n.name.split(".")[0]: n.name if n.asname else n.name.split(".")[0] for n in names}
            case ast.ImportFrom(module=str(source), names=names, level=level):
                prefix = [] if not level else base[: len(base) - level + 1]
                known |= {n.asname or n.name: ".".join([*prefix, source, n.name]) for n in names if n.name != "*"}
    return known


def called(body: ast.AST) -> list[str]:
    return sorted({name for node in ast.walk(body) if isinstance(node, ast.Call) and (name := dotted(node.func))})


def facts(module: str, source: str, package: bool = False) -> Iterator[tuple]:
    """Rows of FACTS: `definition` for top-level functions and classes and direct methods, `import`, `call` for the
    distinct dotted names that each function calls, `test` for test functions and those of Test classes at any depth, once
    for each name they call, or with a null symbol."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return
    for name, target in sorted(imports(tree, module, package).items()):
        yield module, "import", None, None, None, None, None, None, name, target

    def define(node, kind: str, cls: str | None) -> Iterator[tuple]:
        qual = f"{cls}.{node.name}" if cls else node.name
        full = f"{module}.{qual}"
        yield module, "definition", full, kind, qual, cls, node.lineno, node.end_lineno, None, None
        if kind != "class":
            for symbol in called(node):
                yield module, "call", full, kind, qual, cls, node.lineno, node.end_lineno, symbol, None

    for node in tree.body:
        if isinstance(node, FUNCTION):
            yield from define(node, "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function", None)
        elif isinstance(node, ast.ClassDef):
            yield from define(node, "class", None)
            for item in node.body:
                if isinstance(item, FUNCTION):
                    yield from define(
                        item, "async_method" if isinstance(item, ast.AsyncFunctionDef) else "method", node.name
                    )

    def tests(body: list[ast.stmt], prefix: str) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, FUNCTION) and node.name.startswith("test"):
                for symbol in called(node) or [None]:
                    yield module, "test", f"{module}.{prefix}{node.name}", "test", f"{prefix}{node.name}", None, node.lineno, node.end_lineno, symbol, None
            elif isinstance(node, ast.ClassDef) and node.name.startswith("Test"):
                yield from tests(node.body, f"{prefix}{node.name}.")

    yield from tests(tree.body, "")


def source_facts(files: DataFrame) -> DataFrame:
    """FACTS of (module_name, source, is_package) rows; a source that doesn't parse has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for pdf in batches:
            rows = [
                r for m,
                s,
                p in zip(pdf.module_name, pdf.source, pdf.is_package, strict=True) for r in facts(m, s or "", bool(p))
            ]
            out = pd.DataFrame(rows, columns=names)
            for c in ("lineno", "end_lineno"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("module_name", "source", "is_package").mapInPandas(run, FACTS)


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """(module_name, source, is_package) of all *.py below root."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root, wholetext=True)
    base = root.rstrip("/").removeprefix("file:").rsplit("/", 1)[0]
    path = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "^(?:[a-z]+:/*)?(/.*)$", 1), f"^{base}/", "")
    name = F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    return raw.select(
        name.alias("module_name"), F.col("value").alias("source"), path.endswith("__init__.py").alias("is_package")
    )


def calls_with_targets(rows: DataFrame) -> DataFrame:
    """(caller, symbol, callee): calls resolved in turn as a function or class of the module, an imported name, a method
    of the own class (self, cls), an absolute dotted name, an import followed by a path, and a method name that only
    one class of the package has. Unresolved calls keep a null callee."""
    from ..operators.graph import resolve_calls

    defs = rows.where("fact = 'definition'")
    local = defs.where("class_name is null").select(
        F.concat_ws("|", "module_name", "qualname").alias("key"), "full_name"
    )
    alias = rows.where("fact = 'import'").select(
        F.concat_ws("|", "module_name", "symbol").alias("key"), F.col("target").alias("full_name")
    )
    own = defs.where("class_name is not null").select(
        F.concat_ws("|", "module_name", "qualname").alias("key"), "full_name"
    )
    full = defs.select(F.col("full_name").alias("key"), "full_name")
    methods = defs.where("class_name is not null").groupBy(F.substring_index("qualname", ".", -1).alias("key")).agg(
        F.min("full_name").alias("full_name"), F.count("*").alias("n")
    ).where("n = 1").drop("n")
    head, tail = F.substring_index("symbol", ".", 1), F.regexp_extract("symbol", r"^[^.]*\.(.*)$", 1)
    calls = rows.where("fact = 'call'").select(
        F.col("full_name").alias("caller"),
        "symbol",
        "module_name",
        "class_name",
        head.alias("head"),
        tail.alias("tail"),
    )
    by_head = calls.join(
        alias.select(F.col("key").alias("hk"), F.col("full_name").alias("base")),
        F.concat_ws("|", "module_name", "head") == F.col("hk"),
        "left",
    )
    keyed = by_head.select(
        "caller", "symbol", F.concat_ws("|", "module_name", "symbol").alias("k_local"), F.when(
            F.col("head").isin("self", "cls"), F.concat_ws("|", "module_name", F.concat_ws(".", "class_name", "tail"))
        ).alias("k_own"), F.when(F.col("tail") != "", F.concat_ws(".", "base", "tail")).alias("k_suffix"), F.when(F.col("tail") != "", F.substring_index("symbol", ".", -1)).alias("k_method")
    )
    found = resolve_calls(
        keyed.withColumn("k_alias", F.col("k_local")).withColumn("k_full", F.col("symbol")),
        [
            ("k_local", local),
            ("k_alias", alias),
            ("k_own", own),
            ("k_full", full),
            ("k_suffix", full),
            ("k_method", methods),
        ],
    )
    return found.select("caller", "symbol", "callee").distinct()
