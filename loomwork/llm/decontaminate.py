"""Benchmark decontamination: a prefix-filtered join of item windows with document words, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, fresh, spill, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows are broadcast while their words take no more bytes than this in all; beyond, the joins shuffle.
BROADCAST_BYTES = 48 << 20
TOKEN_WORDS = 3


def word_array(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z; null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # then lower() touches A-Z alone, and is faster
    return F.array_remove(
        F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS), ""
    )


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """Windows of the items, as distinct (w, item): `width` consecutive words, all of them if an item has fewer."""
    words = items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("ws")
    ).where(F.size("ws") > 0)
    starts = words.select(
        "item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))).alias("at")
    )
    return starts.select("item", F.slice("ws", F.col("at"), F.lit(width)).alias("w")).distinct()


def room(w: Column) -> Column:
    """Bytes of a window in a table, about."""
    return F.octet_length(F.concat_ws(" ", w)) + 24 * F.size(w) + 64


def shingles_of(ws: Column, size: int) -> Column:
    """Hashes of all `size` consecutive words, by the place of the first; the last size - 1 places hash fewer words."""
    return F.transform(ws, lambda x, i: F.xxhash64(x, *(F.get(ws, i + j) for j in range(1, size))))


def hits(docs: DataFrame, owned: DataFrame, found: str = "found__", all_: bool = True) -> DataFrame:
    """Every row of docs with `found`: the struct (n_words, kept), kept the places and words of the windows in its text;
    null, unless all_, for a row that the join finds no candidate in. owned: windows as of windows_of(). Which items hold a window plays no part here, however many they are.

    The tokens of the join are shingles of TOKEN_WORDS words (of all words, where a window has fewer), ordered by how
    often documents hold them. A window occurs only where its rarest shingle does, so only that one (its necessary
    prefix) is joined, at its place in the window; the place must leave room for the window (length and position
    bounds), and the window must then equal the words there. A window whose rarest shingle no document holds is
    dropped at once.
    """
    most = owned.agg(F.sum(room(F.col("w"))).alias("room")).first().room
    windows = spill(few(owned.select("w").distinct(), most), "windows")
    sizes = F.sort_array(F.collect_set(F.least(F.size("w"), F.lit(TOKEN_WORDS))))
    facts = windows.agg(F.sum(room(F.col("w"))).alias("room"), sizes.alias("sizes")).first()
    hint = F.broadcast if (facts.room or 0) <= BROADCAST_BYTES else lambda df: df
    sizes = list(facts.sizes) or [TOKEN_WORDS]
    words = docs.where("text is not null").select(
        F.col("doc_id").alias("id__"), F.xxhash64("text").alias("fp__"), word_array(F.col("text")).alias("ws")
    )
    # a one-element array binds the words, so that they are split once for each text
    tokens = F.element_at(F.transform(F.array("ws"), lambda ws: F.array(*(shingles_of(ws, n) for n in sizes))), 1)
    own = F.transform(
        F.array(*(F.struct(F.lit(n).alias("size"), shingles_of(F.col("w"), n).alias("t")) for n in sizes)), lambda s: s
    )
    mine = F.element_at(F.filter(own, lambda s: s["size"] == F.least(F.size("w"), F.lit(TOKEN_WORDS))), 1)
    placed_in = windows.select(
        "w", F.posexplode(F.slice(mine["t"], F.lit(1), F.size("w") - mine["size"] + 1)).alias("offset", "token")
    )
    placed = words.select(
        "id__", "fp__", F.size("ws").alias("n"), F.explode(tokens).alias("ts")
    ).select("id__", "fp__", "n", F.posexplode("ts").alias("pos", "token"))
    met = spill(  # one split of the texts serves both joins
        placed.join(hint(placed_in.select("token").distinct()), "token"), "met"
    )
    often = met.groupBy("token").agg(F.count("*").alias("df"))
    rare = placed_in.join(hint(often), "token", "left").groupBy("w").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("r")
    ).where("r.df > 0")
    anchors = spill(few(rare.select("r.df", "r.token", "r.offset", "w"), facts.room), "anchors")
    most = anchors.agg(F.sum(F.col("df") * room(F.col("w"))).alias("room")).first().room  # of candidates
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("w") <= F.col("n"))
    maybe = met.join(hint(anchors), "token").where(fits).groupBy("id__", "fp__").agg(
        F.collect_set(F.struct(start.alias("at"), "w")).alias("maybe")
    )
    maybe = spill(few(maybe, most), "maybe")
    discard(windows, met, anchors)
    fp, id_, f, some = fresh(docs, "fp__", "i__", "f__", "maybe")
    right = maybe.select(F.col("id__").alias(id_), F.col("fp__").alias(f), F.col("maybe").alias(some))
    joined = docs.withColumn(fp, F.xxhash64("text")).join(
        right, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(fp) == F.col(f)), "left"
    )

    def judge(ws: Column) -> Column:
        kept = F.filter(some, lambda c: F.slice(ws, c["at"] + 1, F.size(c["w"])) == c["w"])
        return F.struct(F.size(ws).cast("long").alias("n_words"), kept.alias("kept"))

    judged = F.element_at(F.transform(F.array(word_array(F.col("text"))), judge), 1)
    return joined.withColumn(found, judged if all_ else F.when(F.col(some).isNotNull(), judged)).drop(fp, id_, f, some)


def report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; a null text has no words.

    Rows of docs without a doc_id are judged like others, repeated rows each by itself, long texts as a whole. Items
    without an item_id or a word are left out; items that repeat an id are one. Documents with the same windows have the
    same items, so the items of each set of windows are gathered and hashed once, not for each document.
    """
    owned = windows_of(items, width)
    found = spill(hits(docs.select(F.col("doc_id").cast("long"), "text"), owned).select("doc_id", "found__"), "hits")
    kept = F.coalesce(F.col("found__.kept"), F.array())
    covered = F.transform(kept, lambda c: F.sequence(c["at"], c["at"] + F.size(c["w"]) - 1))
    ws = F.array_sort(F.array_distinct(F.transform(kept, lambda c: c["w"])))
    rows = found.select(
        "doc_id",
        F.col("found__.n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(covered))).cast("long").alias("n_hit"),
        ws.alias("ws"),
    )
    hit = rows.where("n_hit > 0")
    held = F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + room(w))
    facts = hit.agg(F.count("*").alias("n"), F.sum(held).alias("room")).first()
    sets = hit.groupBy("ws").agg(F.count("*").alias("n__")).select("ws", "n__", F.explode("ws").alias("w"))
    names = sets.join(owned, "w").groupBy("ws", "n__").agg(F.array_sort(F.collect_set("item")).alias("names"))
    told = names.select(
        "ws",
        "n__",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
    )
    none = rows.where("n_hit = 0").select(
        "doc_id", "n_words", "n_hit", F.lit(0).cast("long"), F.sha2(F.lit(b""), 256), F.lit(False)
    )
    some = spread_join(hit, told, "ws", facts.n).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.lit(True).alias("contaminated")
    )
    out = spill(few(some, facts.room).union(none), "report")
    discard(found)
    return out


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; columns unchanged.

    Null and empty texts stay, as do repeated rows that hold no window; null doc_ids are judged like others. An empty
    benchmark removes nothing.
    """
    (found,) = fresh(docs, "found__")
    return hits(docs, windows_of(items, width), found, False).where(
        F.coalesce(F.size(f"{found}.kept"), F.lit(0)) < 1
    ).drop(found)
