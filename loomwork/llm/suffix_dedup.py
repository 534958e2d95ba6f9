"""Suffix-array dedup: a common-prefix interval tree over an enhanced suffix array gives maximal repeats with all their
occurrences; bytes that repeat an earlier document go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .anchors import REPLY, Bucket, Meeting, Sizes, between, bucketed, by_key, covered, distinct, marked, repeated, shared_stretches, spans, with_replies
from .common import discard, spill

SEED_BYTES = 16


def byte_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.CODES[0][data], off


def content(s, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, _ = tk.buffer(s.texts)
    return data[tk.ranges(begin, end - begin)], end - begin


def suffix_array(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the given suffixes (of sizes[i] bytes from starts[i]; a proper prefix comes first), and the length of
    the common prefix of each with the one before it (0 for the first)."""
    n, width = len(starts), int(sizes.max())
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    columns = []
    for at in range(0, width, 8):
        take = np.minimum(starts + at, len(text))[:, None] + np.arange(8)
        raw = np.where(at + np.arange(8)[None, :] < sizes[:, None], padded[take], 0)
        columns.append(np.ascontiguousarray(raw.astype(np.uint8)).view(">u8").reshape(-1).astype(np.uint64))
    order = np.lexsort((sizes, *columns[::-1]))
    open_ = np.ones(n, bool)
    open_[0] = False
    for c in columns:
        c = c[order]
        x = np.zeros(n, np.uint64)
        x[1:] = c[1:] ^ c[:-1]
        same = x == 0
        part = np.zeros(n, np.int64)
        some = open_ & ~same
        part[some] = sum((x[some] >> np.uint64(8 * j) == 0).astype(np.int64) for j in range(1, 8))  # leading zero bytes
        lcp += np.where(open_, np.where(same, 8, part), 0)
        open_ &= same
    ordered = sizes[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(ordered[1:], ordered[:-1]))
    return order, lcp


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats of an enhanced suffix array: (length, first, last) of each interval of the common-prefix tree
    with a prefix of `least` or more whose members differ in what stands on their left. left: a code for that, unique
    where there is nothing to the left."""
    stack: list[list[int]] = []  # length, first, left code or -1 if diverse
    n = len(lcp)
    depth = lcp.tolist()
    code = left.tolist()
    for i in range(1, n + 1):
        now = depth[i] if i < n else 0
        begin, seen = i - 1, code[i - 1]
        while stack and stack[-1][0] > now:
            length, begin, own = stack.pop()
            own = own if own == seen else -1
            if own == -1:
                yield length, begin, i - 1
            seen = own
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != seen:
                    stack[-1][2] = -1
            else:
                stack.append([now, begin, seen])


def judge(L: int, all_: bool):
    """Of the stretches that a part of the key space has: the maximal repeats, as runs of windows, for the buckets that
    hold them; all occurrences, or only those in documents above a repeat's smallest."""

    def handle(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Meeting(held, byte_units, SEED_BYTES, L)
        low, high = m.per_node(np.minimum, m.leaf["low"]), m.per_node(np.maximum, m.leaf["high"])
        many = m.per_node(np.add, m.leaf["many"].astype(np.int64))
        # equal stretches are one leaf of the tree; where several documents or places hold it, it is a repeat as a whole
        size = m.size[m.model]
        whole = np.flatnonzero(many > 1) if all_ else np.flatnonzero(high > low)
        out = [
            (whole, low[whole], np.zeros(len(whole), np.int64), size[whole] - L, m.name[m.model[whole]], many[whole])
        ]
        kin = np.sort(m.kin())
        if len(kin):
            out.append(repeats_of(m.text, m.start[m.model[kin]], size[kin], low[kin], many[kin], kin, L))
        node, least, first, last, group, places = (np.concatenate(x) for x in zip(*out, strict=True))
        yield from m.answer(node, least, first, last, group, places, all_)

    return by_key("part", handle)


def repeats_of(
    text: np.ndarray, place: np.ndarray, size: np.ndarray, low: np.ndarray, many: np.ndarray, node: np.ndarray, L: int
):
    """Maximal repeats of the given stretches, from the interval tree, for each stretch that holds one: (node, smallest
    doc_id, first and last window, a name of the repeat, its places)."""
    text, place = text[tk.ranges(place, size)], np.cumsum(size) - size  # the rest of the part's text plays no role here
    # suffixes whose window follows an equal window of all that share it are implied by the longer ones: leave them out
    count = size - L + 1
    at = tk.ranges(place, count)
    leaf = np.repeat(np.arange(len(place)), count)
    opening = at == place[leaf]
    window = tk.mix(spans(tk.CODES[1][text], at, L))
    order, first, n = distinct(window)
    group = np.empty(len(at), np.int64)
    group[order] = np.repeat(np.arange(len(first)), n)
    before = np.where(opening, -1 - np.arange(len(at)), np.append(-1, group[:-1]))[order]
    diverse = np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)
    wanted = np.flatnonzero((diverse & (n > 1))[group])
    if not len(wanted):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), none
    starts, leaf, opening, window = at[wanted], leaf[wanted], opening[wanted], window[wanted]
    order, lcp = suffix_array(text, starts, place[leaf] + size[leaf] - starts)
    left = np.where(opening, 256 + np.arange(len(starts)), text[np.maximum(starts - 1, 0)])[order]
    starts, leaf, window = starts[order], leaf[order], window[order]
    found = np.array(list(intervals(lcp, left, L)), np.int64).reshape(-1, 3)
    length, lo, span = found[:, 0], found[:, 1], found[:, 2] - found[:, 1] + 1
    at, first = tk.ranges(lo, span), np.cumsum(span) - span
    member = leaf[at]
    offset = starts[at] - place[member]
    # all members share the first window and the length, and no other repeat of the part has both
    name = tk.mix(window[lo] + length.astype(np.uint64))
    least, places = (f.reduceat(x[member], first) if len(first) else first for f, x in ((np.minimum, low), (np.add, many)))
    return (
        node[member],
        np.repeat(least, span),
        offset,
        offset + np.repeat(length - L, span),
        np.repeat(name, span),
        np.repeat(places, span),
    )


def cut_bytes(L: int):
    """Of each bucket's texts and the repeats that were found for its stretches: the bytes that remain."""

    def handle(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, anchor, run in marked(Bucket(held, byte_units, SEED_BYTES, L)):
            keep = run["low"] < s.id[s.doc[anchor]]
            gone = covered(s, anchor[keep], run[keep])
            data, _ = tk.buffer(s.texts)
            begin, end = tk.spans(gone, s.off)
            runs = np.searchsorted(begin, s.off)
            removed = np.concatenate([[0], np.cumsum(end - begin)])[runs]
            left, kept = memoryview(data[~gone]), (s.off - removed).tolist()
            own = np.repeat(s.off[:-1], np.diff(runs))
            at = pa.array(runs.astype(np.int32))
            cols = [
                pa.array(np.diff(s.off)),
                pa.array(np.diff(removed)),
                pa.array(np.diff(runs)),
                pa.array([hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(kept[:-1], kept[1:], strict=True)]),
                pa.ListArray.from_arrays(at, pa.array(begin - own)),
                pa.ListArray.from_arrays(at, pa.array(end - own)),
            ]
            yield pa.RecordBatch.from_arrays(
                [s.ids, *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "from_byte", "to_byte"]
            )

    return by_key("bucket", handle)


CUTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, from_byte array<long>, to_byte array<long>"


def found_repeats(docs: DataFrame, length: int, all_: bool) -> tuple[DataFrame, Sizes, DataFrame]:
    """The bucketed texts, and the maximal repeats of stretches as packed answers to the buckets, as a written table."""
    rows, sizes = bucketed(docs)
    stretches, seeds = shared_stretches(
        rows, sizes, byte_units, SEED_BYTES, length, between if not all_ else repeated, content
    )
    found = spill(stretches.mapInArrow(judge(length, all_), REPLY).coalesce(sizes.files), "runs")
    discard(seeds)
    return rows, sizes, found


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (from_byte, to_byte) of every row.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Null
    texts are empty. Rows that share a doc_id are one document as to that rule. Rows without a doc_id lose nothing and
    are held against nothing. Anchors are found in overlapping steps, which split none.

    All equal strings of `length` bytes own the same winnowed anchor, so the stretches around anchors that several
    documents have meet by the anchor's key, each distinct stretch once a bucket, crowded keys dealt by deeper context.
    There, the suffixes of the stretches are sorted with their common prefixes, and a stack scan of this enhanced suffix
    array yields the intervals of the common-prefix tree whose left extensions differ: maximal repeats with all their
    occurrences, down to the end of the stretch. Each occurrence above the smallest document of a repeat is cut.
    Repeats longer than a stretch are the unions of those of its successive anchors; maximal_repeats() puts them together.
    """
    rows, sizes, found = found_repeats(docs, length, False)
    out = spill(with_replies(rows, found, sizes).mapInArrow(cut_bytes(length), CUTS).coalesce(sizes.files), "cuts")
    discard(found)
    return out


SEGMENTS = "doc_id long, first long, last long, id long, many long"


def segments(L: int):
    """Of each bucket: runs of windows (first to last start) with the repeat that each stands for, the one that all places
    of the window share and no longer string does, and the number of these places."""

    def handle(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, anchor, run in marked(Bucket(held, byte_units, SEED_BYTES, L)):
            begin, size = s.start[anchor] + run["first"], run["last"].astype(np.int64) - run["first"] + 1
            at = tk.ranges(begin, size)
            if not len(at):
                continue
            row = np.repeat(np.arange(len(anchor)), size)
            order = np.lexsort((run["group"][row], -run["many"][row].astype(np.int64), at))
            at, row = at[order], row[order]
            best = np.append(True, at[1:] != at[:-1])
            at, row = at[best], row[best]
            offset = at - begin[row]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (anchor[row[1:]] != anchor[row[:-1]]) | (
                run["group"][row[1:]] != run["group"][row[:-1]]
            ) | (offset[1:] != offset[:-1] + 1)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(at)) - 1
            own = row[lo]
            doc = s.doc[anchor[own]]
            id_ = tk.mix(tk.mix(run["group"][own] + offset[lo].astype(np.uint64)) + (hi - lo).astype(np.uint64))
            cols = [
                s.id[doc],
                at[lo] - s.off[doc],
                at[hi] - s.off[doc],
                id_.view(np.int64),
                run["many"][own].astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "first", "last", "id", "many"])

    return by_key("bucket", handle)


SUFFIXES = "key long, before long, ids array<long>, doc_id long, first long, lasts array<long>"


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tracks (doc_id, track of (first, last, unit)): every suffix of two units or more, with the unit before it."""
    for batch in batches:
        rows = []
        for doc, track in zip(batch.column("doc_id").to_pylist(), batch.column("track").to_pylist(), strict=True):
            ids, lasts = [t["unit"] for t in track], [t["last"] for t in track]
            for i in range(len(track) - 1):
                key = int(
                    tk.mix(
                        tk.mix(np.array(ids[i : i + 1]).view(np.uint64)) + np.array(ids[i + 1 : i + 2]).view(np.uint64)
                    ).view(np.int64)[0],
                )
                rows.append((key, ids[i - 1] if i else None, ids[i:], doc, track[i]["first"], lasts[i:]))
        if rows:
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), longs, pa.int64(), pa.int64(), longs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["key", "before", "ids", "doc_id", "first", "lasts"],
            )


REPEATS = "repeat_id long, n_places long, doc_id long, from_byte long, to_byte long"


def repeats_of_units(L: int):
    """The enhanced suffix array of the suffixes that begin with the same two units, and of its intervals the maximal
    repeats of two units or more, with all occurrences."""

    def handle(key: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in held for r in b.to_pylist()), key=lambda r: r["ids"])
        lcp = np.zeros(len(rows), np.int64)
        for i in range(1, len(rows)):
            a, b = rows[i - 1]["ids"], rows[i]["ids"]
            n = min(len(a), len(b))
            lcp[i] = next((j for j in range(n) if a[j] != b[j]), n)
        codes: dict[int, int] = {}
        left = np.array(
            [-2 - i if r["before"] is None else codes.setdefault(r["before"], len(codes)) for i, r in enumerate(rows)]
        )
        out = []
        for length, lo, hi in intervals(lcp, left, 2):
            name = np.array(rows[lo]["ids"][:length], np.int64).view(np.uint64)
            id_ = int(
                np.bitwise_xor.reduce(
                    tk.mix(name + np.arange(length, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                ).view(np.int64),
            )
            out += [(id_, hi - lo + 1, r["doc_id"], r["first"], r["lasts"][length - 1] + L) for r in rows[lo : hi + 1]]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                ["repeat_id", "n_places", "doc_id", "from_byte", "to_byte"],
            )

    return by_key("key", handle)


def maximal_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(repeat_id, n_places, doc_id, from_byte, to_byte): all maximal repeats of `length` bytes or more, each with all its
    occurrences. A repeat is a string that stands at two or more places, in one document or several; it is maximal if
    its places differ in the byte before and in the byte behind it (or a text begins or ends there).

    The repeats of stretches (see repeats()) tell of each window the repeat that all its places share. Runs of windows
    with the same places are joined over the stretches of successive anchors to units, however long: a link between two
    is firm if it stands at all places of both. A maximal repeat is a run of units. Those of one unit differ in the
    units beside them; those of more are the left-diverse intervals of the common-prefix tree over the suffixes of the
    documents' runs of units, sorted where they begin with the same two.

    The result grows with the occurrences of nested repeats, for families of edited copies faster than the texts; the
    cuts of repeats() need none of it. Documents share a doc_id at most by equal rows, which count once; rows without a
    doc_id or a text hold no repeats.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").distinct()
    rows, sizes, found = found_repeats(docs, length, True)
    parts = spill(with_replies(rows, found, sizes).mapInArrow(segments(length), SEGMENTS), "segments")
    discard(found)
    by_doc = Window.partitionBy("doc_id").orderBy("first")
    near = parts.withColumn(
        "next",
        F.when(
            F.lead("first").over(by_doc) == F.col("last") + 1,
            F.struct(F.lead("id").over(by_doc).alias("id"), F.lead("many").over(by_doc).alias("many")),
        ),
    )
    links = near.where("next is not null and next.many = many").groupBy("id", F.col("next.id").alias("to")).agg(
        F.count("*").alias("n"), F.first("many").alias("many")
    )
    firm = links.where("n = many").select(F.col("id").alias("l__"), F.col("to").alias("t__"))
    linked = near.join(
        firm, (F.col("id") == F.col("l__")) & (F.col("next.id") == F.col("t__")), "left"
    ).withColumn("firm", F.col("l__").isNotNull())
    opens = linked.withColumn("opens", ~F.coalesce(F.lag("firm").over(by_doc), F.lit(False)))
    numbered = opens.withColumn("at", F.sum(F.col("opens").cast("long")).over(by_doc))
    units = numbered.groupBy("doc_id", "at").agg(
        F.min_by("id", "first").alias("unit"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    units = spill(units, "units")
    discard(parts)
    beside = units.withColumn(
        "before", F.when(F.lag("last").over(by_doc) + 1 == F.col("first"), F.lag("unit").over(by_doc))
    ).withColumn("after", F.when(F.lead("first").over(by_doc) == F.col("last") + 1, F.lead("unit").over(by_doc)))
    diverse = lambda c: (F.count(c) < F.count("*")) | (F.min(c) < F.max(c))
    single = beside.groupBy("unit").agg(
        F.count("*").alias("n_places"), diverse("before").alias("l"), diverse("after").alias("r")
    ).where("l and r and n_places > 1").select("unit", "n_places")
    alone = units.join(single, "unit").select(
        F.col("unit").alias("repeat_id"),
        "n_places",
        "doc_id",
        F.col("first").alias("from_byte"),
        (F.col("last") + length).alias("to_byte"),
    )
    track = F.sum(F.col("before").isNull().cast("long")).over(by_doc)
    tracks = beside.withColumn("t", track).groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "unit"))).alias("track")
    ).select("doc_id", "track")
    tails = tracks.where(F.size("track") > 1).mapInArrow(suffixes, SUFFIXES).repartition(sizes.tasks, "key").sortWithinPartitions("key")
    return alone.union(tails.mapInArrow(repeats_of_units(length), REPEATS))
