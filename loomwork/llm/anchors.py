"""Winnowed anchors over unit sequences (bytes or words), and packed exchanges between document buckets and key parts.

Any L consecutive units (a window) are owned by one anchor: the k-gram of the smallest hash in them, the leftmost of
equals. Which it is depends on the window's content alone, so equal windows of different documents have equal anchors.
Documents are dealt into buckets by doc_id. What a bucket says about a key leaves as one packed row for each part of
the key space, holding each key once, so a passage that a third of all documents share costs one entry a bucket; a
part answers with one packed row for each bucket.

The stretch of an anchor is what its windows cover. A stretch has a 64-bit name of its units and the anchor's place.
Names only sort and address. Stretches that share one are compared unit by unit, in the parts where those of different
buckets meet and in each bucket when answers are applied (there by a second name between slices of a megabyte), and a
collision is an error, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import shuffle_partitions, slices, spill

#: Units that are hashed at a time, so that what is computed of them stays in a core's cache.
STEP = 1 << 15
SLICE = 1 << 20
ROW = "bucket long, kind int, doc_id long, text string, blob binary"
PACKET = "part long, bucket long, blob binary"
REPLY = "bucket long, blob binary"
P1 = np.uint64(0xC2B2AE3D27D4EB4F)
KEY = np.uint64(0x6A09E667F3BCC909)
CHOICE = np.uint64(0x9E3779B97F4A7C15)
#: A key counts as crowded in a bucket from so many places on, and is dealt by deeper context if so many buckets say so.
CROWD, CROWDED = 4, 16
#: A crowded key is dealt by this many ranges of the window's place around the anchor.
RANGES = 6
#: Leading bits of a name by which most names that no answer has are told.
FILTER = 18
LEAF = np.dtype([("low", "<i8"), ("high", "<i8"), ("size", "<u4"), ("place", "<u4"), ("many", "<u4")])
RUN = np.dtype([("id", "<u8"), ("group", "<u8"), ("low", "<i8"), ("first", "<u4"), ("last", "<u4"), ("many", "<u4")])


def roll(units: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash (modulo 2^64, or 2^32 for such units) of every n consecutive units, composed from powers of two."""
    power, level, width, out, done = P1.astype(units.dtype), units, 1, None, 0
    while True:
        if n & width:
            if out is None:
                out = level
            else:  # out covers `done` units; level follows them
                m = len(units) - done - width + 1
                out = out[:m] * power + level[done : done + m]
            done += width
        if done == n:
            return out
        level = level[:-width] * power + level[width:]
        power = np.array([power]) * power
        power, width = power[0], width * 2


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of P1 and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(P1), -1, 1 << 64))
    return tuple(np.cumprod(np.append(np.uint64(1), np.full((1 << bits) - 1, x))) for x in (P1, inverse))


def spans(units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """roll(units, size[i])[start[i]] of each i, from sums of the units times falling powers; starts must ascend."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    end = start + size
    edges = np.searchsorted(start, np.arange(0, len(units) + STEP, STEP))
    for lo, a, b in zip(range(0, len(units), STEP), edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        first, last = start[a:b] - lo, end[a:b] - lo
        reach = int(last.max())
        power, inverse = powers(max(16, reach.bit_length()))
        total = np.zeros(reach + 1, np.uint64)
        np.cumsum(units[lo : lo + reach] * inverse[:reach], out=total[1:])
        out[a:b] = (total[last] - total[first]) * power[last - 1]
    return out


def anchors(
    units: np.ndarray, off: np.ndarray, k: int, L: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First owned window, number of owned windows, place and key of each anchor, in order."""
    parts = []
    step = max(STEP, L)
    kind, bits = (np.uint32, 16) if step + L <= 1 << 16 else (np.uint64, 32)
    where = kind((1 << bits) - 1)  # of a place in a step; the other bits of a number are the gram's hash
    for lo in range(0, max(1, len(units)), step):
        piece = units[lo : lo + step + L - 1]
        if len(piece) < L:
            continue
        h = roll(piece.astype(kind), k) * CHOICE.astype(kind)
        m = len(piece) - L + 1
        owner = least((h & ~where) | np.arange(len(h), dtype=kind), L - k + 1) & where
        valid = np.ones(m, bool)
        ends = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, lo + len(piece))] - lo
        first = np.maximum(ends - L + 1, 0)
        last = np.minimum(ends, m)
        valid[tk.ranges(first, np.maximum(last - first, 0))] = False
        new = np.ones(m, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, m))
        taken = valid[begin]
        begin, count = begin[taken], count[taken]
        parts.append((begin + lo, count, owner[begin].astype(np.int64) + lo))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    start, count, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(start):
        return start, count, place, np.zeros(0, np.uint64)
    new = np.ones(len(start), bool)  # an anchor whose windows lie in two steps is one
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(new)
    start, count, place = start[first], np.add.reduceat(count, first), place[first]
    return start, count, place, tk.mix(spans(units, place, k) ^ KEY)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorting order (of equal keys: any), and the starts and lengths of the runs of equal keys in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(keys)))


def dealt(to: np.ndarray) -> np.ndarray:
    """A stable sorting order of numbers of buckets or parts."""
    return np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")


def contained(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def by_key(key: str, handle: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow over rows sorted by key: calls handle with the rows of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[lo] != now:
                    if held:
                        yield from handle(int(now), held)
                    now, held = keys[lo], []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from handle(int(now), held)

    return run


def packets(bucket: int, parts: np.ndarray, values: np.ndarray, pack) -> pa.RecordBatch:
    """One row for each part: the packed values, in the order of parts."""
    order = dealt(parts)
    parts, values = parts[order], values[order]
    first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(parts)).astype(np.int64)
    blobs = pa.array([pack(values[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())
    cols = [pa.array(parts[first].astype(np.int64)), pa.array(np.full(len(first), bucket, np.int64)), blobs]
    return pa.RecordBatch.from_arrays(cols, ["part", "bucket", "blob"])


def answers(owners: np.ndarray, values: np.ndarray, pack) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: the packed values for it."""
    order = dealt(owners)
    owners, values = owners[order], values[order]
    if not len(values):
        return
    first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
    ends = np.append(first[1:], len(owners))
    blobs = pa.array([pack(values[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(owners[first].astype(np.int64)), blobs], ["bucket", "blob"])


def shared_keys(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keys of a part: tell each bucket which of its keys other buckets have too. The lowest bit says in an
    offer that the bucket is crowded with the key, and in an answer that many buckets are."""
    blobs = [unpack48(x.as_py()) for b in held for x in b.column("blob")]
    owners = np.repeat(np.concatenate([b.column("bucket").to_numpy() for b in held]), [len(x) for x in blobs])
    values = np.concatenate(blobs)
    crowd, values = (values & np.uint64(1)).astype(np.int64), values >> np.uint64(1)
    order, first, size = distinct(values)
    hot = np.repeat(np.add.reduceat(crowd[order], first) >= CROWDED, size)
    many = np.repeat(size > 1, size)
    yield from answers(owners[order][many], (values[order] << np.uint64(1) | hot.astype(np.uint64))[many], pack48)


class Bucket:
    """The texts of a bucket in slices, with their anchors; and the packed answers to it."""

    def __init__(self, held: list[pa.RecordBatch], units: Callable, k: int, L: int):
        self.replies, self.slices = [], []
        for batch in held:
            kind = batch.column("kind").to_numpy()
            at = int(np.searchsorted(kind, 1))
            self.replies += [x.as_py() for x in batch.column("blob").slice(0, at)]
            for piece in slices(batch.slice(at), most=SLICE) if at < batch.num_rows else ():
                self.slices.append(Slice(piece, units, k, L))


class Slice:
    """Texts, and the anchors of their windows: first window, number of windows, place and key of each. Units are made
    anew when they are asked for, so that a bucket at rest holds texts and anchors only."""

    def __init__(self, piece: pa.RecordBatch, units: Callable, k: int, L: int):
        self.ids, self.texts, self.make, self.k, self.L = piece.column("doc_id"), piece.column("text"), units, k, L
        values, self.off = self.units()
        self.start, self.count, self.place, self.key = anchors(values, self.off, k, L)
        self.doc = np.searchsorted(self.off, self.start, side="right") - 1
        known = np.asarray(self.ids.is_valid())
        if not known.all():  # rows without a doc_id take no part
            keep = known[self.doc]
            for name in ("start", "count", "place", "key", "doc"):
                setattr(self, name, getattr(self, name)[keep])
        self.id = self.ids.fill_null(0).to_numpy(zero_copy_only=False)

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        return self.make(*tk.buffer(self.texts))

    def names(self, chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The names of the stretches of the chosen anchors."""
        return names(values, self.start[chosen], self.count[chosen], self.place[chosen], self.key[chosen], self.L)


def names(
    units: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray, key: np.ndarray, L: int
) -> np.ndarray:
    """A 64-bit name for each stretch of count + L - 1 units from start, of its units and the anchor's place; starts must
    ascend."""
    n = count + L - 1
    inner = (place - start).astype(np.uint64)
    return tk.mix(spans(units, start, n) ^ tk.mix(key + inner * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64)))


def unequal(data: np.ndarray, start: np.ndarray, size: np.ndarray, model: np.ndarray) -> bool:
    """Whether any span data[start[i] : start[i] + size[i]] differs from the span model[i] of the same arrays."""
    if (size != size[model]).any():
        return True
    other = np.flatnonzero(model != np.arange(len(model)))
    for lo in range(0, len(other), 1 << 14):
        own = other[lo : lo + (1 << 14)]
        if not np.array_equal(data[tk.ranges(start[own], size[own])], data[tk.ranges(start[model[own]], size[own])]):
            return True
    return False


COLLISION = "stretches of different units share a 64-bit name"


def bucketed(docs: DataFrame) -> tuple[DataFrame, Sizes]:
    """docs as (bucket, kind 1, doc_id, text, null) rows, and the parts and tasks of the exchanges.

    The bytes of a bucket grow with the root of all bytes, so that buckets times parts, the number of packed rows,
    stays in proportion to the input, up to 16 MB, so that a bucket always fits its task (a longer text stands alone).
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = int(np.clip(24 * np.sqrt(total), 1 << 17, 1 << 24))
    buckets = max(1, -(-total // size))
    parts = max(shuffle_partitions(docs.sparkSession), buckets // 4)
    id_ = F.col("doc_id").cast("long")
    bucket = F.pmod(F.xxhash64(F.coalesce(id_, F.xxhash64("text"))), F.lit(buckets))
    none = F.lit(None).cast("binary")
    rows = docs.select(bucket.alias("bucket"), F.lit(1).alias("kind"), id_.alias("doc_id"), "text", none.alias("blob"))
    return rows, Sizes(
        parts, max(shuffle_partitions(docs.sparkSession), total // TASK_BYTES), max(FILES, total // FILE_BYTES)
    )


TASK_BYTES = 1 << 23  # bytes of text for each task of an exchange
#: Bytes of text for each file of a table that is written behind one, and so many files at least (see common.few()).
FILE_BYTES, FILES = 1 << 24, 16


class Sizes(NamedTuple):
    """Parts of the key space, tasks over which buckets and parts are dealt, and files of a table that is written."""

    parts: int
    tasks: int
    files: int = FILES


def with_replies(rows: DataFrame, replies: DataFrame | None, sizes: Sizes) -> DataFrame:
    """The rows of each bucket together, its replies first."""
    if replies is not None:
        none = F.lit(None)
        rows = rows.union(replies.select("bucket", F.lit(0), none.cast("long"), none.cast("string"), "blob"))
    return rows.repartition(sizes.tasks, "bucket").sortWithinPartitions("bucket", "kind")


def parted(packed: DataFrame, tasks: int) -> DataFrame:
    return packed.repartition(tasks, "part").sortWithinPartitions("part")


def key48(key: np.ndarray) -> np.ndarray:
    return key >> np.uint64(17)


def repeated(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which runs (of equal keys, from first; with the doc_id of each place) have two places or more."""
    return np.diff(np.append(first, len(doc))) > 1


def between(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which runs more than one document holds."""
    return np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def offer_keys(units: Callable, k: int, L: int, parts: int):
    """Each distinct anchor key of a bucket, to the part it belongs to."""

    def handle(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [key48(s.key) for s in Bucket(held, units, k, L).slices]
        keys, many = np.unique(np.concatenate(every or [np.zeros(0, np.uint64)]), return_counts=True)
        if len(keys):
            yield packets(
                bucket, keys % np.uint64(parts), keys << np.uint64(1) | (many >= CROWD).astype(np.uint64), pack48
            )

    return by_key("bucket", handle)


def packed(leaves: tuple[np.ndarray, ...], texts: tuple[np.ndarray, ...]) -> bytes:
    """Leaves and their stretches, compressed, behind their number and size."""
    raw = b"".join([x.tobytes() for x in (*leaves, *texts)])
    return np.array([sum(map(len, leaves)), len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(blob, "<i8", 2)
    raw = pa.decompress(memoryview(blob)[16:], int(size), codec="zstd", asbytes=True)
    return np.frombuffer(raw, LEAF, n), np.frombuffer(raw, np.uint8, -1, n * LEAF.itemsize)


def deal(key: np.ndarray, hot: np.ndarray, start, size, place, values: np.ndarray, k: int, L: int, parts: int):
    """Where each stretch goes, as (which stretch, part).

    A stretch goes to the part of its key. Where a key is crowded with different surroundings it goes instead to a part
    for each of RANGES ranges of the place of a window around the anchor, by the units that all windows of the range
    hold; so two stretches that share a window through the anchor still meet, and the others of the key are spread. It
    goes to a part once, whichever of its ranges lead there: parts add up the places of what they get.
    """
    cold = np.flatnonzero(~hot)
    which, to = [cold], [key48(key[cold]) % np.uint64(parts)]
    hot = np.flatnonzero(hot)
    step = -(-(L - k + 1) // RANGES)
    width = L - step + 1
    hot = hot[np.argsort(place[hot])]
    for j in range(RANGES if len(hot) else 0):
        at = place[hot] - step * j
        fits = (at >= start[hot]) & (at + width <= start[hot] + size[hot])
        which.append(hot[fits])
        h = spans(values, at[fits], width)
        to.append(tk.mix(tk.mix(h + np.uint64(j)) ^ key[hot[fits]]) % np.uint64(parts))
    which, to = np.concatenate(which), np.concatenate(to)
    if not len(hot):
        return which, to
    order = np.lexsort((to, which))
    which, to = which[order], to[order]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (to[1:] != to[:-1])
    return which[new], to[new]


def offer_stretches(units: Callable, k: int, L: int, parts: int, shared: Callable, content: Callable):
    """Of each bucket: its distinct stretches around shared keys, with the smallest and the largest doc_id that holds
    each and the number of places.

    shared(docs, first) tells which runs of equal keys the bucket alone shares; content(slice, begin, end) gives the bytes
    of the units begin .. end, as one array with the size of each span.
    """

    def handle(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bucket(held, units, k, L)
        every = np.concatenate([np.zeros(0, np.uint64), *(key48(s.key) for s in b.slices)])
        if not len(every):
            return
        told = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack48(r) for r in b.replies)]))
        order, first, n = distinct(every)
        known = every[order[first]]
        wanted = shared(np.concatenate([s.id[s.doc] for s in b.slices])[order], first)
        wanted |= contained(known, told >> np.uint64(1))
        crowded = contained(known, told[(told & np.uint64(1)) == 1] >> np.uint64(1))
        flags = np.empty((2, len(every)), bool)
        flags[:, order] = np.repeat([wanted, crowded], n, axis=1)
        bounds = np.cumsum([0, *(len(s.key) for s in b.slices)])
        ids, docs, chosen = [], [], []
        for s, lo, hi in zip(b.slices, bounds[:-1], bounds[1:], strict=True):
            mine = np.flatnonzero(flags[0, lo:hi])
            chosen.append(mine)
            ids.append(s.names(mine, s.units()[0]))
            docs.append(s.id[s.doc[mine]])
        where = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        ids, docs, chosen = (np.concatenate(x) for x in (ids, docs, chosen))
        if not len(ids):
            return
        order, first, many = distinct(ids)
        low, high = np.minimum.reduceat(docs[order], first), np.maximum.reduceat(docs[order], first)
        pick = order[first]
        held_by = np.argsort(pick)  # stretches in the order of slices and places
        pick, low, high, many = pick[held_by], low[held_by], high[held_by], many[held_by]
        cuts = np.searchsorted(where[pick], np.arange(len(b.slices) + 1))
        pieces: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, s in enumerate(b.slices):
            mine = slice(cuts[i], cuts[i + 1])
            at = chosen[pick[mine]]
            if not len(at):
                continue
            hot = flags[1, bounds[i] + at]
            which, part = deal(
                s.key[at],
                hot,
                s.start[at],
                s.count[at] + L - 1,
                s.place[at],
                s.units()[0] if hot.any() else None,
                k,
                L,
                parts,
            )
            order = dealt(part)
            which, part = which[order], part[order]
            leaf = np.zeros(len(at), LEAF)
            leaf["low"], leaf["high"], leaf["many"], leaf["place"] = low[mine], high[mine], many[mine], s.place[at] - s.start[at]
            leaf, at = leaf[which], at[which]
            text, leaf["size"] = content(s, s.start[at], s.start[at] + s.count[at] + L - 1)
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            off = np.concatenate([[0], np.cumsum(leaf["size"], dtype=np.int64)])[edges].tolist()
            edges = edges.tolist()
            for j, to in enumerate(part[edges[:-1]].tolist()):
                pieces.setdefault(to, []).append((leaf[edges[j] : edges[j + 1]], text[off[j] : off[j + 1]]))
        blobs = [packed(*zip(*of, strict=True)) for of in pieces.values()]
        cols = [pa.array(list(pieces), pa.int64()), pa.array([bucket] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["part", "bucket", "blob"])

    return by_key("bucket", handle)


class Meeting:
    """The stretches that meet in a part, from all buckets: leaves, their owners and units; equal ones are one node."""

    def __init__(self, held: list[pa.RecordBatch], units: Callable, k: int, L: int):
        got = [
            (owner, *unpacked(blob.as_py())) for b in held for owner,
            blob in zip(b.column("bucket").to_numpy(), b.column("blob"), strict=True)
        ]
        self.leaf = np.concatenate([leaf for _, leaf, _ in got])
        self.text = np.concatenate([text for _, _, text in got])
        self.owner = np.repeat([owner for owner, _, _ in got], [len(leaf) for _, leaf, _ in got])
        size = self.leaf["size"].astype(np.int64)
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.units, self.bounds = units(self.text, self.off)
        self.start, self.size = self.bounds[:-1], np.diff(self.bounds)
        self.place = self.start + self.leaf["place"]
        self.key = tk.mix(spans(self.units, self.place, k) ^ KEY)
        self.name = names(self.units, self.start, self.size - L + 1, self.place, self.key, L)
        order, self.first, n = distinct(self.name)
        self.order = order
        self.model = order[self.first]  # a leaf of each node
        self.node = np.empty(len(self.leaf), np.int64)
        self.node[order] = np.repeat(np.arange(len(n)), n)
        model = self.model[self.node]
        if unequal(self.text, self.off[:-1], size, model) or (self.leaf["place"] != self.leaf["place"][model]).any():
            raise RuntimeError(COLLISION)

    def per_node(self, ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        return ufunc.reduceat(values[self.order], self.first)

    def kin(self) -> np.ndarray:
        """The nodes whose key other nodes have too, in the order of keys."""
        order, first, n = distinct(self.key[self.model])
        return order[np.repeat(n > 1, n)]

    def answer(self, node, low, first, last, group, many, all_: bool) -> Iterator[pa.RecordBatch]:
        """The runs of nodes (first to last window, at so many places) to the buckets of their members, or only to those
        that hold a document above the run's smallest."""
        by = np.argsort(node, kind="stable")
        runs = np.searchsorted(node[by], np.arange(len(self.model) + 1))
        per = np.diff(runs)[self.node]
        member = np.repeat(np.arange(len(self.leaf)), per)
        run = by[tk.ranges(runs[:-1][self.node], per)]
        keep = slice(None) if all_ else low[run] < self.leaf["high"][member]
        member, run = member[keep], run[keep]
        out = np.zeros(len(member), RUN)
        out["id"], out["group"], out["many"] = self.name[member], group[run], many[run]
        out["low"], out["first"], out["last"] = low[run], first[run], last[run]
        yield from answers(self.owner[member], out, lambda x: x.tobytes())


def marked(b: Bucket) -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
    """Of each slice: anchors, and for each a run that was told about its stretch."""
    runs = np.frombuffer(b"".join(b.replies), RUN)
    order, first, n = distinct(runs["id"].copy())
    runs = runs[order]
    ids = runs["id"][first]
    maybe = np.zeros(1 << FILTER, bool)  # by leading bits, so that most names are searched for only if they are there
    maybe[ids >> np.uint64(64 - FILTER)] = True
    seen = np.zeros((2, 0), np.uint64)  # names met in slices before, and an independent second name of each
    for s in b.slices:
        values, _ = s.units()
        every = s.names(np.arange(len(s.key)), values)
        hit = np.flatnonzero(maybe[every >> np.uint64(64 - FILTER)])
        own = np.searchsorted(ids, every[hit])
        same = ids[np.minimum(own, len(ids) - 1)] == every[hit] if len(ids) else np.zeros(0, bool)
        hit, own = hit[same], own[same]
        lo, size = first[own], n[own]
        order, heads, alike = distinct(own)
        model = np.empty(len(hit), np.int64)
        model[order] = np.repeat(order[heads], alike)
        if unequal(values, s.start[hit], s.count[hit] + s.L - 1, model):
            raise RuntimeError(COLLISION)
        if len(b.slices) > 1:
            at = np.sort(hit[order[heads]])
            seen = np.concatenate([seen, [every[at], s.names(at, tk.mix(values ^ P1))]], axis=1)
            seen = np.unique(seen, axis=1) if len(seen[0]) else seen
            if (seen[0][1:] == seen[0][:-1]).any():
                raise RuntimeError(COLLISION)
        yield s, np.repeat(hit, size), runs[tk.ranges(lo, size)]


def covered(s: Slice, anchor: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which units of the slice the runs cover."""
    edge = np.zeros(s.off[-1] + 1, np.int64)
    np.add.at(edge, s.start[anchor] + run["first"], 1)
    np.add.at(edge, s.start[anchor] + run["last"] + s.L, -1)
    return np.cumsum(edge)[:-1] > 0


def shared_stretches(
    rows: DataFrame, sizes: Sizes, units: Callable, k: int, L: int, shared: Callable, content: Callable
) -> tuple[DataFrame, DataFrame]:
    """Packets of the stretches around shared anchors, parted; and the table behind them, to discard when done."""
    keys = with_replies(rows, None, sizes).mapInArrow(offer_keys(units, k, L, sizes.parts), PACKET)
    few = min(sizes.files, sizes.tasks)  # keys are a fraction of the texts
    seeds = spill(parted(keys, few).mapInArrow(by_key("part", shared_keys), REPLY), "seeds", "none")
    offers = with_replies(rows, seeds, sizes).mapInArrow(
        offer_stretches(units, k, L, sizes.parts, shared, content), PACKET
    )
    return parted(offers, sizes.tasks), seeds
