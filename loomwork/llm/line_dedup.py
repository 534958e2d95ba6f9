"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order, to keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import tokens as tk
from .common import discard, fresh, in_slices, shuffle_partitions, spill

LINES = "h1 long, h2 long, back long, fp long, pos int, n_lines int"
FOUND = "kind int, h1 long, h2 long, doc_id long, fp long, pos int, n_lines int, n_docs long, top long"
#: Decisions about lines: surely dropped; dropped if documents beyond this partition suffice, or if one is larger; and
#: a summary of a run at the edge of a partition.
DROP, FEW, FIRST, SUMMARY = 0, 1, 2, 3


def hash_lines(min_chars: int):
    """Of (doc_id, fp, text): one row for each line whose stripped key has at least min_chars code points.

    back is -doc_id - 1, so that ascending order meets the largest document first.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, off = tk.buffer(batch.column("text"))
        starts, ends = tk.spans(~tk.SPACE[data], off)
        if not len(starts):
            return None
        breaks = np.flatnonzero(data == 10)
        doc = np.searchsorted(off, starts, side="right") - 1
        line = np.searchsorted(breaks, starts)  # line breaks before each word
        first = np.ones(len(starts), bool)
        first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        last = np.append(first[1:], True)
        begin, end, doc = starts[first], ends[last], doc[first]
        pos = line[first] - np.searchsorted(breaks, off[doc])
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = chars[end] - chars[begin] >= min_chars
        begin, end, doc, pos = begin[long], end[long], doc[long], pos[long]
        low = tk.LOWER[data]
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
        fp = batch.column("fp").to_numpy(zero_copy_only=False)[doc]
        n_lines = np.diff(np.searchsorted(breaks, off))[doc] + 1
        hashes = (tk.long_array(tk.hash_spans(low, begin, end, j)) for j in (0, 1))
        cols = [*hashes, pa.array(~ids), pa.array(fp), pa.array(pos, pa.int32()), pa.array(n_lines, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["h1", "h2", "back", "fp", "pos", "n_lines"])

    return in_slices(of)


def found_rows(kind, h1, h2, doc, fp, pos, n_lines, n_docs, top) -> pa.RecordBatch:
    k = len(h1)
    wide = lambda x, t: pa.array(np.ascontiguousarray(np.broadcast_to(x, k)), t)
    ints = [wide(kind, pa.int32()), *(wide(x, pa.int64()) for x in (h1, h2, doc, fp))]
    rest = [wide(pos, pa.int32()), wide(n_lines, pa.int32()), wide(n_docs, pa.int64()), wide(top, pa.int64())]
    return pa.RecordBatch.from_arrays(
        ints + rest, ["kind", "h1", "h2", "doc_id", "fp", "pos", "n_lines", "n_docs", "top"]
    )


def stream_runs(min_docs: int):
    """Walk sorted rows, a run for each hash, the largest document of it first; nothing is held but the rows of the
    first min_docs - 1 documents of the run that is open.

    A row goes if its document is not the first of its run and the run has min_docs documents. From the min_docs-th
    document on both are sure and rows leave at once, also where the run began in the partition before. A run at the
    edge of the partition may have more documents, and a larger first one, elsewhere: its earlier rows leave as FEW, or
    FIRST if they are of the first document here, with a summary row for the run.
    """
    sure = max(min_docs, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opening = None, True  # the open run, and whether the partition began with it
        docs, last, top = 0, 0, 0  # its documents so far, the one read last, the first
        held: list[list[np.ndarray]] = []  # its rows that wait for more documents, with their document's rank

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            h1, h2, back, fp, pos, n_lines, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            if edge:
                yield found_rows(np.where(rank == 1, FIRST, FEW), h1, h2, ~back, fp, pos, n_lines, 0, 0)
                one = np.zeros(1, np.int64)
                yield found_rows(SUMMARY, one + key[0], one + key[1], one, one, 0, 0, docs, ~top)
            elif docs >= min_docs and (rank > 1).any():
                gone = rank > 1
                yield found_rows(DROP, h1[gone], h2[gone], ~back[gone], fp[gone], pos[gone], n_lines[gone], 0, 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            h1, h2, back = cols[:3]
            n = len(h1)
            start = np.ones(n, bool)
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            start[0] = key != (h1[0], h2[0])
            new = start.copy()
            new[1:] |= back[1:] != back[:-1]
            if not start[0]:
                new[0] = back[0] != last
            first = np.flatnonzero(start)
            seen = np.cumsum(new)
            base = np.zeros(n, np.int64)  # documents before each row's run, those carried over counted as after it
            edges = np.append(first, n)
            base[: edges[0]] = -docs
            base[edges[0] :] = np.repeat(seen[first] - 1, np.diff(edges))
            rank = seen - base
            gone = rank >= sure
            if gone.any():
                yield found_rows(DROP, *(c[gone] for c in (h1, h2)), ~back[gone], *(c[gone] for c in cols[3:]), 0, 0)
            early = ~gone
            pick = lambda lo, hi: [c[lo:hi][early[lo:hi]] for c in (*cols, rank)]
            if edges[0]:  # the open run goes on
                held.append(pick(0, edges[0]))
                docs = int(rank[edges[0] - 1])
            if len(first):
                if key is not None:
                    yield from close(opening)
                    opening = False
                # runs that begin and end in this batch
                inner = slice(first[0], first[-1])
                total = np.repeat(np.maximum.reduceat(rank, first), np.diff(edges))
                cut = early[inner] & (rank[inner] > 1) & (
                    total[inner.start - first[0] : inner.stop - first[0]] >= min_docs
                )
                if cut.any():
                    part = [c[inner][cut] for c in cols]
                    yield found_rows(DROP, part[0], part[1], ~part[2], *part[3:], 0, 0)
                if opening and first[-1] > first[0]:  # the partition's first run ended here: it may have begun before
                    to = edges[1]
                    part = [c[first[0] : to][early[first[0] : to]] for c in (*cols, rank)]
                    own = part[-1] == 1
                    if own.any():
                        part = [c[own] for c in part]
                        yield found_rows(FIRST, part[0], part[1], ~part[2], *part[3:6], 0, 0)
                    if total[0] < min_docs:
                        part = [c[first[0] : to][early[first[0] : to] & (rank[first[0] : to] > 1)] for c in cols]
                        if len(part[0]):
                            yield found_rows(FEW, part[0], part[1], ~part[2], *part[3:], 0, 0)
                    one = np.zeros(1, np.int64)
                    yield found_rows(
                        SUMMARY, one + h1[first[0]], one + h2[first[0]], one, one, 0, 0, int(total[0]), ~back[first[0]]
                    )
                    opening = False
                held = [pick(first[-1], n)]
                docs, top = int(rank[-1]), back[first[-1]]
                key = (h1[-1], h2[-1])
            last = back[-1]
        if held:
            yield from close(True)

    return run


def pack(n: int, dropped: np.ndarray) -> bytes:
    """A compressed bitmap of n lines, 1 for those that stay."""
    bits = np.ones(n, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(n: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


BITMAPS = "doc_id long, fp long, n_lines int, n_dropped int, keep_bitmap binary"


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of dropped lines (doc_id, fp, n_lines, pos) in the order of documents: one keep bitmap for each document. Only
    the document that is open is held, as a mask of its lines."""
    now, mask, rows = None, np.zeros(0, bool), []

    def done() -> None:
        rows.append((*now, int(mask.sum()), pack(now[2], mask)))

    def table() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n_lines", "n_dropped", "keep_bitmap"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, fp, n_lines, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(doc)], strict=True):
            own = (int(doc[lo]), int(fp[lo]), int(n_lines[lo]))
            if own != now:
                if now is not None:
                    done()
                now, mask = own, np.zeros(own[2], bool)
            mask[pos[lo:hi]] = True
        if len(rows) > 1000:
            yield table()
            rows = []
    if now is not None:
        done()
        yield table()


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents that lose lines, as (doc_id, fp, n_lines, n_dropped, keep_bitmap): a compressed bitmap of the lines,
    1 for those that stay; fp is xxhash64 of the text. No text is returned.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. A key of at least min_chars
    code points that min_docs documents hold keeps its lines in the largest doc_id only. Rows without a doc_id or a
    text hold no lines here. Rows that share a doc_id count as one document; identical rows get the same bitmap.
    Lines are hashed once and written; range partitioning of that table by (hash, document), sorted by position too,
    splits a very common line over as many partitions as its rows need.
    """
    spark = docs.sparkSession
    some = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp"), "text"
    )
    lines = spill(some.mapInArrow(hash_lines(min_chars), LINES), "hashed")
    order = ["h1", "h2", "back"]
    runs = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "pos")
    found = spill(runs.mapInArrow(stream_runs(min_docs), FOUND), "lines")
    discard(lines)
    # at most two summaries for each partition, so this side has a fixed bound
    sums = (F.sum("n_docs").alias("total"), F.max("top").alias("largest"))
    edges = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(*sums).where(F.col("total") >= min_docs)
    late = found.where(F.col("kind").isin(FEW, FIRST)).join(F.broadcast(edges), ["h1", "h2"]).where(
        f"kind = {FEW} or doc_id < largest"
    )
    columns = ["doc_id", "fp", "n_lines", "pos"]
    gone = found.where(F.col("kind") == DROP).select(columns).union(late.select(columns))
    placed = gone.repartition(shuffle_partitions(spark), "doc_id", "fp").sortWithinPartitions("doc_id", "fp")
    out = spill(placed.mapInArrow(bitmaps, BITMAPS), "bitmaps")
    discard(found)
    return out


def kept_text(text: str | None, n_lines: int | None, bitmap: bytes | None) -> tuple[int, str | None]:
    """Lines before dropping, and the text of those that stay; a text without a bitmap is returned as it is."""
    if text is None or bitmap is None:
        return 1 if not text else text.count("\n") + 1, text
    return n_lines, "\n".join(x for x, k in zip(text.split("\n"), unpack(n_lines, bitmap), strict=True) if k)


def with_bitmaps(docs: DataFrame, keep: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the columns n_lines, n_dropped and keep_bitmap of its document, null where nothing goes, under names
    that docs doesn't have; and these names."""
    fp, id_, f, *new = fresh(docs, "fp__", "id__", "f__", "n_lines__", "n_dropped__", "keep__")
    told = [F.col(c).alias(n) for c, n in zip(("n_lines", "n_dropped", "keep_bitmap"), new, strict=True)]
    right = keep.select(F.col("doc_id").alias(id_), F.col("fp").alias(f), *told)
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.col(fp) == F.col(f))
    return docs.withColumn(fp, F.xxhash64("text")).join(right, same, "left").drop(fp, id_, f), new


DIGESTS = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary"


def line_digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and keep_bitmap (null where nothing goes) of every row of docs.

    Null and empty texts are one empty line. See keep_bitmaps() for the rule, rows without a doc_id and repeated rows.
    """
    keep = keep_bitmaps(docs, min_chars, min_docs)
    both, new = with_bitmaps(docs.select(F.col("doc_id").cast("long"), "text"), keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, n, gone, bitmap in zip(*(batch.column(c) for c in ("text", *new)), strict=True):
                lines, left = kept_text(text.as_py(), n.as_py(), bitmap.as_py())
                rows.append((lines, gone.as_py() or 0, hashlib.sha256((left or "").encode()).hexdigest()))
            cols = [
                pa.array(c, t) for c,
                t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)
            ]
            if rows:
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, batch.column(new[2])], names)

    out = spill(both.mapInArrow(run, DIGESTS), "digests")
    discard(keep)
    return out


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the repeated lines gone from text, every other column and row as it was.

    Null and empty texts stay as they are, as does a text that loses nothing; one that loses all lines becomes empty.
    Rows without a doc_id lose nothing, rows that share one are one document (see keep_bitmaps()).
    """
    names = docs.columns
    both, new = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(batch.column(c) for c in ("text", new[0], new[2])), strict=True)
            left = pa.array([kept_text(t.as_py(), n.as_py(), b.as_py())[1] for t, n, b in told], pa.string())
            yield pa.RecordBatch.from_arrays([left if c == "text" else batch.column(c) for c in names], names)

    schema = StructType(
        [StructField(f.name, StringType(), True) if f.name == "text" else f for f in docs.schema.fields]
    )
    return both.mapInArrow(run, schema)
