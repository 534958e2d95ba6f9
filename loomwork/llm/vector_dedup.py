"""Embedding near-dedup by an inverted multi-index: codebooks on the two halves of unit vectors make a grid of cells;
each vector visits its nearest cells in multi-sequence order up to a calibrated number, and links are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .anchors import by_key
from .common import components, discard, members_then_visitors, shuffle_partitions, smallest, spill

MOST_CODES = 4096  # codes of a half; cells are at most its square
BLOCK_BYTES = 1 << 24  # vectors of a cell that a task holds at a time
VISITORS = 1024  # vectors that are compared with these at a time
QUERIES = 512  # vectors that a task compares with a batch at a time
EVERY = 8192  # vectors that go to all tasks at a time where all pairs are compared
VECTOR = "rep long, weight long, v binary"


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (vec_id, embedding): the usable vectors, their dimension, a 128-bit hash of each and its float64 bytes.

    Null, empty and zero vectors, and those with null or non-finite components, are left out.
    """
    for batch in batches:
        by_dim: dict[int, list] = {}
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is not None and v and None not in v:
                by_dim.setdefault(len(v), []).append((i, v))
        for dim, some in by_dim.items():
            ids, x = [i for i, _ in some], np.array([v for _, v in some], np.float64)
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(axis=1, initial=0)
                fine = np.isfinite(x).all(axis=1) & (scale > 0)
            x, ids = x[fine] + 0.0, np.array(ids, np.int64)[fine]
            if not len(x):
                continue
            flat = np.ascontiguousarray(x).view(np.uint8).reshape(-1)
            at = np.arange(len(x), dtype=np.int64) * 8 * dim
            hashes = (tk.long_array(tk.hash_spans(flat, at, at + 8 * dim, j)) for j in (0, 1))
            y = x / scale[fine][:, None]
            y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
            cols = [
                pa.array(ids),
                pa.array(np.full(len(x), dim, np.int32)),
                *hashes,
                pa.array([r.tobytes() for r in y], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "h1", "h2", "v"])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of x by Lloyd's iterations from distinct random rows."""
    rng = np.random.default_rng(11)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = squares(x, centres).argmin(axis=1)
        for j in np.unique(near):
            centres[j] = x[near == j].mean(axis=0)
    return centres


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.dim, self.cut = sample.shape[1], sample.shape[1] // 2
        self.books = codebook(sample[:, : self.cut], codes), codebook(sample[:, self.cut :], codes)
        self.width = len(self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.cut], self.books[0]), squares(x[:, self.cut :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.width + b.argmin(1)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row by the sum of the halves' distances (multi-sequence order).

        With both halves' codes in ascending order the r-th nearest cell is among those whose places i, j (from 1)
        have i * j <= r, so only that staircase is looked at.
        """
        a, b = self.distances(x)
        oa, ob = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        i = np.repeat(np.arange(a.shape[1]), [min(b.shape[1], n // (r + 1)) for r in range(a.shape[1])])
        j = np.concatenate([np.arange(min(b.shape[1], n // (r + 1))) for r in range(a.shape[1])])
        total = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        pick = np.argsort(total, 1, kind="stable")[:, :n]
        return np.take_along_axis(oa[:, i], pick, 1) * self.width + np.take_along_axis(ob[:, j], pick, 1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of each given cell in the order of the one row x."""
        a, b = (d[0] for d in self.distances(x[None, :]))
        own, sort = a[cells // self.width] + b[cells % self.width], np.sort(b)
        return np.array([int(np.searchsorted(sort, o - a, "left").sum()) for o in own]) + 1


def neighbour_ranks(grid: Grid, ids: np.ndarray, queries: np.ndarray, threshold: float):
    """Of all vectors: how many true neighbours of each query lie at which rank, in steps of about a fifth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rep = matrix(batch.column("v"), grid.dim), batch.column("rep").to_numpy()
            cells = grid.cells(x)
            for at in range(0, len(ids), QUERIES):
                part = slice(at, at + QUERIES)
                hit = (x @ queries[part].T >= threshold) & (rep[:, None] != ids[None, part])
                for q in np.flatnonzero(hit.any(axis=0)):
                    cell, many = np.unique(cells[hit[:, q]], return_counts=True)
                    steps = np.ceil(np.log(grid.ranks(queries[at + q], cell)) / np.log(1.2)).astype(np.int64)
                    step, place = np.unique(steps, return_inverse=True)
                    n = np.bincount(place, weights=many).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(step), ids[at + q])), pa.array(step), pa.array(n)], ["query", "step", "n"]
                    )

    return run


def least_step(found: dict[int, dict[int, int]], which: list[int], target: float) -> int:
    """The least step up to which the queries find the target share of their neighbours, each query weighing the same."""
    shares: dict[int, float] = {}
    for q in which:
        total = sum(found[q].values())
        for step, n in found[q].items():
            shares[step] = shares.get(step, 0.0) + n / total / len(which)
    seen = 0.0
    for step in sorted(shares):
        seen += shares[step]
        if seen >= target - 1e-9:
            break
    return step


def calibrated(
    reps: DataFrame,
    grid: Grid,
    ids: np.ndarray,
    x: np.ndarray,
    n: int,
    threshold: float,
    target: float,
    queries: int,
    enough: int,
) -> int | None:
    """Cells to visit, or None if the drawn classes (ids, x) have too few neighbours to tell.

    Queries are drawn, twice as many each time, until `enough` of them have neighbours and are no neighbours of each
    other: a large group, however many queries fall into it, tells nothing about the others. The target holds both for
    these and for all queries with neighbours. If all n classes are drawn, every rank is known and all of them count.
    """
    found: dict[int, dict[int, int]] = {}
    alone: list[int] = []
    at = 0
    while at < len(ids):
        to = max(queries, 2 * at)
        part = reps.select("rep", "v").mapInArrow(
            neighbour_ranks(grid, ids[at:to], x[at:to], threshold), "query long, step long, n long"
        )
        for r in part.groupBy("query", "step").agg(F.sum("n").alias("n")).collect():
            found.setdefault(r["query"], {})[r.step] = r.n
        for i in range(at, min(to, len(ids))):
            if int(ids[i]) in found and not (x[alone] @ x[i] >= threshold).any():
                alone.append(i)
        at = to
        if len(ids) < n and len(alone) >= enough:
            break
    else:
        if len(ids) < n:
            return None
        target = 1.0
    step = max(
        (least_step(found, which, target) for which in (list(found), [int(ids[i]) for i in alone]) if which), default=0
    )
    return min(2 * int(np.ceil(1.2**step)) + 1, grid.width * len(grid.books[0]))


class Blocks:
    """How many blocks each cell has: 1 but for the crowded cells, which are listed."""

    def __init__(self, cells: np.ndarray, blocks: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.blocks = cells[order], blocks[order]

    def __getitem__(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.ones(cell.shape, np.int64)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.blocks[at], 1)


def dealt(grid: Grid, n: int, blocks: Blocks):
    """Of the vectors: a row for the block of its own cell (kind 0), and one for each block of each visited cell (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, rep = matrix(batch.column("v"), grid.dim), batch.column("rep").to_numpy()
                cell, visit = grid.cells(x), grid.visits(x, n)
                lists = [r.tobytes() for r in np.sort(visit, 1).astype(np.int32)]
                many = blocks[visit]
                row = np.repeat(np.arange(len(x)), many.sum(1))
                to = np.repeat(visit.reshape(-1), many.reshape(-1))
                part = tk.ranges(np.zeros(many.size, np.int64), many.reshape(-1).astype(np.int64))
                own = (tk.mix(rep.astype(np.uint64)) % blocks[cell].astype(np.uint64)).astype(np.int64)
                order = np.concatenate([np.arange(len(x)), row])
                kind = np.concatenate([np.zeros(len(x), np.int32), np.ones(len(row), np.int32)])
                place = np.concatenate([cell, to]) * BLOCK_KEYS + np.concatenate([own, part])
                take = pa.array(order)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place),
                        pa.array(kind),
                        batch.column("rep").take(take),
                        batch.column("weight").take(take),
                        batch.column("v").take(take),
                        pa.array(cell[order]),
                        pa.array(lists, pa.binary()).take(take),
                    ],
                    ["place", "kind", "rep", "weight", "v", "cell", "visits"],
                )

    return run


BLOCK_KEYS = 1 << 32


def rows(a: np.ndarray, n: np.ndarray, b: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (a.astype(np.int64), n.astype(np.int64), b.astype(np.int64), kind)],
        ["id", "n", "other", "edge"],
    )


def connecting(group: np.ndarray, own: np.ndarray, ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the links (own x ids) without those that repeat a connection within the group labels, which they join."""
    links = []
    for q, row in zip(own, link, strict=True):
        to = np.flatnonzero(row)
        labels, first = np.unique(group[to], return_index=True)
        links += [(int(q), int(ids[m])) for m in to[first]]
        if len(labels) > 1:
            group[np.isin(group, labels)] = labels[0]
    return links


def against_all(dim: int, threshold: float, own: np.ndarray, x: np.ndarray):
    """Given vectors against all: the credits and connecting edges of compare(), credited to the given vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, ids, weight = matrix(batch.column("v"), dim), batch.column("rep").to_numpy(), batch.column("weight").to_numpy()
            group = np.arange(len(ids))
            for at in range(0, len(own), QUERIES):
                mine = own[at : at + QUERIES]
                link = (x[at : at + QUERIES] @ y.T >= threshold) & (mine[:, None] != ids[None, :])
                some = np.flatnonzero(link.any(axis=1))
                if not len(some):
                    continue
                mine, link = mine[some], link[some]
                yield rows(mine, link @ weight, np.zeros(len(some), np.int64), np.zeros(len(some), np.int32))
                a, b = np.array(connecting(group, mine, ids, link)).T
                yield rows(a, np.zeros(len(a), np.int64), b, np.ones(len(a), np.int32))

    return run


LINKS = "id long, n long, other long, edge int"


def all_pairs(reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """The links of all pairs: EVERY vectors at a time pass through the driver to all tasks, so nothing is shuffled."""
    out, held = None, []

    def block() -> DataFrame:
        own, x = np.array([r.rep for r in held], np.int64), np.frombuffer(
            b"".join(bytes(r.v) for r in held), np.float64
        ).reshape(-1, dim)
        met = spill(reps.mapInArrow(against_all(dim, threshold, own, x), LINKS), "links")
        return met if out is None else out.union(met)

    for row in reps.select("rep", "v").toLocalIterator():
        held.append(row)
        if len(held) == EVERY:
            out, held = block(), []
    return block() if held else out


def compare(dim: int, threshold: float):
    """Visitors of a block against its members: credits (id, n) of links, and edges (id, other) that connect them.

    A link is credited to the visitor, and also to the member if the member doesn't visit the visitor's cell itself.
    Edges that only repeat a connection within the block are left out.
    """

    def handle(block: pa.Table):
        pick = lambda name: block.column(name).combine_chunks()
        cut = block.num_rows
        y, ids, weight = matrix(pick("v"), dim), pick("rep").to_numpy(), pick("weight").to_numpy()
        known = np.frombuffer(b"".join(pick("visits").to_pylist()), np.int32).reshape(cut, -1)
        group, credit = np.arange(cut), np.zeros(cut, np.int64)

        def visit(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                late = np.flatnonzero(credit)
                yield rows(ids[late], credit[late], np.zeros(len(late), np.int64), np.zeros(len(late), np.int32))
                return
            for at in range(0, batch.num_rows, VISITORS):
                part = batch.slice(at, VISITORS)
                x = matrix(part.column("v"), dim)
                own, w, cell = (part.column(c).to_numpy() for c in ("rep", "weight", "cell"))
                link = (x @ y.T >= threshold) & (own[:, None] != ids[None, :])
                some = np.flatnonzero(link.any(axis=1))
                if not len(some):
                    continue
                link = link[some]
                yield rows(own[some], link @ weight, np.zeros(len(some), np.int64), np.zeros(len(some), np.int32))
                for c in np.unique(cell[some]):
                    mine = cell[some] == c
                    away = ~(known == c).any(axis=1)
                    credit[:] += np.where(away, link[mine].T @ w[some][mine], 0)
                a, b = np.array(connecting(group, own[some], ids, link)).T
                yield rows(a, np.zeros(len(a), np.int64), b, np.ones(len(a), np.int32))

        return visit

    return members_then_visitors("place", handle)


def cell_pairs(reps: DataFrame, grid: Grid, visits: int, threshold: float) -> DataFrame:
    """The links that the visited cells hold."""

    def cell_rows(batches):
        for batch in batches:
            cell, many = np.unique(grid.cells(matrix(batch.column("v"), grid.dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int64)), pa.array(many.astype(np.int64))], ["cell", "n"]
            )

    size = max(256, BLOCK_BYTES // (8 * grid.dim))
    sizes = reps.select("v").mapInArrow(cell_rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    crowded = sizes.where(F.col("n") > size).collect()  # a bounded share of the rows: one for each `size` of them at most
    blocks = Blocks(
        np.array([r.cell for r in crowded], np.int64), np.array([-(-r.n // size) for r in crowded], np.int64)
    )
    rows = reps.mapInArrow(
        dealt(grid, visits, blocks), "place long, kind int, rep long, weight long, v binary, cell long, visits binary"
    )
    return spill(
        rows.repartition(
            shuffle_partitions(reps.sparkSession), "place"
        ).sortWithinPartitions("place", "kind").mapInArrow(compare(grid.dim, threshold), LINKS),
        "links",
    )


SMALL = 4096  # up to so many classes of one dimension are compared in one task, all with all


def within(threshold: float):
    """All pairs of the classes of one dimension, in blocks: of rows (dim, rep, weight, v) sorted by dim."""

    def handle(dim: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        x = matrix(block.column("v").combine_chunks(), dim)
        own = block.column("rep").to_numpy()
        yield from against_all(dim, threshold, own, x)(iter(block.combine_chunks().to_batches()))

    return by_key("dim", handle)


def links_of(
    reps: DataFrame,
    dim: int,
    n: int,
    codes: int | None,
    sample: int,
    queries: int,
    enough: int,
    threshold: float,
    target: float,
) -> DataFrame:
    """The links among the n classes of one dimension, by an index of their own."""
    codes = codes or int(np.clip(np.sqrt(n / 48), 2, MOST_CODES))
    chosen = smallest(reps, [F.xxhash64("rep"), "rep"], max(sample, 2 * codes)).collect()
    x = np.frombuffer(b"".join(bytes(r.v) for r in chosen), np.float64).reshape(-1, dim)
    grid = Grid(x, codes)
    visits = calibrated(
        reps, grid, np.array([r.rep for r in chosen], np.int64), x, n, threshold, target, queries, enough
    )
    return all_pairs(reps, dim, threshold) if visits is None else cell_pairs(reps, grid, visits, threshold)


def groups(
    vectors: DataFrame,
    threshold: float = 0.9,
    target_recall: float = 0.999,
    codes: int | None = None,
    sample: int = 8192,
    queries: int = 512,
    enough: int = 256,
    small: int = SMALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with a vec_id; a null vec_id keeps its row with no links.

    Vectors of any scale are compared by cosine in double precision, each dimension apart. Equal vectors are one class,
    whose members are linked with each other. Dimensions of up to `small` classes are compared whole, a task for each;
    the classes of any other are indexed, all of them. Codebooks come from at most `sample` classes (twice the number of
    codes, if that is more). The number of cells to visit is twice the least that finds target_recall of the true
    neighbours of sampled classes, which are compared with all others, `queries` at first and up to `sample` (see
    calibrated()); a link found from either side counts for both, so the recall of links is higher. If fewer than
    `enough` unrelated ones of the sample have neighbours, all pairs are compared instead and no link is missed, at a
    cost that grows with the square of the classes. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. A repeated vec_id with equal vectors is one vector; one with different vectors is
    linked as each of them.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = base.mapInArrow(
        unit_rows, "vec_id long, dim int, h1 long, h2 long, v binary"
    ).dropDuplicates(["vec_id", "dim", "h1", "h2"])
    usable = spill(usable, "vectors")
    key = ["dim", "h1", "h2"]
    sizes = usable.groupBy(key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    reps = spill(
        usable.withColumnRenamed("vec_id", "rep").join(sizes, [*key, "rep"]).select("dim", "rep", "weight", "v"),
        "classes",
    )
    per_dim = reps.groupBy("dim").count()
    many = {  # one for each `small` rows at most
        r.dim: r["count"] for r in per_dim.where(F.col("count") > small).collect()
    }
    few = reps.where(~F.col("dim").isin(*many)) if many else reps
    few = few.repartition(shuffle_partitions(few.sparkSession), "dim").sortWithinPartitions("dim")
    met = small_links = spill(few.mapInArrow(within(threshold), LINKS), "links")
    for dim, n in sorted(many.items()):
        own = reps.where(F.col("dim") == dim).select("rep", "weight", "v")
        met = met.union(links_of(own, dim, n, codes, sample, queries, enough, threshold, target_recall))
    degree = met.where("edge = 0").groupBy("id").agg(F.sum("n").alias("n"))
    label = components(met.where("edge = 1").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = usable.select("vec_id", *key).join(sizes, key).join(
        degree.withColumnRenamed("id", "rep"), "rep", "left"
    ).join(label.withColumnRenamed("id", "rep"), "rep", "left")
    linked = named.groupBy(F.col("vec_id").alias("id__")).agg(
        F.max(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
        F.min(F.coalesce("component", "rep")).alias("c"),
    )
    out = base.select("vec_id").join(linked, F.col("vec_id") == F.col("id__"), "left")
    out = out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(True)).alias("kept"),
    )
    out = spill(out, "groups")
    discard(usable, reps, small_links)
    return out
