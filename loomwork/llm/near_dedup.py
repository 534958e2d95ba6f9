"""Near-duplicates: SetSketch registers, banded and compared by joint likelihood, then verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import components, discard, fresh, in_slices, members_then_visitors, shuffle_partitions, spill, spread_join

REGISTERS, BANDS, ROWS = 160, 32, 5
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: A pair is dropped unverified if the likelihood of every similarity from the threshold on is exp(-SURE) of the best.
SURE = 14.0


def sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set (values[bounds[i]:bounds[i + 1]]), as (sets, REGISTERS) uint16.

    Every element draws one point from each of REGISTERS equally likely parts of an exponential distribution, in
    ascending order, for a register each (an affine permutation). A register keeps floor(1 - log_BASE(smallest point)).
    An element stops once its next point can't raise the smallest register of its set. Registers of a union are the
    maxima, and two sets' registers agree with about their Jaccard similarity.
    """
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.int32)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    seed, stride = tk.mix(values), tk.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    spot = (seed % np.uint64(PRIME)).astype(np.int64)
    stride = (stride % np.uint64(PRIME - 1)).astype(np.int64) + 1
    low, drawn = np.zeros(n, np.int32), 0
    for j in range(PRIME):
        if not len(seed):
            break
        seed = tk.mix(seed + np.uint64(0x9E3779B97F4A7C15))
        at, spot = spot, (spot + stride) % PRIME
        u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        x = -np.log1p(-(j + u) / PRIME) / RATE
        k = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.int32)
        go = k > low[owner]
        inside = go & (at < REGISTERS)
        np.maximum.at(flat, owner[inside] * REGISTERS + at[inside], k[inside])
        drawn += 1
        if drawn % 2 == 0 or j > 8:
            low = out.min(axis=1) if n else low
        seed, stride, spot, owner = seed[go], stride[go], spot[go], owner[go]
    return out.astype(np.uint16)


PRIME = 163  # so that an affine map permutes; points beyond REGISTERS are unused


def sketches():
    """Of (doc_id, fp, text): n_shingles, a 128-bit signature of the shingle set, and the registers."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = tk.buffer(batch.column("text"))
        _, _, word, bounds = tk.words(data, off, lower=True)
        values, at = tk.shingles(word, bounds, of.k)
        size = np.diff(at)
        pad = np.append(values, np.uint64(0))
        total = lambda x: np.where(
            size > 0, np.add.reduceat(x, np.minimum(at[:-1], len(values))), np.uint64(0)
        )
        registers = sketch(values, at)
        signature = (tk.long_array(total(tk.mix(pad * np.uint64(m) + np.uint64(m // 2)))) for m in (1, 3))
        cols = [
            batch.column("doc_id"),
            batch.column("fp"),
            pa.array(size.astype(np.int64)),
            *signature,
            pa.array([r.tobytes() for r in registers], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n_shingles", "s1", "s2", "registers"])

    return of


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rep, registers): a row (key, rep) for each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(
            b"".join(x.as_py() for x in batch.column("registers")), np.uint16
        ).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], regs.shape[:2]).copy()
        for j in range(ROWS):
            key = tk.mix(key * np.uint64(0x9FB21C651E98DF25) + regs[:, :, j])
        rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([tk.long_array(key.reshape(-1)), pa.array(rep)], ["key", "rep"])


def joint_likelihood(
    more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float
) -> np.ndarray:
    """Best log-likelihood of any similarity minus that of the best one of at least `threshold`, for register counts
    (greater, smaller, equal) of sets of known sizes. Infinite where the sizes alone rule the threshold out."""
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    at = np.linspace(0, 1, 101)[None, :]

    def best(low: np.ndarray) -> np.ndarray:
        s = low[:, None] + (most - low)[:, None] * at
        up, down = p(u[:, None] - v[:, None] * s), p(v[:, None] - u[:, None] * s)
        return (
            more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(
                np.maximum(1 - up - down, 1e-12)
            )
        ).max(axis=1)

    return np.where(most >= threshold, best(np.zeros_like(most)) - best(np.minimum(threshold, most)), np.inf)


def likely(threshold: float):
    """Keep the pairs (a, b, na, nb, ra, rb) that the registers don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ra, rb = (
                    np.frombuffer(
                        b"".join(x.as_py() for x in part.column(c)), np.uint16
                    ).reshape(-1, REGISTERS) for c in ("ra", "rb")
                )
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                gap = joint_likelihood(*counts_of(ra, rb), na, nb, threshold)
                keep = gap <= SURE
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"]
                )

    return run


def shingle_sets(k: int):
    """Of (rep, text): the sorted set as packed 64-bit hashes."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = tk.buffer(batch.column("text"))
        _, _, word, bounds = tk.words(data, off, lower=True)
        values, at = tk.shingles(word, bounds, k)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("rep"),
                pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            ],
            ["rep", "shingles"],
        )

    return in_slices(of)


def verify(percent: int):
    """Of (a, b, sa, sb): the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return run


def counts_of(ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1)


def compare_blocks(percent: int):
    """Visitors against the members of a block: of (place, kind 0 member or 1 visitor, rep, c, n, registers, shingles),
    the links (a, b) of visitors to members of other components, one for each visitor and component that it reaches.

    The block's members are held, visitors pass by. Sizes and registers rule most pairs out; the rest is counted
    exactly, over an index of the members' shingles.
    """

    def handle(block: pa.Table):
        cut = block.num_rows
        reps, cs, ns = (block.column(x).to_numpy() for x in ("rep", "c", "n"))
        mine = np.frombuffer(b"".join(block.column("registers").to_pylist()), np.uint16).reshape(cut, REGISTERS)
        tokens = np.frombuffer(b"".join(block.column("shingles").to_pylist()), np.uint64)
        owner = np.repeat(np.arange(cut), ns)
        order = np.argsort(tokens, kind="stable")
        owner = owner[order]
        known, first = np.unique(tokens[order], return_index=True)
        ends = np.append(first[1:], len(order))

        def visit(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            rep, c, n = (batch.column(x).to_numpy() for x in ("rep", "c", "n"))
            out = []
            for v in range(batch.num_rows):
                fair = (cs != c[v]) & (100 * np.minimum(ns, n[v]) >= percent * np.maximum(ns, n[v]))
                maybe = np.flatnonzero(fair)
                if not len(maybe):
                    continue
                own = np.frombuffer(batch.column("registers")[v].as_py(), np.uint16)[None, :]
                gap = joint_likelihood(
                    *counts_of(mine[maybe], own),
                    ns[maybe].astype(float),
                    np.full(len(maybe), float(n[v])),
                    percent / 100,
                )
                maybe = maybe[gap <= SURE]
                if not len(maybe):
                    continue
                x = np.frombuffer(batch.column("shingles")[v].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                at = at[known[at] == x]
                both = np.bincount(owner[tk.ranges(first[at], ends[at] - first[at])], minlength=cut)[maybe]
                hit = maybe[100 * both >= percent * (ns[maybe] + n[v] - both)]
                _, pick = np.unique(cs[hit], return_index=True)
                out += [(int(rep[v]), int(reps[m])) for m in hit[pick]]
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        return visit

    return members_then_visitors("place", handle)


#: Members, and visitors, that meet at one place. Each member of a cluster is sent to (members outside) / BLOCK places,
#: each of those outside to (all members) / BLOCK.
BLOCK = 512


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked when the Jaccard similarity of their sets of k-word shingles is at least percent / 100. Texts
    with equal sets are one class, and only its smallest doc_id goes on. Classes that share a band of registers are
    candidates. Each bucket has a hub, its class with the most neighbours in all buckets (of a family of edited copies
    that is the original or close to it), and all classes whose buckets have the same hub are a cluster. First every
    class is compared with its hubs: by the joint likelihood of their registers, then on full sets. Two classes that
    are in one component by then need no test. The others of a cluster visit all members of other components, in
    blocks, and only links leave the task. So a large group of copies costs a link or two for each member, and no pair
    that shares a band and could still join two components goes untested. With 32 bands of 5 registers a pair at 0.8
    shares none with a probability of 3e-6. A cluster whose members aren't similar costs the square of its size in
    comparisons, spread over its blocks; each task holds one block and streams the visitors.

    A null or blank text has an empty set and no links. A null doc_id is linked with nothing, its component is null
    and it is kept. Identical rows share a doc_id and so a component; all of them count as kept if one does. Of rows
    that share a doc_id but not the text, each is in the class of its own set; where the id stands for several classes,
    the set of the smallest signature is compared for it. Very long texts are sketched and compared as a whole.
    """
    spark = docs.sparkSession
    of = sketches()
    of.k = k
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")
    base = spill(
        named.mapInArrow(in_slices(of), "doc_id long, fp long, n_shingles long, s1 long, s2 long, registers binary"),
        "sketches",
    )
    signature = ["s1", "s2", "n_shingles"]
    some = base.where("doc_id is not null and n_shingles > 0")
    classes = spill(some.groupBy(signature).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    first = some.join(classes.select(*signature, F.col("rep").alias("doc_id")), [*signature, "doc_id"])
    first = first.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.struct(*signature, "fp", "registers")).alias("m"))
    reps = spill(
        first.select(
            "rep", F.col("m.n_shingles").alias("n"), F.col("m.fp").alias("fp"), F.col("m.registers").alias("registers")
        ),
        "reps",
    )
    rows = reps.select("rep", "registers").mapInArrow(band_rows, "key long, rep long")
    shared = rows.groupBy("key").agg(F.count("*").alias("n__")).where("n__ > 1").withColumn("size", F.col("n__"))
    rows = spill(spread_join(rows, shared, "key", BANDS * reps.count()), "bands")
    degree = rows.groupBy("rep").agg(F.sum("size").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("h")
    hubs = rows.join(degree, "rep").groupBy("key").agg(best, F.count("*").alias("n__")).select(
        "key", "n__", (-F.col("h.r")).alias("hub")
    )
    stars = spill(
        spread_join(
            rows.select("key", "rep"), hubs, "key", rows.count()
        ).where("rep != hub").select("hub", "rep").distinct(),
        "stars",
    )
    used = reps.join(rows.select("rep").distinct(), "rep", "left_semi")
    texts = named.where("text is not null").withColumnRenamed("doc_id", "rep").join(
        used.select("rep", "fp"), ["rep", "fp"], "left_semi"
    )
    sets = texts.select("rep", "text").mapInArrow(shingle_sets(k), "rep long, shingles binary").dropDuplicates(["rep"])
    own = spill(sets.join(used.drop("fp"), "rep"), "sets")

    left = own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    fair = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely_pairs = stars.select(
        F.col("hub").alias("a"), F.col("rep").alias("b")
    ).join(left, "a").join(right, "b").where(fair).mapInArrow(likely(percent / 100), "a long, b long")
    sized = likely_pairs.join(
        own.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b"
    ).join(own.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    links = spill(sized.mapInArrow(verify(percent), "a long, b long"), "links")
    label = spill(components(links), "labels")

    def labelled(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.join(
            label.select(F.col("id").alias(name), F.col("component").alias(f"{to}__")), name, "left"
        ).withColumn(to, F.coalesce(f"{to}__", name)).drop(f"{to}__")

    members = spill(
        labelled(stars.union(stars.select("hub", F.col("hub").alias("rep")).distinct()), "rep", "c"), "members"
    )
    # one hub may have a third of all classes: members of such hubs aren't dealt by hub, but told its facts
    n = members.count()
    sizes = members.groupBy("hub").agg(F.count("*").alias("n__"))
    apart = spread_join(members, labelled(sizes, "hub", "hc"), "hub", n).select(
        "hub", "rep", "c", (F.col("c") != F.col("hc")).alias("apart")
    )
    apart = spill(apart, "apart")
    sums = apart.groupBy("hub").agg(
        F.count("*").alias("n__"), F.count_if(~F.col("apart")).alias("inside"), F.count_if("apart").alias("outside")
    )
    sums = sums.where("outside > 0").select(
        "hub", "n__", F.ceil(F.col("inside") / BLOCK).alias("ib"), F.ceil(F.col("outside") / BLOCK).alias("ob")
    )
    clusters = spill(spread_join(apart, sums, "hub", n), "clusters")
    discard(members, apart)
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    home = F.when(F.col("apart"), F.col("ib") + block("ob")).otherwise(block("ib"))
    homes = clusters.withColumn("home", home)
    # a place is a block of members and a block of visitors, those of other components: each block of these meets all
    # blocks of the hub's component, and of the others those from itself on, so that each pair meets once
    blocks = F.sequence(F.lit(0).cast("long"), F.col("ib") + F.col("ob") - 1)
    outer = F.filter(blocks, lambda b: b >= F.col("ib"))
    meets = F.filter(outer, lambda v: (F.col("home") < F.col("ib")) | (v <= F.col("home")))
    visited = F.filter(blocks, lambda b: (b < F.col("ib")) | (b >= F.col("home")))
    row = ("hub", "rep", "c")
    dealt = homes.select(*row, F.lit(0).alias("kind"), F.col("home").alias("block"), F.explode(meets).alias("visitors"))
    visits = homes.where("apart").select(
        *row, F.lit(1).alias("kind"), F.explode(visited).alias("block"), F.col("home").alias("visitors")
    )
    placed = dealt.union(visits).select(
        F.xxhash64("hub", "block", "visitors").alias("place"), "kind", "rep", "c"
    ).join(own, "rep")
    met = placed.repartition(shuffle_partitions(spark), "place").sortWithinPartitions("place", "kind").mapInArrow(
        compare_blocks(percent), "a long, b long"
    )
    met = spill(met, "met")
    early, label = label, spill(components(links.union(met)), "labels")
    discard(early, rows, stars, own, links, met, clusters, reps)
    final = labelled(classes, "rep", "component")
    lone = final.where("copies = 1 and rep = component").select("rep")  # nothing to tell these documents
    told = final.join(lone, "rep", "left_anti").select(*signature, "component")
    out = base.select("doc_id", *signature).join(told, signature, "left")
    best = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select(
        "doc_id",
        "n_shingles",
        best.alias("component_id"),
        F.coalesce(F.col("doc_id") == best, F.lit(True)).alias("kept"),
    )
    out = spill(out, "groups")
    discard(base, classes, label)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of near-duplicate groups, but for the smallest doc_id of each; columns unchanged.

    Rows without a doc_id or a word are kept, and so are all rows that repeat a kept doc_id (see groups()).
    """
    (name,) = fresh(docs, "gone__")
    gone = groups(docs, k, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
