"""Toxicity: boosted trees over dense features (lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates), calibrated by isotonic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from . import trees
from .common import chosen_texts, discard, fresh, held_out, in_slices, smallest, spill

#: Pronouns of the second person in the corpus' languages.
SECOND = """you your yours yourself u ur du dich dir dein deine ihr euch
tu te toi ton ta tes vous votre tú ti usted ustedes vosotros""".split()
#: Prefix lengths, in bytes, by which the lexicon knows word families; 0 is the word as a whole.
FAMILIES = (4, 5, 7, 0)
NEAR = 5
FOLDS = 3
#: Least leaf sizes of the trees that cross-validation chooses from.
LEAVES = (4, 10, 25)


def _letters() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


LETTER = _letters()
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!?@#$%&*+=_~^"]] = True


def parts(batch: pa.RecordBatch):
    """Bytes, offsets, letter words (starts, ends) and the number of words before each text."""
    data, off = tk.buffer(batch.column("text"))
    starts, ends = tk.spans(LETTER[data], off)
    return data, off, starts, ends, np.searchsorted(starts, off)


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each family the key of each word that is long enough: (words, keys)."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    code, lens = np.zeros(len(starts), np.uint64), ends - starts
    done = {}
    for j in range(max(FAMILIES)):
        code |= padded[starts + j].astype(np.uint64) << np.uint64(8 * j)
        done[j + 1] = code.copy() if j + 1 in FAMILIES else None
    for k in FAMILIES:
        if k:
            words = np.flatnonzero(lens >= k)
            yield words, tk.mix(done[k][words] + np.uint64(k * 0x1E3779B97F4A7C15 & (2**63 - 1)))
        else:
            words = np.flatnonzero(lens >= 3)
            yield words, tk.hash_spans(low, starts[words], ends[words])


def count_grams():
    """Of (part, text, toxic): how many toxic and other texts of the slice hold each gram (context 0), and for toxic
    texts each word that stands before a gram (context is its hash)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off, starts, ends, bounds = parts(batch)
        low = tk.LOWER[data]
        doc = np.searchsorted(off, starts, side="right") - 1
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        part = batch.column("part").to_numpy(zero_copy_only=False)
        word = tk.hash_spans(low, starts, ends)
        before = np.append(np.uint64(1), word[:-1]) | np.uint64(1)
        before[bounds[:-1][bounds[:-1] < len(word)]] = 1  # the first word of a text
        keys, words = (np.concatenate(x) for x in zip(*((k, w) for w, k in grams(low, starts, ends)), strict=True))
        docs = doc[words]

        def counted(keys, docs, context, bad, good):
            order = np.lexsort((context, keys, part[docs]))
            keys, docs, context, bad, good = (x[order] for x in (keys, docs, context, bad, good))
            if not len(keys):
                return [np.zeros(0, np.int64)] * 5
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (context[1:] != context[:-1]) | (part[docs[1:]] != part[docs[:-1]])
            first = np.flatnonzero(new)
            return part[docs[first]], keys[first].view(np.int64), context[first].view(np.int64), np.add.reduceat(bad, first), np.add.reduceat(good, first)

        order = np.lexsort((docs, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys[order].view(np.int64)) != 0) | (np.diff(docs[order]) != 0)
        once = order[new]
        one = toxic[docs[once]].astype(np.int64)
        own = np.flatnonzero(toxic[docs])
        none = np.zeros(len(own), np.int64)
        cols = [
            np.concatenate(x) for x in zip(
                counted(keys[once], docs[once], np.zeros(len(once), np.uint64), one, 1 - one),
                counted(keys[own], docs[own], before[words[own]], none, none),
                strict=True,
            )
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in cols], ["part", "gram", "context", "bad", "good"]
        )

    return in_slices(of)


FEATURES = 14


class Features:
    """Dense features of a slice of texts; the lexicon is a sorted array of gram keys with a weight each."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        second = [w.encode() for w in SECOND]
        blob = np.frombuffer(b"".join(second), np.uint8)
        ends = np.cumsum([len(w) for w in second])
        self.second = np.sort(tk.hash_spans(blob, ends - [len(w) for w in second], ends))

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        data, off, starts, ends, bounds = parts(batch)
        n, words = batch.num_rows, np.diff(bounds)
        low = tk.LOWER[data]
        weight = np.zeros(len(starts))
        whole = None
        for w, k in grams(low, starts, ends):
            whole = (w, k)
            near = np.flatnonzero(
                self.maybe[(k & np.uint64((1 << 20) - 1)).astype(np.int64)]
            ) if len(self.keys) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.keys, k[near]), max(0, len(self.keys) - 1))
            hit = self.keys[at] == k[near] if len(near) else np.zeros(0, bool)
            np.maximum.at(weight, w[near[hit]], self.weights[at[hit]])
        doc = np.repeat(np.arange(n), words)
        short = np.flatnonzero(ends - starts < 3)
        pronoun = np.zeros(len(starts), bool)
        pronoun[short] = np.isin(tk.hash_spans(low, starts[short], ends[short]), self.second)
        if whole is not None and len(whole[0]):
            pronoun[whole[0]] |= np.isin(whole[1], self.second)
        hits = np.flatnonzero(weight > 0)
        said = np.flatnonzero(pronoun)
        close = np.zeros(len(hits), bool)
        if len(said) and len(hits):
            at = np.searchsorted(said, hits)
            for j in (np.maximum(at - 1, 0), np.minimum(at, len(said) - 1)):
                close |= (np.abs(said[j] - hits) <= NEAR) & (doc[said[j]] == doc[hits])
        size = np.maximum(np.diff(off), 1)
        of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
        upper, letter, mark, digit = (data >= 65) & (data <= 90), LETTER[data], MARK[data], (data >= 48) & (data <= 57)
        inside = np.zeros(len(data), bool)  # digits and marks between letters
        if len(data) > 2:
            inside[1:-1] = (mark | digit)[1:-1] & letter[:-2] & letter[2:]
            inside[off[:-1][off[:-1] < len(data)]] = inside[off[1:][off[1:] > 0] - 1] = False  # not over a text's edge
        top = np.zeros(n)
        np.maximum.at(top, doc, weight)
        count = np.bincount(doc[hits], minlength=n)[:n]
        some = np.maximum(words, 1)
        total = np.bincount(doc, weight, minlength=n)[:n]
        near = np.bincount(doc[hits[close]], minlength=n)[:n]
        out = [
            count / some,
            total / some,
            top,
            np.minimum(count, 50),
            near / some,
            np.bincount(doc[said], minlength=n)[:n] / some,
            of(upper) / np.maximum(of(letter), 1),
            of(mark) / size,
            of(data == 33) / size,
            of(inside) / some,
            of(digit) / size,
            np.log1p(words),
            of(letter) / size,
            of(data == 10) / size,
        ]
        return np.stack(out, 1).astype(np.float64) if n else np.zeros((0, FEATURES))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` (doc_id, text, toxic, part, fold) of labelled documents that are not held out, by smallest hash.

    A document with several labels counts as toxic if any says so; null labels say nothing. A doc_id with several texts
    is one document, with one of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    known = known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))).withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    )
    there = spill(
        known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi"), "labelled"
    )
    chosen = smallest(there, [F.xxhash64("doc_id"), "doc_id"], most)
    out = spill(chosen_texts(docs, chosen, "doc_id"), "taught")
    discard(there)
    return out


class Scorer:
    """A fitted model: scores of a batch slice in 0 .. 1."""

    def __init__(self, features: Features, model: dict, knots: tuple[np.ndarray, np.ndarray]):
        self.features, self.model, self.knots = features, model, knots

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        m = trees.margin(self.model, self.features(batch))
        # the raw probability breaks ties between the steps of the calibration
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 / (1 + np.exp(-m)), 0, 1)


def lexicon_of(counts: DataFrame, totals: tuple[int, int], size: int, least: int) -> Features:
    """The `size` grams that mark toxic texts most surely: log-odds of three standard errors or more; their weight is
    the log-odds less one and a half standard errors.

    A gram's support is the number of toxic texts that hold it, or of the different words before it there if they are
    fewer, since copies of one text say a thing only once. It is `least` or more, and a hundredth of all toxic texts.
    """
    good, bad = totals
    by_context = counts.groupBy("gram", "context").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    by_gram = by_context.groupBy("gram").agg(
        F.sum("bad").alias("texts"), F.sum("good").alias("good"), F.count_if(F.col("context") != 0).alias("contexts")
    ).withColumn("bad", F.least("texts", "contexts"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    top = by_gram.where(F.col("bad") >= max(least, -(-bad // 100))).select(
        "gram", (odds - 1.5 * error).alias("weight")
    ).where((odds > 2) & (odds >= 3 * error)).orderBy(F.desc("weight"), "gram").limit(size).collect()
    return Features(
        np.array([r.gram for r in top], np.int64).view(np.uint64), np.array([r.weight for r in top], np.float64)
    )


def fit(docs: DataFrame, labels: DataFrame, most: int = 12000, lexicon: int = 1024, least: int = 3) -> Scorer:
    """Learn from a sample of at most `most` labelled rows (the bound of everything here that reaches the driver or is
    broadcast). The features that train the trees and the calibration are crossed: each half of the sample meets the
    lexicon of the other half, so that no text is judged by words it taught. The final lexicon is that of both. The
    least leaf size is the one of LEAVES with the smallest loss in cross-validation over the sample, and the calibration
    rests on the margins of rows by trees of the other folds. Held-out rows play no part in either."""
    chosen = sample(docs, labels, most)
    totals = {(r.part, r.toxic): r.n for r in chosen.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    grams_ = chosen.select("part", "text", "toxic").mapInArrow(
        count_grams(), "part long, gram long, context long, bad long, good long"
    )
    counts = spill(
        grams_.groupBy("part", "gram", "context").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "grams"
    )
    size = lambda *of: tuple(sum(totals.get((p, toxic), 0) for p in of) for toxic in (0, 1))
    halves = [lexicon_of(counts.where(F.col("part") == p), size(p), lexicon, least) for p in (0, 1)]
    features = lexicon_of(counts, size(0, 1), lexicon, least)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = batch.column("part").to_numpy()
        x = np.where((part == 0)[:, None], halves[1](batch), halves[0](batch))
        cols = [
            batch.column("doc_id"),
            batch.column("toxic"),
            batch.column("fold"),
            pa.array(list(x), pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "fold", "x"])

    got = sorted(chosen.mapInArrow(in_slices(rows), "doc_id long, toxic int, fold long, x array<double>").collect())
    discard(chosen)
    x = np.array([r.x for r in got]).reshape(-1, FEATURES)
    y = np.array([r.toxic for r in got], np.float64)
    if not len(y):
        return Scorer(features, {"base": -4.0, "trees": []}, (np.array([-4.0, 4.0]), np.array([0.02, 0.98])))
    fold = np.array([r.fold for r in got])
    best, apart = min((crossed(x, y, fold, least) for least in LEAVES), key=lambda found: found[0])[1:]
    return Scorer(features, trees.fit(x, y, least=best), trees.isotonic(apart, y))


def crossed(x: np.ndarray, y: np.ndarray, fold: np.ndarray, least: int) -> tuple[float, int, np.ndarray]:
    """Log loss of trees with that least leaf size on folds that didn't grow them, that size, and those margins."""
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any():
            apart[own] = trees.margin(trees.fit(x[~own], y[~own], least=least), x[own]) if not own.all() else 0.0
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -apart, apart)))), least, apart


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with a column `name`. A null text scores as an empty one. No other column is read."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = docs.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer(batch))], [*names, name])

    return docs.mapInArrow(in_slices(rows), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (null doc_ids too, which are never held out).

    Rows are scored one by one: repeated rows have equal scores, null texts score as empty ones, long texts as a whole.
    Without labels every score is small.
    """
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels, **options))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """docs without the rows that score threshold or more; the others, repeated ones too, with all their columns."""
    (name,) = fresh(docs, "score")
    return score(docs, fit(docs, labels, **options), name).where(F.col(name) < threshold).drop(name)
