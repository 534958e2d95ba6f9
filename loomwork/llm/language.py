"""Language identification by string kernels: presence of byte n-grams up to a length (blended spectrum), Nystroem
landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import chosen_texts, first_of_each, held_out, in_slices

WIDTH = 1 << 15
ORDERS = (1, 2, 3)
SKIP = np.zeros(256, bool)  # digits, punctuation and blanks all read as one blank
SKIP[:128] = True
SKIP[65:91] = SKIP[97:123] = False
ROWS = 64


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0/1 matrix: which hashed n-grams of letters and blanks each whole text holds."""
    out = np.zeros((len(off) - 1, WIDTH), np.uint8)
    flat = out.reshape(-1)
    code = np.where(SKIP[data], np.uint8(32), tk.LOWER[data]).astype(np.uint64)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off)) * WIDTH
    gram = code
    for n in ORDERS:
        if n > 1:
            if len(code) < n:
                break
            gram = (gram[:-1] << np.uint64(8)) | code[n - 1 :]
        at = ((gram * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)
        inside = row[: len(gram)] == row[n - 1 :]
        flat[(row[: len(gram)] + at)[inside]] = 1
    return out


def lettered(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    plain = (((data | 32) >= 97) & ((data | 32) <= 122)).astype(np.int64)
    some = np.diff(np.concatenate([[0], np.cumsum(plain)])[off]) > 0
    for i in np.flatnonzero(~some & (np.diff(off) > 0)):
        some[i] = any(c.isalpha() for c in batch.column("text")[int(i)].as_py())
    return some


def packed():
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.packbits(presence(*tk.buffer(batch.column("text"))), axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())],
            ["doc_id", "lang", "bits"],
        )

    return in_slices(of)


class Identifier:
    """langs, and the weights of the hashed n-grams for each.

    The kernel of texts x, y is the number of n-grams both hold over the root of the product of their numbers. With
    landmarks L, the score of x is K(x, L) c for the ridge coefficients c of each language. K(x, L) is the batch's
    presence matrix times that of the landmarks, so the product of the latter with c is formed once and every batch
    costs one matrix product.
    """

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def __call__(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        data, off = tk.buffer(batch.column("text"))
        some = lettered(batch, data, off)
        n = batch.num_rows
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        for at in range(0, n, ROWS):
            part = off[at : at + ROWS + 1]
            x = presence(data[part[0] : part[-1]], part - part[0]).astype(np.float32)
            f = (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
            best[at : at + ROWS] = f.argmax(1)
            score[at : at + ROWS] = np.clip(f.max(1), 0, 1)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def fit(
    docs: DataFrame, per_language: int = 250, landmarks: int = 192, ridge: float = 1e-3, most: int = 4000
) -> Identifier:
    """Learn from at most per_language rows of each language and `most` in all (4 kB of packed presence bits each, the
    bound of what the driver gets), those of the smallest hash among rows with a text and a lang that are not held out.
    Rows that repeat a doc_id and lang are taken as one, with one of their texts."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")
    )
    known = named.where(
        "doc_id is not null and text is not null and lang is not null"
    ).where(~held_out()).select("doc_id", "lang")
    first = first_of_each(known, "lang", [F.xxhash64("doc_id"), "doc_id"], per_language)
    chosen = first.orderBy("rank", "lang").limit(most).select("doc_id", "lang").distinct()
    got = sorted(
        chosen_texts(named, chosen, "doc_id", "lang").mapInArrow(
            packed(), "doc_id long, lang string, bits binary"
        ).collect(),
    )
    langs = sorted({r.lang for r in got})
    if not got:
        return Identifier([], np.zeros((WIDTH, 0), np.float32))
    x = np.unpackbits(
        np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), -1), axis=1
    ).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[r.lang == lang for lang in langs] for r in got], np.float64)
    rng = np.random.default_rng(7)
    marks = x[np.sort(rng.choice(len(x), min(landmarks, len(x)), replace=False))]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nystroem map is K(x, L) root
    phi = (x @ marks.T) @ root
    w = np.linalg.solve(phi.T @ phi + ridge * len(x) * np.eye(phi.shape[1]), phi.T @ y)
    return Identifier(langs, (marks.T @ (root @ w)).astype(np.float32))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. A text that is null or has no letter is `und` with score 0;
    so is every text where no labelled row exists. Ties go to the language that sorts first. Rows are scored one by one,
    so repeated rows have equal scores, and texts of any length as a whole. Null doc_ids are never held out."""
    model = fit(docs, **options)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model(batch)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
        )

    said = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        in_slices(rows, most=1 << 19), "doc_id long, lang_pred string, score double"
    )
    return said.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
