"""Substring dedup by seed and extend: documents joined on winnowed anchors, matches extended both ways over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk
from .anchors import REPLY, Bucket, Meeting, bucketed, by_key, covered, marked, repeated, shared_stretches, with_replies
from .common import discard, spill

SEED_WORDS = 8


def word_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, bounds = tk.words(data, off, lower=False)
    return hashes, bounds


def content(s, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words begin .. end of each span, each followed by one blank."""
    data, off = tk.buffer(s.texts)
    starts, ends = tk.spans(~tk.SPACE[data], off)
    word = tk.ranges(begin, end - begin)
    size = ends[word] - starts[word] + 1
    last = np.cumsum(size) - 1
    at = tk.ranges(starts[word], size)
    out = data[np.minimum(at, len(data) - 1)]
    out[last] = 32
    total = np.concatenate([[0], np.cumsum(size)])
    bounds = np.concatenate([[0], np.cumsum(end - begin)])
    return out, np.diff(total[bounds])


def refined(label: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Labels of equal (label, word) pairs; both are below 2^31."""
    return np.unique(label << 32 | word, return_inverse=True)[1]


def extensions(
    word: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, many: np.ndarray, L: int
) -> np.ndarray:
    """Which windows of each stretch occur twice: (stretch, window) of the given stretches around seeds, whose words are
    given by number.

    All stretches are extended at once, a word at a time, from the seed to the right and to the left: two have the same
    label after j steps if they agree in the seed and the j words beyond it. An extent of L words that takes x words on
    the left and the rest on the right belongs to all stretches with both labels; it is kept if these stand at two or
    more places.
    """
    spare = L - SEED_WORDS
    before, after = place - start, start + size - place - SEED_WORDS
    label = np.zeros(len(start), np.int64)
    for j in range(SEED_WORDS):
        label = refined(label, word[place + j])
    right, left = [label], [label]
    for j in range(spare):
        beyond = place + SEED_WORDS + j
        right.append(refined(right[-1], np.where(after > j, word[np.minimum(beyond, len(word) - 1)] + 1, 0)))
        left.append(refined(left[-1], np.where(before > j, word[np.maximum(place - 1 - j, 0)] + 1, 0)))
    hits = []
    for x in range(spare + 1):
        fits = np.flatnonzero((before >= x) & (after >= spare - x))
        group = refined(left[x][fits], right[spare - x][fits])
        places = np.bincount(group, weights=many[fits]) if len(fits) else np.zeros(0)
        own = fits[places[group] > 1]
        hits.append(np.stack([own, before[own] - x]))
    return np.concatenate(hits, axis=1)


def numbered_words(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each word of the stretches, equal for equal words: exact, by a dictionary of their bytes."""
    starts, ends = tk.spans(~tk.SPACE[text], off)
    edges = np.append(starts, ends[-1] + 1) if len(starts) else np.zeros(1, np.int64)
    column = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(text)]
    )
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def extend(L: int):
    """Of the stretches that a part of the seeds has: the extents of L words or more that occur twice or more, as runs of
    windows, for the buckets that hold them."""

    def handle(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Meeting(held, word_units, SEED_WORDS, L)
        many = m.per_node(np.add, m.leaf["many"].astype(np.int64))
        # a stretch that stands at several places is an extent as a whole; others are extended if their seed is shared
        whole = np.flatnonzero(many > 1)
        node, first, last = [whole], [np.zeros(len(whole), np.int64)], [m.size[m.model[whole]] - L]
        kin = m.kin()
        if (many[kin] == 1).any():
            at = m.model[kin]
            own, window = extensions(numbered_words(m.text, m.off), m.start[at], m.size[at], m.place[at], many[kin], L)
            keep = many[kin][own] == 1
            own, window = own[keep], window[keep]
            order = np.lexsort((window, own))
            own, window = own[order], window[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1)
            begin = np.flatnonzero(new)
            if len(begin):
                end = np.append(begin[1:], len(own)) - 1
                node, first, last = [*node, kin[own[begin]]], [*first, window[begin]], [*last, window[end]]
        node, first, last = (np.concatenate(x) for x in (node, first, last))
        none = np.zeros(len(node), np.int64)
        yield from m.answer(node, none, first, last, none.astype(np.uint64), none, True)

    return by_key("part", handle)


def cut_repeats(L: int):
    """Of each bucket's texts and the extents that were found for its stretches: the words that remain."""

    def handle(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, anchor, run in marked(Bucket(held, word_units, SEED_WORDS, L)):
            gone = covered(s, anchor, run)
            data, off = tk.buffer(s.texts)
            starts, ends = tk.spans(~tk.SPACE[data], off)
            rows = []
            for i in range(len(s.id)):
                lo, hi = s.off[i], s.off[i + 1]
                keep = np.flatnonzero(~gone[lo:hi]) + lo
                if len(keep) == hi - lo:
                    left = b" ".join(s.texts[i].as_py().encode().split()) if hi > lo else b""
                else:
                    left = b" ".join(data[x:y].tobytes() for x, y in zip(starts[keep], ends[keep], strict=True))
                edges = np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]]))
                spans = (np.flatnonzero(edges == e).tolist() for e in (1, -1))
                rows.append((hi - lo, hi - lo - len(keep), hashlib.sha256(left).hexdigest(), *spans))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [s.ids, *cols], ["doc_id", "n_words", "n_removed", "kept_sha256", "from_word", "to_word"]
            )

    return by_key("bucket", handle)


CUTS = "doc_id long, n_words long, n_removed long, kept_sha256 string, from_word array<long>, to_word array<long>"


def repeats(docs: DataFrame, words: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the maximal repeats (from_word, to_word) of every row.

    A word goes if a run of `words` words that holds it starts anywhere else too, in the same text or another. Every
    row counts as a text of its own, repeated rows too; rows without a doc_id lose nothing and are held against
    nothing. Null texts have no words.

    Seeds are anchors of SEED_WORDS words, winnowed so that every window holds one; seeds found once fall away in a
    join of their keys. The words around the others meet by seed, each distinct surrounding once a bucket, crowded seeds
    dealt by deeper context. There the matches are extended from the seed, a word at a time, to the right and to the
    left, over the words themselves, and extents of `words` words or more are kept. Extents of successive seeds that
    touch make up the maximal repeats.
    """
    rows, sizes = bucketed(docs)
    stretches, seeds = shared_stretches(rows, sizes, word_units, SEED_WORDS, words, repeated, content)
    found = spill(stretches.mapInArrow(extend(words), REPLY), "extents")
    discard(seeds)
    out = spill(with_replies(rows, found, sizes).mapInArrow(cut_repeats(words), CUTS), "cuts")
    discard(found)
    return out
