"""Line, near, suffix and substring dedup, and decontamination, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomwork.llm import common, decontaminate, line_dedup, near_dedup, substring_dedup, suffix_dedup

from . import brute

DOCS = "doc_id long, text string, lang string, gone__ string, fp__ string, n int"


def corpus(seed=1, n=60):
    """Random texts with exact and near copies, shared passages and lines, ties, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfg") + rng.choice("aeiouäß") + rng.choice(["n", "r", "st", ""]) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages, lines = [prose(60), prose(45), prose(36)], [prose(8), prose(6).upper(), "short"]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        text = " ".join(parts)
        for line in lines:
            if rng.random() < 0.3:
                text += f"\n \t{line} \r\n" + prose(5)
        texts.append(text)
    for _ in range(n // 2):
        base = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [None, "", " \n\t ", "one", "one", "two words", "ÄÖ ß\nÄÖ ß", prose(3000), (prose(7) + " ") * 30]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "clash", "clash", 1) for i, t in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = {
        r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(frame(spark, rows)).collect()
    }
    assert got == brute.lines(rows)
    left = {r.doc_id: r.text for r in line_dedup.drop_lines(frame(spark, rows)).collect()}
    assert {i: brute.sha(t or "") for i, t in left.items()} == {i: x[2] for i, x in got.items()}
    assert line_dedup.drop_lines(frame(spark, rows)).columns == frame(spark, rows).columns


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(frame(spark, rows), 4).collect()}
    assert got == brute.near(rows)
    kept = {r.doc_id for r in near_dedup.keep_one(frame(spark, rows)).collect()}
    assert kept == {i for i, x in brute.near(rows, 5).items() if x[2]}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    got = {
        r.doc_id: (
            r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256
        ) for r in suffix_dedup.repeats(frame(spark, rows)).collect()
    }
    assert got == brute.suffix(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    rows += rows[:3]  # repeated rows are texts of their own
    got = sorted(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(frame(spark, rows)).collect()
    )
    assert got == sorted(brute.substrings(rows))


def test_decontamination(spark):
    rows = corpus(3)
    words = [t.split() for _, t in rows if t and len(t.split()) > 40]
    items = [
        (i, " ".join(w[5 : 5 + n])) for i, (w, n) in enumerate(zip(words, [12, 25, 10, 9, 3, 1, 30, 11], strict=False))
    ] + [(50, None), (51, "--"), (52, "never seen here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {
        r.doc_id: (
            r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated
        ) for r in decontaminate.report(frame(spark, rows), bench).collect()
    }
    want = brute.leaks(rows, items)
    assert got == want and any(x[4] for x in want.values())
    kept = {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()}
    assert kept == {i for i, x in want.items() if not x[4]}
    assert decontaminate.clean(frame(spark, rows), bench).columns == frame(spark, rows).columns


@pytest.mark.parametrize("task_bytes", [8 << 20, 2_000])
def test_decontamination_writes_small_tables_in_few_files(spark, monkeypatch, task_bytes):
    """Where partitions aren't joined for it, a table of few bytes isn't written in a file for each of them."""
    rows = corpus(3)
    words = [t.split() for _, t in rows if t and len(t.split()) > 40]
    items = [(i, " ".join(w[:30])) for i, w in enumerate(words[:20])]
    files = {}

    def spill(df, tag, *more):
        out = common.spill(df, tag, *more)
        files[tag] = len(out.inputFiles())
        return out

    monkeypatch.setattr(decontaminate, "spill", spill)
    monkeypatch.setattr(common, "TASK_BYTES", task_bytes, raising=False)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {
            r.doc_id: (
                r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated
            ) for r in decontaminate.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        }
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.leaks(rows, items)
    small = {files.get(tag, 0) for tag in ("owned", "windows", "rarity", "anchors", "maybe")}
    assert max(small) == 1 if task_bytes > 2_000 else max(small) > 8


def operators(bench):
    return {
        "line": (line_dedup.line_digests, line_dedup.drop_lines),
        "near": (near_dedup.groups, near_dedup.keep_one),
        "suffix": (suffix_dedup.repeats,),
        "substring": (substring_dedup.repeats,),
        "leaks": (lambda d: decontaminate.report(d, bench), lambda d: decontaminate.clean(d, bench)),
    }


@pytest.mark.parametrize("name", ["line", "near", "suffix", "substring", "leaks"])
def test_empty_tables_null_ids_and_repeated_rows(spark, name):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    text = "the same words again and again " * 12
    odd = [(None, None), (None, text), (7, text), (7, text), (7, "another text of that id"), (9, "")]
    for f in operators(bench)[name]:
        assert f(frame(spark, [])).collect() == []
        out = f(frame(spark, odd)).collect()
        if f not in (near_dedup.keep_one,):
            assert len(out) == len(odd)
        same = [r for r in out if r.doc_id == 7]
        assert len(same) == 3
        assert len([r for r in out if r.doc_id is None]) == 2
    if name == "leaks":
        none = spark.createDataFrame([], "item_id long, text string")
        assert not any(r.contaminated for r in decontaminate.report(frame(spark, odd), none).collect())


def test_runs_over_partition_edges(spark):
    """One line in every document, over more partitions than documents of any task."""
    line = "this line stands in all of the documents"
    rows = [(i, f"{line}\nown line number {i} of this one\n{line}") for i in range(300)]
    got = {
        r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(frame(spark, rows)).collect()
    }
    assert got == brute.lines(rows)


@pytest.mark.parametrize(
    ("min_docs", "batch", "partitions"), [(3, 2, 7), (1, 3, 5), (2, 5, 11), (6, 4, 9), (3, 1000, 40)]
)
def test_runs_in_small_batches(spark, min_docs, batch, partitions):
    """Few keys, repeated within and between documents, in runs that begin and end anywhere in batches and partitions."""
    rng = random.Random(min_docs * 100 + batch)
    rows = [
        (
            i,
            "\n".join(
                f"line {rng.choice('aaaabbc')}{rng.randrange(3) if rng.random() < 0.5 else rng.randrange(60)} of a text" for _ in range(rng.randrange(1, 9))
            ),
        ) for i in rng.sample(range(500), 120)
    ]
    settings = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = line_dedup.line_digests(frame(spark, rows), 5, min_docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out} == brute.lines(rows, 5, min_docs)


def test_keep_bitmaps_are_the_decisions(spark):
    rows = corpus(4)
    texts = dict(rows)
    kept = {i: x for i, x in brute.lines(rows).items() if x[1]}
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(frame(spark, rows)).collect()}
    assert set(got) == set(kept)
    for i, r in got.items():
        bits = line_dedup.unpack(r.n_lines, r.keep_bitmap)
        left = "\n".join(x for x, b in zip(texts[i].split("\n"), bits, strict=True) if b)
        assert (r.n_lines, r.n_dropped, brute.sha(left)) == kept[i]


def test_texts_over_a_slice(spark):
    """Texts beyond the megabyte that a task takes at a time, sharing passages across its border, and ids as ints."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = [word() for _ in range(200_000)]
    shared = " ".join(long[149_000:151_000])
    rows = [
        (3, " ".join(long)),
        (5, f"{word()} {shared} {word()}"),
        (8, " ".join(word() for _ in range(190_000)) + f" {shared}\n{shared}"),
        (9, word()),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats(docs).collect()}
    assert got == brute.suffix(rows)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(docs).collect())
    assert got == sorted(brute.substrings(rows))
    got = {
        r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(docs, min_docs=2).collect()
    }
    assert got == brute.lines(rows, min_docs=2)
    assert {r.doc_id: r.component_id for r in near_dedup.groups(docs).collect()} == {i: i for i, _ in rows}


def test_a_crowded_key_with_many_surroundings(spark, monkeypatch):
    """One passage shorter than a window in every document, so its anchors have as many surroundings as documents."""
    from loomwork.llm import anchors

    monkeypatch.setattr(anchors, "CROWD", 1)
    monkeypatch.setattr(anchors, "CROWDED", 2)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    fill = [" ".join(word() for _ in range(30)) for _ in range(12)]
    rows = [
        (
            i,
            f"{rng.choice(fill)} the same twenty words stand in each of these texts and few of them have the same words around {rng.choice(fill)} {word()}",
        ) for i in range(90)
    ]
    rows_of = anchors.bucketed
    for module in (suffix_dedup, substring_dedup):
        monkeypatch.setattr(
            module,
            "bucketed",
            lambda docs: (rows_of(docs)[0].withColumn("bucket", F.pmod("doc_id", F.lit(30))), anchors.Sizes(40, 8)),
        )
    got = {
        r.doc_id: (
            r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256
        ) for r in suffix_dedup.repeats(frame(spark, rows)).collect()
    }
    assert got == brute.suffix(rows)
    got = sorted(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(frame(spark, rows)).collect()
    )
    assert got == sorted(brute.substrings(rows))


def test_a_crowded_key_with_few_parts(spark, monkeypatch):
    """A stretch of a crowded key whose ranges lead to the same part stands there once, not at as many places."""
    from loomwork.llm import anchors

    monkeypatch.setattr(anchors, "CROWD", 1)
    monkeypatch.setattr(anchors, "CROWDED", 2)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    prose = lambda: " ".join(word() for _ in range(40))
    rows = [(i, f"{prose()} the same twelve words stand in each of these texts and no more {prose()}") for i in range(60)]
    rows_of = anchors.bucketed
    for module in (suffix_dedup, substring_dedup):
        monkeypatch.setattr(
            module,
            "bucketed",
            lambda docs: (rows_of(docs)[0].withColumn("bucket", F.pmod("doc_id", F.lit(30))), anchors.Sizes(2, 4)),
        )
    got = sorted(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(frame(spark, rows)).collect()
    )
    assert got == sorted(brute.substrings(rows)) and not any(r[2] for r in got)
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in suffix_dedup.repeats(frame(spark, rows)).collect()
    }
    assert got == brute.suffix(rows)


def maximal_by_hand(rows, width):
    """Every substring of `width` bytes or more at two or more places that differ on both sides."""
    texts = {i: t.encode() for i, t in rows}
    places = {}
    for i, t in texts.items():
        for a in range(len(t)):
            for b in range(a + width, len(t) + 1):
                places.setdefault(t[a:b], []).append((i, a))
    out = set()
    for s, at in places.items():
        left = {texts[i][a - 1] if a else (i, a) for i, a in at}
        right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, a) for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(at), tuple(sorted((i, a, a + len(s)) for i, a in at))))
    return out


def found_groups(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.repeat_id, []).append(r)
    assert all(len(g) == g[0].n_places for g in groups.values())
    return sorted(
        (g[0].n_places, tuple(sorted((r.doc_id, r.from_byte, r.to_byte) for r in g))) for g in groups.values()
    )


@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats_are_all_and_only_those(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(20, 45)))
    pieces = [word() for _ in range(4)]
    rows = [
        (
            i, "".join(rng.choice(pieces) if rng.random() < 0.75 else word() for _ in range(rng.randrange(1, 6)))
        ) for i in rng.sample(range(90), 9)
    ]
    got = found_groups(
        suffix_dedup.maximal_repeats(frame(spark, [*rows, (95, ""), (96, None), (None, rows[0][1])]), 20)
    )
    assert got == sorted(maximal_by_hand(rows, 20))


def test_maximal_repeats_of_several_kilobytes(spark):
    """A passage of 6 kB in three documents, and 2 kB from its middle in a fourth and twice in a fifth."""
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(6000)
    inner = passage[2500:4500]
    own = [prose(700 + 10 * i) for i in range(6)]
    rows = [
        (1, own[0] + "X" + passage + "Y" + own[1]),
        (2, passage + "Z"),
        (3, "W" + passage),
        (4, own[2] + "1" + inner + "2" + own[3]),
        (5, own[4] + "3" + inner + "45" + inner + "6" + own[5]),
        (6, own[3][:40]),
    ]
    found = found_groups(suffix_dedup.maximal_repeats(frame(spark, rows)))
    places = lambda s: tuple(
        sorted((i, a, a + len(s)) for i, t in rows for a in range(len(t)) if t.startswith(s, a))
    )
    assert found == [(3, places(passage)), (6, places(inner))]


def test_anchors_of_texts_over_a_step(monkeypatch):
    """The anchors of a text that is cut into steps are those of the whole, for units of any kind."""
    import numpy as np

    from loomwork.llm import anchors

    rng = np.random.default_rng(5)
    units = rng.integers(0, 50, 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    off = np.array([0, 3, 3, 7000, 7010, 19_990, 20_000])
    whole = anchors.anchors(units, off, 8, 35)
    monkeypatch.setattr(anchors, "STEP", 1000)
    cut = anchors.anchors(units, off, 8, 35)
    windows = lambda found: [
        (int(w), int(p), int(k)) for s, n, p, k in zip(*found, strict=True) for w in range(s, s + n)
    ]
    assert windows(cut) == windows(whole) and len(windows(whole)) == sum(
        max(0, b - a - 34) for a, b in zip(off[:-1], off[1:], strict=True)
    )


def test_anchors_are_whole_and_owned_by_content(monkeypatch):
    """Steps split no anchor; keys are those of the grams; windows longer than a step own anchors, too."""
    import numpy as np

    from loomwork.llm import anchors
    from loomwork.llm import tokens as tk

    rng = np.random.default_rng(6)
    units = rng.integers(0, 50, 90_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    units[40_000:80_000] = units[:40_000]
    off = np.array([0, 0, 3, 7000, 7010, 89_990, 90_000])
    whole = anchors.anchors(units, off, 8, 35)
    monkeypatch.setattr(anchors, "STEP", 1000)
    for a, b in zip(whole, anchors.anchors(units, off, 8, 35), strict=True):
        assert a.tolist() == b.tolist()
    for L in (35, 33_000):
        start, count, place, key = anchors.anchors(units, off, 8, L)
        assert count.sum() == sum(max(0, b - a - L + 1) for a, b in zip(off[:-1], off[1:], strict=True))
        assert (place >= start + count - 1).all() and (place + 8 <= start + L).all()
        assert (key == tk.mix(anchors.roll(units, 8)[place] ^ anchors.KEY)).all()
        again = {w + 40_000: int(p) + 40_000 for s, n, p in zip(start, count, place, strict=True) for w in range(s, s + n)}
        owner = {w: int(p) for s, n, p in zip(start, count, place, strict=True) for w in range(s, s + n)}
        both = [w for w in again if 47_010 <= w <= 80_000 - L]
        assert all(again[w] == owner[w] for w in both) and (both or L > 32_990)


def test_hashes_of_spans(monkeypatch):
    """Spans of any length have the rolled hash of their units, also where they cross a step, and so in any text."""
    import numpy as np

    from loomwork.llm import anchors

    monkeypatch.setattr(anchors, "STEP", 100)
    units = np.random.default_rng(7).integers(0, 2**63, 1000, dtype=np.uint64)
    for n in (1, 16, 50, 250):
        rolled = anchors.roll(units, n)
        at = np.arange(len(rolled))
        assert (anchors.spans(units, at, n) == rolled).all()
        assert (anchors.spans(units, at[::7], np.full(len(at[::7]), n)) == rolled[::7]).all()
    assert len(anchors.spans(units, np.zeros(0, np.int64), 5)) == 0


def test_work_does_not_grow_by_calls_a_repeat(monkeypatch):
    """All repeats of a part are named and told of at once, not each by calls of its own."""
    import numpy as np

    from loomwork.llm import tokens as tk

    calls, mix = [], tk.mix
    monkeypatch.setattr(tk, "mix", lambda x: calls.append(len(x)) or mix(x))
    counts = []
    for n in (2, 40):
        rng = np.random.default_rng(n)
        shared = rng.integers(97, 123, (n, 60), dtype=np.uint8)
        tails = np.repeat(np.arange(48, 51, dtype=np.uint8)[:, None], 9, axis=1)
        rows = np.concatenate([np.concatenate([shared[i], tails[j]]) for i in range(n) for j in range(3)])
        size = np.full(3 * n, 69)
        calls.clear()
        node, low, first, last, name, many = suffix_dedup.repeats_of(
            rows, np.cumsum(size) - size, size, np.arange(3 * n) + 5, np.full(3 * n, 2), np.arange(3 * n), 50
        )
        counts.append(len(calls))
        assert sorted(node.tolist()) == list(range(3 * n)) and set(first.tolist()) == {0}
        assert (last == 10).all() and (low == 5 + node // 3 * 3).all() and (many == 6).all() and len(set(name.tolist())) == n
    assert counts[0] == counts[1]


def test_suffix_dedup_writes_its_tables_in_few_files(spark, monkeypatch):
    """Tables of few bytes aren't written in a file for each shuffle partition, nor larger ones in fewer than their bytes."""
    from loomwork.llm import anchors

    rows = corpus(4)
    files = {}

    def spill(df, tag, *more):
        out = common.spill(df, tag, *more)
        files[tag] = len(out.inputFiles())
        return out

    monkeypatch.setattr(anchors, "spill", spill)
    monkeypatch.setattr(suffix_dedup, "spill", spill)
    monkeypatch.setattr(anchors, "FILES", 2, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    most = {}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        for size in (1 << 24, 2_000):
            monkeypatch.setattr(anchors, "FILE_BYTES", size, raising=False)
            got = {
                r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                for r in suffix_dedup.repeats(frame(spark, rows)).collect()
            }
            assert got == brute.suffix(rows)
            most[size] = max(files.get(tag, 0) for tag in ("seeds", "runs"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert most[1 << 24] <= 2 < most[2_000]


def test_removed_runs_are_those_of_the_digests(spark):
    """from_byte and to_byte of each row tell what its digest leaves out, over empty and null texts, and texts side by side."""
    rows = [*corpus(3), (2001, ""), (2002, None), (2003, ""), (None, "x" * 300)]
    texts = dict(rows)
    for i in sorted(x for x in texts if x is not None)[:6]:  # texts that begin and end within a repeat
        rows += [(3000 + 2 * i, (texts[i] or "") * 2), (3001 + 2 * i, texts[i] or "")]
    texts = dict(rows)
    hit = 0
    for r in suffix_dedup.repeats(frame(spark, rows)).collect():
        text, left, at = (texts[r.doc_id] or "").encode(), b"", 0
        for a, b in zip(r.from_byte, r.to_byte, strict=True):
            assert at <= a < b <= len(text)
            left, at = left + text[at:a], b
        left += text[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), len(text) - len(left), len(r.from_byte))
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()
        hit += r.n_spans > 0
    assert hit > 5


def one_bucket(batches):
    """band_rows() if all sets agreed in one band."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([7] * batch.num_rows, pa.int64()), batch.column("rep")], ["key", "rep"]
            )


def test_a_bucket_of_dissimilar_documents(spark, monkeypatch):
    """All documents in one bucket, whose hub is like hardly any of them: every pair of the others is still tested."""
    monkeypatch.setattr(near_dedup, "band_rows", one_bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(rng.randrange(30, 60))] for _ in range(900)]
    family = {}
    for i in range(0, 300, 3):  # chains of copies with a changed word, of documents at both ends of the ids
        copy = list(texts[i])
        copy[rng.randrange(len(copy)) if len(copy) < 45 else -1] = word()
        texts[899 - i] = copy
        family[899 - i] = i
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in enumerate(texts)}
    linked = {b: a for b, a in family.items() if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.component_id for r in near_dedup.groups(frame(spark, rows)).collect()}
    assert len(linked) > 30 and got == {i: linked.get(i, i) for i in range(900)}


def test_visitors_pass_by():
    """Members of a key are held, visitors are handed on batch by batch; keys without both are passed over."""
    import pyarrow as pa

    from loomwork.llm.common import members_then_visitors

    rows = [(1, 0, 10), (1, 0, 11), (1, 1, 12), (1, 1, 13), (1, 1, 14), (2, 0, 20), (3, 1, 30), (4, 0, 40), (4, 1, 41)]
    seen, pulled = [], []

    def handle(block):
        own = block.column("x").to_pylist()

        def visit(batch):
            seen.append((own, None if batch is None else batch.column("x").to_pylist()))
            yield from [] if batch is None else [batch]

        return visit

    def batches(size):
        for at in range(0, len(rows), size):
            pulled.append(at)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "kind", "x"), r, strict=True)) for r in rows[at : at + size]]
            )

    for size in (1, 2, 4, 20):
        seen.clear(), pulled.clear()
        out = members_then_visitors("key", handle)(batches(size))
        first = next(out).column("x").to_pylist()
        assert first[0] == 12 and (size > 3 or pulled[-1] <= 3)
        assert first + [x for b in out for x in b.column("x").to_pylist()] == [12, 13, 14, 41]
        assert [s for s in seen if s[1] is None] == [([10, 11], None), ([40], None)]
