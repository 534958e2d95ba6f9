"""Mixing to target weights: domain posteriors of a table-based classifier, and nonnegative document rates by projected
gradient least squares, in DataFrame functions only."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, held_out, spill

BUCKETS = 1 << 12


def token_array(text: Column) -> Column:
    """Words between ASCII white space of the whole text."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_buckets(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct word of each text, hashed into BUCKETS."""
    return docs.select(*keep, F.explode(F.array_distinct(token_array(F.col("text")))).alias("word")).select(
        *keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")
    )


def classifier(docs: DataFrame, label: str, most: int = 4000) -> tuple[list[str], DataFrame]:
    """Naive Bayes tables: the labels, and (bucket, l0, l1, ...) with the log-probability of a bucket under each.

    The labels are those of all rows with a word. Each is learnt from the presence of hashed words in at most `most` of
    its rows, by smallest hash; rows that are held out teach only a label that has no others. The table has BUCKETS
    rows, whatever the input, so it may be broadcast.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", F.xxhash64("text").alias("fp"), F.col(label).cast("string").alias("domain"), "text"
    )
    named = known.select(
        "domain",
        "doc_id",
        "fp",
        F.coalesce(held_out(), F.lit(False)).alias("held"),
        F.xxhash64("doc_id", "fp").alias("h"),
    ).withColumn("part", F.shiftrightunsigned("h", 54))
    parts: dict[str, dict[bool, list]] = {}
    for r in named.groupBy("domain", "held", "part").agg(F.count("*").alias("n")).orderBy("domain", "held", "part").collect():
        parts.setdefault(r.domain, {}).setdefault(r.held, []).append((r.part, r.n))
    if not parts:
        return [], docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    among = F.lit(False)  # rows of the first parts of each label's hashes that hold `most`, so few go to the window's tasks
    for d, of in parts.items():
        held, total = min(of), 0
        for part, n in of[held]:
            total += n
            if total >= most:
                break
        among = among | ((F.col("domain") == d) & (F.col("held") == held) & (F.col("part") <= part))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("part", "h", "doc_id", "fp"))
    chosen = named.where(among).withColumn("rank", rank).where(F.col("rank") <= most).select(
        F.col("domain").alias("d__"), F.col("doc_id").alias("i__"), F.col("fp").alias("f__")
    ).distinct()
    known = known.join(
        F.broadcast(chosen),
        (F.col("domain") == F.col("d__")) & F.col("doc_id").eqNullSafe(F.col("i__")) & (F.col("fp") == F.col("f__")),
        "left_semi",
    )
    counts = spill(word_buckets(known, "domain").groupBy("domain", "bucket").count(), "buckets")
    totals = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("count").alias("n")).collect()}
    domains = sorted(totals)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    wide = every.join(counts, "bucket", "left").groupBy("bucket").agg(
        *(
            F.log(
                (
                    F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0)) + 0.5
                ) / (totals[d] + 0.5 * BUCKETS),
            ).alias(f"l{i}") for i,
            d in enumerate(domains)
        ),
        F.count("*").alias("rows__"),
    ).drop("rows__")
    return domains, wide


def posteriors(docs: DataFrame, label: str = "lang", most: int = 4000) -> tuple[list[str], DataFrame]:
    """(doc_id, fp, n_tokens, p0, p1, ...) of each distinct document with words.

    The log-likelihood is divided by the root of the number of distinct words, so that memberships stay soft.
    """
    domains, model = classifier(docs, label, most)
    model = spill(model, "classifier")
    base = docs.select(F.col("doc_id"), F.xxhash64("text").alias("fp"), "text").where("text is not null")
    size = base.select("doc_id", "fp", F.size(token_array(F.col("text"))).cast("long").alias("n_tokens"), "text")
    k = len(domains)
    if not k:
        return domains, size.drop("text").where("n_tokens > 0").distinct()
    hit = word_buckets(size, "doc_id", "fp", "n_tokens").join(F.broadcast(model), "bucket")
    summed = hit.groupBy("doc_id", "fp", "n_tokens").agg(
        *(F.sum(f"l{i}").alias(f"l{i}") for i in range(k)), F.count("*").alias("words")
    )
    top = F.greatest(*(F.col(f"l{i}") for i in range(k))) if k > 1 else F.col("l0")
    raised = summed.select(
        "doc_id", "fp", "n_tokens", *(F.exp((F.col(f"l{i}") - top) / F.sqrt("words")).alias(f"e{i}") for i in range(k))
    )
    return domains, raised.select(
        "doc_id",
        "fp",
        "n_tokens",
        *(F.expr(f"e{i} / ({' + '.join(f'e{j}' for j in range(k))})").alias(f"p{i}") for i in range(k)),
    )


#: Rounds after which the rates so far are written, so that the expression of a rate stays short.
WRITTEN = 12


def fit_rates(
    table: DataFrame, k: int, target: np.ndarray, rounds: int = 240, tolerance: float = 1e-5
) -> tuple[DataFrame, np.ndarray]:
    """table (n_tokens, p0 ...) with a column `rate`, and the token shares that the rates are expected to give.

    Minimizes |M^(1/2) (sum of rate * tokens * p - target * all tokens)|^2 over rates >= 0 from rates of 1, where M is
    the inverse of the second moments of p by tokens. In the metric that weighs documents by their tokens the gradient
    of a document is p . M residual and the Lipschitz constant 1, so the step is 1. Each round is one aggregation of k
    sums; the rate is an expression of the rounds since the rates were last written.

    It ends when the targets are met, or when the objective has come to rest above 0: then rates >= 0 can't meet them,
    and these come closest. If neither is so after `rounds` rounds, that is an error.
    """
    p = [F.col(f"p{i}") for i in range(k)]
    t = F.col("n_tokens").cast("double")
    row = table.agg(
        F.sum(t).alias("t"), *(F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))
    ).first()
    total = row.t or 0.0
    moments = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    base, rate, share, past = table, F.lit(1.0), target, np.inf
    written = None
    for turn in range(rounds + 1):
        sums = base.agg(*(F.sum(t * p[i] * rate).alias(f"s{i}") for i in range(k))).first()
        now = np.array([s or 0.0 for s in sums])
        share = now / now.sum() if now.sum() else now
        residual = now - target * total
        loss = float(residual @ inverse @ residual)
        if not total or np.abs(residual).max() <= tolerance * total or past - loss <= 1e-7 * loss + 1e-11 * total:
            break
        if turn == rounds:
            raise RuntimeError(f"the rates did not come to rest in {rounds} rounds; shares so far: {share.tolist()}")
        past = loss
        step = inverse @ residual
        move = sum((p[i] * float(step[i]) for i in range(1, k)), p[0] * float(step[0]))
        rate = F.greatest(F.lit(0.0), rate - move)
        if (turn + 1) % WRITTEN == 0:
            before, written = written, spill(base.withColumn("rate", rate), "rates")
            if before is not None:
                discard(before)
            base, rate = written, F.col("rate")
    return base.withColumn("rate", rate), share


def rates(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    label: str = "lang",
    most: int = 4000,
    tolerance: float = 1e-5,
) -> DataFrame:
    """(doc_id, fp, n_tokens, domain, p_domain, rate) of each distinct document that has words.

    targets: the share of all tokens that each domain is to have, all alike by default; domains without a target get
    none, and a target above 0 for a domain that no labelled row with a word has is an error. Without targets and any
    labelled row every rate is 1. Shares that no rates bring to their targets are named in a warning. Null labels teach
    nothing; null doc_ids are rated like others; rows that repeat an id and text are one document, of a null or blank
    text none. Long texts are read as a whole.
    """
    domains, table = posteriors(docs, label, most)
    if targets is not None:
        if unknown := sorted(d for d, share in targets.items() if share > 0 and d not in domains):
            raise ValueError(f"targets without a labelled document: {', '.join(unknown)}")
        if min(targets.values(), default=0) < 0 or not sum(targets.values()) > 0:
            raise ValueError("targets must be shares of 0 or more, some above 0")
    table = spill(table, "posteriors")
    k = len(domains)
    if not k:
        return table.select(
            "doc_id",
            "fp",
            "n_tokens",
            F.lit(None).cast("string").alias("domain"),
            F.lit(None).cast("double").alias("p_domain"),
            F.lit(1.0).alias("rate"),
        )
    want = np.array([1.0 if targets is None else targets.get(d, 0.0) for d in domains])
    want = want / want.sum()
    table, share = fit_rates(table, k, want, tolerance=tolerance)
    if missed := [
        f"{d} {got:.6f} of {w:.6f}" for d,
        got,
        w in zip(domains, share, want, strict=True) if abs(got - w) > 2 * tolerance
    ]:
        warnings.warn(f"token shares that miss their targets: {', '.join(missed)}", stacklevel=2)
    best = F.greatest(*(F.col(f"p{i}") for i in range(k))) if k > 1 else F.col("p0")
    name = F.coalesce(*(F.when(F.col(f"p{i}") == best, F.lit(d)) for i, d in enumerate(domains)))
    return table.select("doc_id", "fp", "n_tokens", name.alias("domain"), best.alias("p_domain"), "rate")


def mix(
    docs: DataFrame, targets: dict[str, float] | None = None, label: str = "lang", column: str = "mix_rate"
) -> DataFrame:
    """docs with a column of sampling rates (expected copies of each row), in place of one of that name. Rows without
    words have the rate 1: they have no tokens. No row is dropped. See rates() for nulls and repeated rows."""
    fp, id_, f, rate = fresh(docs, "fp__", "i__", "f__", "rate__")
    found = rates(docs, targets, label).select(
        F.col("doc_id").alias(id_), F.col("fp").alias(f), F.col("rate").alias(rate)
    )
    joined = docs.withColumn(fp, F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(fp) == F.col(f)), "left"
    )
    return joined.select(*(c for c in docs.columns if c != column), F.coalesce(rate, F.lit(1.0)).alias(column))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, domain, p_domain, rate of every row; a text without words has no domain and the rate 1.

    Repeated rows, null doc_ids and long texts: see rates().
    """
    found = rates(docs).withColumnsRenamed({"doc_id": "i__", "fp": "f__"})
    base = docs.select("doc_id", F.xxhash64("text").alias("fp__"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("i__")) & (F.col("fp__") == F.col("f__")), "left")
    return out.select(
        "doc_id",
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        "domain",
        "p_domain",
        F.coalesce("rate", F.lit(1.0)).alias("rate"),
    )
