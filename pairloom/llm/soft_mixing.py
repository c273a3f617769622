"""Mixing to target weights with soft domain membership.

1. *Classifier.* Labelled rows give each domain a multinomial model over hashed words and word endings. A row's evidence is
   its mean log-likelihood per feature, sharpened by one factor that is fitted, like the models, on at most about
   ``LABELLED`` labelled rows (chosen by a hash of doc_id), on a quarter of them that the models have not seen. Every row
   then has a posterior over the domains, never a hard class.
2. *Rates.* A row is to be taken ``rate`` times, at most ``MOST`` times. The expected tokens of domain k are the sum of rate * tokens *
   posterior_k; the targets are the given weights times all tokens. Least squares on the difference, with a small penalty
   (RIDGE) on moving a row's tokens away from a rate of 1, is solved by projected gradient steps on the domains' pull: the
   gradient is scaled by the Gram matrix of the rows that move, and every rate is projected to [0, MOST] as 1 + pull .
   posterior. One pass over the staged posteriors sums up gradient, objective and Gram matrix for all trial lengths of a
   step; the longest one that raises the (concave) dual objective enough is taken, so the steps end at the optimum from any
   start. Rates are never written between steps. The penalty is lowered by tens until the totals that the rates really
   reach are within MISSED of every target; ``miss`` in the result is the largest relative miss, and targets that no rates
   reach are warned of (``strict``: an error).
3. *Copies.* A row is written floor(rate) times and once more with the remaining probability, by a hash of its doc_id.

Only the feature tables (domains x BUCKETS numbers), totals and Gram matrices reach the driver or the tasks. Defined cases: a
null or empty text has no tokens, the domains' shares as posterior, and a rate like others; labels other than 0 and 1, or
contradicting ones, are left out; a target for a domain without labelled rows is dropped and the rest is scaled up; without
labels there is one domain, and rates are 1; repeated rows have equal rates and copies. Other columns are ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

LABELLED = 12_000
BUCKETS = 1 << 15
STEPS = 100
CLOSE = 1e-7
#: Penalty on leaving a rate of 1, and the least it is lowered to; part of its target by which a domain may be missed.
RIDGE, LEAST_RIDGE = 5e-3, 5e-9
MISSED = 0.01
#: How often a row is taken at most.
MOST = 10.0
TRIALS = 0.5 ** np.array([0, 1, 2, 3, 5, 8, 12, 20])
#: Domains by (quality, toxic), and the parts of all tokens they are to get.
DOMAINS = {"good": (1, 0), "low": (0, 0), "toxic": (1, 1), "low_toxic": (0, 1)}
TARGETS = {"good": 0.82, "low": 0.08, "toxic": 0.08, "low_toxic": 0.02}


def _features(piece: packed.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per feature its row and bucket (words in the lower half, word endings in the upper); words per row."""
    found = packed.words(piece, lower=True)
    half = np.uint64(BUCKETS // 2)
    ending = packed.span_hashes(packed.prefix_sums(packed.LOWER[piece.data]), np.maximum(found.start, found.end - 3), found.end)
    count = np.diff(found.bounds)
    row = np.repeat(np.arange(len(count)), count)
    key = np.concatenate([found.hashes % half, half + ending % half]).astype(np.int64)
    return np.concatenate([row, row]), key, count


def _count(batches, domains: int):
    """Feature counts per domain over the rows of a batch that the models learn from."""
    for batch in batches:
        domain = batch.column("domain").to_numpy(zero_copy_only=False)
        counts = np.zeros(domains * BUCKETS, dtype=np.int64)
        for piece in packed.pieces(batch):
            row, key, _ = _features(piece)
            counts += np.bincount(domain[piece.first + row].astype(np.int64) * BUCKETS + key, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "n"])


def _evidence(batches, shipped, extra: list[str]):
    """Tokens and mean log-likelihood per domain."""
    table = shipped.value
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        out = np.zeros((batch.num_rows, table.shape[0]))
        for piece in packed.pieces(batch):
            row, key, count = _features(piece)
            rows = piece.last - piece.first
            size[piece.first : piece.last] = count
            for k in range(table.shape[0]):
                out[piece.first : piece.last, k] = np.bincount(row, weights=table[k][key], minlength=rows)
        out /= np.maximum(2 * size, 1)[:, None]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array(size), packed.list_array(out.ravel(), np.full(len(out), out.shape[1]))],
            names=["doc_id", *extra, "tokens", "evidence"],
        )


def _posterior(evidence: np.ndarray, prior: np.ndarray, sharp: float) -> np.ndarray:
    logs = np.log(prior) + sharp * evidence
    logs -= logs.max(axis=1, keepdims=True)
    return np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)


def memberships(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, tokens, posterior) of every row, staged, and the domains in the order of the posterior."""
    spark = docs.sparkSession
    texts = jobs.with_columns(docs, doc_id="long", text="string")
    labels = jobs.with_columns(labels, doc_id="long", quality="int", toxic="int").where("quality IN (0, 1) AND toxic IN (0, 1)")
    labels = labels.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("quality", "toxic") for n, f in (("low", F.min), ("high", F.max))))
    labels = labels.where("quality_low = quality_high AND toxic_low = toxic_high")
    shares = {(r[0], r[1]): r[2] for r in labels.groupBy("quality_low", "toxic_low").count().collect()}
    names = [name for name, kind in DOMAINS.items() if shares.get(kind)] or ["all"]
    prior = np.array([shares.get(DOMAINS.get(name), 1) for name in names], dtype=float)
    prior /= prior.sum()

    part = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20))
    share = min(1.0, LABELLED / max(1, sum(shares.values())))
    domain = F.lit(0)
    for k, name in enumerate(names):
        if name in DOMAINS:
            quality, toxic = DOMAINS[name]
            domain = F.when((F.col("quality_low") == quality) & (F.col("toxic_low") == toxic), k).otherwise(domain)
    chosen = labels.where(part < int(share * (1 << 20))).select("doc_id", domain.alias("domain"))
    sample = texts.where((part < int(share * (1 << 20))) & F.col("text").isNotNull()).join(chosen, "doc_id")
    sample = jobs.staged(sample, "mixing-sample")
    tested = F.pmod(F.xxhash64("doc_id", F.lit("tested")), F.lit(4)) == 0

    counts = np.zeros(len(names) * BUCKETS)
    made = sample.where(~tested).mapInArrow(lambda batches: _count(batches, len(names)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts[made.column("place").to_numpy()] = made.column("n").to_numpy()
    counts = counts.reshape(len(names), BUCKETS)
    overall = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    table = np.log((counts + 4000 * overall) / (counts.sum(axis=1, keepdims=True) + 4000))
    shipped = spark.sparkContext.broadcast(table)

    seen = sample.where(tested).mapInArrow(lambda batches: _evidence(batches, shipped, ["domain"]), "doc_id long, domain int, tokens long, evidence array<double>").toArrow()
    sharp = 1.0
    if seen.num_rows:
        values, _ = packed.list_bounds(seen.column("evidence"))
        values = values.reshape(-1, len(names))
        truth = seen.column("domain").to_numpy()
        loss = {s: -np.log(_posterior(values, prior, s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in 2.0 ** np.arange(-2, 12)}
        sharp = float(min(loss, key=loss.get))
    evidence = texts.mapInArrow(lambda batches: _evidence(batches, shipped, []), "doc_id long, tokens long, evidence array<double>")
    logs = F.zip_with("evidence", F.array(*(F.lit(float(x)) for x in np.log(prior))), lambda e, p: p + sharp * e)
    top = F.array_max("logs")
    raised = F.transform("logs", lambda x: F.exp(x - top))
    evidence = evidence.withColumn("logs", logs).withColumn("raised", raised)
    total = F.aggregate("raised", F.lit(0.0), lambda a, x: a + x)
    return jobs.staged(evidence.select("doc_id", "tokens", F.transform("raised", lambda x: x / total).alias("posterior")), "mixing-posteriors"), names


def _rate(pull: np.ndarray) -> Column:
    """The rate within its bounds that is nearest to 1 under the domains' pull."""
    change = sum((float(x) * F.col("posterior")[k] for k, x in enumerate(pull)), F.lit(0.0))
    return F.least(F.lit(MOST), F.greatest(F.lit(0.0), F.lit(1.0) + change))


def _sums(batches, points: np.ndarray, most: float):
    """All tokens, then for every pull: objective of the rows, expected tokens of the domains, Gram matrix of the rows that move."""
    count, size = points.shape
    out = np.zeros(1 + count * (1 + size + size * size))
    for batch in batches:
        posterior, _ = packed.list_bounds(batch.column("posterior"))
        posterior = posterior.reshape(-1, size)
        tokens = batch.column("tokens").to_numpy().astype(np.float64)
        parts = [[tokens.sum()]]
        for pull in points:
            change = posterior @ pull
            rate = np.clip(1 + change, 0, most)
            moving = tokens * ((rate > 0) & (rate < most))
            parts += [[(tokens * (change * rate - (rate - 1) ** 2 / 2)).sum()], posterior.T @ (tokens * rate), (posterior.T @ (posterior * moving[:, None])).ravel()]
        out += np.concatenate(parts)
    yield pa.RecordBatch.from_arrays([packed.list_array(out, np.array([len(out)]))], names=["sums"])


def _evaluated(rows: DataFrame, points: np.ndarray) -> tuple[float, list]:
    """All tokens; (objective, expected tokens, Gram matrix) of every pull in ``points``. One small row per task is summed."""
    size = points.shape[1]
    each = rows.select("posterior", "tokens").mapInArrow(lambda batches: _sums(batches, points, MOST), "sums array<double>")
    summed = each.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(1 + len(points) * (1 + size + size * size))
    for place, value in summed:
        flat[place] = value
    parts = flat[1:].reshape(len(points), -1)
    return flat[0], [(part[0], part[1 : 1 + size], part[1 + size :].reshape(size, size)) for part in parts]


def _fitted(rows: DataFrame, weights: np.ndarray, part: float, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pull at the optimum under the penalty ``part``, and the parts of all tokens that its rates reach."""
    size = len(weights)
    pull = np.zeros(size) if start is None else start
    everything, told = _evaluated(rows, pull[None, :])
    if not everything:
        return np.zeros(size), weights
    target, ridge = weights * everything, part * everything

    def objective(at: np.ndarray, value: float) -> float:
        return at @ target - value - ridge * (at @ at) / 2

    value, total, gram = told[0]
    for _ in range(STEPS):
        gradient = target - total - ridge * pull
        if np.abs(gradient).max() <= CLOSE * everything:
            return pull, total / everything
        step = np.linalg.solve(gram + ridge * np.eye(size), gradient)
        points = pull + TRIALS[:, None] * step
        _, told = _evaluated(rows, points)
        now, rise = objective(pull, value), 1e-4 * (gradient @ step)
        enough = [k for k, length in enumerate(TRIALS) if objective(points[k], told[k][0]) >= now + length * rise]
        if not enough:  # no rise that floating point can tell
            return pull, total / everything
        pull, (value, total, gram) = points[enough[0]], told[enough[0]]
    raise ArithmeticError(f"mixing: {STEPS} steps leave a gradient of {np.abs(gradient).max() / everything:.2g} of all tokens")


def fitted_pull(rows: DataFrame, weights: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """The domains' pull at which the gradient of the least squares vanishes for every rate within its bounds."""
    return _fitted(rows, weights, RIDGE if ridge is None else ridge, None)[0]


def closest_pull(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The pull under the largest penalty (RIDGE, or less by tens) that leaves no domain further than MISSED from its target, and its miss.

    Where none does, the one under LEAST_RIDGE.
    """
    ridge, pull, some = RIDGE, None, weights > 0
    while True:
        pull, reached = _fitted(rows, weights, ridge, pull)
        miss = float(np.abs(reached[some] / weights[some] - 1).max())
        if miss <= MISSED or ridge <= LEAST_RIDGE * 1.001:
            return pull, miss
        ridge /= 10


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, strict: bool = False) -> DataFrame:
    """Per row: doc_id, tokens, posterior, rate and copies, the names of the domains, and the largest relative miss of a target."""
    targets = TARGETS if targets is None else targets
    rows, names = memberships(docs, labels)
    weights = np.array([max(0.0, targets.get(name, 0.0)) for name in names])
    weights = weights / weights.sum() if weights.sum() else np.full(len(names), 1 / len(names))
    pull, miss = closest_pull(rows, weights) if len(names) > 1 else (np.zeros(1), 0.0)
    if miss > MISSED:
        told = f"mixing: no rates up to {MOST} reach the targets; the largest relative miss is {miss:.3f}"
        if strict:
            raise ValueError(told)
        warnings.warn(told)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    out = rows.withColumn("rate", _rate(pull))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    domains = F.array(*(F.lit(n) for n in names)).alias("domains")
    return out.select("doc_id", "tokens", domains, "posterior", "rate", copies.alias("copies"), F.lit(miss).alias("miss"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    copies = rated(docs, labels, targets).groupBy(F.col("doc_id").alias("_rated_id")).agg(F.max("copies").alias("_copies"))
    joined = docs.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col("_rated_id"))).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
