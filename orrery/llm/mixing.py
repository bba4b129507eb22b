"""Mixing a corpus to target weights by soft membership, with DataFrame functions only.

Domains come from the labelled table: `clean` (quality 1, not toxic), `rough` (quality 0, not toxic) and
`toxic`.  A naive Bayes classifier over hashed features of a text's words (the first five
letters, the last two) learns from a bounded sample of labelled rows how often documents of each domain hold each
feature; features whose counts tell nothing (a chi-square under `TELLING`) weigh nothing.  A softmax regression on
the evidence and the length, fitted on the sample's other half, turns it into the document's
posterior over the domains.

Rates.  A document of n tokens and posterior p adds r n p to the expected domain totals.  Nonnegative rates bring the
totals to their targets, as little away from 1 as that allows: least squares of the missed totals, with the distance of the rates
from 1 (weighted by tokens) at a vanishing weight `PULL`.  The least squares are solved from their dual side: gradient steps from rates of 1 only ever move a document
along its posterior, so their sum is one step for each domain (`steps`), and its projection onto the nonnegative gives each document its own rate
max(0, 1 + p . steps).  That is where projected gradient steps on the rates themselves end (tests compare the two), in a few rounds instead of thousands.  Every round is one
distributed sum over all documents: the totals that the projected rates reach, and their slopes; from it the driver, which sees only these few numbers, takes the next
step for each domain (the gradient, scaled by the inverse slopes as in Newton's method, shortened while it brings no gain).  The rounds end
when the gradient is below `RESIDUAL`, or after `ROUNDS`; the output's `residual` tells how far the gradient is then (in shares of all tokens).  Rates have no upper bound; `reached` gives the totals beside their targets.

Targets.  Shares of `epochs` times the corpus' tokens; a domain without a target is left free.  `mixed` repeats documents: a rate of 1.3
gives one copy, and a second one for the three in ten whose hash falls there.

Defined results: null, empty and blank texts have no tokens and the prior as posterior; where no document has a
label of a domain its posterior is 0; without any labels everything is `clean`;
repeated documents are rows of their own with equal rates; no documents give no rows; other columns stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut, kept
from orrery.llm.samples import held_out

DOMAINS = ("clean", "rough", "toxic")
TARGETS = {"clean": 0.85, "rough": 0.10, "toxic": 0.05}
EPOCHS = 1.15
BUCKETS = 1 << 13
#: Labelled rows of each domain that the classifier learns from.
ROWS_PER_DOMAIN = 4000
#: The rounds end when the gradient is this small, in shares of all tokens, or after so many rounds.
RESIDUAL = 1e-7
ROUNDS = 60
#: The weight of the rates' distance from 1 beside the missed totals.
PULL = 1e-6
TELLING = 20.0


def _buckets() -> Column:
    """The distinct features of the column text, as buckets."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    head = lambda w: F.pmod(F.xxhash64(F.left(w, F.lit(5))), F.lit(BUCKETS)).cast("int")
    tail = lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(2)), F.lit(2)), F.lit(BUCKETS)).cast("int")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(head(w), tail(w)))))


def tokens() -> Column:
    """Tokens of a text: what stands between blanks and line breaks."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long")


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "rough").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


class Classifier:
    """Log prior of each domain, and log ratios of each bucket against the first domain."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("__id"), domain().alias("domain"))
        here = docs.select(F.col("doc_id").cast("long").alias("__id")).distinct()
        known = cut(known.where("domain is not null").groupBy("__id").agg(F.max("domain").alias("domain")).join(here, "__id", "left_semi"))
        count = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
        total = sum(count.values())
        self.prior = [math.log(count[d] / total) if count.get(d) else -math.inf for d in DOMAINS] if total else [0.0] + [-math.inf] * (len(DOMAINS) - 1)
        sample = None
        for name in DOMAINS:
            part = known.where(F.col("domain") == name).orderBy(F.xxhash64("__id", F.lit(3))).limit(ROWS_PER_DOMAIN)
            sample = part if sample is None else sample.union(part)
        texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(sample), "__id")  # a bounded number of ids
        learn = texts.where(F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(2)) == 0)
        held = learn.select("domain", F.explode(_buckets()).alias("bucket"))
        sizes = {r.domain: r["count"] for r in learn.groupBy("domain").count().collect()}
        seen = {(r.domain, r.bucket): r["count"] for r in held.groupBy("domain", "bucket").count().collect()}  # at most domains * BUCKETS rows
        self.ratios = [[self._ratio(seen, sizes, name, b) for b in range(BUCKETS)] for name in DOMAINS[1:]]
        other = texts.where(F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(2)) == 1).select("domain", tokens().alias("n"), self.logits().alias("e")).collect()
        drawn = {d: sum(r.domain == d for r in other) for d in DOMAINS}
        self.weights = _softmax(
            [self._inputs(float(r.n), list(r.e), math.log, math.sqrt) for r in other],
            [DOMAINS.index(r.domain) for r in other],
            [count[r.domain] / total / drawn[r.domain] for r in other],
        )

    @staticmethod
    def _inputs(n, evidence, log, root):
        return [1.0, log(n + 1) / 5, *[e / 5 for e in evidence], *[e / root(n + 10) for e in evidence]]

    @staticmethod
    def _ratio(seen: dict, sizes: dict, name: str, bucket: int) -> float:
        a, b, n, m = seen.get((name, bucket), 0), seen.get((DOMAINS[0], bucket), 0), sizes.get(name, 0), sizes.get(DOMAINS[0], 0)
        expected = (a + b) * n / (n + m) if n and m else 0.0
        if not expected or (a - expected) ** 2 / expected < TELLING:
            return 0.0
        return math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))

    def logits(self) -> Column:
        """Evidence for each domain but the first, for the column text, before the priors."""
        tables = [F.split(F.lit(",".join(f"{x:.4f}" for x in ratio)), ",").cast("array<double>") for ratio in self.ratios]
        start = F.struct(*[F.lit(0.0).alias(f"e{k}") for k in range(len(tables))])
        add = lambda s, b: F.struct(*[(s[f"e{k}"] + F.get(t, b)).alias(f"e{k}") for k, t in enumerate(tables)])
        scale = lambda s: F.array(*[s[f"e{k}"] for k in range(len(tables))])
        return F.aggregate(_buckets(), start, add, scale)

    def posterior(self) -> Column:
        """array<double> over DOMAINS, from __logits and __n."""
        inputs = self._inputs(F.col("__n").cast("double"), [F.get("__logits", F.lit(k)) for k in range(len(self.ratios))], F.log, F.sqrt)
        odds = []
        for prior, weights in zip(self.prior, self.weights):
            z = F.lit(weights[0])
            for w, x in zip(weights[1:], inputs[1:]):
                z = z + F.lit(w) * x
            odds.append(F.lit(0.0) if math.isinf(prior) else F.exp(F.greatest(F.lit(-300.0), F.least(F.lit(300.0), z))))
        total = odds[0]
        for o in odds[1:]:
            total = total + o
        return F.array(*[o / total for o in odds])


def _softmax(inputs: list[list[float]], domain: list[int], weight: list[float], rounds: int = 400) -> list[list[float]]:
    """Weights of each domain by gradient ascent with momentum on a bounded sample; the first domain's stay 0."""
    width = 2 * len(DOMAINS)
    found = np.zeros((len(DOMAINS), width))
    if not inputs:
        return found.tolist()
    x, w = np.array(inputs), np.array(weight)[:, None]
    scale = np.maximum(1e-9, np.sqrt((x**2 * w).sum(axis=0) / w.sum()))
    x, y, speed = x / scale, np.eye(len(DOMAINS))[domain], np.zeros_like(found)
    for _ in range(rounds):
        z = x @ found.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + 0.5 * (((y - p) * w).T @ x / w.sum() - 1e-4 * found)
        found = found + speed
    return ((found - found[:1]) / scale).tolist()


def memberships(docs: DataFrame, labels: DataFrame, write) -> DataFrame:
    """docs with __n (tokens) and __p (posterior); write() puts the evidence down before more is computed from it."""
    model = Classifier(docs, labels)
    told = write(docs.withColumn("__n", tokens()).withColumn("__logits", model.logits()))
    return told.withColumn("__p", model.posterior()).drop("__logits")


def _rate(steps: list[float]) -> Column:
    """The rate of a document with posterior __p."""
    moved = F.lit(1.0)
    for k, step in enumerate(steps):
        moved = moved + F.lit(step) * F.get("__p", F.lit(k))
    return F.greatest(F.lit(0.0), moved)


def fitted_steps(placed: DataFrame, goal: list[float | None], rounds: int = ROUNDS) -> tuple[list[float], float]:
    """(step of each domain, gradient left) for rows with __n and __p, so that the expected totals come closest to goal (shares of all tokens)."""
    domains = [k for k, wanted in enumerate(goal) if wanted is not None]
    wanted = np.array([goal[k] for k in domains])

    def totals(steps):
        """Shares of the domains at these steps, and their slopes: one sum over all documents."""
        rate, n = _rate(list(steps)), F.col("__n").cast("double")
        part = [F.get("__p", F.lit(k)) for k in domains]
        held = [F.sum(n * rate * p) for p in part] + [F.sum(F.when(rate > 0, n * p * q)) for p in part for q in part]
        row = placed.agg(F.sum(n), *held).first()
        whole = row[0] or 0.0
        if not whole:
            return None
        sums = np.array([x or 0.0 for x in row[1:]]) / whole
        return sums[: len(domains)], sums[len(domains) :].reshape(len(domains), -1)

    steps = np.zeros(len(goal))
    now = totals(steps)
    if now is None or not domains:
        return steps.tolist(), 0.0
    gap = lambda reached, steps: wanted - reached - PULL * steps[domains]
    share, tries = 1.0, 0
    move = None
    for _ in range(rounds):
        left = gap(now[0], steps)
        if np.abs(left).max() <= RESIDUAL:
            break
        if move is None:
            move = np.linalg.solve(now[1] + PULL * np.eye(len(domains)), left)
        ahead = steps.copy()
        ahead[domains] += share * move
        then = totals(ahead)
        if tries < 6 and np.abs(gap(then[0], ahead)).sum() > (1 - 0.1 * share) * np.abs(left).sum():
            share, tries = share / 2, tries + 1  # no gain: a shorter step
            continue
        steps, now, move, share, tries = ahead, then, None, 1.0, 0
    return steps.tolist(), float(np.abs(gap(now[0], steps)).max())


def with_rates(placed: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """placed (with __n and __p) and the columns __rate and __residual (the same for all)."""
    steps, residual = fitted_steps(placed.select("__n", "__p"), [targets[d] * epochs if d in targets else None for d in DOMAINS])
    return placed.withColumn("__rate", _rate(steps)).withColumn("__residual", F.lit(residual))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>, rate, residual."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = memberships(texts, labels, lambda told: cut(told.drop("text")))
    return with_rates(placed, targets, epochs).select("doc_id", F.col("__n").alias("n_tokens"), *[F.get(F.col("__p"), F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], F.round("__rate", 6).alias("rate"), F.col("__residual").alias("residual"))


def reached(rated: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> dict[str, tuple[float | None, float]]:
    """Of the rows of rates(): for each domain its target (None: free) and its expected total, in shares of all tokens."""
    sums = [F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]
    row = rated.agg(F.sum("n_tokens").alias("__all"), *sums).first()
    return {d: (targets[d] * epochs if d in targets else None, (row[d] or 0.0) / max(1, row["__all"] or 0)) for d in DOMAINS}


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """docs, each as often as its rate says; the columns stay as they are."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = memberships(packed, labels, lambda told: kept(told.drop("text"), "mixing"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("__rate") + chance).cast("int")
    return with_rates(placed, targets, epochs).withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("doc.*")
