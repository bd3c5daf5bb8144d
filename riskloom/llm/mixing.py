"""Soft-membership mixing of documents to target domain weights.

A classifier learned from the labelled table gives each document a posterior over domains. Rates r >= 0 for
documents are fitted by projected gradient so that expected domain tokens, sum(r * tokens * posterior),
match the targets in the least-squares sense. The objective is weighted by the inverse second moment G of
the posteriors and each document's step by its tokens, so the step for all documents is
``r <- clip(r - posterior . inv(G) (totals - targets))``, with momentum: it meets feasible targets at once where nothing is
clipped and goes on until the residual is small or no pass makes it smaller any more (targets that no rates
meet; the residual is reported with every row). A pass is one aggregation over the written posteriors; rates
aren't stored between passes but replayed from the few gradients so far.

Domains: ``toxic`` (labels.toxic = 1), else ``low`` (quality = 0), else ``clean``.

Null text: empty, 0 tokens; its posterior is the classifier's for an empty text, its rate is as others'.
No labelled documents: all documents are ``clean``. Domains that no labelled document has get posterior 0,
and a positive target for one can't be met (the residual says so). Documents repeat as they come, each row with
its own rate; a null doc_id is kept like any other. Of the documents only doc_id and text are read; ``thin``
keeps all columns, whatever they are called.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import bag, word_slots
from .packing import _encoder
from .quality import sampled_bags
from .util import Scratch, fresh, map_arrow, texts_of

DOMAINS = ("clean", "low", "toxic")
#: Shares of all tokens that the mix should have.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
#: Labelled documents taken of each domain, at most.
PER_DOMAIN = 1500
#: Word slots that the classifier sees beside the bag, and the value of one that is there.
WORDS, PRESENT = 256, 0.5
#: Residual (share of all tokens) that is small, and a bound for all passes.
TOLERANCE, PASSES = 1e-4, 200
#: The fit ends where the objective falls by less than a share in so many passes.
STALL = (1e-3, 10)


def domain_of(labels: DataFrame) -> DataFrame:
    """labels with ``domain``, the place of the row's domain in DOMAINS."""
    return labels.withColumn("domain", F.expr("case when toxic = 1 then 2 when quality = 0 then 1 when quality is not null then 0 end"))


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, prior: np.ndarray, rounds: int = 150, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a multinomial logistic regression, classes weighted alike, offsets moved to the prior."""
    hot = np.eye(classes, dtype=np.float32)[y]
    per = np.maximum(hot.sum(0), 1)
    row = (1 / per)[y][:, None].astype(np.float32) / max(1, len(np.unique(y)))
    centre = x.mean(0)
    x = x - centre
    w, b = np.zeros((x.shape[1], classes), np.float32), np.where(hot.any(0), 0, -50).astype(np.float32)
    step = 4.0 / max(1e-9, float((row * x * x).sum()))
    vw, vb, seen = np.zeros_like(w), np.zeros_like(b), hot.any(0)
    for _ in range(rounds):
        z = x @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - hot) * row
        vw = 0.9 * vw + x.T @ d + ridge * w
        vb = 0.9 * vb + d.sum(0) * seen
        w, b = w - step * 0.5 * vw, b - 0.5 * vb
    return w, b - centre @ w + np.log(np.maximum(prior, 1e-12)) * seen


def telling_words(words: list[np.ndarray], y: np.ndarray, classes: int, n: int = WORDS) -> np.ndarray:
    """The word slots whose presence tells most about the class: greatest standardised difference from what chance would give."""
    total = np.zeros(1 << 16)
    by_class = np.zeros((classes, 1 << 16))
    for slots, c in zip(words, y, strict=True):
        total[slots] += 1
        by_class[c, slots] += 1
    share = np.bincount(y, minlength=classes)[:, None] / max(1, len(y))
    chance = share * total
    gain = ((by_class - chance) / np.sqrt(np.maximum(chance * (1 - share), 1.0))).max(0)
    gain[total < 3] = 0
    best = np.argsort(-gain, kind="stable")[:n]
    return np.sort(best[gain[best] > 0])


class Classifier:
    """Posterior over domains from the bag of a text and the presence of telling words."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray, words: np.ndarray):
        self.weights, self.offsets, self.words = weights, offsets, words
        self.place = np.full(1 << 16, -1, np.int32)
        self.place[words] = np.arange(len(words))

    def inputs(self, texts: pa.Array) -> np.ndarray:
        seen = np.zeros((len(texts), len(self.words)), np.float32)

        def put(hashes: np.ndarray, of: np.ndarray) -> None:
            at = self.place[word_slots(hashes)]
            hit = at >= 0
            seen[of[hit], at[hit]] = PRESENT

        return np.concatenate((bag(texts, words_of=put), seen), 1)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        z = self.inputs(texts) @ self.weights + self.offsets
        p = np.exp(z - z.max(1, keepdims=True)).astype(np.float64)
        return p / p.sum(1, keepdims=True)


def domain_model(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> Classifier:
    named = domain_of(labels)
    words: list[np.ndarray] = []
    bags, y = sampled_bags(docs, named, "domain", per_domain, words)
    if not len(y):
        return Classifier(np.zeros((bags.shape[1], len(DOMAINS)), np.float32), np.array([0.0, -50.0, -50.0], np.float32), np.zeros(0, np.int64))
    y = y.astype(int)
    prior = np.zeros(len(DOMAINS))
    for r in named.where("domain is not null").groupBy("domain").count().collect():
        prior[r["domain"]] = r["count"]
    prior = np.where(np.isin(np.arange(len(DOMAINS)), y), prior, 0)
    told = telling_words(words, y, len(DOMAINS))
    place = np.full(1 << 16, -1)
    place[told] = np.arange(len(told))
    seen = np.zeros((len(y), len(told)), np.float32)
    for i, slots in enumerate(words):
        at = place[slots]
        seen[i, at[at >= 0]] = PRESENT
    return Classifier(*softmax_fit(np.concatenate((bags, seen), 1), y, len(DOMAINS), prior / max(1, prior.sum())), told)


def _measured(docs: DataFrame, model: Classifier, path: str, ranks: str | None, keep: list[str], names: list[str]) -> DataFrame:
    """The columns ``keep`` with tokens and the posterior of every whole text under the names given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = next(c for c in docs.columns if c.lower() == "text")
    kept = docs.select(*keep, *([] if text in keep else [text]))
    at = kept.columns.index(text)
    schema = type(docs.schema)([kept.schema[c] for c in keep]).add(names[0], "long")
    for name in names[1:]:
        schema = schema.add(name, "double")

    def make():
        classify, encoder = shared.value, _encoder(path, ranks)

        def step(batch: pa.RecordBatch) -> dict:
            p = classify(batch.column(at))
            out = {c: batch.column(i) for i, c in enumerate(keep)}
            out[names[0]] = [len(encoder.encode(t)) for t in texts_of(batch.column(at))]
            return out | {c: p[:, i] for i, c in enumerate(names[1:])}

        return step

    return map_arrow(kept, make, schema)


NAMES = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]


def memberships(docs: DataFrame, model: Classifier, path: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the posterior p_<domain> of every whole text."""
    return _measured(docs, model, path, ranks, ["doc_id"], NAMES)


#: A pass: the gradient, and the momentum with which the rates went on before it.
Step = tuple[np.ndarray, float]


def _replay(p: np.ndarray, steps: list[Step], most: float) -> np.ndarray:
    r = before = np.ones(len(p))
    for g, momentum in steps:
        before, r = r, np.clip(r + momentum * (r - before) - p @ g, 0, most)
    return r


def _posterior(batch: pa.RecordBatch, names: list[str] = NAMES) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in names[1:]], 1)


def fit_rates(members: DataFrame, targets: dict[str, float], most: float = float("inf"), passes: int = PASSES, tolerance: float = TOLERANCE, names: list[str] = NAMES, stall: tuple[float, int] = STALL) -> tuple[list[Step], dict]:
    """The passes that rates are replayed from, and a report: tokens, shares before and after, targets, goal, residual.

    The residual is the greatest distance of a domain's share from its goal, in shares of all tokens.

    With ``most`` (no document oftener than that) the mix is as large as the domain of the greatest target allows;
    targets of others are upper bounds then: one that falls short stays as it is and costs no other domain's documents.
    """
    want = np.array([targets.get(d, 0.0) for d in DOMAINS])
    want = want / want.sum()
    n = len(DOMAINS)

    def sums(steps: list[Step], moments: bool) -> np.ndarray:
        def make():
            def step(batch: pa.RecordBatch) -> dict:
                t, p = np.asarray(batch.column(names[0])).astype(float), _posterior(batch, names)
                tp = t[:, None] * p
                got = [t.sum(), *(_replay(p, steps, most) @ tp)]
                return {"s": [got + (list((tp.T @ p).ravel()) if moments else [])]}

            return step

        width = 1 + n + n * n * moments
        rows = map_arrow(members, make, "s array<double>").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).first()
        return np.array([x or 0.0 for x in rows])

    first = sums([], True)
    tokens, shares = first[0], first[1 : 1 + n] / max(first[0], 1)
    report = {"tokens": tokens, "targets": want, "before": shares, "after": shares, "residual": float(np.abs(shares - want).max())}
    if not tokens:
        return [], report
    inverse = np.linalg.inv(first[1 + n :].reshape(n, n) / tokens + 1e-6 * np.eye(n))
    goal = want
    if np.isfinite(most):
        main = int(want.argmax())
        goal = np.minimum(want * most * shares[main] / want[main], most * shares)
    # The objective is the distance from the goal weighted by the inverse moments, under which a step of 1 is safe.
    steps: list[Step] = []
    best, kept, after = np.inf, 0, shares
    got = before = shares
    pace, last = 1.0, np.inf
    while True:
        lost = float((got - goal) @ inverse @ (got - goal))
        if lost < best * (1 - stall[0]):
            best, kept, after = lost, len(steps), got
        if np.abs(got - goal).max() <= tolerance or len(steps) - kept >= stall[1] or len(steps) >= passes:
            break
        if lost > last:  # too fast: momentum starts anew
            pace = 1.0
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        momentum, pace, last = (pace - 1) / faster, faster, lost
        # Totals are linear in the rates, so those of the rates gone on with need no pass of their own.
        ahead = got + momentum * (got - before)
        steps.append((inverse @ (ahead - goal), momentum))
        before, got = got, sums(steps, False)[1 : 1 + n] / tokens
    if np.abs(got - goal).max() > tolerance:
        steps, got = steps[:kept], after
    report |= {"after": got, "goal": goal, "residual": float(np.abs(got - goal).max())}
    return steps, report


def with_rates(members: DataFrame, steps: list[Step], most: float = float("inf"), names: list[str] = NAMES, rate: str = "rate") -> DataFrame:
    schema, columns = type(members.schema)([*members.schema.fields]).add(rate, "double"), list(members.columns)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(i) for i, c in enumerate(columns)} | {rate: np.round(_replay(_posterior(batch, names), steps, most), 9)}

        return step

    return map_arrow(members, make, schema)


def rates(docs: DataFrame, labels: DataFrame, path: str, ranks: str | None = None, targets: dict[str, float] = TARGETS, most: float = float("inf")) -> tuple[DataFrame, dict]:
    """(doc_id, n_tokens, p_<domain>, rate, residual; report) of every document. The residual is that of the whole mix."""
    model = domain_model(docs, labels)
    members = Scratch(docs.sparkSession, "mixing").cut(memberships(docs, model, path, ranks), "memberships")
    steps, report = fit_rates(members, targets, most)
    return with_rates(members, steps, most).withColumn("residual", F.lit(round(report["residual"], 9))), report


def thin(docs: DataFrame, labels: DataFrame, path: str, ranks: str | None = None, targets: dict[str, float] = TARGETS, seed: int = 17) -> DataFrame:
    """The documents in the target mix, each row at most once: it stays where a hash of its id and text falls below its own rate.

    Rows that repeat an id have rates and draws of their own, as have rows without one; equal rows share both.
    """
    model = domain_model(docs, labels)
    columns = list(docs.columns)
    *names, rate, drawn = fresh(columns, *NAMES, "rate", "drawn")
    measured = _measured(docs.withColumn(drawn, F.xxhash64(F.lit(seed), "doc_id", "text")), model, path, ranks, [*columns, drawn], names)
    members = Scratch(docs.sparkSession, "thin").cut(measured, "memberships")
    steps, report = fit_rates(members.select(names), targets, 1.0, names=names)
    said = ", ".join(f"{d} {got:.4f} for {goal:.4f}" for d, got, goal in zip(DOMAINS, report["after"], report.get("goal", report["targets"]), strict=True))
    logging.getLogger(__name__).warning("thinning: %s of all tokens after %d passes, residual %.5f", said, len(steps), report["residual"])
    below = F.pmod(F.col(drawn), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col(rate)
    rated = with_rates(members, steps, 1.0, names, rate)
    return rated.where(below).select(*(F.col(f"`{c}`") for c in columns))
