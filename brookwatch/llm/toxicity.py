"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text and the first 3 to 6 characters of each, as 0 or 1, hashed to a table of fixed
size.  A factorization machine adds to the linear weights an interaction of every two terms, the inner product of their
factors, so that an insult next to the mention of a group can weigh more than both weights say.

Training.  Labels come from a sample of labelled rows of at most about ``max_rows`` for each label, drawn by a hash of
the id; what was drawn less of one label is made good in the intercept.  Terms of fewer than ``least`` rows are left out.
The sample, as lists of terms in the shared folder, is bounded by ``max_rows`` and fitted by one task on an executor, in
a fixed order, so that a lost executor only costs that task; the driver gets the fitted numbers.  There are two parts that
add up.  The first takes the ``max_terms`` terms whose shares differ most clearly between the labels.  The
second takes all terms, so that what is toxic only in combination, and rare words, have weights and factors too; it goes
on from the scores of the first for as long as the loss on a fifth of the sample, kept from it, falls, and is dropped if
it never does.  Scoring is one pass without a shuffle.

Defined cases: a null or empty text has no terms and scores the intercept; without labels of both kinds every score is
the share of toxic labels (0.5 without any); labels of one id that differ all count; rows of one id are each scored; a
null id belongs to no held-out part and is never trained on; whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed_texts, map_batches, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
TABLE = 1 << 20
MAX_ROWS = 20_000
MAX_TERMS = 4096
MIN_Z = 4.0
FACTORS = 8
ROUNDS = 30
STEP, DECAY, BATCH = 0.05, 1e-4, 256
FOLDS = 5
LEAST_ROWS = 5
PATIENCE = 4  # rounds without a smaller loss on the rows kept apart
MORE_ROUNDS = 60
PART = 1 << 16  # terms of a row of the stored machine
MODEL = "at long, intercept double, width int, terms binary, weights binary, factors binary"
SLOW = 1e-3  # start of the squared gradients of the second part, so that terms of few rows move little


def word_terms(word: str) -> list[int]:
    """Hashed terms of one word."""
    forms = {"=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)}
    return [xxhash.xxh32_intdigest(f) % TABLE for f in forms]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Machine:
    """A fitted factorization machine: kept terms, intercept, weights, factors."""

    terms: np.ndarray
    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, places: np.ndarray) -> float:
        factors = self.factors[places].astype(np.float64)
        total = factors.sum(axis=0)
        return float(self.intercept + self.weights[places].sum(dtype=np.float64) + 0.5 * (total @ total - (factors ** 2).sum()))

    def score(self, places: np.ndarray) -> float:
        """Probability of the label for the kept terms at these places."""
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(places)))))


def fit(rows: list[np.ndarray], labels: np.ndarray, n: int, intercept: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Adaptive gradient steps on the logistic loss; rows hold places of terms."""
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(n), rng.normal(0, 0.05, (n, FACTORS)), intercept
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            x = np.zeros((len(part), n), np.float32)
            for i, r in enumerate(part):
                x[i, rows[r]] = 1
            total = x @ v
            z = b + x @ w + 0.5 * ((total ** 2).sum(1) - x @ (v ** 2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            seen = x.T @ error
            dw = seen + DECAY * w
            dv = x.T @ (error[:, None] * total) - seen[:, None] * v + DECAY * v
            db = error.sum()
            gw += dw ** 2
            gv += dv ** 2
            gb += db ** 2
            w -= STEP * dw / np.sqrt(gw)
            v -= STEP * dv / np.sqrt(gv)
            b -= STEP * db / math.sqrt(gb)
    return b, w, v


def loss(z: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - labels * z)) if len(z) else math.inf


def refine(rows: list[np.ndarray], labels: np.ndarray, offset: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and factors of all n terms that lower the loss beyond the given scores, on rows kept apart from the steps.

    The list of rows is emptied on the way."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(rows))
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.05, (n, FACTORS)).astype(np.float32)
    gw, gv = np.full(n, SLOW, np.float32), np.full((n, FACTORS), SLOW, np.float32)

    def packed(part: np.ndarray) -> tuple:
        counts = [len(rows[r]) for r in part]
        terms = np.concatenate([rows[r] for r in part])
        for r in part:  # held once
            rows[r] = terms[:0]
        cols = np.unique(terms)
        return cols, terms, counts, part

    def batches(part: np.ndarray) -> list[tuple]:
        return [packed(part[at:at + BATCH]) for at in range(0, len(part), BATCH)]

    def added(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights[:, k], n) for k in range(weights.shape[1])], 1)

    def scores(batch: tuple) -> tuple:
        _, terms, counts, part = batch
        row, held = np.repeat(np.arange(len(part)), counts), v[terms]
        total = added(row, held, len(part))
        return row, total, (offset[part] + np.bincount(row, w[terms], len(part))
                            + 0.5 * ((total ** 2).sum(1) - np.bincount(row, (held ** 2).sum(1), len(part))))

    apart, steps = batches(order[:len(order) // FOLDS]), batches(order[len(order) // FOLDS:])
    known = np.concatenate([labels[b[3]] for b in apart]) if apart else np.zeros(0)
    best, found, since = loss(np.concatenate([offset[b[3]] for b in apart]), known) if apart else -math.inf, None, 0
    for _ in range(MORE_ROUNDS):
        for k in rng.permutation(len(steps)):
            cols, terms, _, part = steps[k]
            row, total, z = scores(steps[k])
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            at = np.searchsorted(cols, terms)
            seen = np.bincount(at, error[row], len(cols))
            dw = seen + DECAY * w[cols]
            dv = added(at, (error[:, None] * total)[row], len(cols)) - seen[:, None] * v[cols] + DECAY * v[cols]
            gw[cols] += dw ** 2
            gv[cols] += dv ** 2
            w[cols] -= STEP * dw / np.sqrt(gw[cols])
            v[cols] -= STEP * dv / np.sqrt(gv[cols])
        now, since = loss(np.concatenate([scores(b)[2] for b in apart]), known) if apart else math.inf, since + 1
        if now < best:
            best, found, since = now, (w.copy(), v.copy()), 0
        elif since >= PATIENCE:
            break
    return found


def fit_sample(truth: np.ndarray, sizes: np.ndarray, held: np.ndarray, shift: float, max_terms: int, least: int) -> Machine:
    """The machine of a sample: labels and numbers of terms of its rows, and the terms of all rows one after the other."""
    pos, neg = int(truth.sum()), int(len(truth) - truth.sum())
    if not pos or not neg:
        share = 0.5 if pos == neg else float(pos > 0)
        odds = 0.0 if pos == neg else math.copysign(30.0, share - 0.5)
        return Machine(np.zeros(0, np.int64), odds, np.zeros(0), np.zeros((0, FACTORS)))
    of_row = np.repeat(truth.astype(bool), sizes)
    toxic, clean = np.bincount(held[of_row], minlength=TABLE), np.bincount(held[~of_row], minlength=TABLE)
    chosen = np.flatnonzero(toxic + clean >= least)
    toxic, clean = toxic[chosen], clean[chosen]
    place = np.full(TABLE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    places = place[held]
    del of_row, held
    ends = np.cumsum(sizes)
    rows = [(p := places[end - n:end])[p >= 0] for n, end in zip(sizes, ends, strict=True)]
    del places
    # the same order whatever the order of the files
    order = sorted(range(len(rows)), key=lambda i: (truth[i], xxhash.xxh3_128_digest(rows[i].tobytes())))
    rows, truth = [rows[i] for i in order], truth[order].astype(np.float64)
    # terms by how clearly their shares differ between the labels
    p, q, mean = toxic / pos, clean / neg, (toxic + clean) / (pos + neg)
    z = np.abs(p - q) / np.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg) + 1e-12)
    clear = np.sort(np.lexsort((chosen, -z))[:max_terms])
    clear = clear[z[clear] >= MIN_Z]
    at = np.full(len(chosen), -1, np.int64)
    at[clear] = np.arange(len(clear))
    first = Machine(chosen[clear], *fit([(f := at[x])[f >= 0] for x in rows], truth, len(clear), math.log(pos / neg)))
    offset = np.array([first.logit((f := at[x])[f >= 0]) for x in rows], np.float32)
    first.intercept += shift
    if (more := refine(rows, truth, offset, len(chosen))) is None:
        return first
    weights, factors = more
    weights[clear] += first.weights
    both = np.zeros((len(chosen), 2 * FACTORS), np.float32)
    both[:, FACTORS:] = factors
    both[clear, :FACTORS] = first.factors
    return Machine(chosen, first.intercept, weights, both)


def fold(id_col: str) -> Column:
    """Remainder that decides the held-out part."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """About max_rows training rows of each label by a hash of the id, and the part of each label that was drawn."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold("doc_id") != 0))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {label: min(1.0, max_rows / n) for label, n in counts.items()}
    places = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    wanted = [(F.col("label") == label) & (places < round(part * 1_000_000)) for label, part in drawn.items()]
    rows = known.where(wanted[0] if len(wanted) == 1 else wanted[0] | wanted[1]) if wanted else known
    return rows, drawn


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, least: int = LEAST_ROWS) -> Machine:
    """Fit on the labelled rows outside the held-out part."""
    drawn_rows, drawn = sample(labels, id_col, label_col, max_rows)
    # at most about 2 * max_rows pairs of numbers
    texts = keyed_texts(docs, id_col, text_col).join(F.broadcast(drawn_rows), "doc_id").select("label", "text")

    def terms(label: list[int], text: list[str]) -> dict:
        known: dict[str, list[int]] = {}
        out = []
        for t in text:
            words = words_of(t)
            for w in words:
                if w not in known:
                    known[w] = word_terms(w)
            out.append(np.unique(np.array([x for w in words for x in known[w]], np.int32)))
        return {"label": label, "terms": out}

    rows = written(map_batches(texts, lambda: terms, "label int, terms array<int>"), "labelled-terms")
    shift, target = math.log(drawn[0] / drawn[1]) if len(drawn) == 2 else 0.0, arrow_schema(MODEL)

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        truth, sizes, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for batch in batches:
            lists = batch.column(1)
            truth.append(batch.column(0).to_numpy().astype(np.int32))
            sizes.append(np.diff(lists.offsets.to_numpy()).astype(np.int64))
            held.append(lists.flatten().to_numpy().astype(np.int32))
        machine = fit_sample(np.concatenate(truth), np.concatenate(sizes), np.concatenate(held), shift, max_terms, least)
        for at in range(0, max(1, len(machine.terms)), PART):
            parts = (x[at:at + PART].astype(kind).tobytes() for x, kind in (
                (machine.terms, np.int64), (machine.weights, np.float32), (machine.factors, np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, machine.intercept, machine.factors.shape[1], *parts)],
                                             schema=target)

    # the bounded sample is read by one task; at most a row for each place of the table comes back
    parts = sorted(written(rows.coalesce(1).mapInArrow(fitted, MODEL), "machine").collect(), key=lambda r: r["at"])
    if not parts:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    columns = [np.concatenate([np.frombuffer(r[c], kind) for r in parts]) for c, kind in (
        ("terms", np.int64), ("weights", np.float32), ("factors", np.float32))]
    return Machine(columns[0], parts[0]["intercept"], columns[1], columns[2].reshape(len(columns[0]), parts[0]["width"]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    def make():
        place = np.full(TABLE, -1, np.int64)
        place[machine.terms] = np.arange(len(machine.terms))

        def work(key: list, held: list[bool], text: list[str]) -> dict:
            known: dict[str, tuple[int, ...]] = {}
            scores = []
            for t in text:
                found: set[int] = set()
                for w in words_of(t):
                    if (kept := known.get(w)) is None:
                        kept = known[w] = tuple(p for x in word_terms(w) if (p := int(place[x])) >= 0)
                    if kept:
                        found.update(kept)
                scores.append(machine.score(np.array(sorted(found), np.int64)))
            return {"doc_id": key, "held_out": held, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}
        return work

    texts = keyed_texts(docs, id_col, text_col).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text")
    return map_batches(texts, make, "doc_id long, held_out boolean, score double, predicted int")
