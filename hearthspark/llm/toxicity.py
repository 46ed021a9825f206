"""Operator 6, toxicity by a linear-chain conditional random field with hidden token states.

Each token is clean or toxic. All tokens have features: the word, its prefixes and its end, and the words beside it, hashed to SLOTS weights. Labels are
per document, so token labels are those that a document's label implies: in a clean document every token is clean, in a toxic one at least one
token is not, and which is left to the chain (a hidden-state field). The weights maximise the conditional likelihood of the labels, sum of -log Z over
clean and of log(1 - 1/Z) over toxic documents, where the all-clean path has weight one: forward-backward gives each token's
marginal and with it the gradient. A document's score is the chain's probability of any toxic token, calibrated by a logistic function of its log odds that is fitted on the training documents; spans are
the tokens whose marginal is high, in a flagged document at least the highest.

That likelihood is not concave, so the fit begins from evidence: features are counted by class, and those whose surplus in toxic documents passes a likelihood-ratio test over all
features start at their log odds, the others at zero and under a stronger ridge, which leaves them to many documents' evidence.

The fit is distributed: the training texts, at most ``max_train`` labelled rows and whole, are packed into arrays of token numbers once; each step of L-BFGS is
a job whose tasks return one gradient each, of the slots that their texts have (two megabytes at most). The driver holds weights and a few gradients, no texts. The model's size is fixed, it goes to the workers
by value; texts are scored where they lie, without a shuffle. Chains are cut into segments of SEGMENT tokens whose transfer
matrices are computed side by side, so long texts cost what their length costs.

Cases: null and empty texts have score zero; without training rows of both classes the score is constant, the share of toxic training rows (0 if
none); repeated rows each give a row; labels of unknown ids and null labels are ignored, of several labels of an id the larger counts; an empty table gives
an empty result; columns other than the named ones are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import cut

#: Bound of the fit: labelled rows used.
MAX_TRAIN = 12_000
FOLDS = 5
#: Weights of hashed features.
SLOTS = 1 << 19
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3,)
#: Weight of the squared norm against the likelihood, of features with and without evidence of their own; chance of any false evidence; steps of the fit.
RIDGE, WEAK_RIDGE, ALPHA, STEPS = 0.2, 10.0, 0.05, 30
SEGMENT = 64
#: Tokens that are held side by side, texts of a pack, and tasks of the fit.
CHUNK, PACK, TASKS = 200_000, 256, 8
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 250_000
_OWN = 1 + len(PREFIXES) + len(SUFFIXES)


def fold(id_col: str, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def slots(word: str) -> list[int]:
    """Of a word: slots of the word, its prefixes and its end (SLOTS where it is too short), then of a word before and of a word after that is this one."""
    word = word.lower()
    n, w = len(word), word.encode("utf-8", "surrogatepass")
    part = (lambda i, j: w[i:j]) if n == len(w) else (lambda i, j: word[i:j].encode("utf-8", "surrogatepass"))
    out = [crc32(w, 1) % SLOTS]
    out += [crc32(part(0, k), 2) % SLOTS if n > k else SLOTS for k in PREFIXES]
    out += [crc32(part(n - k, n), 3) % SLOTS if n > k else SLOTS for k in SUFFIXES]
    return [*out, crc32(w, 4) % SLOTS, crc32(w, 5) % SLOTS]


def least_shingle(text: Column, n: int = 5) -> Column:
    """The least hash of the runs of ``n`` words: nearly always the same for near copies, hardly ever for other texts."""
    hashes = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: F.xxhash64(x))
    return F.array_min(F.transform(F.arrays_zip(*[F.slice(hashes, i + 1, 1 << 30).alias(f"h{i}") for i in range(n)]), lambda x: F.xxhash64(x)))


@dataclass
class Chains:
    """Figures of several chains: ``log_z`` of each; if asked for, ``marginals`` of all tokens in a row and ``pairs``, expected moves (0 to 1, 1 to 0, 1 to 1) of each."""

    log_z: np.ndarray
    marginals: np.ndarray | None = None
    pairs: np.ndarray | None = None


def run_chains(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, full: bool = False) -> Chains:
    """Forward (and backward) over chains that stand in a row. ``emit``: log weight of each token's toxic state; ``trans``: log weights of moves to
    toxic, from it and of staying; the clean state, the move from clean to clean and the place before the first token count zero."""
    n_seg = -(-lengths // SEGMENT)
    first = np.concatenate([[0], np.cumsum(n_seg)])
    size, starts = int(first[-1]), np.concatenate([[0], np.cumsum(lengths)])
    where = np.repeat(first[:-1] * SEGMENT - starts[:-1], lengths) + np.arange(len(emit))
    e, inside = np.ones(size * SEGMENT), np.zeros(size * SEGMENT, bool)
    e[where], inside[where] = np.exp(np.clip(emit, -40, 40)), True
    e, inside = e.reshape(size, SEGMENT).T.copy(), inside.reshape(size, SEGMENT).T.copy()
    to, out, stay = np.exp(np.clip(trans, -20, 20))
    # Transfer matrices of the segments, from state i to state j, up to the factor exp(scale).
    m = np.zeros((2, 2, size))
    m[0, 0] = m[1, 1] = 1
    scale = np.zeros(size)
    for t in range(SEGMENT):
        a, b = m[:, 0] + m[:, 1] * out, (m[:, 0] * to + m[:, 1] * stay) * e[t]
        top = np.maximum(a.max(axis=0), b.max(axis=0))
        on = inside[t]
        m[:, 0], m[:, 1] = np.where(on, a / top, m[:, 0]), np.where(on, b / top, m[:, 1])
        scale += np.where(on, np.log(top), 0)
    flat, scale = m.reshape(4, size).T.tolist(), scale.tolist()
    log_z, begin = np.zeros(len(lengths)), np.zeros((size, 2))
    for d in range(len(lengths)):
        x, y, logs = 1.0, 0.0, 0.0
        for s in range(first[d], first[d + 1]):
            begin[s] = x, y
            a, b, c, f = flat[s]
            x, y = x * a + y * c, x * b + y * f
            z = x + y
            x, y, logs = x / z, y / z, logs + math.log(z) + scale[s]
        log_z[d] = max(logs, 0.0)
    if not full:
        return Chains(log_z)
    end = np.ones((size, 2))
    for d in range(len(lengths)):
        x, y = 0.5, 0.5
        for s in range(first[d + 1] - 1, first[d] - 1, -1):
            end[s] = x, y
            a, b, c, f = flat[s]
            x, y = a * x + b * y, c * x + f * y
            x, y = x / (x + y), y / (x + y)
    forward, backward = np.zeros((SEGMENT + 1, 2, size)), np.zeros((SEGMENT, 2, size))
    forward[0] = begin.T
    for t in range(SEGMENT):
        x, y = forward[t]
        a, b = x + y * out, (x * to + y * stay) * e[t]
        forward[t + 1] = np.where(inside[t], np.stack([a, b]) / (a + b), forward[t])
    backward[-1] = end.T
    for t in range(SEGMENT - 1, 0, -1):
        x, y = backward[t]
        a, b = x + to * e[t] * y, out * x + stay * e[t] * y
        backward[t - 1] = np.where(inside[t], np.stack([a, b]) / (a + b), backward[t])
    both = forward[1:] * backward
    marginals = (both[:, 1] / both.sum(axis=1)).T.ravel()[where]
    x, y = forward[:-1, 0], forward[:-1, 1]
    moves = np.stack([x * to * e * backward[:, 1], y * out * backward[:, 0], y * stay * e * backward[:, 1]])
    moves = np.where(inside, moves / (x * backward[:, 0] + moves.sum(axis=0)), 0).sum(axis=1)
    pairs = np.zeros((len(lengths), 3))
    for k in range(3):
        pairs[:, k] = np.add.reduceat(np.append(moves[k], 0), np.minimum(first[:-1], size)) * (n_seg > 0)
    return Chains(log_z, marginals, pairs)


def emissions(u: np.ndarray, before: np.ndarray, after: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, bias: float) -> np.ndarray:
    """Log weights of the tokens' toxic states: of the word, of the word before and of the word after, within each chain."""
    emit = u[tokens] + bias
    if len(tokens) > 1:
        ends = np.cumsum(lengths)
        inner = np.ones(len(tokens), bool)
        inner[ends[(ends > 0) & (ends < len(tokens))]] = False  # the first tokens of later chains
        link = inner[1:]
        emit[1:] += before[tokens[:-1]] * link
        emit[:-1] += after[tokens[1:]] * link
    return emit


def _words(theta: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights of each distinct word, before another and after it."""
    w = theta[: SLOTS + 1]
    return w[ids[:, :_OWN]].sum(axis=1), w[ids[:, _OWN]], w[ids[:, _OWN + 1]]


def objective(theta: np.ndarray, ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels and its gradient. ``theta``: SLOTS weights, one that stays zero, bias and three moves; ``ids``: slots() of each distinct word."""
    found = run_chains(emissions(*_words(theta, ids), tokens, lengths, theta[SLOTS + 1]), lengths, theta[SLOTS + 2 :], full=True)
    z = np.maximum(found.log_z, 1e-12)
    value = float(np.where(toxic, np.log(-np.expm1(-z)), -found.log_z).sum())
    c = np.where(toxic, 1 / np.expm1(np.minimum(z, 700)), -1.0)
    d = np.repeat(c, lengths) * found.marginals
    grad = np.zeros_like(theta)
    per = np.bincount(tokens, d, len(ids))
    link = np.ones(max(len(tokens) - 1, 0), bool)
    ends = np.cumsum(lengths)
    link[ends[(ends > 0) & (ends < len(tokens))] - 1] = False
    left, right = np.bincount(tokens[:-1], d[1:] * link, len(ids)), np.bincount(tokens[1:], d[:-1] * link, len(ids))
    grad[: SLOTS + 1] = np.bincount(ids.ravel(), np.concatenate([np.repeat(per[:, None], _OWN, axis=1), left[:, None], right[:, None]], axis=1).ravel(), SLOTS + 1)
    grad[SLOTS], grad[SLOTS + 1], grad[SLOTS + 2 :] = 0.0, d.sum(), c @ found.pairs
    return value, grad


def maximise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int = STEPS, memory: int = 8, small: float = 1e-4) -> np.ndarray:
    """L-BFGS; ends when a step gains less than ``small`` of the value."""
    value, grad = f(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append((a, s, y))
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max())
        for a, s, y in reversed(kept):
            q += (a - y @ q / (s @ y)) * s
        if q @ grad <= 0:
            q, past = grad / max(1.0, np.abs(grad).max()), []
        # A step that gains enough and leaves a smaller slope: longer while the slope holds, shorter where too little is gained.
        rate, low, high, slope = 1.0, 0.0, math.inf, float(q @ grad)
        for _ in range(12):
            new = theta + rate * q
            new_value, new_grad = f(new)
            if not new_value >= value + 1e-4 * rate * slope:
                high = rate
            elif new_grad @ q > 0.9 * slope:
                low = rate
            else:
                break
            rate = (low + high) / 2 if low and high < math.inf else low * 4 if low else high / 4
        if new_value <= value:
            break
        s, y = new - theta, grad - new_grad
        if s @ y > 1e-10:
            past = [*past[1 - memory :], (s, y)]
        gained, theta, value, grad = new_value - value, new, new_value, new_grad
        if gained < small * abs(value):
            break
    return theta


def log_odds(log_z: np.ndarray) -> np.ndarray:
    """Of any toxic token, within bounds: log(z - 1)."""
    return np.clip(np.where(log_z < 30, np.log(np.maximum(np.expm1(np.minimum(log_z, 30)), 1e-300)), log_z), -20, 20)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the log odds, by Newton steps with a little ridge."""
    rows, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(2)
        w = w + np.linalg.solve(h, rows.T @ (y - p) - 0.05 * w)
    return (float(w[0]), float(w[1])) if w[1] > 0 else (0.0, 1.0)


@dataclass
class Model:
    theta: np.ndarray | None = None
    link: tuple[float, float] = (0.0, 1.0)
    constant: float | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in a worker; the weights of words met are kept."""

    def __init__(self, model: Model) -> None:
        self.constant, self.link = model.constant, model.link
        if self.constant is None:
            theta = model.theta.astype(np.float64)
            self.theta, self.bias, self.trans = theta, theta[SLOTS + 1], theta[SLOTS + 2 :]
            self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((0, 3))

    def chains(self, texts: list[str | None], full: bool = False) -> tuple[Chains, np.ndarray]:
        if len(self.numbers) > _CACHE:
            self._forget()
        words, numbers = [_WORD.findall(text or "") for text in texts], self.numbers
        lengths = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        new = [w for w in dict.fromkeys(flat) if w not in numbers]
        if new:
            ids = np.array([slots(w) for w in new])
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, np.stack(_words(self.theta, ids), axis=1)])
        tokens = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        return run_chains(emissions(*self.rows.T, tokens, lengths, self.bias), lengths, self.trans, full), lengths

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The calibrated probability of any toxic token."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text or "") // 6
            if held > CHUNK or i == len(texts) - 1:
                x = log_odds(self.chains(texts[at : i + 1])[0].log_z)
                out.append(1 / (1 + np.exp(-self.link[0] - self.link[1] * x)))
                at, held = i + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def spans(self, text: str | None, at_least: float) -> list[dict]:
        """Tokens of the text as it stands, in code points, end exclusive, whose marginal is ``at_least`` that, or the highest."""
        if self.constant is not None:
            return []
        p = self.chains([text], full=True)[0].marginals
        at_least = min(at_least, p.max(initial=0))
        return [{"start": m.start(), "end": m.end(), "score": float(x)} for m, x in zip(_WORD.finditer(text or ""), p, strict=True) if x >= at_least]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to packs: slots of the distinct words, tokens, lengths, classes."""

    def packed() -> pa.RecordBatch:
        cols = [np.array([slots(w) for w in words], "<i4").reshape(len(words), _OWN + 2), np.array(tokens, "<i4"), np.array(lengths, "<i4"), np.array(toxic, "u1")]
        counts = [pa.array([len(toxic)], pa.int64()), pa.array([sum(toxic)], pa.int64())]
        return pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()], pa.binary()) for c in cols], *counts], names=["ids", "tokens", "lengths", "toxic", "n", "t"])

    words: dict[str, int] = {}
    tokens, lengths, toxic = [], [], []
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = [w.lower() for w in _WORD.findall(text.as_py() or "")]
            tokens += [words.setdefault(w, len(words)) for w in found]
            lengths.append(len(found))
            toxic.append(y)
            if len(lengths) == PACK or len(tokens) > CHUNK:
                yield packed()
                words, tokens, lengths, toxic = {}, [], [], []
    if lengths:
        yield packed()


def _arrays(row: tuple) -> tuple[np.ndarray, ...]:
    ids, tokens, lengths, toxic = (np.frombuffer(x.as_py(), t) for x, t in zip(row, ("<i4", "<i4", "<i4", "u1"), strict=True))
    return ids.reshape(-1, _OWN + 2), tokens.astype(np.int64), lengths.astype(np.int64), toxic == 1


def _filled(x: np.ndarray, kind: str) -> list[pa.Array]:
    """A vector, or rows of one length, without the places that are zero throughout: numbers of the others, or a bit for each place where that is shorter, and what is there. Most texts have few of all slots, and the driver holds what all tasks return."""
    there = x.astype(kind).reshape(-1, x.shape[-1]).any(axis=0)
    at, bits = np.flatnonzero(there).astype("<i4"), np.packbits(there)
    return [pa.array([(at if at.nbytes < bits.nbytes else bits).tobytes()], pa.binary()), pa.array([x[..., there].astype(kind).tobytes()], pa.binary())]


def _add(total: np.ndarray, at: bytes | pa.Buffer, values: bytes | pa.Buffer, kind: str) -> None:
    """Adds what _filled() returned."""
    size, places = total.shape[-1], np.frombuffer(at, "u1")
    places = places.view("<i4") if len(places) < -(-size // 8) else np.flatnonzero(np.unpackbits(places, count=size))
    total[..., places] += np.frombuffer(values, kind).reshape(*total.shape[:-1], len(places))


def _binaries(rows: pa.Table) -> Iterator[tuple[pa.Buffer, ...]]:
    """Rows of binary columns, not copied."""
    return (tuple(x.as_buffer() for x in row) for row in zip(*rows.columns, strict=True))


def _gradients(sent):
    """``sent``: broadcast theta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = sent.value.astype(np.float64)
        total, grad = 0.0, np.zeros(len(theta))
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                value, part = objective(theta, *_arrays(row))
                total, grad = total + value, grad + part
        yield pa.RecordBatch.from_arrays([pa.array([total]), *_filled(grad, "<f4")], names=["value", "at", "grad"])

    return run


def _odds(sent):
    """(x, y): log odds and class of the packs' documents. ``sent``: broadcast theta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = sent.value.astype(np.float64)
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, tokens, lengths, toxic = _arrays(row)
                emit = emissions(*_words(theta, ids), tokens, lengths, theta[SLOTS + 1])
                yield pa.RecordBatch.from_arrays([pa.array(log_odds(run_chains(emit, lengths, theta[SLOTS + 2 :]).log_z)), pa.array(toxic.astype(float))], names=["x", "y"])

    return run


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean and toxic documents in which each slot of a word itself occurs."""
    counts = np.zeros((2, SLOTS + 1), "<i4")
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(4)), strict=True):
            ids, tokens, lengths, toxic = _arrays(row)
            for part, y in zip(np.split(tokens, np.cumsum(lengths)[:-1]), toxic, strict=True):
                counts[int(y), np.unique(ids[np.unique(part), :_OWN])] += 1  # a word beside is no evidence of its own
    yield pa.RecordBatch.from_arrays(_filled(counts, "<i4"), names=["at", "counts"])


def evidence(counts: np.ndarray, n: int, t: int, alpha: float = ALPHA) -> np.ndarray:
    """Log odds of the slots (clean and toxic ``counts`` of ``n`` documents, ``t`` of them toxic) whose one-sided likelihood ratio is above log(slots tested / alpha); zero for the others."""
    c, own = counts.astype(float)
    share, base, seen = own / np.maximum(own + c, 1), t / n, own >= 3
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen, own * np.log(share / base) + np.where(c > 0, c * np.log((1 - share) / (1 - base)), 0), 0)
    strong = seen & (share > base) & (ratio > np.log(max(seen.sum(), 1) / alpha))
    strong[SLOTS] = False
    return np.where(strong, np.log((own + 0.5) / (t + 1)) - np.log((c + 0.5) / (n - t + 1)), 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, folds: int = FOLDS) -> Model:
    """The model of the labelled rows outside fold 0; at most ``max_train`` of them, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id", folds) != 0))
    sample = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    # At most max_train rows of two numbers each, so this side may be broadcast.
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    # Copies and near copies would count as independent witnesses: of texts with one least shingle, that of the least hash is kept.
    order = F.struct(F.xxhash64("_id"), "_id", F.xxhash64("text"))
    train = train.groupBy(F.coalesce(least_shingle(F.col("text")), F.lit(0)).alias("_key"), "toxic").agg(F.min_by("text", order).alias("text"))
    # So few tasks, whatever the cluster, as each returns a gradient.
    packs = cut(train.repartition(TASKS).sortWithinPartitions("_key", "toxic").select("text", "toxic").mapInArrow(_pack, "ids binary, tokens binary, lengths binary, toxic binary, n long, t long"))
    n = packs.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    if not n["n"] or n["t"] in (0, n["n"]):
        return Model(constant=n["t"] / n["n"] if n["n"] else 0.0)

    counts = np.zeros((2, SLOTS + 1), np.int64)
    for at, found in _binaries(packs.mapInArrow(_support, "at binary, counts binary").toArrow()):
        _add(counts, at, found, "<i4")
    theta = np.zeros(SLOTS + 5)
    theta[: SLOTS + 1] = evidence(counts, n["n"], n["t"])
    ridge = np.where(theta != 0, RIDGE, WEAK_RIDGE)
    # A word's features mostly come together, so each starts at less than its own odds; the bias starts low.
    theta *= 0.7
    theta[SLOTS + 1], ridge[SLOTS + 1 :] = -8.0, RIDGE / 10

    def asked(job, theta: np.ndarray, schema: str) -> pa.Table:
        """A job's rows, as Arrow, which the driver's JVM passes on as it gets them; the weights go out by a broadcast that is taken back, as closures of this size would pile up on disks."""
        sent = docs.sparkSession.sparkContext.broadcast(theta.astype(np.float32))
        rows = packs.mapInArrow(job(sent), schema).toArrow()
        sent.destroy()
        return rows

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        rows, grad = asked(_gradients, theta, "value double, at binary, grad binary"), np.zeros(len(theta))
        total = sum(rows["value"].to_pylist())
        for at, part in _binaries(rows.drop_columns("value")):
            _add(grad, at, part, "<f4")
        total -= float(ridge @ theta**2) / 2
        grad -= ridge * theta
        return total, grad

    theta = maximise(value, theta)
    # At most max_train rows of two numbers.
    odds = asked(_odds, theta, "x double, y double")
    return Model(theta.astype(np.float32), calibrate(odds["x"].to_numpy(), odds["y"].to_numpy()))


SCORED = "score double, spans array<struct<start:int,end:int,score:double>>"


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and, where that is a half or more, ``spans``: tokens whose marginal is ``at_least`` that or the highest, in code points, end exclusive."""
    names = [c for c in docs.columns if c not in ("score", "spans")]
    kept = docs.select(*names)
    at_text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            scores = scorer.scores(texts)
            spans = [scorer.spans(t, at_least) if s >= 0.5 else [] for t, s in zip(texts, scores, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*names, "score", "spans"])

    schema = reduce(lambda s, f: s.add(f), kept.schema.fields, type(kept.schema)()).simpleString()[7:-1]
    return kept.mapInArrow(run, f"{schema},{SCORED}" if schema else SCORED)


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column; the other columns stay in the JVM."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)), dtype="float64")

    return F.pandas_udf(run, "double", functionType=F.PandasUDFType.SCALAR_ITER)(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, and ``spans``."""
    model = fit(docs, labels, id_col, text_col)
    scored = score_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
