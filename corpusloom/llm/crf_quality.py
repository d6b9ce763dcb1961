"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad from its own features (shares of capitals,
symbols, repeats ... in steps) and those of the lines beside it; labels of
neighbouring lines depend on each other. Training gives every line its
document's label. A document's quality is the mean of its lines' forward-backward
marginals weighted by their length, put on a scale where 0.5 separates the two
labels best (logistic calibration on the training documents).

Defined cases: a text without words (null too) is one empty line and gets that
line's score; with no labelled document, or of one class only, every document
gets the smoothed share of label 1 (0.5 without labels); rows that repeat a
doc_id are scored each; an empty table gives an empty result. Inputs of a score
are the bytes of the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._labels import training_rows

PER_CLASS = 2000
SEGMENT = 128
CHUNK = 2 << 20
STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95], np.float32)


def _table(characters: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(characters)] = True
    return t


_UPPER = _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(0xC0, 256)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#*$%&<>@^_~=+{}[]\\/")
_BAR = _table(b"|")
_SHOUT = _table(b"!")
_STOP = _table(b".,;:?\"'()-")
_FINAL = _table(b".!?:;\"'")


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, length of each line in bytes, each document's first line)."""
    start, end, first = A.line_spans(data, off)
    begin, finish = A.spans(data, off)
    words = A.span_hash(data, begin, finish)
    a, b = np.searchsorted(begin, start), np.searchsorted(begin, end)
    n = (b - a).astype(np.float32)
    n_words, n_bytes = np.maximum(n, 1), np.maximum(end - start, 1).astype(np.float32)

    def per_line(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return (c[end] - c[start]).astype(np.float32)

    def per_words(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return (c[b] - c[a]).astype(np.float32)

    wide_upper = np.zeros(len(data), bool)  # capitals of Latin-1 as two bytes
    wide_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    line_of = np.searchsorted(start, begin, "right") - 1
    doc_of_line = np.repeat(np.arange(len(off) - 1), np.diff(first))
    beside = np.zeros(len(words), bool)
    beside[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    again = pd.Series(words ^ A.mix(line_of.astype(A.U64) + A.U64(1))).duplicated().to_numpy()
    whole = A.run_hash(words, a, b) ^ A.mix(doc_of_line.astype(A.U64) + A.U64(1))
    twin = A.repeated(whole) & (n > 0)
    counts = np.diff(np.searchsorted(begin, off))
    at, per = A.windows(counts, 3)
    covered = np.zeros(len(words), bool)
    if len(at):
        doc = np.repeat(np.arange(len(counts), dtype=A.U64), per)
        twice = at[A.repeated(A.ngram_hash(words, 3)[at] ^ A.mix(doc + A.U64(1)))]
        for k in range(3):
            covered[twice + k] = True
    ends_well = np.zeros(len(start), np.float32)
    ends_well[n > 0] = _FINAL[data[finish[b[n > 0] - 1] - 1]]
    rows = [
        (per_line(_UPPER[data]) + per_line(wide_upper)) / np.maximum(per_line(_LETTER[data]), 1),
        per_line(_SYMBOL[data]) / n_bytes,
        per_line(_BAR[data]) / n_words,
        per_line(_SHOUT[data]) / n_words,
        per_line(_DIGIT[data]) / n_bytes,
        per_line(_STOP[data]) / n_words,
        np.minimum((end - start) / n_words / 20, 1).astype(np.float32),
        per_words(beside) / n_words,
        per_words(again) / n_words,
        per_words(covered) / n_words,
        twin.astype(np.float32),
        np.minimum(np.log1p(n) / 7, 1).astype(np.float32),
        ends_well,
        (n == 0).astype(np.float32),
    ]
    return np.stack(rows, axis=1).astype(np.float32), np.maximum(end - start, 1), first


def design(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps of a line's own features, the features of the lines before and after it, and a constant."""
    before, after = np.zeros_like(raw), np.zeros_like(raw)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    steps = (raw[:, :, None] > STEPS).reshape(len(raw), -1).astype(np.float32)
    return np.concatenate([steps, raw, before, after, np.ones((len(raw), 1), np.float32)], axis=1)


def forward_backward(u: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward values (lines x 2) and log partition (chains); u: what speaks for good at each line.

    Chains are taken longest first, so step t is one operation on all chains
    longer than t.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    head, longest = first[:-1][order], int(length.max(initial=0))
    active = np.searchsorted(-length[order], -np.arange(longest), "left")
    alpha, beta = np.empty((len(u), 2)), np.zeros((len(u), 2))
    for t in range(longest):
        at = head[: active[t]] + t
        if t == 0:
            alpha[at] = start
        else:
            p = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(p[:, 0] + move[0, 0], p[:, 1] + move[1, 0])
            alpha[at, 1] = np.logaddexp(p[:, 0] + move[0, 1], p[:, 1] + move[1, 1])
        alpha[at, 1] += u[at]
    for t in range(longest - 1, 0, -1):
        at = head[: active[t]] + t
        q0, q1 = beta[at, 0], beta[at, 1] + u[at]
        beta[at - 1, 0] = np.logaddexp(q0 + move[0, 0], q1 + move[0, 1])
        beta[at - 1, 1] = np.logaddexp(q0 + move[1, 0], q1 + move[1, 1])
    last = first[1:] - 1
    return alpha, beta, np.logaddexp(alpha[last, 0], alpha[last, 1])


class Crf:
    """weights, move (2 x 2), start (2), and the calibration of document scores."""

    def __init__(self, size: int):
        self.weights, self.move, self.start = np.zeros(size), np.zeros((2, 2)), np.zeros(2)
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def line_marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        u = x @ self.weights
        alpha, beta, z = forward_backward(u, first, self.move, self.start)
        return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - np.repeat(z, np.diff(first)), 0))

    def aggregate(self, raw: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        good = self.line_marginals(design(raw, first), first)
        return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1])

    def score(self, raw: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1 / (1 + np.exp(-(self.scale * _logit(self.aggregate(raw, length, first)) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_crf(raws: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam over chains of at most SEGMENT lines, then the calibration on whole documents."""
    if not len(labels) or labels.min() == labels.max():
        model = Crf(0)
        model.constant = float((labels.sum() + 1) / (len(labels) + 2))
        return model
    raw, n = np.concatenate(raws), np.array([len(r) for r in raws])
    first = np.concatenate([[0], np.cumsum(n)])
    x = design(raw, first).astype(np.float64)
    heads = np.unique(np.concatenate([first[:-1], *(np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > SEGMENT)]))
    chain = np.append(heads, len(x))
    y = np.repeat(labels, n).astype(np.int64)
    # both classes weigh alike, whatever their numbers
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    w_line, w_chain = np.repeat(weight, n), np.repeat(weight, n)[heads]
    joined = np.ones(len(x), bool)
    joined[heads] = False
    at = np.flatnonzero(joined)
    chain_of = np.repeat(np.arange(len(heads)), np.diff(chain))
    model = Crf(x.shape[1])
    theta = np.concatenate([model.weights, np.zeros(4), np.zeros(2)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        k = x.shape[1]
        model.weights, model.move, model.start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        u = x @ model.weights
        alpha, beta, z = forward_backward(u, chain, model.move, model.start)
        good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z[chain_of], 0))
        grad = np.empty_like(theta)
        grad[:k] = x.T @ ((good - y) * w_line)
        for i in range(2):
            for j in range(2):
                edge = np.exp(np.minimum(alpha[at - 1, i] + model.move[i, j] + beta[at, j] + j * u[at] - z[chain_of[at]], 0))
                grad[k + 2 * i + j] = ((edge - ((y[at - 1] == i) & (y[at] == j))) * w_line[at]).sum()
        grad[k + 4] = ((1 - good[heads] - (y[heads] == 0)) * w_chain).sum()
        grad[k + 5] = ((good[heads] - (y[heads] == 1)) * w_chain).sum()
        grad = grad / len(heads) + l2 * theta
        grad[k : k + 4] += 0.01 * theta[k : k + 4]  # documents never mix labels in training, but they may mix lines
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = _logit(model.aggregate(raw, np.concatenate(lengths), first))
    a, b = 1.0, 0.0
    target = np.where(labels == 1, 1 - 1 / (2 + (labels == 1).sum()), 1 / (2 + (labels == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        g = np.array([((p - target) * weight * s).sum() + 1e-3 * a, ((p - target) * weight).sum()])
        h = p * (1 - p) * weight
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    model.scale, model.shift = max(float(a), 1e-3), float(b)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf:
    """Learn from up to per_class labelled documents of either class that aren't held out."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", CHUNK):
            raw, length, first = line_features(*A.utf8(batch.column("text")))
            cut = [pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()) for x in (raw, length)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), *cut], ["label", "h", "raw", "length"])

    drawn = training_rows(docs, labels, "quality", per_class).mapInArrow(features, "label int, h long, raw binary, length binary")
    rows = sorted(((r["h"], bytes(r["raw"]), bytes(r["length"]), r["label"]) for r in drawn.collect()))
    n = 14
    raws = [np.frombuffer(r[1], np.float32).reshape(-1, n) for r in rows]
    return fit_crf(raws, [np.frombuffer(r[2], np.int64) for r in rows], np.array([r[3] for r in rows], np.int64))


def quality_score(model: Crf, text: Column | str = "text") -> Column:
    """The quality of a text column, 0 to 1."""

    def score(texts: pa.Array) -> pa.Array:
        out, at = [np.zeros(0)], 0
        _, off = A.utf8(texts)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
            out.append(model.score(*line_features(*A.utf8(texts.slice(at, to - at)))))
            at = to
        A.release()
        return pa.array(np.concatenate(out), pa.float64())

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(score, "double")(column.cast("string"))
