"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text's words (runs of ASCII letters and digits and of other characters, in
lower case) are hashed to 2**22 buckets; buckets that at least three training
documents hold have an embedding, all others share the zero vector. Filters of
one, two and three words run over the embeddings, the largest value of each
filter over the whole text goes through a rectifier, and one layer gives the
probability. The language is guessed from the text's own function words; per
language a threshold is chosen on training documents kept apart from the
gradient steps, and the score is shifted so that 0.7 is that threshold.

Defined cases: a text without words (null too) is the zero vector alone; with no
labelled document, or of one class only, every document gets the smoothed share
of label 1 (0.5 without labels); rows that repeat a doc_id are scored each; an
empty table gives an empty result. Inputs of a score are the bytes of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._labels import label_shares, training_rows

PER_CLASS = 2500
CUT = 0.7
BUCKETS = 1 << 22
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12
CHUNK = 1 << 20

# Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be by this are from have not",
    "fr": "le la les des et du une est que qui dans pour sur pas avec au par plus ce il",
    "de": "der die und das den von zu mit sich des auf für ist nicht ein eine als auch es dem",
    "es": "el los las del y que una por con para se su al lo como más pero sus le ya",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.ones(256, bool)
_BREAK[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
_BREAK[0x80:] = False


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, each document's first word)."""
    lower = _LOWER[data]
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lower[wide] += 32
    starts, ends = A.spans(lower, off, _BREAK)
    return (A.span_hash(lower, starts, ends) & A.U64(BUCKETS - 1)).astype(np.int32), np.searchsorted(starts, off)


def _language_table() -> np.ndarray:
    """A bit for each language that has the bucket's word."""
    table = np.zeros(BUCKETS, np.uint8)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        raw = [w.encode() for w in words.split()]
        off = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        got, _ = word_buckets(np.frombuffer(b"".join(raw), np.uint8), off)
        table[got] |= 1 << k
    return table


class Cnn:
    """buckets (ascending), embeddings (row 0 is the zero vector), filters (DIM x positions x FILTERS), output layer, thresholds."""

    def __init__(self, buckets: np.ndarray, embeddings: np.ndarray, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.buckets, self.embeddings = buckets, embeddings.astype(np.float32)
        self.filters = [draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, : FILTERS // 2] = 1
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, len(self.bias)).astype(np.float32)
        for k in range(len(WIDTHS)):
            self.out[k * FILTERS : k * FILTERS + FILTERS // 2] = 0.5
        self.last = np.float32(-1)
        self.thresholds = np.full(len(FUNCTION_WORDS) + 1, 0.5)
        self.constant: float | None = None
        self._rows: np.ndarray | None = None
        self._languages: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None, "_languages": None}

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if self._rows is None:
            self._rows = np.zeros(BUCKETS, np.int32)
            self._rows[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return self._rows[buckets]

    def languages(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language with most function words; the last index where none has any."""
        if self._languages is None:
            self._languages = _language_table()
        marks = self._languages[buckets]
        votes = np.stack([A.totals(marks >> k & 1, first) for k in range(len(FUNCTION_WORDS))], axis=1)
        return np.where(votes.any(axis=1), votes.argmax(axis=1), len(FUNCTION_WORDS))

    def values(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter values of width WIDTHS[k] at every word of embeddings x; beyond the end stands the zero vector."""
        f = self.filters[k]
        out = x @ f[0]
        for j in range(1, len(f)):
            out[:-j] += x[j:] @ f[j]
        return out

    def probabilities(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of documents; one zero vector stands behind each, so that no filter reaches the next document."""
        n = len(first) - 1
        gap = first[1:] + 2 * np.arange(n)
        padded = np.zeros(len(rows) + 2 * n, np.int32)
        body = np.ones(len(padded), bool)
        body[gap] = body[gap + 1] = False
        padded[body] = rows
        begin = first[:-1] + 2 * np.arange(n)
        x = self.embeddings[padded]
        top = np.concatenate([np.maximum.reduceat(self.values(x, k), begin, axis=0) for k in range(len(WIDTHS))], axis=1)
        return 1 / (1 + np.exp(-(np.maximum(top + self.bias, 0) @ self.out + self.last).astype(np.float64)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        buckets, first = word_buckets(data, off)
        p = self.probabilities(self.rows(buckets), first)
        limit = self.thresholds[self.languages(buckets, first)]
        shift = math.log(CUT / (1 - CUT)) - _logit(limit)
        return 1 / (1 + np.exp(-(_logit(p) + shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit_cnn(texts: list[np.ndarray], labels: np.ndarray, shares: dict[int, int], epochs: int = 6, least_steps: int = 600, seed: int = 1) -> Cnn:
    """texts: the buckets of each document's words; every fifth document sets thresholds, the others train."""
    if not len(labels) or labels.min() == labels.max():
        model = Cnn(np.zeros(0, np.int64), np.zeros((1, DIM)))
        model.constant = float((labels.sum() + 1) / (len(labels) + 2))
        return model
    draw = np.random.default_rng(seed)
    apart = np.arange(len(labels)) % 5 == 4
    train = np.flatnonzero(~apart)
    if len(set(labels[train].tolist())) < 2:
        train = np.arange(len(labels))
    seen = [np.unique(t) for t in texts]
    held = np.bincount(np.concatenate([seen[i] for i in train]), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate([np.zeros(0, np.int64), *(seen[i] for i in train if labels[i])]), minlength=BUCKETS)
    known = np.flatnonzero(held >= 3)
    n1 = int(labels[train].sum())
    odds = np.log((toxic[known] + 0.5) / (n1 + 1)) - np.log((held[known] - toxic[known] + 0.5) / (len(train) - n1 + 1))
    e = draw.normal(0, 0.05, (len(known) + 1, DIM))
    e[1:, 0] += 0.5 * np.clip(odds * held[known] / (held[known] + 5), -3, 3)
    e[0] = 0
    model = Cnn(known, e)
    docs = [np.append(model.rows(t), [0, 0]) for t in texts]
    # Adam on the dense parts; the embeddings of the words that won a filter take plain steps
    dense = [*model.filters, model.bias, model.out]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step, each = 0, range(FILTERS)
    for _ in range(max(epochs, -(-32 * least_steps // len(train)))):
        order = draw.permutation(train)
        for a in range(0, len(order), 32):
            grads = [np.zeros_like(p) for p in dense]
            touched, change, last = [], [], 0.0
            for i in order[a : a + 32].tolist():
                rows = docs[i]
                x = model.embeddings[rows]
                won = [model.values(x, k) for k in range(len(WIDTHS))]
                at = [h.argmax(axis=0) for h in won]
                top = np.concatenate([h[w, each] for h, w in zip(won, at, strict=True)]) + model.bias
                z = np.maximum(top, 0)
                delta = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z @ model.out + model.last))))) - labels[i]
                grads[-1] += delta * z
                last += delta
                back = np.where(top > 0, delta * model.out, 0).astype(np.float32)
                grads[-2] += back
                for k, w in enumerate(at):
                    g = back[k * FILTERS : (k + 1) * FILTERS]
                    for j in range(WIDTHS[k]):
                        place = np.minimum(w + j, len(rows) - 1)
                        grads[k][j] += (x[place] * g[:, None]).T
                        touched.append(rows[place])
                        change.append(g[:, None] * model.filters[k][j].T)
            step += 1
            for p, g, mm, vv in zip(dense, grads, m, v, strict=True):
                g = g / 32
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
            model.last -= np.float32(0.05 * last / 32)
            np.add.at(model.embeddings, np.concatenate(touched), -0.02 * np.concatenate(change))
            model.embeddings[0] = 0
    rest = np.flatnonzero(apart) if len(set(labels[apart].tolist())) == 2 else train
    first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rest])])
    flat = np.concatenate([texts[i] for i in rest])
    p, language, y = model.probabilities(model.rows(flat), first), model.languages(flat, first), labels[rest]
    weight = np.where(y == 1, shares.get(1, 1) / max((y == 1).sum(), 1), shares.get(0, 1) / max((y == 0).sum(), 1))
    model.thresholds[:] = _best_cut(p, y, weight)
    for k in range(len(FUNCTION_WORDS)):
        mine = language == k
        if min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= 20:
            model.thresholds[k] = _best_cut(p[mine], y[mine], weight[mine])
    return model


def _best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the least weighted error, in the middle of its gap on the log-odds scale."""
    order = np.argsort(p)
    s, y, weight = _logit(p[order]), y[order], weight[order]
    error = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, -weight))])  # of calling the first k clean
    new = np.concatenate([[True], s[1:] != s[:-1], [True]])
    at = np.flatnonzero(new)
    k = at[np.argmin(error[at])]
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    return float(1 / (1 + np.exp(-(edges[k] + edges[k + 1]) / 2)))


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Cnn:
    """Learn from up to per_class labelled documents of either class that aren't held out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", CHUNK):
            got, first = word_buckets(*A.utf8(batch.column("text")))
            cut = pa.array([got[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), cut], ["label", "h", "words"])

    drawn = training_rows(docs, labels, "toxic", per_class).mapInArrow(words, "label int, h long, words binary")
    rows = sorted((r["h"], bytes(r["words"]), r["label"]) for r in drawn.collect())
    return fit_cnn([np.frombuffer(r[1], np.int32) for r in rows], np.array([r[2] for r in rows], np.int64), label_shares(labels, "toxic"))


def toxicity_score(model: Cnn, text: Column | str = "text") -> Column:
    """The toxicity of a text column, 0 to 1; 0.7 is the threshold of the text's language."""
    shared: list[Cnn] = [model]

    def score(texts: pa.Array) -> pa.Array:
        out, at = [np.zeros(0)], 0
        _, off = A.utf8(texts)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
            out.append(shared[0].score(*A.utf8(texts.slice(at, to - at))))
            at = to
        A.release()
        return pa.array(np.concatenate(out), pa.float64())

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(score, "double")(column.cast("string"))
