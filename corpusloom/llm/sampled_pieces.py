"""SentencePiece encoding and decoding, and segmentations sampled without replacement.

The lattice of a text has an arc for each piece of the vocabulary that matches at
a place (and the byte pieces of a character that is no piece). Pieces never join
a character to a following space, so a text is a row of segments (spaces and
what follows them; a line break alone) whose lattices are independent; each
distinct segment of a chunk gets its arcs and its backward sums once.

A segmentation's probability is the normalised product of its pieces' weights:
exp(score) of a unigram model, 1 / (rank + 10) for the ranks of a BPE model, to
the power alpha. The Gumbel top-k trick draws k distinct segmentations: a node of
the search is a set of segmentations (a prefix, and what it may not go on with),
its bound is a Gumbel variable at the log of the set's probability, truncated at
its parent's; the best node is expanded along a path drawn from the lattice,
whose leaf has the node's bound, and the sets beside the path are new nodes.
So leaves come out by falling perturbed log probability, as from an A* search
over the whole space. All draws are hashes of the row's key, the seed and their
place in the text, whatever the partitioning.

Inclusion is the probability that a segmentation is among the k given the next
bound: 1 - exp(-exp(log_prob - bound)), and 1 if there is no other.

Defined cases: a null or empty text has one segmentation, of no pieces; U+2581 in
a text is a space, as in the library; rows that repeat a key get the same
samples; a null key is a key of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches

SAMPLES = 3
ALPHA = 1.0
CHUNK = 1 << 20
_SPACE = "▁"
_BASE = A._BASE

_lattices: dict[tuple[str, float], Lattice] = {}


class Lattice:
    """A vocabulary as hash tables of its pieces' prefixes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.alpha = alpha
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        pieces, scores = {}, np.zeros(n)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i).replace(_SPACE, " ").encode()] = i
                scores[i] = model.get_score(i)
        own = scores[list(pieces.values())]
        if len(own) and (own <= 0).all() and (own == np.rint(own)).all() and own.min() < -1000:  # merge ranks
            scores = -np.log(np.minimum(-scores, n) + 10)
        self.log_weights = scores * alpha
        self.byte_log_weight = alpha * (scores[list(pieces.values())].min() if pieces else 0.0)
        if any(b"\n" in p for p in pieces) or any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError("pieces that join a character to a following space or line break are not supported")
        table: dict[int, int] = {}
        for p, i in pieces.items():
            for k in range(1, len(p) + 1):
                table.setdefault(self._raw(p[:k]), -1)
            table[self._raw(p)] = i
        self.longest = max(map(len, pieces), default=0)
        keys, values = np.array(list(table), np.uint64), np.array(list(table.values()), np.int32)
        self.levels = []
        for bits in (20, 16, 14, 12, 12, 12, 12, 12):
            if not len(keys):
                break
            slot = self._slot(keys, len(self.levels), bits)
            _, at = np.unique(slot, return_index=True)
            k, v = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
            k[slot[at]], v[slot[at]] = keys[at], values[at]
            self.levels.append((bits, k, v))
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values = keys[rest], values[rest]
        if len(keys):
            raise ValueError("the vocabulary is too large for the hash tables")

    @staticmethod
    def _raw(p: bytes) -> int:
        up, _ = A.powers(_BASE, len(p) + 1)
        return int((A._BYTES[np.frombuffer(p, np.uint8)] * up[: len(p)]).sum(dtype=np.uint64)) ^ len(p)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (keys * A.U64(0x9E3779B97F4A7C15 + 2 * level) >> A.U64(64 - bits)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key; -1: only a prefix of one; -2: neither."""
        out = np.full(len(keys), -2, np.int32)
        left = np.arange(len(keys))
        for level, (bits, k, v) in enumerate(self.levels):
            slot = self._slot(keys[left], level, bits)
            hit = k[slot] == keys[left]
            out[left[hit]] = v[slot[hit]]
            left = left[~hit]
        return out

    def arcs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, length, piece or -1 for byte pieces, log weight) of all arcs of segments, by place and length."""
        n = len(data)
        end_of = np.repeat(ends, ends - starts)
        up, down = A.powers(_BASE, n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(A._BYTES[data] * up[:n], out=c[1:])
        characters = np.flatnonzero((data & 0xC0) != 0x80)
        active, parts = characters, []
        covered = np.zeros(n, bool)
        size_of = np.diff(np.append(characters, n))
        width = np.zeros(n, np.int64)
        width[characters] = np.minimum(size_of, end_of[characters] - characters)
        for k in range(1, self.longest + 1):
            active = active[active + k <= end_of[active]]
            if not len(active):
                break
            found = self.lookup(((c[active + k] - c[active]) * down[active]) ^ A.U64(k))
            piece = found >= 0
            at = active[piece]
            covered[at[width[at] == k]] = True
            parts.append((at, np.full(len(at), k), found[piece].astype(np.int64), self.log_weights[found[piece]]))
            active = active[found > -2]
        bare = characters[~covered[characters]]
        parts.append((bare, width[bare], np.full(len(bare), -1), width[bare] * self.byte_log_weight))
        at, size, piece, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at.astype(np.int64) << 24 | np.minimum(size, (1 << 24) - 1))
        return at[order].astype(np.int32), size[order].astype(np.int32), piece[order].astype(np.int32), weight[order]


def lattice(path: str, alpha: float) -> Lattice:
    """The worker's lattice tables for this file, made once."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


class _Segments:
    """Distinct segments of texts: arcs by place, their conditional probabilities and sums of them."""

    def __init__(self, model: Lattice, data: np.ndarray, off: np.ndarray):
        n = len(data)
        space, line = data == 0x20, data == 0x0A
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        self.first = np.searchsorted(starts, off)  # segments of each text
        code, keys = pd.factorize(A.span_hash(data, starts, ends))
        example = np.empty(len(keys), np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        size = (ends - starts)[example]
        own = data[A.ragged(starts[example], size)]
        end = np.cumsum(size)
        begin = end - size
        self.begin = begin[code].astype(np.int32)  # where each segment's lattice starts
        self.at, self.size, self.piece, weight = model.arcs(own, begin, end)
        self.data, self.model = own, model
        total = len(own)
        self.off = np.zeros(total + 1, np.int32)  # arcs of each place
        np.cumsum(np.bincount(self.at, minlength=total), out=self.off[1:])
        self.end_of = np.repeat(end.astype(np.int32), size)
        beta = np.zeros(total + 1)
        left = self.end_of[self.at] - self.at
        most = int(left.max(initial=0))
        order = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable").astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=most + 1))[1:]]) if most else np.zeros(1, np.int64)
        inner = self.at + self.size < self.end_of[self.at]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            arc = order[a:b]
            place = self.at[arc]
            value = weight[arc] + np.where(inner[arc], beta[np.minimum(place + self.size[arc], total)], 0.0)
            new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            top = np.maximum.reduceat(value, new)
            per = np.diff(np.append(new, len(value)))
            beta[place[new]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, per)), new))
        nxt = np.where(inner, beta[np.minimum(self.at + self.size, total)], 0.0)
        self.log_p = np.minimum(weight + nxt - beta[self.at], 0.0)
        c = np.concatenate([[0.0], np.cumsum(np.exp(self.log_p))])
        self.cum = (c[1:] - c[self.off[self.at]]).astype(np.float32)
        self.next = np.where(inner, self.at + self.size, np.int32(-1))  # -1: the segment ends
        self.many = np.diff(self.off) > 1

    def walk(self, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs drawn from each place to its segment's end, one walk after another; arcs of each). place -1 is an empty walk."""
        on = np.flatnonzero(place >= 0).astype(np.int32)
        at, steps, count = place[on], [], np.zeros(len(place), np.int64)
        turn = 0
        while len(on):
            turn += 1
            arc = self.off[at]
            go = np.flatnonzero(self.many[at])
            u = (A.mix(seed[on[go]] + A.U64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> A.U64(40)).astype(np.float32) * np.float32(2.0**-24)
            now, last = arc[go], self.off[at[go] + 1] - 1
            while len(go):
                more = (self.cum[now] <= u) & (now < last)
                arc[go[~more]] = now[~more]
                go, now, last, u = go[more], now[more] + 1, last[more], u[more]
            steps.append((on, arc))
            count[on] += 1
            at = self.next[arc]
            more = at >= 0
            on, at = on[more], at[more]
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (which, arc) in enumerate(steps):
            out[base[which] + k] = arc
        return out, count

    def other(self, own: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(an arc beside each own one, by probability; the probability of the rest; whether there is a rest)."""
        place = self.at[own]
        first, last = self.off[place], self.off[place + 1] - 1
        p = np.exp(self.log_p[own])
        before = self.cum[own] - p
        x = pick * np.maximum(1 - p, 0)
        x += np.where(x >= before, p, 0)
        arc = first.copy()
        go = np.arange(len(arc))
        while len(go):
            go = go[((self.cum[arc[go]] <= x[go]) | (arc[go] == own[go])) & (arc[go] < last[go])]
            arc[go] += 1
        arc = np.where(arc == own, np.where(own > first, own - 1, own + 1), arc)
        return arc, 1 - p - np.exp(self.log_p[arc]), last - first > 1

    def other_than(self, taken: list[int], pick: float) -> tuple[int, float, bool]:
        """The same for one place of which several arcs are taken."""
        place = int(self.at[taken[0]])
        options = [a for a in range(int(self.off[place]), int(self.off[place + 1])) if a not in taken]
        weight = np.exp(self.log_p[options])
        k = min(int(np.searchsorted(np.cumsum(weight), pick * weight.sum(), "right")), len(options) - 1)
        return options[k], float(weight.sum() - weight[k]), len(options) > 1

    def ids(self, arcs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, their number for each run of counts arcs)."""
        piece = self.piece[arcs].astype(np.int64)
        width = np.where(piece >= 0, 1, self.size[arcs])
        out = np.repeat(piece, width)
        raw = np.flatnonzero(piece < 0)
        if len(raw):
            place = np.cumsum(width) - width
            bytes_at = A.ragged(self.at[arcs[raw]], width[raw])
            out[A.ragged(place[raw], width[raw])] = self.model.byte_ids[self.data[bytes_at]]
        return out.astype(np.uint32), A.totals(width, np.concatenate([[0], np.cumsum(counts)]))


def _gumbel(x: np.ndarray) -> np.ndarray:
    u = ((x >> A.U64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


def _below(bound: np.ndarray, place: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel variables at place, truncated at bound."""
    x = place + draw
    return np.minimum(bound, x) - np.log1p(np.exp(-np.abs(bound - x)))


class _Paths:
    """One segmentation of each text that has one: arcs, and the bounds of the sets beside it."""

    def __init__(self, texts: np.ndarray, arcs: np.ndarray, counts: np.ndarray, segments: _Segments, top: np.ndarray, fresh: np.ndarray, key: np.ndarray, turn: int):
        """fresh: arcs of each text that a parent path already had."""
        self.texts, self.arcs, self.counts, self.top = texts, arcs, counts, top
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        lp = segments.log_p[arcs]
        self.run = np.concatenate([[0.0], np.cumsum(lp)])
        self.log_prob = self.run[self.bounds[1:]] - self.run[self.bounds[:-1]]
        self.bound = np.full(len(arcs), -np.inf, np.float64)
        new = segments.many[segments.at[arcs]] & (lp < -1e-12)
        for begin, skip in zip(self.bounds[:-1][fresh > 0].tolist(), fresh[fresh > 0].tolist(), strict=True):
            new[begin : begin + skip] = False
        at = np.flatnonzero(new)
        if len(at):
            owner = np.searchsorted(self.bounds, at, "right") - 1
            salt = A.mix(key + A.U64(turn * 4 + 1))
            noise = A.mix(salt[owner] ^ (at - self.bounds[owner]).astype(A.U64))
            rest = np.log(-np.expm1(lp[at]))  # of the other arcs at the place
            self.bound[at] = _below(top[owner], self.run[at] - self.run[self.bounds[owner]] + rest, _gumbel(noise))
        self.taken: dict[int, list[int]] = {}  # flat step -> arcs that its set may not take, besides the path's own


def _best(paths: list[_Paths], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bound, path, flat step) of the best open set of each of n texts."""
    best, which, where = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j, p in enumerate(paths):
        has = np.flatnonzero(p.counts > 0)
        if not len(has):
            continue
        begin = p.bounds[:-1][has]
        top = np.maximum.reduceat(p.bound, begin)
        hit = np.flatnonzero(p.bound == np.repeat(top, p.counts[has]))
        at = hit[np.searchsorted(hit, begin)]
        text = p.texts[has]
        better = top > best[text]
        best[text[better]], which[text[better]], where[text[better]] = top[better], j, at[better]
    return best, which, where


def sample_texts(model: Lattice, data: np.ndarray, off: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each rank: (texts that have it, ids, ids of each text, log probability, perturbed) and, last, the next bounds of all texts."""
    n = len(off) - 1
    s = _Segments(model, data, off)
    per = np.diff(s.first)
    text_of = np.repeat(np.arange(n), per)
    inner = A.ragged(np.zeros(n, np.int64), per)

    def seeds(segment: np.ndarray, turn: int) -> np.ndarray:
        return A.mix(A.mix(keys[text_of[segment]] + A.U64(turn * 4 + 2)) ^ inner[segment].astype(A.U64))

    every = np.arange(len(text_of))
    arcs, count = s.walk(s.begin, seeds(every, 0))
    top = _gumbel(A.mix(keys + A.U64(3)))
    counts = A.totals(count, s.first)
    paths = [_Paths(np.arange(n), arcs, counts, s, top, np.zeros(n, np.int64), keys, 0)]
    # the segment of each arc of a path, by text and segment
    of = [np.repeat(every.astype(np.int32), count)]
    for turn in range(1, k):
        bound, which, where = _best(paths, n)
        texts = np.flatnonzero(bound > -np.inf)
        if not len(texts):
            break
        begin = np.empty(len(texts), np.int64)
        base = np.concatenate([[0], np.cumsum([len(p.arcs) for p in paths])])
        which, where = which[texts], where[texts]
        for j, p in enumerate(paths):
            mine = which == j
            begin[mine] = p.bounds[np.searchsorted(p.texts, texts[mine])]
            p.bound[where[mine]] = -np.inf
        all_arcs, all_of = np.concatenate([p.arcs for p in paths]), np.concatenate(of)
        branch = where - begin
        own = all_arcs[base[which] + where]
        pick = (A.mix(A.mix(keys[texts] + A.U64(turn * 4)) ^ A.U64(77)) >> A.U64(11)).astype(np.float64) * 2.0**-53
        arc, rest, left = s.other(own, pick)
        taken = {}
        for i in [i for i, (j, f) in enumerate(zip(which.tolist(), where.tolist(), strict=True)) if f in paths[j].taken]:
            taken[i] = [*paths[which[i]].taken[int(where[i])], int(own[i])]
            arc[i], rest[i], left[i] = s.other_than(taken[i], float(pick[i]))
        at_segment = all_of[base[which] + where].astype(np.int64)
        # what is left of the branching segment, then all later segments of the text
        lengths = s.first[1:][texts] - at_segment
        flat_segment = A.ragged(at_segment, lengths)
        place = s.begin[flat_segment].copy()
        place[np.cumsum(lengths) - lengths] = s.next[arc]
        drawn, each = s.walk(place, seeds(flat_segment, turn))
        total = A.totals(each, np.concatenate([[0], np.cumsum(lengths)]))
        counts = branch + 1 + total
        bounds = np.concatenate([[0], np.cumsum(counts)])
        arcs, owner = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.int32)
        old, new = A.ragged(base[which] + begin, branch), A.ragged(bounds[:-1], branch)
        arcs[new], owner[new] = all_arcs[old], all_of[old]
        at = bounds[:-1] + branch
        arcs[at], owner[at] = arc, at_segment
        new = A.ragged(at + 1, total)
        arcs[new], owner[new] = drawn, np.repeat(flat_segment.astype(np.int32), each)
        p = _Paths(texts, arcs, counts, s, bound[texts], branch + 1, keys[texts], turn)
        more = np.flatnonzero(left & (rest > 1e-12))
        noise = _gumbel(A.mix(A.mix(keys[texts[more]] + A.U64(turn * 4 + 1)) ^ branch[more].astype(A.U64)))
        p.bound[at[more]] = _below(p.top[more], p.run[at[more]] - p.run[bounds[:-1][more]] + np.log(rest[more]), noise)
        p.taken = {int(at[i]): taken.get(i, [int(own[i])]) for i in more.tolist()}
        paths.append(p)
        of.append(owner)
    following, _, _ = _best(paths, n)
    out = []
    for p in paths:
        ids, sizes = s.ids(p.arcs, p.counts)
        out.append((p.texts, ids, sizes, p.log_prob, p.top, following[p.texts]))
    return out


def sample_pieces(docs: DataFrame, model: str, key: str = "doc_id", k: int = SAMPLES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """k distinct segmentations of every whole text: key, sample (from 0, by falling perturbed), ids (little-endian unsigned
    32-bit), log_prob, perturbed, inclusion. A text with fewer segmentations gives them all."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # U+2581 is the library's sign for a space; every text but the empty one begins with one
    rows = rows.select("key", "h", F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), F.replace("text", F.lit(_SPACE), F.lit(" ")))).alias("text"))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lattice(model, alpha)
        for batch in A.slices(batches, "text", CHUNK):
            hashed = A.mix(batch.column("h").to_numpy().view(A.U64))
            found = sample_texts(tables, *A.utf8(batch.column("text")), hashed, k)
            for rank, (texts, ids, sizes, log_prob, perturbed, bound) in enumerate(found):
                with np.errstate(over="ignore"):
                    inclusion = np.where(np.isneginf(bound), 1.0, -np.expm1(-np.exp(log_prob - bound)))
                cuts = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int64)
                raw = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(texts)), pa.array(np.full(len(texts), rank), pa.int32()), raw, pa.array(log_prob), pa.array(perturbed), pa.array(inclusion)],
                    ["key", "sample", "ids", "log_prob", "perturbed", "inclusion"],
                )

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(samples, f"key {kind}, sample int, ids binary, log_prob double, perturbed double, inclusion double").withColumnRenamed("key", key)


_processors: dict = {}


def _processor(model: str):
    import sentencepiece

    if model not in _processors:
        _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _processors[model]


def encode_pieces(text: Column | str, model: str) -> Column:
    """The library's own ids of a text column; a null text has none."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(_processor(model).encode([t or "" for t in texts.to_pylist()], num_threads=1), pa.list_(pa.int32()))

    return F.arrow_udf(encode, "array<int>")((F.col(text) if isinstance(text, str) else text).cast("string"))


def decode_pieces(ids: Column | str, model: str) -> Column:
    """The text of a column of ids: an array of integers, or little-endian unsigned 32-bit integers."""

    def decode(column: pa.Array) -> pa.Array:
        raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        lists = [np.frombuffer(x or b"", "<u4").tolist() if raw else list(x or []) for x in column.to_pylist()]
        return pa.array(_processor(model).decode(lists) if lists else [], pa.string())

    return F.arrow_udf(decode, "string")(F.col(ids) if isinstance(ids, str) else ids)
