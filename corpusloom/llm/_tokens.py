"""Token ids of whole texts by the tokenizers library, a text's distinct units encoded once.

For a tokenizer whose pre-tokenizer drops white space and never joins across
it, a text's ids are its words' ids one after another. Each chunk's distinct
units (a word, or a word and the ASCII punctuation that ends it) go through the
library; frequent units stay in a bounded cache of the worker. Units are told
apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from corpusloom.llm import _arrays as A

CACHE = 1 << 19
TURN = 1 << 14  # units of one call: the library's results hold about a kilobyte each
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_loaded: dict[tuple[str, int], Tokens] = {}


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to hash, starts and ends of the units, and each document's first unit.

    ASCII letters are put in lower case as the tokenizer does, but in words with
    a "<", where a special token may be spelt.
    """
    starts, ends = A.spans(data, off)
    lower = _LOWER[data]
    odd = np.zeros(len(starts), bool)
    if (data == 0x3C).any():
        odd = np.diff(np.concatenate([[0], np.cumsum(data == 0x3C)])[np.stack([starts, ends])], axis=0)[0] > 0
        at = A.ragged(starts[odd], (ends - starts)[odd])
        lower[at] = data[at]
    if not len(starts):
        return lower, starts, ends, np.searchsorted(starts, off)
    core = np.maximum.accumulate(np.where(_PUNCT[lower], -1, np.arange(len(lower))))[ends - 1]
    cut = (core >= starts) & (core < ends - 1) & ~odd & _ALNUM[lower[np.maximum(core, 0)]]
    all_starts = np.sort(np.concatenate([starts, core[cut] + 1]), kind="stable")
    all_ends = np.sort(np.concatenate([ends, core[cut] + 1]), kind="stable")
    return lower, all_starts, all_ends, np.searchsorted(all_starts, off)


class Tokens:
    """Encoder for one tokenizer file; end is the id that closes each document."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        self.keys, self.at, self.pool = np.zeros(0, A.U64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lists = []
        for at in range(0, len(words), TURN):
            lists += [x.ids for x in self.library.encode_batch_fast(words[at : at + TURN], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        return sizes, flat

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the documents, each closed by the end id."""
        lower, starts, ends, first = units(data, off)
        codes, keys = pd.factorize(A.span_hash(lower, starts, ends))
        n = len(keys)
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(n, bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        begin[known], size[known] = self.at[where[known]], np.diff(self.at)[where[known]]
        pool = self.pool
        if not known.all():
            example = np.empty(n, np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            new = np.flatnonzero(~known)
            sizes, flat = self._ids(lower.tobytes(), starts[example[new]], ends[example[new]])
            begin[new], size[new] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, flat])
            if len(self.keys) + len(new) <= CACHE:
                order = np.argsort(merged := np.concatenate([self.keys, keys[new]]))
                starts_, sizes_ = np.concatenate([self.at[:-1], begin[new]]), np.concatenate([np.diff(self.at), sizes])
                self.keys, self.pool = merged[order], pool[A.ragged(starts_[order], sizes_[order])]
                self.at = np.concatenate([[0], np.cumsum(sizes_[order])])
        ids = pool[A.ragged(begin[codes], size[codes])]
        counts = A.totals(size[codes], first) + 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.uint32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body], out[offsets[1:] - 1] = ids, self.end
        return out, offsets


def tokens(path: str, end: int) -> Tokens:
    """The worker's encoder for this file, loaded once."""
    if (path, end) not in _loaded:
        _loaded[path, end] = Tokens(path, end)
    return _loaded[path, end]
