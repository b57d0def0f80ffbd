"""Token ids of whole texts by the ``tokenizers`` library, encoding each distinct piece of a text once.

A byte-level tokenizer never joins what stands before a single space or line feed between two visible characters with what
follows, so a text is the sequence of its pieces cut there, and a piece has the same ids in every text.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from .textbytes import prefix_sums, segment_hash

HELD_PIECES = 2_000_000  # pieces that a worker remembers; beyond it starts afresh
ENCODED_AT_ONCE = 4096  # pieces given to the tokenizer at a time, as each result takes about a KB until its ids are read


_OTHER, _LETTER, _MARK, _QUOTE, _BLANK = range(5)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of ASCII bytes; letters and digits count alike."""
    table = np.zeros(256, np.uint8)
    table[33:127] = _MARK
    table[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _LETTER
    table[[0x20, 0x0A]] = _BLANK
    table[ord("'")] = _QUOTE
    return table


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = self.tokenizer.to_str()
        #: Only byte-level pieces without a normalizer are known to be independent of each other.
        self.cuts = '"normalizer":null' in described and '"type":"ByteLevel"' in described
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        counts, ids = [], []
        for i in range(0, len(pieces), ENCODED_AT_ONCE):
            part = self.plain([piece.decode() for piece in pieces[i : i + ENCODED_AT_ONCE]])
            counts.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.fromiter(chain.from_iterable(part), self.dtype))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.place = np.insert(self.place, at, len(self.first) - 1 + order)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and how many each text has."""
        raw = data.tobytes()
        if not self.cuts or any(token in raw for token in self.added):
            ids = self.plain([raw[a:b].decode() for a, b in zip(starts[:-1], starts[1:], strict=True)])
            return np.fromiter(chain.from_iterable(ids), self.dtype), np.array([len(x) for x in ids], np.int64)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(starts) - 1, np.int64)
        first = self.pieces(data, starts)
        end = np.append(first[1:], len(data))
        piece, keys = pd.factorize(segment_hash(prefix_sums(data), first, end))
        if len(self.keys) > HELD_PIECES:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            example = np.zeros(len(keys), np.int64)
            example[piece] = np.arange(len(piece))
            self.learn(keys[new], [raw[first[i] : end[i]] for i in example[new]])
            at = np.searchsorted(self.keys, keys)
        place = self.place[at][piece]
        count = np.diff(self.first)[place]
        ends = np.cumsum(count)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.first[place] - ends + count, count)]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(first, starts)])

    @staticmethod
    def pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin: each text, each space or line feed that stands alone between visible characters, and each
        change between letters or digits and marks (but the apostrophe, which may begin a contraction)."""
        kind = _kinds()[data]
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[accented] = kind[accented + 1] = _LETTER
        before, here = kind[:-1], kind[1:]
        cut = ((before == _LETTER) & (here == _MARK)) | ((before == _MARK) & (here == _LETTER))
        visible = (kind == _LETTER) | (kind == _MARK) | (kind == _QUOTE)
        cut[:-1] |= visible[:-2] & (here[:-1] == _BLANK) & visible[2:]
        begins = np.append(True, cut)
        begins[starts[:-1][starts[:-1] < len(data)]] = True
        return np.flatnonzero(begins)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
