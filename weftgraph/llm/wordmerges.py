"""Byte-pair merges of many words at once, over arrays of ids.

For tokenizers that merge the bytes of a word and mark its end: the ids are those that the library gives, as the merges and
their order are read from the tokenizer itself. In each round every word merges its pair of lowest rank, the leftmost if it
has several, until no pair has a rank. Words that are done leave the arrays.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.uint64((1 << 64) - 1)
_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> list[str]:
    """The character by which byte-level tokenizers write each byte: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordMerges:
    def __init__(self, spec: dict):
        """``spec``: a tokenizer's description as read from its JSON. ``ValueError`` if it is of another kind."""
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        if model["type"] != "BPE" or not end or not plain or steps != ["Split", "ByteLevel"] or normal != ["NFC", "Replace", "Lowercase"] or len(model["vocab"]) >= 1 << 16:
            raise ValueError("not a lower-casing tokenizer that merges the bytes of words")
        vocabulary, symbols = model["vocab"], byte_symbols()
        self.inner = np.array([vocabulary[c] for c in symbols], np.int32)
        self.final = np.array([vocabulary[c + end] for c in symbols], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint64)
        self.keys, self.ranks = np.full(1 << _BITS, _EMPTY), np.full(1 << _BITS, _NONE)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[at] != _EMPTY:
                at = (at + 1) % (1 << _BITS)
            self.keys[at], self.ranks[at] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        out, at = np.full(len(keys), _NONE), self._slots(keys)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            again = ~hit & (there != _EMPTY)
            todo, at = todo[again], (at[again] + 1) % (1 << _BITS)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """At the place of each word's first bytes its ids, at the others -1. ``starts``: where the words (not empty) begin."""
        out, ids = np.full(len(data), -1, np.int32), self.inner[data]
        ends = np.append(starts[1:], len(data)) - 1
        ids[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        place = np.arange(len(data))
        rank = np.full(len(data), _NONE)  # of each symbol with the next one of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            done = least == _NONE
            out[place[done]] = ids[done]
            at = np.flatnonzero((rank == least) & ~done)
            at = at[np.append(True, word[at][1:] != word[at][:-1])] if len(at) else at
            ids[at] = self.made[rank[at]]
            keep = ~done
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            changed = moved[at]
            ids, word, place, rank = ids[keep], word[keep], place[keep], rank[keep]
            n = len(ids)
            for here in (changed, changed[(changed > 0)] - 1):
                here = here[here >= 0]
                paired = np.zeros(len(here), bool)
                inner = here < n - 1
                paired[inner] = word[here[inner]] == word[here[inner] + 1]
                rank[here[~paired]] = _NONE
                here = here[paired]
                rank[here] = self._rank(ids[here], ids[here + 1])
        return out
