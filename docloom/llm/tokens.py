"""Exact token ids of whole texts through the tokenizers library, each distinct unit encoded once per worker.

The two supported pre-tokenizers never join certain neighbours into one token (a letter and a comma, say, or a
word and the white space after it). Texts are cut at such places into units; ids of a text are its units' ids.
"""

from __future__ import annotations

import json
import os

import numpy as np

from docloom.llm.hashing import FOLD, span_hashes

_WS, _SPACE, _LETTER, _DIGIT, _OTHER, _KEEP = range(6)
_CLASS = np.full(256, _KEEP, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[39]] = _KEEP
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[9:14] = _WS
_CLASS[32] = _SPACE
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((_LETTER, _OTHER), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _OTHER), (_OTHER, _LETTER), (_OTHER, _DIGIT)):
    _CUT[_a, _b] = True
for _a in (_LETTER, _DIGIT, _OTHER):
    _CUT[_a, _WS] = _CUT[_a, _SPACE] = True
_CUT = _CUT.ravel()
#: Distinct units a worker keeps; beyond that it starts anew.
CACHE_UNITS = 500_000


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending places at which no token crosses: row starts, and cuts by the classes of the bytes beside them."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # U+00C0 to U+00FF but for the two signs are letters
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    plain = (kind >= _LETTER) & (kind <= _OTHER)
    cut[2:] |= (kind[1:-1] == _WS) & plain[:-2] & plain[2:]  # a lone line end or tab between words
    cut[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        self.fold = FOLD if "Lowercase" in json.dumps(spec["normalizer"]) else None
        kind = json.dumps(spec["pre_tokenizer"])
        self.by_unit = '"ByteLevel"' in kind and '"add_prefix_space": true' not in kind and (spec["normalizer"] is None or '"Replace"' in json.dumps(spec["normalizer"]))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(length.sum())), length

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (uint32) and each row's first (rows + 1)."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if not self.by_unit:
            ids, length = self._encode([data[off[i] : off[i + 1]].tobytes().decode() for i in range(rows)])
            return ids, np.concatenate(([0], np.cumsum(length)))
        starts = unit_starts(data, off)
        ends = np.append(starts[1:], len(data))
        keys, first, inverse = np.unique(span_hashes(data if self.fold is None else self.fold[data], starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            ids, length = self._encode([data[s:e].tobytes().decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = len(self.ids) + np.cumsum(length) - length
            self.keys, self.at, self.length = np.insert(self.keys, place[new], keys[new]), np.insert(self.at, place[new], at), np.insert(self.length, place[new], length)
            self.ids = np.concatenate((self.ids, ids))
            place = np.searchsorted(self.keys, keys)
        place = place[inverse]
        length = self.length[place]
        run = np.concatenate(([0], np.cumsum(length)))
        source = np.repeat(self.at[place] - run[:-1], length) + np.arange(run[-1])
        return self.ids[source], run[np.searchsorted(starts, off)]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder of that file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
