"""Ids of many different words at once, as the ``tokenizers`` library gives them.

Letters, digits and marks of ASCII and the Latin-1 letters are cut into pieces
by byte, and all pieces merge in step: each round every piece that still has a
known pair merges its lowest-ranked one, leftmost first, as the library does
one word after the other. Other words, and tokenizers that are not built like
the one this is written for, are left to the library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Bytes of a word at most; a longer one would need as many rounds.
WORD_BYTES = 64
_LETTER, _DIGIT, _MARK = 1, 2, 3
_NONE = np.int64(1) << 62
#: Slots of the pair table; pairs whose slot is taken are kept in order beside it.
_SLOT_BITS = 18
_FACTOR = np.uint32(0x9E3779B1)

# Per byte: what it is (0: its word is left to the library), and the byte of its lower case. An apostrophe can begin a
# piece of its own and a "<" a special token. A Latin-1 letter is 0xC3 and a byte of the second pair of tables.
_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, 0x3C]] = 0
_KIND_2 = np.zeros(256, np.int8)
_KIND_2[0x80:0xC0] = _LETTER
_KIND_2[[0x97, 0xB7]] = 0  # the signs of multiplication and division
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER_2 = np.arange(256, dtype=np.uint8)
_LOWER_2[0x80:0x9F] += 32

_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    """The pairs of a vocabulary with their ranks, and the ids of its bytes (first row: inside a piece, second: at its end)."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.byte_ids = np.array([[vocab[c + end] for c in _byte_letters()] for end in ("", "</w>")], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}  # of a repeated pair the last, as there
        key = np.array([a << 16 | b for a, b in rank], np.uint32)
        # Rank and merged id in one number that also sorts by rank; 32 bits below are free for a place.
        worth = np.array([k << 16 | made for k, made in rank.values()], np.int64) << 28
        slot = (key * _FACTOR) >> np.uint32(32 - _SLOT_BITS)
        first = np.unique(slot, return_index=True)[1]
        self.key = np.full(1 << _SLOT_BITS, 0xFFFFFFFF, np.uint32)
        self.worth = np.full(1 << _SLOT_BITS, _NONE)
        self.key[slot[first]], self.worth[slot[first]] = key[first], worth[first]
        more = np.setdiff1d(np.arange(len(key)), first)
        more = more[np.argsort(key[more])]
        self.more_key, self.more_worth = np.r_[key[more], np.uint32(0xFFFFFFFF)], np.r_[worth[more], _NONE]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 16 | right).astype(np.uint32)
        slot = (key * _FACTOR) >> np.uint32(32 - _SLOT_BITS)
        held = self.key[slot]
        out = self.worth[slot]
        other = np.flatnonzero(held != key)
        out[other] = _NONE
        other = other[held[other] != 0xFFFFFFFF]
        at = np.searchsorted(self.more_key, key[other])
        out[other] = np.where(self.more_key[at] == key[other], self.more_worth[at], _NONE)
        return out

    def merged(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of ``sizes`` byte ids each, merged: the ids, and the place of each one's first byte, ascending."""
        out = ids.copy()
        gone = np.zeros(len(ids), bool)
        place = np.arange(len(ids))
        worth = np.full(len(ids), _NONE)
        worth[:-1] = self.of_pairs(ids[:-1], ids[1:])
        worth[np.cumsum(sizes) - 1] = _NONE
        begin = np.cumsum(sizes) - sizes
        while len(sizes):
            low = np.minimum.reduceat(worth + np.arange(len(worth)), begin)
            open_ = low < _NONE
            low, hit = low[open_], low[open_] & ((1 << 28) - 1)
            out[place[hit]] = low >> 28 & 0xFFFF
            gone[place[hit + 1]] = True
            keep = np.repeat(open_, sizes)
            keep[hit + 1] = False
            place, worth, hit, sizes = place[keep], worth[keep], hit - begin[open_], sizes[open_] - 1
            begin = np.cumsum(sizes) - sizes
            hit += begin
            worth[hit] = _NONE
            right = hit[hit < begin + sizes - 1]
            worth[right] = self.of_pairs(out[place[right]], out[place[right + 1]])
            left = hit[hit > begin]
            worth[left - 1] = self.of_pairs(out[place[left - 1]], out[place[left]])
        stay = np.flatnonzero(~gone)
        return out[stay], stay

    def plain(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of ``data``: which are done here, their ids one after the other, and how many each has (0 if not done)."""
        lead = np.r_[False, data[:-1] == 0xC3]
        kind = np.where(lead, _KIND_2[data], _KIND[data])
        bad = np.r_[0, np.cumsum(kind == 0)]
        done = (size <= WORD_BYTES) & (bad[begin + size] == bad[begin])
        n = np.where(done, size, 0)
        word = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(word)) + np.repeat(begin - (np.cumsum(n) - n), n)
        if not len(at):
            return done, np.zeros(0, np.int64), n
        kind, lower = kind[at], np.where(lead[at], _LOWER_2[data[at]], _LOWER[data[at]])
        first = np.r_[True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)]
        last = np.r_[first[1:], True]
        ids, place = self.merged(self.byte_ids[last.astype(np.int8), lower], np.diff(np.flatnonzero(first), append=len(word)))
        return done, ids, np.bincount(word[place], minlength=len(n))


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges | None:
    """Those of a tokenizer file, or none if it is not built like the one known here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    known = all(spec.get(k) == v for k, v in _KNOWN.items()) and all(model.get(k) == v for k, v in _KNOWN_MODEL.items())
    special = all(t["content"].startswith("<") and not t["normalized"] for t in spec["added_tokens"])
    return Merges(model) if known and special and max(model["vocab"].values()) < 1 << 16 else None
