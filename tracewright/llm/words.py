"""Texts to arrays of words, folded and hashed as whole arrays instead of word by word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = dict(zip("аеорсхуіјѕԁһӏԛԝαορνικ", "aeopcxyijsdhlqwaopvik"))
GAP = 32
#: Texts are folded this many characters at a time, so that memory does not follow the length of a text.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point (BMP) -> code of ``a-z0-9``, ``GAP`` for anything that parts words, 0 for what stands for nothing (accents, format characters)."""
    table = np.full(0x10000, GAP, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Mn", "Cf", "Me"):
            table[cp] = 0
            continue
        if kind[0] not in "LN":
            continue
        low = ch.lower()
        base = LOOK_ALIKE.get(low[:1]) or unicodedata.normalize("NFKD", low)[:1].lower()
        base = LOOK_ALIKE.get(base, base)
        # Letters outside a-z count as parts of words, by a code of their own kind.
        table[cp] = ord(base) if base.isascii() and base.isalnum() else 128 + cp % 120
    return table


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    p = np.ones(4096, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, len(p)):
            p[i] = p[i - 1] * np.uint64(0x9E3779B97F4A7C15)
    return p


def _plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _hash(part: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``part``, and where in ``part`` each starts; names of ``<tags>`` are no words."""
    cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = fold_table()[np.minimum(cp, 0xFFFF)]
    at = np.flatnonzero(code)
    if len(at) != len(code):
        code = code[at]
    word = code != GAP
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(word)
    lens = end - start
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lens) - lens, lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(code[inside].astype(np.uint64) * _powers()[place & 4095], np.cumsum(lens) - lens)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    first = at[start]
    if 60 in cp:  # '<'
        before = cp[np.maximum(first - 1, 0)]
        before2 = cp[np.maximum(first - 2, 0)]
        keep = ~(((before == 60) & (first > 0)) | ((before == 47) & (before2 == 60) & (first > 1)))
        h, first = h[keep], first[keep]
    return h, first


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words of each text)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[str] = []
    size, low = 0, 0

    def flush(upto: int) -> None:
        nonlocal held, size, low
        if held:
            # One gap between texts, so that no word spans two of them.
            h, first = _hash("\n".join(held))
            ends = np.cumsum([len(t) + 1 for t in held])
            counts[low:upto] += np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(held))[: upto - low]
            hashes.append(h)
        held, size, low = [], 0, upto

    for i, t in enumerate(texts):
        t = _plain(t)
        if len(t) > SLICE:
            flush(i)
            a = 0
            while a < len(t):
                b = min(a + SLICE, len(t))
                if b < len(t):
                    cut = max(t.rfind(" ", a, b), t.rfind("\n", a, b))
                    b = cut + 1 if cut > a else b
                h, _ = _hash(t[a:b])
                hashes.append(h)
                counts[i] += len(h)
                a = b
            low = i + 1
            continue
        held.append(t)
        size += len(t)
        if size >= SLICE:
            flush(i + 1)
    flush(len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
