"""Evaluation items that leaked into documents: Wu-Manber search, then confirmation of the passage.

Patterns are all windows of ``WINDOW`` words of the items (all words of a shorter item),
without sentences that several different items share. A document is searched over its words: a block of two words looks up how far
the search may skip (block shift table); where it may not skip, the hash of the window's
words picks a bucket of patterns and the words are compared one by one. The cursors of many
stretches of text move together, as arrays.

A hit names item and place. The hits of a document and item on neighbouring diagonals are
one alignment: every item word that stands at its place (a few words to and fro allowed)
earns its weight, every other one costs ``MISS`` times its weight, and the best stretch is
the passage. Weights are the rarity of a word among the items, so that a scenario with
other particulars loses the words that matter. A leak is a passage of at least
``LEAST_SHARE`` of the item's words and at least ``LEAST_WORDS`` words, or the whole item if
it has fewer; one word less is let through, as a changed word at the end of a passage
shortens it (not for items of fewer than ``STRICT`` words: nothing of them may be missing).

So dear a miss would cut a short passage at a single changed word. A stretch with enough
words in their places is therefore a passage as well if they are evidence enough: what a
word in place tells is its surprise, given the words before it as the other items have
them. The fixed words of a scenario tell next to nothing, its particulars a lot. Here a
miss whose neighbours match costs ``CHANGED``, however rare the word.

Layout, case, accents, look-alike letters, invisible characters and mark-up do not matter.
Null and blank texts or items give no rows; items without words of their own are never
found; items of equal words are found together; repeated rows count once; ids may be any
type; an empty side gives an empty table. More than ``ITEM_CHARS`` characters of items are
refused: they no longer are a held-out set that every task can hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.words import word_hashes

WINDOW = 4
BLOCK = 2
LEAST_SHARE = 1 / 3
LEAST_WORDS = 12
STRICT = 6
MISS = 3.0
#: Evidence (natural logarithm of odds) that a single changed word costs, and that a stretch with changed words must have.
CHANGED, EVIDENT = 2.5, 6.0
#: Words before a word that may foretell it.
BEFORE = 3
#: Words to and fro that an aligned word may be off its diagonal; hits further apart are different alignments.
SLACK, APART = 3, 8
#: Characters of items that one search index may hold; more items mean more passes over the documents.
ITEMS_PER_PASS = 16_000_000
#: Characters of all items together.
ITEM_CHARS = 256_000_000
#: Entries of an array that one step may build: alignments times item words, or hits times their places.
CELLS = 4_000_000
#: Words that one cursor covers.
STRETCH = 256
_TABLE = 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def own_sentences(texts: list[str]) -> list[list[str]]:
    """The sentences of each item that no different item has (compared by their words; copies of an item are not different)."""
    split = [[s for s in _SENTENCE.split(t) if s.strip()] for t in texts]
    keys = []
    for sentences in split:
        h, n = word_hashes(sentences)
        at = np.concatenate([[0], np.cumsum(n)])
        keys.append([h[a:b].tobytes() for a, b in zip(at, at[1:])])
    seen = Counter(k for ks in {b"".join(ks): ks for ks in keys}.values() for k in set(ks))
    return [[s for s, k in zip(ss, ks) if k and seen[k] == 1] for ss, ks in zip(split, keys)]


@dataclass
class Index:
    """Everything a search needs; its size follows the items, not the documents."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1, 0 is any other word
    words: np.ndarray  # word numbers of all items, one after another
    begin: np.ndarray  # where each item starts in words
    share: np.ndarray  # part of a word as written that each entry is (an address has several)
    weight: np.ndarray
    surprise: np.ndarray  # what each entry tells in its place
    written: np.ndarray  # number of the word as written that each entry is of
    need: np.ndarray  # words that a passage of the item must have
    shift: np.ndarray  # by block hash
    bucket: np.ndarray  # sorted hashes of the distinct patterns
    pattern: np.ndarray  # their words
    places: np.ndarray  # places in words of all occurrences, by pattern
    place_at: np.ndarray  # bounds of the patterns in places
    item_of: np.ndarray  # item of each entry of words
    window: int  # words of a pattern


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) * 0x5BD1E995 + b.astype(np.int64) * 0x1B873593) >> 7) & (_TABLE - 1)


def _suffix(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.int64)
    with np.errstate(over="ignore"):
        for k in range(windows.shape[1]):
            h = h * np.int64(6364136223846793005) + windows[:, k].astype(np.int64) + 1442695040888963407
    return h


def surprises(texts: list[str], rarity: dict[int, float]) -> list[np.ndarray]:
    """For each word of each text: its weight, or less if other texts have it too behind one of the ``BEFORE`` words before it."""
    hashes = [word_hashes(t.split())[0] for t in texts]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    vocabulary, words = np.unique(flat, return_inverse=True)
    out = np.array([rarity[int(x)] for x in vocabulary] or [0.0])[words] if len(flat) else np.zeros(0)
    item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    for d in range(1, BEFORE + 1):
        at = np.arange(d, len(flat))
        at = at[item[at] == item[at - d]]
        pair = words[at - d].astype(np.int64) * len(vocabulary) + words[at]
        both, before = _texts_with(pair, item[at]) - 1, _texts_with(words[at - d], item[at]) - 1  # in other texts
        known = both > 0
        out[at[known]] = np.minimum(out[at[known]], np.log(before[known] / both[known]))
    return np.split(out, np.cumsum([len(h) for h in hashes])[:-1])


def _texts_with(key: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each entry, the number of items that have its key."""
    if not len(key):
        return np.zeros(0, np.int64)
    _, key = np.unique(key, return_inverse=True)
    pairs = np.unique(key.astype(np.int64) * (int(item.max()) + 1) + item)
    return np.bincount(pairs // (int(item.max()) + 1))[key]


def build_index(texts: list[str], rarity: dict[int, float], surprise: list[np.ndarray] | None = None, window: int = WINDOW) -> Index:
    """Index of items that have at least ``window`` words."""
    hashes, shares, written, begin = [], [], [], [0]
    for text in texts:
        h, n = word_hashes(text.split())
        hashes.append(h)
        shares.append(np.repeat(1.0 / np.maximum(n, 1), n))
        written.append(np.repeat(np.arange(len(n)), n))
        begin.append(sum(map(len, hashes)))
    surprise = surprises(texts, rarity) if surprise is None else surprise
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    share = np.concatenate(shares) if shares else np.zeros(0)
    tells = np.concatenate(surprise) if surprise else np.zeros(0)
    written_ = np.concatenate(written) if written else np.zeros(0, np.int64)
    vocabulary = np.unique(flat)
    words = (np.searchsorted(vocabulary, flat) + 1).astype(np.int32)
    begin = np.array(begin, np.int64)
    item_of = np.repeat(np.arange(len(texts)), np.diff(begin))
    by_word = np.array([rarity[int(x)] for x in vocabulary] or [0.0])
    total = np.array([share[a:b].sum() for a, b in zip(begin, begin[1:])])
    need = np.minimum(total, np.maximum(LEAST_WORDS, LEAST_SHARE * total)) - (total >= STRICT) - 1e-6
    ends = np.arange(window - 1, len(words))
    ends = ends[item_of[ends] == item_of[ends - window + 1]] if len(ends) else ends
    windows = words[ends[:, None] + np.arange(1 - window, 1)] if len(ends) else np.zeros((0, window), np.int32)
    block = min(BLOCK, window)
    shift = np.full(_TABLE, window - block + 1, np.int8)
    for q in range(block, window + 1):  # a block that ends at word q of a pattern allows a skip of window - q
        np.minimum.at(shift, _block(windows[:, q - block], windows[:, q - 1]), window - q)
    distinct, which = np.unique(windows, axis=0, return_inverse=True)
    bucket = _suffix(distinct)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which.ravel()]
    by = np.argsort(which, kind="stable")
    return Index(vocabulary, words, begin, share, by_word[words - 1] if len(words) else np.zeros(0), tells, written_, need, shift, bucket[order], distinct[order], ends[by], np.searchsorted(which[by], np.arange(len(order) + 1)), item_of, window)


def search(words: np.ndarray, counts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(end place in ``words``, pattern) of every occurrence of a pattern; ``counts``: words of each document."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    spans = -(-counts // STRETCH)
    doc = np.repeat(np.arange(len(counts)), spans)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
    low = begin[doc] + nth * STRETCH
    stop = np.minimum(low + STRETCH, begin[doc + 1])
    window, before = index.window, min(BLOCK, index.window) - 1
    at = np.maximum(low, begin[doc] + window - 1)
    live = at < stop
    at, stop = at[live], stop[live]
    found = []
    while len(at):
        step = index.shift[_block(words[at - before], words[at])]
        found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    if not len(ends) or not len(index.bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = words[ends[:, None] + np.arange(1 - window, 1)]
    h = _suffix(windows)
    lo, hi = np.searchsorted(index.bucket, h, "left"), np.searchsorted(index.bucket, h, "right")
    ends, windows, lo, n = ends[lo < hi], windows[lo < hi], lo[lo < hi], (hi - lo)[lo < hi]
    each = np.repeat(np.arange(len(ends)), n)
    pattern = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    same = (index.pattern[pattern] == windows[each]).all(axis=1)
    return ends[each[same]], pattern[same]


def _spread(ends: np.ndarray, pattern: np.ndarray, begin: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, diagonal) of all places of all hits, about ``CELLS`` at a time; a diagonal is place in words minus place in the items' words."""
    n = index.place_at[pattern + 1] - index.place_at[pattern]
    upto = np.cumsum(n)
    k = 0
    while k < len(ends):
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CELLS, side="right")))
        m = n[k:to]
        each = np.repeat(np.arange(to - k), m)
        place = index.places[index.place_at[pattern[k:to]][each] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)]
        at = ends[k:to][each]
        yield np.searchsorted(begin, at, side="right") - 1, index.item_of[place], at - place
        k = to


def _parts(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in parts of at most 4096 whose longest length times their number stays within ``CELLS``, if they are several."""
    order = np.argsort(lens, kind="stable")
    k = 0
    while k < len(order):
        m = min(4096, len(order) - k)
        while m > 1 and lens[order[k + m - 1]] * m > CELLS:
            m //= 2
        yield order[k : k + m]
        k += m


def passages(words: np.ndarray, counts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, words of the passage) for each alignment that is long enough."""
    ends, pattern = search(words, counts, index)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(ends):
        return none
    begin = np.concatenate([[0], np.cumsum(counts)])
    items = len(index.begin) - 1
    # Which document and item could go together is asked before their alignments are looked at.
    pairs = np.zeros(0, np.int64)
    for doc, item, _ in _spread(ends, pattern, begin, index):
        pairs = np.union1d(pairs, doc * items + item)
    pairs = pairs[_possible(words, begin, index, pairs // items, pairs % items)]
    if not len(pairs):
        return none
    kept = []
    for doc, item, diagonal in _spread(ends, pattern, begin, index):
        ok = np.isin(doc * items + item, pairs)
        kept.append(np.stack([doc[ok], item[ok], diagonal[ok]]))
    doc, item, diagonal = np.unique(np.concatenate(kept, axis=1), axis=1)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > APART)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc, item, low, high = doc[first], item[first], diagonal[first], diagonal[last]
    found = []
    for s in _parts((index.begin[1:] - index.begin[:-1])[item]):
        w = _longest(words, begin, index, doc[s], item[s], low[s] - SLACK, high[s] + SLACK)
        ok = w >= index.need[item[s]]
        found.append((doc[s][ok], item[s][ok], w[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _longest(words: np.ndarray, begin: np.ndarray, index: Index, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words of the best stretch of each alignment (diagonals ``low`` to ``high``), at least those needed if its words in place are evident."""
    a, b = index.begin[item], index.begin[item + 1]
    lens = b - a
    row = np.repeat(np.arange(len(doc)), lens)
    p = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + a[row]
    want, d0, d1 = index.words[p], begin[doc][row], begin[doc + 1][row]
    hit = np.zeros(len(row), bool)
    for k in range(int((high - low).max()) + 1):
        t = p + low[row] + k
        ok = (t >= d0) & (t < d1) & (low[row] + k <= high[row]) & ~hit
        ok[ok] = words[t[ok]] == want[ok]
        hit |= ok
    gain = np.where(hit, 1.0, -MISS) * index.weight[p]
    w = _stretches(row, lens, gain, index.share[p])[0]
    need = index.need[item]
    return np.where(_evident(row, lens, p, hit, index, need, w < need), np.maximum(w, need), w)


def _evident(row: np.ndarray, lens: np.ndarray, p: np.ndarray, hit: np.ndarray, index: Index, need: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether a stretch of each row that is ``asked`` for has ``need`` words in place and evidence of ``EVIDENT``; ``hit``: entries ``p`` that are in place."""
    share = hit * index.share[p]
    # All words in place together are the most that a stretch can have.
    asked = asked & (np.bincount(row, share, len(lens)) >= need - 1e-9) & (np.bincount(row, share * index.surprise[p], len(lens)) >= EVIDENT)
    out, keep = np.zeros(len(lens), bool), asked[row]
    if asked.any():
        out[asked] = _evidence((np.cumsum(asked) - 1)[row[keep]], lens[asked], p[keep], hit[keep], index, need[asked]) >= EVIDENT
    return out


def _evidence(row: np.ndarray, lens: np.ndarray, p: np.ndarray, hit: np.ndarray, index: Index, need: np.ndarray) -> np.ndarray:
    """The most evidence of any stretch of each row with ``need`` words in place; minus infinity if that is below ``EVIDENT`` anyway."""
    share = index.share[p]
    start = np.cumsum(lens) - lens
    # The neighbours of a word as written, which may be several entries.
    edge = np.concatenate([[True], (row[1:] != row[:-1]) | (index.written[p[1:]] != index.written[p[:-1]])])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(p)) - 1
    of = np.cumsum(edge) - 1
    whole = np.add.reduceat(hit, first, dtype=np.int64) == last - first + 1
    single = ~whole & (first > start[row[first]]) & (last < (start + lens - 1)[row[last]])
    single[single] = hit[first[single] - 1] & hit[last[single] + 1]
    # Parts that a changed word has kept tell nothing.
    gain = np.where(whole[of], index.surprise[p] * share, np.where(hit | single[of], 0.0, -np.maximum(CHANGED, MISS * index.weight[p])))
    gain[first[single]] = -CHANGED
    n, width = len(lens), int(lens.max())
    col = np.arange(len(row)) - start[row]
    sums, placed = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    sums[col + 1, row], placed[col + 1, row] = gain, hit * share
    np.cumsum(sums, axis=0, out=sums)
    least = np.minimum.accumulate(sums, axis=0)
    most = (sums - least).max(axis=0)
    go = np.flatnonzero(most >= EVIDENT)  # the others stay below whatever the number of words
    out = np.full(n, -np.inf)
    sums, least, placed, need = sums[:, go], least[:, go], placed[:, go].cumsum(axis=0), need[go]
    best, k, each = np.full(len(go), -np.inf), np.full(len(go), -1), np.arange(len(go))
    for c in range(1, width + 1):
        while (more := placed[k + 1, each] <= placed[c] - need + 1e-9).any():  # k: the last start that leaves words enough
            k = k + more
        found = k >= 0
        best[found] = np.maximum(best[found], sums[c, found] - least[k[found], each[found]])
    out[go] = best
    return out


def _stretches(row: np.ndarray, lens: np.ndarray, gain: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the stretch of the highest gain, words of the longest stretch that never loses all) of each row of ``lens`` entries."""
    n, width = len(lens), int(lens.max())
    col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    g, s = np.full((width, n), -1.0), np.zeros((width, n))  # one line a place, all rows at once
    g[col, row], s[col, row] = gain, share
    run, length, best, words_of, longest = (np.zeros(n) for _ in range(5))
    for c in range(width):
        run = run + g[c]
        alive = run > 0
        run, length = run * alive, (length + s[c]) * alive
        better = run > best
        best, words_of = np.where(better, run, best), np.where(better, length, words_of)
        np.maximum(longest, length, out=longest)
    return words_of, longest


def _possible(words: np.ndarray, begin: np.ndarray, index: Index, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which documents and items can have an alignment that is long enough: even if every item word that the document has anywhere stood in its place.

    With more words in place no stretch gets shorter or less evident, so nothing is lost.
    """
    ok = np.zeros(len(doc), bool)
    v = len(index.vocabulary) + 1
    step = int(min(4096, max(16, 64_000_000 // v)))
    for part in _parts((index.begin[1:] - index.begin[:-1])[item]):
        for s in (part[k : k + step] for k in range(0, len(part), step)):
            d, i = doc[s], item[s]
            own, at = np.unique(d, return_inverse=True)
            n = begin[own + 1] - begin[own]
            row = np.repeat(np.arange(len(own)), n)
            has = np.zeros((len(own), v), bool)
            has[row, words[np.repeat(begin[own], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]] = True
            lens = index.begin[i + 1] - index.begin[i]
            row = np.repeat(np.arange(len(i)), lens)
            p = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + index.begin[i][row]
            hit = has[at.ravel()[row], index.words[p]]
            gain = np.where(hit, 1.0, -MISS) * index.weight[p]
            long = _stretches(row, lens, gain, index.share[p])[1] >= index.need[i]
            ok[s] = long | _evident(row, lens, p, hit, index, index.need[i], ~long)
    return ok


def rarities(texts: list[str]) -> dict[int, float]:
    """Weight of each word: the logarithm of its rarity among the items, with a floor for common words."""
    seen: Counter = Counter()
    for t in texts:
        seen.update(set(word_hashes([t])[0].tolist()))
    return {w: max(0.3, float(np.log(len(texts) / n))) for w, n in seen.items()}


def leaked(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of every document that contains an item or a long enough passage of it.

    The items are held by the driver and by each task; they are a held-out set, far smaller
    than a corpus, and their size is checked first. Beyond ``ITEMS_PER_PASS`` characters they
    are searched in several passes.
    """
    some = items.where(F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    size = some.agg(F.sum(F.length(item_text))).first()[0] or 0
    if size > ITEM_CHARS:
        raise ValueError(f"{size} characters of items are more than {ITEM_CHARS}")
    owners: dict[bytes, list] = {}
    first: dict[bytes, str] = {}
    for i, t in some.orderBy(item_id, item_text).collect():
        key = word_hashes([t])[0].tobytes()
        owners.setdefault(key, []).append(i)
        first.setdefault(key, t)
    texts = [" ".join(s) for s in own_sentences(list(first.values()))]
    ids = list(owners.values())
    rarity = rarities(texts)
    surprise = surprises(texts, rarity)
    d, i = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField(doc_id, d), T.StructField(item_id, i)])
    passes: list[list[int]] = [[]]
    size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > ITEMS_PER_PASS:
            passes.append([])
            size = 0
        passes[-1].append(k)
        size += len(t)
    src = docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text))
    out = None
    for chosen in passes:
        indices = []
        for window in range(1, WINDOW + 1):  # items too short for a whole window have patterns of their own length
            own = [k for k in chosen if min(len(surprise[k]), WINDOW) == window]
            if own:
                indices.append((build_index([texts[k] for k in own], rarity, [surprise[k] for k in own], window), [ids[k] for k in own]))
        part = src.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(indices), doc_id, item_id), schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _searcher(held, doc_id: str, item_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, docs = b.column(1), b.column(0)
            pairs = set()
            lens = np.cumsum([0] + [len(x) if x else 0 for x in texts.to_pylist()])
            k = 0
            while k < b.num_rows:  # about a million characters at a time
                to = max(k + 1, int(np.searchsorted(lens, lens[k] + 1_000_000, side="right")) - 1)
                hashes, counts = word_hashes([x or "" for x in texts.slice(k, to - k).to_pylist()])
                for index, ids in held.value:
                    place = np.searchsorted(index.vocabulary, hashes)
                    place[place == len(index.vocabulary)] = 0
                    words = np.where(index.vocabulary[place] == hashes, place + 1, 0).astype(np.int32)
                    d, i, _ = passages(words, counts, index)
                    pairs |= {(a + k, o) for a, c in zip(d.tolist(), i.tolist()) for o in ids[c]}
                k = to
            if pairs:
                found = sorted(pairs, key=lambda p: p[0])
                yield pa.RecordBatch.from_arrays([docs.take(pa.array([p[0] for p in found])), pa.array([p[1] for p in found])], [doc_id, item_id])

    return run
