"""Language of documents and of their segments.

Model: sparse multinomial logistic regression on TF-IDF weighted character n-grams (one to
``LONGEST`` letters, within words), trained by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of labelled documents, then temperature
calibrated on held-out documents of the sample. Labels of the sample may be wrong: a first
model drops the sentences that contradict it, the next is trained on the rest.

A text is cut into sentences. Only natural words speak for a language; tokens with figures,
path or address characters or capitals inside are names and say nothing. As features lie
within words, the score of a distinct word is worked out once a batch and summed over
sentences; every document is read whole.

Segments: an optimal path over the sentences pays for each change of language, so that a
segment needs evidence of its own (:func:`segments`), and enough of it over the languages
beside it (:func:`merge_weak`): not the number of its words but their calibrated odds decide.
A document's languages are those of its segments. The languages told apart are those that the labels name often enough
(``LEAST_SHARE``); text of any other language gets the one it is most like.

Defined results: null and blank texts, and texts without natural words, have no language and
no rows; a segment's confidence is the calibrated probability of its language over its words;
with no usable labels at all nothing is learnt and no row comes out; repeated rows count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of language labels (two letters, then three letters and the English name).
SPELLINGS = {
    "ar": ["ara", "arabic"], "bg": ["bul", "bulgarian"], "ca": ["cat", "catalan"], "cs": ["ces", "cze", "czech"],
    "da": ["dan", "danish"], "de": ["deu", "ger", "german"], "el": ["ell", "gre", "greek"], "en": ["eng", "english"],
    "es": ["spa", "spanish"], "et": ["est", "estonian"], "fa": ["fas", "per", "persian"], "fi": ["fin", "finnish"],
    "fr": ["fra", "fre", "french"], "he": ["heb", "hebrew"], "hi": ["hin", "hindi"], "hr": ["hrv", "croatian"],
    "hu": ["hun", "hungarian"], "id": ["ind", "indonesian"], "it": ["ita", "italian"], "ja": ["jpn", "japanese"],
    "ko": ["kor", "korean"], "lt": ["lit", "lithuanian"], "lv": ["lav", "latvian"], "nl": ["nld", "dut", "dutch"],
    "no": ["nor", "nb", "nob", "norwegian"], "pl": ["pol", "polish"], "pt": ["por", "portuguese"], "ro": ["ron", "rum", "romanian"],
    "ru": ["rus", "russian"], "sk": ["slk", "slo", "slovak"], "sl": ["slv", "slovenian"], "sr": ["srp", "serbian"],
    "sv": ["swe", "swedish"], "th": ["tha", "thai"], "tr": ["tur", "turkish"], "uk": ["ukr", "ukrainian"],
    "vi": ["vie", "vietnamese"], "zh": ["zho", "chi", "chinese"],
}

#: Documents of each language and characters of a document that training may use.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
#: Of all labelled documents, the share that a label needs to be a language of the model: rarer ones are as likely wrong.
LEAST_SHARE = 0.005
#: The sample is drawn this many times as large as wanted, as some of it will not do.
DRAWN = 2
#: Fits in a row, each on the sentences that the one before does not contradict.
PASSES = 4
#: Share of the held-out sentences whose label may be wrong after all passes.
LABEL_NOISE = 0.002
LONGEST = 4
BITS = 18
#: Of the regularised leader: step, its offset, L1, L2; rounds over the sample.
ALPHA, BETA, L1, L2, ROUNDS = 0.3, 1.0, 0.02, 0.5, 4
#: Rounds of the models that only judge labels: telling languages apart takes fewer than calibrated weights.
JUDGE_ROUNDS = 2
#: Evidence (log odds) that a change of language must bring.
CHANGE = 3.0
#: Evidence that a segment must have over the language beside it, however many words it has.
CERTAIN = 6.0


def label_code(c: Column) -> Column:
    """Two-letter code of a label in any spelling (case, region, three letters, English name); null if it names no language of ``SPELLINGS``."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:[-_].*)?$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for code, forms in SPELLINGS.items() for f in (code, *forms) for x in (f, code)]), base)


# Character classes.
_LETTER, _SPACE, _BAD, _DOT, _UPPER, _END, _LINE = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class bits, lower case) of each code point of the Basic Multilingual Plane."""
    kind, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint16)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        bits = 0
        if cat[0] == "L" or cat == "Mn":
            bits |= _LETTER | (_UPPER if cat in ("Lu", "Lt") else 0)
            lower = ch.lower()
            if len(lower) == 1:
                low[cp] = ord(lower)
        elif ch.isspace() or cat[0] == "Z":
            bits |= _SPACE
        elif cat[0] == "N" or ch in "\\_@={}|<>/[]#%^~":
            bits |= _BAD
        if ch in ".!?…":
            bits |= _END
        if ch == ".":
            bits |= _DOT
        if ch in "\n\r\u2028\u2029\x85":
            bits |= _LINE
        kind[cp] = bits
    return kind, low


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(512, 0x100000001B3, np.uint64))


@dataclass
class Cut:
    """Natural words of texts, by sentence."""

    distinct: np.ndarray  # lower-case letters of the distinct words, one after another
    at: np.ndarray  # bounds of the distinct words
    which: np.ndarray  # distinct word of each word
    sentence: np.ndarray  # sentence of each word, counted over all texts
    text_of: np.ndarray  # text of each sentence that has a word
    begin: np.ndarray  # first and last character of each sentence's words within its text
    end: np.ndarray


def cut_up(texts: list[str]) -> Cut:
    joined = "\n".join(texts) + "\n"
    cp = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    kinds, lower = _classes()
    k = kinds[cp]
    space, letter = (k & _SPACE) != 0, (k & _LETTER) != 0
    following, before = np.append(k[1:], _SPACE), np.append(_SPACE, k[:-1])
    # Tokens between white space that are names, paths or figures.
    bad = (k & _BAD) != 0
    bad |= ((k & _DOT) != 0) & ((following & (_LETTER | _BAD)) != 0) & ((before & (_LETTER | _BAD)) != 0)
    bad |= ((k & _UPPER) != 0) & ((before & _LETTER) != 0) & ((before & _UPPER) == 0)
    token = np.cumsum(space)
    spoilt = np.zeros(int(token[-1]) + 1, bool)
    spoilt[token[bad]] = True
    stop = ((k & _LINE) != 0) | (((k & _END) != 0) & ((following & _SPACE) != 0))
    sentence_at = np.cumsum(stop)
    good = letter & ~spoilt[token]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    lens = end - start
    none = np.zeros(0, np.int64)
    if not len(start):
        return Cut(np.zeros(0, np.uint16), np.zeros(1, np.int64), none, none, none, none, none)
    inside = np.flatnonzero(good)
    chars = lower[cp[inside]]
    off = np.cumsum(lens) - lens
    place = np.arange(len(inside)) - np.repeat(off, lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(chars.astype(np.uint64) * _powers()[place & 511], off)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    n = lens[first]
    at = np.concatenate([[0], np.cumsum(n)])
    distinct = chars[np.repeat(off[first], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)]
    raw = sentence_at[start]
    new = np.concatenate([[True], raw[1:] != raw[:-1]])
    sentence = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(raw)) - 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(ends, start[head], side="right")
    base = np.concatenate([[0], ends])[text_of]
    return Cut(distinct, at, which, sentence, text_of, start[head] - base, end[tail] - base)


def word_grams(c: Cut) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, distinct word) of all n-grams of the distinct words, edges marked."""
    n = np.diff(c.at)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    marked = np.full(at[-1], 95, np.uint64)
    owner = np.repeat(np.arange(len(n)), n + 2)
    body = np.ones(at[-1], bool)
    body[at[:-1]] = body[at[1:] - 1] = False
    marked[body] = c.distinct
    grams, words = [], []
    with np.errstate(over="ignore"):
        for size in range(1, LONGEST + 1):
            if len(marked) < size:
                break
            m = len(marked) - size + 1
            h = np.full(m, size, np.uint64)
            for j in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + marked[j : j + m]
            ok = owner[:m] == owner[size - 1 :]
            if size == 1:
                ok &= body
            grams.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS))[ok].astype(np.int64))
            words.append(owner[:m][ok])
    return np.concatenate(grams), np.concatenate(words)


@dataclass
class Model:
    weight: np.ndarray  # (2 ** BITS, languages), with the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float
    languages: list[str]

    def logits(self, c: Cut, group: np.ndarray | None = None, groups: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(uncalibrated logits, words) of each sentence, or of each group of words."""
        grams, words = word_grams(c)
        n_words, k = len(c.at) - 1, len(self.languages)
        w = self.weight[grams]
        score = np.stack([np.bincount(words, w[:, j], n_words) for j in range(k)], 1)
        size = np.bincount(words, minlength=n_words).astype(float)
        group = c.sentence if group is None else group
        m = len(c.text_of) if groups is None else groups
        total = np.stack([np.bincount(group, score[c.which, j], m) for j in range(k)], 1)
        norm = np.sqrt(np.maximum(np.bincount(group, size[c.which], m), 1.0))
        return total / norm[:, None] + self.bias, np.bincount(group, minlength=m)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(texts: list[str]) -> tuple[Cut, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' sentences as (cut, sentence, gram, count) triples in order of sentence."""
    c = cut_up(texts)
    if not len(c.which):
        return c, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    grams, words = word_grams(c)
    order = np.argsort(words, kind="stable")
    grams, n = grams[order], np.bincount(words, minlength=len(c.at) - 1)
    off = np.cumsum(n) - n
    each = n[c.which]
    row = np.repeat(c.sentence, each)
    gram = grams[np.repeat(off[c.which], each) + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)]
    key, count = np.unique(row * (1 << BITS) + gram, return_counts=True)
    return c, key >> BITS, key & ((1 << BITS) - 1), count.astype(float)


def train(texts: list[str], labels: list[int], names: list[str], passes: int = PASSES) -> Model | None:
    """Fit on whole sentences of the texts; every fifth text is held out for the temperature.

    Labels may be wrong and texts mixed: each pass but the last finds the sentences whose
    label has less than half of the probability, or whose text as a whole speaks another
    language, and the next pass leaves them out.
    """
    c, row, gram, count = _matrix(texts)
    if not len(row):
        return None
    m, k = len(c.text_of), len(names)
    y = np.asarray(labels)[c.text_of]
    # Sentences are documents to the inverse document frequency.
    used, gram = np.unique(gram, return_inverse=True)  # only features that occur have coordinates
    idf = np.log((1.0 + m) / (1.0 + np.bincount(gram))) + 1.0
    x = count * idf[gram] / np.sqrt(np.maximum(np.bincount(row, count, m), 1.0))[row]
    held, fair, every = c.text_of % 5 == 4, np.ones(m, bool), np.arange(m)

    def model_of(use: np.ndarray, rounds: int) -> Model:
        use = np.flatnonzero(use)
        share = np.bincount(y[use], minlength=k).astype(float)
        balance = np.where(share > 0, share.sum() / (k * np.maximum(share, 1.0)), 0.0)
        own, bias = _leader(row, gram, x, y, balance, use, m, k, rounds)
        weight = np.zeros((1 << BITS, k), np.float32)
        weight[used] = own * idf[:, None]
        return Model(weight, bias, 1.0, names)

    half = (c.text_of // 5) % 2 == 0
    for _ in range(passes - 1):
        # Each half of the texts is judged by a model of the other half, which has not seen it.
        p, whole = np.zeros((m, k)), np.zeros((m, k))
        for side in (half, ~half):
            logits, words = model_of(~side & fair, JUDGE_ROUNDS).logits(c)
            p[side] = softmax(logits)[side]
            # A wrong label is wrong for all of its text, which is easier to see than in one sentence.
            told = np.stack([np.bincount(c.text_of, words * np.log(np.maximum(softmax(logits)[:, j], 1e-6))) for j in range(k)], 1)
            whole[side] = told[c.text_of][side]
        fair = (p[every, y] >= 0.5) & (whole.argmax(1) == y)
    model = model_of(~held & fair, ROUNDS)
    logits, words = model.logits(c)
    known = held & fair & (words >= 3)
    model.temperature = _temperature(logits[known], y[known])
    return model


def _leader(row: np.ndarray, gram: np.ndarray, x: np.ndarray, y: np.ndarray, balance: np.ndarray, chosen: np.ndarray, m: int, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, per coordinate, in small batches."""
    d = int(gram.max()) + 1
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    bounds = np.searchsorted(row, np.arange(m + 1))

    def solve(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(rounds):
        order = rng.permutation(chosen)
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            n_in = bounds[rows + 1] - bounds[rows]
            r = np.repeat(np.arange(len(rows)), n_in)
            at = np.repeat(bounds[rows], n_in) + np.arange(len(r)) - np.repeat(np.cumsum(n_in) - n_in, n_in)
            f, local = np.unique(gram[at], return_inverse=True)
            w = solve(z[f], n[f], L1)
            b = solve(z[d], n[d], 0.0)
            xv = x[at]
            logits = np.stack([np.bincount(r, xv * w[local, j], len(rows)) for j in range(k)], 1) + b
            p = softmax(logits)
            p[np.arange(len(rows)), y[rows]] -= 1.0
            p *= balance[y[rows]][:, None]
            g = np.stack([np.bincount(local, xv * p[r, j], len(f)) for j in range(k)], 1)
            for i, gi, wi in ((f, g, w), (d, p.sum(0), b)):
                sigma = (np.sqrt(n[i] + gi * gi) - np.sqrt(n[i])) / ALPHA
                z[i] += gi - sigma * wi
                n[i] += gi * gi
    return solve(z[:d], n[:d], L1), solve(z[d], n[d], 0.0)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-out sentences, without the worst ``LABEL_NOISE`` of them: some labels are still wrong."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.5), np.log(10.0), 40))  # never sharper than twice: the held-out part is small
    worst = int(np.ceil(LABEL_NOISE * len(y)))
    loss = [np.sort(-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)))[: len(y) - worst].mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, doc_id: str, text: str, label: str, per_label: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, least_share: float = LEAST_SHARE) -> Model | None:
    """Model of the languages that the labels name, from at most ``per_label`` documents of each (those of smallest hash) of at most ``chars`` characters.

    Labels are counted first, without the texts. Their numbers give the part of the hashes
    that holds about ``DRAWN`` times the documents wanted, and the scan lets only these pass:
    what leaves it has the size of the sample, however many tasks there are.
    """
    code = label_code(F.col(label))
    counts = {r["c"]: r["n"] for r in docs.groupBy(code.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect() if r["c"]}
    names = sorted(c for c, n in counts.items() if n >= least_share * sum(counts.values()))
    if not names:
        return None
    span = 1 << 40
    limits = F.create_map(*[F.lit(x) for c in names for x in (c, int(span * min(1.0, DRAWN * per_label / counts[c])))])
    few = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), code.alias("c"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"))
    drawn = few.where((F.pmod("h", F.lit(span)) < F.element_at(limits, F.col("c"))) & (F.length("t") <= chars)).distinct().collect()
    rows: set[tuple[str, str]] = set()
    for c in names:
        mine = sorted((r["h"] % span, r["t"]) for r in drawn if r["c"] == c)
        rows |= {(t, c) for _, t in mine[:per_label]}
    rows = sorted(rows, key=lambda r: (hash_text(r[0]), r[1]))
    return train([r[0] for r in rows], [names.index(r[1]) for r in rows], names)


def hash_text(t: str) -> int:
    """A hash of a text that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))


def segments(log_p: np.ndarray) -> list[tuple[int, int, int]]:
    """(first sentence, last sentence, language) of the best path over one text's sentences; a change costs ``CHANGE``."""
    n, k = log_p.shape
    best, back = log_p[0].copy(), np.zeros((n, k), np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - CHANGE
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - CHANGE) + log_p[i]
    path = [int(best.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out, a = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[a]:
            out.append((a, i - 1, path[a]))
            a = i
    return out


#: Texts are cut up this many characters at a time.
PIECE = 500_000


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text; long ones part at a line or sentence end, if there is one."""
    a = 0
    while len(text) - a > PIECE:
        b = max(text.rfind("\n", a, a + PIECE), text.rfind(". ", a, a + PIECE))
        b = b + 1 if b > a else a + PIECE
        yield a, text[a:b]
        a = b
    yield a, text[a:]


def analyse(model: Model, texts: list[str]) -> list[tuple[int, int, str, float, int, int, int]]:
    """(text, segment, language, confidence, first character, end, words) of each segment of each text."""
    parts = [(i, a, x) for i, t in enumerate(texts) for a, x in _pieces(t)]
    logits, words, text_of, begin, end = [], [], [], [], []
    k = 0
    while k < len(parts):
        size, to = 0, k
        while to < len(parts) and (to == k or size + len(parts[to][2]) <= PIECE):
            size += len(parts[to][2])
            to += 1
        c = cut_up([x for _, _, x in parts[k:to]])
        if len(c.which):
            x, w = model.logits(c)
            logits.append(x)
            words.append(w)
            text_of.append(np.array([i for i, _, _ in parts[k:to]])[c.text_of])
            base = np.array([a for _, a, _ in parts[k:to]])[c.text_of]
            begin.append(c.begin + base)
            end.append(c.end + base)
        k = to
    if not logits:
        return []
    p = softmax(np.concatenate(logits) / model.temperature)
    words, text_of, begin, end = np.concatenate(words), np.concatenate(text_of), np.concatenate(begin), np.concatenate(end)
    log_p = np.log(np.maximum(p, 1e-9))
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    out = []
    top = p.argmax(1)
    for t in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = int(bounds[t]), int(bounds[t + 1])
        if (top[a:b] == top[a]).all():
            found = [(0, b - a - 1, int(top[a]))]
        else:
            found = merge_weak(segments(log_p[a:b]), words[a:b], log_p[a:b])
        for s, (i, j, lang) in enumerate(found):
            w = words[a + i : a + j + 1]
            conf = float(np.average(p[a + i : a + j + 1, lang], weights=w))
            out.append((t, s, model.languages[lang], conf, int(begin[a + i]), int(end[a + j]), int(w.sum())))
    return out


def merge_weak(parts: list[tuple[int, int, int]], words: np.ndarray, log_p: np.ndarray) -> list[tuple[int, int, int]]:
    """Segments join a neighbour unless they have evidence of ``CERTAIN`` over either neighbour's language."""
    parts = list(parts)

    def over(k: int, q: int) -> float:
        at = slice(parts[k][0], parts[k][1] + 1)
        return float((log_p[at, parts[k][2]] - log_p[at, parts[q][2]]).sum())

    while len(parts) > 1:
        size = [int(words[i : j + 1].sum()) for i, j, _ in parts]
        near = [[x for x in (k - 1, k + 1) if 0 <= x < len(parts)] for k in range(len(parts))]
        weak = [k for k in range(len(parts)) if min(over(k, q) for q in near[k]) < CERTAIN]
        if not weak:
            break
        k = min(weak, key=lambda x: size[x])
        x = min(near[k], key=lambda q: over(k, q))
        a, b = min(k, x), max(k, x)
        parts[a : b + 1] = [(parts[a][0], parts[b][1], parts[x][2])]
        i = 0
        while i + 1 < len(parts):  # neighbours of one language are one segment
            if parts[i][2] == parts[i + 1][2]:
                parts[i : i + 2] = [(parts[i][0], parts[i + 1][1], parts[i][2])]
            else:
                i += 1
    return parts


def _shipped(model: Model) -> tuple:
    """The model as its non-zero rows: what the penalties left of it."""
    rows = np.flatnonzero((model.weight != 0).any(1))
    return rows, model.weight[rows], model.bias, model.temperature, model.languages


def _unpacked(shipped: tuple) -> Model:
    rows, values, bias, temperature, languages = shipped
    weight = np.zeros((1 << BITS, len(languages)), np.float32)
    weight[rows] = values
    return Model(weight, bias, temperature, languages)


def language_segments(docs: DataFrame, doc_id: str, text: str, model: Model | None) -> DataFrame:
    """(doc_id, segment, lang, confidence, begin_char, end_char, n_words) of every segment of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, segment int, lang string, confidence double, begin_char long, end_char long, n_words long"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shipped = _shipped(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(shipped)
        for b in batches:
            found = analyse(own, [x or "" for x in b.column(1).to_pylist()])
            if found:
                c = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.float64()), *[pa.array(x, pa.int64()) for x in c[4:]]], [doc_id, "segment", "lang", "confidence", "begin_char", "end_char", "n_words"]
                )

    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def label_cases(docs: DataFrame, doc_id: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing, names none or another one, or whose text has several.

    The label travels through the analysis in front of the id, so that no join is needed.
    """
    model = model or fit(docs, doc_id, text, label)
    tagged = docs.select(F.to_json(F.struct(label_code(F.col(label)).alias("c"), F.col(doc_id).alias("i"))).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    seg = language_segments(tagged, "key", "text", model).groupBy("key").agg(F.collect_set("lang").alias("langs"))
    out = seg.select(F.from_json("key", f"c string, i {kind}").alias("k"), "langs")
    case = F.col("k.c").isNull() | (F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("k.c"))
    return out.where(case).select(F.col("k.i").alias(doc_id), F.explode("langs").alias("lang")).distinct()
