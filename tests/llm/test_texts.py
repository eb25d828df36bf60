from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import langid, leakage, packing
from tracewright.llm.words import word_hashes

# Words.


def test_words_ignore_layout_accents_look_alikes_and_markup():
    plain = word_hashes(["Three hosts share a copy of the café log"])[0]
    for other in ("three  HOSTS\nshare, a copy; of the cafe\tlog", "Thrее hоsts share а cоpy of the cafe\u0301 log", "<b>Three</b> ho\u200bsts **share** `a` copy of <i>the</i> café log"):
        assert np.array_equal(word_hashes([other])[0], plain), other


def test_word_counts_by_text():
    h, n = word_hashes(["a b", "", "   ", "c", "x" * 10, "a b"])
    assert n.tolist() == [2, 0, 0, 1, 1, 2] and h[0] == h[4] and len(set(h.tolist())) == 4
    long = "word " * 300_000
    h, n = word_hashes(["p q", long, "r"])
    assert n.tolist() == [2, 300_000, 1] and len(set(h[2:-1].tolist())) == 1


# Leakage.

SHARED = "Read the following excerpt carefully and choose the best explanation."
RARE = [f"w{i}" for i in range(400)]


def make_items(seed=0):
    r = random.Random(seed)
    texts = []
    for i in range(20):
        words = ["the", "trace", "of", "host", "begins", "with"] + [r.choice(RARE) for _ in range(30)]
        texts.append((i, f"{SHARED} {' '.join(words)}."))
    return texts


def brute_search(words, counts, index):
    patterns = {tuple(p): i for i, p in enumerate(index.pattern.tolist())}
    out, at = set(), 0
    for n in counts.tolist():
        for e in range(at + leakage.WINDOW - 1, at + n):
            p = patterns.get(tuple(words[e - leakage.WINDOW + 1 : e + 1].tolist()))
            if p is not None:
                out.add((e, p))
        at += n
    return out


def test_search_equals_brute_force():
    texts = [" ".join(s) for s in leakage.own_sentences([t for _, t in make_items()])]
    index = leakage.build_index(texts, leakage.rarities(texts))
    r = random.Random(5)
    counts = np.array([0, 3, 900, 40, 4])
    words = np.array([r.randrange(0, len(index.vocabulary) + 1) for _ in range(int(counts.sum()))], np.int32)
    words[10:40] = index.words[5:35]
    words[890:930] = index.words[30:70]  # over the end of a document
    ends, pattern = leakage.search(words, counts, index)
    assert set(zip(ends.tolist(), pattern.tolist())) == brute_search(words, counts, index)
    assert len(ends) > 20


def test_shared_sentences_are_no_part_of_an_item():
    assert all(SHARED not in " ".join(s) for s in leakage.own_sentences([t for _, t in make_items()]))


def test_leaks_are_found_and_look_alikes_are_not(spark):
    items = make_items()
    own = [" ".join(leakage.own_sentences([t for _, t in items])[i]).rstrip(".") for i in range(20)]
    w = [t.split() for t in own]
    changed = list(w[2])
    changed[8], changed[20] = "different", "words"
    other = [x if x in ("the", "trace", "of", "host", "begins", "with") else f"{x}x" for x in w[4]]
    docs = [
        (1, "before " + own[0] + " after"), (2, "x " + " ".join(w[1][6:24]) + " y"), (3, " ".join(changed).upper()), (4, "\n".join(w[3][:7]) + " only a quotation"), (5, " ".join(other)),
        (6, SHARED), (7, None), (8, "  "), (9, own[5] + " gap " + own[6]), (1, "before " + own[0] + " after"), (10, "noise " * 60_000 + own[7]),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([*items, (99, None), (98, ""), items[0]], "item_id long, text string")
    got = {tuple(x) for x in leakage.leaked(d.select("doc_id", "text"), i, "doc_id", "text", "item_id", "text").collect()}
    # An item that stands twice in the table shares its sentences with nobody but itself.
    assert got == {(1, 0), (2, 1), (3, 2), (9, 5), (9, 6), (10, 7)}
    assert leakage.leaked(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.leaked(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_one_changed_rare_word_in_a_shortest_passage():
    kinds = ["a privilege grant lasting N minutes outside the P calendar", "a refused ticket with code N next to a granted one", "a chain of N short sessions that all lead back to P"]
    r = random.Random(3)
    names = ["quill", "fenview", "latchd", "umbauth", "brkload", "vrelay", "gnmail", "kcmd"]
    fill = lambda: r.choice(kinds).replace("N", str(r.randrange(10_000))).replace("P", r.choice(names))
    texts = [f"The trace of host{r.randrange(10_000)} begins with {fill()} while {r.choice(names)}{r.randrange(10_000)} answers for desk {r.randrange(10_000)} under ticket {r.randrange(10_000)}" for _ in range(120)]
    index = leakage.build_index(texts, leakage.rarities(texts))

    def found(words):
        h = word_hashes([" ".join(words)])[0]
        place = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
        numbers = np.where(index.vocabulary[place] == h, place + 1, 0).astype(np.int32)
        return set(leakage.passages(numbers, np.array([len(h)]), index)[1].tolist())

    for i in range(120):
        w = texts[i].split()
        passage, k = w[-12:], 4
        assert passage[k][-1].isdigit()
        assert i in found([*passage[:k], "different", *passage[k + 1 :]]), i
        # Another scenario: the same words, other particulars.
        assert not found([f"other{k}" if x[-1].isdigit() or x in names else x for k, x in enumerate(w)]), i


def test_short_items_and_items_of_equal_text(spark):
    items = make_items()
    short = [(50, f"{SHARED} The quokka signed forty blue forms on Tuesday."), (51, "Marmots whistle loudly"), (52, "zzyzx"), (53, "w1 w2"), (60, items[3][1]), (61, items[3][1].upper())]
    docs = [
        (1, "It is said that the quokka signed forty blue forms on Tuesday, and more."), (2, "the quokka signed forty green forms on tuesday"), (3, "the quokka signed two red papers on monday"), (4, "here marmots whistle loudly again"),
        (5, "marmots whistle softly"), (6, "drive to Zzyzx now"), (7, items[3][1]), (8, "w1 w3 w2"),
    ]
    i = spark.createDataFrame([*items, *short], "item_id long, text string")
    got = {tuple(x) for x in leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), i, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 50), (2, 50), (4, 51), (6, 52), (7, 3), (7, 60), (7, 61)}


def test_small_arrays_give_the_same(monkeypatch):
    texts = [" ".join(s) for s in leakage.own_sentences([t for _, t in make_items()])]
    index = leakage.build_index(texts, leakage.rarities(texts))
    words = np.concatenate([index.words, index.words[5:60], np.zeros(9, np.int32), index.words[100:400]])
    counts = np.array([len(index.words), 55, 9, 300])
    whole = [x.tolist() for x in leakage.passages(words, counts, index)]
    monkeypatch.setattr(leakage, "CELLS", 50)
    assert sorted(zip(*whole)) == sorted(zip(*[x.tolist() for x in leakage.passages(words, counts, index)])) and len(whole[0]) > 20


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_CHARS", 100)
    i = spark.createDataFrame(make_items(), "item_id long, text string")
    with pytest.raises(ValueError, match="characters of items"):
        leakage.leaked(i.toDF("doc_id", "text"), i, "doc_id", "text", "item_id", "text")


def test_several_passes_over_the_items_give_the_same(spark, monkeypatch):
    items = make_items()
    docs = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(x) for x in leakage.leaked(docs, i, "doc_id", "text", "item_id", "text").collect()}
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 500)
    assert {tuple(x) for x in leakage.leaked(docs, i, "doc_id", "text", "item_id", "text").collect()} == one == {(k, k) for k in range(20)}


# Packing.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=21, max_size=21))
def test_plan_uses_every_item_once_and_fits(counts):
    counts = np.array(counts)
    counts[0] = 0
    used = np.zeros(21, int)
    for inside, times in packing.plan(counts, 20):
        assert sum(inside) <= 20 and times >= 1
        for a in inside:
            used[a] += times
    assert used.tolist() == counts.tolist()
    table = packing.intervals(packing.plan(counts, 20))
    for a in range(1, 21):
        own = table[table[:, 0] == a]
        assert (np.diff(own[:, 1]) > 0).all() and (len(own) == 0) == (counts[a] == 0)


def test_plan_finds_exact_complements():
    c = np.zeros(101, int)
    c[[60, 40, 55, 25, 20, 30]] = [3, 3, 2, 2, 2, 1]
    p = packing.plan(c, 100)
    assert all(sum(inside) == 100 for inside, _ in p[:-1]) and sum(t for _, t in p) == -(-int((c * np.arange(101)).sum()) // 100)


def test_plan_wastes_little_on_many_lengths():
    r = np.random.default_rng(1)
    c = np.bincount(np.minimum(2048, r.geometric(1 / 300, 20_000)), minlength=2049)
    boxes = sum(t for _, t in packing.plan(c, 2048))
    assert boxes <= -(-int((c * np.arange(2049)).sum()) // 2048) + 1


def first_fit_decreasing(lengths, capacity):
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return len(gaps)


needs_tokenizer = pytest.mark.skipif(not os.path.isdir(packing.TOKENIZERS), reason="no vocabulary files here")


@needs_tokenizer
def test_texts_in_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 20)
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "für", "да"]) for _ in range(r.choice([1, 5, 30, 200])))) for i in range(150)]
    rows += [(900, None), (901, "  "), (902, ""), (903, "word " * 1000), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, container_id int")
    out = packing.pack(df, "doc_id", "text", 128).toPandas()
    enc = packing.tokenizer(packing.TOKENIZERS, packing.VOCABULARY)
    filled = out[out.n_tokens > 0]
    assert filled.groupby("container_id").n_tokens.sum().max() <= 128
    assert not filled.duplicated(["container_id", "slot"]).any() and filled.container_id.nunique() == filled.container_id.max() + 1
    texts = dict(rows)
    for i, n in out.groupby("doc_id").n_tokens.sum().items():
        t = texts[i]
        expected = len(enc.encode_ordinary(t)) if t and t.strip() else 0
        assert n == expected * (2 if i == 5 else 1)
    whole = out[(out.doc_id < 900) & (out.doc_id != 5)].groupby("doc_id").size()
    short = [i for i in whole.index if len(enc.encode_ordinary(texts[i])) <= 128]
    assert (whole[short] == 1).all()  # only what exceeds a container is split
    assert out[out.doc_id.isin([900, 901, 902])].container_id.isna().all()
    assert filled.container_id.nunique() <= first_fit_decreasing(filled.n_tokens.tolist(), 128)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# Languages.

SENTENCES = {
    "en": ["the service was stopped by the night shift before the backup", "nobody could explain why the file had been copied to the share", "we found many refused logons and the case was kept open", "the clock of the server ran ahead and the alert was wrong"],
    "de": ["der dienst wurde von der nachtschicht vor der sicherung beendet", "niemand konnte erklären warum die datei auf die freigabe kopiert wurde", "wir fanden viele verweigerte anmeldungen und der fall bleibt offen", "die uhr des servers ging vor und die warnung war falsch"],
    "fr": ["le service a été arrêté par l'équipe de nuit avant la sauvegarde", "personne ne savait pourquoi le fichier avait été copié vers le partage", "nous avons trouvé des connexions refusées et le dossier reste ouvert", "l'horloge du serveur avançait et l'alerte était fausse"],
    "ru": ["служба была остановлена ночной сменой перед копированием", "никто не смог объяснить зачем файл скопировали в общую папку", "мы нашли много отклонённых входов и дело остаётся открытым", "часы сервера спешили и предупреждение было ложным"],
}


def doc(lang, r, n=4):
    return " ".join(f"On SRV-{r.randrange(99):02d}, {r.choice(SENTENCES[lang])} at C:\\x\\y{r.randrange(9)}.exe." for _ in range(n))


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    texts, labels = [], []
    for i in range(240):
        lang = r.choice(list(SENTENCES))
        texts.append(doc(lang, r))
        labels.append(list(SENTENCES).index(lang if r.random() > 0.15 else r.choice(list(SENTENCES))))
    return langid.train(texts, labels, list(SENTENCES))


def test_held_out_accuracy_with_wrong_labels_in_training(model):
    r = random.Random(2)
    wanted = [r.choice(list(SENTENCES)) for _ in range(120)]
    got = {s[0]: s[2] for s in langid.analyse(model, [doc(x, r) for x in wanted])}
    assert sum(got.get(i) == x for i, x in enumerate(wanted)) >= 118


def test_penalties_leave_few_weights(model):
    assert 0 < (model.weight != 0).any(1).sum() < 1 << 14 and 0.5 <= model.temperature <= 10


def test_mixed_documents_have_segments(model):
    r = random.Random(3)
    a, b = doc("de", r, 3), doc("ru", r, 2)
    s = langid.analyse(model, [a + "\n" + b, "", "C:\\a\\b.exe 10.0.0.1 SRV-01", "DER DIENST WURDE VON DER NACHTSCHICHT VOR DER SICHERUNG BEENDET"])
    assert [(x[0], x[2]) for x in s] == [(0, "de"), (0, "ru"), (3, "de")]
    assert s[1][4] > len(a) - 1 and all(0.5 < x[3] <= 1 for x in s)


def test_short_sentences_of_another_language_stand_if_they_are_certain(model):
    r = random.Random(6)
    a, b = doc("en", r, 3), doc("en", r, 2)
    for short, lang in (("niemand konnte erklären warum", "de"), ("дело остаётся открытым", "ru"), ("la sauvegarde du dossier", "fr")):
        found = [x[2] for x in langid.analyse(model, [f"{a}\n{short}.\n{b}"])]
        assert found == ["en", lang, "en"], (short, found)
    # A word or two that say little do not.
    assert [x[2] for x in langid.analyse(model, [f"{a}\nPlan der Backup.\n{b}"])] == ["en"]


def test_segments_join_only_without_evidence():
    words = np.array([20, 3, 20])
    log_p = np.log(np.array([[0.9999, 0.0001], [1e-7, 1.0], [0.9999, 0.0001]]))
    parts = [(0, 0, 0), (1, 1, 1), (2, 2, 0)]
    assert langid.merge_weak(parts, words, log_p) == parts
    log_p[1] = np.log([0.2, 0.8])
    assert langid.merge_weak(parts, words, log_p) == [(0, 2, 0)]
    log_p[1] = np.log([0.002, 0.998])
    assert langid.merge_weak(parts, words, log_p) == parts


def test_languages_are_those_of_the_labels_and_the_sample_is_bounded(spark):
    r = random.Random(8)
    rows = [(i, doc(x, r), x) for i, x in enumerate(r.choice(["en", "de", "fr"]) for _ in range(400))]
    rows += [(1000, doc("en", r), "sv")]  # one label in four hundred is no language of the model
    rows += [(2000, rows[0][1], "en")] * 300
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", per_label=40)
    assert m.languages == ["de", "en", "fr"]
    assert [x[2] for x in langid.analyse(m, [doc("de", r), doc("fr", r)])] == ["de", "fr"]


def test_long_text_is_read_to_its_end(model):
    r = random.Random(4)
    t = doc("en", r, 9000) + "\n" + doc("fr", r, 3)
    assert len(t) > langid.PIECE
    s = langid.analyse(model, [t])
    assert [x[2] for x in s] == ["en", "fr"] and s[1][5] > len(t) - 60


def test_cases(spark, model):
    r = random.Random(5)
    rows = [(1, doc("en", r), "en-GB"), (2, doc("en", r), "German"), (3, doc("de", r), None), (4, doc("de", r), "xx"), (5, doc("fr", r) + "\n" + doc("en", r), "fr"), (6, None, "en"), (7, "  ", None), (8, doc("ru", r), " RUS "), (9, "10.0.0.1", None), (3, rows_text := doc("de", r), None)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, key string")
    got = sorted(map(tuple, langid.label_cases(df, "doc_id", "text", "lang", model).collect()))
    assert got == [(2, "en"), (3, "de"), (4, "de"), (5, "en"), (5, "fr")]
    assert rows_text and langid.label_cases(df.limit(0), "doc_id", "text", "lang", model).count() == 0
    assert langid.fit(df.where("doc_id = 6"), "doc_id", "text", "lang") is None
    assert langid.label_cases(df.where("doc_id in (6, 7)"), "doc_id", "text", "lang").count() == 0


def test_label_spellings(spark):
    df = spark.createDataFrame([("en_GB",), ("ENG",), (" Dutch ",), ("pt-PT",), ("bg",), ("",), (None,), ("??",), ("unknown",)], "l string")
    assert [r[0] for r in df.select(langid.label_code(df.l)).collect()] == ["en", "en", "nl", "pt", "bg", None, None, None, None]
