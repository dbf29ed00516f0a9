"""Trained operators: plain arithmetic where it is exact, held-out accuracy where it isn't."""

import math
import os
import random
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from barloom.llm import brown, cotraining, language_id
from barloom.llm.common import doc_hash
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["schen", "tum", "gler", "wisk"], "cc": ["oule", "aité", "çon", "ell"]}


def sentence(r, lang, n=40):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


def language_rows(n=300, seed=1):
    r = random.Random(seed)
    return [(i, sentence(r, lang := r.choice([*SYLLABLES])), lang) for i in range(n)]


def is_held(i, k):
    return zlib.crc32(str(i).encode()) % 5 == k


def test_languages_of_held_out_documents(spark):
    rows = language_rows() + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "Ka" * 40_000, None), (None, "schentum", None), (0, "schentum", None)]
    docs = spark.createDataFrame([(*x, "s", "clash") for x in rows], "doc_id long, text string, lang string, source string, Score string")
    model = language_id.train(docs, F.coalesce(doc_hash("doc_id") % 5 != 0, F.lit(True)))
    whole = language_id.identify(docs, model)
    assert whole.drop("language").exceptAll(docs).count() == 0 and docs.exceptAll(whole.drop("language")).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(docs, model, "SCORE")
    got = whole.select("doc_id", "text", "lang", "source", "language.*").collect()
    assert len(got) == len(rows) and got[0]["source"] == "s"
    held = [r for r in got if r["lang"] and (r["doc_id"] or 0) < 900 and is_held(r["doc_id"], 0)]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(r["lang_accepted"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got if (r["doc_id"] or 0) >= 900}
    assert {by[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and by[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*SYLLABLES, "und"} for r in got)
    assert not any(by[i]["lang_accepted"] for i in (900, 901, 902))


def test_a_prediction_depends_on_the_text_alone(spark):
    rows = language_rows(80)
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    one = language_id.identify(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model)
    two = language_id.identify(spark.createDataFrame([(-i, t, "zz") for i, t, _ in rows], "doc_id long, text string, lang string"), model)
    key = lambda df: {r["text"]: (r["lang_pred"], r["score"]) for r in df.select("text", "language.*").collect()}
    assert key(one) == key(two)


def test_text_of_an_unlearned_language_is_rejected(spark):
    """Its letters are known, but not how it puts them together; nearly all clean held-out documents stay."""
    rows = language_rows(700, 5)
    model = language_id.train(spark.createDataFrame(rows[:500], "doc_id long, text string, lang string"), F.lit(True))
    r = random.Random(6)
    other = [(1000 + i, " ".join("".join(r.choices(["zbo", "fyk", "vej", "pux", "qwi"], k=r.randint(2, 4))) for _ in range(40)), None) for i in range(100)]
    got = language_id.identify(spark.createDataFrame(rows[500:] + other, "doc_id long, text string, lang string"), model).select("doc_id", "language.lang_accepted").collect()
    assert np.mean([x["lang_accepted"] for x in got if x["doc_id"] < 1000]) >= 0.97
    assert np.mean([x["lang_accepted"] for x in got if x["doc_id"] >= 1000]) <= 0.05


def test_training_sees_whole_texts_and_no_order(spark):
    """What tells the languages apart stands at the ends of long texts; rows of one id give one sample, however they lie."""
    r = random.Random(8)
    same = [sentence(r, "aa", 3000) for _ in range(4)]
    rows = [(i, f"{same[i % 4]} {sentence(r, lang, 1500)}", lang) for i in range(40) for lang in [("bb", "cc")[i % 2]]]
    docs = spark.createDataFrame([*rows, (0, "other text", "aa"), (0, "other text", "aa")], "doc_id long, text string, lang string")
    one, two = (language_id.train(d, F.lit(True)) for d in (docs, docs.orderBy(F.desc("text")).repartition(3)))
    assert (one.logits == two.logits).all() and one.threshold == two.threshold and one.languages == two.languages
    ends = spark.createDataFrame([(i, sentence(r, lang, 50), lang) for i in range(20) for lang in [("bb", "cc")[i % 2]]], "doc_id long, text string, lang string")
    assert all(x["lang"] == x["lang_pred"] for x in language_id.identify(ends, one).select("lang", "language.*").collect())


def test_subwords_of_long_words_span_by_span(monkeypatch):
    r = random.Random(12)
    words = ["".join(r.choices("abcçé", k=n)) for n in (0, 1, 5, 37, 38, 39, 40, 41, 42, 80, 3, 400, 7)]
    owner, bucket = language_id.subwords(words)
    want = sorted(zip(owner.tolist(), bucket.tolist(), strict=True))
    for span in (40, 4, 1000):
        monkeypatch.setattr(language_id, "SPAN", span)
        assert sorted((w, b) for o, k in language_id.subword_parts(words) for w, b in zip(o.tolist(), k.tolist(), strict=True)) == want


def test_memory_of_one_long_word():
    """A word of 64 million characters is scored in little more than its own copies."""
    code = """
        import resource
        import numpy as np
        from barloom.llm import language_id as L
        model = L.Model(np.ones((L.BUCKETS, 4)), np.ones(L.BUCKETS), np.zeros(4), 1.0, 0.3, 0.0, ["a", "b", "c", "d"])
        text = "abcdefgh" * (8 << 20)
        at = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        best, score, _ = L.predict(model, L._Words(model), [text])
        assert best[0] >= 0
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - at) // 1024)
    """
    got = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(got.stdout) < 1000


def test_languages_without_labels_or_rows(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert language_id.train(empty, F.lit(True)) is None
    got = language_id.identify(spark.createDataFrame([(1, "text", None)], schema), None).first()["language"]
    assert (got["lang_pred"], got["score"], got["lang_accepted"]) == ("und", 0.0, False)
    assert language_id.identify(empty, None).count() == 0


def base_scores(rows):
    """(n_tokens, n_known, N, base score) of each row by the contract's formula."""
    tokens = [[*[w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))], None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i is None or not is_held(i, 1) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for ws in tokens]


def class_rows(n=250, seed=6):
    """Texts in which classes of words alternate, so that the class before tells much of the next word."""
    r = random.Random(seed)
    groups = [[f"{p}{i}" for i in range(25)] for p in ("noun", "verb", "adj", "part")]
    return [(i, " ".join(r.choice(groups[k % 4]) for k in range(r.randint(0, 60)))) for i in range(n)]


def test_brown_scores(spark, monkeypatch):
    monkeypatch.setattr(brown, "WORDS", 70)
    monkeypatch.setattr(brown, "HEAD", 60)
    monkeypatch.setattr(brown, "END_ID", 60)
    monkeypatch.setattr(brown, "IDS", 61 + brown.ENDINGS)
    rows = class_rows() + [(700, None), (701, ""), (702, "UNSEEN Noun1 ünseen x"), (703, "noun1 verb1 " * 50_000), (None, "noun2 verb2"), (5, "twice"), (5, "twice"), (704, "x" * 5000)]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double")
    held = F.coalesce(doc_hash("doc_id") % 5 == 1, F.lit(False))
    got = brown.score_documents(docs, ~held, held).collect()
    want = sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, base_scores(rows), strict=True))
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
    unseen = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 700]
    assert len(unseen) > 20 and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + 0.3 * sum(r["n_tokens"] for r in unseen)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_brown_scores_by_the_formula(spark, monkeypatch):
    """Each text's score from classes and transitions, word by word; and all words, unseen ones and the end sum to one after any class."""
    learnt, real = [], brown.cluster
    monkeypatch.setattr(brown, "cluster", lambda *a: learnt.append(real(*a)) or learnt[-1])
    rows = class_rows(120) + [(700, None), (702, "UNSEEN noun1 rare1 rare2"), (703, "rare1 Rare1 once,"), (704, "noun1 " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(doc_hash("doc_id") % 5 == 1, F.lit(False))
    got = {r["doc_id"]: r["score"] for r in brown.score_documents(docs, ~held, held).collect()}
    kinds, table, classes = learnt[0]
    tokens = {i: [*brown.words_of(t or ""), b""] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not is_held(i, 1) for w in ws)
    total = sum(counts.values())
    known = sorted((w for w in counts if w and counts[w] >= brown.EVIDENCE), key=lambda w: (-counts[w], w.decode()))
    kind_of = {w: int(kinds[k]) for k, w in enumerate(known)} | {b"": classes}
    kind = lambda w: kind_of.get(w, classes + 1 + brown.ending(w))
    into = [sum(table[a][b] for a in range(len(table))) for b in range(len(table))]
    types = Counter(brown.ending(w) for w in counts if w and counts[w] < brown.EVIDENCE)
    base = lambda w: (counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))

    def chance(before, k, n, base_):
        prior = (into[k] + 1) / (sum(into) + len(into))
        step = (table[before][k] + brown.PRIOR * prior) / (sum(table[before]) + brown.PRIOR)
        emit = n / max(into[k], 1) if k <= classes else (n + 0.5) / (into[k] + 0.5 * (types[k - classes - 1] + 1))
        return (1 - brown.MIX) * step * emit + brown.MIX * base_

    for i, ws in tokens.items():
        before = [classes, *map(kind, ws)]
        assert got[i] == pytest.approx(sum(math.log10(chance(b, kind(w), counts[w], base(w))) for b, w in zip(before, ws, strict=False)), rel=1e-9)
    used = {k for k in range(len(into)) if into[k]}
    for before in range(len(table)):
        seen = sum(chance(before, kind(w), counts[w], base(w)) for w in counts)
        unseen = sum(chance(before, classes + 1 + e, 0, 0) for e in range(brown.ENDINGS)) + brown.MIX * base(b"never seen")
        nowhere = sum(chance(before, k, max(into[k], 1), 0) for k in range(classes + 1) if k not in used)  # classes without words keep their prior
        assert seen + unseen + nowhere == pytest.approx(1, rel=1e-9)


def test_tables_of_many_classes_stay_small():
    """At the most classes, a task's tables and what it takes to make them are a few hundred MB, and gains are the same however many counts are looked up."""
    code = f"""
        import resource
        import numpy as np
        from barloom.llm import brown
        classes = brown.CLASSES * brown.MOST_SPLIT
        table = np.random.default_rng(1).poisson(1, (classes + 33, classes + 33)).astype(float)
        at = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        gains = brown.Gains(table, classes)
        assert gains.most == 1
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - at) // 1024)
    """
    got = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(got.stdout) < 500
    r = np.random.default_rng(3)
    w, d, k, n = np.repeat(np.arange(40), 6), np.tile([0, 0, 0, 1, 1, 1], 40), np.concatenate([np.sort(r.permutation(12)[:3]) for _ in range(80)]), r.integers(1, 12, size=240)
    table, own, most = r.poisson(3, (12, 12)).astype(float), r.integers(10, 12, size=40), []
    for cells in (1, 16 << 20):
        brown.LOOKUP_CELLS, before = cells, brown.LOOKUP_CELLS
        most.append(brown.best_classes(w, d, k, n, own, brown.Gains(table, 10), np.arange(40)))
        brown.LOOKUP_CELLS = before
    assert (most[0] == most[1]).all()


def test_brown_clusters_words_beyond_the_head(spark, monkeypatch):
    """Four classes of words that all end alike, most of them outside the head, the broadcast table or 64 bytes."""
    for name, n in (("WORDS", 60), ("HEAD", 40), ("END_ID", 40), ("IDS", 41 + brown.ENDINGS)):
        monkeypatch.setattr(brown, name, n)
    r = random.Random(9)
    groups = [[f"{p}{i}{'long' * 20 if i % 5 == 0 else ''}zz" for i in range(100)] for p in ("noun", "verb", "adj", "part")]
    rows = [(i, " ".join(r.choice(groups[k % 4]) for k in range(r.randint(10, 60)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(doc_hash("doc_id") % 5 == 1, F.lit(False))
    unseen = [x for x in brown.score_documents(docs, ~held, held).collect() if x["held_out"]]
    assert len(unseen) > 20 and sum(x["score"] - x["base_score"] for x in unseen) > 0.3 * sum(x["n_tokens"] for x in unseen)


def test_brown_classes_grow_with_the_vocabulary():
    assert [brown.class_count(n) for n in (0, 6000, 400_000)] == [64, 64, 256] and brown.class_count(10**7) > 700 and brown.class_count(10**10) == brown.CLASSES * brown.MOST_SPLIT


def test_a_word_goes_to_its_best_class():
    r = np.random.default_rng(4)
    size, classes, words = 12, 10, 30
    stream = r.integers(words, size=4000)
    stream = stream[np.append(True, stream[1:] != stream[:-1])]

    def table(kinds):
        t = np.zeros((size, size))
        np.add.at(t, (kinds[stream[:-1]], kinds[stream[1:]]), 1)
        return t

    for w in (3, 17):
        kinds = r.integers(classes, size=words)
        kinds[w] = classes + 1  # no class yet, so that what others have doesn't change
        around = np.zeros((2, size), np.int64)
        np.add.at(around, (0, kinds[stream[:-1][stream[1:] == w]]), 1)
        np.add.at(around, (1, kinds[stream[1:][stream[:-1] == w]]), 1)
        d, k = np.nonzero(around)
        got = brown.best_classes(np.zeros(len(d), int), d, k, around[d, k], kinds[[w]].astype(np.int64), brown.Gains(table(kinds), classes), np.array([w]))
        moved = [brown.likelihood(table(np.where(np.arange(words) == w, c, kinds))) for c in range(classes)]
        assert moved[got[0]] == pytest.approx(max(moved), rel=1e-12)  # two empty classes are alike


def test_words_that_move_at_once_do_not_all_go_to_a_small_class():
    """Rare words in random order: each alone would gain most in the class of one word. Weighed with counts of chance, few would."""
    r = np.random.default_rng(6)
    classes, words = 10, 4000
    size = classes + 2
    stream, kinds = r.integers(words, size=40_000), r.integers(1, classes, size=words)
    kinds[0] = 0
    left, right = stream[:-1], stream[1:]
    table = np.zeros((size, size))
    np.add.at(table, (kinds[left], kinds[right]), 1)
    cells, n = np.unique(np.concatenate([left * 2 * size + size + kinds[right], right * 2 * size + kinds[left]]), return_counts=True)
    names, w = np.unique(cells // (2 * size), return_inverse=True)
    plain, weighed = (brown.best_classes(w, cells // size % 2, cells % size, n, kinds[names], brown.Gains(t, classes), names) for t in (table, brown.with_background(table)))
    assert (plain == 0).mean() > 0.5 and (weighed == 0).mean() < 1 / classes


def test_brown_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = brown.score_documents(docs, F.lit(False), F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isclose(r["score"], r["base_score"]) for r in got)
    assert brown.score_documents(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(8)
    size, n = 80, 40_000
    stream = np.empty(n, np.int64)
    for i in range(n):  # words of two hidden classes alternate
        stream[i] = 2 * r.integers(size // 2) + i % 2
    kinds = np.concatenate([np.arange(brown.HEAD) // 7 % brown.CLASSES, np.arange(brown.CLASSES, brown.KINDS)])

    def around(kinds):
        counts = np.zeros((brown.IDS, 2, brown.KINDS), np.int64)
        np.add.at(counts, (stream[1:], 0, kinds[stream[:-1]]), 1)
        np.add.at(counts, (stream[:-1], 1, kinds[stream[1:]]), 1)
        return counts

    def likelihood(kinds):
        t = np.zeros((brown.KINDS, brown.KINDS))
        np.add.at(t, (kinds[stream[:-1]], kinds[stream[1:]]), 1)
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    before = likelihood(kinds)
    for k in range(4):
        kinds = brown.exchange(around(kinds), kinds, np.arange(k % 2, size, 2))
    assert likelihood(kinds) > before


def quality_rows(n=400, seed=3):
    """Good texts are sentences from one kind of source, bad ones repeat marks and capitals and come from others."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        text = sentence(r, "aa").capitalize() + "." if good else " ".join(r.choice(["BUY", "NOW!!!", "$$$", "click", "99%"]) for _ in range(r.randint(3, 40)))
        rows.append((i, text, "aa", f"src{r.randint(0, 4) if good == (r.random() < 0.9) else r.randint(5, 9)}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_cotraining_on_held_out_documents(spark):
    rows, labels = quality_rows()
    more = [(900, None, None, None, None), (901, "", "aa", "src1", 0), (902, "ka " * 100_000, "aa", "src1", 300_000), (None, rows[0][1], "aa", "src1", 50), rows[0]]
    docs = spark.createDataFrame([(*x, "clash") for x in rows + more], "doc_id long, text string, lang string, source string, n_chars long, quality string")
    marks = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    whole = cotraining.classify(docs, marks, "judged")
    assert whole.drop("judged").exceptAll(docs).count() == 0 and docs.exceptAll(whole.drop("judged")).count() == 0
    with pytest.raises(ValueError):
        cotraining.classify(docs, marks, "Quality")
    got = whole.select("doc_id", F.col("judged.score").alias("quality_score"), F.col("judged.accepted").alias("quality_accepted")).collect()
    assert len(got) == len(rows) + len(more)
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and not r["doc_id"] % 2]
    good = {i: not t.startswith(("BUY", "NOW", "$", "click", "99")) for i, t, *_ in rows}
    assert sum((r["quality_score"] >= 0.5) == good[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)
    clean = [r for r in unseen if good[r["doc_id"]]]
    assert sum(r["quality_accepted"] for r in clean) >= 0.98 * len(clean)
    assert sum(r["quality_accepted"] for r in unseen if not good[r["doc_id"]]) <= 0.1 * len(unseen)
    assert all(0 <= r["quality_score"] <= 1 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_quality_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(i, "some text", "aa", "s", 9) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(r["quality"]["accepted"] and r["quality"]["score"] == 1.0 for r in cotraining.classify(docs, marks).collect())
    assert cotraining.classify(docs.limit(0), marks).count() == 0


def plain_cotraining(docs, marks):
    """Co-training over lists: every unlabelled document is in the pool, and each view takes its best by sorting them all."""
    words = cotraining._Words()
    meta = lambda d: cotraining.metadata_views(np.array([cotraining.metadata_places(*d[2:])]))[0]
    view = {d[0]: (cotraining.text_view(words, d[1] or "").astype("<f4").astype(float), meta(d)) for d in docs}
    known, pool = sorted(i for i in view if i in marks), sorted(i for i in view if i not in marks)
    given = (set(), set())
    quota = cotraining.quotas(len(pool), np.mean([marks[i] for i in known]))

    def teach(*models):
        out = []
        for k, m in enumerate(models):
            p = {i: float(cotraining._expit(m.log_odds(view[i][k][None]))[0]) for i in pool}
            mine = []
            for label, sure in ((0.0, {i: 1 - x for i, x in p.items()}), (1.0, p)):
                best = sorted((-s, i) for i, s in sure.items() if i not in given[k])[: quota[label]]
                mine += [(i, p[i]) for _, i in best]
            given[k].update(i for i, _ in mine)
            size = (cotraining.TEXT_SIZE, cotraining.META_SIZE)
            out.append((*(np.array([view[i][v] for i, _ in mine]).reshape(-1, size[v]) for v in (0, 1)), np.array([x for _, x in mine])))
        return out

    stack = lambda k: np.array([view[i][k] for i in known])
    model = cotraining.cotrain(stack(0), stack(1), np.array([marks[i] for i in known], float), teach)
    return model, {i: float(model.probability(v[0][None], v[1][None])[0]) for i, v in view.items()}


def test_cotraining_against_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "TAUGHT", 30)
    rows, labels = quality_rows(300, 7)
    model, want = plain_cotraining(rows, {i: q for i, q, _ in labels})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, marks).select("doc_id", "quality.*").collect()
    assert model.taught > 40
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6) and r["accepted"] == (want[r["doc_id"]] >= model.threshold)


def test_both_views_teach_both_classes(spark):
    """Each class in its share of the labelled rows, by either view, however sure the view is."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    featured = cotraining.materialize(cotraining.with_views(docs, keep=["doc_id"]), "views")
    lessons = cotraining.train(featured, labels).lessons
    good = labels.where("quality = 1").count() / labels.where("quality is not null").count()
    for view in ("text", "meta"):
        bad = lessons[view, 0.0] / (lessons[view, 0.0] + lessons[view, 1.0])
        assert lessons[view, 0.0] >= 20 and abs(bad - (1 - good)) < 0.03, lessons
    assert cotraining.quotas(10**9, 0.9) == {1.0: 360, 0.0: 40} and cotraining.quotas(0, 0.5) == {1.0: 1, 0.0: 1}


def test_labelled_rows_are_dealt_into_parts_of_both_classes():
    y = np.array([1.0] * 90 + [0.0] * 10)
    parts = cotraining.deal(y)
    assert sorted(np.concatenate(parts).tolist()) == list(range(100)) and all(0 < y[p].mean() < 1 for p in parts)
    assert cotraining.deal(np.array([1.0] * 90 + [0.0] * 2)) is None


def test_seeds_count_their_neighbours_in_the_table_of_pairs(spark, tmp_path):
    r, ids = random.Random(3), brown.Ids(40)
    streams = [[r.randrange(ids.more + 10) for _ in range(r.randrange(30))] for _ in range(50)]
    streams = [[x for x in s if x != ids.end] for s in streams]
    low = ids.low(np.array([r.randrange(brown.ENDINGS) for _ in range(50)]))
    kinds = np.concatenate([np.arange(brown.HEAD) % brown.CLASSES, np.arange(brown.CLASSES, brown.KINDS)]).astype(np.int32)
    texts = spark.createDataFrame([(len(s), brown._pack(np.array(s, "<i4"))) for s in streams], "length int, ids binary").repartition(3)
    got = brown.neighbours(brown.pairs(texts, ids, sum(map(len, streams)), f"{tmp_path}/pairs"), kinds, low)
    want = np.zeros_like(got)
    for s in streams:
        for x, y in zip([ids.end, *s], [*s, ids.end]):
            want[low[x], 1, kinds[low[y]]] += 1
            if low[y] < brown.HEAD:
                want[low[y], 0, kinds[low[x]]] += 1
    assert (got == want).all() and got.sum() > 0
