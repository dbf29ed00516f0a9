"""Near-duplicate operators against all pairs on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from barloom.llm import embedding_dedup, minhash
from barloom.llm.components import connected_components


def components(ids, links):
    """Smallest id that each id reaches, by repeated relabelling."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 240)]
    rows = [*chain, *star, (5, 5), (3, None), (None, 3), (240, 241), (241, 240), (2, 230)]
    random.Random(3).shuffle(rows)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    links = [(a, b) for a, b in rows if a is not None and b is not None and a != b]
    assert got == components({x for p in links for x in p}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def every_pair(texts, n):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    return sets, [(a, b) for (a, s), (b, t) in itertools.combinations(sorted(sets.items()), 2) if s and t and 100 * len(s & t) >= 80 * len(s | t)]


def near_texts(seed=5):
    """Families of edited copies from 0 to 40 % apart, texts that share a long passage, and odd ones."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = r.choices(words, k=60)
    out = []
    for _ in range(25):
        base = r.choices(words, k=r.choice((8, 30, 120, 400)))
        out.append(" ".join(base))
        for share in (0, 0.01, 0.02, 0.03, 0.05, 0.08):
            out.append(" ".join(x if r.random() >= share else r.choice(words) for x in base))
        out.append(" ".join([*base, *r.choices(words, k=max(1, len(base) // 5))]))
    out += [" ".join([*passage, *r.choices(words, k=40)]) for _ in range(40)]
    out += ["", None, "   \n\t", "one", "ONE", "one\x0btwo", "one two", "one two", "É x y z q", "é x y z q", "a b c d e", "A B C D E"]
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("words", "limits"), [(4, {}), (5, {}), (5, {"HOPEFUL": 0, "COPIES": 2, "MOST_BITS": 64, "CHUNK_BITS": 64})])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, words, limits):
    """With other limits too: sets in all blocks, salted copies, and a bitset that lets nearly every document pass."""
    for name, n in limits.items():
        monkeypatch.setattr(minhash, name, n)
    texts = near_texts()
    sets, links = every_pair(texts, words)
    low = components(texts, links)
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in texts.items()], "text string, doc_id long, kept string, component_id int")
    got = minhash.near_duplicates(docs, words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), low[i], low[i] == i) for i in texts}
    assert len(got) == len(texts)


@pytest.mark.parametrize("hopeful", [4, 0])
def test_a_large_bucket_of_many_components_is_tried_in_full(spark, monkeypatch, hopeful):
    """Texts that all share half of their shingles stand in many common buckets; pairs of them link there."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HOPEFUL", hopeful)
    r = random.Random(9)
    common = [f"c{i}" for i in range(80)]
    texts = {}
    for i in range(60):
        own = [f"o{i}_{j}" for j in range(60)]
        texts[2 * i], texts[2 * i + 1] = " ".join(common + own), " ".join(common + own[: 60 - r.randint(1, 8)])
    sets, links = every_pair(texts, 5)
    low = components(texts, links)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(links) >= 60
    assert {x["doc_id"]: x["component_id"] for x in got} == low


def test_near_duplicates_of_odd_rows(spark):
    text = "some words that are the same in both of these rows"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (9, text.upper()), (4, "x " * 200_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (4, 4, True), (9, 1, False)]
    # a doc_id of several texts joins the groups of all of them
    words = [[f"{p}{i}" for i in range(30)] for p in "xyz"]
    rows = [(3, " ".join(words[0])), (5, " ".join(words[0])), (5, " ".join(words[1])), (7, " ".join(words[1])), (5, " ".join(words[2])), (8, " ".join(words[2])), (9, "else")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 3), (9, 9)]
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_register_estimates_are_near_the_truth():
    r = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        x = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
        both = int(4000 * 2 * share / (1 + share))
        y = np.concatenate([x[:both], r.integers(0, 1 << 64, 4000 - both, dtype=np.uint64)])
        a, b = minhash.registers([np.unique(x), np.unique(y)])
        got = minhash.estimates(a[None], b[None], np.array([4000]), np.array([4000]))[0]
        assert abs(got - share) < 0.14


def link_rows(rows, threshold=0.93):
    """(n_links, component) of each row, from all pairs."""
    good = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = []
    for (k, i, v, a), (m, j, w, b) in itertools.combinations(good, 2):
        if a == b and len(v) == len(w) and (v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)) >= threshold:
            links.append((k, m, i, j))
    low = components({i for i, _, _ in rows}, [(i, j) for _, _, i, j in links])
    return [(sum(k in x[:2] for x in links), low[i]) for k, (i, _, _) in enumerate(rows)]


def vectors(seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = r.standard_normal(24)
            rows += [((centre + s * r.standard_normal(24)).tolist(), label) for s in (0, 0.1, 0.2, 0.3, 0.35, 0.4)]
    same = r.standard_normal(24).tolist()
    rows += [(same, 0)] * 40 + [(same, 1), ([2 * x for x in same], 0), ([-x for x in same], 0)]
    rows += [(None, 0), ([], 0), ([0.0] * 24, 0), ([float("nan"), *same[1:]], 0), ([float("inf"), *same[1:]], 0), ([None, *same[1:]], 0), (same[:12], 0), ([1e-30 * x for x in same], 0), ([1e30 * x for x in same], 1)]
    order = r.permutation(len(rows))
    return [(int(k), *rows[k]) for k in order]


@pytest.mark.parametrize(("block", "hopeful"), [(256, 4), (4, 4), (4, 0), (256, 0.6)])
def test_vectors_against_all_pairs(spark, monkeypatch, block, hopeful):
    """With blocks cut, and with all or some vectors heavy."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "HOPEFUL", hopeful)
    rows = vectors()
    want = {i: x for (i, _, _), x in zip(rows, link_rows(rows), strict=True)}
    frame = spark.createDataFrame([(i, v, lab, 5) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = embedding_dedup.near_duplicate_vectors(frame).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_odd_vector_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    empty = embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (3, [1.0, 0.01], "a"), (4, [1.0, 0.0], "b")]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False), (4, 0, 4, True)]


def test_no_table_is_left_after_a_scope(spark, tmp_path):
    """What op7's result reads is removed when its reader's scope ends."""
    import os

    from barloom.llm.common import scratch_scope, shared_dir

    rows = [(i, f"these are some words of text number {i // 3} and so on") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared_dir(spark).removeprefix("file://") + "/barloom"
    os.makedirs(folder, exist_ok=True)
    before = {*os.listdir(folder)}
    with scratch_scope(spark):
        assert len(minhash.op7_hyperminhash_dedup(spark, str(tmp_path)).collect()) == 30
    assert {*os.listdir(folder)} == before
