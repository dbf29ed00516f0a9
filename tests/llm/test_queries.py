"""The registered queries over whole small tables, against plain Python."""

import hashlib
import os
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from barloom.llm.queries import queries
from test_dedup import components, every_pair, link_rows
from test_models import base_scores, is_held
from test_runs_and_bytes import plain_digest, plain_rearranged

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, n):
    (name,) = [x for x in queries() if x.startswith(f"op{n}_")]
    return queries()[name](spark, SF).collect()


def library_ids(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op1(spark, documents):
    got = run(spark, 1)
    assert {r["doc_id"] for r in got} == {*documents} and len(got) == len(documents)
    score = {r["doc_id"]: r["score"] for r in got}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in score and r["quality"] is not None]
    good, bad = ([score[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    ahead = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert ahead > 0.9, ahead
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert np.mean([kept[r["doc_id"]] for r in labels if r["quality"] == 1]) >= 0.97


def test_op2(spark, documents):
    order = sorted(documents)
    _, ids = library_ids("byte_bpe_50k.json", [documents[i]["text"] or "" for i in order])
    want, at = {}, 0
    for i, x in zip(order, ids, strict=True):
        x = [*x, 2]
        want[i] = (at, len(x), zlib.crc32(packed(x)))
        at += len(x)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, 2)} == want


def test_op3(spark, documents):
    got = run(spark, 3)
    assert len(got) == len(documents)
    by_text = defaultdict(set)
    for r in got:
        t = (documents[r["doc_id"]]["text"] or "").encode()
        p = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        by_text[t].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_op4(spark, documents):
    _, ids = library_ids("word_bpe_49k.json", [r["text"] or "" for r in documents.values()])
    want, total = {}, 0
    for i, x in zip(documents, ids, strict=True):
        x = [*x, 1]
        total += len(x)
        for k, at in enumerate(range(0, len(x), 4096)):
            want[i, k] = (at, len(x[at : at + 4096]), zlib.crc32(packed(x[at : at + 4096])))
    got = run(spark, 4)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= 1.05 * -(-total // 4096) + 1


def test_op5(spark, documents):
    rows = [(i, r["text"]) for i, r in documents.items()]
    want = {i: x for (i, _), x in zip(rows, base_scores(rows), strict=True)}
    got = run(spark, 5)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, is_held(r["doc_id"], 1))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6(spark, documents):
    t, ids = library_ids("word_bpe_49k.json", [r["text"] or "" for r in documents.values()])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x), sha(packed(x)), sha(t.decode(x, skip_special_tokens=False).encode())) for i, x in zip(documents, ids, strict=True)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, 6)} == want


def test_op7(spark, documents):
    texts = {i: r["text"] for i, r in documents.items()}
    sets, links = every_pair(texts, 4)
    low = components(texts, links)
    got = run(spark, 7)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), low[i], low[i] == i) for i in texts}


def test_op8(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in run(spark, 8)}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[i]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss)) and r["formatted_chars"] > sum(len(t) for _, t in turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_op9(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {i: x for (i, _, _), x in zip(rows, link_rows(rows), strict=True)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, 9)} == want


def test_op10(spark, documents):
    got = run(spark, 10)
    assert len(got) == len(documents)
    languages = {r["lang"] for r in documents.values()} - {None}
    for r in got:
        t = documents[r["doc_id"]]["text"] or ""
        assert r["held_out"] == is_held(r["doc_id"], 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t)) and r["lang_pred"] in languages | {"und"}
    held = [r for r in got if r["held_out"] and documents[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_op11(spark, documents):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = {i: library.encode_ordinary(r["text"] or "") for i, r in documents.items()}
    want = {i: (len(x), sha(" ".join(map(str, x))), sha(documents[i]["text"] or "")) for i, x in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, 11)} == want


def test_op12(spark, documents):
    got = run(spark, 12)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: plain_digest(i, r["text"] or "") for i, r in documents.items()} and len(got) == len(documents)
    assert sum(r["n_runs"] > 0 for r in got) > 0.05 * len(got)


def test_op13(spark, documents):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, r in documents.items():
        *row, output = plain_rearranged(i, r["text"] or "")
        want[i] = (*row, sha(output), sha(r["text"] or ""))
    assert {r["doc_id"]: tuple(r)[1:] for r in run(spark, 13)} == want


def test_pipeline(spark, documents):
    """Each stage takes what its predecessor kept; the last one packs every kept document whole."""
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items() and len(after) >= 0.5 * len(before)
    low = components(before, every_pair(before, 5)[1])
    assert set(after) == {i for i in before if low[i] == i}
    _, ids = library_ids("word_bpe_49k.json", [t or "" for t in after.values()])
    assert rebuilt(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == sorted((i, [*x, 1]) for i, x in zip(after, ids, strict=True))


def rebuilt(sequences):
    """(doc_id, ids) of every document, from the packed sequences alone."""
    back = defaultdict(dict)
    for r in sequences:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert len(ids) == r["n_tokens"] <= 4096 and {p["doc_id"] for p in r["pieces"]} == {*r["doc_ids"]}
        for p in r["pieces"]:
            back[p["row"], p["doc_id"]][p["start"]] = ids[p["offset"] : p["offset"] + p["length"]].tolist()
    return sorted(((doc, [x for at in sorted(parts) for x in parts[at]]) for (_, doc), parts in back.items()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """All columns keep their values, whatever they are called; rows of one id and texts of null ids are documents each."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, Score string, kept int, language double, quality_score string, row string, views int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    words, other = "several plain words that make a text of some length here", "wholly different ones stand in this one, which shares an id with others"
    more = ("USER1", 1, 0.5, "mine", "r", None)
    rows = [(1, words, "en", "s", 9, *more), (1, words, "en", "s", 9, *more), (2, words, None, None, None, *[None] * 6), (None, words, "en", "s", 9, *more), (3, None, "en", None, 0, *[None] * 6), (1, other, "en", "t", 9, *more), (None, other + " yes indeed", "en", "s", 9, *more), (None, "a third text of this table with a null id", "en", "s", 9, *more)]
    want = [{*rows} - {rows[4]}, {*rows} - {rows[4]}, {rows[0], rows[5], rows[7]}]
    for data, ends in ((rows, want), ([], [set()] * 3)):
        docs = spark.createDataFrame(data, schema)
        for (name, stage), end in zip(corpus_pipeline.STAGES, [*ends, None], strict=True):
            got = stage(spark, docs, str(tmp_path))
            if name != "best_fit_packing":
                assert got.columns == docs.columns and got.schema == docs.schema
                rows_ = [tuple(r) for r in got.collect()]
                assert {*rows_} == end, name
                docs = spark.createDataFrame(rows_, schema)
        assert len(rows_) == len(ends[-1])
        _, ids = library_ids("word_bpe_49k.json", [r[1] for r in rows_])
        assert rebuilt(got.collect()) == sorted(((r[0], [*x, 1]) for r, x in zip(rows_, ids, strict=True)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
