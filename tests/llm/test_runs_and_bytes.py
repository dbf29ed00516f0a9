import hashlib
import os
import random
import subprocess
import sys
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from barloom.llm import byte_bpe, fill_in_middle, tandem

ODD = [(1, "a a a a a a a", "n"), (1, "a a a a a a a", None), (2, None, "n"), (None, "b c b c b c b c b c x", "n"), (3, "", "n"), (4, " \n\t ", "n"), (5, " x x  🙂é <P", "n"), (6, "it's  2 words's\n\n\n end ", "n")]
SCHEMA = "DOC_ID long, text string, Start string"


def frame(spark, rows):
    """Rows whose other columns are called as results are."""
    return spark.createDataFrame(rows, SCHEMA)


# --- runs of words


def all_runs(words, least_words=6, least_periods=4):
    """Every run, by comparing words at each distance."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= max(least_words, least_periods * q):
                    out.append((i, j + q - i, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = [w for w in text.encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, best = all_runs(words), None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q or (length * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, length, q)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    start, length, q = best or (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), start, length, q, 1000 * length // q if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_many_sequences_at_once():
    deal = random.Random(1)
    for _ in range(150):
        sequences = []
        for _ in range(deal.randint(0, 20)):
            k = deal.randint(1, 4)
            w = [deal.randrange(k) for _ in range(deal.randint(0, 50))]
            if w and deal.random() < 0.6:
                unit, at = [deal.randrange(k) for _ in range(deal.randint(1, 6))], deal.randrange(len(w))
                w[at:at] = (unit * 30)[: deal.randint(1, 9 * len(unit))]
            sequences.append(np.array(w, np.int32))
        for w, got in zip(sequences, tandem.runs_of(sequences), strict=True):
            assert [tuple(r) for r in got.tolist()] == all_runs(w.tolist())
        if sequences:
            for w, (start, length, period) in zip(sequences[:1], [tandem.SuffixTree(sequences[:1]).runs(2, 2)], strict=True):
                assert [*zip(start.tolist(), length.tolist(), period.tolist(), strict=True)] == all_runs(w.tolist(), 2, 2)


def test_tree_against_sorted_suffixes():
    deal = random.Random(2)
    for n in (0, 1, 2, 30, 200):
        w = [deal.randrange(2) for _ in range(n)]
        tree = tandem.SuffixTree([np.array(w, np.int32)])
        whole = [*w, 2]
        assert tree.suffixes.tolist() == sorted(range(n + 1), key=lambda i: whole[i:])
        for k in range(1, n + 1):
            a, b = (whole[x:] for x in tree.suffixes[k - 1 : k + 1].tolist())
            assert tree.common[k] == next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def test_leaves_are_listed_in_parts(monkeypatch):
    w = np.array([i % 7 % 3 for i in range(500)], np.int32)
    want = tandem.runs_of([w, w[:90]])
    monkeypatch.setattr(tandem, "LISTED", 16)
    monkeypatch.setattr(tandem, "PART", 8)
    assert all((a == b).all() for a, b in zip(tandem.runs_of([w, w[:90]]), want, strict=True))
    text = " ".join(f"w{x}" for x in w.tolist()).encode() + b" \t"
    numbers, names = tandem.words_of(text)
    assert [names[x] for x in numbers.tolist()] == text.split() and b"".join(tandem.joined(numbers, names)) == b" ".join(text.split())


def test_digests_of_runs(spark):
    deal = random.Random(3)
    rows = [*ODD, *((i, " ".join(deal.choices(["the", "cat", "sat", "Cat x", "é"], k=deal.randint(0, 200))), "n") for i in range(10, 90)), (7, "x " * 3000, "n")]
    got = tandem.digest_runs(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *plain_digest(i, t or "")) for i, t, _ in rows), key=str)
    assert tandem.digest_runs(frame(spark, [])).count() == 0
    found = {tuple(r) for r in tandem.find_runs(frame(spark, rows)).collect()}
    assert found == {(i, *r) for i, t, _ in rows for r in all_runs((t or "").encode().split())}
    short = {r["doc_id"]: r["text"] for r in tandem.collapse(frame(spark, rows)).collect()}
    assert short[1] == "a" and short[None] == "b c x" and short[2] == "" and short[7] == "x"


def test_long_periodic_text():
    n = 400_000
    words = np.arange(n, dtype=np.int32) % 1000
    words[:1000] = 5
    (runs,) = tandem.runs_of([words])
    assert runs.tolist() == [[0, 1000, 1], [1000, n - 1000, 1000]]


# --- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    assert public_tokenizers.PATTERN == byte_bpe.PATTERN
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts_of_pieces(deal, n):
    pieces = ["a", "ß", "日本", "'s", "'", "1", "٣", "!", "…", " ", "  ", "\n", "　", "\u0085", "\x1c", "hello", " world", "é", "🙂", "͸", "'ll"]
    return ["".join(deal.choices(pieces, k=deal.randint(0, n))) for _ in range(400)]


def test_long_texts_are_split_where_it_changes_nothing(ranks, monkeypatch):
    import re

    monkeypatch.setattr(byte_bpe, "PART", 12)
    monkeypatch.setattr(byte_bpe, "_STRETCH", re.compile(byte_bpe._STRETCH.pattern.replace(str(1 << 18), "6")))
    bpe = byte_bpe.ByteBpe(ranks, span=16)
    deal = random.Random(4)
    long = ["".join(deal.choices("abcé", k=deal.randint(1, 400))) for _ in range(60)] + ["a" * 500, "é" * 300, " " * 200, " " * 99 + "x", "\n" * 99 + "x", "x" + " \n" * 50 + "'s" + "7" * 80]
    for t in [*texts_of_pieces(deal, 60), *long, *(a + b for a in long[:20] for b in long[-6:])]:
        parts = [x.tolist() for x in bpe.parts(t)]
        want = bpe.library.encode_ordinary(t)
        assert sum(parts, []) == want, t
        assert b"".join(bpe.decode(np.array(p, np.uint32)) for p in parts) == t.encode()
        assert bpe.digests(t) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_documents_as_the_library_has_them(spark, ranks):
    import public_tokenizers

    rows = [*ODD, (9, "word " * 100_000, "n"), (10, " " * 600_000 + "x", None), (11, "ab" * 300_000, "n")]
    library = byte_bpe.ByteBpe(ranks).library
    encoded = byte_bpe.encode_documents(frame(spark, rows), ranks, public_tokenizers.PATTERN)
    got = sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in encoded.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    back = byte_bpe.decode_documents(encoded, ranks).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in back), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    digests = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in byte_bpe.digest_documents(frame(spark, rows), ranks).collect()}
    assert digests == {(i, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert byte_bpe.digest_documents(frame(spark, []), ranks).count() == byte_bpe.encode_documents(frame(spark, []), ranks).count() == 0
    odd = spark.createDataFrame([(1, bytearray(np.array([198, 50, 255, 0], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode_documents(odd, ranks).collect()} == {1: library.decode_bytes([198, 50, 255, 0]), 2: b""}


def test_memory_of_long_pieces(ranks):
    """Texts that are one match of 24 million characters take few bytes a character, and runs of white space don't stop the library."""
    code = f"""
        import resource, sys
        from barloom.llm.byte_bpe import ByteBpe
        bpe = ByteBpe({ranks!r})
        bpe.digests("warm up")
        at = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for text in ("ab" * 12_000_000, " " * 24_000_000 + "x"):
            n, _, _ = bpe.digests(text)
            assert n > 100_000
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - at) // 1024)
    """
    got = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(got.stdout) < 600


# --- fill-in-middle


def plain_rearranged(doc_id, text):
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rearranged_and_restored(spark):
    deal = random.Random(5)
    sizes = [0, 1, 2, 3, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 70_000]
    texts = ["".join(deal.choices("ab🙂é\n\r \x00<>PSM\\$", k=n)) for n in sizes for _ in range(12)]
    rows = [*ODD, (7, "x<S>y", "n"), (8, "<P", "n"), (None, "some text", "n"), *((100 + i, t, "n") for i, t in enumerate(texts))]
    d = fill_in_middle.restore(fill_in_middle.rearrange(frame(spark, rows)))
    got = d.collect()
    want = [(i, *plain_rearranged(i, t or ""), t or "") for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.rearrange(frame(spark, [])).count() == 0


def test_other_sentinels(spark):
    how = fill_in_middle.Arrangement("[$^", "<|fim.suf|>", "\\E*", 100, 50)
    rows = [(i, f"text {i} with $^ and fim.suf", "n") for i in range(40)]
    d = fill_in_middle.restore(fill_in_middle.rearrange(frame(spark, rows), how), how)
    got = d.collect()
    assert {r["doc_id"]: r["restored"] for r in got} == {i: t for i, t, _ in rows} and {r["form"] for r in got} == {"psm", "spm"}
    for marks in (("<a>", "<a>b", "c"), ("", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle.Arrangement(*marks)


def test_rearranged_by_sql(spark, tmp_path):
    texts = ["", "é🙂" * 700, "plain words", None, "has <M> in it", "\n\r\n" * 400]
    rows = spark.createDataFrame([(i, texts[i % 6]) for i in range(60)] + [(None, "no id")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(fill_in_middle.OP13_SQL).fetchall()
    assert sorted(map(tuple, fill_in_middle.op13_fill_in_middle(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_native_plan(spark, tmp_path):
    """No Python and no shuffle, and the text is cut into windows once."""
    frame(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    plan = fill_in_middle.op13_fill_in_middle(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("{1,1024}") == 1 and plan.count("split(") == 1
