import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from barloom.llm import chat, jpeg

TEXTS = [b"", b"\0", b"x" * 64, b"y" * 65, bytes(range(256)) * 5, "ÿñ".encode() * 700, b"plain words and more words. " * 3000]


def bits(data):
    for byte in data:
        for k in range(7, -1, -1):
            yield byte >> k & 1


def decode_slowly(p):
    """One bit at a time, as the standard tells it."""
    trees = {k: {(n, c): s for s, (c, n) in jpeg._codes(*v).items()} for k, v in p.huffman.items()}

    def symbol(stream, tree):
        code = n = 0
        while True:
            code, n = code << 1 | next(stream), n + 1
            if (n, code) in tree:
                return tree[n, code]

    def value(stream, size):
        v = 0
        for _ in range(size):
            v = v << 1 | next(stream)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    across, down = p.mcus()
    per, pattern, out = p.restart or across * down, p.pattern(), []
    for k, seg in enumerate(p.segments):
        stream, before = bits(seg), [0] * len(p.components)
        for _ in range(min(per, across * down - k * per)):
            for c in pattern:
                block = [0] * 64
                before[c] += value(stream, symbol(stream, trees[p.components[c][4]]))
                block[0], i = before[c], 1
                while i < 64:
                    s = symbol(stream, trees[p.components[c][5]])
                    if s == 0:
                        break
                    i += s >> 4
                    if s & 15:
                        block[i] = value(stream, s & 15)
                    i += 1
                out.append(block)
    return np.array(out)


def test_payloads_come_back_and_agree_with_a_slow_decoder():
    files = jpeg.encode(TEXTS)
    for t, f, (p, coef) in zip(TEXTS, files, jpeg.decode(files), strict=True):
        payload, n = jpeg.payload_of(p, coef)
        assert n == len(t) and payload == t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        if len(t) < 3000:
            assert (decode_slowly(jpeg.parse(f)) == coef).all()
        small = jpeg.thumbnail(p, coef)
        assert small.shape == (p.height // 8, p.width // 8)
        assert small.ravel()[0] == min(255, int(jpeg.COEFFICIENT[payload[0]]) + 128)


def colour_file(restart, seed):
    """A 4:2:0 file of random coefficients with runs of zeros, written bit by bit."""
    r = random.Random(seed)
    dc = ((0, 0, 0, 12) + (0,) * 12, tuple(range(12)))
    symbols = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11) if run < 15 or size < 11]
    ac = ((0,) * 7 + (len(symbols),) + (0,) * 8, tuple(symbols)) if len(symbols) < 255 else None
    d, a = jpeg._codes(*dc), jpeg._codes(*ac)
    width, height = 40, 27
    across, down = -(-width // 16), -(-height // 16)
    per, segments, blocks = restart or across * down, [], []
    for at in range(0, across * down, per):
        out, before = "", [0, 0, 0]
        for _ in range(min(per, across * down - at)):
            for c in (0, 0, 0, 0, 1, 2):
                block = [r.randint(-900, 900)] + [r.choice([0] * 12 + [r.randint(-300, 300)]) for _ in range(63)]
                blocks.append(block)
                diff = block[0] - before[c]
                before[c] = block[0]
                put = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
                code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
                out += code(d, abs(diff).bit_length()) + put(diff)
                zeros = 0
                last = max([i for i in range(64) if block[i]] + [0])
                for v in block[1 : last + 1]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        out, zeros = out + code(a, 0xF0), zeros - 16
                    out, zeros = out + code(a, zeros << 4 | abs(v).bit_length()) + put(v), 0
                if last < 63:
                    out += code(a, 0x00)
        out += "1" * (-len(out) % 8)
        segments.append(bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0"))
    part = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    head = b"\xff\xd8" + part(0xDB, bytes([0, *[2] * 64])) + part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += part(0xC4, b"\x00" + bytes(dc[0]) + bytes(dc[1]) + b"\x10" + bytes(ac[0]) + bytes(ac[1])) + (part(0xDD, struct.pack(">H", restart)) if restart else b"")
    scan = b"".join(s + (bytes([0xFF, 0xD0 + k % 8]) if k < len(segments) - 1 else b"") for k, s in enumerate(segments))
    return head + part(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_colour_files(restart):
    f, blocks = colour_file(restart, restart)
    p, coef = jpeg.decode([f])[0]
    assert (coef == blocks).all() and (decode_slowly(p) == blocks).all()
    small = jpeg.thumbnail(p, coef)
    assert small.shape == (4, 5)
    assert small[0, 1] == np.clip(np.rint(blocks[1][0] * 2 / 8 + 128), 0, 255)
    assert small[1, 0] == np.clip(np.rint(blocks[2][0] * 2 / 8 + 128), 0, 255)
    assert small[0, 2] == np.clip(np.rint(blocks[6][0] * 2 / 8 + 128), 0, 255)


def test_broken_files_are_refused():
    f = jpeg.encode([b"some text"])[0]
    for bad in (b"", b"GIF89a", f[:30], f.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError, struct.error)):
            jpeg.decode([bad])


def test_broken_and_null_files_give_rows_with_a_reason(spark):
    good, colour = jpeg.encode([b"some text"])[0], colour_file(4, 1)[0]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(good[:60])), (5, bytearray(colour)), (None, bytearray(good)), (6, bytearray(good[:-8] + b"\xff\xd9")), (7, bytearray())]
    got = {r["doc_id"]: r for r in jpeg.media_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == len(rows) and got[1]["error"] is None and got[1]["n_bytes"] == got[None]["n_bytes"] == 9
    for i in (2, 3, 4, 7):
        assert got[i]["error"] and got[i]["payload_sha256"] is None and got[i]["feature"] is None, i
    assert got[5]["feature"].startswith("40x27:") and "payload" in got[5]["error"] and got[2]["media_bytes"] is None and got[3]["media_bytes"] == 6


def test_long_texts_are_encoded_in_parts(monkeypatch):
    """The parts' scans make the file that is made at once, and a text of 24 MB takes little memory."""
    import subprocess
    import sys

    texts = [b"x" * 5000, b"", bytes(range(256)) * 40, b"y" * 3072]
    whole = jpeg.encode(texts)
    monkeypatch.setattr(jpeg, "STEP_BYTES", 2048)
    monkeypatch.setattr(jpeg, "STEP_SEGMENTS", 3)
    assert jpeg.encode(texts) == whole
    for t, (p, coef) in zip(texts, jpeg.decode(whole), strict=True):
        assert jpeg.payload_of(p, coef)[0][: len(t)] == t
    code = """if 1:
        import resource
        from barloom.llm import jpeg
        t = b"some words of a long text, " * 900_000
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        (f,) = jpeg.encode([t])
        ((p, coef),) = jpeg.decode([f])
        assert jpeg.payload_of(p, coef)[0][: len(t)] == t
        print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
    """
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(used.stdout) < 500_000


def test_op3_operator(spark):
    rows = [(i, t.decode("latin-1"), "en") for i, t in enumerate(TEXTS)] + [(90, None, None), (1, "twice", "en"), (1, "twice", "en"), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = jpeg.media_features(jpeg.store_media(docs)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for r, g in zip(sorted(rows, key=key), sorted(got, key=lambda g: (g["doc_id"] is None, g["doc_id"] or 0, g["n_bytes"])), strict=True):
        t = (r[1] or "").encode()
        payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(g["media_sha256"], g["feature"]) for g in got if g["doc_id"] == 1 and g["n_bytes"] == 5}) == 1
    assert jpeg.media_features(jpeg.store_media(docs.limit(0))).count() == 0


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<s", "[ROLE]a[TEXT]", "<<SYS>>\\<</SYS>>", "", "[INST] [INST] ", "\n</s"]


def test_escaping_is_reversible_and_leaves_no_mark():
    t = chat.TEMPLATE
    for role in ("user", "assistant", "system", "tool", "[TEXT]", ""):
        for text in HARD:
            segments = t.segments(role, text)
            assert t.read("".join(s for s, _ in segments)) == [(role, text)]
            body = next(s for s, _ in segments[1:] if s == t.escape(text))
            assert chat.unescape(body) == text and not any(m in body for m in t.controls())


def test_all_short_texts_of_marks_come_back():
    """Every text of up to three pieces of marks, whole or cut, in every role, alone and with turns after it."""
    t = chat.TEMPLATE
    pieces = [*t.controls(), "[INST]", "[/INST]", " ", "\\", "<", "s>", "</", "<<", "[", "]", "a"]
    after = [("user", "[INST]"), ("assistant", " [/INST"), ("tool", "[TEXT")]
    tail = "".join(x for role, text in after for x, _ in t.segments(role, text))
    for n in range(4):
        for some in itertools.product(pieces, repeat=n):
            text = "".join(some)
            for role in ("system", "user", "assistant", "tool"):
                assert t.read("".join(x for x, _ in t.segments(role, text)) + tail) == [(role, text), *after], (role, text)


def test_templates_that_could_not_be_read_back():
    for marks in ({"a": ("<", "</a>")}, {"a": ("<a>", "</a>"), "b": ("<a>b", "</b>")}, {"a": ("<a>", "|a|")}, {"a": ("<a>", "\\end")}, {"a": ("<a>", "</a>"), "b": ("<a>", "</b>")}):
        with pytest.raises(ValueError, match="marks|mark"):
            chat.Template(marks, frozenset(), {}, frozenset())
    with pytest.raises(ValueError, match="opens"):
        chat.TEMPLATE.read("plain")
    with pytest.raises(ValueError, match="closed"):
        chat.TEMPLATE.read("[INST] never ends")


def test_op8_query_of_hard_texts(spark, tmp_path):
    """Texts that end as marks begin, a very long text, and a long conversation."""
    deal = random.Random(8)
    pieces = [*chat.TEMPLATE.controls(), "[INST]", "hi [INST]", " ", "\\", "ok"]
    rows = [(1, 0, "user", "hi [INST]"), (1, 1, "assistant", "[INST]"), (2, 0, "user", "[INST] word " * 200_000), (2, 1, "assistant", "\\</s>" * 100_000)]
    rows += [(3, k, ("user", "assistant")[k % 2], "".join(deal.choices(pieces, k=deal.randint(0, 6)))) for k in range(5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op8_role_machine_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {-1, 1, 2, 3}
    for conv in (1, 2, 3):
        mine = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["loss_chars"], g["valid"]) == (len(mine), len(loss), True)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest() and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def conversations(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", HARD[0]), (1, 2, "assistant", HARD[0]), (2, 0, "assistant", "first?"), (3, 0, "user", None), (3, 1, "assistant", "é\U0001f600"), (3, 1, "assistant", "é\U0001f600"), (4, None, None, None), (None, 0, "user", "hm"), (5, 0, "tool", "x")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string"), rows


def test_op8_operator(spark):
    df, rows = conversations(spark)
    got = {r["conv_id"]: r for r in chat.read_digests(chat.materialize(chat.format_conversations(df), "chat")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(mine), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {k: g["valid"] for k, g in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False}
    assert chat.read_digests(chat.format_conversations(df.limit(0))).count() == 0
