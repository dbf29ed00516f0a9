"""Baseline JPEG media columns: lossless payloads in DCT coefficients, Huffman decoding, DC-only thumbnails.

JPEG's own unit is the quantised coefficient, which its entropy coding keeps exactly; samples would lose bits in the
transform. So 64 bytes of payload are the 64 coefficients of one 8x8 block, in zigzag order: byte values are ranked,
and rank r is the coefficient +-(r // 2 + 1). Restart markers every RESTART blocks split a scan into parts that
can be decoded alone; numpy decodes one symbol of every part at each step.

The decoder reads any baseline or extended-Huffman 8-bit file of one interleaved scan (grey or colour, any sampling
factors), with or without restart markers.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import materialize, text_steps, texts_of

#: Byte values that texts have most; others follow by value (fixed values).
FREQUENT = b" enatirosdhlucmg.pb,fyvw\nq!j\xc3\xb3kzxT*"
RANKED = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)], np.uint8)
RESTART = 16
#: Bytes of text that are encoded or decoded at once, and segments.
STEP_BYTES, STEP_SEGMENTS = 3 << 20, 4096
#: Huffman codes: number of codes of each length 1..16, and the symbols (sizes in bits; for AC also 0x00 EOB, 0xF0 ZRL).
DC_LENGTHS, DC_SYMBOLS = (0, 0, 7, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (3, 4, 5, 2, 1, 6, 7, 8, 0, 9, 10)
AC_LENGTHS, AC_SYMBOLS = (0, 3, 1, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0), (2, 3, 1, 4, 5, 6, 7, 8, 0x00, 0xF0)

_sign = np.where(np.arange(256) % 2, -1, 1)
COEFFICIENT = np.empty(256, np.int16)
COEFFICIENT[RANKED] = _sign * (np.arange(256) // 2 + 1)


def _codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) by JPEG's canonical rule."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for s in symbols[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


def _size_table(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(lengths, symbols)
    return np.array([codes.get(s, (0, 0))[0] for s in range(12)], np.int64), np.array([codes.get(s, (0, 0))[1] for s in range(12)], np.int64)


_DC, _AC = _size_table(DC_LENGTHS, DC_SYMBOLS), _size_table(AC_LENGTHS, AC_SYMBOLS)
_BITS = np.array([int(x).bit_length() for x in range(1024)], np.int64)


def _words(values: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code and extra bits of each value as one word, and its length."""
    size = _BITS[np.abs(values)]
    extra = np.where(values > 0, values, values + (1 << size) - 1)
    return (table[0][size] << size) | extra, table[1][size] + size


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down for at least so many blocks."""
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def _header(wide: int, high: int, n_bytes: int, payload: int) -> bytes:
    part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    quant = bytes([0, 8, *[1] * 63])
    return b"".join((
        b"\xff\xd8", part(0xFE, b"payload" + struct.pack(">QQ", n_bytes, payload)), part(0xDB, quant),
        part(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00"),
        part(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)), part(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
        part(0xDD, struct.pack(">H", RESTART)), part(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def encode(texts: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each text, whose coefficients are the text and zero bytes up to a multiple of 64.

    Long texts are cut between segments, so that about STEP_BYTES are worked on at once.
    """
    files: list[list[bytes]] = []
    todo: list[tuple[int, bytes, int, bool]] = []  # file, bytes of whole blocks, number of the first segment, whether the last part
    held = 0
    per = RESTART * 64

    def flush() -> None:
        for (i, _, _, last), raw in zip(todo, _scans([x[1:] for x in todo]), strict=True):
            files[i] += [raw, b"\xff\xd9"] if last else [raw]
        todo.clear()

    for i, t in enumerate(texts):
        blocks = max(1, -(-len(t) // 64))
        wide, high = grid(blocks)
        if wide > 8191:
            raise ValueError("a payload of over 4 GB doesn't fit a JPEG")
        files.append([_header(wide, high, len(t), blocks * 64)])
        total, step = wide * high * 64, STEP_BYTES // per * per
        for at in range(0, total, step):
            size = min(step, total - at)
            part = t[at : at + size]
            part = part.ljust(min(size, max(0, blocks * 64 - at)), b"\0").ljust(size, b" ")
            todo.append((i, part, at // per, at + size == total))
            held += size
            if held >= STEP_BYTES:
                flush()
                held = 0
    flush()
    return [b"".join(f) for f in files]


def _scans(parts: list[tuple[bytes, int, bool]]) -> list[bytes]:
    """Entropy-coded segments of each (bytes of whole blocks, number of the first segment, whether the file ends here)."""
    if not parts:
        return []
    coef = COEFFICIENT[np.frombuffer(b"".join(p[0] for p in parts), np.uint8)].astype(np.int64).reshape(-1, 64)
    counts = np.array([len(p[0]) // 64 for p in parts])
    first = np.repeat(np.cumsum(counts) - counts, counts)
    local = np.arange(len(coef)) - first
    starts = np.flatnonzero(local % RESTART == 0)  # of segments, in blocks
    diff = coef[:, 0].copy()
    diff[1:] -= coef[:-1, 0]
    diff[starts] = coef[starts, 0]
    words, bits = _words(coef, _AC)
    words[:, 0], bits[:, 0] = _words(diff, _DC)
    words, bits = words.ravel(), bits.ravel()
    ends = np.cumsum(bits)
    seg_end = ends[np.append(starts[1:], len(coef)) * 64 - 1]
    seg_from = np.append(0, seg_end[:-1])
    seg_bytes = -(-(seg_end - seg_from) // 8)
    seg_at = np.cumsum(seg_bytes) - seg_bytes
    per = np.diff(np.append(starts, len(coef))) * 64
    at = ends - bits + np.repeat(seg_at * 8 - seg_from, per)
    window = (words << (32 - bits - (at & 7))).astype(np.uint32)  # words have at most 25 bits
    total = int(seg_bytes.sum())
    packed = np.zeros(total + 4, np.int64)
    for k in range(4):
        packed += np.bincount((at >> 3) + k, ((window >> np.uint32(24 - 8 * k)) & np.uint32(255)).astype(np.float64), total + 4).astype(np.int64)
    data = packed[:total].astype(np.uint8)
    fill = seg_bytes * 8 - (seg_end - seg_from)
    data[seg_at + seg_bytes - 1] |= ((1 << fill) - 1).astype(np.uint8)
    # stuffing after each 0xFF, and restart markers after all segments of a file but its last
    of_part = np.repeat(np.arange(len(parts)), -(-counts // RESTART))
    order = local[starts] // RESTART + np.array([p[1] for p in parts])[of_part]
    end_of_part = np.append(of_part[1:] != of_part[:-1], True)
    last = end_of_part & np.array([p[2] for p in parts])[of_part]
    room = np.where(last, 0, 2)
    ff = data == 0xFF
    place = np.cumsum(ff) - ff + np.arange(total) + np.repeat(np.cumsum(room) - room, seg_bytes)
    out = np.zeros(total + int(ff.sum()) + int(room.sum()), np.uint8)
    out[place] = data
    tail = seg_at + seg_bytes - 1
    after = place[tail] + 1 + ff[tail]
    out[after[~last]], out[after[~last] + 1] = 0xFF, (0xD0 + order[~last] % 8).astype(np.uint8)
    cuts, raw, begin, scans = (after + room)[end_of_part], out.tobytes(), 0, []
    for end in cuts.tolist():
        scans.append(raw[begin:end])
        begin = end
    return scans


@dataclass
class Parsed:
    """What a file's markers say, and the bytes of its scan without stuffing, cut at restart markers."""

    width: int = 0
    height: int = 0
    components: list[list[int]] = field(default_factory=list)  # id, h, v, quantisation table, DC table, AC table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    segments: list[bytes] = field(default_factory=list)

    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def mcus(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.components) == 1 else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Parsed:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = Parsed(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not out.height or not out.width:
                raise ValueError("only 8-bit files with their height are read")
            out.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                out.huffman[body[0]] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if body[0] != len(out.components):
                raise ValueError("only files of one scan are read")
            for i in range(body[0]):
                for c in out.components:
                    if c[0] == body[1 + 2 * i]:
                        c[4:] = [body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15]
            end = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])").search(data, at)
            scan = data[at : end.start() if end else len(data)]
            out.segments = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff+[\xd0-\xd7]", scan)]
            return out


@lru_cache(maxsize=64)
def _lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: bits of the code (0: none), zeros before the value, the value's bits, and the value where all fit."""
    table = np.zeros((65536, 4), np.int32)
    for s, (code, n) in _codes(lengths, symbols).items():
        size, low, high = s & 15, code << (16 - n), (code + 1) << (16 - n)
        rows = np.arange(low, high)
        table[low:high, 0], table[low:high, 1], table[low:high, 2] = n, s >> 4, size
        if size and n + size <= 16:
            extra = (rows >> (16 - n - size)) & ((1 << size) - 1)
            table[low:high, 3] = np.where(extra >> (size - 1), extra, extra - (1 << size) + 1)
    return table


def _decode_segments(segments: list[bytes], blocks: np.ndarray, pattern: list[int], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quantised coefficients in zigzag order, (segments, most blocks, 64); DC values are still differences."""
    lanes, most = len(segments), int(blocks.max())
    sizes = np.array([len(s) + 8 for s in segments])
    flat = np.frombuffer(b"".join(s + bytes(8) for s in segments) + bytes(8), np.uint8).astype(np.uint32)
    word = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    used = sorted({id(t): t for pair in tables for t in pair}.items())
    number = {k: i for i, (k, _) in enumerate(used)}
    lookup = np.concatenate([t for _, t in used])
    n_bits, runs, sizes_of, direct = (np.ascontiguousarray(lookup[:, i]) for i in range(4))
    base = np.array([[number[id(tables[c][k])] << 16 for k in (0, 1)] for c in pattern])
    out = np.zeros(lanes * most * 64, np.int16)
    live = np.arange(lanes)
    bit = (np.cumsum(sizes) - sizes) * 8
    end = (bit // 8 + sizes) * 8
    k, block, of = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), blocks.astype(np.int64)
    home = live * most * 64
    one_table = len(pattern) == 1
    while len(live):
        top = word[bit >> 3] << (bit & 7).astype(np.uint32)
        which = base[0, (k > 0).view(np.int8)] if one_table else base[block % len(pattern), (k > 0).view(np.int8)]
        e = which + (top >> np.uint32(16))
        n, run, size = n_bits[e], runs[e], sizes_of[e]
        if not n.all() or (bit > end).any():
            raise ValueError("a scan has bits that are no code")
        value = direct[e]
        if (slow := np.flatnonzero(n + size > 16)).size:
            p = bit[slow] + n[slow]
            more = ((word[p >> 3] << (p & 7).astype(np.uint32)) >> (32 - size[slow]).astype(np.uint32)).astype(np.int32)
            value[slow] = np.where(more >> (size[slow] - 1), more, more - (1 << size[slow]) + 1)
        bit = bit + n + size
        is_dc = k == 0
        k = k + np.where(is_dc, 0, run)
        keep = size > 0
        if (k[keep] > 63).any():
            raise ValueError("a block has over 64 coefficients")
        if keep.all():
            out[home + block * 64 + k] = value
        else:
            out[(home + block * 64 + k)[keep]] = value[keep]
        k = np.where(keep | is_dc | (run == 15), k + 1, 64)
        if (over := k > 63).any():
            block = block + over
            k[over] = 0
            if (done := block >= of).any():
                left = ~done
                live, bit, end, k, block, of, home = (x[left] for x in (live, bit, end, k, block, of, home))
    return out.reshape(lanes, most, 64)


def decode(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Each file's markers and its blocks' coefficients in scan order, (blocks, 64) in zigzag order, DC values absolute.

    About STEP_SEGMENTS segments or STEP_BYTES are decoded at once, of many files or of a part of one.
    """
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault((tuple(p.pattern()), tuple((p.huffman[c[4]], p.huffman[c[5]]) for c in p.components)), []).append(i)
    out: list = [None] * len(files)
    for (pattern, codes), members in groups.items():
        tables = [(_lookup(*a), _lookup(*b)) for a, b in codes]
        todo: list[tuple[int, int, bytes, int]] = []  # file, first block, segment, blocks
        held = 0

        def flush(todo: list = todo, pattern: tuple = pattern, tables: list = tables) -> None:
            if not todo:
                return
            coef = _decode_segments([x[2] for x in todo], np.array([x[3] for x in todo]), list(pattern), tables)
            for c in set(pattern):
                mine = np.flatnonzero(np.array([pattern[j % len(pattern)] for j in range(coef.shape[1])]) == c)
                coef[:, mine, 0] = np.cumsum(coef[:, mine, 0], axis=1)
            for k, (i, at, _, n) in enumerate(todo):
                out[i][1][at : at + n] = coef[k, :n]
            todo.clear()

        for i in members:
            p, (across, down) = parsed[i], parsed[i].mcus()
            per = p.restart or across * down
            counts = [min(per, across * down - at) * len(pattern) for at in range(0, across * down, per)]
            if len(counts) != len(p.segments):
                raise ValueError("restart markers are missing")
            if sum(counts) > 32 * sum(map(len, p.segments)) + 64:
                raise ValueError("a scan is too short for its blocks")
            out[i] = (p, np.empty((sum(counts), 64), np.int16))
            first = 0
            for s, n in zip(p.segments, counts, strict=True):
                todo.append((i, first, s, n))
                first += n
                held += len(s) + 64
                if len(todo) >= STEP_SEGMENTS or held >= STEP_BYTES:
                    flush()
                    held = 0
        flush()
    return out


def thumbnail(p: Parsed, coef: np.ndarray) -> np.ndarray:
    """One luminance sample a block, from DC values only: (rows, columns) of uint8."""
    _, h, v, tq, _, _ = p.components[0]
    across, down = p.mcus()
    pattern = p.pattern()
    if len(pattern) == 1:
        h = v = 1
    luma = coef.reshape(-1, len(pattern), 64)[:, : h * v, 0].astype(np.int64).reshape(down, across, v, h)
    dc = luma.transpose(0, 2, 1, 3).reshape(down * v, across * h) * p.quant[tq][0]
    top = (1, 1) if len(p.components) == 1 else (max(c[1] for c in p.components), max(c[2] for c in p.components))
    rows, cols = -(-(-(-p.height * v // top[1])) // 8), -(-(-(-p.width * h // top[0])) // 8)
    return np.clip(np.rint(dc / 8 + 128), 0, 255).astype(np.uint8)[:rows, :cols]


def payload_of(p: Parsed, coef: np.ndarray) -> tuple[bytes, int]:
    """The payload that `encode` stored, and its length without padding."""
    note = next((c for c in p.comments if c[:7] == b"payload" and len(c) == 23), None)
    if note is None:
        raise ValueError("the file holds no payload")
    n_bytes, size = struct.unpack(">QQ", note[7:])
    c = coef.reshape(-1)
    if size > len(c) or n_bytes > size:
        raise ValueError("the payload is longer than the scan")
    rank = 2 * np.abs(c) - 2 + (c < 0)
    if ((rank < 0) | (rank > 255)).any():
        raise ValueError("a coefficient stands for no byte")
    return RANKED[rank[:size]].tobytes(), n_bytes


MEDIA = "doc_id long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width int, height int, thumbnail_sha256 string, error string"
)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and a JPEG of each row's whole text. A null text is an empty one; repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, 2 * STEP_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(encode([t.encode() for t in texts_of(b)]), pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def _decode_each(files: list[bytes | None]) -> list[tuple[Parsed, np.ndarray] | str]:
    """What `decode` gives for each file, or why it can't be read."""
    try:
        return list(decode(files))
    except Exception:  # noqa: BLE001  one of them is broken: find out which
        out: list = []
        for f in files:
            try:
                out += decode([f]) if f is not None else ["no file"]
            except Exception as e:  # noqa: BLE001
                out.append(f"{type(e).__name__}: {e}"[:200])
        return out


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the thumbnail's features of every stored file, from its bytes.

    A null or broken file, and one that holds no payload, gives a row with its doc_id, what could be read, and the reason in
    `error`; repeated rows and null ids stay.
    """

    def features(doc: int | None, f: bytes | None, got: tuple[Parsed, np.ndarray] | str) -> tuple:
        stored = (None, None) if f is None else (len(f), hashlib.sha256(f).hexdigest())
        if isinstance(got, str):
            return (doc, None, None, None, None, *stored, None, None, None, None, got)
        p, coef = got
        small = thumbnail(p, coef)
        sha = hashlib.sha256(struct.pack(">II", *small.shape) + small.tobytes()).hexdigest()
        seen = (f"{p.width}x{p.height}:{sha[:16]}", p.width, p.height, sha)
        try:
            payload, n = payload_of(p, coef)
        except ValueError as e:
            return (doc, None, None, None, None, *stored, *seen, f"ValueError: {e}")
        return (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, *seen, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, STEP_BYTES):
            files = b.column(1).to_pylist()
            rows = [features(*r) for r in zip(b.column(0).to_pylist(), files, _decode_each(files), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op3_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored JPEG, and what its bytes say; a null text is an empty one."""
    return media_features(materialize(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
