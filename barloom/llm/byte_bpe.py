"""Byte-level BPE with the tiktoken library and a local rank file, and raw bytes back from ids.

A long text is split before it meets the library, only where no match of the pattern goes across and none changes by
it: before white space that follows something else. What has no such place for long is matched here, piece by piece:
a run of white space, all but its last character where a word follows, and a run without any, by the pattern itself.
A piece that is still long is encoded in overlapping spans. Merges are local, so ids are those of the whole piece if every
pair of neighbours encodes to itself: a span ends at a token after which the next span begins with one that passes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table, text_steps, texts_of
from barloom.llm.tokens import WHITE, windows

#: Characters of a text that the library takes at once, and bytes of one span of a piece.
PART, SPAN = 1 << 18, 1 << 16
#: Words, numbers, the rest and white space, with a first blank or a contraction's end: the only pattern whose safe cuts are known (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MATCH = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
_STRETCH = re.compile(f"[{WHITE}]{{{PART},}}|[^{WHITE}]{{{PART},}}")


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str = PATTERN, span: int = SPAN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.splits = pattern == PATTERN
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.span = span

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The text's ids, part by part."""
        if not self.splits:
            yield self._ids(text)
            return
        for part in windows(text, PART):
            at = 0
            for m in _STRETCH.finditer(part) if len(part) >= PART else ():
                start, stop = m.span()
                if start < at:
                    continue
                if part[start] in _WHITE:
                    if at < start:
                        yield self._ids(part[at:start])  # ends before white space
                    at = stop if stop == len(part) else stop - 1
                    yield from self.piece(part[start:at].encode())
                else:
                    first = start  # with the white space before it, so that the cut is safe
                    while first > at and part[first - 1] in _WHITE:
                        first -= 1
                    if at < first:
                        yield self._ids(part[at:first])
                    yield from self._run(part[first:stop])
                    at = stop
            if at == 0 or at < len(part):
                yield self._ids(part[at:] if at else part)

    def _ids(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())

    def _run(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a long text with white space at most before it, match by match.

        Characters that Unicode had not assigned when this Python was made could be letters to the library: it takes them whole.
        """
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            yield self._ids(text)
            return
        short: list[int] = []
        for m in _MATCH.finditer(text):
            piece = m.group().encode()
            if len(piece) <= self.span:
                short += self.library._encode_single_piece(piece)
            if short and (len(short) > self.span or len(piece) > self.span):
                yield np.array(short, np.uint32)
                short = []
            if len(piece) > self.span:
                yield from self.piece(piece)
        yield np.array(short, np.uint32)

    def piece(self, piece: bytes) -> list[np.ndarray]:
        """Ids of one match, however long; where spans don't meet, of the whole at once."""
        encode, done, at = self.library._encode_single_piece, [], 0
        ids = encode(piece[: self.span])
        while at + self.span < len(piece):
            ends = at + np.cumsum([len(self.tokens[x]) for x in ids])
            for k in range(len(ids) * 3 // 4, max(len(ids) * 3 // 4 - 64, 0), -1):
                to = int(ends[k - 1])
                after = encode(piece[to : to + self.span])
                if after[0] == ids[k] or encode(self.tokens[ids[k - 1]] + self.tokens[after[0]]) == [ids[k - 1], after[0]]:
                    break
            else:
                return [np.array(encode(piece), np.uint32)]
            done.append(np.array(ids[:k], np.uint32))
            ids, at = after, to
        return [*done, np.array(ids, np.uint32)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, which need not be UTF-8."""
        return self.library.decode_bytes(ids.tolist())

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimals with blanks between, and of the decoded bytes; of a part at a time."""
        n, all_ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            if len(ids):
                all_ids.update(((" " if n else "") + " ".join(map(self.decimal.__getitem__, ids.tolist()))).encode())
                decoded.update(self.decode(ids))
                n += len(ids)
        return n, all_ids.hexdigest(), decoded.hexdigest()


_WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str = PATTERN) -> ByteBpe:
    """This process's coder for a rank file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each row.

    A null text is an empty one and has no ids; null doc_ids and repeated rows come back as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in text_steps(batches, 2 << 20):
            ids = [b"".join(x.astype("<u4").tobytes() for x in bpe.parts(t)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and raw bytes of each row of (doc_id, ids) as `encode_documents` gives them; null ids are none, and give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in text_steps(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digest_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each row, made where the texts are; rows as `encode_documents` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks, pattern)
        for b in text_steps(batches, 2 << 20):
            n, ids, decoded = zip(*map(bpe.digests, texts_of(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_tiktoken_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of `documents` encoded and decoded; a null text has no ids, null ids and repeated rows come back each."""
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
