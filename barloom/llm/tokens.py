"""Encoding with the tokenizers library, once per distinct chunk of text.

Where a tokenizer's pre-tokenizer never joins text over a blank, a text's ids are the ids of its chunks in order. Each
distinct chunk is cut into the pre-tokenizer's words once, and the library's BPE model encodes each distinct word
once. A text with a special token's string, and any tokenizer of another kind, goes to the library whole. Both ways
give the library's ids for the whole text.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Unicode White_Space, as the tokenizers' patterns have it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: One optional blank and what follows up to the next white space; of white space, all but the last character.
BYTE_CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORD_CHUNKS = re.compile(f"[^{WHITE}]+")
_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Characters of a text that are cut into chunks at once (a longer chunk stays whole).
WINDOW = 1 << 20
#: Words inside a chunk of each kind: the tokenizers' own patterns, for text whose only white space is a first blank.
BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+")
PUNCTUATION = frozenset(string.punctuation)


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """`text` in parts of about `size` characters. Parts begin where chunks of either kind do, so theirs are the whole text's."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_chunks(text: str) -> list[str]:
    """WORD_CHUNKS of a text: str.split takes the same white space, and U+001C to U+001F besides."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return WORD_CHUNKS.findall(text)
    return text.split()


def byte_characters() -> dict[int, int]:
    """Byte-level BPE's character of each byte: itself where it's printable Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: b if b in shown else next(hidden) for b in range(256)}


def lower_nfc(text: str) -> str:
    """NFC, then lower case of each character alone (no final sigma), as the tokenizers' normalizers do it."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunking(spec: dict) -> tuple[re.Pattern, regex.Pattern, bool] | None:
    """Patterns of chunks and of words in them, and whether texts are normalized; None where texts go in whole."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("truncation") or spec.get("padding") or spec.get("post_processor") or spec["model"]["type"] != "BPE":
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return BYTE_CHUNKS, BYTE_WORDS, False
    parts = pre.get("pretokenizers", [])
    if [x["type"] for x in parts] == ["Split", "ByteLevel"] and norm and norm["type"] == "Sequence":
        split, steps = parts[0], [x["type"] for x in norm["normalizers"]]
        pattern = split["pattern"].get("Regex", "")
        if split["behavior"] == "Removed" and split["invert"] and pattern.endswith(r"|[^\s\p{L}\p{N}]+") and steps == ["NFC", "Replace", "Lowercase"]:
            return WORD_CHUNKS, regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{L}")), True
    return None


class ChunkEncoder(dict):
    """Maps a chunk or a word to its ids as little-endian bytes.

    Holds about `max_chunks` of them or `max_bytes` (and a text's window), and as many of the generation before, from which
    those still in use come back.
    """

    def __init__(self, path: str, max_chunks: int = 250_000, max_bytes: int = 32 << 20) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = chunking(spec)
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"={self.code}").newbyteorder("<")
        self.characters = byte_characters()
        self.max_chunks, self.max_bytes, self.bytes = max_chunks, max_bytes, 0
        self.older: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[str]:
        core = chunk[1:] if chunk[0] == " " else chunk
        if core.isalpha() or core.isspace() or not core:
            return [chunk]
        if core[-1] in PUNCTUATION and core[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.kind[1].findall(chunk)

    def _ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):  # those characters stand for themselves
            word = word.encode().decode("latin-1").translate(self.characters)
        tokens = self.model.tokenize(word)
        return array(self.code, [t.id for t in tokens]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            text = lower_nfc(chunk) if self.kind[2] else chunk
            words = self._words(text)
            if len(words) == 1:
                out = self._ids(words[0])
            elif text is chunk or text.isascii():  # each word's ids are those of it as a chunk
                out = b"".join([self[w] for w in words])
            else:
                out = b"".join([self._ids(w) for w in words])
        self[chunk] = out
        self.bytes += len(chunk) + len(out)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of `dtype`."""
        if self.kind is None:
            return [self._whole(t) for t in texts]
        find = word_chunks if self.kind[0] is WORD_CHUNKS else self.kind[0].findall
        get, out = self.__getitem__, []
        for t in texts:
            if any(s in t for s in self.specials):
                out.append(self._whole(t))
            else:
                parts = []
                for w in windows(t):
                    parts.append(b"".join(map(get, find(w))))
                    self._forget()
                out.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return out

    def _forget(self) -> None:
        if len(self) > self.max_chunks or self.bytes > self.max_bytes:
            self.older, self.bytes = dict(self), 0
            self.clear()


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a tokenizer file; reused Python workers keep it between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
