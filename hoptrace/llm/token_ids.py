"""Exact token ids of whole texts: those of the ``tokenizers`` library's own ``encode``, with a bounded cache.

A byte-pair tokenizer first cuts a text into pre-tokens by a published pattern, and merges never cross a cut. So a text
of well-known characters is cut by that pattern here, the model of the library gives each distinct pre-token's ids, and
the ids are joined. Words between blanks, which are always cuts, are looked up first.

Every other text goes to the library's ``encode`` as a whole: one with a character outside ``KNOWN`` (Unicode tables
differ between libraries, and combining marks change their neighbours), or with the content of an added token, such as
an end-of-text mark, in any case of letters. Tests compare the ids over every code point and over the added tokens. A
tokenizer file of another kind is handled by the library alone.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

#: Entries of one worker's cache (some 150 bytes each); what comes later is encoded each time it occurs.
CACHE_ENTRIES = 600_000
#: Longer ones are not kept.
CACHED_CHARS = 48

# The published cutting patterns of the two kinds of tokenizer, and each for texts of ASCII alone.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WITH_SPACE = ENDINGS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WITH_SPACE_ASCII = ENDINGS + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
WITHOUT_SPACE = ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WITHOUT_SPACE_ASCII = ENDINGS + r"|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet's rule: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}


_BYTES = _byte_characters()


class _Shown(dict):
    """Characters' numbers to what stands for their bytes in that alphabet."""

    def __missing__(self, number: int) -> str:
        self[number] = shown = chr(number).encode().decode("latin-1").translate(_BYTES)
        return shown


_SHOWN = _Shown()


class _Pieces(dict):
    """Stretches of text between cuts to the bytes of their ids; one that is missing is encoded, or cut further first."""

    def __init__(self, model, dtype: np.dtype, size: int, cut):
        super().__init__()
        self.tokenize, self.cut = model.tokenize, cut
        self.unit = [int(i).to_bytes(dtype.itemsize, "little") for i in range(size)]

    def __missing__(self, piece: str) -> bytes:
        if not (piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha())):  # else one pre-token: letters, with one space at most
            if piece[:-1].isalpha():  # a cut is before what follows letters
                ids = self[piece[:-1]] + self[piece[-1]]
                if len(piece) <= CACHED_CHARS and len(self) < CACHE_ENTRIES:
                    self[piece] = ids
                return ids
            parts = self.cut[not piece.isascii()](piece)
            if len(parts) != 1:
                ids = b"".join(map(self.__getitem__, parts))
                if len(piece) <= CACHED_CHARS and len(self) < CACHE_ENTRIES:
                    self[piece] = ids
                return ids
            piece = parts[0]
        unit = self.unit
        shown = piece if piece.isascii() and piece.isalpha() else piece.translate(_SHOWN)
        ids = b"".join([unit[t.id] for t in self.tokenize(shown)])
        if len(piece) <= CACHED_CHARS and len(self) < CACHE_ENTRIES:
            self[piece] = ids
        return ids


#: Characters that both cut alike, whatever stands beside them: ASCII without most controls, Latin and Cyrillic letters,
#: usual marks, kana, ideographs and Hangul syllables; all are in composed form already.
KNOWN = r"\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Blanks that are not known to be cuts where a blank goes with the word behind it.
RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")


class TextEncoder:
    """``encode(texts)`` gives, for each text (null: empty), its ids as a numpy array of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [before])
        norm = [x.get("type") for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.lower = norm == ["NFC", "Replace", "Lowercase"]
        self.cut = None
        if kind.get("model", {}).get("type") == "BPE" and all(x.get("add_prefix_space") is False for x in parts if x.get("type") == "ByteLevel"):
            if len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not kind.get("normalizer"):
                self.cut = (re.compile(WITH_SPACE_ASCII, re.ASCII).findall, regex.compile(WITH_SPACE).findall)
            elif len(parts) == 2 and self.lower and parts[0].get("pattern", {}).get("Regex") == WITHOUT_SPACE:
                self.cut = (re.compile(WITHOUT_SPACE_ASCII, re.ASCII).findall, regex.compile(WITHOUT_SPACE).findall)
        self.pieces = _Pieces(self.tokenizer.model, self.dtype, size, self.cut)
        self.unknown = re.compile(f"[^{KNOWN}]").search
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _bytes(self, text: str) -> bytes:
        """Ids of a whole text, cut at blanks first: a blank is dropped, or a lone one goes with the word behind it."""
        low = text.lower()
        if self.cut is None or self.unknown(text) or any(mark in low for mark in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if self.lower:
            return b"".join(map(self.pieces.__getitem__, low.replace("\n", " ").split(" ")))
        if any(x in text for x in RUNS):
            return b"".join(map(self.pieces.__getitem__, self.cut[not text.isascii()](text)))
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(self._bytes(t) if t else b"", dtype=self.dtype) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One per worker process and file."""
    return TextEncoder(path)
