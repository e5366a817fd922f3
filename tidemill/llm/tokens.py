"""Cached encoders that give the ids of the tokenizers library, word by word."""

from __future__ import annotations

import re
import unicodedata

import regex
from tokenizers import Tokenizer

#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_TO_CHAR = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """A byte-level BPE of one pre-tokenizer pattern; the ids of a piece are remembered, `most` pieces at a time."""

    def __init__(self, definition: str, pattern: str, most: int = 200_000):
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.pattern = regex.compile(pattern)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.most, self.cache, self.short = most, {}, {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, word: str) -> bytes:
        """Ids of one pre-token, four bytes each."""
        if not (word.isascii() and word.isprintable() and " " not in word):  # those bytes stand for themselves
            word = word.encode().decode("latin-1").translate(BYTE_TO_CHAR)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(word)])

    def parts(self, text: str):
        """Stretches of text between special tokens, and the ids of those."""
        if self.special is None or "<|" not in text:
            yield text, None
            return
        for x in self.special.split(text):
            yield x, self.added.get(x)

    def _remembered(self, key: str, make) -> bytes:
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            found = self.cache[key] = make(key)
        return found


class WordEncoder(Encoder):
    """For vocabularies with word ends: NFC, lower case, white space dropped. Remembers stretches between white space."""

    def __init__(self, definition: str, most: int = 200_000):
        super().__init__(definition, WORD_PATTERN, most)

    def _stretch(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.piece(chunk)
        out, short = [], self.short
        for w in self.pattern.findall(chunk):
            if len(w) > 3:
                out.append(self.piece(w))
                continue
            ids = short.get(w)  # digits, marks and short runs of letters
            if ids is None:
                if len(short) >= self.most:
                    short.clear()
                ids = short[w] = self.piece(w)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()  # no final sigma
            # characters that str.split takes for white space, but the pattern does not
            chunks = part.split() if not _ODD.search(part) else [part]
            found = list(map(self.cache.get, chunks))
            if None in found:
                found = [x or self._remembered(c, self._stretch) for x, c in zip(found, chunks, strict=True)]
            out += found
        return b"".join(out)


_ODD = re.compile("[\x1c-\x1f]")
