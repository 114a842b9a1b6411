"""Public tokenizer files inside Spark tasks.

The driver reads the JSON file (a few MB: bounded by the vocabulary) and the
tasks receive its text, so executors need no local copy. A worker keeps the
parsed tokenizer between tasks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import regex

_LOADED: dict[str, object] = {}


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _load(kind, spec: str):
    key = kind.__name__ + hashlib.sha1(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = kind(spec)
    return _LOADED[key]


def byte_encoder(spec: str) -> ByteBpe:
    return _load(ByteBpe, spec)


def word_encoder(spec: str) -> WordBpe:
    return _load(WordBpe, spec)


def _special_pattern(tok) -> tuple[re.Pattern | None, dict[str, int]]:
    ids = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    names = sorted(ids, key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None), ids


# Fixed value: the split of byte-level BPE.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Merging one very long word is slow in the fast encoder.
_LONG_WORD = re.compile(r"\S{2000}|\s{2000}")
# The split of the lower-case word BPE (white space is dropped).
WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
_LATIN = {b: c for b, c in _ALPHABET.items()}


class ByteBpe:
    """Byte-level BPE: the ids of a text as little-endian unsigned 32-bit
    bytes. The vocabulary's ids are its merge ranks, so the rank encoder gives
    the tokenizer's ids, several times faster; texts with very long words go
    through the tokenizer itself."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.special, self.special_ids = _special_pattern(self.tok)
        byte_of = {c: b for b, c in _ALPHABET.items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t not in self.special_ids}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        if _LONG_WORD.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            if part in self.special_ids:
                out.append(self.special_ids[part].to_bytes(4, "little"))
            elif part:
                out.append(self._plain(part))
        return b"".join(out)


class WordBpe:
    """Lower-case BPE with word ends. ``split`` gives a text's words: a
    special token is the word " " + token, which no other word looks like."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.special, self.special_ids = _special_pattern(self.tok)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.pieces = [self.tok.id_to_token(i) for i in range(size)]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return WORD_SPLIT_ASCII.findall(text.lower())
        return WORD_SPLIT.findall(self.tok.normalizer.normalize_str(text))

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.special.split(text):
            if part in self.special_ids:
                out.append(" " + part)
            elif part:
                out.extend(self._plain(part))
        return out

    def encode(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special_ids[word[1:]]]
        return [t.id for t in self.tok.model.tokenize(word.encode("utf-8").decode("latin-1").translate(_LATIN))]
