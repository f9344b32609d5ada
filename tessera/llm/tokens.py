"""Whole-text tokenization with a tokenizers file, memoised by word.

The file lower-cases a text, splits it into words and encodes each word by itself, so a text's ids are the ids of its
words one after the other. A word's ids are computed once per Python worker and kept as packed bytes. Texts in which that
does not hold (special tokens' strings, separators that Python and the tokenizer class differently) are encoded whole, and
so is every text with a file of other settings.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import numpy as np
import regex

#: Words in each half of a worker's memo.
MEMO = 200_000
#: The file's pre-tokenizer after lower-casing, for ASCII, for texts of ASCII and Latin-1 letters, and for any text.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"[a-z]+|{_SHORT}|[0-9]|[^\sa-z0-9]+")
_LATIN = re.compile(rf"[a-z\xdf-\xf6\xf8-\xff]+|{_SHORT}|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
_BEYOND = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_ANY = regex.compile(rf"{_SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")
#: Sought one by one: a search for a plain string takes a small part of the time of one for a class of characters.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTES = _byte_letters()


class _Memo(dict):
    """The ids of words. A full half is set aside; of its words those met again before the next is full stay known."""

    def __init__(self, encode):
        self.encode = encode
        self.aside: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.aside.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.aside = dict(self)
                self.clear()
            self[word] = found
        return found


#: The settings for which the patterns above stand.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": rf"{_SHORT}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(settings: dict) -> bool:
    """Whether a tokenizers file encodes word by word in the way that this module repeats."""
    normal, before = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    model, added = settings.get("model") or {}, settings.get("added_tokens") or []
    return (
        normal.get("normalizers") == _NORMALIZERS
        and before.get("pretokenizers") == [_SPLIT, _BYTE_LEVEL]
        and model.get("type") == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in added)
        and not settings.get("truncation") and not settings.get("padding")
    )


class Encoder:
    """encode(text) -> uint32 array; a None text counts as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab_size = self.tok.get_vocab_size()
        self.model = self.tok.model
        self.packed = [struct.pack("<I", i) for i in range(max(self.tok.get_vocab().values(), default=-1) + 1)]
        self.words = _Memo(self._word)
        with open(path, encoding="utf-8") as file:
            self.by_words = by_words(json.load(file))

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # else each byte is its own letter
            word = word.encode().decode("latin1").translate(_BYTES)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if not self.by_words or any(odd in text for odd in _ODD):
            return np.frombuffer(self._whole(text), dtype="<u4")
        if text.isascii():
            pieces = _ASCII.findall(text.lower())
        elif not _BEYOND.search(text):
            pieces = _LATIN.findall(text.lower())
        else:  # case is mapped character by character, as the file's normalizer does
            pieces = _ANY.findall("".join([c.lower() for c in unicodedata.normalize("NFC", text)]))
        return np.frombuffer(b"".join(map(self.words.__getitem__, pieces)), dtype="<u4")

    def token_strings(self) -> dict[int, str]:
        return {i: s for s, i in self.tok.get_vocab().items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
