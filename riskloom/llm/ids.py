"""Token ids of whole texts by the tokenizers library, word by word through bounded tables.

The library's model merges every distinct pre-token once; tables give the ids of words and of pre-tokens seen
before, as little-endian 32-bit bytes. Texts are cut into pre-tokens by the published pattern, so the ids are
those of the library's own ``encode`` (tests compare them), without its cutting, which takes most of its time.
"""

from __future__ import annotations

import json
import struct

import numpy as np

from .tokens import _SPLIT, byte_symbols

#: Entries of each of the two tables of a worker (about 150 bytes each); a full table is begun anew.
TABLE = 500_000
_STOPS = frozenset(".,;:!?")


class _Odd(Exception):
    """The text has white space that words split at single spaces can't stand for."""


class LibraryIds:
    """Ids of a byte-level vocabulary file. ``special``: whether special strings inside texts are special tokens, as is the library's default."""

    def __init__(self, path: str, special: bool = True, limit: int = TABLE):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            names = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.special = [n for n in names if n] if special else []
        self.limit = limit
        symbols = {b: s for b, s in byte_symbols().items()}
        merge, parts = self.whole.model.tokenize, regex.compile(_SPLIT).findall

        class Table(dict):
            """A table that is begun anew where it is full."""

            def keep(self, key: str, value: bytes) -> bytes:
                if len(key) < 64:
                    if len(self) >= limit:
                        self.clear()
                    self[key] = value
                return value

        packs = [struct.Struct(f"<{n}I").pack for n in range(64)]
        space = symbols[32]

        class PreTokens(Table):
            def __missing__(self, part: str) -> bytes:
                if part.isascii() and part[1:].isalpha():
                    shown = space + part[1:] if part[0] == " " else part if part[0].isalpha() else part.translate(symbols)
                else:
                    shown = part.encode().decode("latin-1").translate(symbols)
                ids = [t.id for t in merge(shown)]
                return self.keep(part, packs[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes())

        class Words(Table):
            """Ids of ' ' + word, by word. Letters, letters before one stop, and letters after one line end need no pattern to be cut."""

            def __missing__(self, word: str) -> bytes:
                if word.isalpha():
                    return self.keep(word, pre(" " + word))
                if word[-1:] in _STOPS and word[:-1].isalpha():
                    return self.keep(word, pre(" " + word[:-1]) + pre(word[-1]))
                head, line, tail = word.partition("\n")
                if line and head and tail.isalpha() and not head[-1].isspace():
                    return self[head] + pre("\n") + pre(tail)
                if not word or word[0].isspace():
                    raise _Odd
                return self.keep(word, b"".join(map(pre, parts(" " + word))))

        pre, self.words, self.parts = PreTokens().__getitem__, Words().__getitem__, parts
        self.pre = pre

    def data(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *words = text.split(" ")
        try:
            return b"".join([*map(self.pre, self.parts(head)), *map(self.words, words)])
        except _Odd:
            return b"".join(map(self.pre, self.parts(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.data(text), "<u4")


def library_ids(path: str, special: bool = True) -> LibraryIds:
    """One encoder for each worker process, whose tables serve task after task."""
    held = library_ids.__dict__.setdefault("held", {})
    if (path, special) not in held:
        held[path, special] = LibraryIds(path, special)
    return held[path, special]
