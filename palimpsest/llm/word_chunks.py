"""Word-end BPE of whole texts, each distinct run of letters, digit or run of other characters encoded once per worker.

The vocabulary lower-cases a text and cuts it into such runs, each of which it encodes by itself; the ids of a text are those of its runs
in order. Texts of plain and of common accented Latin letters (PLAIN: no character of these is changed by composition, and each is
lower-cased by itself) are cut here by the same rule, and their runs go to the library's model without its normalisation; in others, each blank-separated word with other characters is
left whole to the tokenizers library, which gives all ids. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import re
import struct

from . import bpe_chunks

#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
WORD = re.compile("[^\x20\x09-\x0d]+")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
PLAIN = re.compile(f"[\x00-\x7f{_LATIN}]*")
#: The vocabulary's rule for what is encoded by itself, for lower-cased plain texts.
RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\x20\x09-\x0d0-9{_LATIN}]+")

_words: dict[str, tuple[_Runs, _Words]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def whole(path: str, text: str) -> bytes:
    """The library's ids of the text, as little-endian unsigned 32-bit integers."""
    ids = bpe_chunks.tokenizer(path).encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of a word, by the whole of the library's tokenizer."""

    def __init__(self, path: str) -> None:
        self.path = path

    def ids(self, word: str) -> bytes:
        return whole(self.path, word)

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class _Runs(_Words):
    """Ids of a lower-cased run, by the library's model alone; that sees a character of the byte-level alphabet for each byte."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.model = bpe_chunks.tokenizer(path).model
        self.letters = {b: c for c, b in bpe_chunks.byte_alphabet().items()}

    def ids(self, word: str) -> bytes:
        seen = word if word.isascii() and word.isalnum() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(seen)]
        return struct.pack(f"<{len(ids)}I", *ids)


def encode(path: str, text: str) -> bytes:
    """The text's ids, as whole() gives them."""
    if path not in _words:
        _words[path] = _Runs(path), _Words(path)
    runs, words = _words[path]
    if PLAIN.fullmatch(text):
        return b"".join(map(runs.__getitem__, RUN.findall(text.lower())))
    return b"".join(words[w] if not PLAIN.fullmatch(w) else b"".join(map(runs.__getitem__, RUN.findall(w.lower()))) for w in WORD.findall(text))
