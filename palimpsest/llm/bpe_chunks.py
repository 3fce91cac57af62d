"""Exact byte-level BPE of whole texts, each distinct space-led word encoded once per worker.

The vocabulary's splitting pattern lets a token hold a space only as its first character or within a run of white
space. So no token crosses a space that stands between two characters that aren't white space, and the ids of a text
are those of its words cut before such spaces. A text with any other white space beside a space is encoded whole.
Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import os
import struct

import numpy as np

#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64

_state: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """The tokenizers library's tokenizer."""
    if ("tokenizer", path) not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _state["tokenizer", path] = t
    return _state["tokenizer", path]


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters are their own bytes, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str):
    """The same vocabulary in the faster library, whose ranks are the ids; the tests hold it against tokenizer()."""
    if ("encoder", path) not in _state:
        import public_tokenizers
        import tiktoken

        of = byte_alphabet()
        special = {t.content for t in tokenizer(path).get_added_tokens_decoder().values()}
        ranks = {bytes(map(of.__getitem__, piece)): i for piece, i in tokenizer(path).get_vocab().items() if piece not in special}
        _state["encoder", path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _state["encoder", path]


def whole(path: str, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    ids = encoder(path).encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of a word with a space before it; None if a text can't be cut before it or after it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __missing__(self, word: str) -> bytes | None:
        ids = None if not word or word[0].isspace() or word[-1].isspace() else whole(self.path, " " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def encode(path: str, text: str) -> bytes:
    """The text's ids, as whole() gives them."""
    known = _state.setdefault(("words", path), _Words(path))
    first, *words = text.split(" ")
    ids = [whole(path, first), *map(known.__getitem__, words)]
    if None in ids or (words and first and first[-1].isspace()):
        return whole(path, text)
    return b"".join(ids)


def token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id stands for."""
    if ("bytes", path) not in _state:
        enc = encoder(path)
        _state["bytes", path] = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab - 1)], np.int64)
    return _state["bytes", path]
