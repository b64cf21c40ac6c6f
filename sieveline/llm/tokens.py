"""Subword ids of texts by a public byte-level tokenizer, through a bounded cache of chunks.

A text is cut before every run of spaces and newlines that follows another character; the
tokenizer's own pre-tokenization never crosses such a place, so chunks are tokenized alone
and remembered. Texts with other white space or with letters beyond Latin Extended-A are given whole to the
reference tokenizer instead.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cached_property

import numpy as np

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than space and newline, or a code point for which two libraries' tables of letters could differ.
ODD = re.compile(r"[^ -~\n\xa1-ſ]")
SPECIAL = "<|endoftext|>"


class Bounded(dict):
    """A memory of texts and what was made of them, emptied when what it holds comes to `most` bytes, about."""

    #: What an entry takes besides its text and its value.
    ENTRY = 200

    def __init__(self, most: int = 48 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def keep(self, key, value, size: int):
        """Remember value, which takes about `size` bytes beside the key, and return it."""
        size += len(key) + self.ENTRY
        if size > self.most >> 4:
            return value
        if self.held + size > self.most:
            self.forget()
        self.held += size
        self[key] = value
        return value


class Ids(Bounded):
    """chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        super().__init__(32 << 20)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        #: For each id, whether its bytes begin with a space.
        self.spaced = np.zeros(1 + max(ranks.values()), bool)
        self.spaced[[n for b, n in ranks.items() if b[:1] == b" "]] = True
        core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        if buffer := getattr(core, "encode_to_tiktoken_buffer", None):
            self.quick = lambda t, special: bytes(buffer(t, special))
        else:
            self.quick = lambda t, _: np.array(core.encode_ordinary(t), "<u4").tobytes()

    @cached_property
    def exact(self):
        """The reference tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.quick(chunk, set())
        return self.keep(chunk, ids, len(ids))

    def of(self, text: str) -> bytes:
        if ODD.search(text) or SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


_made: dict[tuple, Ids] = {}


def paths() -> tuple[str, str, str]:
    """Default parameter of the operators: (tokenizer file, its ranks, its pre-tokenization pattern)."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def ids_of(where: tuple[str, str, str]) -> Ids:
    """The tokenizer of this worker."""
    if where not in _made:
        _made[where] = Ids(*where)
    return _made[where]
