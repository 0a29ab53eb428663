"""Byte-level BPE of whole texts through a cache of space-delimited pieces.

A text is cut before every single space that a non-space follows. The pattern of the vocabulary always starts a
match there, and no match reaches over such a place, so the ids of the pieces, one after another, are the ids of the
text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import tiktoken

#: A worker forgets its pieces beyond this number, and keeps none longer than this, which bounds its memory.
CACHE_PIECES, CACHE_CHARS = 300_000, 64
_CUT = re.compile(r"(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The rank file as an encoding; each worker reads it once, as the file is a part of the installed environment."""
    import public_tokenizers

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the tokenizer file (.json) beside the rank file, which the library finds in texts as well."""
    found = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that stand for themselves are known")
    return {t["content"]: t["id"] for t in found}


def pieces(text: str) -> list[str]:
    """text cut before single spaces that a non-space follows."""
    parts = text.split(" ")
    for p in parts:
        if not p or p[0].isspace():  # white space in runs
            return [p for p in _CUT.split(text) if p]
    return [parts[0], *[" " + p for p in parts[1:]]]


class _Cache(dict):
    def __init__(self, enc: tiktoken.Encoding, dtype: str):
        super().__init__()
        self.encode, self.dtype = enc.encode_ordinary, dtype

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.encode(piece), self.dtype).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=8)
def cache(path: str, dtype: str) -> _Cache:
    return _Cache(encoding(path), dtype)


def encode_bytes(text: str | None, known: _Cache) -> bytes:
    """The ids of a text as flat bytes of the cache's dtype."""
    return b"".join(map(known.__getitem__, pieces(text))) if text else b""


def encode_with_added(text: str | None, known: _Cache, added: dict[str, int]) -> bytes:
    """As encode_bytes, but a text is split at the added tokens first, which have their own ids."""
    if not text or not any(t in text for t in added):
        return encode_bytes(text, known)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return b"".join(np.array([added[p]], known.dtype).tobytes() if i % 2 else encode_bytes(p, known) for i, p in enumerate(parts))
