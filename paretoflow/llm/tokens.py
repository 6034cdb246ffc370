"""Token ids of a public byte-level BPE vocabulary.

The rank file of the vocabulary gives the same ids as its ``tokenizers`` file (the tests compare
them) several times faster. :func:`encoder` gives the added tokens of that file, such as
``<|endoftext|>``, their own ids wherever they stand in a text; ``encode_ordinary`` of
:func:`encoding` takes them for ordinary text. Texts with very long runs of white space, on which
the fast pattern matcher gives up, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs of white space from this length on.
LONG_RUN = 10_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the ``tokenizers`` file beside a rank file; none without such a file."""
    described = _described(path)
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _described(path: str) -> str:
    """The ``tokenizers`` file beside a rank file."""
    return os.path.splitext(path)[0] + ".json"


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(_described(path))


def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text as ``tokenizers`` gives them with ``add_special_tokens=False``."""
    known = encoding(path)
    added = known.special_tokens_set

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return tokenizer(path).encode(text, add_special_tokens=False).ids
        # Looking for added tokens while encoding is slower, and few texts hold one.
        if any(t in text for t in added):
            return known.encode(text, allowed_special=added)
        return known.encode_ordinary(text)

    return encode


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
