"""Token ids of the public byte-level BPE vocabulary, per worker process.

Ids are those of the ``tokenizers`` file.  The ``tiktoken`` file holds the same
vocabulary and gives the same ids about six times faster, so it encodes texts
of plain letters and signs (code points below 0x250 and common punctuation);
all others, and texts that spell a special token, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: Anything but letters and signs whose classes Python's ``re`` and the vocabulary's pattern share.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u024f\u2010-\u201f\u2026\u20ac]|<\\|")
#: The vocabulary's pre-token pattern for plain texts: its letters and numbers in terms of ``re``.
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LOADED: dict[tuple[str, str], tuple] = {}


def default_files() -> tuple[str, str]:
    """Paths of the two files of the vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _load(files: tuple[str, str] | None) -> tuple:
    """Per process: a function that gives the ``tokenizers`` tokenizer, read when first needed, and the
    ``tiktoken`` encoding."""
    files = tuple(files or default_files())
    if files not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact: list = []

        def tokenizer():
            if not exact:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(files[0]))
            return exact[0]

        _LOADED[files] = tokenizer, fast
    return _LOADED[files]


def encoder(files: tuple[str, str] | None = None):
    """A function from a text to its ids (unsigned 32-bit); loaded once per process.

    Its attribute ``counts(text, cuts)`` gives the number of ids between
    consecutive cuts, which must be pre-token bounds."""
    exact, fast = _load(files)

    def encode(text: str) -> np.ndarray:
        if _PLAIN.search(text):
            return np.array(exact().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    def counts(text: str, cuts: list[int]) -> list[int]:
        if _PLAIN.search(text):
            return [len(encode(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        return [len(fast.encode_ordinary(text[a:b])) for a, b in zip(cuts, cuts[1:])]

    encode.counts = counts
    return encode


def splitter(files: tuple[str, str] | None = None):
    """A function from a text to the lengths of its pre-tokens, whose ids don't depend on one another.
    A text that spells a special token counts as one pre-token."""
    exact, _ = _load(files)

    def split(text: str) -> list[int]:
        if not _PLAIN.search(text):
            return [len(x) for x in _PIECE.findall(text)]
        if "<|endoftext|>" in text:
            return [len(text)]
        ends = [b for _, (_, b) in exact().pre_tokenizer.pre_tokenize_str(text)]
        return [b - a for a, b in zip([0, *ends], ends)]

    return split
