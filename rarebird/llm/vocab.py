"""Vocabulary files of the ``tokenizers`` library; the path is always a parameter."""

from __future__ import annotations

import functools
import json
import os

import numpy as np


def public_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def specials(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(a["content"] for a in json.load(f)["added_tokens"])


@functools.cache
def library(path: str):
    """The library's tokenizer, once per Python worker and on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Cache:
    """Numbers of the words met so far and a value for each; emptied before it outgrows
    ``bound`` words, or words of ``MOST`` bytes in all. It belongs to one task's iterator
    and ends with it."""

    MOST = 16 << 20

    def __init__(self, bound: int = 300_000) -> None:
        self.bound, self.era = bound, 0
        self.clear()

    def clear(self) -> None:
        self.era += 1  # numbers of an earlier era mean nothing now
        self.index: dict[str, int] = {}
        self.values: list = []
        self.size = 0

    def numbers(self, words: list[str], compute) -> np.ndarray:
        """The words' numbers, which are places in ``values``; ``compute`` gives the values of
        a list of words not seen yet. Numbers hold until the next call."""
        missing = set(words).difference(self.index)
        if len(self.index) + len(missing) > self.bound or self.size > self.MOST:
            self.clear()
            missing = set(words)
        if missing:
            new = list(missing)
            self.index.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
            self.values.extend(compute(new))
            self.size += sum(map(len, new))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
