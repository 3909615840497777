"""Cut texts into pre-tokens with numpy, as the public tokenizers' split patterns do.

Two patterns, both written over the Unicode classes letter, number, white space, other:

* ``byte``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
  (pre-tokens tile the text);
* ``word``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` (white space is dropped).

Runs of one class are found for a whole chunk of texts at once; contractions and the
space that a run takes along are fixed up on the runs. A special string inside a text is
one pre-token of its own and splits the text, as in the tokenizers library.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000)
#: The suffixes of the patterns' contractions.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    first = {"L": LETTER, "N": NUMBER}
    table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[list(WHITE_SPACE)] = SPACE
    return table


def codepoints(text: str) -> np.ndarray:
    """As bytes where all are below 256, else as 32-bit integers."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _marked(texts: list[str], pattern: str, specials: tuple[str, ...]) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The texts as the pattern sees them (folded for ``word``) and (text, start, end) of
    every special string. Specials are looked for in the texts as given: folding a text
    does not make new ones."""
    prepare = fold if pattern == "word" else str
    out, marks = [], []
    found = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
    for i, t in enumerate(texts):
        if not any(x in t for x in specials):
            out.append(prepare(t))
            continue
        parts = found.split(t)
        parts[::2] = map(prepare, parts[::2])
        at = 0
        for j, p in enumerate(parts):
            if j % 2:
                marks.append((i, at, at + len(p)))
            at += len(p)
        out.append("".join(parts))
    return out, marks


def cut(texts: list[str], pattern: str, specials: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray]:
    """(pre-tokens of all texts in order, their number in each text)."""
    joined, at, to, counts = _spans(texts, pattern, specials)
    return list(map(joined.__getitem__, map(slice, at.tolist(), to.tolist()))), counts


def dictionary(texts: list[str], specials: tuple[str, ...] = ()) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct ``byte`` pre-tokens in UTF-8, the number of each pre-token's distinct one, pre-tokens of
    each text). These pre-tokens tile the texts, so their ends are the offsets of one Arrow
    string array, which Arrow encodes as a dictionary; only distinct ones become Python objects."""
    joined, at, to, counts = _spans(texts, "byte", specials)
    if not len(at):
        return [], np.zeros(0, np.int64), counts
    data = joined.encode("utf-8", "surrogatepass")
    ends = np.append(at, to[-1])
    if len(data) != len(joined):
        cp = codepoints(joined)  # UTF-8 has one byte more from each of these on
        ends = ends + sum(np.searchsorted(np.flatnonzero(cp >= c), ends) for c in (0x80, 0x800, 0x10000) if cp.dtype != np.uint8 or c < 256)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    encoded = words.dictionary_encode()
    return encoded.dictionary.to_pylist(), np.asarray(encoded.indices, np.int64), counts


def _spans(texts: list[str], pattern: str, specials: tuple[str, ...] = ()) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts as one string, start and end of each pre-token in it, pre-tokens of each text)."""
    texts, places = _marked(texts, pattern, specials)
    joined = "".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens) - lens
    n = len(joined)
    if not n:
        none = np.zeros(0, np.int64)
        return "", none, none, np.zeros(len(texts), np.int64)
    cp = codepoints(joined)
    cls = _classes()[cp]
    fresh = np.zeros(n + 1, bool)  # where a new text, or a new part of a text, begins
    fresh[starts] = True
    marks = [(int(starts[i]) + a, int(starts[i]) + b) for i, a, b in places]
    for a, b in marks:
        fresh[a] = fresh[b] = True
    edge = np.ones(n, bool)
    edge[1:] = (cls[1:] != cls[:-1]) | fresh[1:n]
    s = np.flatnonzero(edge)
    e = np.append(s[1:], n)
    k = cls[s]
    begins = fresh[s]                      # the run opens its part
    closes = fresh[e] | (e == n)           # the run ends its part
    after_space = np.zeros(len(s), bool)   # the run takes the space before it along
    if pattern == "byte":
        after_space[1:] = (k[1:] != SPACE) & (k[:-1] == SPACE) & ~begins[1:] & (cp[s[1:] - 1] == 32)
    # contractions: a lone apostrophe that no space precedes, then letters that begin with a suffix
    cut_letters = np.zeros(len(s), np.int64)  # letters of a run that belong to the apostrophe before it
    lone = np.flatnonzero((k[:-1] == OTHER) & (e[:-1] - s[:-1] == 1) & (cp[s[:-1]] == 39) & ~after_space[:-1]
                          & (k[1:] == LETTER) & ~begins[1:])
    for r in lone.tolist():
        a, b = int(s[r + 1]), int(e[r + 1])
        for x in SUFFIXES:
            if joined.startswith(x, a, b):
                cut_letters[r + 1] = len(x)
                break
    flag = np.zeros(n + 1, bool)
    solid = k != SPACE
    if pattern == "byte":
        flag[(s - after_space)[solid & (cut_letters == 0)]] = True
        more = cut_letters > 0
        flag[(s + cut_letters)[more & (s + cut_letters < e)]] = True
        blank = ~solid
        inner = blank & ~closes
        last_plain = np.zeros(len(s), bool)
        last_plain[inner] = cp[e[inner] - 1] == 32
        flag[s[blank & closes]] = True
        flag[s[inner & ((e - s > 1) | ~last_plain)]] = True
        flag[(e - 1)[inner & (e - s > 1) & ~last_plain]] = True
        flag[n] = False
        for a, b in marks:
            flag[a + 1:b] = False
            flag[a] = True
        at = np.flatnonzero(flag)
        to = np.append(at[1:], n)
    else:
        # ends are kept apart as white space lies between pre-tokens
        take = solid & ~((cut_letters > 0) & (s + cut_letters >= e)) & (k != NUMBER)
        grown = np.append(cut_letters[1:], 0) * (k == OTHER)
        at, to = (s + cut_letters)[take], (e + grown)[take]
        digits = np.flatnonzero(cls == NUMBER)
        at, to = np.concatenate([at, digits]), np.concatenate([to, digits + 1])
        if marks:
            lo = np.array([m[0] for m in marks])
            hi = np.array([m[1] for m in marks])
            i = np.searchsorted(lo, at, "right") - 1
            free = (i < 0) | (at >= hi[np.maximum(i, 0)])
            at, to = np.concatenate([at[free], lo]), np.concatenate([to[free], hi])
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
    counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return joined, at, to, counts


def fold(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a final sigma)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def numbered(words: list[str]) -> tuple[list[str], np.ndarray]:
    """(distinct words in order of appearance, the number of each word's distinct word)."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return list(ids), np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
