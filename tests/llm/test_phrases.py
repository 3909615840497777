"""Phrase mining against a brute-force count of every phrase of a small corpus."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rarebird.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, min_count=30, max_words=4, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        covered = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                   if j - i < len(p) and 100 * a >= cover * count[p[i:j]]}
        rows = []
        for p, a in cands.items():
            if p not in covered:
                score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(seed, docs, vocabulary=12):
    rng = random.Random(seed)
    words = [*"abcdefghijklmnop"[:vocabulary], "Émile", "naïve", "日本", "l'eau"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ?!", "\r\n", "\x0b", "\x1c"]
    out = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(docs)]
    return out + [("en", None), (None, ""), ("de", " .,; \n"), ("en", "New York City hall " * 40), ("en", "new YORK city. " * 35), ("es", "solo")]


@pytest.mark.parametrize("min_count, block", [(30, 8 << 20), (3, 200), (2, 1)])
def test_phrases_equal_brute_force(spark, min_count, block):
    rows = corpus(min_count, 150)
    docs = spark.createDataFrame([(None if i % 7 == 0 else i % 5, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)],
                                 "doc_id int, lang string, text string, phrase string, n int").repartition(5)
    got = [tuple(r) for r in phrases.top_phrases(docs, min_count=min_count, block_bytes=block).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == brute(rows, min_count)


def test_top_and_cover(spark):
    rows = corpus(9, 120, 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top, cover, words in ((5, 50, 3), (3, 100, 2)):
        got = [tuple(r) for r in phrases.top_phrases(docs, top=top, cover=cover, min_count=4, max_words=words)
               .select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert sorted(got) == brute(rows, 4, words, cover, top)


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.top_phrases(none).count() == 0
    assert phrases.phrases(spark.createDataFrame([(None, None), ("en", "...")], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3 * 10**15
    table = spark.createDataFrame([("en", 1, "x y", "y", a, [a + 7, a], [a, a + 4])], "lang string, id long, phrase string, last string, f long, heads array<long>, tails array<long>")
    row = phrases._uncovered(table, None, 80, None, 2).first()
    assert row.score == 2_000_000 * a // (2 * a + 11) and (row.l, row.r) == (a + 7, a + 4)
