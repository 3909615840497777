"""The training-data operators on small tables with nulls, empty and long texts, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarebird.llm import (components, decontamination, language_id, license_scan, ngram_join, nn_descent, sharding,
                          token_counts, token_files, warc_derivatives, word_bpe)
from rarebird.llm.vocab import library, public_path
from rarebird.session import scratch_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "a", "It's 3 o'clock, we'll 'stop' <|endoftext|> x", "<|ENDOFTEXT|> <|startoftext|>ΣΑΣ é é ½", "word " * 3000,
       "x" * 5000, "same text here", "same text here", "日本語 テスト", "   two  spaces\r\n"]
SCHEMA = "doc_id long, text string, lang string, n long, word string, id string, score string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 7, "w", "x", "s", "y") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None, None), (3, "same id", "fr", 1, "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def texts(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


def test_token_counts(odd, empty):
    tok = library(BYTE)
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(odd)]
    for hot in (50_000, 0, 3):
        got = rows_of(token_counts.token_counts(odd, BYTE, hot_words=hot), "doc_id", "n_bytes", "n_tokens")
        assert got == sorted(want, key=repr)
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_word_bpe(odd, empty):
    tok = library(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in texts(odd)]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids]
    assert rows_of(word_bpe.round_trip(odd, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    coded = word_bpe.encode(odd, WORD)
    assert rows_of(coded, "doc_id", "ids") == sorted(ids, key=repr)
    assert rows_of(word_bpe.decode(coded, WORD), "doc_id", "decoded") == sorted([(i, tok.decode(x, skip_special_tokens=False)) for i, x in ids], key=repr)
    assert word_bpe.round_trip(empty, WORD).count() == 0


def test_token_file_round_trip(spark, odd, empty):
    tok = library(BYTE)
    file = token_files.write_token_file(odd, BYTE, scratch_path(spark, "t"), block=16)
    got = token_files.read_token_file(spark, file).collect()
    want = sorted([tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t in texts(odd)])
    assert sorted([np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got]) == want
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    digests = {(r.start, r.ids_crc32) for r in token_files.read_token_file(spark, file, digest=True).collect()}
    assert digests == {(r.start, zlib.crc32(bytes(r.ids))) for r in got}
    file = token_files.write_token_file(empty, BYTE, scratch_path(spark, "t"))
    assert token_files.read_token_file(spark, file).count() == 0


def test_code_lengths_are_optimal_under_the_limit():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 16), (2, 16), (300, 9), (1000, 16), (40, 6)):
        counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
        length = token_files.code_lengths(counts, limit)
        assert length.max() <= limit and (n == 1 or (0.5 ** length).sum() == 1)
        ids = rng.choice(n, 2000)
        docs = np.array([0, 700, 1, 1299])
        code = token_files.canonical(length, limit)
        payload, at, checks, blocks = token_files.pack(ids, docs, code, 64)
        each = np.concatenate([np.append(np.full(b - 1, 64), d - 64 * (b - 1)) if b else np.zeros(0, int) for b, d in zip(blocks, docs)])
        out, _ = token_files.unpack(np.frombuffer(payload, np.uint8), checks + np.repeat(8 * at[:-1], blocks), each.astype(np.int64), code)
        assert out.tolist() == ids.tolist()


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, empty):
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16)
    many = spark.range(3000).withColumnRenamed("id", "doc_id")
    for n in (1, 8, 200):
        got = sharding.assign_shards(many, "doc_id", n).collect()
        assert all(r.shard == jump(key(r.doc_id), n) for r in got)
    plan = sharding.shard_plan(odd, 4).collect()
    assert len(plan) == len(ODD) + 2 and all(r.grown_shard in (r.shard, 4) for r in plan)
    for s in range(4):
        slots = sorted(r.slot for r in plan if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.size for r in plan if r.doc_id == 0} == {1}
    assert sharding.shard_plan(empty, 4).count() == 0


def brute_components(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_ngram_join_equals_brute_force(spark, odd, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = list(ODD)
    for _ in range(12):  # families around a base, with different shares of changed words
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(25):
            docs.append(" ".join(rng.choice(vocabulary) if rng.random() < rng.choice((0, 0.01, 0.03, 0.05)) else w for w in base))
    rng.shuffle(docs)
    sets = [shingles(t) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    top = brute_components(links, range(len(docs)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(df).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), top[i]) for i, s in enumerate(sets)}
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD) + 2 and {r.component_id for r in got if r.doc_id is None} == {None}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2000, 2200)]
    df = spark.createDataFrame(pairs + [(None, 1)], "a long, b long")
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert {(r.id, r.component) for r in components.components(df, "a", "b").collect()} == set(brute_components(pairs, {x for p in pairs for x in p}).items()) & {(i, c) for i in ids for c in ids}


def test_nn_descent_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = [b + 0.05 * rng.standard_normal(16) for b in base[:40] for _ in range(3)] + list(rng.standard_normal((300, 16)))
    x += [base[0] + 0.03 * rng.standard_normal(16) for _ in range(150)] + [x[5]] * 4
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [], 0), (None, rows[0][1], 0), (7, rows[9][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links long")
    u = np.array([np.array(r[1], float) for r in rows[:n]] + [np.array(rows[9][1], float)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(n), 7]
    top = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], [*range(n)])
    got = nn_descent.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < n} == {
        (i, int(k), top[i]) for i, k in zip(ids, near.sum(1))}
    assert all((r.n_links, r.kept) == (0, True) for r in got if r.vec_id is not None and r.vec_id >= n)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_nn_descent_joins_groups_whose_lists_are_full(spark):
    rng = np.random.default_rng(8)
    e = np.eye(16)
    at = lambda a, b, cos: cos * e[a] + np.sqrt(1 - cos * cos) * e[b]
    # two groups of more than GROWN, each vector's nearest in its own; one chain of them; one group apart
    x = [c + 0.002 * rng.standard_normal(16) for c in (e[0], at(0, 1, 0.9503), e[5]) for _ in range(120)]
    x += list(rng.standard_normal((200, 16)))
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    top = brute_components(list(zip(*np.nonzero(near))), range(len(x)))
    assert top[0] == top[130] != top[250]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nn_descent.near_duplicates(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, int(k), top[i]) for i, k in enumerate(near.sum(1))}


def nn_vectors(spark, x):
    return spark.createDataFrame([(i, 1, np.asarray(v, float).tobytes()) for i, v in enumerate(x)], "id long, copies long, vec binary")


def test_nn_descent_meets_all_components(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 8))
    x = np.repeat(base, 2, 0) + 0.02 * rng.standard_normal((400, 8))
    none = spark.createDataFrame([], "id long, component long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.95)) if a != b]
    want = brute_components(pairs, range(400))
    met = nn_descent._all_met(nn_vectors(spark, x), none, 8, 0.95).collect()
    assert brute_components([(r.a, r.b) for r in met], range(400)) == want


def test_nn_descent_audit_sees_lost_pairs(spark):
    rng = np.random.default_rng(10)
    x = [np.eye(32)[0] + 0.01 * rng.standard_normal(32) for _ in range(300)]
    x += [v + 0.01 * rng.standard_normal(32) for v in rng.standard_normal((30, 32)) for _ in range(2)]
    counted = spark.createDataFrame([(i, 0, 299) for i in range(300)], "id long, component long, links long")  # no pair found
    assert nn_descent.audit(nn_vectors(spark, x), counted, 32, 0.95) < 0.1


def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(5000)}"
    items = [" ".join(word() for _ in range(k)) for k in (15, 30, 30, 59, 3)]
    docs = [" ".join(word() for _ in range(200)) for _ in range(40)]
    planted = {}
    for d, item in ((2, 0), (5, 1), (9, 3), (11, 4), (13, 2)):
        w = docs[d].split()
        piece = items[item].split()
        if item == 3:
            piece[20] = "changed"  # 5 of 55 n-grams differ: 50 / 60
        docs[d] = " ".join(w[:90] + piece + w[90:]).upper()
        planted[d] = item
    half = items[3].split()[:30]
    docs[20] = " ".join(half) + " " + docs[20]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " ")], "item_id long, text string")
    df = spark.createDataFrame([*enumerate(docs), (100, None), (101, "")], "doc_id long, text string")
    got = decontamination.contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(planted.items())
    assert decontamination.contamination(odd, bench).count() == 0
    assert decontamination.contamination(empty, bench).count() == decontamination.contamination(df, bench.limit(0)).count() == 0


def found_in(text, items):
    indexes, known = decontamination.build(list(enumerate(items)), decontamination.RADIUS)
    words, _ = ngram_join.word_hashes([text.encode()])
    return {(item, n): shared / total for item, _, n, shared, total in decontamination.matches_of(words, indexes, known)}


def test_decontamination_of_documents_shorter_than_the_item():
    rng = random.Random(14)
    for k in (15, 30, 59):
        item = [f"s{rng.randrange(5000)}" for _ in range(k)]
        for words in (item[1:], item[:-1], item[1:-1]):
            m = len(words) - 4
            assert found_in(" ".join(words), [" ".join(item)]) == {(0, len(words)): m / (k - 4)}
        assert found_in(" ".join(item[k // 2:]), [" ".join(item)]) == {}
    assert found_in("a b c", ["a b c d e f"]) == {}


def test_decontamination_finds_windows_with_runs():
    rng = random.Random(15)
    word = lambda: f"r{rng.randrange(5000)}"
    items = [[word() for _ in range(200)] for _ in range(10)]
    for i, item in enumerate(items):  # 24 words become one run: 168 of 224
        doc = [word() for _ in range(50)] + item[:80] + ["-"] * 24 + item[104:] + [word() for _ in range(50)]
        assert found_in(" ".join(doc), [" ".join(x) for x in items]) == {(i, 200): 0.75}
    run = ["x"] * 40 + items[0][:20]
    assert found_in(" ".join(run), [" ".join(run)]) == {(0, 60): 1.0}


def test_hamming_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(6)
    grams = [rng.integers(0, 2**63, 26, dtype=np.uint64) for _ in range(50)]
    index = decontamination.Index(30, list(range(50)), grams, 23)
    prints = index.prints[rng.integers(0, 50, 400)] ^ (rng.integers(0, 2**63, 400, dtype=np.uint64) & rng.integers(0, 2**63, 400, dtype=np.uint64))
    want = {(w, i) for w in range(400) for i in range(50) if int(prints[w] ^ index.prints[i]).bit_count() <= 23}
    assert set(zip(*map(np.ndarray.tolist, index.near(prints)))) == want


def test_language_id(spark, odd, empty):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.fit(docs, train_rows=400, landmarks=100)
    got = language_id.predict(docs, model).where(language_id.held_out("doc_id")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    by = {(r.doc_id, r.text): r for r in language_id.predict(odd, model).collect()}
    assert len(by) == len(ODD) + 2
    for t in (None, "", " \n\t "):
        assert by[(ODD.index(t), t)].lang_pred == "und" and by[(ODD.index(t), t)].score == 0
    assert all(0 <= r.score <= 1 for r in by.values())
    nothing = language_id.fit(empty)
    assert language_id.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_license_scan(spark, odd, empty):
    lines = {0: "Released under the MIT License.", 1: "Licensed under CC BY-NC 4.0.", 2: "This license plate was granted permission.",
             3: "licensed under the apache license, version 2.0", 4: "She lost her driving license."}
    docs = spark.createDataFrame([(i, f"Some first line.\n{t}\nand more") for i, t in lines.items()] + [(9, None)], "doc_id long, text string")
    scanner = license_scan.train(docs)
    assert rows_of(license_scan.scan(docs, scanner), "doc_id", "paragraph", "family") == [(0, 1, "MIT"), (1, 1, "CC-BY-NC"), (3, 1, "Apache-2.0")]
    assert license_scan.scan(odd, scanner).count() == license_scan.scan(empty, scanner).count() == 0
    for notice in sum(license_scan.NOTICES.values(), []):  # three quarters of a notice's word pairs hold a mark, or it is not scored
        assert any(m in notice.lower() for m in license_scan.MARKS)


def test_license_marks_lose_nothing(spark):
    for notice in sum(license_scan.NOTICES.values(), []):
        words = license_scan._split(notice)
        assert len(words) <= license_scan.LONGEST and license_scan.unmarked(words) < license_scan.MIN_SHARED
    lines = ["Available under CC BY 4.0.", "Shared under CC BY-NC 4.0", "Released under CC0 1.0 Universal", "Released under the MIT terms"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.id for r in license_scan.paragraphs(docs).collect()}
    assert got == set(range(len(lines)))


def test_license_scan_finds_wrapped_notices(spark):
    texts = {"MIT": """
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction""", "ISC": """
 * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that""", "GPL-3.0": """
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""", "Apache-2.0": """
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at"""}
    plain = [(100 + i, f"Line {i} of a story.\nThe general gave permission to use the copyright of {i} files.") for i in range(60)]
    docs = spark.createDataFrame([*[(i, f"Some first line.\n{t}\n\nmore words") for i, t in enumerate(texts.values())], *plain], "doc_id long, text string")
    got = license_scan.scan(docs, license_scan.train(docs)).collect()
    first = {"MIT": 2, "ISC": 2, "GPL-3.0": 3, "Apache-2.0": 2}
    assert sorted((r.doc_id, r.family, r.paragraph) for r in got) == sorted((i, f, first[f]) for i, f in enumerate(texts))


def test_warc(spark):
    pages = [(1, "http://a/?x=1", "<html lang=en><head><title>T &amp; t</title><script>var a='</p>'</script></head><body><p>One</p><p>two <b>three</b> &lt;x&gt;</p></body>"),
             (2, None, None), (3, "http://b", ""), (3, "http://b", ""), (4, "http://c", "plain\r\n\r\nWARC/1.1\r\nx" + "y" * 20000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    made = warc_derivatives.derivatives(warc_derivatives.responses(df))
    path = scratch_path(spark, "w")
    warc_derivatives.write_warc(made, path)
    back = warc_derivatives.read_warc(spark, path).collect()
    assert len(back) == 2 * len(pages)
    assert rows_of(made, "type", "record_id", "refers_to") == sorted([(r.type, r.record_id, r.refers_to) for r in back], key=repr)
    one = {r.type: r for r in back if r.uri == "http://a/?x=1"}
    assert one["conversion"].block.decode() == "One\ntwo three <x>"
    about = one["metadata"].block.decode()
    assert one["conversion"].refers_to == one["metadata"].refers_to and f"conversion: {one['conversion'].record_id}" in about
    assert "title: T & t" in about and one["conversion"].headers["X-Source-Content-Type"] == "text/html; charset=utf-8"
    empty = warc_derivatives.derivatives(warc_derivatives.responses(df.limit(0)))
    assert empty.count() == 0


def test_warc_records_end_anywhere(spark):
    """Ends at every offset around 64 kB, blocks that hold boundaries, equal rows, null ids, clashing columns."""
    head = len(warc_derivatives.make_record("conversion", "r", "s", "u", "d", [], "text/plain", b"x" * 65000).encode()) - 65000
    for ends in (b"\r\n", b"\r\n\r\n", b"\r\n\r\nWARC/1.1\r\n", b""):
        sizes = range(65536 - head - len(ends) - 12, 65536 - head - len(ends) + 12)
        blocks = [b"x" * n + ends for n in sizes]
        records = spark.createDataFrame([(warc_derivatives.make_record("conversion", f"r{i}", "s", "u", "d", [], "text/plain", b),) for i, b in enumerate(blocks)], "record string")
        for limit in (1, 200_000):
            path = scratch_path(spark, "w")
            warc_derivatives.write_warc(records.coalesce(2), path, limit)
            got = warc_derivatives.read_warc(spark, path).collect()
            assert sorted(bytes(r.block) for r in got) == sorted(blocks)
    rows = [(None, None, None, "a"), (None, None, None, "a"), (1, "u", "<p>x</p>", "b"), (1, "u", "<p>x</p>", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    made = warc_derivatives.derivatives(warc_derivatives.responses(pages))
    assert made.select("record_id").distinct().count() == 8
    path = scratch_path(spark, "w")
    warc_derivatives.write_warc(made, path)
    assert warc_derivatives.read_warc(spark, path).count() == 8
    with pytest.raises(ValueError, match="byte 0"):
        list(warc_derivatives.records_of(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_warc_head_without_its_closing_tag():
    text = warc_derivatives.plain_text
    assert text("<html><head><title>x</title><body><p>hello</p></body></html>") == "hello"
    assert text("<head><meta charset=utf-8><script>'<body>'</script><!-- <p> --><title>x</title>\n<p>one<header>two</header>") == "one\ntwo"
    assert text("<head><title>x</title>bare text") == "bare text"
    assert text("<HEAD><style>p {}</style><link rel=x><TITLE>x</TITLE></HEAD><body>a<script>b") == "a"


def test_pipeline_stages(spark, odd):
    import corpus_pipeline
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120).cache()
    kept = corpus_pipeline.language_stage(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    left = corpus_pipeline.dedup_stage(spark, odd, SF_SMALL).collect()
    # the row "same id" shares the id of another document and is one of its own
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted([*[(False, i) for i in range(len(ODD)) if i != 9], (False, 3), (True, 0)])
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF_SMALL)
    assert clean.columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "bpe_round_trip"


def test_word_hashes_in_bounded_memory(monkeypatch):
    """The words of a chunk of texts are hashed some at a time: the same hashes, with small buffers."""
    import tracemalloc

    from rarebird.llm import ngram_join as nj

    texts = [b"", *(b"Word%d other  words\t%d " % (i, i % 7) * (i % 300) for i in range(1200)), b"  "]
    assert sum(map(len, texts)) > 3 << 20
    tracemalloc.start()
    words, counts = nj.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    monkeypatch.setattr(nj, "HASH_BYTES", 1 << 40)
    for got, whole in zip((words, counts), nj.word_hashes(texts), strict=True):
        assert got.dtype == whole.dtype and np.array_equal(got, whole)
    assert [len(x) for x in nj.word_hashes([])] == [0, 0]


def test_ngram_join_ships_compressed_texts(spark):
    """What travels for the verification is less than half of the sets (8 bytes an n-gram), and pairs are
    verified on whole sets, also where ids have several rows."""
    from rarebird.llm import ngram_join as nj

    rng = random.Random(11)
    base = [rng.choice([f"word{i}" for i in range(500)]) for _ in range(400)]
    texts = [" ".join(w if rng.random() > share else f"other{rng.randrange(500)}" for w in base) for share in (0, 0.005, 0.01, 0.03, 0.06, 0.3)]
    texts += ["", None, "a b", "A  b"]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    far = [(1000 + i, t) for i, t in enumerate(["x"] * 50)]

    def similar(x, y):
        return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)

    def links(rows):
        df = spark.createDataFrame(rows, "id long, text string")
        sets = df.select("id")
        got = nj._tried_links(df, sets, spark.createDataFrame(pairs, "a long, b long")).collect()
        by = {i: [shingles(t) for k, t in rows if k == i] for i in range(len(texts))}
        want = {(a, b) for a, b in pairs if any(similar(x, y) for x in by[a] for y in by[b])}
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        return len(want)

    rows = [*enumerate(texts), (None, texts[0]), *far]
    assert 0 < links(rows) < links([*rows, (5, texts[0]), (5, ""), (0, None), (8, texts[1])])

    df = spark.createDataFrame([*enumerate(texts), *far], "id long, text string")
    kept = nj._kept(df, spark.createDataFrame([(i,) for i in range(6)], "id long")).collect()
    assert {r.id for r in kept} == set(range(6))
    assert 2 * sum(len(r.packed) for r in kept) < 8 * sum(len(shingles(t)) for t in texts[:6])
