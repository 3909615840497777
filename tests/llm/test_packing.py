"""Packing: every id in exactly one piece, gapless sequences, best fit as its definition, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np

from rarebird.llm import packing
from rarebird.llm.vocab import library, public_path

BYTE = public_path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " \n\t ", "It's 3 o'clock <|endoftext|> x", "word " * 5000, "same text here", "same text here", "日本語 テスト é ½", "x" * 3000]


def check(rows, want, window):
    """``want``: the ids of each row of the table (with repeats), as lists."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
        assert 0 < r.length <= window and len(r.ids) == 4 * r.length
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *[r.length for r in parts]]).tolist()
        assert [r.offset for r in parts] == ends[:-1] and ends[-1] <= window
    got = []
    for parts in by_doc.values():  # rows with equal ids and lengths: their pieces cover each start as often
        starts = defaultdict(list)
        for r in parts:
            starts[r.start].append(r)
        for _ in range(len(starts[0])):
            at, ids = 0, []
            while at < parts[0].doc_tokens:
                r = starts[at].pop()
                at += r.length
                ids += np.frombuffer(bytes(r.ids), "<u4").tolist()
            got.append(ids)
        assert not any(starts.values())
    assert sorted(got) == sorted(want)
    return by_seq


def test_pack_holds_every_id_once(spark):
    tok = library(BYTE)
    table = [(i, t, "w", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "", 1), (6, "another row of id 6", "", 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, start string, length int").repartition(3)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in table]
    for window, buffer in ((1024, 1 << 20), (16, 64), (1024, 1), (1, 1)):
        rows = packing.pack(docs, BYTE, window=window, buffer=buffer, slack=0).collect()
        by_seq = check(rows, want, window)
        # a task pads one sequence
        assert sum(sum(r.length for r in s) < window for s in by_seq.values()) <= 3
    made = packing.sequences(packing.pack(docs, BYTE, window=16), 16).collect()
    assert sum(len(r.ids) for r in made) == 4 * sum(map(len, want))
    for r in made:
        assert r.length * 4 == len(r.ids) and r.ends[-1] == r.length
        assert r.padded_length == (r.length if r.length in (1, 2, 4, 8, 16) else 16)
    assert packing.pack(docs.where("false"), BYTE).count() == 0


def test_best_fit_is_its_definition():
    rng = random.Random(3)
    for window in (1, 7, 64, 1024):
        items = [packing.Piece(i, 0, rng.randint(1, window)) for i in range(300)]
        rooms, plain = [], []
        for x in sorted(items, key=lambda x: -x.length):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= x.length]
            if fits:
                i = min(fits)[1]
            else:
                rooms.append(window)
                plain.append([])
                i = len(rooms) - 1
            rooms[i] -= x.length
            plain[i].append(x.length)
        got = packing.best_fit(items, window)
        # of windows with equal room either may be taken, so the windows' rooms agree, not what they hold
        assert sorted(sum(p.length for p in w) for w in got) == sorted(map(sum, plain))


def test_fill_leaves_one_window():
    items = [packing.Piece(i, 0, 700) for i in range(50)]
    done, left = packing.fill(packing.best_fit(items), slack=0)
    assert all(sum(p.length for p in w) == 1024 for w in done)
    assert sum(p.length for w in [*done, left] for p in w) == 50 * 700 and sum(p.length for p in left) < 1024
    done, left = packing.fill([[packing.Piece(0, 0, 1020)], [packing.Piece(1, 0, 5)]], slack=8)
    assert done == [[packing.Piece(0, 0, 1020)]] and left == [packing.Piece(1, 0, 5)]


def test_query_on_whole_table(spark):
    from tests.conftest import SF_SMALL
    from rarebird.llm.queries import QUERIES

    tok = library(BYTE)
    docs = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_best_fit_packing"](spark, SF_SMALL).collect()
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    for r in rows:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(1024 - u for u in used.values()) <= 0.01 * sum(used.values()) + 1024
