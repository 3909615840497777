"""run() against a brute-force pipeline on rows with null and shared ids, copies, passages and odd texts."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest

import corpus_pipeline
from rarebird.llm.vocab import library, public_path

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def holds(text, item):
    doc, own = words(text), words(item)
    size = min(5, len(own))
    if not own or len(doc) < size:
        return False
    grams = [tuple(doc[i:i + size]) for i in range(len(doc) - size + 1)]
    wanted = Counter(tuple(own[i:i + size]) for i in range(len(own) - size + 1))
    m = min(sum(wanted.values()), len(grams))
    return any(100 * sum((c & wanted).values()) >= 75 * sum((c | wanted).values()) for i in range(len(grams) - m + 1) for c in [Counter(grams[i:i + m])])


def brute(rows, items):
    rows = [r for r in rows if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept = {}
    for g, r in zip(group, rows, strict=True):
        if g not in kept or (r[0] is None, r[0] or 0) < (kept[g][0] is None, kept[g][0] or 0):
            kept[g] = r
    tok, sha = library(public_path("word_bpe_49k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for r in kept.values():
        if not any(holds(r[1], item) for _, item in items):
            ids = tok.encode(r[1], add_special_tokens=False).ids
            out.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([20, 33, 59, 6, 3])] + [(None, "no id"), (9, None)]
    rows = [(i, prose(rng.randint(1, 120)), rng.choice(["en", "fr", None]), "s", 1) for i in range(60)]
    for at in range(8):  # near copies and copies, some with null or shared ids
        base = rows[at][1].split()
        rows.append((rng.choice([None, 100 + at, at]), " ".join(base + [rng.choice(vocabulary)]), "en", "s", 1))
        rows.append((rng.choice([None, 200 + at]), rows[at][1].upper(), "fr", "s", 1))
    for i, (_, item) in enumerate(items[:5]):
        rows.append((None if i % 2 else 300 + i, f"{prose(40)} {item} {prose(30)}", "en", "s", 1))
    rows.append((3, f"{prose(10)} {items[1][1]}", "en", "s", 1))  # contaminated, shares its id with a clean row
    rows.append((500, " ".join(items[2][1].split()[:-1]), "en", "s", 1))  # an item cut short is the whole document
    rows += [(600, None, "en", "s", 1), (601, "", "en", "s", 1), (602, "123 !?", "en", "s", 1), (None, "é", "fr", "s", 1), (603, "\n\t", None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = brute(rows, [x for x in items if x[0] is not None and x[1]])
    # of equal keys in a group the first row of the table stays, which Parquet decides; their texts differ in case or a word
    assert len(got) == len(want) and Counter(r[0] for r in got) == Counter(r[0] for r in want)
    unique = {r[0] for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1}
    assert sorted(r for r in got if r[0] in unique) == sorted(r for r in want if r[0] in unique)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("ids", [(None, 5), (5, 5)])
def test_ids_do_not_decide_over_other_rows(spark, tmp_path, ids):
    """A contaminated row goes though its id is null or another row's; the clean one stays."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(ids[0], f"well {item} yes", "en", "s", 1), (ids[1], "a clean text of its own", "en", "s", 1)], SCHEMA)
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in left] == [(ids[1], "a clean text of its own")]
