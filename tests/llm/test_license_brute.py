"""The licence scan against a version that scores every run of lines, without marks and without bounds."""

import random

from pyspark.ml.functions import vector_to_array

from rarebird.llm import license_scan as ls


def brute(spark, docs, scanner):
    """Runs of non-blank lines (or any single line) in plain Python; only the classifier is the operator's."""
    runs = []
    for row, (doc_id, text) in enumerate(docs):
        lines = [ls._split(x) for x in text.split("\n")] if text is not None else []
        for i in range(len(lines)):
            for k in range(1, len(lines) - i + 1):
                part = lines[i:i + k]
                if k > 1 and (not all(part) or sum(map(len, part[1:-1])) >= ls.LONGEST - 1):
                    break
                runs.append((row, doc_id, i, i + k - 1, [w for x in part for w in x]))
    table = spark.createDataFrame(runs, "row int, id long, at int, until int, words array<string>")
    scored = scanner.pipeline.transform(table).select("row", "id", "at", "until", "words", vector_to_array("rawPrediction").alias("z")).collect()
    import math

    kept = {}
    pairs = lambda words: {" ".join(p) for p in zip(words, words[1:], strict=False)}
    for r in scored:
        weights = [math.exp((z - max(r.z)) / scanner.temperature) for z in r.z]
        best = max(range(len(weights)), key=lambda j: (weights[j], -j))
        family, p = scanner.families[best], weights[best] / sum(weights)
        if family == ls.UNKNOWN or p < ls.MIN_PROBABILITY:
            continue
        shared = max(len(pairs(r.words) & pairs(ls._split(n))) / len(pairs(ls._split(n))) for n in ls.NOTICES[family])
        if shared >= ls.MIN_SHARED:
            kept.setdefault((r.row, family), []).append((r.at, r.until, r.id, round(shared, 9)))
    out = []
    for (_, family), found in kept.items():
        shortest = {at: min(u for a, u, *_ in found if a == at) for at, *_ in found}
        for at, until in shortest.items():
            if not any(at < b and u <= until for b, u in shortest.items()):
                out += [(i, at, family, s) for a, u, i, s in found if (a, u) == (at, until)]
    return sorted(out, key=repr)


def test_scan_equals_scoring_every_run(spark):
    rng = random.Random(11)
    notices = [n for ns in ls.NOTICES.values() for n in ns]
    filler = "the permission general story of a license and copyright was granted by public domain foundation mit river gnu version work".split()
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(notices).split()
            kind = rng.random()
            if kind < 0.3:
                words = [rng.choice(filler) for _ in range(rng.randint(0, 8))]
            elif kind < 0.6:  # some words lost or replaced
                words = [w if rng.random() > 0.12 else rng.choice(filler) for w in words]
            cut = rng.randint(1, max(len(words), 1))
            lines += [" ".join(words)] if rng.random() < 0.6 else [" ".join(words[:cut]), "# " + " ".join(words[cut:])]
            if rng.random() < 0.2:
                lines.append("")
        docs.append((i % 50 or None, "\n".join(lines)))
    docs += [(1, None), (2, ""), (3, "\n\n")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    scanner = ls.train(table)
    got = [(r.doc_id, r.paragraph, r.family, round(r.shared, 9)) for r in ls.scan(table, scanner).collect()]
    want = brute(spark, docs, scanner)
    assert len(want) > 30 and sorted(got, key=repr) == want
