"""Conversation repair against a search over all edit sequences, and its bounded memory."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rarebird.llm import conversations as cv

PATTERN = re.compile("(s?(ua)+)?")
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        for _ in range({0: 0, 3: 2}.get(way, 1)):
            yield conv, turn, "user" if way == 4 else role, text


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All sequences with at most four inserts in a gap (more only repeat a state): (cost, audit, lines)."""
    fault, best = faults(rows), None
    for kept in itertools.product("KRD", repeat=len(rows)):
        if any(k != "D" and f in (1, 2) for k, f in zip(kept, fault, strict=True)):
            continue
        for gaps in itertools.product(range(4), repeat=len(rows) + 1):
            if sum(gaps) > 4:
                continue
            cost = 3 * sum(gaps) + sum({"K": 0, "R": 3, "D": 4}[k] + (3 if f == 3 and k != "D" else 0) for k, f in zip(kept, fault, strict=True))
            audit = "".join("I" * g + k for g, k in zip(gaps, kept, strict=False)) + "I" * gaps[-1]
            if best is not None and (cost, audit) >= best[:2]:
                continue
            lines, at, it = [], "", iter(rows)
            for e in audit:
                row = next(it) if e != "I" else None
                turn = "assistant" if at == "u" else "user"
                if e == "D":
                    continue
                role, text = (row[1], row[2]) if e == "K" else (turn, "" if e == "I" else row[2])
                lines.append(f"{role}:{text}")
                at = role[:1]
            if PATTERN.fullmatch("".join(x[:1] for x in lines)):
                best = cost, audit, lines
    return best


def report(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    fault = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = cheapest(rows)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[fault.count(k) for k in (1, 2, 3)],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Hi.", "Yes!", "no end", " \t\n", "", None, "Why? \x0b", "Hi.", "é", "...", "\x1c", "wrap.\n"]
    rows = []
    for conv in [*range(60), None, -7]:
        turns = sorted(rng.sample(range(-2, 9), rng.randint(1, 4)))
        rows += [(conv, None if rng.random() < 0.05 else t, rng.choice(roles), rng.choice(texts)) for t in turns]
    # conversations whose rows all go: their keys have remainder 0
    return rows + [(i, 0, "user", "Gone.") for i in range(1000, 1400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]


def test_repair_equals_all_sequences(spark, table):
    frame = spark.createDataFrame([(*r, 1) for r in table], "conv_id long, turn long, role string, text string, fault int").repartition(3)
    got = [tuple(r[c] for c in FIELDS) for r in cv.repair(cv.damage(frame)).collect()]
    by = {conv: [] for conv, *_ in table}
    for conv, *row in damaged(table):
        by[conv].append(tuple(row))
    assert sorted(got, key=repr) == sorted([report(conv, rows) for conv, rows in by.items()], key=repr)


def test_edits_give_the_repaired_lines(spark, table):
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    rows = cv.damage(frame)
    reports = {r.conv_id: r for r in cv.repair(rows).collect()}
    lines, audits = {}, {}
    for r in sorted(cv.edits(rows).collect(), key=lambda r: r.step):
        audits[r.conv_id] = audits.get(r.conv_id, "") + r.edit
        if r.edit != "D":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, r in reports.items():
        assert r.audit == audits.get(conv, "")
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest()


def depth(node):
    n = 0
    while node.parent is not None:
        node, n = node.parent, n + 1
    return n


def test_long_conversation_keeps_little():
    """The tree holds the unsettled edits alone, and long ones are as the plain dynamic programme has them."""
    rng = random.Random(8)
    out, most = [], 0
    search = cv.Search(lambda *edit: out.append(edit))
    rows = [(rng.choice(["user", "assistant", "user", "assistant", "tool"]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(4000)]
    plain = {cv.START: (0, "")}
    for role, text, fault in rows:
        search.add(role, text, fault)
        most = max(most, *(depth(node) for _, _, node in search.alive.values()))
        new = {}
        for s, (c, a) in plain.items():
            for ins in ("", "I", "II"):
                steps = [(s, c + 4, a + ins + "D")]
                if fault not in (1, 2):
                    extra = 3 * (fault == 3)
                    steps += [(cv.TURN[s], c + 3 + extra, a + ins + "R")]
                    if role[:1] in cv.ADMITS[s]:
                        steps += [(cv.ADMITS[s][role[:1]], c + extra, a + ins + "K")]
                for t, *x in steps:
                    new[t] = min(new.get(t, (10**9, "")), tuple(x))
                s, c = cv.TURN[s], c + 3
        plain = new
    cost = search.end()
    assert (cost, "".join(e for e, *_ in out)) == min((c + 3 * cv.MISSING[s], a + "I" * cv.MISSING[s]) for s, (c, a) in plain.items())
    assert most < 200


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(cv.damage(none)).count() == 0 and cv.edits(cv.damage(none)).count() == 0
