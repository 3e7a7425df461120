"""Conversation repair, hard negatives and toxicity against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from amperoute.llm import conversation_repair, hard_negatives, queries, toxicity

# ---------------------------------------------------------------- conversation repair


def plain_repair(rows):
    """(turn, role, text) of one conversation, by recursion over rows and states."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    initials = "".join(r[1][:1] or "-" for r in rows)

    @cache
    def solve(at, state, inserted):
        need = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[need]
        ways = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        if at < len(rows):
            _, role, text = rows[at]
            options = [(3, "D", state, None)]
            if faults[at] in ("", "truncated"):
                extra = int(faults[at] == "truncated")
                if role[:1] == need or role[:1] == "s" and state == "":
                    options.append((extra, "K", role[:1], f"{role}:{text}"))
                options.append((2 + extra, "R", need, f"{name}:{text}"))
            for cost, letter, to, line in options:
                then = solve(at + 1, to, 0)
                if then:
                    ways.append((cost + then[0], letter + then[1], ((line,) if line is not None else ()) + then[2]))
        if inserted < 3 and (then := solve(at, need, inserted + 1)):
            ways.append((2 + then[0], "I" + then[1], (f"{name}:", *then[2])))
        return min(ways, default=None)

    cost, audit, lines = solve(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    count = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(seed, n):
    rng = random.Random(seed)
    role = lambda i: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "sage"]) if rng.random() < 0.4 else ["user", "assistant"][i % 2]
    text = lambda: rng.choice(["One.", "Two!", "Three? ", "cut off", "", " \n", None, "again.", "a\nb.", f"only {rng.random()}."])
    return [(rng.choice([i, i, i, i, i + 3, None, 5]), role(i), text()) for i in range(n)]


KINDS = "conv_id long, turn long, role string, text string, row string, cost long"


def compare(spark, given, partitions=3):
    rows = [(c, t, r, x, "extra", 1) for c, found in given.items() for t, r, x in found]
    random.Random(5).shuffle(rows)
    out = conversation_repair.repair(spark.createDataFrame(rows, KINDS).repartition(partitions)).collect()
    got = {r.conv_id: tuple(r)[1:] for r in out}
    assert len(out) == len(got) == len([c for c in given if given[c]])
    for c, found in given.items():
        if found:
            assert got[c] == plain_repair(found), (c, found)


def test_repair_matches_plain_recursion(spark):
    given = {i: conversation(i, i % 9) for i in range(120)}
    given[None] = conversation(900, 7)
    given[1000] = [(None, None, None)] * 4
    given[1001] = [(1, "user", "x" * 300_000 + "."), (2, "assistant", "y")]
    compare(spark, given)


def test_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_CHARS", 500)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        compare(spark, {1: conversation(1, 2), 2: conversation(2, 260), 3: conversation(3, 3)})
        compare(spark, {1: [(i, "user", "") for i in range(90)] + [(None, "system", "Hi.")]})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_block_lookup_equals_single_steps():
    tables = conversation_repair.Tables()
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 9, 40):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        vector, state = tables.effect(symbols)
        for last in range(len(tables.vectors)):
            costs = tables.vectors[last]
            for s in reversed(symbols):
                costs = conversation_repair.before(s, costs)
            for p in range(4):
                letters, cost, start, left = tables.trace(symbols, last, p)
                assert (start, left) == (vector[last], state[last, p])
                assert cost + tables.vectors[start][p] == costs[p] and len(letters) == n


def test_damage_and_empty_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"Text {t}. More!") for c in range(12) for t in range(6)] + [(None, None, None, None), (77, 0, "user", "x")]
    keep = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = {}
    for c, t, r, x in rows:
        fault, found = keep(c, t), hurt.setdefault(c, [])
        r, x = r or " ", x or " "
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        found += [] if fault == 0 else [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_repair(found) if found else nothing for c, found in hurt.items()}
    assert conversation_repair.repair(spark.createDataFrame([], KINDS)).collect() == []


# ---------------------------------------------------------------- hard negatives


def plain_mine(rows, anchors):
    rows = sorted({(i, y, tuple(x)) for i, y, x in rows if None not in (i, y, x) and None not in x})
    out = []
    for a, ya, xa in rows:
        if anchors(a):
            met = [(-sum(p * q for p, q in zip(xa, x)), i, y) for i, y, x in rows if i != a and len(x) == len(xa)]
            for p, pid in heapq.nsmallest(5, [(s, i) for s, i, y in met if y == ya]):
                fits = [(s, i) for s, i, y in met if y != ya and 80 * -p <= 100 * -s <= 100 * -p]
                out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(heapq.nsmallest(5, fits), 1)]
    return sorted(out)


def mined(spark, rows, modulus=10):
    frame = spark.createDataFrame([(i, y, x, "extra", 1) for i, y, x in rows], "vec_id long, label long, x array<long>, point string, id long")
    read = frame.select("vec_id", "label", "x", "point")
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(read, F.col("id") % modulus == 0).collect())


@pytest.mark.parametrize("page", [2048, 40])
def test_hard_negatives_match_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(hard_negatives, "PAGE_POINTS", page)
    monkeypatch.setattr(hard_negatives, "LEAF_POINTS", 4)
    rng = np.random.default_rng(page)
    centres = rng.integers(-40, 40, (6, 8))
    rows = [(i, int(rng.integers(0, 5)), (centres[rng.integers(0, 6)] + rng.integers(-6, 7, 8)).tolist()) for i in range(240)]
    rows += [(300 + i, i % 3, [9] * 8) for i in range(60)]  # one vector many times
    rows += [(400, None, [1] * 8), (410, 1, None), (420, 1, [1, None] * 4), (None, 1, [1] * 8), (430, 1, []), (431, 1, []), (432, 2, [])]
    rows += [(440, 1, [3, 4]), (441, 1, [3, 5]), (442, 0, [3, 4]), (10, 3, [2] * 8), rows[20], rows[20], (450, 1, [2**28] * 8), (451, 1, [2**28] * 8), (452, 2, [2**28 - 1] * 8)]
    assert mined(spark, rows) == plain_mine(rows, lambda i: i % 10 == 0)


def test_no_anchors_or_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1, 2]), (3, 1, [1, 1])]) == []


def test_descent_leaves_out_far_nodes():
    rng = np.random.default_rng(1)
    x = (rng.integers(-200, 200, (16, 6))[rng.integers(0, 16, 800)] + rng.integers(-3, 4, (800, 6))).astype(np.int64)
    tree = hard_negatives.CoverTree.grow(x, np.zeros(800, np.int64), [[i] for i in range(800)])
    read = []
    tree.below, below = None, tree.below

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop - key.start)
            return super().__getitem__(key)

    tree.below = below.view(Counted)
    for q in x[:20]:
        found = tree.search(q, [(None, None)], 0, True, 5)[0]
        scores = x @ q
        assert found == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(800), -scores))[:5]]
    assert sum(read) < 0.5 * 20 * 800


# ---------------------------------------------------------------- toxicity

PLAIN = [a + b for a in ("ban", "lor", "mit", "sed", "vel", "qua", "nor", "pel") for b in ("dar", "tion", "ing", "ora", "ere", "ust")]
FOUL = ["garbagehead", "nitwitted", "blockhead", "numbskull"]


def essays(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words, toxic = rng.choices(PLAIN, k=rng.randrange(40, 160)), int(rng.random() < 0.3)
        for _ in range(6 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(FOUL))
        yield i, " ".join(words), toxic


def test_toxicity_of_held_out_documents(spark):
    given = list(essays(400, 1))
    odd = [(1000, None), (1001, ""), (1002, "12 34 ..."), (None, "bandar " * 50), (1003, "NITWITTED Blockhead " * 20), (1004, "z" * 200_000), (5, given[5][1])]
    docs = spark.createDataFrame([(i, t, "x", 2.0) for i, t, _ in given] + [(i, t, "x", 2.0) for i, t in odd], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in given] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs.repartition(3), labels).select("row.doc_id", "held_out", "score").collect()
    assert len(rows) == len(given) + len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in rows)
    score, truth = {r.doc_id: r.score for r in rows}, {i: y for i, _, y in given}
    out = [r.doc_id for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 50 and sum((score[i] >= 0.5) == truth[i] for i in out) >= 0.97 * len(out)
    assert score[1003] > 0.5 > score[1002] and score[1000] == score[1001] == score[1002]


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, "another"), (3, None)], "doc_id long, text string")
    labels = "doc_id long, toxic int"
    assert {r.score for r in toxicity.score(docs, spark.createDataFrame([], labels)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], labels)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), spark.createDataFrame([], labels)).collect() == []
