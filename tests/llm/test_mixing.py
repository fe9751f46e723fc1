"""Mixing: targets, schedule and what is taken, against brute force."""

import hashlib
import math

import pytest

from mosaiq.llm import mixing


def expected(rows, block=mixing.BLOCK):
    """Sizes, targets and taken words by plain loops; rows: (doc_id, source, size)."""
    sources = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    have = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, budget = {}, set(sources), 1.5 * sum(have.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if 2 * have[s] <= level * weight[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * have[s] for s in over})
        budget -= sum(2 * have[s] for s in over)
        free -= over
    out = []
    for s in sources:
        words, at = math.floor(target[s] + 0.5), 0
        order = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        for doc, _, n in order:
            full, rest = divmod(words, have[s]) if have[s] else (0, 0)
            out.append((doc, n, have[s], target[s], full * n + max(0, min(at + n, rest) - at)))
            at += n
    return out


def rounded(rows):
    return sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in rows), key=repr)


@pytest.fixture()
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, s, None if n is None else " ".join(["w"] * n), 3, "x") for i, s, n in rows], "doc_id long, source string, text string, size long, Text string")

    return make


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_taken(table, block):
    # a hot source, a small one, one without words, no source, repeated rows and ids, a long text
    rows = [(i, "hot", 40 + i % 7) for i in range(60)] + [(100 + i, f"s{i % 3}", 10 * i) for i in range(9)]
    rows += [(200, "none", 0), (201, "none", None), (None, None, 30), (None, None, 30), (202, None, 5), (203, "big", 5000), (7, "hot", 47), (7, "hot", 47), (8, "é", 4)]
    got = mixing.taken(table(rows), block=block).collect()
    assert rounded(got) == rounded(expected([(i, s, n or 0) for i, s, n in rows]))
    assert all(r.taken <= 2 * r.size for r in got)


def test_empty(table):
    assert mixing.taken(table([])).collect() == []
    assert [tuple(r) for r in mixing.taken(table([(1, "a", 0), (2, None, None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_schedule_is_even(table):
    """Each source has exactly its slots, and nearly its share of every prefix of the mix."""
    rows = [(i, "abcd"[i % 4], 50) for i in range(400)]
    _, slots = mixing.plan(table(rows), block=16)
    got = sorted((r.slot, r.name, r.rank) for r in slots.collect())
    count, total = {}, {}
    for _, name, _ in got:
        total[name] = total.get(name, 0) + 1
    for i, (_, name, rank) in enumerate(got):
        assert rank == count.get(name, 0)
        count[name] = rank + 1
        assert all(abs(count.get(s, 0) - (i + 1) * n / len(got)) <= 2 + math.log2(len(got)) / 2 for s, n in total.items())


def test_mix_has_the_taken_words(table):
    rows = [(i, "ab"[i % 2], 30 + i) for i in range(40)]
    took = {}
    for r in mixing.mix(table(rows), block=16).collect():
        assert r.source == "ab"[r.doc_id % 2] and 0 <= r.first_word and r.first_word + r.n_words <= 30 + r.doc_id
        took[r.doc_id] = took.get(r.doc_id, 0) + r.n_words
    assert took == {r.doc_id: r.taken for r in mixing.taken(table(rows), block=16).collect() if r.taken}
    assert sorted(map(tuple, mixing.mix(table(rows), block=16).collect())) == sorted(map(tuple, mixing.mix(table(rows[::-1]).repartition(7), block=16).collect()))
