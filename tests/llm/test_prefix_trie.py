"""The prefix trie of rebuilt conversations, against brute force over whole lists of turns."""

import hashlib
import random
import zlib

import pytest

from mosaiq.llm import prefix_trie


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def expected(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    digest = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if built[c] == node).encode()).hexdigest()
    return sorted(((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children.get(n, [])), leaves[n], saved[n], digest(n)) for n, who in members.items()), key=repr)


def made(n_convs, longest, words, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", rng.choice(words)))
    return rows


@pytest.fixture()
def check(spark):
    def run(rows, parts=3, swept=None):
        df = spark.createDataFrame([(*r, 5, "x", None) for r in rows], "conv_id long, turn long, role string, text string, depth long, Text string, node binary").repartition(parts)
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            if swept:
                spark.conf.set("spark.sql.shuffle.partitions", str(swept))
                spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = sorted((tuple(r) for r in prefix_trie.nodes(df).collect()), key=repr)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert got == expected(rows)

    return run


def test_random(check):
    check(made(150, 7, ["a", "bb", "", "é"], 1))
    check(made(330, 5, ["a", "b"], 2), swept=9)  # nodes go on over many partitions


def test_copies_over_partitions(check):
    """Whole conversations, their prefixes and their continuations, each many times over."""
    rows = []
    for c in range(1, 400):
        n = (40, 40, 40, 12, 55)[c % 5]
        rows += [(1000 * c + 7, t, "user", f"turn {t}") for t in range(n)]  # no first conversation of the group: only the own tail is left
    check(rows, swept=11)


def test_long_conversations(check):
    """Two that part after 700 turns, one of them far longer than all the rest; and few short ones."""
    rows = [(10_005, t, "user", f"{t} of one") for t in range(1500)] + [(10_006, t, "user", f"{t} of {'one' if t < 700 else 'another'}") for t in range(900)]
    check(rows + made(20, 4, ["a", "b"], 3))


def test_odd_rows(check):
    rows = [(None, 0, "user", "nobody"), (3, None, None, None), (3, None, None, None), (3, 0, None, ""), (3, 0, "user", "x"), (3, 0, "user", "a"), (-7, 1, "user", "neg"), (100, 0, "u", "t"), (104, 0, "u", "t"), (104, 1, "u", "\x00"), (2**40, 5, "", "x" * 100_000)]
    check(rows)
    check([])
    check([(None, None, None, None)])


def test_common_prefix():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 9))] for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix_trie.common_prefix(*[b"".join(x.encode() * 16 for x in v) for v in (a, b)]) == want
