"""How much the operators find of what is planted or hidden, where no exact answer is defined."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import url_filter

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


# --- 9 url filter ---------------------------------------------------------------------------


#: Rules by section and domain, none by a part of a number.
OTHER_RULES = (("allow", "org", "/"), ("block", "org", "/es/"), ("allow", "com", "/"), ("block", "com", "/en/"), ("block", "example.org", "/de/"))


@pytest.mark.parametrize("rules", [url_filter.RULES, OTHER_RULES], ids=["registered", "other"])
def test_url_templates_recover_hidden_labels(spark, rules):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = url_filter.ruled_rows(pages, rules)
    tree = url_filter.path_tree(rows)
    hidden = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    shown = url_filter.template_labels(tree.where(~hidden))
    asked = tree.where("ruled is not null").where(hidden)
    found = url_filter.template_verdicts(asked, shown).withColumn("found", F.lit(True))
    rows = asked.join(found, ["host", "template"], "left").select("path", "ruled", F.coalesce("found", F.lit(False)).alias("found")).toPandas()
    # the first digit of a number is no part of a template, so a rule that asks for it is not learned
    blocked = (rows.ruled == "block") & ~rows.path.str.startswith("/en/1")
    recall, precision = rows.found[blocked].mean(), (rows.ruled == "block")[rows.found].mean()
    print(f"hidden {len(rows)}, blocked {blocked.sum()}, recall {recall:.3f}, precision {precision:.3f}")
    assert blocked.sum() > 20 and recall >= 0.9 and precision >= 0.9
    unruled = url_filter.judge(pages, rules).where("rule is null").groupBy("verdict").count().toPandas().set_index("verdict")["count"]
    assert unruled["allow"] > unruled.get("block", 0)


def test_url_numbers_are_alike(spark):
    """No verdict by the first digit: all numbers of a section are judged together."""
    rules = (("block", "a.net", "/x/1"), ("allow", "a.net", "/x/2"))
    urls = [f"http://{h}.net/x/{d}{n}" for h in "ab" for d in (1, 2, 3) for n in range(40)]
    v = {(r.host, r.path[:4]): r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert v == {("a.net", "/x/1"): "block", ("a.net", "/x/2"): "allow", ("a.net", "/x/3"): "allow", **{("b.net", f"/x/{d}"): "allow" for d in (1, 2, 3)}}


@pytest.mark.parametrize("depth", [15, 16, 17, 40_000])
def test_url_depth_and_clashing_columns(spark, depth):
    deep = "http://h.net/" + "/".join(str(i) for i in range(depth))
    pages = spark.createDataFrame([(None, deep, "x", "y", "z", "t"), (None, deep, "x", "y", "z", "t"), (3, "http://h.net/a", None, None, None, None)], "page_id long, url string, path string, rule string, verdict string, template string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == 3 and {r.verdict for r in rows} == {"allow"} and sum(r.page_id is None for r in rows) == 2


def test_url_siblings(spark):
    """Numbers inherit from one labelled branch, sections from two alike; where branches differ nothing is handed on."""
    rules = (("block", "a.net", "/x/1"), ("block", "b.net", "/x/"), ("block", "b.net", "/y/"), ("block", "c.net", "/x/"), ("allow", "c.net", "/y/"))
    urls = [f"http://{h}.net/{s}/{n}" for h in "abc" for s in ("x", "y", "z") for n in range(100, 400, 7)]
    v = {(r.host[0], r.path[1], r.path[3]): r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert v["a", "x", "2"] == "block" and v["a", "z", "1"] == "allow"
    assert v["b", "z", "1"] == "block" and v["c", "z", "1"] == "allow"


# --- 3 personal data ------------------------------------------------------------------------

SPELLED = dict(enumerate("zero one two three four five six seven eight nine".split()))
LOOKS = dict(zip("aeopcxABEHKMOPTX", "аеорсхАВЕНКМОРТХ", strict=True))


def planted(kind, rng):
    word = lambda: "".join(rng.choice("abcdefghikmnprstuvw") for _ in range(rng.randint(3, 9)))
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if kind == "email":
        return f"{word()}.{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "phone":
        return "+" + rng.choice("123456789") + digits(rng.randint(9, 13))
    head = "4" + digits(14)
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(head)))
    return head + str(-total % 10)


def wide(x, rng):
    return "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in x)


def spell(x, rng):
    return rng.choice([" ", ", ", "  ", " - "]).join({"+": "plus", ".": "dot"}.get(c) or SPELLED[int(c)] for c in x)


def bracket(x, rng):
    blank = lambda: " " * rng.choice([0, 1, 2, 7])
    return x.replace("@", f"{blank()}[{blank()}at{blank()}]{blank()}").replace(".", f"{blank()}{rng.choice(['(dot)', '[dot]', '{.}', '<dot>'])}{blank()}")


def speak(x, rng):
    gap = " " * rng.choice([1, 2, 5])
    return x.replace("@", f"{gap}{rng.choice(['at', 'AT'])}{gap}").replace(".", f"{gap}dot{gap}")


DISGUISES = {
    ("email", "wide"): wide, ("ip", "wide"): wide, ("card", "wide"): wide, ("phone", "wide"): wide,
    ("email", "look-alikes"): lambda x, rng: "".join(LOOKS.get(c, c) for c in x),
    ("email", "invisible"): lambda x, rng: "​".join(x), ("ip", "invisible"): lambda x, rng: "­".join(x), ("card", "invisible"): lambda x, rng: "​".join(x),
    ("ip", "letters for digits"): lambda x, rng: x.replace("0", "O").replace("1", "l"), ("card", "letters for digits"): lambda x, rng: x.replace("0", "O"),
    ("ip", "spelled"): spell, ("card", "spelled"): spell, ("phone", "spelled"): spell,
    ("email", "brackets"): bracket, ("ip", "brackets"): bracket,
    ("email", "spoken"): speak, ("email", "entities"): lambda x, rng: x.replace("@", "&#64;").replace(".", "&#46;"),
    ("email", "apart"): lambda x, rng: " ".join(x), ("ip", "apart"): lambda x, rng: " ".join(x),
}


def test_disguised_identifiers_are_found():
    import random

    from mosaiq.llm import pii

    rng = random.Random(11)
    recall = {}
    for (kind, name), disguise in DISGUISES.items():
        hits = 0
        for _ in range(200):
            plain = planted(kind, rng)
            text = f"Some words first, then {disguise(plain, rng)} and on it goes."
            spans = [text[a:b] for k, a, b in pii.find(text)[1] if k == kind]
            hits += disguise(plain, random.Random(0)) == plain or any(len(x) >= len(disguise(plain, rng)) - 40 and x in text and x.strip() and text.index(x) == len("Some words first, then ") for x in spans)
        recall[kind, name] = hits / 200
    print(recall)
    assert min(recall.values()) >= 0.9


def test_no_limit_on_blanks_labels_and_their_number():
    from mosaiq.llm import pii

    for n in (1, 3, 4, 64, 65, 2000):
        for text in (
            f"john{' ' * n}[{' ' * n}at{' ' * n}]{' ' * n}example{' ' * n}[dot]{' ' * n}com",
            " dot ".join(["a"] * n) + " at mail" + " dot mail" * n + " dot com",
            "x" * n + " at example dot " + "c" * max(n, 2),
            (" " * n).join(["nine"] * 3 + ["dot"] + ["nine"] + ["dot"] + ["nine"] + ["dot"] + ["nine"]) if n < 65 else "a at b dot com",
        ):
            if not text.startswith("nine"):
                assert [(k, a, b) for k, a, b in pii.find(text)[1]] == [("email", 0, len(text))], text[:80]


# --- 7 decontamination ----------------------------------------------------------------------

WORDS = "river stone garden market winter bridge candle forest window yellow silver morning letter basket kitchen harbour".split()
NAMES = "Anna Carl Mia Otto Eva Nils Ida Lars Tom Ruth Paul Vera".split()
CARDINALS = {2: "two", 3: "three", 5: "five", 7: "seven", 8: "eight", 9: "nine", 25: "twenty five", 31: "thirty-one", 47: "forty seven"}


def _question(rng):
    """A template of literal words with places for two names and two numbers, each standing twice."""
    w = [rng.choice(WORDS) for _ in range(14)]
    return f"{{a}} and {{b}} {w[0]} {w[1]} {{x}} kg of {w[2]} and {w[3]} the {w[4]} for {{y}} {w[5]}, so {w[6]} {w[7]} does {{a}} {w[8]} when {{x}} kg of {w[9]} {w[10]} and {{y}} {w[11]} {w[12]} to {{b}} in {w[13]}?"


def test_reparameterised_items_are_found(spark):
    import random

    from mosaiq.llm import decontam

    rng = random.Random(17)
    fill = lambda q, a, b, x, y: q.format(a=a, b=b, x=x, y=y)
    items, docs, want = [], [], {}
    for i in range(60):
        q = _question(rng)
        (a, b, c, d), (x, y, u, v) = rng.sample(NAMES, 4), rng.sample(sorted(CARDINALS), 4)
        items.append((i, fill(q, a, b, x, y)))
        other = fill(_question(rng), c, d, u, v)
        rewrites = {
            "other values": fill(q, c, d, u, v), "other numbers, lower case": fill(q, a, b, u, v).lower(), "verbatim, lower case": fill(q, a, b, x, y).lower(),
            "verbatim, upper case": fill(q, a, b, x, y).upper(), "numbers spelled": fill(q, a, b, CARDINALS[x], CARDINALS[y]), "spelled in part": fill(q, c, d, u, v).replace(str(u), CARDINALS[u], 1),
            "another question": other,
        }
        for kind, text in rewrites.items():
            want[len(docs)] = (kind, i)
            docs.append((len(docs), f"Something else stands before it. {text} And after it."))
    found = {(r.doc_id, r.item_id) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {k: sum((d, i) in found for d, (kind, i) in want.items() if kind == k) / 60 for k in {kind for kind, _ in want.values()}}
    precision = sum((d, i) in found for d, (kind, i) in want.items() if kind != "another question") / len(found)
    print(recall, precision)
    assert recall.pop("another question") == 0 and precision >= 0.95
    assert min(recall.values()) >= 0.9


def test_windows_agree_with_brute_force(spark):
    """Matched words of every pair are those under equal windows of equal words, counted one by one."""
    import random

    from mosaiq.llm import decontam

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS[:5]) for _ in range(n))
    items = [(i, text(rng.randint(3, 25))) for i in range(15)]
    docs = [(i, text(rng.randint(0, 300))) for i in range(15)]
    want = set()
    for i, d in docs:
        for k, t in items:
            w, words = d.split(), t.split()
            n = min(8, len(words))
            at = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            covered = {p for j in range(len(words) - n + 1) if tuple(words[j : j + n]) in at for p in range(j, j + n)}
            if len(covered) >= 13 or 2 * len(covered) >= len(words):
                want.add((i, k, len(covered)))
    found = {(r.doc_id, r.item_id, r.n_words) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == want and want


def test_decontamination_of_odd_tables(spark):
    from mosaiq.llm import decontam

    long = "word " * 60_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = spark.createDataFrame([(1, long, "x", 1), (1, long, "x", 1), (None, "", None, None), (2, None, "y", 2)], "doc_id long, text string, item_id string, hash long")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = spark.createDataFrame([(7, item, "a", 0), (7, item, "b", 1), (None, item, "c", 2)], "item_id long, text string, doc_id string, width int")
    assert {(r.doc_id, r.item_id, r.share) for r in decontam.matches(docs, bench).collect()} == {(1, 7, 1.0), (1, None, 1.0)}
    assert decontam.clean(docs, bench).count() == 2 and decontam.clean(docs, bench).columns == docs.columns


# --- 2 quality ------------------------------------------------------------------------------


def test_toxic_documents_of_every_language_go(spark):
    """Learned from half of the labels, measured on the other half's good documents."""
    from mosaiq.llm import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    shown = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held = labels.join(shown, "doc_id", "left_anti").where("quality = 1")
    judged = quality.judge(docs, labels=shown)
    rows = held.join(docs.select("doc_id", "lang"), "doc_id").join(judged, "doc_id").toPandas()
    toxic, fair = rows[rows.toxic == 1], rows[(rows.toxic == 0) & ~rows.base_failed]
    recall = {lang: 1 - part.kept.mean() for lang, part in toxic.groupby("lang")}
    print(recall, 1 - toxic.kept.mean(), fair.kept.mean())
    assert min(recall.values()) >= 0.85 and 1 - toxic.kept.mean() >= 0.9 and fair.kept.mean() >= 0.99


def test_labels_of_odd_tables(spark):
    from mosaiq.llm import quality

    docs = spark.createDataFrame([(1, "word " * 60, "a"), (None, "word " * 60, None), (2, None, "c"), (3, "", "d")], "doc_id long, text string, toxic string")
    for rows in ([], [(None, 1, 1), (1, None, 1), (1, 1, None), (1, 1, 1), (2, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int, text int")
        assert quality.learned_stems(docs, labels) == [] and quality.judge(docs, labels=labels).count() == 4


def test_rules_that_leave_nothing_to_each_other_come_last():
    from mosaiq.llm import quality

    rules = tuple(quality.Rule(n, None) for n in "abc")
    # a rejects three texts, b two of the same, c one other: c has more left to reject than b
    measured = [[(1.0, i < 3), (1.0, i < 2), (1.0, i == 3)] for i in range(5)]
    assert [r.name for r in quality.arranged(rules, measured)] == ["a", "c", "b"]


# --- 6 language identification ----------------------------------------------------------------


def test_language_scores_are_calibrated_and_weights_sparse(spark):
    """Scores of short held-out pieces mean what they say; most weights are zero; the temperature is found, not a limit."""
    import numpy as np

    from mosaiq.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    used = model.idf > 0
    assert 0.03 < model.temperature < 15 and (model.weights[:, :-1][:, used] != 0).mean() < 0.3
    held = docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").collect()
    whole = [langid.classify(r.text, model)[0] == r.lang for r in held]
    pieces = [(langid.classify(langid.piece_of(r.text, k * 7919 + (r.doc_id << 17)), model), r.lang) for r in held for k in range(6)]
    score, right = (np.array(v) for v in zip(*[(s, p == lang) for (p, s), lang in pieces if p != langid.UNDETERMINED], strict=True))
    bins = np.ceil(score * 10)
    error = sum((bins == b).mean() * abs(score[bins == b].mean() - right[bins == b].mean()) for b in np.unique(bins))
    print(f"whole {np.mean(whole):.3f}, pieces {right.mean():.3f}, mean score {score.mean():.3f}, calibration error {error:.3f}")
    assert np.mean(whole) >= 0.97 and right.mean() > 0.9 and error < 0.06 and score.min() < 0.9


def test_language_broadcast_is_plain(spark, monkeypatch):
    """What is broadcast can be read by workers that lack the package."""
    import pickletools
    import pickle

    from mosaiq.llm import langid

    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, own=type(spark.sparkContext).broadcast: sent.append(value) or own(self, value))
    docs = spark.createDataFrame([(i, "the cat sat" if i % 2 else "le chat dort", "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.identify(docs).count() == 60
    names = [arg for op, arg, _ in pickletools.genops(pickle.dumps(sent)) if isinstance(arg, str)]
    assert sent and not any("mosaiq" in n for n in names)


def test_shared_instructions_are_no_match(spark):
    """Items and documents that share an instruction give no pair by it; copies and other values are found, and pairs stay few."""
    from mosaiq.llm import decontam

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9)))
    instruction = "please read the following question with care and then write down the single best answer in full"
    items = [(i, f"{instruction} " + " ".join(word() for _ in range(20))) for i in range(120)]
    # one question with many values, and the instruction alone as an item
    family = "a train leaves the old station at {} and travels for {} hours before it meets the slow river bridge near town"
    items += [(1000 + i, family.format(i + 100, i + 3)) for i in range(60)] + [(5000, instruction)]
    docs = [(i, f"{instruction} " + " ".join(word() for _ in range(40))) for i in range(150)]
    docs += [(900 + i, "x y z " + items[i][1] + " and more") for i in range(5)] + [(950, family.format(7000, 12)), (951, items[125][1])]
    rows = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert all(found.get(900 + i, set()) - {5000} == {i} for i in range(5))
    assert found[950] and found[951] and all(1000 <= i < 1060 for d in (950, 951) for i in found[d])
    # the instruction is an item of its own here; beside it no document matches by the instruction alone
    assert all(found.get(i, set()) <= {5000} for i in range(150)) and len(rows) < 400


def test_items_of_one_id_are_kept_apart(spark):
    from mosaiq.llm import decontam

    rng = random.Random(22)
    a, b = (" ".join("".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(20)) for _ in range(2))
    half = a.split()[:8] + ["between"] + b.split()[:8]
    got = decontam.matches(spark.createDataFrame([(1, " ".join(half)), (2, a)], "doc_id long, text string"), spark.createDataFrame([(7, a), (7, b), (None, a + " x"), (None, b + " y")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in got} == {(2, 7, 20), (2, None, 20)}


def test_no_pair_is_lost_to_shared_windows(spark):
    """Every pair by the plain rule, of which many hang on windows of more than SHARED items, is in a row."""
    from mosaiq.llm import decontam

    rng = random.Random(31)
    words = lambda n: [rng.choice(WORDS) for _ in range(n)]
    common = [words(n) for n in (6, 9, 12, 17)]
    # items of one, two or no common passage and some words of their own; documents likewise
    make = lambda: [w for p in rng.sample([*common, words(3), words(10), []], 3) for w in p] or words(5)
    items = [(i, make()) for i in range(70)]
    docs = [(i, words(4) + (make() if i % 2 else rng.choice(items)[1][rng.randint(0, 4) :]) + words(4)) for i in range(50)]
    want, size = {}, {i: len(t) for i, t in items}
    for i, d in docs:
        for k, t in items:
            n = min(8, len(t))
            at = {tuple(d[j : j + n]) for j in range(len(d) - n + 1)}
            covered = {p for j in range(len(t) - n + 1) if tuple(t[j : j + n]) in at for p in range(j, j + n)}
            if len(covered) >= 13 or 2 * len(covered) >= len(t):
                want[i, k] = len(covered)
    frames = [spark.createDataFrame([(i, " ".join(t)) for i, t in x], f"{name} long, text string") for name, x in (("doc_id", docs), ("item_id", items))]
    rows, of = decontam.matches(*frames).collect(), {}
    for m in decontam.members(frames[1]).collect():
        of.setdefault(m.class_item_id, set()).add(m.item_id)
    assert max(map(len, of.values())) > decontam.SHARED
    links, got = {}, {}
    for r in rows:
        links[r.doc_id] = links.get(r.doc_id, 0) + r.n_items
        for k in {r.item_id} | (of.get(r.item_id, set()) if r.n_items > 1 else set()):
            got.setdefault((r.doc_id, k), set()).add(r.n_words)
    # as many links as pairs, and each pair's words in a row of the item or of its class
    assert links == {i: sum(d == i for d, _ in want) for i in {d for d, _ in want}}
    assert all(n in got.get(pair, {n}) for pair, n in want.items()) and len(rows) < len(want)
    assert all(r.share == r.n_words / size[r.item_id] for r in rows)


def test_every_item_of_a_generated_question_is_linked(spark):
    """Items that differ by their values, also as a class whose slots repeat values at other places than another's."""
    from mosaiq.llm import decontam

    family = "after lunch the old farmer near {} sells {} baskets of fresh pears and {} small pots of honey at the market in town"
    places = "Rome Oslo Bern Kiel Graz Nice Bath York Cork Lyon Turin Malmo".split()
    items = [(i, family.format(places[i], i + 20, i + 40)) for i in range(12)] + [(100 + i, family.format(places[i], i + 60, i + 60)) for i in range(10)]
    docs = [(1, family.format("Riga", 700, 800)), (2, family.format("Riga", 900, 900)), (3, items[4][1]), (4, items[15][1].lower()), (5, "after lunch the old farmer near the river sells nothing at all")]
    frames = [spark.createDataFrame(x, f"{name} long, text string") for name, x in (("doc_id", docs), ("item_id", items))]
    rows = decontam.matches(*frames).collect()
    links, kept = {}, {r.doc_id for r in decontam.clean(*frames).collect()}
    for r in rows:
        links[r.doc_id] = links.get(r.doc_id, 0) + r.n_items
        assert r.telling and r.item_hash is not None
    whole = {(r.doc_id, r.item_id) for r in rows if r.n_items == 1 and r.share == 1.0}
    print(links, whole)
    assert {(3, 4), (4, items[15][0])} <= whole and kept == {5}
    assert {k: links[k] for k in (1, 2)} == {1: 12, 2: 22}


# --- 10 license scan ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This project is MIT licensed.", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
        ("Licensed under the Mozilla Public License 2.0", "mpl"), ("under Creative Commons Attribution 4.0, as is", "cc-by"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
        # near misses
        ("This project is MIT funded.", ""), ("SPDX-License-Identifier: LicenseRef-Own", ""), ("the Mozilla foundation and its public license debate of 2.0", ""), ("Creative Commons photographs, attribution needed", ""),
        ("Permission is hereby granted to enter the garden free of charge", ""), ("Redistribution and use of the land in the valley are permitted", ""), ("Licensed under the supervision of a doctor", ""),
    ],
)
def test_license_lines(spark, text, labels):
    from mosaiq.llm import license_scan

    docs = spark.createDataFrame([(1, "some words before it. " + text + "\nand some after")], "doc_id long, text string")
    assert license_scan.scan(docs).first().labels == labels
