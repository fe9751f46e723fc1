"""Each operator against a brute-force version, and on odd tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from mosaiq.llm import decontam, langid, license_scan, packing, pii, quality, queries, simhash, substring_dedup, token_counts, url_filter


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# --- 1 packing ------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        h = {n: rng.randint(1, 9) for n in rng.sample(range(0, 40), rng.randint(1, 9))}
        k = rng.randint(1, 4)

        def padding(bounds, h=h):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in h.items())

        best = min(padding((*b, max(h))) for size in range(min(k, len(h))) for b in itertools.combinations(sorted(h)[:-1], size))
        found = packing.boundaries(h, k)
        assert padding(found) == best and len(found) <= k and found[-1] == max(h)


def test_pack_is_whole_and_within_budget(corpus):
    rng = random.Random(2)
    docs = corpus([(i, " ".join(["w"] * n)) for i, n in enumerate([0, 1, 250, 99, 100, 101] + [rng.randint(1, 120) for _ in range(300)])])
    rows = packing.pack(docs, max_len=100, buckets=4, budget=300, chunk_rows=16).toPandas()
    want = {i: len(t.split()) for i, t in texts(docs).items()}
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert (rows.n_tokens <= rows.bucket_len).all() and rows.n_tokens.max() == 100
    batch = rows.groupby(["bucket", "batch"]).agg(n=("slot", "size"), length=("bucket_len", "first"), slots=("slot", "nunique"))
    assert (batch.n * batch.length <= 300).all() and (batch.n == batch.slots).all()
    for _, b in batch.groupby("bucket"):  # only the last batch of a bucket is open
        assert (b.n.iloc[:-1] == 300 // max(b.length.iloc[0], 1)).all()


def test_pack_odd(odd, spark):
    rows = packing.pack(odd).toPandas()
    assert len(rows) == 9 + 15 and rows.n_tokens.sum() == 30_000 + 3 + 2 * 3 + 1
    assert packing.pack(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, max_len=10, budget=5)


def test_packing_query_counts_tokens(spark, tmp_path):
    rows = [(1, "plain prose of a few words"), (2, "0123456789abcdefghij" * 800), (3, None), (4, "plain prose of a few words"), (None, "漢字仮名交" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = token_counts.count_tokens([t or "" for _, t in rows], token_counts.default_tokenizer())
    found = queries.op1_packing(spark, str(tmp_path)).toPandas()
    want = {-1 if i is None else i: n for (i, _), n in zip(rows, counts, strict=True)}
    assert found.assign(doc_id=found.doc_id.fillna(-1).astype(int)).groupby("doc_id").n_tokens.sum().to_dict() == want and want[2] > packing.MAX_LEN
    assert (found.n_tokens <= found.bucket_len).all() and found.bucket_len.max() <= packing.MAX_LEN
    assert (found.groupby(["bucket", "batch"]).n_tokens.sum() <= packing.BUDGET).all()
    long = found[found.doc_id == 2].sort_values("piece")
    assert (long.first_token == long.piece * packing.MAX_LEN).all()


# --- 2 quality ------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat)


def test_quality_counts(real):
    t = texts(real)
    for r in quality.judge(real).collect():
        counts = brute_counts(t[r.doc_id])
        assert tuple(r)[1:6] == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r.base_failed and r.kept)


def test_order_changes_no_verdict(real):
    kept = {r.doc_id for r in quality.judge(real).where("kept").collect()}
    for rules in (quality.RULES[::-1], quality.ordered(quality.RULES, quality.sample(real))):
        assert {i for i, t in texts(real).items() if not quality.base_failed(quality.Text(t)) and not quality.rejected(quality.Text(t), rules)} == kept
    assert {r.doc_id for r in quality.keep_good(real).collect()} == kept


def test_cheap_strong_rules_come_first():
    import time

    slow = quality.Rule("slow", lambda t: time.sleep(0.002) or True)
    idle, quick = quality.Rule("idle", lambda t: False), quality.Rule("quick", lambda t: True)
    assert [r.name for r in quality.ordered((slow, idle, quick), ["a b c"] * 20)][0] == "quick"


def test_quality_on_labels(spark, real):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").join(quality.judge(real), "doc_id").toPandas()
    clean = labels[(labels.quality == 1) & (labels.toxic == 0) & ~labels.base_failed]
    assert clean.kept.mean() > 0.99 and not labels[labels.quality == 0].kept.any()


def test_quality_odd(odd):
    rows = quality.judge(odd).toPandas()
    assert len(rows) == 10 and rows.n_words.max() == 30_000
    assert quality.keep_good(odd.limit(0)).count() == 0 and quality.keep_good(odd).columns == odd.columns


# --- 3 personal data ------------------------------------------------------------------------


def brute_spans(t):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m.group())
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_match_the_patterns(real):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab1234567890.@+- ()%5_") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in [*texts(real).values(), *made]:
        assert pii.plain_spans(t) == brute_spans(t)


DISGUISED = [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john.doe at mail dot example dot com, ok", "email", "john.doe at mail dot example dot com"),
    ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏ＠ｅｘ．ｃｏｍ", "email", "ｊｏ＠ｅｘ．ｃｏｍ"),
    ("jo&#64;example&#46;com", "email", "jo&#64;example&#46;com"),
    ("call plus one five five five one two three four five six seven eight now", "phone", "plus one five five five one two three four five six seven eight"),
    ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
    ("at 192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("juan arroba correo punto es", "email", "juan arroba correo punto es"),
    ("Karte vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ("host 192.l68.1.1", "ip", "192.l68.1.1"),
    ("x jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
]


@pytest.mark.parametrize("text,kind,span", DISGUISED)
def test_disguises_map_back(text, kind, span):
    plain, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in plain] == [(kind, span)]
    assert pii.redacted(text) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at the example.com dot this", "one two three four", "we meet at noon. dot com", "une année à Paris", "joe AT example.com", "five at one dot", "le point est un deux", "B12 O2 10l 5I", "un deux trois soleil"])
def test_clean_text_stays(text):
    assert pii.find(text) == ([], []) and pii.redacted(text) == text


def test_pii_rows(real, odd):
    t = texts(real)
    for r in pii.detect(real).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.detect(odd).count() == 10 and pii.detect(odd.limit(0)).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == 10


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for piece in ("a", "1", "a@", "1.", "+1", "one ", "(", "х", "@ "):
        pii.find(piece * (200_000 // len(piece)))
    assert time.time() - began < 20


# --- 4 token counts -------------------------------------------------------------------------


def test_token_counts(real, odd, tmp_path, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_tokenizer())
    t = texts(real)
    for r in token_counts.token_counts(real).collect():
        n = len(library.encode(t[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t[r.doc_id].encode()), n, n > 512)
    rows = token_counts.token_counts(odd).toPandas()
    assert len(rows) == 10 and rows.n_tokens[rows.n_bytes == 0].tolist() == [0, 0, 0]
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_cache_encodes_only_misses(corpus, tmp_path, spark, monkeypatch):
    cache = str(tmp_path / "cache")
    path = token_counts.default_tokenizer()
    first = corpus([(1, "alpha beta"), (2, "alpha beta"), (3, "<|endoftext|> x")])
    a = token_counts.token_counts(first, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    b = {r.doc_id: r.n_tokens for r in token_counts.token_counts(corpus([(9, "alpha beta"), (8, "gamma")]), cache).collect()}
    assert spark.read.parquet(cache).count() == 3 and b[9] == next(r.n_tokens for r in a if r.doc_id == 1)
    monkeypatch.setattr(token_counts, "tokenizer_digest", lambda p: "another version")
    token_counts.refresh(first, cache, path)
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2


def test_a_repeated_or_racing_append_changes_nothing(corpus, tmp_path, spark):
    cache = str(tmp_path / "cache")
    docs = corpus([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (None, None)])
    want = sorted(map(tuple, token_counts.token_counts(docs, cache).collect()), key=repr)
    rows = spark.read.schema(token_counts.CACHE).parquet(cache).collect()
    spark.createDataFrame(rows, token_counts.CACHE).write.partitionBy("tokenizer", "part").mode("append").parquet(cache)
    assert spark.read.parquet(cache).count() == 2 * len(rows)
    assert sorted(map(tuple, token_counts.token_counts(docs, cache).collect()), key=repr) == want and len(want) == 4


def test_a_warm_cache_moves_no_text(real, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    want = sorted(map(tuple, token_counts.token_counts(real, cache).collect()))
    monkeypatch.setattr(token_counts, "_encode", lambda path: (_ for _ in ()).throw(AssertionError("nothing is to be encoded")))
    warm = token_counts.token_counts(real, cache)
    assert sorted(map(tuple, warm.collect())) == want
    plan = warm._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and "text" in x]


def test_the_fast_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_tokenizer())
    rng = random.Random(8)
    letters = "abcdefgh  \n\t'sstt.,!?-0123456789ABCÀÖöøÿßé<|>endoftext"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    made += ["".join(chr(rng.choice([32, 10, 39, 115, rng.randrange(33, 700), rng.randrange(0x3000, 0x3100)])) for _ in range(40)) for _ in range(1000)]
    assert token_counts.count_tokens(made, token_counts.default_tokenizer()) == [len(library.encode(t, add_special_tokens=False).ids) for t in made]


# --- 5 simhash ------------------------------------------------------------------------------


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    parent = dict(zip(ids, ids))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(real):
    prints = {i: brute_print(t) for i, t in texts(real).items()}
    want = brute_components(prints)
    for r in simhash.near_duplicates(real).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_covering_triples():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("limit", [2, 5, 256])
def test_links_lose_nothing_at_any_list_length(spark, limit):
    rng = random.Random(limit)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {i: rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(250)}
    prints |= {300 + i: rng.getrandbits(64) for i in range(50)}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    groups = simhash.group_by_fingerprint(spark.createDataFrame(signed, "doc_id long, fp long"), limit)
    found = {r.fp: r.component_id for r in groups.collect()}
    assert {i: found[p] for i, p in signed} == brute_components(prints)


def test_simhash_odd(odd):
    rows = simhash.near_duplicates(odd).toPandas()
    blank = rows[rows.fingerprint == "0" * 16]
    assert len(rows) == 10 and len(blank) == 4 and (blank.component_id == 1).all()
    assert rows[rows.doc_id.isin([5, 6])].component_id.tolist() == [5, 5, 5]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 7, 8]


# --- 6 language -----------------------------------------------------------------------------


def test_language_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert 0.2 < rows.held_out.mean() < 0.3 and (held.lang == held.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    model = langid.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and langid.classify("12 34 !", model) == ("und", 0.0)
    assert langid.identify(odd).where("lang_pred <> 'und'").count() == 0  # no labels: nothing is known
    assert langid.identify(odd.limit(0)).count() == 0


def test_ftrl_is_sparse_and_calibration_minimises():
    rng = np.random.default_rng(3)
    vectors, labels = [], []
    for _ in range(200):
        y = int(rng.integers(2))
        vectors.append((np.array([y, 5, langid.BUCKETS]), np.array([1.0, 0.3, 1.0])))
        labels.append(y)
    w = langid.fit_ftrl(vectors, np.array(labels), 2)
    assert (w != 0).sum() <= 8 and all(int((w[:, at] @ x).argmax()) == y for (at, x), y in zip(vectors, labels))
    s = rng.normal(size=(300, 3)) * 5
    y = np.array([rng.choice(3, p=np.exp(r / 5) / np.exp(r / 5).sum()) for r in s])
    assert 3 < langid.calibrate(s, y) < 8


def test_language_is_learned_from_whole_texts(spark):
    head = "xyz " * 5001
    rows = [(i, head + ("abab baba " if i % 2 else "cdcd dcdc ") * 50, "aa" if i % 2 else "cc") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.classify("baba abab", model)[0] == "aa" and langid.classify("dcdc cdcd", model)[0] == "cc"


# --- 7 decontamination ----------------------------------------------------------------------

ITEM = "Anna Berg buys 12 pens and Carl Holm buys 30 kg of apples, so how many euros does Anna pay for 12 pens today?"
OTHER = "Mia Lind buys 7 pens and Otto Falk buys 45 kg of apples, so how many euros does Mia pay for 7 pens today?"
BROKEN = "Mia Lind buys 7 pens and Otto Falk buys 45 kg of apples, so how many euros does Eva pay for 9 pens today?"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_templates(spark, corpus):
    docs = corpus([(1, f"some words before. {ITEM} and after"), (2, f"Intro.\n{OTHER}"), (3, BROKEN), (4, "nothing of the kind here at all, just some plain words in a row"), (5, None), (None, ITEM.lower())])
    found = {r.doc_id: r.share for r in decontam.matches(docs, bench(spark, [(10, ITEM), (11, None), (12, ""), (13, "too short")])).collect()}
    assert 1 in found and 2 in found and 4 not in found and 5 not in found
    assert found[1] > 0.9 and found[2] > 0.9 and 3 not in found
    kept = decontam.clean(docs, bench(spark, [(10, ITEM)]))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5} and 1 not in {r.doc_id for r in kept.collect()}


def test_items_of_few_literals_are_found_as_they_stand(spark, corpus):
    items = [(1, "Solve 3 x 4 + 5 x 6"), (2, "What is 12 + 35 - 7 * 2?"), (3, "Anna Berg Carl Holm Mia Lind Otto Falk Eva Dahl Nils Krog Ida Moe")]
    docs = [(i, f"We went on and {t} was there") for i, t in items] + [(4, "We went on and Solve 9 x 8 + 7 x 1 was there"), (5, "What is 13 + 36 - 8 * 3?")]
    assert {(r.doc_id, r.item_id, r.share) for r in decontam.matches(corpus(docs), bench(spark, items)).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)}


def test_copies_are_found_whatever_their_case_and_context(spark, corpus):
    short = "What did Anna buy? The pens were blue. In May Carl paid. Then Otto went home."
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, f"He asked What it was and The man said In short Then no. {short} More of it."), (4, BROKEN.lower()), (5, "STRASSE " + ITEM.upper())]
    found = {(r.doc_id, r.item_id): r.share for r in decontam.matches(corpus(docs), bench(spark, [(10, ITEM), (11, short), (12, "straße")])).collect()}
    assert found == {(1, 10): 1.0, (2, 10): 1.0, (3, 11): 1.0, (5, 10): 1.0, (5, 12): 1.0}


def test_benchmark_passages_are_found(spark, real):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.sub(r"[^\w\s]", "", t.lower()).split()) + " "
    b = {r.item_id: norm(r.text) for r in items.collect()}
    want = {(i, k) for i, t in texts(real).items() for k, v in b.items() if v in norm(t)}
    assert {(r.doc_id, r.item_id) for r in decontam.matches(real, items).collect()} == want and want


def test_decontam_empty(spark, odd):
    assert decontam.matches(odd, bench(spark, [])).count() == 0 and decontam.matches(odd.limit(0), bench(spark, [(1, ITEM)])).count() == 0
    assert decontam.clean(odd, bench(spark, [])).count() == 10


# --- 8 substring dedup ----------------------------------------------------------------------


def brute_removal(rows, span):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + span]) for _, w in words for k in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - span + 1) if count[tuple(w[k : k + span])] > 1 for j in range(k, k + span)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removal(df, **how):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df, **how).collect()), key=repr)


def test_substrings_of_real_texts(real):
    assert removal(real) == brute_removal(list(texts(real).items()), 35)


def few_words(seed):
    """Passages of few different words in ever new surroundings."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(4, 20))] for _ in range(5)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, gram, group_limit", [(0, 3, 64), (1, 3, 1), (2, 3, 4), (3, 4, 64), (4, 7, 64), (5, 1, 3)])
def test_substrings_of_few_words(corpus, seed, gram, group_limit):
    rows = few_words(seed)
    assert removal(corpus(rows), span=7, gram=gram, group_limit=group_limit) == brute_removal(rows, 7)


@pytest.mark.parametrize("group_limit", [64, 2])
def test_substrings_compare_words(corpus, monkeypatch, group_limit):
    """Words whose hashes collide are still told apart."""
    of = substring_dedup.word_hashes
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda whole: of(whole) & np.uint64(1))
    rows = few_words(9)
    assert removal(corpus(rows), span=7, gram=3, group_limit=group_limit) == brute_removal(rows, 7)


def test_greedy_factors():
    """The longest run from the leftmost word on; the next is looked for span - 1 words before its end."""

    def block(words, anchor, n=1, first=0):
        return {"words": words.encode(), "first": first, "at": first + words.split().index(anchor), "n": n}

    group = [block("a b c M d e f g h", "M", first=10), block("b c M d e f x", "M"), block("a b c M d y", "M"), block("z M d e f g h", "M", n=2), block("q M r", "M")]
    factors = substring_dedup.greedy_factors(group, 5)
    assert [(a, b) for i, a, b in factors if i == 0] == [(10, 10), (11, 12), (13, 14)]  # abcMd, bcMdef, Mdefgh
    assert {i for i, _, _ in factors} == {0, 1, 2}
    assert substring_dedup.greedy_factors(group[3:], 3) == []


def test_substrings_odd(odd):
    assert removal(odd) == brute_removal([(r.doc_id, r.text) for r in odd.collect()], 35)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert substring_dedup.cleaned_texts(odd).first().n_removed > 0  # the long text repeats itself


# --- 9 url filter ---------------------------------------------------------------------------

URLS = [
    ("http://A.example.org/es/x?q=1", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org/p", "x.org", "/p", "org/", "allow"), ("http://shop.com/fr/1", "shop.com", "/fr/1", "com/fr/", "allow"), ("ftp://shop.com/de/", "shop.com", "/de/", "com/de/", "block"),
    ("http://shop.com", "shop.com", "", None, "allow"), ("shop.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://com/de/1", "com", "/de/1", "com/de/", "block"), ("http://a.com?x=/de/", "a.com", "", None, "allow"), ("", "", "", None, "allow"), ("x://y://z/p", "y:", "//z/p", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] + [(0, URLS[0][0], None)], "page_id long, url string, host string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert tuple(r)[1:] == URLS[r.page_id][1:]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates(spark):
    rules = (("block", "bad.net", "/ads/1"), ("allow", "bad.net", "/news/"))
    urls = [f"http://bad.net/ads/{100 + i}" for i in range(60)] + [f"http://bad.net/news/{i}" for i in range(60)]
    urls += [f"http://bad.net/ads/{200 + i}" for i in range(5)] + ["http://bad.net/shop/7"]
    v = {r.path: r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert v["/ads/203"] == "block" and v["/shop/7"] == "allow" and v["/news/9"] == "allow"


def test_url_sections_of_a_large_host_are_judged_as_those_of_a_small_one(spark):
    few = [f"http://few.com/de/{i}" for i in range(40)] + [f"http://few.com/{s}/{i}" for s in ("news", "shop") for i in range(40)]
    many = [f"http://many.com/de/{i}" for i in range(40)] + [f"http://many.com/section-{k}/{i}" for k in range(120) for i in range(40)]
    many += [f"http://more.com/{s}/{i}" for s in ("fr", "de") for i in range(40)] + [f"http://more.com/section-{k}/{i}" for k in range(120) for i in range(40)]
    v = {(r.host, r.path): r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(few + many)), "page_id long, url string")).collect()}
    assert all(verdict == ("block" if path.startswith("/de/") else "allow") for (_, path), verdict in v.items())


# --- 10 license scan ------------------------------------------------------------------------


def test_license_base(real, odd):
    for r in license_scan.scan(real).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts(real)[r.doc_id]))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} or not labels
    assert license_scan.scan(odd).count() == 10 and license_scan.scan(odd.limit(0)).count() == 0


def test_license_diagonals(corpus):
    grant = dict(license_scan.TEMPLATES[::-1])["isc"].split()
    near = [w if i != 9 else "whatever" for i, w in enumerate(grant)]
    part = grant[: len(grant) // 2]
    docs = corpus([(1, "x y " + " ".join(grant) + " z"), (2, " ".join(near)), (3, " ".join(grant[:12] + ["really"] + grant[12:])), (4, " ".join(part)), (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0.")])
    rows = defaultdict(list)
    for r in license_scan.scan(docs).collect():
        rows[r.doc_id].append((r.labels, round(r.score, 2)))
    assert rows[1] == [("isc", 1.0)] and rows[2][0][0] == "isc" and rows[2][0][1] >= 0.8 and rows[3][0] == ("isc", 1.0)
    assert rows[4] == [("", 0.0)] and rows[5] == [("cc-by-nc", 1.0)] * 2
