"""Exact substring deduplication by relative Lempel-Ziv parsing over anchored reference blocks.

Every window of `span` consecutive words holds one anchor: the leftmost of its `gram`-word runs
with the least hash. The choice depends on the window's words alone, so equal windows have equal
anchors wherever they stand. The windows that share an anchor occurrence form its block, the
stretch of text they cover (at most 2 * span - gram words).

* Index: the blocks of all documents, under their anchors. Copies of a block collapse to one
  reference block with a count; a document's block that the index holds more than once is one
  factor in full, and neighbouring ones join into a longer one.
* Parsing: every other block is factored against all reference blocks under its anchor. From the
  leftmost word on, the longest run of words that starts there and goes on alike in any one
  reference block is a factor, found by comparing word with word to both sides of the anchor. A
  run below `span` words is none, and the next word is tried.
* Factor boundaries: after a factor the parse goes on `span` - 1 words before its end, so a
  repeat that crosses the boundary between two factors is found too.

An equal window reaches half of what lies around the anchor on one side at least, so blocks meet
under the anchor and that many words to its left, and again to its right. Only those that meet
there are parsed, at most `group_limit` together; blocks that more share, such as a common line
in ever new surroundings, have each single window looked up by its digest instead, which settles
the same question in linear time, whatever the number.

Factors are at least `span` words long; the words they cover are removed. Digests are 96 bits of
BLAKE2b over the words themselves. Hot passages collapse before the shuffle (partial counts by
block), so no task sees all their copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, id_text, may_match, rolling, span_hash, word_hashes

SPAN = 35
GRAM = 8
#: Blocks that are compared word by word in one group; more are looked up window by window.
GROUP_LIMIT = 64
_LEFT, _RIGHT = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _cuts(whole: bytes) -> np.ndarray:
    """Where each word of single-spaced words starts, and where one more would."""
    blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    return np.concatenate(([0], blanks + 1, [len(whole) + 1]))


def _digests(whole: bytes, cuts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """96 bits of each run of words starts[i]:ends[i]."""
    runs = zip(cuts[starts].tolist(), (cuts[ends] - 1).tolist(), strict=True)
    found = b"".join([hashlib.blake2b(whole[a:b], digest_size=12).digest() for a, b in runs])
    return np.frombuffer(found, np.dtype([("d1", "<i8"), ("d2", "<i4")]))


def _blocks(hashes: np.ndarray, span: int, gram: int):
    """Anchor hash, first and last window start of each block of one document, in order."""
    grams = rolling(hashes, gram)
    width = span - gram + 1
    windows = len(hashes) - span + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, width)[:windows]
    if windows * width > 1 << 21:  # very long texts: bound the argmin's reads
        at = np.concatenate([best[i : i + (1 << 16)].argmin(axis=1) for i in range(0, windows, 1 << 16)])
    else:
        at = best.argmin(axis=1)
    at = at + np.arange(windows)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [windows - 1]))
    return grams[at[first]], first, last


def _key(text: Column) -> list[Column]:
    """Two integers of 60 bits each from the SHA-256 of a text; a null text counts as empty."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"k{i + 1}") for i in range(2)]


def _table(span: int, gram: int):
    def run(batches):
        for batch in batches:
            n_words, kept, lists = [], [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                whole = b" ".join(words)
                kept.append(hashlib.sha256(whole).hexdigest())
                n_words.append(len(words))
                if len(words) < span:
                    lists.append(None)
                    continue
                h = word_hashes(whole)
                anchor, first, last = _blocks(h, span, gram)
                digest = _digests(whole, _cuts(whole), first, last + span)
                lists.append((anchor, digest["d1"], digest["d2"], first, last))
            full = [x for x in lists if x is not None]
            sizes = np.array([0 if x is None else len(x[0]) for x in lists], np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)

            def column(i, kind):
                flat = np.concatenate([x[i] for x in full]) if full else np.empty(0, kind)
                return pa.array(flat.view(kind) if flat.dtype == np.uint64 else flat.astype(kind))

            struct = pa.StructArray.from_arrays(
                [column(i, kind) for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32))],
                names=["anchor", "b1", "b2", "first", "last"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array(n_words, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                ],
                names=["doc_id", "k1", "k2", "n_words", "all_sha256", "blocks"],
            )

    return run


TABLE = "doc_id long, k1 long, k2 long, n_words long, all_sha256 string, blocks array<struct<anchor:long,b1:long,b2:int,first:int,last:int>>"


SIDES = "key long, k1 long, k2 long, first int, last int, at int, n int, words binary"


def _sides(span: int, gram: int):
    """The blocks of each document, once under the words to the left of their anchor, once under those to the right."""
    half = (span - gram + 1) // 2

    def run(batches):
        for batch in batches:
            rows, words = [], []
            for i, (text, blocks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("open").to_pylist(), strict=True)):
                whole = b" ".join(_words(text))
                h, cuts = word_hashes(whole), _cuts(whole)
                first, last, n = (np.array([x[c] for x in blocks], np.int64) for c in ("first", "last", "n"))
                at = first + np.lib.stride_tricks.sliding_window_view(rolling(h, gram), span - gram + 1)[first].argmin(axis=1)
                for begin, end, salt in ((at - half, at + gram, _LEFT), (at, at + gram + half, _RIGHT)):
                    ok = np.flatnonzero((begin >= first) & (end <= last + span))
                    key = span_hash(h, begin[ok], end[ok], salt).view(np.int64)
                    rows.append((np.full(len(ok), i), key, first[ok], last[ok], at[ok], np.minimum(n[ok], 2)))
                    words += [whole[a:b] for a, b in zip(cuts[first[ok]].tolist(), (cuts[last[ok] + span] - 1).tolist(), strict=True)]
            if rows:
                of, key, *numbers = (np.concatenate(x) for x in zip(*rows, strict=True))
                of = pa.array(of)
                columns = [pa.array(key), batch.column("k1").take(of), batch.column("k2").take(of), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SIDES.split(", ")])

    return run


def greedy_factors(variants: list[dict], span: int) -> list[tuple[int, int, int]]:
    """Factors of the blocks that the index holds once, against all others of the group: block, first and last window start.

    A block has its words, the place of their first (`first`) and of the anchor (`at`), and its count (`n`).
    """
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known)) for w in v["words"].split()] for v in variants]
    lead = [v["at"] - v["first"] for v in variants]
    middle = max(lead)
    width = middle + max(len(r) - x for r, x in zip(rows, lead, strict=True))
    words = np.repeat(-1 - np.arange(len(rows))[:, None], width, axis=1)  # outside a block nothing is alike
    for i, (row, x) in enumerate(zip(rows, lead, strict=True)):
        words[i, middle - x : middle - x + len(row)] = row
    factors = []
    for i, v in enumerate(variants):
        if v["n"] > 1:
            continue
        alike = words == words[i]
        alike[i] = False
        left = np.logical_and.accumulate(alike[:, :middle][:, ::-1], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(alike[:, middle:], axis=1).sum(axis=1)
        reach = np.zeros(middle + 1, np.int64)  # how far right of the anchor a run gets that starts so many words left of it
        np.maximum.at(reach, left, right)
        reach = np.maximum.accumulate(reach[::-1])[::-1].tolist()
        before = lead[i]
        while before >= 0:
            if before + reach[before] >= span:
                factors.append((i, v["at"] - before, v["at"] + reach[before] - span))
                before = span - reach[before] - 1
            else:
                before -= 1
    return factors


def _parse_groups(span: int):
    def run(batches):
        for batch in batches:
            out = []
            for variants in batch.column("variants"):
                group = variants.as_py()
                out += [(group[i]["k1"], group[i]["k2"], first, last) for i, first, last in greedy_factors(group, span)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "first", "last"])

    return run


def _windows(span: int):
    """The digest of each window of each block."""

    def run(batches):
        for batch in batches:
            rows = []
            numbers = [batch.column(c).to_pylist() for c in ("first", "last", "n", "words")]
            for i, (first, last, n, words) in enumerate(zip(*numbers, strict=True)):
                starts = np.arange(last - first + 1)
                rows.append((np.full(len(starts), i), _digests(words, _cuts(words), starts, starts + span), starts + first, np.full(len(starts), n)))
            if rows:
                of, digest, start, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
                of = pa.array(of)
                columns = [batch.column("k1").take(of), batch.column("k2").take(of), *(pa.array(np.ascontiguousarray(digest[d])) for d in ("d1", "d2"))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(start.astype(np.int32)), pa.array(weight.astype(np.int64))], names=["k1", "k2", "w1", "w2", "start", "weight"]
                )

    return run


def _cover(n_words: int, factors, span: int) -> np.ndarray:
    """True for the words that the factors (first, last window start) leave."""
    edge = np.zeros(n_words + 1, np.int64)
    for x in factors:
        edge[x["first"]] += 1
        edge[x["last"] + span] -= 1
    return np.cumsum(edge[:-1]) == 0


def _remove(span: int, with_text: bool):
    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, factors in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist(), strict=True):
                words = _words(text)
                left = _cover(len(words), factors, span)
                rest = b" ".join([words[i] for i in np.flatnonzero(left).tolist()])
                removed.append(int(len(words) - left.sum()))
                kept.append(rest.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["k1", "k2", "n_removed", "kept"],
            )

    return run


KEY = ["k1", "k2"]


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (a written table: k1, k2 and more) with the text of each; few texts that are not asked for move, copies once a task."""
    asked = may_match(id_text(docs).select(*_key(F.col("text")), "text"), keys, KEY).join(keys.select(*KEY), KEY)
    return asked.groupBy(*KEY).agg(F.first("text").alias("text")).join(keys, KEY)


def parse(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(table, factors): TABLE's rows, factors (k1, k2, first, last).

    Texts are keyed by their SHA-256, so equal texts share factors. The result is the same for any group_limit.
    """
    common.prepare(docs.sparkSession)
    table = cut(id_text(docs).select("doc_id", *_key(F.col("text")), "text").mapInArrow(_table(span, gram), TABLE), "blocks")
    blocks = table.select(*KEY, F.explode("blocks").alias("b")).select(*KEY, "b.*")
    # reference blocks: copies collapse, map side first; where stands for any one of them
    one = [F.first(c).alias(c) for c in (*KEY, "first", "last")]
    reference = cut(blocks.groupBy("anchor", "b1", "b2").agg(F.count(F.lit(1)).alias("n"), *one), "reference")
    repeated = cut(reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "anchors")
    whole = reference.where("n > 1").select("b1", "b2")
    long_factors = may_match(blocks, whole, ["b1", "b2"]).join(whole, ["b1", "b2"]).select(*KEY, "first", "last")
    # blocks under an anchor with several variants are parsed against those they meet on either side of it
    open_blocks = may_match(reference, repeated, ["anchor"]).join(repeated.select("anchor"), "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "n")).alias("open"))
    sides = cut(texts_of(docs, cut(open_blocks, "open")).select(*KEY, "text", "open").mapInArrow(_sides(span, gram), SIDES), "sides")
    met = cut(sides.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "met")
    few, many = (met.where(c).select("key") for c in (F.col("met") <= group_limit, F.col("met") > group_limit))
    groups = may_match(sides, few, ["key"]).join(few, "key").groupBy("key").agg(F.collect_list(F.struct(*KEY, "first", "at", "n", "words")).alias("variants")).select("variants")
    parsed = groups.mapInArrow(_parse_groups(span), "k1 long, k2 long, first int, last int")
    hot = may_match(sides, many, ["key"]).join(many, "key").groupBy(*KEY, "first", "last", "n").agg(F.first("words").alias("words"))
    windows = cut(hot.mapInArrow(_windows(span), "k1 long, k2 long, w1 long, w2 int, start int, weight long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.where("weight = 1").join(twice, ["w1", "w2"]).select(*KEY, F.col("start").alias("first"), F.col("start").alias("last"))
    return table, long_factors.unionByName(parsed).unionByName(single)


def _removal(docs: DataFrame, span: int, gram: int, group_limit: int, with_text: bool) -> DataFrame:
    table, factors = parse(docs, span, gram, group_limit)
    by_text = cut(factors.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("factors")), "factors")
    cleaned = texts_of(docs, by_text).select(*KEY, "text", "factors")
    cleaned = cut(cleaned.mapInArrow(_remove(span, with_text), "k1 long, k2 long, n_removed long, kept string"), "cleaned")
    return table.select("doc_id", *KEY, "n_words", "all_sha256").join(cleaned, KEY, "left")


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word covered by a window of `span` words whose sequence also starts
    elsewhere in the table. A null or empty text has no words; a text shorter than `span` keeps
    all its words; a very long one is read whole; repeated rows are copies of each other and lose
    all their windows. An empty table gives an empty result; further columns of docs are ignored.
    """
    joined = _removal(docs, span, gram, group_limit, with_text=False)
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "all_sha256").alias("kept_sha256"))


def cleaned_texts(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_removed, kept_text for the rows of docs that lose words."""
    return _removal(docs, span, gram, group_limit, with_text=True).where("n_removed > 0").select("doc_id", "n_removed", F.col("kept").alias("kept_text"))
