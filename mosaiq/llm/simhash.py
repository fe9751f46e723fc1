"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most four
bits differ in at most four bytes, so they share at least four positional bytes: that is the
guaranteed minimum of matches. Posting lists of single bytes would each hold 1/256 of the
corpus; the index instead posts groups of positions. The twenty triples of TRIPLES form a
covering system: every set of four of the eight positions contains one of them, so each pair
with four shared bytes meets in at least one posting list. For each pair that meets, the shared
positional bytes are tallied, pairs below the minimum are dropped, and the rest are verified on
their differing bits.

Posting lists longer than `pair_limit` are never paired. They are split by a fourth shared byte
(one must exist), and lists that are still long after that are linked through midpoints: two
fingerprints at distance <= 4 have a common point within two bit flips of either, and all that
meet in such a point are at distance <= 4. Each member sends a fixed number of rows, so the work
stays linear however large a group is; no link is lost.

Components come from alternating star contraction over scratch tables; nothing is collected.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ASCII_LOWER, cut, id_text

#: Bits of the filter that keeps rows without near-duplicates out of the last joins.
FILTER_BITS = 1 << 26
MAX_BITS = 4
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS


def _covering() -> list[tuple[int, ...]]:
    """Triples of the 8 positions such that each 4 positions hold one (Turan's construction).

    The positions fall in three parts; taken are the triples within a part and those with two
    positions in one part and one in the next.
    """
    part = {p: p % 3 for p in range(BYTES)}
    chosen = []
    for t in itertools.combinations(range(BYTES), 3):
        count = [sum(part[p] == k for p in t) for k in range(3)]
        if 3 in count or any(count[k] == 2 and count[(k + 1) % 3] == 1 for k in range(3)):
            chosen.append(t)
    return chosen


TRIPLES = _covering()
#: Bit masks of up to two flips inside the four bytes not shared.
FLIPS = [0] + [1 << i for i in range(32)] + [1 << i | 1 << j for i in range(32) for j in range(i)]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text as a signed 64-bit integer; zero for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends[: len(words) - width + 1] - [len(w) + 1 for w in words[: len(words) - width + 1]]).tolist()
        shingles = [whole[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounds the unpacked bits of very long texts
        part = hashes[i : i + (1 << 15)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())],
            names=["doc_id", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row."""
    common.prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _group(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
    return key


def _shared(a: Column, b: Column) -> Column:
    differing = a.bitwiseXOR(b)
    return sum((_byte(differing, p) == 0).cast("int") for p in range(1, BYTES)) + (_byte(differing, 0) == 0).cast("int")


def _long_lists(postings: DataFrame, limit: int, name: str) -> DataFrame:
    return cut(postings.groupBy("key").count().where(F.col("count") > limit).select("key"), name)


def _pairs(postings: DataFrame) -> DataFrame:
    """Verified pairs u < v of the postings' lists, each of bounded length."""
    a, b = postings.select("key", F.col("fp").alias("u")), postings.select("key", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    near = (u < v) & (_shared(u, v) >= MIN_SHARED) & (F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS)
    return a.join(b, (a["key"] == b["key"]) & near).select("u", "v")


def links(distinct: DataFrame, pair_limit: int = 256) -> DataFrame:
    """Links u, v between different fingerprints (column fp, distinct) that span every component.

    Lists of at most pair_limit members give all their pairs; longer ones give each member's
    link to the smallest member of each midpoint it reaches.
    """
    fp = F.col("fp")
    postings = distinct.select("fp", F.explode(F.array(*[_group(fp, n, t) for n, t in enumerate(TRIPLES)])).alias("key"))
    long3 = _long_lists(postings, pair_limit, "long3")
    out = _pairs(postings.join(long3, "key", "left_anti"))
    if long3.isEmpty():
        return out
    quads = list(itertools.combinations(range(BYTES), 4))
    inside = [[n for n, q in enumerate(quads) if set(t) <= set(q)] for t in TRIPLES]
    number = F.shiftright(F.col("key"), 24)
    deeper = postings.join(long3, "key", "left_semi").select(
        "fp", F.explode(F.element_at(F.array(*[F.array(*[_group(fp, n, quads[n]) for n in own]) for own in inside]), (number + 1).cast("int"))).alias("key")
    )
    deeper = cut(deeper.distinct(), "deeper")
    long4 = _long_lists(deeper, pair_limit, "long4")
    out = out.unionByName(_pairs(deeper.join(long4, "key", "left_anti")))
    if long4.isEmpty():
        return out
    rest = F.element_at(
        F.array(*[_group(fp, 0, tuple(p for p in range(BYTES) if p not in q)) for q in quads]), (F.shiftright(F.col("key"), 32) + 1).cast("int")
    )
    points = deeper.join(long4, "key", "left_semi").select(
        "fp", "key", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in FLIPS]), lambda m: rest.bitwiseXOR(m))).alias("point")
    )
    points = points.where(F.col("fp").isNotNull())
    least = cut(points.groupBy("key", "point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "midpoints")
    stars = points.join(least, ["key", "point"]).where("u < fp").select("u", F.col("fp").alias("v"))
    return out.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected edges (u, v); root is the component's least node.

    Alternates large-star and small-star contraction until the edges no longer change, however
    many rounds that takes (about the square of the logarithm of the longest chain).
    """
    now = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("low")).distinct(), "edges"
    )
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = now.select("node", F.col("low").alias("other")).unionByName(now.select(F.col("low").alias("node"), F.col("node").alias("other")))
        least = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least")), "large")
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("low"))
        large = cut(large.where("node <> low").distinct(), "star")
        # small star: a node's smaller neighbours and itself are linked to the least of them
        least = cut(large.groupBy("node").agg(F.min("low").alias("least")), "small")
        small = large.join(least, "node").select(F.col("low").alias("node"), F.col("least").alias("low")).unionByName(least.select("node", F.col("least").alias("low")))
        now = cut(small.where("node <> low").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select("node", F.col("low").alias("root"))


def group_by_fingerprint(prints: DataFrame, pair_limit: int = 256) -> DataFrame:
    """fp, root (the group's least fingerprint) and component_id for each different fingerprint of prints (doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    roots = components(links(distinct.select("fp"), pair_limit))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    member = cut(member, "members")
    least = cut(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "roots")
    return cut(member.join(least, "root").select("fp", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame, pair_limit: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text has no words and so fingerprint zero, linked like any other; a very long
    one is read whole. Rows with a null doc_id get their group's smallest doc_id (null if it has
    none). Repeated rows are kept. An empty table gives an empty result; further columns of docs
    are ignored, whatever their names.
    """
    prints = cut(fingerprints(docs), "docprints")
    groups = group_by_fingerprint(prints, pair_limit)
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key: the id and two hashes of the whole text, told apart from its own columns by being a struct named so."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")).alias("key"))


def _key_prints(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())], names=["key", "fp"])


def _parted(keyed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed in two: rows whose key is surely none of found's, which need no join, and the rest, which may be.

    A bitmap of FILTER_BITS hashed keys tells them apart: 8 MB whatever the tables hold, so it is
    broadcast. The more keys there are the more rows are asked needlessly; none is missed.
    """
    number = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(FILTER_BITS)) + 1
    bits = found.select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("at"))
    bits = cut(bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "filter")
    marked = keyed.withColumn("bucket", F.bitmap_bucket_number(number)).withColumn("at", F.bitmap_bit_position(number)).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False))
    return marked.where(~hit).select("row", "key"), marked.where(hit).select("row", "key")


def keep_one(docs: DataFrame, pair_limit: int = 256) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id.

    Rows with a null doc_id come last in their group; among rows alike in doc_id the one with the
    least fingerprint and text hash stays, among rows alike in text too the one whose columns as
    JSON come first. Null and empty texts have fingerprint zero and are one group. Very long texts
    are read whole. An empty table gives an empty result; all columns stay, whatever their names.
    """
    common.prepare(docs.sparkSession)
    keyed = _keyed(docs)
    prints = cut(keyed.select("key", F.col("row.text").cast("string").alias("text")).mapInArrow(_key_prints, "key struct<id:long,h1:long,h2:long>, fp long"), "docprints")
    groups = group_by_fingerprint(prints.select(F.col("key.id").alias("doc_id"), "fp"), pair_limit)
    where = prints.groupBy("key", "fp").agg(F.count(F.lit(1)).alias("n")).join(groups, "fp")
    # the least key of each component, null ids last; a component without ids goes by its least fingerprint
    first = F.struct(F.col("key.id").isNull().alias("none"), F.col("key.id").alias("id"), "fp", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))
    where = cut(where.select("key", "n", "root", first.alias("first")), "keys")
    winner = where.groupBy("root").agg(F.min("first").alias("least"))
    settled = where.join(winner, "root").select("key", "n", (F.col("first") == F.col("least")).alias("wins"))
    out = cut(settled.where("not wins or n > 1").select("key", "wins"), "losers")
    sure, asked = _parted(keyed, out.select("key"))
    stay = asked.join(out.select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_anti").select("row")
    repeated = asked.join(out.where("wins").select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_semi")
    one = repeated.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return sure.select("row").unionByName(stay).unionByName(one).select("row.*")
