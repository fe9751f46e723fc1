"""Prefix trie of conversations: global range sort, adjacent common prefixes, a stack sweep.

Turns become 16-byte keys (SHA-256 of role and text, cut) and their lengths; texts do not move.
A turn that no other conversation has at its place ends what a conversation can share. Up to
that turn its keys form one array; all behind it is a chain with one member, made directly.

The arrays are sorted by range over all partitions, equal ones by id. A pass over each partition
takes the common prefix with the array before, closes the nodes below it and opens new ones: the
stack holds the nodes on the path of the present array. Nodes that lie inside a partition are
complete. Those on the path of its first or last array can go on in its neighbours: their parts
are added up by node, less what the two sides of each boundary both counted.

No conversation is gathered: places are numbered in the partitions of a sort by id and turn, and
only what is shared becomes an array. The ids that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import columns, cut

#: Every conversation begins with turns of the first of its GROUP, at most HEADS - 1 of them.
GROUP = 100
HEADS = 6
KEY = 16
#: Rows of an output batch, and ids of a fragment of a list that goes on in another partition.
BATCH = 4096
#: A node with more than 1 / WIDE of all nodes as children is broadcast to them.
WIDE = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Rows of the sweep. kind n: a complete node; o: a part of a node; c: what both sides of a boundary counted;
#: e: a fragment of the ids that end at a node, seq its place; f, l: a partition's first and last array.
SWEPT = "kind string, node binary, above binary, part long, seq long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, own boolean, keys binary, lens binary"
_SWEPT = pa.schema([("kind", pa.string()), ("node", pa.binary()), ("above", pa.binary()), *[(c, pa.int64()) for c in ("part", "seq", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                    ("ends_sha256", pa.string()), ("own", pa.bool_()), ("keys", pa.binary()), ("lens", pa.binary())])


def heads_of(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("long")


# --- rebuilt conversations -------------------------------------------------------------------


def _keyed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key, chars of the turns; a turn's key tells role and text apart from all others."""
    rows = columns(conversations, "conv_id long, turn long, role string, text string").where(F.col("conv_id").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return rows.select("conv_id", "turn", F.unhex(F.substring(digest, 1, 2 * KEY)).alias("key"), F.length(text).cast("long").alias("chars"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, key, chars) and conversations (conv_id, turns) as rebuilt.

    Turns of a conversation are ordered by turn, null first, those of one turn by key. Places
    come from the row's number in a partition of the sorted table, so no task numbers a whole
    conversation; equal turns are told apart by a number of their own.
    """
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("key").asc(), F.col("salt").asc()]
    turns = _keyed(conversations).withColumn("salt", F.monotonically_increasing_id()).orderBy(*order)
    turns = turns.select("conv_id", "key", "chars", F.monotonically_increasing_id().alias("at"))
    turns = cut(turns.withColumn("part", F.shiftright("at", 33)), "turns")
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    by_conv = Window.partitionBy("conv_id")  # a row for each partition that holds the conversation
    before = F.coalesce(F.sum("n").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "part", (F.col("first") - before).alias("zero"), F.sum("n").over(by_conv).alias("own"))
    runs = runs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", heads_of(F.col("conv_id")))
    runs = cut(runs, "runs")
    bases = runs.where(F.col("conv_id") == F.col("base")).groupBy("base").agg(F.first("own").alias("base_turns"))
    runs = runs.join(bases, "base", "left").withColumn("borrowed", F.least("h", F.coalesce("base_turns", F.lit(0))))
    # (conv_id, part): no key holds more than a partition
    placed = cut(turns.join(runs.select("conv_id", "part", "zero", "h", "base", "borrowed"), ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("zero")), "placed")
    own = placed.where("place >= h").select("conv_id", (F.col("borrowed") + F.col("place") - F.col("h")).alias("place"), "key", "chars")
    whole = runs.groupBy("conv_id").agg(F.first("base").alias("base"), F.first("h").alias("h"), F.first("borrowed").alias("borrowed"), F.first("own").alias("own"))
    first = placed.where((F.col("conv_id") == F.col("base")) & (F.col("place") < HEADS - 1)).select("base", "place", "key", "chars")
    lent = first.join(whole.select("conv_id", "base", "h"), "base").where("place < h").select("conv_id", "place", "key", "chars")
    total = F.col("borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return cut(own.unionByName(lent), "rebuilt"), cut(whole.select("conv_id", total.alias("turns")), "conversations")


# --- arrays and their sweep ------------------------------------------------------------------


def _shared(turns: DataFrame) -> DataFrame:
    """conv_id, alone: the first place where no other conversation has the same turn."""
    single = turns.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"), F.first("conv_id").alias("conv_id")).where("n = 1")
    return single.groupBy("conv_id").agg(F.min("place").alias("alone"))


def _arrays(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrays (keys, lens, conv_id, more: turns follow that nobody shares) and the turns behind them."""
    known = convs.join(_shared(turns), "conv_id", "left")
    # a key for every 4096 places, so that a long conversation's turns meet their limit in many tasks
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("greatest(turns - 1, 0) div 4096")))
    limits = known.select("conv_id", "turns", "alone", spread.alias("stretch"))
    rows = turns.withColumn("stretch", F.expr("place div 4096")).join(limits, ["conv_id", "stretch"])
    rows = cut(rows.drop("stretch"), "limited")
    behind = rows.where("place > alone")
    parts = F.array_sort(F.collect_list(F.struct("place", "key", "chars")))
    arrays = rows.where("alone is null or place <= alone").groupBy("conv_id").agg(parts.alias("p"))
    arrays = known.join(arrays, "conv_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<place:long,key:binary,chars:long>>")))
    more = F.coalesce(F.col("turns") > F.col("alone") + 1, F.lit(False))
    hexed = lambda of: F.unhex(F.array_join(F.transform("p", of), ""))
    return arrays.select(hexed(lambda t: F.hex(t["key"])).alias("keys"), hexed(lambda t: F.lpad(F.hex(t["chars"]), 16, "0")).alias("lens"), "conv_id", more.alias("more")), behind


def common_prefix(a: bytes, b: bytes) -> int:
    """Keys that two arrays share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    lo, hi = 0, n // KEY  # the first lo keys agree, the first hi do not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo * KEY : mid * KEY] == b[lo * KEY : mid * KEY] else (lo, mid)
    return lo


def below(node: bytes, key: bytes) -> bytes:
    """Name of the node reached from `node` by a turn."""
    return hashlib.sha256(node + key).digest()[:KEY]


class _Node:
    """An open node: what the arrays so far say of it."""

    __slots__ = ("chars", "child", "children", "ends", "first", "leaves", "least", "name", "saved", "sha", "start")

    def __init__(self, name: bytes, chars: int, start: int, first: bool) -> None:
        self.name, self.chars, self.start, self.first = name, chars, start, first
        self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: array | None = None  # ids that end here, while they still come
        self.sha = NO_ENDS
        self.child = False


class _Sweep:
    """One partition's arrays in order; rows as in SWEPT."""

    def __init__(self, part: int) -> None:
        self.part, self.at, self.seq = part, 0, 0
        self.stack: list[_Node] = []
        self.last: tuple[bytes, bytes] | None = None
        self.rows: list[dict] = []

    def _row(self, kind: str, **values) -> None:
        self.rows.append(dict.fromkeys(_SWEPT.names) | {"kind": kind, "part": self.part} | values)

    def _settle(self, depth: int, final: bool) -> None:
        """No more ids end at the node: their hash, or fragments where neighbours may hold more."""
        node = self.stack[depth]
        if node.ends is None:
            return
        if node.first or final:
            for i in range(0, len(node.ends), BATCH):
                self._row("e", node=node.name, depth=depth, seq=self.seq, keys=",".join(map(str, node.ends[i : i + BATCH])).encode())
                self.seq += 1
        else:
            node.sha = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        node.ends = None

    def _close(self, final: bool, kept: int = -1) -> None:
        """Takes the deepest node off; nodes down to `kept` stay open."""
        depth = len(self.stack) - 1
        self._settle(depth, final)
        node = self.stack.pop()
        n = self.at - node.start
        leaves = node.leaves if node.children else 1
        saved = node.saved + (n - 1) * node.chars
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up.leaves += leaves
            up.saved += saved
            up.least = node.least if up.least is None else min(up.least, node.least)
        values = {"node": node.name, "above": up.name if up else None, "conv_id": node.least, "depth": depth, "n_convs": n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.sha}
        # a parent that closes with one member has the child's id; any other is looked up by name
        self._row("o" if node.first or final else "n", own=not final and depth - 1 > kept and not up.first and self.at - up.start == 1, **values)

    def add(self, keys: bytes, lens: bytes, conv_id: int, more: bool) -> None:
        if self.last is None:
            self._row("f", keys=keys, lens=lens)
            self.stack.append(_Node(b"", 0, 0, True))
            shared = 0
        else:
            shared = common_prefix(self.last[0], keys)
            while len(self.stack) - 1 > shared:
                self._close(False, shared)
            if shared < len(keys) // KEY:
                self._settle(shared, False)
        for d in range(shared, len(keys) // KEY):
            up = self.stack[-1]
            up.children += 1
            chars = int.from_bytes(lens[8 * d : 8 * d + 8], "big")
            self.stack.append(_Node(below(up.name, keys[KEY * d : KEY * d + KEY]), chars, self.at, self.last is None))
        top = self.stack[-1]
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if more:
            top.children, top.leaves = 1, 1  # the chain behind
        else:
            top.ends = array("q") if top.ends is None else top.ends
            top.ends.append(conv_id)
        self.last = (keys, lens)
        self.at += 1

    def end(self) -> None:
        if self.last is not None:
            self._row("l", keys=self.last[0], lens=self.last[1])
            while self.stack:
                self._close(True)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=_SWEPT)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = None
    for batch in batches:
        for part, keys, lens, conv_id, more in zip(*[batch.column(c).to_pylist() for c in ("part", "keys", "lens", "conv_id", "more")], strict=True):
            sweep = sweep or _Sweep(part)
            sweep.add(keys, lens, conv_id, more)
            if len(sweep.rows) >= BATCH:
                yield sweep.batch()
    if sweep is not None:
        sweep.end()
        yield sweep.batch()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Between each partition's last array and the next one's first: what both sides counted of the nodes they share."""
    last = None
    for batch in batches:
        out = []
        for kind, keys, lens in zip(*[batch.column(c).to_pylist() for c in ("kind", "keys", "lens")], strict=True):
            if kind == "l":
                last = keys
                continue
            if last is None:
                continue
            shared = common_prefix(last, keys)
            chars = [0, *[int.from_bytes(lens[8 * d : 8 * d + 8], "big") for d in range(shared)]]
            left, name = sum(chars), b""
            for d in range(shared + 1):
                if d:
                    name = below(name, keys[KEY * (d - 1) : KEY * d])
                # each side has saved one copy too few of these turns, counted the child they share,
                # and, where the left array ends, a leaf that the right side counts or continues
                out.append(dict.fromkeys(_SWEPT.names) | {"kind": "c", "node": name, "depth": d, "saved_tokens": left, "n_children": -int(d < shared), "n_leaves": -int(len(last) // KEY == shared)})
                left -= chars[d]
        yield pa.RecordBatch.from_pylist(out, schema=_SWEPT)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the fragments of each node, which come in order; one fragment in memory."""
    key, sha = None, None
    names = ["depth", "node", "listed"]

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([sha.hexdigest()])], names=names)

    for batch in batches:
        for depth, node, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "node", "keys")], strict=True):
            if (depth, node) != key:
                if key is not None:
                    yield done()
                key, sha = (depth, node), hashlib.sha256(text)
            else:
                sha.update(b"," + text)
    if key is not None:
        yield done()


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: the columns of NODE.

    Null roles and texts count as empty; a turn whose number is null comes first; turns of equal
    number are ordered by their key, so any order of rows gives the same trie. Rows without a
    conv_id belong to no conversation and are left out. A conversation of which nothing is left
    ends at the root. Long conversations and long texts are taken whole, repeated rows are turns
    each. An empty table gives an empty result: no root without members. Extra columns are
    ignored, whatever their names.
    """
    common.prepare(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    arrays, behind = _arrays(turns, convs)
    ordered = arrays.orderBy("keys", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    swept = cut(ordered.mapInArrow(_sweep, SWEPT), "swept")
    edges = swept.where("kind in ('f', 'l')").select("kind", "part", "keys", "lens")
    # two arrays of each partition
    stitched = edges.repartition(1).sortWithinPartitions("part", "kind").mapInArrow(_stitch, SWEPT)
    add = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    parts = swept.where("kind = 'o'").unionByName(stitched).groupBy("depth", "node")
    # the parts of a node lie in consecutive partitions
    ended = F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256")))
    joined = parts.agg(F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), *add.values(), ended.alias("ends"))
    lists = swept.where("kind = 'e'").select("depth", "node", "part", "seq", "keys").repartition("depth", "node").sortWithinPartitions("depth", "node", "part", "seq")
    lists = lists.mapInArrow(_hash_lists, "depth long, node binary, listed string")
    joined = joined.join(lists, ["depth", "node"], "left").withColumn("ends_sha256", F.coalesce("listed", "ends", F.lit(NO_ENDS)))
    out = ["node", "above", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "own"]
    every = cut(joined.withColumn("own", F.lit(False)).select(*out).unionByName(swept.where("kind = 'n'").select(*out)), "nodes")
    # parents: a root, an only child's own id, or by name
    root = every.where("depth = 0").select("conv_id").first()
    parents = every.where("depth > 0 and n_children > 0 and not own").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv_id").alias("parent"), "n_children")
    deep, many = every.where("depth > 1 and not own"), F.col("n_children") > every.count() // WIDE
    # fewer than WIDE nodes can have so many children: they are broadcast, and their children stay where they are
    wide = F.broadcast(parents.where(many).drop("n_children"))
    narrow = parents.where(~many).drop("n_children")
    deep = deep.join(wide, ["depth", "above"]).unionByName(deep.join(wide, ["depth", "above"], "left_anti").join(narrow, ["depth", "above"]).select(*deep.columns, "parent"))
    near = every.where("depth <= 1 or own").withColumn("parent", F.when(F.col("own"), F.col("conv_id")).when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")))
    names = [c.split()[0] for c in NODE.split(", ")]
    shared = deep.unionByName(near, allowMissingColumns=True).withColumnRenamed("parent", "parent_conv_id").select(*names)
    one, last = F.lit(1).cast("long"), F.col("place") + 1 == F.col("turns")
    chain = behind.select(
        "conv_id", (F.col("place") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return shared.unionByName(chain)
