"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Sources take weights in turn and share a budget of words, none beyond `most` times what it has.
The words of a source, its documents shuffled by the digest of their id, are cut into blocks of
equal size. A source needs so many slots as its target has blocks. The slots of all sources lie
side by side on a grid of 2^k points (their cumulative weights); van der Corput point n falls on
a place of that grid and so on a source, or beyond the last one, where the slot stays empty. So
each source gets exactly its slots, and in every prefix of the schedule nearly its share. The
r-th slot of a source takes block r modulo its blocks; the last takes only what is still missing.

No task holds a source: documents, points and blocks are numbered in chunks whose offsets are
summed apart. The joins are on source and block, or on source and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, cut

#: The contract's parameters: weights in turn, budget in parts of all words, most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of a block.
BLOCK = 1024
#: Documents of a chunk, about, and points of the grid that meet the sources' intervals at once.
CHUNK_ROWS = 4096
CELL = 256


def _before(over) -> object:
    return over.rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: str, over) -> Column:
    return F.coalesce(F.sum(value).over(_before(over)), F.lit(0))


def _running(df: DataFrame, value: str, to: str, part: str = "part", order: str = "place") -> DataFrame:
    """The sum of value over all rows before, in two levels: within a part and over the parts."""
    sums = df.groupBy(part).agg(F.sum(value).alias("__sum"))
    sums = sums.select(part, _sum_before("__sum", Window.orderBy(part)).alias("__base"))  # a row for each file of the sorted table
    inner = _sum_before(value, Window.partitionBy(part).orderBy(order))
    return df.withColumn(to, inner).join(sums, part).withColumn(to, F.col(to) + F.col("__base")).drop("__base")


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, name (the source, NULL told apart from all others), source, size, digest."""
    rows = columns(docs, "doc_id long, source string, text string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return rows.select("doc_id", name.alias("name"), "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """name, number (by code point, null last), weight, source_size, target; part and place in that order.

    A target is the weight's share of the budget, or most times the source where that is less;
    what is over goes to the others by weight. Each round is one sum over the sources.
    """
    stats = sized.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("one"))
    ordered = stats.orderBy(F.col("source").asc_nulls_last()).select("name", "source_size", F.lit(1).alias("one"), F.monotonically_increasing_id().alias("place"))
    ordered = cut(ordered.withColumn("part", F.shiftright("place", 33)), "sources")
    numbered = _running(ordered, "one", "number")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    known = cut(numbered.withColumn("weight", weight).drop("one"), "weights")
    twice = int(2 * share)  # the budget is twice * words / 2
    total = known.agg(F.sum("source_size")).first()[0] or 0
    capped, rest = 0, known.agg(F.sum("weight")).first()[0] or 0
    while True:
        # sources at or below the level (budget - words of those capped) / weights of the rest
        over = F.lit(2.0 * most) * F.col("source_size") * F.lit(float(rest)) <= F.lit(float(twice * total - 2 * most * capped)) * F.col("weight")
        found = known.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if ((found[0] or 0), (found[1] or 0)) == (capped, rest) or not found[1]:
            break
        capped, rest = found[0] or 0, found[1]
    level = F.col("weight") * F.lit(float(twice * total - 2 * most * capped)) / F.lit(2.0 * max(rest, 1))
    return known.withColumn("target", F.when(over, F.col("source_size") * F.lit(float(most))).otherwise(level))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Spans and schedule.

    Spans: name, start (place of the document's first word in its shuffled source), doc_id, size,
    source_size, target. Schedule: slot (order of the mix), name, rank, block, first and last
    (words of the source, last exclusive).
    """
    spark = docs.sparkSession
    sized = cut(_sized(docs), "sizes")
    sources = cut(targets(sized, weights, share, most), "targets")
    return _spans(sized, sources), _schedule(spark, sources, block)


def _spans(sized: DataFrame, sources: DataFrame) -> DataFrame:
    rows, digits = sized.count(), 1
    while rows > CHUNK_ROWS * 16**digits and digits < 8:
        digits += 1
    sized = sized.withColumn("chunk", F.substring("digest", 1, digits))
    sizes = sized.groupBy("name", "chunk").agg(F.sum("size").alias("words"))
    # offsets of a source's chunks, by the first digit and within it
    wide = sizes.withColumn("digit", F.substring("chunk", 1, 1))
    digit = wide.groupBy("name", "digit").agg(F.sum("words").alias("words"))
    digit = digit.select("name", "digit", _sum_before("words", Window.partitionBy("name").orderBy("digit")).alias("base"))
    inner = wide.select("name", "digit", "chunk", _sum_before("words", Window.partitionBy("name", "digit").orderBy("chunk")).alias("inner"))
    offsets = inner.join(digit, ["name", "digit"]).join(sources.select("name", "source_size", "target"), "name")
    offsets = offsets.select("name", "chunk", (F.col("base") + F.col("inner")).alias("offset"), "source_size", "target")
    within = _sum_before("size", Window.partitionBy("name", "chunk").orderBy("digest", "doc_id", "size"))
    spans = sized.withColumn("start", within).join(offsets, ["name", "chunk"])
    return cut(spans.select("name", (F.col("start") + F.col("offset")).alias("start"), "doc_id", "size", "source_size", "target"), "spans")


def _schedule(spark, sources: DataFrame, block: int) -> DataFrame:
    words = F.floor(F.col("target") + 0.5).cast("long")
    full, rest = F.expr("words div greatest(source_size, 1)"), F.expr("words % greatest(source_size, 1)")
    needs = sources.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("rest", rest)
    needs = needs.withColumn("slots", (full * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    needs = cut(_running(needs.where(F.col("slots") > 0), "slots", "low").withColumn("high", F.col("low") + F.col("slots")), "needs")
    bits = max(1, (int(needs.agg(F.sum("slots")).first()[0] or 1) - 1).bit_length())
    points = spark.range(1 << bits).withColumnRenamed("id", "slot")
    points = points.withColumn("point", F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long"))
    points = points.withColumn("cell", F.expr(f"point div {CELL}"))
    cells = needs.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {CELL}"), F.expr(f"(high - 1) div {CELL}"))))
    hit = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    hit = hit.select("slot", "name", "source_size", "blocks", "slots", "rest", F.shiftright("slot", min(max(bits - 8, 8), 16)).alias("chunk"))
    counts = hit.groupBy("name", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("name", "chunk", _sum_before("n", Window.partitionBy("name").orderBy("chunk")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("name", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("inner", inner).join(counts, ["name", "chunk"]).withColumn("rank", F.col("inner") + F.col("base"))
    ranked = ranked.withColumn("block", F.pmod("rank", "blocks")).withColumn("first", F.col("block") * block)
    # the last slot, unless it ends a whole pass, stops where the target is met
    ends = F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest")).otherwise(F.col("source_size"))
    return ranked.select("slot", "name", "rank", "block", "first", F.least(F.col("first") + block, ends).alias("last"))


def _pieces(spans: DataFrame, block: int) -> DataFrame:
    last = F.expr(f"(start + size - 1) div {block}")
    return spans.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), last)))


def _overlap() -> tuple[Column, Column]:
    first = F.greatest("first", "start")
    return first, F.least(F.col("last"), F.col("start") + F.col("size")) - first


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix itself: slot, source, doc_id, first_word, n_words, a row per stretch of a document.

    Read by slot, and within a slot by place, it is the training order; slots of a source are
    spread evenly over it.
    """
    spans, slots = plan(docs, weights, share, most, block)
    first, length = _overlap()
    rows = _pieces(spans, block).join(slots, ["name", "block"]).withColumn("from", first).withColumn("n_words", length).where("n_words > 0")
    source = F.when(F.col("name") != "", F.substring("name", 2, 1 << 30))
    return rows.select("slot", source.alias("source"), F.col("from").alias("place"), "doc_id", (F.col("from") - F.col("start")).alias("first_word"), "n_words")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    A null or empty text has size 0 and nothing is taken of it; very long texts are cut by the
    blocks. A null source is a source of its own, the last; a source without words has target 0.
    Documents of one digest and id (repeated rows) follow each other by size, so equal rows may
    stand for each other; a null id is shuffled like an empty one. The taken words of a source
    are its target rounded to a whole number, and no document exceeds `most` times its size. An
    empty table gives an empty result; extra columns are ignored, whatever their names. Reruns
    agree: nothing depends on partitions.
    """
    spans, slots = plan(docs, weights, share, most, block)
    _, length = _overlap()
    took = F.when(F.col("last").isNull(), 0).otherwise(F.greatest(length, F.lit(0)))  # without a slot nothing is taken
    used = _pieces(spans, block).join(slots.select("name", "block", "first", "last"), ["name", "block"], "left").withColumn("taken", took)
    # name and start tell documents with words apart
    used = used.groupBy("name", "start").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return used.select(*out).unionByName(spans.where(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long")).select(*out))
