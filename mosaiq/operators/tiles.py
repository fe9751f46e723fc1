"""Connected components of images larger than one task.

An image is cut into tiles. A task labels a tile; a component goes by its first pixel in raster
order. Pixels that touch across a seam give edges between components of different tiles. Edges
are contracted by large and small stars until every component hangs on the first one of its
image-wide component. Only edges at seams take part, so the rounds work on little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number_within
from ..plans.scratch import materialise
from . import kernels

TILE = 512
#: A pixel as one number that grows in raster order.
SHIFT = 31


PARTS = "image_id string, ty long, tx long, ys array<int>, xs array<int>, parts array<long>"


def _tiles(diagonal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tile in batch.column("p"):
                y, x, on = (tile.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "on"))
                y, x, on = y.astype(np.int64), x.astype(np.int64), on.astype(bool)
                mask = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1), bool)
                mask[y - y.min(), x - x.min()] = on
                label, n = kernels.components(mask, diagonal)
                own = np.where(on, label[y - y.min(), x - x.min()], 0)
                first = np.full(n + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, own, (y << SHIFT) | x)
                found.append(pa.array(first[own], mask=~on))
            p = batch.column("p")
            ends = pa.array(np.r_[0, np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False))], pa.int32())
            flat = p.flatten()
            parts = pa.concat_arrays(found) if found else pa.array([], pa.int64())
            lists = [pa.ListArray.from_arrays(ends, c) for c in (flat.field("y"), flat.field("x"), parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "ty", "tx")), *lists], names=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _seams(parts: DataFrame, tile: int, diagonal: bool) -> DataFrame:
    """image_id, u, v (u < v): components that touch across a seam, each pair once."""
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    each = parts.select("image_id", F.inline(F.arrays_zip(F.col("ys").alias("y"), F.col("xs").alias("x"), F.col("parts").alias("part"))))
    border = each.where("part is not null").where(edge("y") | edge("x"))
    steps = [(0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else [])]
    # only a step that leaves the tile can meet another one's component
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    ahead = border.select("image_id", F.col("part").alias("a"), "y", "x", step.alias("s"))
    block = lambda c: F.floor(c / tile)
    y, x = F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")
    ahead = ahead.where((block(y) != block(F.col("y"))) | (block(x) != block(F.col("x")))).select("image_id", "a", y.alias("y"), x.alias("x"))
    # sizes of packed scratch files say little of the rows in them, so nothing is broadcast
    met = ahead.join(border.select("image_id", "y", "x", F.col("part").alias("b")).hint("merge"), ["image_id", "y", "x"]).where("a <> b")
    return met.select("image_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """image_id, v, u: every node but the least of its component, with the least one."""
    key = ["image_id"]
    edges = materialise(edges, "edges")
    state = None
    while True:
        # large star: greater neighbours of a node go to its least neighbour, or itself
        both = edges.select(*key, F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(*key, F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy(*key, "n").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "n"))
        large = both.where("o > n").join(least.hint("merge"), [*key, "n"]).select(*key, F.col("m").alias("u"), F.col("o").alias("v")).where("u < v").distinct()
        # small star: a node and its lesser neighbours go to the least of these
        least = large.groupBy(*key, "v").agg(F.min("u").alias("m"))
        small = large.join(least.hint("merge"), [*key, "v"])
        small = small.select(*key, F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").unionByName(least.select(*key, F.col("m").alias("u"), "v")).distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*key, "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def connected_components(mask: DataFrame, diagonal: bool = True, tile: int = TILE) -> DataFrame:
    """Pixels relabelled by the connected component of their non-zero label, in raster order.

    The same as the one-task form, for images of any size and any tile.
    """
    spots = mask.select("image_id", "y", "x", F.coalesce(F.col("label") > 0, F.lit(False)).alias("on"))
    at = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "yx"]
    tiles = spots.groupBy("image_id", *at).agg(F.collect_list(F.struct("y", "x", "on")).alias("p"))
    parts = materialise(tiles.mapInArrow(_tiles(diagonal), PARTS), "parts")
    stars = contract(_seams(parts, tile, diagonal))
    held = materialise(parts.select("image_id", "ty", "tx", F.explode(F.array_distinct("parts")).alias("part")).where("part is not null"), "held")
    firsts = held.select("image_id", F.col("part").alias("v")).distinct()
    roots = firsts.join(stars.hint("merge"), ["image_id", "v"], "left_anti").withColumnRenamed("v", "root")
    numbered = materialise(number_within(roots, ["image_id"], ["root"], "number"), "numbers")
    of = stars.select("image_id", F.col("v").alias("part"), F.col("u").alias("root")).unionByName(numbered.select("image_id", F.col("root").alias("part"), "root"))
    names = of.join(numbered.hint("merge"), ["image_id", "root"]).select("image_id", "part", F.col("number").cast("int").alias("number"))
    # tiles, not pixels, meet the names of the components that they hold
    named = held.join(names.hint("merge"), ["image_id", "part"]).groupBy("image_id", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("part", "number"))).alias("names"))
    whole = parts.join(named.hint("merge"), ["image_id", "ty", "tx"], "left").select("image_id", "names", F.inline(F.arrays_zip(F.col("ys").alias("y"), F.col("xs").alias("x"), F.col("parts").alias("part"))))
    return whole.select("image_id", "y", "x", F.when(F.col("part").isNull(), 0).otherwise(F.try_element_at("names", F.col("part"))).alias("label"))
