"""Image-wise kernels as DataFrame operators: one Arrow row per image, no per-group overhead."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.raster import IMAGES, _nested, flat, images, spread
from . import graph, kernels
from .neighbours import disk


def _raster(rows: pa.ListScalar) -> np.ndarray:
    """An array of rows as a matrix, by its buffer."""
    lines = rows.values
    return lines.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(lines), -1).astype(np.int32, copy=False) if len(lines) else np.zeros((0, 0), np.int32)


SHAPES = (
    "image_id string, label int, convexity double, convex_defect double, feret_diameter_max double, skeleton_branches double, skeleton_length_ratio double,"
    " tortuosity double, curvature_std double, fourier_energy double, fractal_dimension_boxcount double, curvature_sum double, curvature_points double, perimeter double"
)
_SHAPE_NAMES = [c.split()[0] for c in SHAPES.split(",")][2:]


def _shapes(batches):
    for batch in batches:
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            raster = _raster(labels)
            around = kernels.perimeters(raster) if raster.size else ()
            rows = [(label, kernels.region_shape(mask) | {"perimeter": around[label]}) for label, _, _, mask in kernels.crops(raster)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([image] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([float(r[1][n]) for r in rows], pa.float64()) for n in _SHAPE_NAMES)],
                names=["image_id", "label", *_SHAPE_NAMES],
            )


def region_shapes(pixels: DataFrame) -> DataFrame:
    """Hull, skeleton, first-contour, box-counting and perimeter features of each region."""
    return images(pixels).mapInArrow(_shapes, SHAPES)


def _image_batch(names: list[str], rasters: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), _nested(rasters)], names=["image_id", "labels"])


def _band_batch(image: str, kinds: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    whole = np.concatenate([raster for _, raster in kinds]).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * whole.shape[1], pa.int32()), pa.array(whole.ravel()))
    names = np.repeat([kind for kind, _ in kinds], [len(raster) for _, raster in kinds])
    y = np.concatenate([np.arange(len(raster), dtype=np.int32) for _, raster in kinds])
    return pa.RecordBatch.from_arrays([pa.array([image] * len(whole), pa.string()), pa.array(names.tolist(), pa.string()), pa.array(y), lines], names=["image_id", "region_type", "y", "labels"])


def _classes(batches):
    for batch in batches:
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            raster = _raster(labels)
            background, walls, junctions = kernels.boundary_classes(raster)
            kinds = [("grain", raster), ("background", background), ("thinw", walls), ("junc", junctions)]
            yield _image_batch([image] * 4, [r for _, r in kinds]).append_column("region_type", pa.array([k for k, _ in kinds], pa.string()))


def typed_images(pixels: DataFrame) -> DataFrame:
    """Images by region_type: the grains themselves, large background areas, thin walls, junctions."""
    return images(pixels).mapInArrow(_classes, f"{IMAGES}, region_type string")


def typed_pixels(pixels: DataFrame) -> DataFrame:
    """The same as pixels."""
    rows = typed_images(pixels).select("image_id", "region_type", F.posexplode("labels").alias("y", "labels"))
    return rows.select("image_id", "region_type", "y", F.posexplode("labels").alias("x", "label"))


def _components(diagonal: bool):
    def run(batches):
        for batch in batches:
            for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
                yield _band_batch(image, [("component", kernels.components(_raster(labels) > 0, diagonal)[0])])

    return run


def connected_components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """Pixels relabelled by the connected component of their non-zero label, in raster order."""
    rows = images(mask).mapInArrow(_components(diagonal), "image_id string, region_type string, y int, labels array<int>")
    return rows.select("image_id", "y", F.posexplode("labels").alias("x", "label"))


def _skeletons(batches):
    for batch in batches:
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            yield _image_batch([image], [kernels.thin(_raster(labels) > 0)])


def skeletons(mask: DataFrame) -> DataFrame:
    """Images with label 1 on the thinned mask of non-zero labels."""
    return images(mask).mapInArrow(_skeletons, IMAGES)


def skeleton_pixels(mask: DataFrame) -> DataFrame:
    """Pixels with label 1 on the thinned mask of non-zero labels."""
    return flat(skeletons(mask))


def _measures(batches):
    for batch in batches:
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            raster = _raster(labels)
            around = kernels.perimeters(raster) if raster.size else ()
            rows = [(label, around[label], kernels.box_dimension(mask)) for label, _, _, mask in kernels.crops(raster)]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array([image] * len(rows), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())],
                names=["image_id", "label", "perimeter", "fractal_dimension_boxcount"],
            )


def region_measures(pixels: DataFrame) -> DataFrame:
    """image_id, label, perimeter, fractal_dimension_boxcount: what neighbours.perimeters and
    regions.fractal_dimension say, from one pass over the images."""
    return images(pixels).mapInArrow(_measures, "image_id string, label int, perimeter double, fractal_dimension_boxcount double")


def _near(radius: int):
    def run(batches):
        for batch in batches:
            for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
                raster = _raster(labels)
                near = kernels.dilate(raster > 0, radius) if raster.size else raster
                yield _band_batch(image, [("near", 2 * raster + near)])

    return run


def near_labels(pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels with near: whether a labelled pixel lies within a disk of the radius around them."""
    rows = images(pixels).mapInArrow(_near(radius), "image_id string, region_type string, y int, labels array<int>")
    flat = rows.select("image_id", "y", F.posexplode("labels").alias("x", "v"))
    return flat.select("image_id", "y", "x", F.shiftright("v", 1).alias("label"), (F.col("v") % 2 == 1).alias("near"))


def _near_edges(radius: int):
    def run(batches):
        for batch in batches:
            for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
                yield _image_batch([image], [kernels.dilate(kernels.inner_boundary(_raster(labels)), radius)])

    return run


def near_boundary(pixels: DataFrame, radius: int) -> DataFrame:
    """Images with label 1 within a disk around the inner boundary of any region."""
    return images(pixels).mapInArrow(_near_edges(radius), IMAGES)


NETWORK = "image_id string, nodes long, edges long, components long, network_euler_number long, longest_chain_length long, endpoints long, segments long, segment_pixels long"


def _networks(batches):
    for batch in batches:
        out = []
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            s = kernels.thin(_raster(labels) > 0)
            nodes, segments = kernels.skeleton_graph(s)
            edges = {(min(a, b), max(a, b)) for a, b, _ in segments if a != b}
            parent = list(range(len(nodes)))

            def find(i: int, parent=parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for a, b in edges:
                parent[find(a)] = find(b)
            c = sum(find(i) == i for i in range(len(nodes)))
            ends = int((s & (kernels.count_neighbours(s) == 1)).sum())
            out.append((image, len(nodes), len(edges), c, len(nodes) - len(edges) + c if nodes else 0, 0, ends, len(segments), sum(len(path) for *_, path in segments)))
        columns = list(zip(*out)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[c.split()[0] for c in NETWORK.split(", ")])


def boundary_networks(mask: DataFrame) -> DataFrame:
    """Nodes, edges (pairs of nodes that a segment joins) and Euler number (V - E + C) of the thinned
    mask's graph; all its segments and their pixels (the last node with each, the first not).

    longest_chain_length is the reference's placeholder, always 0.
    """
    return images(mask).mapInArrow(_networks, NETWORK)


def _edges(batches):
    for batch in batches:
        for image, labels in zip(batch.column("image_id").to_pylist(), batch.column("labels"), strict=True):
            nodes, segments = kernels.skeleton_graph(kernels.thin(_raster(labels) > 0))
            rows = [(a, b, *nodes[a], *nodes[b], len(path), [{"y": y, "x": x} for y, x in path]) for a, b, path in segments]
            columns = list(zip(*rows)) or [()] * 8
            point = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([image] * len(rows), pa.string()), *(pa.array(c, pa.int32()) for c in columns[:7]), pa.array(columns[7], point)],
                names=["image_id", "src", "dst", "src_y", "src_x", "dst_y", "dst_x", "length", "path"],
            )


def skeleton_edges(mask: DataFrame) -> DataFrame:
    """Segments between branch and end pixels of the thinned mask, with their pixels."""
    return images(mask).mapInArrow(
        _edges, "image_id string, src int, dst int, src_y int, src_x int, dst_y int, dst_x int, length int, path array<struct<y:int,x:int>>"
    )


PERSISTENCE = "image_id string, dim int, birth double, death double"


def _persistence(limit: float):
    def run(batches):
        for batch in batches:
            rows = []
            for image, pts in zip(batch.column("image_id").to_pylist(), batch.column("pts").to_pylist(), strict=True):
                bars = kernels.homology(np.array([p["y"] for p in pts]), np.array([p["x"] for p in pts]), limit)
                rows += [(image, dim, *bar) for dim, found in enumerate(bars) for bar in found]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["image_id", "dim", "birth", "death"])

    return run


def persistence(points: DataFrame, limit: float = 100.0) -> DataFrame:
    """Finite bars of positive length of the Rips filtration of each image's points, up to limit."""
    return graph.gathered(points).mapInArrow(_persistence(limit), PERSISTENCE)


def mean_persistence(points: DataFrame, limit: float = 100.0) -> DataFrame:
    bars = persistence(points, limit).groupBy("image_id").agg(
        F.avg(F.when(F.col("dim") == 0, F.col("death") - F.col("birth"))).alias("h0"), F.avg(F.when(F.col("dim") == 1, F.col("death") - F.col("birth"))).alias("h1")
    )
    every = points.select("image_id").distinct()
    return every.join(bars, "image_id", "left").select("image_id", F.coalesce("h0", F.lit(0.0)).alias("persistence_H0_mean"), F.coalesce("h1", F.lit(0.0)).alias("persistence_H1_mean"))


def _small_worlds(batches):
    for batch in batches:
        out = []
        for image, labels, edges, t in zip(*(batch.column(c).to_pylist() for c in ("image_id", "labels", "edges", "t")), strict=True):
            at = {v: i for i, v in enumerate(labels)}
            src = np.array([at[e["src"]] for e in edges], int)
            dst = np.array([at[e["dst"]] for e in edges], int)
            w = np.array([e["weight"] for e in edges], float)
            row, known = [], {}
            for k, limit in enumerate(t):
                keep = w <= limit
                n = int(keep.sum())
                if n not in known:
                    known[n] = bool(edges) and kernels.small_world(len(labels), src[keep], dst[keep], zlib.crc32(f"{image}:{k}".encode()))
                row.append(known[n])
            out.append((image, row))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.bool_()))], names=["image_id", "small_world"])


def small_worlds(points: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """image_id, small_world: a flag per threshold, against seeded random graphs."""
    nodes = spread(points).groupBy("image_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    links = edges.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("weight", "src", "dst"))).alias("edges"))
    rows = nodes.join(links.hint("merge"), "image_id", "left").join(limits.hint("merge"), "image_id").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<weight:double,src:int,dst:int>>")))
    return rows.mapInArrow(_small_worlds, "image_id string, small_world array<boolean>")


def grown_masks(radius: int):
    """A function of an image's labels: runs (mask_id, y, x0, x1) of the places within a disk around each region, inside the frame."""

    def run(images: pa.Array) -> pa.Array:
        parts, sizes = [np.zeros((0, 4), np.int32)], [0]
        for labels in images:
            raster = _raster(labels)
            high, wide = raster.shape
            pad = np.pad(raster, radius)
            hits = np.stack([pad[radius + dy : radius + dy + high, radius + dx : radius + dx + wide] for dy, dx in disk(radius)])
            hits.sort(axis=0)
            fresh = hits > 0
            fresh[1:] &= hits[1:] != hits[:-1]
            k, y, x = np.nonzero(fresh)
            # one number per place, with a gap between rows, so a run is what counts on by one
            code = np.sort((hits[k, y, x].astype(np.int64) * high + y) * (wide + 1) + x)
            cut = np.flatnonzero(np.diff(code) != 1)
            first, last = code[np.r_[0, cut + 1]] if len(code) else code, code[np.r_[cut, len(code) - 1]] if len(code) else code
            line = first // (wide + 1)
            parts.append(np.column_stack((line // high, line % high, first % (wide + 1), last % (wide + 1))).astype(np.int32) if len(code) else parts[0])
            sizes.append(len(parts[-1]))
        whole = np.concatenate(parts)
        runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in whole.T], names=["mask_id", "y", "x0", "x1"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), runs)

    return F.arrow_udf(run, "array<struct<mask_id:int,y:int,x0:int,x1:int>>")


def _dedup(min_area: int, area_ratio: float | None):
    def run(batches):
        for batch in batches:
            for image, height, width, pixels in zip(*(batch.column(c).to_pylist() for c in ("image_id", "height", "width")), batch.column("pixels"), strict=True):
                mask_id, y, x = (pixels.values.field(c).to_numpy(zero_copy_only=False) for c in ("mask_id", "y", "x"))
                known, number = np.unique(mask_id, return_inverse=True)
                stack = np.zeros((len(known), height, width), bool)
                inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
                stack[number[inside], y[inside], x[inside]] = True
                for i, rest in kernels.deduplicate(list(stack), min_area, area_ratio):
                    y, x = np.nonzero(rest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * len(y), pa.string()), pa.array(np.full(len(y), known[i]), pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.int32())], names=["image_id", "mask_id", "y", "x"]
                    )

    return run


def deduplicate_masks(masks: DataFrame, frame: DataFrame, min_area: int = 100, area_ratio: float | None = None) -> DataFrame:
    """Pixels (image_id, mask_id, y, x) left to each kept mask; pixels outside the frame are dropped.

    A worker holds one image's masks at a time, as arrays.
    """
    by_image = masks.groupBy("image_id").agg(F.collect_list(F.struct("mask_id", "y", "x")).alias("pixels")).join(frame.hint("shuffle_hash"), "image_id")
    return by_image.select("image_id", "height", "width", "pixels").mapInArrow(_dedup(min_area, area_ratio), "image_id string, mask_id int, y int, x int")
