"""Every operator as a query over the driver's tables; doubles are rounded for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns
from .operators import distances, graph, models, morphology, neighbours, plots, regions, select, stats, tiles
from .plans import analysis, features
from .sources import raster


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Every double column rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, other.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def image_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius = F.col("equivalent_diameter") / 2
    stats = regions.geometry(raster.pixels(spark, sf_dir)).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("num_grains"), F.avg("area").alias("area_mean"), F.stddev_pop("area").alias("area_std"), F.avg(radius).alias("radius_mean"), F.stddev_pop(radius).alias("radius_std")
    )
    return rounded(stats)


def label_raster(spark, sf_dir):
    p = raster.pixels(spark, sf_dir)
    return p.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") * 131 + F.col("x")).cast("long")).alias("place"))


def region_geometry(spark, sf_dir):
    return rounded(regions.geometry(raster.pixels(spark, sf_dir)))


def region_axes(spark, sf_dir):
    return rounded(regions.axes(regions.central_moments(raster.pixels(spark, sf_dir), 2)).drop("area"), 5)


def region_orientation(spark, sf_dir):
    return rounded(regions.orientation(regions.central_moments(raster.pixels(spark, sf_dir), 2)), 5)


def region_hu(spark, sf_dir):
    hu = regions.hu_moments(regions.central_moments(raster.pixels(spark, sf_dir)))
    return rounded(hu.select("image_id", "label", *[F.col("hu")[i].alias(f"hu_moments_{i}") for i in range(7)]), 9)


def _near(spark, sf_dir):
    return neighbours.with_neighbours(raster.raster(spark, sf_dir))


def _mosaic(spark, sf_dir):
    """The rasters without gaps, whose regions touch."""
    return raster.raster(spark, sf_dir, gap=0.0)


def adjacency_edges(spark, sf_dir):
    return neighbours.adjacency(neighbours.with_neighbours(_mosaic(spark, sf_dir)))


def boundary_pixels(spark, sf_dir):
    return neighbours.boundary_counts(_near(spark, sf_dir))


def thick_boundaries(spark, sf_dir):
    return _places(neighbours.thick_boundary(_near(spark, sf_dir)))


def raster_faults(spark, sf_dir):
    """Overlapping masks are no raster yet: places repeat."""
    masks, _ = _overlapping_masks(spark, sf_dir)
    return raster.faults(masks.withColumnRenamed("mask_id", "label"))


def total_boundary_length(spark, sf_dir):
    return neighbours.inner_boundary(_near(spark, sf_dir)).groupBy("image_id").agg(F.count(F.lit(1)).alias("total_boundary_length"))


def region_perimeter(spark, sf_dir):
    images = raster.raster(spark, sf_dir)
    p, a = F.col("perimeter"), F.col("area")
    joined = morphology.region_measures(images).join(regions.geometry(raster.flat(images)).select("image_id", "label", "area").hint("merge"), ["image_id", "label"])
    return rounded(
        joined.select(
            "image_id", "label", p.alias("perimeter"),
            F.when(p > 0, 4 * F.pi() * a / (p * p + 1e-6)).otherwise(0.0).alias("compactness"),
            F.when(p > 0, 4 * F.pi() * a / (p * p)).otherwise(0.0).alias("shape_compactness"),
            (p / F.sqrt("area")).alias("perimeter_area_ratio"), (p / (2 * F.sqrt(F.pi() * a))).alias("slenderness"),
        )
    )


def neighbor_area_stats(spark, sf_dir):
    images = _mosaic(spark, sf_dir)
    return rounded(graph.neighbour_areas(regions.geometry(raster.flat(images)), neighbours.adjacency(neighbours.with_neighbours(images))))


def topology_features(spark, sf_dir):
    points = raster.points(spark, sf_dir)
    return graph.topology(points, neighbours.adjacency(neighbours.with_neighbours(_mosaic(spark, sf_dir))), graph.delaunay(points))


def fractal_regions(spark, sf_dir):
    return rounded(morphology.region_measures(raster.raster(spark, sf_dir)).drop("perimeter"))


def fractal_boundaries(spark, sf_dir):
    images = raster.raster(spark, sf_dir)
    return rounded(regions.boundary_fractal(neighbours.inner_boundary(neighbours.with_neighbours(images)), regions.frames(images)))


def _places(df):
    return df.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("y") * 131 + F.col("x")).cast("long")).alias("place"))


def dilate_disk(spark, sf_dir):
    """By a disk of five pixels: boundaries of all neighbours meet."""
    return _places(raster.flat(morphology.near_boundary(raster.raster(spark, sf_dir), 5)).where("label = 1"))


def dilate_disk_all(spark, sf_dir):
    """The inner boundary of every region, dilated."""
    return _places(raster.flat(morphology.near_boundary(raster.raster(spark, sf_dir), 3)).where("label = 1"))


def thin_background(spark, sf_dir):
    return _places(morphology.near_labels(raster.raster(spark, sf_dir), 3).where("label = 0 and near"))


def nn_distance(spark, sf_dir):
    return rounded(graph.nearest_neighbours(raster.points(spark, sf_dir)))


def pairwise_distance(spark, sf_dir):
    return rounded(graph.pairwise_distances(raster.points(spark, sf_dir)))


def delaunay_edges(spark, sf_dir):
    return rounded(graph.delaunay(raster.points(spark, sf_dir)))


def degree_distribution(spark, sf_dir):
    points = raster.points(spark, sf_dir)
    ends = graph.both_ways(graph.delaunay(points))
    counts = ends.groupBy("image_id", F.col("u").alias("label")).agg(*[F.count_if(F.col("weight") <= t).alias(f"t{t}") for t in graph.FIXED])
    nodes = points.select("image_id", "label").join(counts, ["image_id", "label"], "left")
    long = nodes.select("image_id", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(f"t{t}", F.lit(0)).alias("degree")) for t in graph.FIXED])).alias("d")).select("image_id", "d.*")
    return graph.degree_distribution(long, by=("image_id", "threshold"))


def avg_clustering(spark, sf_dir):
    points = raster.points(spark, sf_dir)
    edges = graph.delaunay(points)
    c = graph.clustering(points, edges, points.groupBy("image_id").agg(F.array(*[F.lit(float(t)) for t in graph.FIXED], *[F.lit(0.0)] * 25).alias("t")))
    return rounded(c.select("image_id", F.col("c1").alias("avg_clustering")))


# --- statistics -----------------------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events_by_rater(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), "ts", "event_id", "user_id", "value")
    return columns.number_within(events, ["sample"], ["ts", "event_id"], "rater")


def _events_long(spark, sf_dir):
    wide = _events_by_rater(spark, sf_dir).select("sample", "rater", "value", F.col("user_id").alias("user"), F.lit(5.0).alias("flat"))
    return stats.unpivot(wide, ["sample", "rater"], ["value", "user", "flat"])


def _lineitem_long(spark, sf_dir):
    wide = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample"), *MEASURES)
    return stats.unpivot(wide, ["sample"], MEASURES)


def rater_index(spark, sf_dir):
    return _events_by_rater(spark, sf_dir).select("event_id", "sample", "rater")


def icc3k(spark, sf_dir):
    return rounded(stats.icc3k(_events_long(spark, sf_dir)))


def anova_f(spark, sf_dir):
    return rounded(stats.anova(_lineitem_long(spark, sf_dir)).select("feature", "f", "df1", "df2"))


def levene_f(spark, sf_dir):
    return rounded(stats.levene(_lineitem_long(spark, sf_dir)).select("feature", "f"))


def anova_p(spark, sf_dir):
    return rounded(stats.anova(_lineitem_long(spark, sf_dir)).select("feature", "p_value", "reject_h0"))


def normality(spark, sf_dir):
    return rounded(stats.normality(_events_long(spark, sf_dir)))


def good_features(spark, sf_dir):
    long = _events_long(spark, sf_dir)
    return rounded(stats.good_features(stats.icc3k(long), stats.anova(long)).select("feature", "icc", "p_value", "reject_h0", "good_feature"))


def sample_means(spark, sf_dir):
    return rounded(_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in MEASURES]))


def variance_filter(spark, sf_dir):
    data = _table(spark, sf_dir, "lineitem").select(*MEASURES, F.lit(3.0).alias("constant"))
    kept = select.variance_filter(data, data.columns)
    return rounded(select.variances(data, data.columns).select("feature", "variance", F.col("feature").isin(kept).alias("kept")))


def corr_matrix(spark, sf_dir):
    dims = [f"d{i}" for i in range(64)]
    wide = _table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)])
    return rounded(select.correlation_matrix(wide, dims))


def corr_filter(spark, sf_dir):
    base = _table(spark, sf_dir, "lineitem").select(
        *MEASURES, (F.col("l_quantity") * 2 + 1).alias("quantity_twice"), (F.col("l_quantity") + F.col("l_tax")).alias("quantity_std"), (-F.col("l_discount")).alias("discount_less")
    )
    kept = select.correlation_filter(base, base.columns)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "position int, feature string")


def feature_target_corr(spark, sf_dir):
    data = _table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0))
    return rounded(select.feature_target_correlation(data, ["l_quantity", "l_discount", "flat", "missing"], ["l_extendedprice", "l_tax"]))


def merge_features_external(spark, sf_dir):
    f = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    e = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("amount"), "c_mktsegment")
    return select.merge_external(f, e)


def target_groups(spark, sf_dir):
    """Correlations with the target groups; targets and whole groups that the table lacks are left out."""
    f = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("orders"))
    e = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("Hc20"), F.col("c_nationkey").alias("C"), (F.col("c_custkey") % 7).alias("alpha"), F.col("c_acctbal").alias("other"))
    return rounded(analysis.correlate(f, e))


# --- cleaning and scalar functions ----------------------------------------------------------


def coerce_numeric(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("page"), F.concat_ws("", F.lit("x"), F.col("value").cast("string")).alias("bad"), F.col("user_id").cast("string").alias("user"))
    return columns.coerce_numeric(raw, ["page", "bad", "user"])


def drop_empty_columns(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select(F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("nothing"), F.col("user_id").cast("double").alias("user"))
    kept = columns.present_columns(raw, raw.columns)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def _with_gaps(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("double")).alias("user"))


def impute_mean(spark, sf_dir):
    return rounded(columns.impute_mean(_with_gaps(spark, sf_dir), ["value", "user"]))


def fill_zero(spark, sf_dir):
    return _with_gaps(spark, sf_dir).fillna({"value": 0.0, "user": 0.0})


def drop_missing(spark, sf_dir):
    return _with_gaps(spark, sf_dir).dropna(subset=["value", "user"])


def nan_to_zero(spark, sf_dir):
    v = F.col("value")
    odd = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("inf")).when(F.col("event_id") % 7 == 2, float("-inf")).otherwise(v)
    return _table(spark, sf_dir, "events").select("event_id", columns.finite_or_zero(odd).alias("value"))


def standardize_pop(spark, sf_dir):
    return rounded(columns.standardize(_with_gaps(spark, sf_dir), ["value", "user"]), 5)


def regex_sample_id(spark, sf_dir):
    name = F.concat_ws("_", F.concat(F.lit("S"), (F.col("event_id") % 17).cast("string")), F.col("event_type"), (F.col("event_id") % 3).cast("string"))
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("dir"), (F.col("event_id") % 4).cast("string"), F.lit("/"), name, F.lit(".mask"))).otherwise(F.concat(name, F.lit(".mask")))
    e = _table(spark, sf_dir, "events").select("event_id", name.alias("name"), path.alias("path"))
    return e.select("event_id", columns.sample_of_file(F.col("name")).alias("by_name"), columns.sample_of_path(F.col("path")).alias("by_path"))


def concat_union_by_name(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    a = e.where("event_id % 2 = 0").select("event_id", "value")
    b = e.where("event_id % 2 = 1").select("event_id", F.col("user_id").cast("double").alias("user"))
    return a.unionByName(b, allowMissingColumns=True)


def topk_importance(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.abs("value")).alias("importance"))
    return rounded(e.orderBy(F.desc("importance"), "event_type").limit(5))


def neighbour_sets(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    low, odd = n.where("k < 15"), n.where("k % 2 = 1")
    tag = lambda d, t: d.withColumn("part", F.lit(t))
    return tag(low.intersect(odd), "common").unionByName(tag(low.exceptAll(odd), "extra")).unionByName(tag(odd.exceptAll(low), "missing"))


def random_rows(spark, sf_dir):
    """A hundred rows in the order of a multiplicative hash of the key: the same sample on every run."""
    return columns.random_rows(_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100)


# --- plot tables ----------------------------------------------------------------------------


def _degrees(spark, sf_dir, limit=50.0):
    points = raster.points(spark, sf_dir)
    ends = graph.both_ways(graph.delaunay(points)).where(F.col("weight") <= limit)
    counted = ends.groupBy("image_id", F.col("u").alias("label")).agg(F.count(F.lit(1)).alias("degree"))
    return points.select("image_id", "label").join(counted, ["image_id", "label"], "left").fillna({"degree": 0})


def degree_value_counts(spark, sf_dir):
    return plots.value_counts(_degrees(spark, sf_dir), "degree")


def value_histogram(spark, sf_dir):
    return plots.histogram(_table(spark, sf_dir, "events"), "value", 2.5)


def histogram_by_sample(spark, sf_dir):
    return plots.histogram(_table(spark, sf_dir, "events"), "value", 10.0, ("event_type",))


def compare_quartiles(spark, sf_dir):
    return rounded(plots.box_summary(_table(spark, sf_dir, "events"), "value", "event_type"))


def compare_ordered(spark, sf_dir):
    details = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sample"), "value")
    external = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("Hc20"))
    return plots.ordered_samples(details, external, "value", "Hc20").groupBy("sample", "position").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def kde_grid(spark, sf_dir):
    return rounded(plots.density(_table(spark, sf_dir, "events"), "value", "event_type"))


def kde_2d(spark, sf_dir):
    return rounded(plots.density_2d(_table(spark, sf_dir, "events").select("value", "user_id"), "value", "user_id"), 9)


def hexbin(spark, sf_dir):
    return plots.hexbin(_table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")


def outlier_flags(spark, sf_dir):
    return plots.degree_outliers(_degrees(spark, sf_dir), "degree", 3, 7)


def node_scaling(spark, sf_dir):
    return rounded(plots.node_sizes(_degrees(spark, sf_dir), "degree"))


def discrete_colormap(spark, sf_dir):
    degrees = plots.colour_scheme(_degrees(spark, sf_dir), "degree")
    return degrees.unionByName(plots.colour_scheme(_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image_id"), "l_discount"), "l_discount"))


def spatial_coloring(spark, sf_dir):
    values = _degrees(spark, sf_dir).where("label % 5 > 0").withColumn("degree", F.col("degree").cast("double"))
    coloured = plots.coloured_pixels(raster.pixels(spark, sf_dir), values, "degree")
    return rounded(coloured.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.max("value").alias("value")))


def file_match(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    masks = part.select(F.concat(F.lit("P"), (F.col("k") % 3).cast("string")).alias("parent"), F.col("k").cast("string").alias("id"))
    folder = F.when(F.col("k") % 2 == 0, F.concat(F.lit("P"), (F.col("k") % 3).cast("string"), F.lit("_"))).otherwise(F.lit("other_"))
    details = part.where("k % 5 <> 0").select(F.concat(F.lit("out/"), folder, F.col("k").cast("string"), F.lit("_details.csv")).alias("path"))
    return plots.match_details(masks, details)


# --- image kernels --------------------------------------------------------------------------


def boundary_classes(spark, sf_dir):
    typed = morphology.typed_pixels(raster.raster(spark, sf_dir))
    return typed.where("label > 0").groupBy("image_id", "region_type").agg(F.count(F.lit(1)).alias("pixels"), F.max("label").alias("regions"))


def connected_regions(spark, sf_dir):
    """Components of the labelled pixels; seeds whose cells touch nothing are one each."""
    found = morphology.connected_components(raster.raster(spark, sf_dir))
    return found.where("label > 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.min(F.col("y") * 128 + F.col("x")).alias("first"))


def connected_regions_tiled(spark, sf_dir):
    """The same from tiles of 32 pixels, each labelled by itself."""
    found = tiles.connected_components(raster.pixels(spark, sf_dir), tile=32)
    return found.where("label > 0").groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("pixels"), F.min(F.col("y") * 128 + F.col("x")).alias("first"))


def distance_map(spark, sf_dir):
    """How far the pixels of each region lie from the background."""
    far = distances.distance_map(raster.pixels(spark, sf_dir))
    return rounded(far.where("label > 0").groupBy("image_id", "label").agg(F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")))


def region_shapes(spark, sf_dir):
    return rounded(morphology.region_shapes(raster.raster(spark, sf_dir)))


def skeleton_branches(spark, sf_dir):
    near = neighbours.with_neighbours(morphology.skeletons(raster.background(raster.raster(spark, sf_dir)))).where("label = 1")
    around = F.lit(0)
    for o in neighbours.EIGHT:
        around = around + F.coalesce(F.col(neighbours._name(*o)), F.lit(0))
    return near.select("image_id", around.alias("k")).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("k") > 2).alias("branches"), F.count_if(F.col("k") == 1).alias("ends"))


def boundary_network(spark, sf_dir):
    return morphology.boundary_networks(raster.background(raster.raster(spark, sf_dir)))


def skeleton_edges(spark, sf_dir):
    return morphology.skeleton_edges(raster.background(raster.raster(spark, sf_dir))).drop("path")


def persistence_h0(spark, sf_dir):
    return rounded(morphology.persistence(raster.points(spark, sf_dir)).where("dim = 0").select("image_id", "death"))


def persistence_h1(spark, sf_dir):
    return rounded(morphology.persistence(raster.points(spark, sf_dir)).where("dim = 1").select("image_id", "birth", "death"))


def small_world(spark, sf_dir):
    points = raster.points(spark, sf_dir)
    limits = graph.thresholds(regions.geometry(raster.pixels(spark, sf_dir)))
    flags = morphology.small_worlds(points, graph.delaunay(points), limits)
    return flags.select("image_id", *[F.col("small_world")[i].alias(f"is_small_world_{s}") for i, s in enumerate(graph.SUFFIXES)])


def delaunay_degree_29(spark, sf_dir):
    points = raster.points(spark, sf_dir)
    limits = graph.thresholds(regions.geometry(raster.pixels(spark, sf_dir)))
    return graph.degrees(points, graph.delaunay(points), limits)


def delaunay_kernel(spark, sf_dir):
    return rounded(graph.delaunay(raster.points(spark, sf_dir), relational_up_to=0))


def dedup_masks(spark, sf_dir):
    masks, frame = _overlapping_masks(spark, sf_dir)
    kept = morphology.deduplicate_masks(masks, frame, 100)
    return kept.groupBy("image_id", "mask_id").agg(F.count(F.lit(1)).alias("area"))


def _overlapping_masks(spark, sf_dir):
    """Each region of the raster without gaps, grown by two pixels, so neighbours overlap."""
    images = _mosaic(spark, sf_dir)
    runs = raster.spread(images.select("image_id", morphology.grown_masks(2)("labels").alias("runs")), rows=raster.load_part(spark, sf_dir).count())
    runs = runs.select("image_id", F.inline("runs"))
    masks = runs.select("image_id", "mask_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return masks, images.select("image_id", F.lit(96).alias("height"), F.lit(128).alias("width"))


def labels_from_masks(spark, sf_dir):
    masks, frame = _overlapping_masks(spark, sf_dir)
    pixels = raster.from_masks(masks, frame)
    return pixels.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") * 131 + F.col("x")).cast("long")).alias("place"))


def region_details(spark, sf_dir):
    return rounded(features.region_details(features.Rasters(raster.raster(spark, sf_dir))), 4)


def image_features(spark, sf_dir):
    return rounded(features.image_features(raster.raster(spark, sf_dir)), 4)


def region_type_stats(spark, sf_dir):
    """Means and deviations of a few features per image and region type."""
    typed = morphology.typed_pixels(raster.raster(spark, sf_dir)).where("label > 0")
    key = typed.select(F.concat_ws("|", "image_id", "region_type").alias("image_id"), "y", "x", "label")
    g = regions.geometry(key).groupBy("image_id").agg(F.avg("area").alias("area_mean"), F.stddev_pop("area").alias("area_std"), F.avg("rectangularity").alias("rectangularity_mean"))
    return rounded(g)


# --- models ---------------------------------------------------------------------------------

PARTS = ["p_size", "log_size", "p_key", "odd"]


def _parts(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.log1p("p_size").alias("log_size"), (F.col("p_partkey") % 1000).cast("double").alias("p_key"), (F.col("p_partkey") % 2).cast("double").alias("odd"), "p_retailprice")


def model_comparison(spark, sf_dir):
    """All seven models over the whole table, five folds."""
    return rounded(models.compare_models(_parts(spark, sf_dir), PARTS, "p_retailprice", "p_partkey", models.SMALL_GRIDS), 4)


def ridge_cv(spark, sf_dir):
    return rounded(models.compare_models(_parts(spark, sf_dir), PARTS, "p_retailprice", "p_partkey", {"Ridge": models.GRIDS["Ridge"], "Lasso": models.GRIDS["Lasso"]}), 4)


def rfe_selected(spark, sf_dir):
    kept, trail = models.recursive_elimination(_parts(spark, sf_dir), PARTS, "p_retailprice", "p_partkey")
    return spark.createDataFrame([(n, round(r, 4), c) for n, r in trail for c in kept], "n_features int, cv_r2 double, selected string")


def feature_importance(spark, sf_dir):
    return rounded(models.feature_importance(_parts(spark, sf_dir), PARTS, "p_retailprice"))


def shap_mean_abs(spark, sf_dir):
    return rounded(models.mean_attribution(_parts(spark, sf_dir), PARTS, "p_retailprice", "p_partkey", "RandomForest", {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2}), 4)


QUERIES = {
    f.__name__: f
    for f in (
        image_region_stats, label_raster, region_geometry, region_axes, region_orientation, region_hu, adjacency_edges, boundary_pixels, thick_boundaries, raster_faults,
        total_boundary_length, region_perimeter, neighbor_area_stats, topology_features, fractal_regions, fractal_boundaries, dilate_disk, dilate_disk_all,
        thin_background, nn_distance, pairwise_distance, delaunay_edges, degree_distribution, avg_clustering,
        rater_index, icc3k, anova_f, levene_f, anova_p, normality, good_features, sample_means, variance_filter, corr_matrix, corr_filter, feature_target_corr,
        merge_features_external, target_groups, coerce_numeric, drop_empty_columns, impute_mean, fill_zero, drop_missing, nan_to_zero, standardize_pop,
        regex_sample_id, concat_union_by_name, topk_importance, neighbour_sets, random_rows, degree_value_counts, value_histogram, histogram_by_sample,
        compare_quartiles, compare_ordered, kde_grid, kde_2d, hexbin, outlier_flags, node_scaling, discrete_colormap, spatial_coloring, file_match,
        boundary_classes, connected_regions, connected_regions_tiled, distance_map, region_shapes, skeleton_branches, boundary_network, skeleton_edges, persistence_h0, persistence_h1, small_world,
        delaunay_degree_29, delaunay_kernel, dedup_masks, labels_from_masks, region_details, image_features, region_type_stats,
        model_comparison, ridge_cv, rfe_selected, feature_importance, shap_mean_abs,
    )
}
