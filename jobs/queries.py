"""The jobs as queries: each runs twice into one new folder and returns what then stands there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.oracles import RASTER

from . import config, region_feed, text_study


def _folder(spark: SparkSession, job: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only on a local master that leaves it unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="jobs-")
    return f"{base.rstrip('/')}/jobs/{job}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def job1_text_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details (section detail) and study."""
    out = _folder(spark, "text-study")
    for _ in range(2):
        text_study.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    details = text_study.read(spark, out, "details").withColumn("section", F.lit("detail"))
    return _rounded(details.unionByName(text_study.read(spark, out, "study"), allowMissingColumns=True))


def job2_region_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, regions and images (section), as the second run, which finds nothing new, leaves them."""
    out = _folder(spark, "region-feed")
    for _ in range(2):  # a stream takes a folder or a pattern, not a single file
        region_feed.run(spark, f"{sf_dir}/part.parquet*", f"{out}/tables", f"{out}/checkpoint")
    parts = [region_feed.read(spark, f"{out}/tables", t).withColumn("section", F.lit(t)) for t in ("regions", "images")]
    seeds = region_feed.read(spark, f"{out}/tables", "seeds").drop("batch").withColumn("section", F.lit("seeds"))
    return _rounded(seeds.unionByName(parts[0], allowMissingColumns=True).unionByName(parts[1], allowMissingColumns=True))


_S = config.load("text_study")
_M = text_study.MEASURES
_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
_COUNT = "CAST(len(regexp_extract_all(text, '{}')) AS DOUBLE)"
_VALUES = {
    "n_chars": "CAST(length(text) AS DOUBLE)",
    "n_words": f"CAST(len({_WORDS}) AS DOUBLE)",
    "n_lines": "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE)",
    "word_length": f"CAST(length(array_to_string({_WORDS}, '')) AS DOUBLE) / len({_WORDS})",
    "line_length": "CAST(length(text) AS DOUBLE) / (length(text) - length(replace(text, chr(10), '')) + 1)",
    "distinct_words": f"CAST(len(list_distinct({_WORDS})) AS DOUBLE) / len({_WORDS})",
    **{name: f"{_COUNT.format(kind)} / length(text)" for name, kind in (("upper", "[A-Z]"), ("digits", "[0-9]"), ("marks", "[.,;:!?]"), ("accents", "[^\\x00-\\x7F]"))},
}
_PAIRS = [(i, j) for i in range(len(_M)) for j in range(i + 1, len(_M))]

# p of F is an incomplete beta function: a finite sum where the second degrees of freedom are even (pe), else a series (po)
TEXT_STUDY = f"""
WITH RECURSIVE det AS (SELECT doc_id, lang AS sample, {", ".join(f"CASE WHEN len({_WORDS}) > 0 THEN {v} END AS {m}" for m, v in _VALUES.items())} FROM documents),
feat AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(_M))}) t(i, feature)),
wide AS (SELECT sample, doc_id % {_S["raters"]} + 1 AS rater, {", ".join(f"avg({m}) AS {m}" for m in _M)} FROM det WHERE sample IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL),
r AS ({" UNION ALL ".join(f"SELECT sample, rater, '{m}' AS feature, {m} AS v FROM wide WHERE {m} IS NOT NULL" for m in _M)}),
k AS (SELECT feature, count(DISTINCT rater) AS k FROM r GROUP BY feature),
c AS (SELECT r.* FROM r JOIN k USING (feature) JOIN (SELECT feature, sample, count(*) AS n FROM r GROUP BY feature, sample) s ON s.feature = r.feature AND s.sample = r.sample AND s.n = k.k),
w AS (SELECT feature, sample, v, avg(v) OVER (PARTITION BY feature, sample) AS ms, avg(v) OVER (PARTITION BY feature, rater) AS mr, avg(v) OVER (PARTITION BY feature) AS m FROM c),
t AS (SELECT feature, any_value(k) AS k, count(DISTINCT sample) AS n, sum((ms - m) ** 2) AS ssb, sum((v - ms - mr + m) ** 2) AS sse FROM w JOIN k USING (feature) GROUP BY feature),
icc AS (SELECT feature, CASE WHEN ssb > 0 THEN (ssb / (n - 1) - sse / ((n - 1) * (k - 1))) / (ssb / (n - 1)) END AS icc FROM t),
grp AS (SELECT feature, sample, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM r GROUP BY feature, sample HAVING count(*) >= 2),
grand AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM grp GROUP BY feature),
res AS (SELECT g.feature, CASE WHEN max(abs(var)) > 1e-8 THEN (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * var) / (sum(n) - count(*))) END AS f,
  CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2 FROM grp g JOIN grand USING (feature) GROUP BY g.feature),
xs AS (SELECT feature, f, df1 / 2 AS a, df2 / 2 AS b, df1 * f / (df1 * f + df2) AS x, df2 / (df1 * f + df2) AS y FROM res),
pe AS (SELECT feature, sum(exp(b_term)) AS below FROM (SELECT feature, a * ln(x) + lgamma(a + j) - lgamma(a) - lgamma(j + 1) + j * ln(y) AS b_term FROM xs, range(CAST(floor(b) AS BIGINT)) t(j) WHERE b = floor(b) AND f IS NOT NULL) GROUP BY feature),
po AS (SELECT feature, sum(exp(lgamma(a + b + j) - lgamma(a + 1 + j) - lgamma(b) + (a + j) * ln(x) + b * ln(y))) AS below FROM xs, range(200000) t(j) WHERE b > floor(b) AND f IS NOT NULL GROUP BY feature),
pv AS (SELECT feature, CASE WHEN f IS NULL THEN 1.0 ELSE greatest(1 - coalesce(pe.below, po.below), 0) END AS p_value FROM xs LEFT JOIN pe USING (feature) LEFT JOIN po USING (feature)),
good AS (SELECT i, feature, icc, f, df1, df2, p_value, p_value < {_S["alpha"]} / {len(_M)} AS reject, coalesce(icc >= {_S["icc"]} AND p_value < {_S["alpha"]} / {len(_M)}, FALSE) AS good FROM feat JOIN icc USING (feature) JOIN res USING (feature) JOIN pv USING (feature)),
pair AS ({" UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, corr({_M[i]}, {_M[j]}) AS c FROM det" for i, j in _PAIRS)}),
strong AS (SELECT a, b FROM pair WHERE abs(c) > {_S["corr"]} UNION ALL SELECT b, a FROM pair WHERE abs(c) > {_S["corr"]}),
chosen(step, kept) AS (
  SELECT 0, (SELECT list(i ORDER BY i) FROM good WHERE good)
  UNION ALL
  SELECT step + 1, [x FOR x IN kept IF x <> worst] FROM (
    SELECT step, any_value(kept) AS kept, arg_min(i, -1000 * n + i) AS worst, max(n) AS most FROM (
      SELECT d.step, any_value(d.kept) AS kept, g.i, count(s.b) AS n FROM chosen d JOIN feat g ON list_contains(d.kept, g.i) LEFT JOIN strong s ON s.a = g.i AND list_contains(d.kept, s.b) GROUP BY d.step, g.i)
    GROUP BY step) WHERE most > 0),
kept AS (SELECT unnest(kept) AS i FROM (SELECT kept FROM chosen ORDER BY step DESC LIMIT 1)),
scores AS (SELECT good.*, good.i IN (SELECT i FROM kept) AS kept FROM good),
lab AS (SELECT det.*, {", ".join(f"l.{t}" for t in _S["targets"])} FROM det JOIN labels l USING (doc_id)),
rel AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{m}' AS feature, '{t}' AS target, corr({m}, {t}) AS v FROM lab" for i, m in enumerate(_M) for t in _S["targets"])}),
empty AS (SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS sample, {", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in _M)}, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS BIGINT) AS rater, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS value WHERE FALSE)
SELECT * FROM empty
UNION ALL BY NAME SELECT doc_id, sample, {", ".join(f"round({m}, 6) AS {m}" for m in _M)}, 'detail' AS section FROM det
UNION ALL BY NAME SELECT sample, rater, feature, round(v, 6) AS value, 'rating' AS section FROM r
{"".join(f"UNION ALL BY NAME SELECT feature, '{name}' AS target, round(CAST({v} AS DOUBLE), 6) AS value, 'reliability' AS section FROM scores " for name, v in (("icc", "icc"), ("f", "f"), ("df1", "df1"), ("df2", "df2"), ("p_value", "p_value"), ("reject_h0", "reject"), ("good_feature", "good"), ("kept", "kept")))}
UNION ALL BY NAME SELECT feature, target, round(v, 6) AS value, 'correlation' AS section FROM rel WHERE i IN (SELECT i FROM kept)"""

_R = config.load("region_feed")
REGION_FEED = f"""
WITH RECURSIVE {RASTER},
regions AS (
  SELECT image_id, label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x, sqrt(4 * count(*) / pi()) AS equivalent_diameter,
    count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS rectangularity, count(*) < {_R["area_low"]} OR count(*) > {_R["area_high"]} AS outlier, CAST(image_id AS BIGINT) // {_R["images_per_block"]} AS block
  FROM pixels WHERE label > 0 GROUP BY image_id, label)
SELECT 'seeds' AS section, p_partkey, p_size, CAST(p_partkey // {40 * _R["images_per_block"]} AS BIGINT) AS block FROM part
UNION ALL BY NAME SELECT 'regions' AS section, image_id, label, area, round(centroid_y, 6) AS centroid_y, round(centroid_x, 6) AS centroid_x, round(equivalent_diameter, 6) AS equivalent_diameter,
  round(rectangularity, 6) AS rectangularity, outlier, CAST(block AS BIGINT) AS block FROM regions
UNION ALL BY NAME SELECT 'images' AS section, image_id, count(*) AS regions, round(avg(area), 6) AS area_mean, round(stddev_pop(area), 6) AS area_std, count(*) FILTER (outlier) AS outliers, CAST(block AS BIGINT) AS block FROM regions GROUP BY image_id, block"""

QUERIES = {"job1_text_study": job1_text_study, "job2_region_feed": job2_region_feed}
ORACLES = {"job1_text_study": TEXT_STUDY, "job2_region_feed": REGION_FEED}
