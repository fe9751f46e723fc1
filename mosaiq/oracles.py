"""The queries' equivalents in DuckDB SQL over the same tables, written independently of Spark."""

RASTER = """
seeds AS (
  SELECT CAST(p_partkey // 40 AS VARCHAR) AS image_id, CAST(p_partkey % 40 + 1 AS INTEGER) AS seed,
         (p_partkey % 40) // 8 AS r, (p_partkey % 40) % 8 AS c,
         (p_partkey % 40) // 8 * 19 + 5 + (p_size * 7 + p_partkey * 3) % 10 AS sy,
         (p_partkey % 40) % 8 * 16 + 3 + (p_size * 5 + p_partkey * 11) % 10 AS sx,
         p_partkey AS k, p_size AS z
  FROM part),
images AS (SELECT DISTINCT image_id FROM seeds),
grid AS (SELECT image_id, y, x FROM images, range(96) a(y), range(128) b(x)),
cand AS (
  SELECT g.image_id, g.y, g.x, s.seed, (g.y - s.sy) * (g.y - s.sy) + (g.x - s.sx) * (g.x - s.sx) AS d2
  FROM grid g JOIN seeds s ON s.image_id = g.image_id AND s.r BETWEEN g.y // 19 - 1 AND g.y // 19 + 1 AND s.c BETWEEN g.x // 16 - 1 AND g.x // 16 + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY d2, seed) AS rn FROM cand),
pixels AS (
  SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
         CAST(CASE WHEN sqrt(max(d2) FILTER (rn = 2)) - sqrt(max(d2) FILTER (rn = 1)) >= 1.5 OR max(d2) FILTER (rn = 2) IS NULL
              THEN max(seed) FILTER (rn = 1) ELSE 0 END AS INTEGER) AS label
  FROM ranked WHERE rn <= 2 GROUP BY image_id, y, x)"""

MOSAIC = RASTER.replace("1.5", "0")

POINTS = """
points AS (
  SELECT CAST(p_partkey // 40 AS VARCHAR) AS image_id, CAST(p_partkey % 40 + 1 AS INTEGER) AS label,
         (p_partkey % 40) // 8 * 19 + 5 + (p_size * 7 + p_partkey * 3) % 10 + CAST(0.0001 AS DOUBLE) * ((p_partkey * 7919 + p_size * 977) % 9739) / 10 AS y,
         (p_partkey % 40) % 8 * 16 + 3 + (p_size * 5 + p_partkey * 11) % 10 + CAST(0.0001 AS DOUBLE) * ((p_partkey * 6007 + p_size * 131) % 8887) / 10 AS x
  FROM part)"""

NEAR = """
near AS (
  SELECT *, lag(label) OVER c AS num, lead(label) OVER c AS ndm, lag(label) OVER w AS nml, lead(label) OVER w AS nmr,
         lag(label) OVER a AS nul, lead(label) OVER a AS ndr, lag(label) OVER b AS nur, lead(label) OVER b AS ndl
  FROM pixels
  WINDOW c AS (PARTITION BY image_id, x ORDER BY y), w AS (PARTITION BY image_id, y ORDER BY x),
         a AS (PARTITION BY image_id, y - x ORDER BY y), b AS (PARTITION BY image_id, y + x ORDER BY y)),
inner_boundary AS (
  SELECT image_id, y, x, label FROM near
  WHERE label > 0 AND (coalesce(num <> label, FALSE) OR coalesce(ndm <> label, FALSE) OR coalesce(nml <> label, FALSE) OR coalesce(nmr <> label, FALSE)))"""

GEOMETRY = """
geo AS (
  SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS min_y, min(x) AS min_x, max(y) AS max_y, max(x) AS max_x,
         CAST((max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS BIGINT) AS area_bbox, sqrt(4 * count(*) / pi()) AS eqd
  FROM pixels WHERE label > 0 GROUP BY image_id, label)"""

PERIMETER = """
border AS (
  SELECT image_id, y, x, CASE WHEN label > 0 AND NOT (coalesce(num, 0) = label AND coalesce(ndm, 0) = label AND coalesce(nml, 0) = label AND coalesce(nmr, 0) = label) THEN label ELSE 0 END AS label
  FROM near),
border_near AS (
  SELECT *, lag(label) OVER c AS num, lead(label) OVER c AS ndm, lag(label) OVER w AS nml, lead(label) OVER w AS nmr,
         lag(label) OVER a AS nul, lead(label) OVER a AS ndr, lag(label) OVER b AS nur, lead(label) OVER b AS ndl
  FROM border
  WINDOW c AS (PARTITION BY image_id, x ORDER BY y), w AS (PARTITION BY image_id, y ORDER BY x),
         a AS (PARTITION BY image_id, y - x ORDER BY y), b AS (PARTITION BY image_id, y + x ORDER BY y)),
coded AS (
  SELECT image_id, label,
         1 + 2 * (coalesce(num = label, FALSE)::INT + coalesce(ndm = label, FALSE)::INT + coalesce(nml = label, FALSE)::INT + coalesce(nmr = label, FALSE)::INT)
           + 10 * (coalesce(nul = label, FALSE)::INT + coalesce(ndr = label, FALSE)::INT + coalesce(nur = label, FALSE)::INT + coalesce(ndl = label, FALSE)::INT) AS code
  FROM border_near WHERE label > 0),
perim AS (
  SELECT image_id, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter
  FROM coded GROUP BY image_id, label)"""

MOMENTS = """
mom AS (
  SELECT p.image_id, p.label, any_value(g.area) AS area,
         sum((y - cy) ** 2) AS mu20, sum((x - cx) ** 2) AS mu02, sum((y - cy) * (x - cx)) AS mu11, sum((y - cy) ** 3) AS mu30, sum((x - cx) ** 3) AS mu03,
         sum((y - cy) ** 2 * (x - cx)) AS mu21, sum((y - cy) * (x - cx) ** 2) AS mu12
  FROM pixels p JOIN geo g USING (image_id, label) GROUP BY p.image_id, p.label)"""

ADJACENCY = """
adj AS (
  SELECT image_id, src, dst, count(*) AS contact
  FROM (SELECT image_id, label AS src, unnest([nul, num, nur, nml, nmr, ndl, ndm, ndr]) AS dst FROM near WHERE label > 0)
  WHERE dst > 0 AND dst <> src GROUP BY image_id, src, dst)"""

DELAUNAY = """
pair AS (
  SELECT a.image_id, a.label AS src, b.label AS dst, a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx,
         sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS weight
  FROM points a JOIN points b ON a.image_id = b.image_id AND a.label < b.label),
bound AS (
  SELECT p.image_id, p.src, p.dst, p.weight, -(by_ - ay) * (k.x - ax) + (bx - ax) * (k.y - ay) AS ca,
         (k.x * k.x + k.y * k.y - ax * ax - ay * ay - (ax + bx) * (k.x - ax) - (ay + by_) * (k.y - ay)) / 2 AS cb
  FROM pair p JOIN points k ON k.image_id = p.image_id AND k.label <> p.src AND k.label <> p.dst),
edges AS (
  SELECT image_id, src, dst, any_value(weight) AS weight FROM bound GROUP BY image_id, src, dst
  HAVING coalesce(max(CASE WHEN ca < 0 THEN cb / ca END) < min(CASE WHEN ca > 0 THEN cb / ca END), TRUE) AND count(*) FILTER (ca = 0 AND cb < 0) = 0)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


DILATED = """
, hit AS (SELECT DISTINCT b.image_id, b.y + dy AS y, b.x + dx AS x FROM inner_boundary b, range(-{r}, {r1}) a(dy), range(-{r}, {r1}) c(dx) WHERE dy * dy + dx * dx <= {rr})
SELECT image_id, count(*) AS pixels, CAST(sum(y * 131 + x) AS BIGINT) AS place FROM hit WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 127 GROUP BY image_id"""

ORACLES = {
    "image_region_stats": _with(RASTER, GEOMETRY) + """
SELECT image_id, count(*) AS num_grains, round(avg(area), 6) AS area_mean, round(stddev_pop(area), 6) AS area_std,
       round(avg(eqd / 2), 6) AS radius_mean, round(stddev_pop(eqd / 2), 6) AS radius_std
FROM geo GROUP BY image_id""",
    "label_raster": _with(RASTER) + """
SELECT image_id, label, count(*) AS n, CAST(sum(y * 131 + x) AS BIGINT) AS place FROM pixels GROUP BY image_id, label""",
    "region_geometry": _with(RASTER, GEOMETRY) + """
SELECT image_id, label, area, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, min_y, min_x, max_y, max_x, area_bbox,
       round(eqd, 6) AS equivalent_diameter, round(area / area_bbox, 6) AS rectangularity FROM geo""",
    "region_axes": _with(RASTER, GEOMETRY, MOMENTS) + """
, ax AS (SELECT image_id, label, 4 * sqrt(((mu20 + mu02) + sqrt(4 * mu11 ** 2 + (mu20 - mu02) ** 2)) / 2 / area) AS major,
              4 * sqrt(greatest(((mu20 + mu02) - sqrt(4 * mu11 ** 2 + (mu20 - mu02) ** 2)) / 2 / area, 0)) AS minor FROM mom)
SELECT image_id, label, round(major, 5) AS major_axis_length, round(minor, 5) AS minor_axis_length, round(major / (minor + 1e-6), 5) AS aspect_ratio,
       round(CASE WHEN major > 0 THEN 1 - minor / (major + 1e-6) ELSE 0 END, 5) AS elongation FROM ax""",
    "region_orientation": _with(RASTER, GEOMETRY, MOMENTS) + """
SELECT image_id, label, round(CASE WHEN area < 2 THEN 0 ELSE 0.5 * atan2(2 * b, a - c) END, 5) + 0.0 AS orientation,
       round(CASE WHEN a = c THEN CASE WHEN b > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE 0.5 * atan2(2 * b, a - c) END, 5) + 0.0 AS inertia_orientation
FROM (SELECT image_id, label, area, round(mu20, 6) AS a, round(mu02, 6) AS c, round(mu11, 6) + 0.0 AS b FROM mom)""",
    "region_hu": _with(RASTER, GEOMETRY, MOMENTS) + """
, e AS (SELECT image_id, label, mu20 / area ** 2 AS n20, mu02 / area ** 2 AS n02, mu11 / area ** 2 AS n11, mu30 / area ** 2.5 AS n30, mu03 / area ** 2.5 AS n03,
             mu21 / area ** 2.5 AS n21, mu12 / area ** 2.5 AS n12 FROM mom)
SELECT image_id, label, round(n20 + n02, 9) AS hu_moments_0, round((n20 - n02) ** 2 + 4 * n11 ** 2, 9) AS hu_moments_1,
       round((n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2, 9) AS hu_moments_2, round((n30 + n12) ** 2 + (n21 + n03) ** 2, 9) AS hu_moments_3,
       round((n30 - 3 * n12) * (n30 + n12) * ((n30 + n12) ** 2 - 3 * (n21 + n03) ** 2) + (3 * n21 - n03) * (n21 + n03) * (3 * (n30 + n12) ** 2 - (n21 + n03) ** 2), 9) + 0 AS hu_moments_4,
       round((n20 - n02) * ((n30 + n12) ** 2 - (n21 + n03) ** 2) + 4 * n11 * (n30 + n12) * (n21 + n03), 9) + 0 AS hu_moments_5,
       round((3 * n21 - n03) * (n30 + n12) * ((n30 + n12) ** 2 - 3 * (n21 + n03) ** 2) - (n30 - 3 * n12) * (n21 + n03) * (3 * (n30 + n12) ** 2 - (n21 + n03) ** 2), 9) + 0 AS hu_moments_6
FROM e""",
    "adjacency_edges": _with(MOSAIC, NEAR, ADJACENCY) + """
SELECT image_id, src, dst, contact FROM adj""",
    "boundary_pixels": _with(RASTER, NEAR) + """
SELECT image_id, label, count(*) AS boundary_pixels FROM inner_boundary GROUP BY image_id, label""",
    "total_boundary_length": _with(RASTER, NEAR) + """
SELECT image_id, count(*) AS total_boundary_length FROM inner_boundary GROUP BY image_id""",
    "region_perimeter": _with(RASTER, NEAR, GEOMETRY, PERIMETER) + """
SELECT image_id, label, round(perimeter, 6) AS perimeter, round(CASE WHEN perimeter > 0 THEN 4 * pi() * area / (perimeter ** 2 + 1e-6) ELSE 0 END, 6) AS compactness,
       round(CASE WHEN perimeter > 0 THEN 4 * pi() * area / perimeter ** 2 ELSE 0 END, 6) AS shape_compactness, round(perimeter / sqrt(area), 6) AS perimeter_area_ratio,
       round(perimeter / (2 * sqrt(pi() * area)), 6) AS slenderness FROM perim JOIN geo USING (image_id, label)""",
    "neighbor_area_stats": _with(MOSAIC, NEAR, GEOMETRY, ADJACENCY) + """
SELECT g.image_id, g.label, round(coalesce(avg(n.area), 0), 6) AS neighbor_area_mean, round(coalesce(stddev_pop(n.area), 0), 6) AS neighbor_area_std,
       round(coalesce(stddev_pop(n.area) / (avg(n.area) + 1e-6), 0), 6) AS neighbor_size_variation
FROM geo g LEFT JOIN adj a ON a.image_id = g.image_id AND a.src = g.label LEFT JOIN geo n ON n.image_id = g.image_id AND n.label = a.dst GROUP BY g.image_id, g.label""",
    "topology_features": _with(MOSAIC, NEAR, ADJACENCY, POINTS, DELAUNAY) + """
, two AS (SELECT image_id, src, dst FROM edges UNION ALL SELECT image_id, dst, src FROM edges),
al AS (SELECT image_id, src, dst, TRUE AS a FROM adj), vo AS (SELECT image_id, src, dst, TRUE AS v FROM two),
f AS (SELECT image_id, src, count(a) AS na, count(v) AS nv, count(*) FILTER (a AND v) AS common FROM al FULL JOIN vo USING (image_id, src, dst) GROUP BY image_id, src)
SELECT p.image_id, p.label, coalesce(na, 0) AS neighbor_count, CAST(coalesce(na, 0) >= 3 AS DOUBLE) AS triple_junction, coalesce(nv, 0) AS voronoi_neighbors,
       coalesce(common, 0) AS neighbor_consistency, coalesce(na - common, 0) AS extra_neighbors, coalesce(nv - common, 0) AS missing_neighbors
FROM points p LEFT JOIN f ON f.image_id = p.image_id AND f.src = p.label""",
    "fractal_regions": _with(RASTER) + """
, fr AS (SELECT image_id, label, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM pixels WHERE label > 0 GROUP BY image_id, label),
sc AS (SELECT DISTINCT f.*, CAST(round_even(10 ** (log10(greatest(h, w)) * i / 9), 0) AS INTEGER) AS s FROM fr f, range(10) t(i) WHERE greatest(h, w) > 1),
bx AS (SELECT DISTINCT p.image_id, p.label, s, (y - y0) // s AS by_, (x - x0) // s AS bx FROM pixels p JOIN sc USING (image_id, label) WHERE s <= least(h, w)),
ct AS (SELECT image_id, label, s, count(*) AS n FROM bx GROUP BY image_id, label, s),
sl AS (SELECT image_id, label, CASE WHEN count(*) >= 2 THEN -regr_slope(ln(n), ln(s)) END AS d FROM ct GROUP BY image_id, label)
SELECT image_id, label, round(coalesce(d, 0), 6) AS fractal_dimension_boxcount FROM fr LEFT JOIN sl USING (image_id, label)""",
    "fractal_boundaries": _with(RASTER, NEAR) + """
, bx AS (SELECT DISTINCT image_id, k, y // (1 << k) AS by_, x // (1 << k) AS bx FROM inner_boundary, range(1, 6) t(k)),
ct AS (SELECT image_id, k, count(*) AS n FROM bx GROUP BY image_id, k)
SELECT image_id, round(-regr_slope(ln(n), k * ln(2)), 6) AS boundary_fractal_dim FROM ct GROUP BY image_id""",
    "dilate_disk": _with(RASTER, NEAR) + DILATED.format(r=5, r1=6, rr=25),
    "dilate_disk_all": _with(RASTER, NEAR) + DILATED.format(r=3, r1=4, rr=9),
    "distance_map": _with(RASTER) + """
, back AS (SELECT image_id, y, x FROM pixels WHERE label = 0),
d AS (SELECT p.image_id, p.label, sqrt(min((p.y - b.y) ** 2 + (p.x - b.x) ** 2)) AS d FROM pixels p JOIN back b USING (image_id) WHERE p.label > 0 GROUP BY p.image_id, p.label, p.y, p.x)
SELECT image_id, label, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM d GROUP BY image_id, label""",
    "thin_background": _with(RASTER) + """
, thin AS (SELECT DISTINCT b.image_id, b.y, b.x FROM pixels b, range(-3, 4) a(dy), range(-3, 4) c(dx), pixels o
  WHERE b.label = 0 AND o.label > 0 AND o.image_id = b.image_id AND o.y = b.y + dy AND o.x = b.x + dx AND dy * dy + dx * dx <= 9)
SELECT image_id, count(*) AS pixels, CAST(sum(y * 131 + x) AS BIGINT) AS place FROM thin GROUP BY image_id""",
    "nn_distance": _with(POINTS) + """
, d AS (SELECT a.image_id, a.label, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS nn FROM points a JOIN points b ON a.image_id = b.image_id AND a.label <> b.label GROUP BY a.image_id, a.label)
SELECT image_id, round(avg(nn), 6) AS nn_dist_mean, round(stddev_pop(nn), 6) AS nn_dist_std FROM d GROUP BY image_id""",
    "pairwise_distance": _with(POINTS) + """
, d AS (SELECT a.image_id, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM points a JOIN points b ON a.image_id = b.image_id AND a.label < b.label)
SELECT image_id, round(avg(d), 6) AS pairwise_dist_mean, round(stddev_pop(d), 6) AS pairwise_dist_std FROM d GROUP BY image_id""",
    "delaunay_edges": _with(POINTS, DELAUNAY) + """
SELECT image_id, src, dst, round(weight, 6) AS weight FROM edges""",
    "degree_distribution": _with(POINTS, DELAUNAY) + """
, t AS (SELECT unnest([20, 50, 100, 150]) AS threshold),
deg AS (SELECT p.image_id, t.threshold, p.label, count(e.src) AS degree FROM points p CROSS JOIN t
  LEFT JOIN (SELECT image_id, src, weight FROM edges UNION ALL SELECT image_id, dst, weight FROM edges) e ON e.image_id = p.image_id AND e.src = p.label AND e.weight <= t.threshold
  GROUP BY p.image_id, t.threshold, p.label)
SELECT image_id, CAST(threshold AS INTEGER) AS threshold, """ + ", ".join(f"count(*) FILTER (degree = {d}) AS degree_dist_{d}" for d in range(9)) + """
FROM deg GROUP BY image_id, threshold""",
    "avg_clustering": _with(POINTS, DELAUNAY) + """
, e AS (SELECT image_id, src, dst FROM edges WHERE weight <= 50), b AS (SELECT * FROM e UNION ALL SELECT image_id, dst, src FROM e),
deg AS (SELECT image_id, src, count(*) AS k FROM b GROUP BY image_id, src),
tri AS (SELECT image_id, u, count(*) AS t FROM (
   SELECT x.image_id, unnest([x.src, x.dst, y.dst]) AS u FROM e x JOIN e y ON y.image_id = x.image_id AND y.src = x.dst JOIN e z ON z.image_id = x.image_id AND z.src = x.src AND z.dst = y.dst) GROUP BY image_id, u)
SELECT p.image_id, round(avg(CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS avg_clustering
FROM points p LEFT JOIN deg d ON d.image_id = p.image_id AND d.src = p.label LEFT JOIN tri r ON r.image_id = p.image_id AND r.u = p.label GROUP BY p.image_id""",
}

EVENTS_LONG = """
ev AS (SELECT event_id, event_type AS sample, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rater, value, CAST(user_id AS DOUBLE) AS usr FROM events),
long AS (SELECT sample, rater, 'value' AS feature, value AS v FROM ev UNION ALL SELECT sample, rater, 'user', usr FROM ev UNION ALL SELECT sample, rater, 'flat', 5.0 FROM ev)"""

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = "long AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS sample, '{m}' AS feature, CAST({m} AS DOUBLE) AS v FROM lineitem" for m in MEASURES) + ")"

ANOVA = """
grp AS (SELECT feature, sample, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM long WHERE v IS NOT NULL GROUP BY feature, sample HAVING count(*) >= 2),
grand AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM grp GROUP BY feature),
res AS (SELECT g.feature, CASE WHEN max(abs(var)) > 1e-8 THEN (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * var) / (sum(n) - count(*))) END AS f,
          CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2 FROM grp g JOIN grand USING (feature) GROUP BY g.feature)"""

DEGREES = _with(POINTS, DELAUNAY) + """
, deg AS (SELECT p.image_id, p.label, count(e.src) AS degree FROM points p
  LEFT JOIN (SELECT image_id, src, weight FROM edges UNION ALL SELECT image_id, dst, weight FROM edges) e ON e.image_id = p.image_id AND e.src = p.label AND e.weight <= 50
  GROUP BY p.image_id, p.label)
"""

GAPS = "gaps AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS usr FROM events)"

ORACLES |= {
    "rater_index": "SELECT event_id, event_type AS sample, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rater FROM events",
    "icc3k": _with(EVENTS_LONG) + """
, r AS (SELECT * FROM long WHERE rater <= 8), k AS (SELECT feature, count(DISTINCT rater) AS k FROM r GROUP BY feature),
c AS (SELECT r.* FROM r JOIN k USING (feature) JOIN (SELECT feature, sample, count(*) AS n FROM r GROUP BY feature, sample) s ON s.feature = r.feature AND s.sample = r.sample AND s.n = k.k),
w AS (SELECT feature, sample, v, avg(v) OVER (PARTITION BY feature, sample) AS ms, avg(v) OVER (PARTITION BY feature, rater) AS mr, avg(v) OVER (PARTITION BY feature) AS m FROM c),
t AS (SELECT feature, any_value(k) AS k, count(DISTINCT sample) AS n, sum((ms - m) ** 2) AS ssb, sum((v - ms - mr + m) ** 2) AS sse FROM w JOIN k USING (feature) GROUP BY feature)
SELECT feature, round(CASE WHEN ssb > 0 THEN (ssb / (n - 1) - sse / ((n - 1) * (k - 1))) / (ssb / (n - 1)) END, 6) AS icc FROM t""",
    "anova_f": "WITH " + LINE_LONG + "," + ANOVA + " SELECT feature, round(f, 6) AS f, df1, df2 FROM res",
    "levene_f": "WITH " + LINE_LONG.replace("long AS", "raw AS") + """
, md AS (SELECT feature, sample, quantile_cont(v, 0.5) AS q FROM raw GROUP BY feature, sample),
long AS (SELECT feature, sample, abs(v - q) AS v FROM raw JOIN md USING (feature, sample)),""" + ANOVA + " SELECT feature, round(f, 6) AS f FROM res",
    "sample_means": "SELECT l_returnflag, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEASURES) + " FROM lineitem GROUP BY l_returnflag",
    "variance_filter": " UNION ALL ".join(
        f"SELECT '{m}' AS feature, round(var_pop({m}), 6) AS variance, var_pop({m}) > 0 AND max({m}) > min({m}) AS kept FROM lineitem" for m in MEASURES
    ) + " UNION ALL SELECT 'constant', 0.0, FALSE",
    "corr_matrix": """WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT 'd' || a.i AS feature_a, 'd' || b.i AS feature_b, round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 6) AS corr
FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""",
    "feature_target_corr": " UNION ALL ".join(
        f"SELECT '{f or 'flat'}' AS feature, '{t}' AS target, " + (f"round(covar_pop({f}, {t}) / nullif(stddev_pop({f}) * stddev_pop({t}), 0), 6)" if f else "CAST(NULL AS DOUBLE)") + " AS corr" + (" FROM lineitem" if f else "")
        for f in ("l_quantity", "l_discount", "")
        for t in ("l_extendedprice", "l_tax")
    ),
    "merge_features_external": "SELECT o_custkey AS sample_id, o_orderkey, o_totalprice AS amount_x, c_acctbal AS amount_y, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "target_groups": """WITH f AS (SELECT o_custkey AS id, avg(o_totalprice) AS price, count(*) AS orders FROM orders GROUP BY o_custkey),
m AS (SELECT price, orders, c_acctbal AS hc, c_nationkey AS c, c_custkey % 7 AS a FROM f JOIN customer ON c_custkey = id)
SELECT 'props' AS target_group, 'price' AS feature, 'Hc20' AS target, round(corr(price, hc), 6) AS corr FROM m UNION ALL SELECT 'props' AS target_group, 'orders' AS feature, 'Hc20' AS target, round(corr(orders, hc), 6) AS corr FROM m UNION ALL SELECT 'pps' AS target_group, 'price' AS feature, 'C' AS target, round(corr(price, c), 6) AS corr FROM m UNION ALL SELECT 'pps' AS target_group, 'orders' AS feature, 'C' AS target, round(corr(orders, c), 6) AS corr FROM m UNION ALL SELECT 'effs' AS target_group, 'price' AS feature, 'alpha' AS target, round(corr(price, a), 6) AS corr FROM m UNION ALL SELECT 'effs' AS target_group, 'orders' AS feature, 'alpha' AS target, round(corr(orders, a), 6) AS corr FROM m""",
    "random_rows": "SELECT p_partkey FROM part ORDER BY ((p_partkey + 42) % 2147483647) * (2654435761 % 2147483647) % 2147483647, p_partkey LIMIT 100",
    "coerce_numeric": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS page, CAST(NULL AS DOUBLE) AS bad, CAST(user_id AS DOUBLE) AS \"user\" FROM events",
    "drop_empty_columns": "SELECT 'value' AS feature UNION ALL SELECT 'user'",
    "impute_mean": "WITH " + GAPS + ' SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value, round(coalesce(usr, avg(usr) OVER ()), 6) AS "user" FROM gaps',
    "fill_zero": "WITH " + GAPS + ' SELECT event_id, coalesce(value, 0) AS value, coalesce(usr, 0) AS "user" FROM gaps',
    "drop_missing": "WITH " + GAPS + ' SELECT event_id, value, usr AS "user" FROM gaps WHERE value IS NOT NULL AND usr IS NOT NULL',
    "nan_to_zero": "SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 0.0 ELSE value END AS value FROM events",
    "standardize_pop": "WITH " + GAPS + """, f AS (SELECT event_id, coalesce(value, avg(value) OVER ()) AS a, coalesce(usr, avg(usr) OVER ()) AS b FROM gaps)
SELECT event_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 5) + 0.0 AS value, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) + 0.0 AS "user" FROM f""",
    "regex_sample_id": """SELECT event_id, 'S' || event_id % 17 AS by_name,
  CASE WHEN event_id % 2 = 0 THEN 'dir' || event_id % 4 ELSE 'S' || event_id % 17 || '_' || event_type END AS by_path FROM events""",
    "concat_union_by_name": 'SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN CAST(user_id AS DOUBLE) END AS "user" FROM events',
    "topk_importance": "SELECT event_type, round(avg(abs(value)), 6) AS importance FROM events GROUP BY event_type ORDER BY importance DESC, event_type LIMIT 5",
    "neighbour_sets": """SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 15 AND n_nationkey % 2 = 1 THEN 'common' WHEN n_nationkey < 15 THEN 'extra' ELSE 'missing' END AS part
FROM nation WHERE n_nationkey < 15 OR n_nationkey % 2 = 1""",
    "degree_value_counts": DEGREES + "SELECT degree AS value, count(*) AS n FROM deg GROUP BY degree",
    "value_histogram": """WITH e AS (SELECT floor(min(value)) AS lo, ceil(max(value)) AS hi FROM events), b AS (SELECT least(floor((value - lo) / 2.5), greatest(1, ceil((hi + 2.5 - lo) / 2.5) - 1) - 1) AS bin, lo FROM events, e)
SELECT CAST(bin AS BIGINT) AS bin, any_value(lo) + bin * 2.5 AS low, count(*) AS n FROM b GROUP BY bin""",
    "histogram_by_sample": """WITH e AS (SELECT floor(min(value)) AS lo, ceil(max(value)) AS hi FROM events), b AS (SELECT event_type, least(floor((value - lo) / 10.0), greatest(1, ceil((hi + 10.0 - lo) / 10.0) - 1) - 1) AS bin, lo FROM events, e)
SELECT event_type, CAST(bin AS BIGINT) AS bin, any_value(lo) + bin * 10.0 AS low, count(*) AS n FROM b GROUP BY event_type, bin""",
    "compare_quartiles": """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outside
FROM events JOIN q USING (event_type) GROUP BY event_type""",
    "compare_ordered": """WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, CAST(dense_rank() OVER (ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR)) AS INTEGER) AS position FROM customer WHERE c_custkey % 3 > 0 AND c_acctbal IS NOT NULL)
SELECT sample, position, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN r ON sample = CAST(user_id AS VARCHAR) GROUP BY sample, position""",
    "kde_grid": """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * count(*) ** -0.2 AS h, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
g AS (SELECT *, lo - 3 * h + p * ((hi - lo + 6 * h) / 31) AS x FROM s, range(32) t(p))
SELECT g.event_type, CAST(p AS INTEGER) AS point, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density
FROM g JOIN events e ON e.event_type = g.event_type GROUP BY g.event_type, p""",
    "kde_2d": """WITH s AS (SELECT count(*) AS n, stddev_samp(value) * count(*) ** (-1.0 / 6) AS hx, stddev_samp(user_id) * count(*) ** (-1.0 / 6) AS hy, min(value) AS x0, max(value) AS x1, min(user_id) AS y0, max(user_id) AS y1 FROM events)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(exp(-0.5 * (((x0 + i * ((x1 - x0) / 11) - value) / hx) ** 2 + ((y0 + j * ((y1 - y0) / 11) - user_id) / hy) ** 2))) / any_value(n * hx * hy * 2 * pi()), 9) AS density
FROM events, s, range(12) a(i), range(12) b(j) GROUP BY i, j""",
    "hexbin": """WITH r AS (SELECT CAST(min(o_totalprice) AS DOUBLE) AS x0, (max(o_totalprice) - min(o_totalprice)) / 30 AS sx, CAST(min(o_custkey) AS DOUBLE) AS y0, (max(o_custkey) - min(o_custkey)) / CAST(17 AS DOUBLE) AS sy FROM orders),
u AS (SELECT (o_totalprice - x0) / sx AS u, (o_custkey - y0) / sy AS v FROM orders, r),
w AS (SELECT u, v, round_even(u, 0) AS a, round_even(v, 0) AS b, floor(u) AS c, floor(v) AS d FROM u),
z AS (SELECT *, (u - a) ** 2 + 3 * (v - b) ** 2 < (u - c - 0.5) ** 2 + 3 * (v - d - 0.5) ** 2 AS one FROM w)
SELECT CASE WHEN one THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN one THEN a ELSE c END AS BIGINT) AS ix, CAST(CASE WHEN one THEN b ELSE d END AS BIGINT) AS iy, count(*) AS n FROM z GROUP BY ALL""",
    "outlier_flags": DEGREES + "SELECT image_id, label, degree, coalesce(degree < 3 OR degree > 7, FALSE) AS is_outlier FROM deg",
    "node_scaling": DEGREES + """SELECT image_id, label, degree, round(CASE WHEN max(degree) OVER w > min(degree) OVER w THEN 50 + (degree - min(degree) OVER w) / CAST(max(degree) OVER w - min(degree) OVER w AS DOUBLE) * 450 ELSE 275 END, 6) AS size
FROM deg WINDOW w AS (PARTITION BY image_id)""",
    "discrete_colormap": DEGREES + """, u AS (SELECT image_id, CAST(degree AS DOUBLE) AS v FROM deg UNION ALL SELECT l_returnflag, l_discount FROM lineitem),
s AS (SELECT image_id, count(DISTINCT v) AS n_values, bool_and(v = floor(v)) AS whole FROM u GROUP BY image_id)
SELECT image_id, n_values, CASE WHEN whole AND n_values BETWEEN 2 AND 10 THEN 'tab10' WHEN whole AND n_values BETWEEN 11 AND 20 THEN 'tab20' ELSE 'continuous' END AS scheme FROM s""",
    "spatial_coloring": _with(RASTER, POINTS, DELAUNAY) + DEGREES[DEGREES.index(", deg AS") :] + """, val AS (SELECT image_id, label, CAST(degree AS DOUBLE) AS v FROM deg WHERE label % 5 > 0), least AS (SELECT image_id, min(v) AS lo FROM val GROUP BY image_id)
SELECT p.image_id, p.label, count(*) AS pixels, max(CASE WHEN p.label > 0 THEN coalesce(v, lo) END) AS value
FROM pixels p LEFT JOIN val USING (image_id, label) LEFT JOIN least USING (image_id) GROUP BY p.image_id, p.label""",
    "file_match": """SELECT 'P' || p_partkey % 3 AS parent, CAST(p_partkey AS VARCHAR) AS id,
  CASE WHEN p_partkey % 5 <> 0 THEN 'out/' || CASE WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey % 3 || '_' ELSE 'other_' END || p_partkey || '_details.csv' END AS path FROM part""",
    "delaunay_kernel": _with(POINTS, DELAUNAY) + " SELECT image_id, src, dst, round(weight, 6) AS weight FROM edges",
    "delaunay_degree_29": _with(RASTER, GEOMETRY, POINTS, DELAUNAY) + """
, r AS (SELECT image_id, avg(eqd / 2) AS m, stddev_pop(eqd / 2) AS s FROM geo GROUP BY image_id), two AS (SELECT image_id, src, weight FROM edges UNION ALL SELECT image_id, dst, weight FROM edges)
SELECT p.image_id, p.label, """ + ", ".join(f"count(*) FILTER (weight <= {t}) AS delaunay_degree_fixed_{t}" for t in (20, 50, 100, 150)) + ", " + ", ".join(
        f"count(*) FILTER (weight <= greatest(0, {k} * m + {i} * s)) AS delaunay_degree_adaptive_{k}r{str(i).replace('.', '_')}std" for k in (1, 2, 4, 6, 8) for i in (0, 0.5, 1, 1.5, 2)
    ) + """
FROM points p JOIN r ON r.image_id = p.image_id LEFT JOIN two ON two.image_id = p.image_id AND two.src = p.label GROUP BY p.image_id, p.label""",
    "thick_boundaries": _with(RASTER, NEAR) + """
SELECT image_id, count(*) AS pixels, CAST(sum(y * 131 + x) AS BIGINT) AS place FROM near
WHERE coalesce(num <> label, FALSE) OR coalesce(ndm <> label, FALSE) OR coalesce(nml <> label, FALSE) OR coalesce(nmr <> label, FALSE) GROUP BY image_id""",
    "raster_faults": _with(MOSAIC) + """
, m AS (SELECT DISTINCT image_id, label, y + dy AS y, x + dx AS x FROM pixels, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4),
p AS (SELECT image_id, y, x, count(*) AS n FROM m WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 127 GROUP BY ALL)
SELECT image_id, CAST(0 AS BIGINT) AS missing, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unlabelled FROM p GROUP BY image_id HAVING sum(n - 1) > 0""",
    "labels_from_masks": _with(MOSAIC) + """
, m AS (SELECT image_id, y + dy AS y, x + dx AS x, min(label) AS label FROM pixels, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4 GROUP BY ALL)
SELECT image_id, CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(y * 131 + x) AS BIGINT) AS place FROM m WHERE y BETWEEN 0 AND 95 AND x BETWEEN 0 AND 127 GROUP BY image_id, label""",
    "persistence_h0": _with(POINTS) + """
, e AS (SELECT a.image_id, a.label AS s, b.label AS t, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS w FROM points a JOIN points b ON a.image_id = b.image_id AND a.label < b.label),
two AS (SELECT image_id, s, t, w FROM e UNION ALL SELECT image_id, t, s, w FROM e),
-- an edge is in the minimum spanning tree iff its ends are not joined by shorter edges
reach(image_id, s, t, w, pos) AS (SELECT image_id, s, t, w, s FROM e WHERE w <= 30 UNION SELECT r.image_id, r.s, r.t, r.w, x.t FROM reach r JOIN two x ON x.image_id = r.image_id AND x.s = r.pos AND (x.w, least(x.s, x.t), greatest(x.s, x.t)) < (r.w, r.s, r.t))
SELECT e.image_id, round(e.w, 6) AS death FROM e WHERE w <= 30 AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.image_id = e.image_id AND r.s = e.s AND r.t = e.t AND r.pos = e.t)""",
}

P_VALUE = """
, pv AS (
  -- the upper tail of F for an even df1 is a finite sum; a feature that varies in no sample has f NULL and p 1
  SELECT feature, CASE WHEN any_value(f) IS NULL THEN 1.0 ELSE sum(exp(df2 / 2 * ln(df2 / (df1 * f + df2)) + lgamma(df2 / 2 + j) - lgamma(df2 / 2) - lgamma(j + 1) + j * ln(df1 * f / (df1 * f + df2)))) END AS p_value
  FROM res, range(CAST(df1 / 2 AS BIGINT)) t(j) GROUP BY feature)"""

ICC = """
r AS (SELECT * FROM long WHERE rater <= 8), k AS (SELECT feature, count(DISTINCT rater) AS k FROM r GROUP BY feature),
c AS (SELECT r.* FROM r JOIN k USING (feature) JOIN (SELECT feature, sample, count(*) AS n FROM r GROUP BY feature, sample) s ON s.feature = r.feature AND s.sample = r.sample AND s.n = k.k),
w AS (SELECT feature, sample, v, avg(v) OVER (PARTITION BY feature, sample) AS ms, avg(v) OVER (PARTITION BY feature, rater) AS mr, avg(v) OVER (PARTITION BY feature) AS m FROM c),
t AS (SELECT feature, any_value(k) AS k, count(DISTINCT sample) AS n, sum((ms - m) ** 2) AS ssb, sum((v - ms - mr + m) ** 2) AS sse FROM w JOIN k USING (feature) GROUP BY feature),
icc AS (SELECT feature, CASE WHEN ssb > 0 THEN (ssb / (n - 1) - sse / ((n - 1) * (k - 1))) / (ssb / (n - 1)) END AS icc FROM t)"""

#: The columns that the correlation filter chooses from.
LIKE_COLUMNS = {**{m: m for m in MEASURES}, "quantity_twice": "l_quantity * 2 + 1", "quantity_std": "l_quantity + l_tax", "discount_less": "-l_discount"}

ORACLES |= {
    "anova_p": "WITH " + LINE_LONG + "," + ANOVA + P_VALUE + " SELECT feature, round(p_value, 6) AS p_value, p_value < 0.05 / 4 AS reject_h0 FROM pv",
    "good_features": _with(EVENTS_LONG, ICC, ANOVA) + P_VALUE + """
SELECT feature, round(icc, 6) AS icc, round(p_value, 6) AS p_value, p_value < 0.05 / 3 AS reject_h0, coalesce(icc >= 0.75 AND p_value < 0.05 / 3, FALSE) AS good_feature FROM icc JOIN pv USING (feature)""",
    "corr_filter": "WITH RECURSIVE feat AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(LIKE_COLUMNS)) + ") t(i, name)), pair AS (" + " UNION ALL ".join(
        f"SELECT {i} AS a, {j} AS b, corr({x}, {y}) AS c FROM lineitem" for i, x in enumerate(LIKE_COLUMNS.values()) for j, y in enumerate(LIKE_COLUMNS.values()) if i < j
    ) + """), strong AS (SELECT a, b FROM pair WHERE abs(c) > 0.95 UNION ALL SELECT b, a FROM pair WHERE abs(c) > 0.95),
-- each step drops the feature with most partners left, one named _std before others, then the first
chosen(step, kept) AS (
  SELECT 0, (SELECT list(i ORDER BY i) FROM feat)
  UNION ALL
  SELECT step + 1, [x FOR x IN kept IF x <> worst] FROM (
    SELECT step, any_value(kept) AS kept, arg_min(i, -1000 * n + CASE WHEN suffix(name, '_std') THEN 0 ELSE 100 END + i) AS worst, max(n) AS most FROM (
      SELECT d.step, any_value(d.kept) AS kept, f.i, f.name, count(s.b) AS n FROM chosen d JOIN feat f ON list_contains(d.kept, f.i) LEFT JOIN strong s ON s.a = f.i AND list_contains(d.kept, s.b) GROUP BY d.step, f.i, f.name)
    GROUP BY step) WHERE most > 0),
u AS (SELECT unnest(kept) AS i, generate_subscripts(kept, 1) - 1 AS position FROM (SELECT kept FROM chosen ORDER BY step DESC LIMIT 1))
SELECT CAST(position AS INTEGER) AS position, name AS feature FROM u JOIN feat USING (i)""",
    "connected_regions": _with(RASTER) + """
, fg AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pixels WHERE label > 0),
runs AS (SELECT image_id, y, min(x) AS a, max(x) AS b, count(*) AS n, y * 128 + min(x) AS id FROM fg GROUP BY image_id, y, g),
touch AS (SELECT p.image_id, p.id AS u, q.id AS v FROM runs p JOIN runs q ON q.image_id = p.image_id AND abs(q.y - p.y) = 1 AND q.a <= p.b + 1 AND q.b >= p.a - 1),
reach(image_id, id, root) AS (SELECT image_id, id, id FROM runs UNION SELECT r.image_id, t.v, r.root FROM reach r JOIN touch t ON t.image_id = r.image_id AND t.u = r.id),
least AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY image_id, id)
SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label, CAST(sum(n) AS BIGINT) AS pixels, root AS first FROM least JOIN runs USING (image_id, id) GROUP BY image_id, root""",
}

ORACLES["connected_regions_tiled"] = ORACLES["connected_regions"]
