"""DuckDB SQL of the corpus queries that SQL can express."""

from .license_scan import BAND, K, MIN_SHARE, PHRASES, SHORT, TEMPLATES
from .quality import ABUSIVE, LEXICON, MIN_TOXIC, STEM, STEM_RATIO, STEM_TEXTS
from .url_filter import DOMAINS, IDENTIFIER, LEVELS, LONG_SEGMENT, MIN_SEGMENT_PAGES, NUMBER, REJECT_FROM, RULES, SIMILAR_Z, SMOOTHING

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
tok AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
tri AS (SELECT *, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, count(*) OVER (PARTITION BY rid) AS n FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS c FROM tri WHERE i <= n - 2) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
runs AS (SELECT rid, max(c) AS longest FROM (SELECT rid, count(*) AS c FROM (SELECT rid, word, i - row_number() OVER (PARTITION BY rid, word ORDER BY i) AS g FROM tok) GROUP BY rid, word, g) GROUP BY rid),
letters AS (SELECT rid, count(*) FILTER (regexp_matches(word, '\\p{{L}}')) AS lettered FROM tok GROUP BY rid),
lab AS (SELECT DISTINCT text, toxic FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL),
occ AS (SELECT text, toxic, left(word, {STEM}) AS stem, count(*) AS n FROM (SELECT text, toxic, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{{STEM},}}')) AS word FROM lab) GROUP BY ALL),
tot AS (SELECT sum(n) FILTER (toxic = 1) AS nt, sum(n) FILTER (toxic <> 1) AS nc, count(DISTINCT text) FILTER (toxic = 1) AS texts FROM occ),
lex AS (SELECT stem FROM (SELECT stem, count(*) FILTER (toxic = 1) AS k, sum(CASE WHEN toxic = 1 THEN n ELSE 0 END) AS a, sum(CASE WHEN toxic = 1 THEN 0 ELSE n END) AS b FROM occ GROUP BY stem), tot
  WHERE k >= {STEM_TEXTS} AND a * nc >= {STEM_RATIO} * (b + 1) * nt AND texts >= {MIN_TOXIC} ORDER BY k DESC, stem LIMIT {LEXICON}),
bad AS (SELECT rid, count(*) AS hits FROM (SELECT rid, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{{STEM},}}')) AS word FROM d) JOIN lex ON left(word, {STEM}) = stem GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS k FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
f AS (SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.k, 0) AS n_dup_lines, coalesce(c.n_repeat, 0) AS n_repeat_words, coalesce(r.longest, 0) AS longest, coalesce(t.lettered, 0) AS lettered,
        length(text) - length(replace(text, '!', '')) AS shouts, len(regexp_extract_all(text, '(?i)\\b(?:{"|".join(sorted(ABUSIVE))})\\b')) AS insults, coalesce(x.hits, 0) AS hits
      FROM w LEFT JOIN bad x USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN runs r USING (rid) LEFT JOIN letters t USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > 2 * n_words AND NOT 2 * n_dup_lines > n_lines AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND NOT 10 * shouts > 5 * n_words
  AND NOT 10 * lettered < 7 * n_words AND longest <= 20 AND NOT (insults >= 3 AND 250 * insults >= n_words) AND NOT (hits >= 2 AND 100 * hits >= n_words) AS kept
FROM b"""

SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS s, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT rid, s, md5(array_to_string(list_slice(ws, s, s + 34), ' ')) AS k FROM win),
dup AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
gone AS (SELECT DISTINCT rid, s + o AS i FROM dup, range(35) t(o)),
g AS (SELECT rid, list(i) AS gi FROM gone GROUP BY rid),
tok AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

_FITS = [(w, h, p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for w, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))]
URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in _FITS)} END AS rule, CASE {" ".join(f"WHEN {c} THEN '{w}'" for w, _, _, c in _FITS)} END AS ruled FROM hp),
paths AS (SELECT host, path, ruled, count(*) AS n FROM r GROUP BY ALL),
seg AS (SELECT host, path, n, generate_subscripts(s, 1) AS depth, unnest(s) AS raw FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM paths)),
gen AS (SELECT *, CASE WHEN depth > {LEVELS} THEN '*' WHEN regexp_matches(raw, '{NUMBER}') THEN '#' WHEN regexp_matches(raw, '{IDENTIFIER}') THEN '#h' WHEN length(raw) >= {LONG_SEGMENT} THEN '*' ELSE raw END AS segment FROM seg),
lit AS (SELECT host, depth, segment FROM (SELECT *, count(*) OVER (PARTITION BY depth, segment) AS hosts FROM (SELECT host, depth, segment, sum(n) AS pages FROM gen WHERE segment <> '*' AND NOT contains(segment, '#') GROUP BY ALL))
  WHERE pages >= {MIN_SEGMENT_PAGES} OR hosts >= {MIN_SEGMENT_PAGES}),
tmpl AS (SELECT g.host, g.path, list(CASE WHEN l.segment IS NOT NULL OR contains(g.segment, '#') THEN g.segment ELSE '*' END ORDER BY g.depth) AS template FROM gen g LEFT JOIN lit l USING (host, depth, segment) GROUP BY g.host, g.path),
tree AS (SELECT p.host, p.path, p.ruled, p.n, coalesce(template, []) AS template FROM paths p LEFT JOIN tmpl USING (host, path)),
leaf AS (SELECT host, template, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b, sum(n) AS n FROM tree WHERE ruled IS NOT NULL GROUP BY ALL),
prior AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0.0) AS p FROM leaf),
spot AS (SELECT host, template, list_filter(range(len(template)), lambda i: template[i + 1] <> '*') AS pos FROM (SELECT DISTINCT host, template FROM tree)),
anc AS (SELECT host, template, j, CASE WHEN j = 0 THEN template ELSE list_concat(list_slice(template, 1, pos[len(pos) - j + 1]), list_transform(range(len(template) - pos[len(pos) - j + 1]), lambda x: '*')) END AS node,
        j > 0 AND contains(template[pos[len(pos) - j + 1] + 1], '#') AS wild, j < len(pos) AS said FROM spot, range(17) t(j) WHERE j <= len(pos)),
anf AS (SELECT *, said AND bool_and(wild OR j = 0) OVER (PARTITION BY host, template ORDER BY j) AS free FROM anc),
branch AS (SELECT a.host, a.node, coalesce(c.node, a.node) AS child, sum(b) AS b, sum(n) AS n FROM anc a JOIN leaf USING (host, template) LEFT JOIN anc c ON c.host = a.host AND c.template = a.template AND c.j = a.j - 1 GROUP BY ALL),
hlab AS (SELECT host, list_slice(string_split(host, '.'), -least(len(string_split(host, '.')), {DOMAINS}), -1) AS parts FROM (SELECT DISTINCT host FROM tree)),
dom AS (SELECT host, d, array_to_string(list_slice(parts, d, {DOMAINS}), '.') AS domain, CASE WHEN d = 1 THEN '=' || host ELSE array_to_string(list_slice(parts, d - 1, {DOMAINS}), '.') END AS below FROM hlab, range(1, {DOMAINS} + 2) t(d) WHERE d <= len(parts) + 1),
wide AS (SELECT domain, node, child, below, host, sum(b) AS b, sum(n) AS n FROM (SELECT host, node, child, b, n FROM branch WHERE len(list_filter(node, lambda x: x <> '*')) > 0) JOIN dom USING (host) GROUP BY ALL),
pool AS (SELECT 'h' AS what, host AS name, node, sum(b) AS b, sum(n) AS n, count(*) AS k, count(*) AS c, sum(b * b / n) AS s FROM branch GROUP BY ALL
  UNION ALL SELECT 'd', domain, node, sum(b), sum(n), sum(k), count(*), sum(b * b / n) FROM (SELECT domain, node, below, sum(b) AS b, sum(n) AS n, count(DISTINCT host) AS k FROM wide GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT 's', domain, node, sum(b), sum(n), 0, count(*), sum(b * b / n) FROM (SELECT domain, node, child, sum(b) AS b, sum(n) AS n FROM wide GROUP BY ALL) GROUP BY ALL),
node AS (SELECT *, c = 1 OR b = 0 OR b = n OR (s - b * b / n) / (b / n * (1 - b / n)) <= c - 1 + {SIMILAR_Z} * sqrt(2 * (c - 1)) AS alike FROM pool),
step AS (SELECT a.host, a.template, a.j, 0 AS d, a.wild, a.free, b, n, k, alike AS sections, TRUE AS hosts FROM anf a JOIN node p ON what = 'h' AND p.name = a.host AND p.node = a.node
  UNION ALL SELECT a.host, a.template, a.j, d.d, a.wild, a.free, p.b, p.n, p.k, q.alike, p.alike FROM anf a JOIN dom d USING (host) JOIN node p ON p.what = 'd' AND p.name = d.domain AND p.node = a.node
    JOIN node q ON q.what = 's' AND q.name = p.name AND q.node = p.node WHERE said),
near AS (SELECT host, template, j, min(d) FILTER (k >= 2 AND (j = 0 OR sections)) AS ok, coalesce(min(d) FILTER (NOT hosts), 99) AS bad, bool_or(free) AS free FROM step WHERE d > 0 GROUP BY ALL),
inn AS (SELECT host, template, bool_or(j = 0) AS labelled, min(j) FILTER (sections AND (k >= 2 OR wild)) AS above, coalesce(min(j) FILTER (NOT sections), 99) AS unlike FROM step WHERE d = 0 GROUP BY ALL),
free AS (SELECT host, template, min(j) AS j FROM near WHERE free GROUP BY ALL),
start AS (SELECT t.host, t.template, CASE WHEN labelled THEN 0 WHEN z.ok < z.bad THEN 0 WHEN above < unlike THEN above WHEN f.ok < f.bad THEN f.j END AS level,
        CASE WHEN labelled THEN 0 WHEN z.ok < z.bad THEN z.ok WHEN above < unlike THEN 0 ELSE f.ok END AS domain
  FROM (SELECT DISTINCT host, template FROM step) t LEFT JOIN inn USING (host, template) LEFT JOIN near z ON z.host = t.host AND z.template = t.template AND z.j = 0
  LEFT JOIN (near f JOIN free USING (host, template, j)) f ON f.host = t.host AND f.template = t.template),
seen AS (SELECT x.host, x.template, x.j, x.d, x.b, x.n FROM step x JOIN start o USING (host, template) JOIN step y USING (host, template) WHERE level IS NOT NULL AND x.j >= level AND x.d >= domain GROUP BY ALL
  HAVING bool_and(y.hosts OR y.j <> level OR y.d <= domain OR y.d > x.d) AND bool_and(y.sections OR y.d <> x.d OR y.j <= level OR y.j > x.j)),
judged AS (SELECT host, template, arg_max(struct_pack(b := b, n := n), struct_pack(n := n, j := -j, d := -d)) AS best FROM seen GROUP BY ALL),
bad AS (SELECT DISTINCT t.host, t.path FROM tree t JOIN judged o ON o.host = t.host AND o.template = t.template, prior
  WHERE ruled IS NULL AND (best.b + {SMOOTHING} * p) / (best.n + {SMOOTHING}) >= {REJECT_FROM})
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN bad ON bad.host = r.host AND bad.path = r.path"""

_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
tok AS (SELECT rid, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM d),
nxt AS (SELECT *, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
place AS ({" UNION ALL ".join(f"SELECT rid, i, '{lab}' AS label FROM nxt WHERE word = '{p.split()[0]}' AND w2 = '{p.split()[1]}'" + (f" AND w3 = '{p.split()[2]}'" if len(p.split()) > 2 else "") for p, lab in PHRASES.items())}),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY rid),
tm AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{lab}', {_quoted(t)})" for n, (lab, t) in enumerate(TEMPLATES))}) t(template, label, text)),
tw AS (SELECT template, label, {_WORDS.format("text")} AS ws FROM tm),
tg AS (SELECT template, label, len(ws) AS size, t, list_slice(ws, t + 1, t + {K}) AS gram FROM tw, range(200) r(t) WHERE t <= len(ws) - {K}),
hit AS (SELECT DISTINCT n.rid, g.template, g.label, g.size, n.i - g.t AS diagonal, g.t FROM nxt n JOIN tg g ON n.word = g.gram[1] AND n.w2 = g.gram[2] AND n.w3 = g.gram[3]),
dg AS (SELECT DISTINCT rid, template, diagonal FROM hit),
bd AS (SELECT rid, template, diagonal, sum(far) OVER (PARTITION BY rid, template ORDER BY diagonal) AS band
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {BAND} THEN 0 ELSE 1 END AS far FROM dg)),
cov AS (SELECT rid, template, label, band, any_value(size) AS size, count(DISTINCT w) AS c FROM (SELECT hit.*, band, unnest(range(t, t + {K})) AS w FROM hit JOIN bd USING (rid, template, diagonal)) GROUP BY rid, template, label, band),
sp AS (SELECT rid, list(DISTINCT label) AS found, max(c / size) AS best FROM cov WHERE c / size >= CASE WHEN size <= {SHORT} THEN 1 ELSE {MIN_SHARE} END GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN sp USING (rid)"""

MIXING = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS every, coalesce(sum(s) OVER below, 0) AS cs, coalesce(sum(w) OVER below, 0) AS cw FROM w
  WINDOW below AS (ORDER BY s / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 4.0 * s * (every - cw) <= (3 * total - 4 * cs) * w AS capped FROM o),
l AS (SELECT coalesce(sum(s) FILTER (capped), 0) AS cs, coalesce(sum(w) FILTER (NOT capped), 1) AS rest FROM c),
t AS (SELECT source, s, CASE WHEN capped THEN 2.0 * s ELSE w * CAST(3 * total - 4 * l.cs AS DOUBLE) / CAST(2 * l.rest AS DOUBLE) END AS target FROM c, l),
u AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t),
e AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE words // s * size + greatest(0, least(start + size, words % s) - greatest(start, 0)) END AS BIGINT) AS taken
FROM e JOIN u ON e.source IS NOT DISTINCT FROM u.source"""

TRIE = """
WITH c AS (SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p FROM c),
i AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h FROM c GROUP BY conv_id),
j AS (SELECT i.*, least(i.h, coalesce(b.own, 0)) AS lent FROM i LEFT JOIN i b ON b.conv_id = i.base),
r AS (SELECT conv_id, lent + p - h AS p, k, n FROM o JOIN j USING (conv_id) WHERE p >= h UNION ALL SELECT j.conv_id, p, k, n FROM j JOIN o ON o.conv_id = j.base WHERE p < h),
x AS (SELECT conv_id, p + 1 AS depth, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM j),
m AS (SELECT conv_id, max(depth) AS turns FROM x GROUP BY conv_id),
nd AS (SELECT depth, path, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM x GROUP BY ALL),
ch AS (SELECT depth - 1 AS depth, left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN ch USING (depth, path)),
sub AS (SELECT a AS depth, left(path, 64 * a) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_) GROUP BY ALL),
e AS (SELECT depth, path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM x JOIN m USING (conv_id) WHERE depth = turns GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ f JOIN sub USING (depth, path) LEFT JOIN e USING (depth, path) LEFT JOIN full_ u ON u.depth = f.depth - 1 AND u.path = left(f.path, 64 * (f.depth - 1))"""

ORACLES = {"op12_prefix_trie": TRIE, "op11_mixing": MIXING, "op2_quality_rules": QUALITY, "op8_substring_dedup": SUBSTRINGS, "op9_url_filter": URLS, "op10_license_scan": LICENSES}
