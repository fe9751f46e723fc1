"""URL filter: explicit rules, and a path-template tree where no rule fits.

Per host, path segments become a tree of templates: numbers become the wildcard
"#", hex identifiers "#h", and segments that hardly any page or host has "*". The ancestors of a
template have one more of its last segments made "*". Pages that a rule judges are the labels.

* Merging: a node whose labelled branches do not differ significantly in their blocked share (a
  chi-square of the branches against the node) is one branch of its parent, and so on upwards. The
  same template of related hosts merges in the same way, domain by domain up to all hosts. A
  template is judged by the largest pool that it merges into.
* A template without labels starts from the same template in the nearest domain (two alike hosts at
  least), else from the nearest labelled ancestor of its own host. That stands for it if its
  branches are alike and there are two of them at least, or if the step down to the template is a
  wildcard, which every number is alike to. Where the host's branches differ, or it has nothing to
  say, the ancestors by such steps are asked in the nearest domain.
* A template is rejected if the blocked share, smoothed towards that of all labelled pages,
  reaches a limit; without evidence it is allowed.

Built-in functions only. Counts run over distinct paths first, so a hot host or page collapses
map side; rows are joined to the verdicts of their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A segment stays literal from this number of pages of its host, or of hosts that have it at its depth.
MIN_SEGMENT_PAGES = 3
#: Segments below this depth are wildcards, so a template has a bounded number of ancestors.
LEVELS = 16
#: Domains of a host that are asked, from all hosts down.
DOMAINS = 8
#: Branches are alike up to so many standard deviations of chi-square beyond its mean.
SIMILAR_Z = 1.96
SMOOTHING = 2.0
REJECT_FROM = 0.9
NUMBER = r"^[0-9]+([._-][0-9]+)*(\.[A-Za-z]{1,5})?$"
IDENTIFIER = r"^[0-9a-fA-F-]{16,}$"
#: From this length on a segment is never literal.
LONG_SEGMENT = 48


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame) -> DataFrame:
    """host, path, template (array) for distinct paths (host, path, n pages)."""
    raw = F.col("raw")
    made = F.when(F.rlike(raw, F.lit(NUMBER)), "#").when(F.rlike(raw, F.lit(IDENTIFIER)), "#h")
    made = made.when((F.length(raw) >= LONG_SEGMENT) | (raw == "*"), "*").otherwise(raw)
    segments = paths.select("host", "path", "n", F.posexplode(F.filter(F.split("path", "/"), lambda s: s != "")).alias("depth", "raw"))
    segments = segments.select("host", "path", "n", "depth", F.when(F.col("depth") >= LEVELS, "*").otherwise(made).alias("segment"))
    open_ = (F.col("segment") == "*") | F.contains("segment", F.lit("#"))
    # wildcards need no count, so the hottest segments of a host never meet in one task
    counted = cut(segments.where(~open_).groupBy("host", "depth", "segment").agg(F.sum("n").alias("pages")), "segments")
    usual = cut(counted.groupBy("depth", "segment").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= MIN_SEGMENT_PAGES).select("depth", "segment", F.lit(True).alias("usual")), "usual")
    counted = counted.join(usual, ["depth", "segment"], "left").where((F.col("pages") >= MIN_SEGMENT_PAGES) | F.col("usual"))
    literal = cut(counted.select("host", "depth", "segment"), "literals").withColumn("literal", F.lit(True))
    kept = segments.where(~open_).join(literal, ["host", "depth", "segment"], "left").select("host", "path", "depth", F.when(F.col("literal"), F.col("segment")).otherwise("*").alias("s"))
    kept = kept.unionByName(segments.where(open_).select("host", "path", "depth", F.col("segment").alias("s")))
    return kept.groupBy("host", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "s"))), lambda x: x["s"]).alias("template"))


def ancestors(rows: DataFrame) -> DataFrame:
    """rows (with a template) for each j: node (its last j segments made "*") and child (node j - 1).

    wild: step j is a wildcard; said: the node has a segment other than "*"; free: so it has, and
    all steps up to j are wildcards.
    """
    t, at = F.col("template"), F.col("at")
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: F.coalesce(F.get(t, i) != "*", F.lit(False))))
    place = lambda j: F.get(at, F.size(at) - j)
    number = lambda i: F.contains(F.get(t, i), F.lit("#"))

    def node(j):
        return F.when(j == 0, t).otherwise(F.concat(F.slice(t, 1, place(j)), F.array_repeat(F.lit("*"), F.size(t) - place(j))))

    def step(j):
        said = j < F.size(at)
        free = said & F.forall(F.slice(at, F.size(at) - j + 1, j), number)
        return F.struct(j.alias("j"), node(j).alias("node"), node(F.greatest(j - 1, F.lit(0))).alias("child"), F.coalesce(number(place(j)), F.lit(False)).alias("wild"), said.alias("said"), free.alias("free"))

    return rows.withColumn("step", F.explode(F.transform(F.sequence(F.lit(0), F.size(at)), step))).drop("at").select("*", "step.*").drop("step")


def domains(rows: DataFrame) -> DataFrame:
    """rows (with a host) for each domain of the host: d from 1 up, domain, below (the branch of it that holds the host)."""
    labels = F.split("host", r"\.")
    labels = F.slice(labels, -F.least(F.size(labels), F.lit(DOMAINS)), F.lit(DOMAINS))
    name = lambda d: F.array_join(F.slice("labels", d, F.lit(DOMAINS)), ".")
    each = F.transform(F.sequence(F.lit(1), F.size("labels") + 1), lambda d: F.struct(d.alias("d"), name(d).alias("domain"), F.when(d == 1, F.concat(F.lit("="), F.col("host"))).otherwise(name(d - 1)).alias("below")))
    return rows.withColumn("labels", labels).withColumn("of", F.explode(each)).drop("labels").select("*", "of.*").drop("of")


def _alike(branches: DataFrame, *key: str) -> DataFrame:
    """Per key: blocked b, labels n, members k of its branches, and whether the branches are alike."""
    sums = branches.groupBy(*key).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("branches"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("s"))
    p = F.col("b") / F.col("n")
    chi = (F.col("s") - F.col("b") * p) / (p * (1 - p))
    alike = (F.col("branches") == 1) | (F.col("b") == 0) | (F.col("b") == F.col("n")) | (chi <= F.col("branches") - 1 + SIMILAR_Z * F.sqrt(2 * (F.col("branches") - 1)))
    return sums.select(*key, "b", "n", "k", alike.alias("alike"))


def _sums(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))


def nodes(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labelled nodes of each host (host, node) and of each domain (domain, node).

    b, n, k (branches of a host's node, hosts of a domain's), sections (whether the branches below
    are alike) and hosts (whether the hosts are).
    """
    grown = _sums(ancestors(labels), "host", "node", "child", "said").withColumn("k", F.lit(1))
    inside = _alike(grown, "host", "node").withColumnRenamed("alike", "sections").withColumn("hosts", F.lit(True))
    above = domains(grown.where("said"))
    by_host = _alike(_sums(_sums(above, "domain", "node", "below", "host"), "domain", "node", "below"), "domain", "node").withColumnRenamed("alike", "hosts")
    by_child = _alike(_sums(above, "domain", "node", "child"), "domain", "node").select("domain", "node", F.col("alike").alias("sections"))
    return cut(inside, "inside"), cut(by_host.join(by_child, ["domain", "node"]), "across")


def template_verdicts(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """host, template of the rejected ones among tree's; labels: host, template, b (blocked), n, of the labelled ones."""
    labels = cut(labels, "labels")
    sums = labels.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    prior = sums.b / sums.n if sums.n else 0.0
    inside, across = nodes(labels)
    steps = ancestors(cut(tree.select("host", "template").distinct(), "asked")).drop("child")
    own = steps.join(inside, ["host", "node"]).withColumn("d", F.lit(0))
    other = domains(steps.where("said")).join(across, ["domain", "node"])
    columns = ["host", "template", "j", "d", "b", "n", "k", "sections", "hosts", "wild", "free"]
    found = own.select(*columns).unionByName(other.select(*columns)).groupBy("host", "template").agg(F.collect_list(F.struct(*columns[2:])).alias("all"))
    none = F.lit(None).cast("int")

    def least(field, such):
        return F.array_min(F.transform(F.filter("all", such), lambda x: x[field]))

    def nearest_domain(j):
        ok = least("d", lambda x: (x["j"] == j) & (x["d"] > 0) & (x["k"] >= 2) & ((j == 0) | x["sections"]))
        bad = least("d", lambda x: (x["j"] == j) & (x["d"] > 0) & ~x["hosts"])
        return F.when(ok < F.coalesce(bad, F.lit(99)), ok)

    found = found.withColumn("labelled", F.exists("all", lambda x: (x["j"] == 0) & (x["d"] == 0))).withColumn("same", nearest_domain(F.lit(0)))
    above = least("j", lambda x: (x["d"] == 0) & x["sections"] & ((x["k"] >= 2) | x["wild"]))
    unlike = least("j", lambda x: (x["d"] == 0) & ~x["sections"])
    found = found.withColumn("above", F.when(above < F.coalesce(unlike, F.lit(99)), above)).withColumn("free", least("j", lambda x: (x["d"] > 0) & x["free"]))
    found = found.withColumn("far", nearest_domain(F.col("free")))
    level = F.when(F.col("labelled"), 0).when(F.col("same").isNotNull(), 0).when(F.col("above").isNotNull(), F.col("above")).when(F.col("far").isNotNull(), F.col("free")).otherwise(none)
    domain = F.when(F.col("labelled"), 0).when(F.col("same").isNotNull(), F.col("same")).when(F.col("above").isNotNull(), 0).otherwise(F.col("far"))
    found = found.withColumn("level", level).withColumn("domain", domain)

    def reached(x):
        # domain by domain from the start, then section by section there, where most is known
        hosts = F.forall("all", lambda y: (y["j"] != F.col("level")) | (y["d"] <= F.col("domain")) | (y["d"] > x["d"]) | y["hosts"])
        sections = F.forall("all", lambda y: (y["d"] != x["d"]) | (y["j"] <= F.col("level")) | (y["j"] > x["j"]) | y["sections"])
        return (x["j"] >= F.col("level")) & (x["d"] >= F.col("domain")) & hosts & sections

    best = F.array_max(F.transform(F.filter("all", reached), lambda x: F.struct(x["n"].alias("n"), (-x["j"]).alias("j"), (-x["d"]).alias("d"), x["b"].alias("b"))))
    judged = found.where("level is not null").select("host", "template", best.alias("pool"))
    return judged.where((F.col("pool.b") + SMOOTHING * prior) / (F.col("pool.n") + SMOOTHING) >= REJECT_FROM).select("host", "template")


def ruled_rows(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict) of each row."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules)
    return rows.withColumn("rule", rule).withColumn("ruled", verdict)


def path_tree(rows: DataFrame) -> DataFrame:
    """host, path, ruled, n (pages), template of the distinct paths."""
    paths = cut(rows.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("n")), "paths")
    tree = paths.join(templates(paths), ["host", "path"], "left")
    return cut(tree.withColumn("template", F.coalesce("template", F.array().cast("array<string>"))), "tree")


def template_labels(tree: DataFrame) -> DataFrame:
    """host, template, b (pages blocked by a rule), n (pages that a rule judges)."""
    blocked = F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)
    return tree.where("ruled is not null").groupBy("host", "template").agg(F.sum(blocked).alias("b"), F.sum("n").alias("n"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A url that is null or has no "://" has an empty host and path; no rule fits it and its empty
    template is allowed unless labels reject it. Of several rules that fit the longest decides,
    among equally long ones the last listed. Very long urls keep their whole path; segments below
    LEVELS are wildcards. Rows with a null page_id and repeated rows are judged like any other; an
    empty table gives an empty result; further columns of pages are ignored, whatever their names.
    """
    rows = ruled_rows(pages, rules)
    tree = path_tree(rows)
    open_ = tree.where("ruled is null")
    rejected = cut(template_verdicts(open_, template_labels(tree)), "rejected")
    bad = cut(open_.join(rejected, ["host", "template"], "left_semi").select("host", "path", F.lit("block").alias("found")), "bad")
    judged = rows.join(bad, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))
