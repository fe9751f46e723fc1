"""Which measures of texts are reliable, and what do they say about the labels?

The study that is made of image features, made of texts: measures of each document (the details),
their means in replicates of each sample (the ratings), ICC and ANOVA of each measure over them,
the filters by variance and correlation, and the correlations of what is left with the labels.

    python -m jobs.text_study DOCUMENTS LABELS OUT [--config FILE]

Below OUT: details/ (a row per document, partitioned by sample) and study/ (long, partitioned by
section: rating, reliability, correlation). Each run replaces both, so a rerun gives the same.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import select, stats

from . import config

log = logging.getLogger("jobs.text_study")

WORD = r"[^\x20\x09-\x0D]+"
MEASURES = ["n_chars", "n_words", "n_lines", "word_length", "line_length", "distinct_words", "upper", "digits", "marks", "accents"]
DETAILS = "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES) + ", sample string"
STUDY = "sample string, rater long, feature string, target string, value double, section string"


def measures(text: str = "text") -> dict[str, Column]:
    """Measures of a text, all NULL where it has no word; shares are of its characters."""
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    n, chars = F.size(words), F.length(text)
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    share = lambda kind: F.regexp_count(text, F.lit(kind)) / chars
    found = {
        "n_chars": chars,
        "n_words": n,
        "n_lines": lines,
        "word_length": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")) / n,
        "line_length": chars / lines,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "marks": share("[.,;:!?]"),
        "accents": share(r"[^\x00-\x7F]"),
    }
    return {name: F.when(n > 0, value).cast("double").alias(name) for name, value in found.items()}


def ratings(details: DataFrame, raters: int) -> DataFrame:
    """feature, sample, rater, value: each measure's mean in every replicate of a sample.

    A document belongs to replicate doc_id modulo `raters`; without an id or a sample to none.
    """
    rater = (F.pmod("doc_id", F.lit(raters)) + 1).alias("rater")
    known = details.where(F.col("doc_id").isNotNull() & F.col("sample").isNotNull())
    wide = known.groupBy("sample", rater).agg(*[F.avg(m).alias(m) for m in MEASURES])
    return stats.unpivot(wide, ["sample", "rater"], MEASURES).where(F.col("value").isNotNull())


def reliability(details: DataFrame, rated: DataFrame, settings: dict) -> DataFrame:
    """ICC, ANOVA and whether a measure is good and kept, one row per measure."""
    found = stats.good_features(stats.icc3k(rated, settings["raters"]), stats.anova(rated, settings["alpha"], len(MEASURES)), settings["icc"]).cache()
    rows = {r.feature: r for r in found.collect()}  # a row per measure
    scored = [m for m in MEASURES if m in rows and rows[m].icc is not None]
    good = [m for m in MEASURES if m in rows and rows[m].good_feature] if scored else MEASURES
    kept = select.correlation_filter(details, select.variance_filter(details, good), settings["corr"]) if good else []
    flags = found.withColumn("kept", F.col("feature").isin(kept) if kept else F.lit(False))
    found.unpersist()
    return flags


def study(details: DataFrame, labels: DataFrame, settings: dict) -> DataFrame:
    """The long table of STUDY."""
    rated = ratings(details, settings["raters"])
    scores = reliability(details, rated, settings)
    values = ["icc", "f", "df1", "df2", "p_value", "reject_h0", "good_feature", "kept"]
    long = scores.select("feature", *[F.col(v).cast("double").alias(v) for v in values]).unpivot("feature", values, "target", "value")
    kept = [r.feature for r in scores.where("kept").collect()]
    labelled = details.join(labels.select("doc_id", *settings["targets"]), "doc_id")
    related = select.feature_target_correlation(labelled, [m for m in MEASURES if m in kept], settings["targets"])
    parts = {
        "rating": rated.select("sample", "rater", "feature", "value"),
        "reliability": long,
        "correlation": related.select("feature", "target", F.col("corr").alias("value")),
    }
    empty = details.sparkSession.createDataFrame([], STUDY)
    for name, part in parts.items():
        empty = empty.unionByName(part.withColumn("section", F.lit(name)), allowMissingColumns=True)
    return empty


def run(spark: SparkSession, documents: str, labels: str, out: str, settings: dict | None = None) -> dict[str, int]:
    """Reads the two tables, replaces details and study below `out`; rows read and written."""
    settings = settings or config.load("text_study")
    docs = spark.read.parquet(documents)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *measures().values(), F.col(settings["sample"]).cast("string").alias("sample"))
    table.write.mode("overwrite").partitionBy("sample").parquet(f"{out}/details")
    details = read(spark, out, "details")
    known = spark.read.parquet(labels)
    counts = {"details": details.count(), "labels": known.count()}
    log.info("read %d documents of %s, %d labels of %s", counts["details"], documents, counts["labels"], labels)
    study(details, known, settings).write.mode("overwrite").partitionBy("section").parquet(f"{out}/study")
    counts |= {r.section: r.n for r in read(spark, out, "study").groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    log.info("wrote %s below %s", ", ".join(f"{n} {k}" for k, n in counts.items() if k != "labels"), out)
    return counts


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A written table; `details` or `study`."""
    return spark.read.schema(DETAILS if table == "details" else STUDY).parquet(f"{out}/{table}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.text_study", description=__doc__.splitlines()[0])
    parser.add_argument("documents")
    parser.add_argument("labels")
    parser.add_argument("out")
    parser.add_argument("--config")
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_study").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, config.load("text_study", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
