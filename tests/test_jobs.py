"""The jobs: results against the queries' SQL and plain loops, reruns, growing input, command lines."""

import json
import math
import os
import statistics

import duckdb
import pandas as pd
import pytest

from jobs import config, queries, region_feed, text_study
from mosaiq.operators import regions
from mosaiq.sources import raster

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(pdf):
    out = []
    for r in pdf[sorted(pdf.columns)].itertuples(index=False):
        out.append(tuple("-" if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    before = dict(spark.conf.getAll)
    con = duckdb.connect()
    for t in ("documents", "labels", "part"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.astype(object)) == plain(want.astype(object))
    assert dict(spark.conf.getAll) == before


# --- text study -------------------------------------------------------------------------------


def texts(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)


def test_measures(spark):
    text = "Ab cd.\nAb éf 12!"
    row = spark.createDataFrame([(text,), ("",), (" \n ",), (None,)], "text string").select(*text_study.measures().values()).collect()
    assert row[0].asDict() == {
        "n_chars": 16.0, "n_words": 5.0, "n_lines": 2.0, "word_length": 12 / 5, "line_length": 8.0, "distinct_words": 4 / 5,
        "upper": 2 / 16, "digits": 2 / 16, "marks": 2 / 16, "accents": 1 / 16,
    }
    assert all(v is None for r in row[1:] for v in r)


def test_study_finds_what_was_planted(spark, tmp_path):
    """Word length tells the samples apart and upper case does not; n_chars goes with n_words."""
    rows, labels = [], []
    for i in range(240):
        word = "x" * (3 + 2 * (i % 3)) + ("X" if i % 5 == 0 else "")
        rows.append((i, " ".join([word] * (20 + i * 7 % 11)) + ".\n", "abc"[i % 3]))
        labels.append((i, i % 3, None if i % 4 else 1))
    rows += [(None, "no id at all", "a"), (900, "no sample", None), (901, None, "a"), (902, " ", "b")]
    texts(spark, rows, str(tmp_path / "d"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "l"))
    counts = text_study.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"))
    assert counts["details"] == 244 and counts["rating"] == 24 * len(text_study.MEASURES)
    study = text_study.read(spark, str(tmp_path / "out"), "study").collect()
    score = {(r.feature, r.target): r.value for r in study if r.section != "rating"}
    assert score["word_length", "good_feature"] == 1.0 and score["word_length", "icc"] > 0.99 and score["upper", "good_feature"] == 0.0
    assert not (score["n_chars", "kept"] and score["line_length", "kept"])  # one line each, so they correlate
    assert score["word_length", "quality"] > 0.9 and ("upper", "quality") not in score and score["word_length", "toxic"] is None
    cell = [r[1].replace(".\n", "").split() for r in rows if r[0] is not None and r[2] == "b" and r[0] % 8 == 3 and r[0] < 900]
    want = statistics.mean((sum(map(len, w)) + 1) / len(w) for w in cell)
    got = next(r.value for r in study if r.section == "rating" and (r.sample, r.rater, r.feature) == ("b", 4, "word_length"))
    assert math.isclose(got, want)


def test_study_of_nothing_and_reruns(spark, tmp_path):
    texts(spark, [], str(tmp_path / "d"))
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "l"))
    for _ in range(2):
        counts = text_study.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "out"))
        assert counts["details"] == 0 and "rating" not in counts
    # a rerun over other input leaves nothing of the last one
    texts(spark, [(i, f"some words of {i}", "ab"[i % 2]) for i in range(40)], str(tmp_path / "d2"))
    text_study.run(spark, str(tmp_path / "d2"), str(tmp_path / "l"), str(tmp_path / "out"))
    first = plain(text_study.read(spark, str(tmp_path / "out"), "study").toPandas().astype(object))
    texts(spark, [(1, "one", "z")], str(tmp_path / "d3"))
    text_study.run(spark, str(tmp_path / "d3"), str(tmp_path / "l"), str(tmp_path / "out"))
    assert [r.doc_id for r in text_study.read(spark, str(tmp_path / "out"), "details").collect()] == [1]
    text_study.run(spark, str(tmp_path / "d2"), str(tmp_path / "l"), str(tmp_path / "out"))
    assert plain(text_study.read(spark, str(tmp_path / "out"), "study").toPandas().astype(object)) == first


# --- region feed ------------------------------------------------------------------------------


def state(spark, out):
    return {t: plain(region_feed.read(spark, out, t).drop("batch").toPandas().astype(object)) for t in region_feed.WRITTEN}


def expected(seeds, settings):
    """All regions and images at once, with the library's own operators."""
    found = region_feed.region_table(seeds, settings)
    return {"regions": plain(found.toPandas().astype(object)), "images": plain(region_feed.image_table(found).toPandas().astype(object))}


def test_feed_over_growing_input(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_size")
    land, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    settings = config.load("region_feed") | {"images_per_block": 2}
    # an image comes in two files of two runs
    part.where("p_partkey < 100").coalesce(1).write.mode("append").parquet(land)
    first = region_feed.run(spark, land, out, mark, settings)
    assert (first["batches"], first["read"], first["seeds"]) == (1, 100, 100)
    assert {k: v for k, v in state(spark, out).items() if k != "seeds"} == expected(part.where("p_partkey < 100"), settings)
    stands = state(spark, out)
    assert region_feed.run(spark, land, out, mark, settings) == {"batches": 0, "read": 0} and state(spark, out) == stands
    untouched = sorted(f for f in os.listdir(f"{out}/regions/block=0") if f.endswith(".parquet"))
    # new seeds, one that is known with another size, a null, and a size for a seed twice in one batch
    more = part.where("p_partkey >= 100").unionByName(spark.createDataFrame([(99, 50), (99, 7), (None, 3)], "p_partkey long, p_size int"))
    more.coalesce(1).write.mode("append").parquet(land)
    second = region_feed.run(spark, land, out, mark, settings)
    assert (second["batches"], second["read"], second["seeds"]) == (1, 101, 201)
    now = part.where("p_partkey <> 99").unionByName(spark.createDataFrame([(99, 50)], "p_partkey long, p_size int"))
    assert {k: v for k, v in state(spark, out).items() if k != "seeds"} == expected(now, settings)
    assert sorted(f for f in os.listdir(f"{out}/regions/block=0") if f.endswith(".parquet")) == untouched  # other blocks are not written again
    # a batch that is run again after a failure leaves the same
    stands = state(spark, out)
    region_feed.take(more, 1, out, settings)
    assert state(spark, out) == stands


def test_feed_takes_files_in_batches(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_size")
    land, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    part.repartition(5).write.parquet(land)
    settings = config.load("region_feed") | {"files_per_trigger": 2}
    counts = region_feed.run(spark, land, out, mark, settings)
    assert (counts["batches"], counts["read"]) == (3, 200)
    assert {k: v for k, v in state(spark, out).items() if k != "seeds"} == expected(part, settings)
    assert counts["regions"] == regions.geometry(raster.synthetic_pixels(part)).count()


# --- settings and command lines -----------------------------------------------------------------


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"raters": 4}))
    assert config.load("text_study", str(tmp_path / "c.json")) == config.load("text_study") | {"raters": 4}
    (tmp_path / "c.json").write_text(json.dumps({"rater": 4}))
    with pytest.raises(ValueError, match="rater"):
        config.load("text_study", str(tmp_path / "c.json"))


@pytest.mark.parametrize(("job", "given"), [(text_study, ["D", "L", "O"]), (region_feed, ["I", "O", "C"])])
def test_command_line(monkeypatch, job, given):
    class Session:
        stopped = False

        def stop(self):
            Session.stopped = True

    class Builder:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return Session()

    seen = []
    monkeypatch.setattr(job, "SparkSession", type("S", (), {"builder": Builder()}))
    monkeypatch.setattr(job, "run", lambda spark, *a: seen.append(a))
    job.main(given)
    assert seen[0][:3] == tuple(given) and seen[0][3] == config.load(job.__name__.split(".")[-1]) and Session.stopped
