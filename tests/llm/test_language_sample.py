"""The sample that languages are learned from, at any size."""

from pyspark.sql import functions as F

from sonoframe.llm import langid


def test_every_language_has_a_row_and_none_over_its_share(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    many = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.concat(F.lit("l"), F.col("id") % 1100).alias("lang"))
    got = langid.labelled_sample(many, 3, 1)
    assert len(got) == len({lang for _, lang in got}) > 600
    few = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("lang"))
    got = [lang for _, lang in langid.labelled_sample(few, 3, 1)]
    assert got.count("common") == 20 and got.count("rare") == 20
    assert langid.labelled_sample(few.repartition(7), 3, 1) == langid.labelled_sample(few, 3, 1)


def test_the_rate_stays_positive(spark):
    """The share of hashes that are looked at, for 10^12 rows of a language."""
    assert float(langid.HASHES) * 4 * (600 + 8) / 1e12 > 1e6


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 10)
    same = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("word").alias("text"), F.lit("en").alias("lang"))
    assert len(langid.labelled_sample(same, 3, 1)) <= 10


def test_single_rows_of_a_language_are_fitted_and_never_calibrated_on():
    fit, held = langid.split([("a b", "en")] * 10 + [("c", "de")], __import__("numpy").random.default_rng(1))
    assert len(held) == 2 and [lang for _, lang in fit].count("de") == 1
