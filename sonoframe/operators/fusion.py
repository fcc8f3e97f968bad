"""One transcript out of two models' hypotheses for each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import hotwords as hw
from sonoframe.functions.text import normalize, quality, sequence_ratio, strip, text_or_empty
from sonoframe.params import Params


def pair_hypotheses(primary: DataFrame, secondary: DataFrame, key: str = "segment_id") -> DataFrame:
    """Both hypotheses of each segment side by side; either may be missing. Inputs have ``key``, ``text`` and, if they like, ``reported``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        reported = F.col("reported") if "reported" in df.columns else hw.empty()
        return df.select(key, F.col("text").alias(f"{name}_text"), reported.alias(f"{name}_reported"), F.lit(True).alias(f"{name}_there"))

    both = side(primary, "primary").join(side(secondary, "secondary"), key, "full_outer")
    return both.withColumns({f"{n}_there": F.coalesce(f"{n}_there", F.lit(False)) for n in ("primary", "secondary")})


def heard(primary: DataFrame, secondary: DataFrame, key: str = "segment_id") -> DataFrame:
    """Primary hypotheses of the segments in which the secondary model heard anything."""
    return primary.join(secondary.where(text_or_empty("text") != "").select(key), key, "left_semi")


def decide(pairs: DataFrame, params: Params = Params(), *, hotwords: Column | None = None, similarity: Column | None = None, unicode_form: bool = True) -> DataFrame:
    """``pairs`` with ``fused``: the text, its hotwords, what was chosen and why, and the measures behind it.

    ``similarity`` is a column for the likeness of the normal forms ``norm_primary`` and ``norm_secondary``; without
    it, it is the ratio of matching blocks.
    """
    p = params
    words = hotwords if hotwords is not None else hw.empty()
    df = pairs.withColumns({"primary_text": text_or_empty("primary_text"), "secondary_text": text_or_empty("secondary_text")})
    df = df.withColumns({"norm_primary": normalize("primary_text", unicode_form=unicode_form), "norm_secondary": normalize("secondary_text", unicode_form=unicode_form), "_words": hw.normalized(words)})
    df = df.withColumns({"_q1": quality(F.col("norm_primary"), F.col("_words"), p.hotword_boost), "_q2": quality(F.col("norm_secondary"), F.col("_words"), 0.0), "_sim": similarity if similarity is not None else sequence_ratio("norm_primary", "norm_secondary")})
    q1, q2, sim = F.col("_q1"), F.col("_q2"), F.col("_sim")
    first, second = F.col("primary_text"), F.col("secondary_text")
    fair = q1["score"] >= p.min_primary_score
    # fixed values: choices and reasons; in order, the first that holds decides
    rules = [
        (second == "", "silence", "secondary_empty_force_silence", F.lit("")),
        (first == "", "secondary_only", "primary_empty", second),
        (q1["hotword_hits"] > 0, "primary_hotword_hit", "primary_hits_hotword", first),
        ((q1["repetition_ratio"] > p.max_repetition) | ((1 - sim > p.disagreement_threshold) & (q1["hotword_hits"] <= q2["hotword_hits"])), "secondary_qwen_fallback", "primary_hallucination_risk", second),
        ((sim >= p.similarity_threshold) & fair, "primary_agreement", "high_similarity_and_primary_valid", first),
        (fair & (q1["score"] >= q2["score"] + p.score_margin), "primary_hotword_advantage", "primary_score_margin", first),
        (F.lit(True), "secondary_qwen_fallback", "primary_not_confident", second),
    ]

    def choose(pick) -> Column:
        out = None
        for rule in rules:
            out = F.when(rule[0], pick(rule)) if out is None else out.when(rule[0], pick(rule))
        return out

    known = words
    measured = (first != "") & (second != "")
    kept = {"p": hw.keep_reported(F.col("primary_reported"), known), "s": hw.keep_reported(F.col("secondary_reported"), known)}
    of = lambda rule: hw.empty() if rule[1] == "silence" else kept["p"] if rule[3] is first else kept["s"]
    fused = F.struct(
        choose(lambda r: r[3]).alias("text"), choose(of).alias("hotwords"), choose(lambda r: F.lit(r[1])).alias("selected"), choose(lambda r: F.lit(r[2])).alias("reason"),
        F.when(measured, F.round(sim, 4)).alias("similarity"), F.when(measured, F.lit(p.similarity_threshold)).alias("threshold"), F.when(measured, F.round(1 - sim, 4)).alias("disagreement"),
        F.when(measured, q1["score"]).otherwise(0.0).alias("primary_score"), F.when(measured, q2["score"]).when((second != "") & (first == ""), 1.0).otherwise(0.0).alias("secondary_score"),
        F.when(measured, q1).alias("primary_metrics"), F.when(measured, q2).alias("secondary_metrics"), F.col("norm_primary").alias("primary_preview"), F.col("norm_secondary").alias("secondary_preview"),
    )
    return df.withColumn("fused", fused).drop("_q1", "_q2", "_sim", "_words")


def final_text(pairs: DataFrame, params: Params = Params(), **how) -> DataFrame:
    """``pairs`` with ``final``: the fused text, or, where one model gave no result at all, the other's text."""
    df = decide(pairs, params, **how)
    one = F.when(F.col("primary_there") & ~F.col("secondary_there"), F.col("primary_text")).when(F.col("secondary_there") & ~F.col("primary_there"), F.col("secondary_text"))
    return df.withColumn("final", F.coalesce(one, F.col("fused.text")))


def detected_or(detected: Column, requested: Column) -> Column:
    return F.coalesce(F.nullif(detected, F.lit("")), requested)


def partial_text(pairs: DataFrame, params: Params = Params(), **how) -> DataFrame:
    """``pairs`` with ``final``, where the secondary model heard anything and a text is chosen: what a partial shows."""
    heard_any = pairs.where(F.trim(text_or_empty("secondary_text")) != "")
    return final_text(heard_any, params, **how).where(F.trim("final") != "")


def primary_partial(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``final``: the primary text alone, where both models heard anything."""
    text = strip(text_or_empty("primary_text"))
    return pairs.where((strip(text_or_empty("secondary_text")) != "") & (text != "")).withColumn("final", text)
