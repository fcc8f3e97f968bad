"""Load-test figures by level: percentiles, real-time factors, throughput, and where a ladder of levels stops."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.sources.scratch import stored


def counts(requests: DataFrame, by: list[str], ok: Column) -> DataFrame:
    n_ok = F.count_if(ok)
    return requests.groupBy(*by).agg(F.count("*").alias("n_total"), n_ok.alias("n_ok"), (F.count("*") - n_ok).alias("n_err"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, names): exact quantiles of each group, between neighbours by straight lines; null values don't count.

    Values are counted first, one row for each distinct one, and those are dealt by ranges of (group, value): no task
    holds a group. A group's count before each of the few ranges it spreads over says where a quantile lies.
    """
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    # stored with the number of its range, so that both uses see the same one
    dealt = stored(distinct.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "quantiles")
    within = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("_part", *by).agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*by)
    known = parts.withColumns({"_base": F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(whole)}).drop("_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_part", *by)]
    running = dealt.withColumn("_upto", F.sum("_n").over(within)).alias("a").join(known.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{value}").alias("_v"), F.col("a._n").alias("_n"), (F.col("_base") + F.col("_upto")).alias("_end"), "_all")
    covers = lambda place: (place < F.col("_end")) & (place >= F.col("_end") - F.col("_n"))
    found = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("_all") - 1)
        low = F.floor(place)
        ends = {"l": low, "h": F.least(low + 1, F.col("_all") - 1)}
        found += [F.max(F.when(covers(x), F.col("_v"))).alias(f"_{name}_{k}") for k, x in ends.items()] + [F.max(place - low).alias(f"_{name}_w")]
    got = running.groupBy(*by).agg(*found)
    return got.select(*by, *[(F.col(f"_{n}_l") + (F.col(f"_{n}_h") - F.col(f"_{n}_l")) * F.col(f"_{n}_w")).alias(n) for n in at])


def level_stats(requests: DataFrame, by: list[str], *, ok: Column, latency: Column, audio_sec: Column, tokens: Column, wall_sec: Column) -> DataFrame:
    """One row a level; latencies are those of good requests, percentiles interpolate, and a level without one has nulls."""
    df = requests.withColumn("_good", F.when(ok, latency))
    n_ok, wall, audio = F.count_if(ok), F.max(wall_sec), F.max(audio_sec)
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n_total"), n_ok.alias("n_ok"), (F.count("*") - n_ok).alias("n_err"), F.avg("_good").alias("lat_mean"),
        (n_ok / wall).alias("req_per_s"), (n_ok * audio / wall).alias("audio_s_per_s"), (F.sum(F.when(ok, tokens)) / wall).alias("tok_per_s"), audio.alias("_audio"),
    )
    places = quantiles(df, by, "_good", {"lat_p50": 0.5, "lat_p90": 0.9, "lat_p99": 0.99})
    both = sums.alias("s").join(places.alias("q"), [F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by], "left")
    return both.select(*[F.col(f"s.{c}").alias(c) for c in by], "n_total", "n_ok", "n_err", "lat_p50", "lat_p90", "lat_p99", "lat_mean", (F.col("lat_p50") / F.col("_audio")).alias("rtf_p50"), (F.col("lat_p90") / F.col("_audio")).alias("rtf_p90"), "req_per_s", "audio_s_per_s", "tok_per_s")


def error_rate(n_err: Column, n_total: Column) -> Column:
    return n_err / F.greatest(F.lit(1), n_total)


def request_count(concurrency: Column, fixed: Column | None = None) -> Column:
    """Requests for a level: five a client, 20 at least and 200 at most, unless fixed."""
    auto = F.least(F.lit(200), F.greatest(F.lit(20), concurrency * 5))
    return auto if fixed is None else F.coalesce(fixed, auto)


def until_overload(levels: DataFrame, ladder: str, step: str, *, rtf: str = "rtf_p50", errors: str = "error_rate", most_rtf: float = 1.0, most_errors: float = 0.05) -> DataFrame:
    """Each ladder's levels up to the first that is overloaded, itself included."""
    over = F.when((F.col(rtf) > most_rtf) | (F.col(errors) > most_errors), 1).otherwise(0)
    before = Window.partitionBy(ladder).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return levels.withColumn("_o", F.coalesce(F.max(over).over(before), F.lit(0))).where("_o = 0").drop("_o")


def real_time_factor(elapsed: Column, duration: Column) -> Column:
    return F.when(duration == 0, 0.0).otherwise(elapsed / duration)


def first_errors(requests: DataFrame, by: list[str], order: str, error: str, most: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return requests.where(F.col(error).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def report(requests: DataFrame, levels: DataFrame, config: dict, *, by: list[str], order: str, ok: Column, latency: str, error: str, output: str, path: str) -> None:
    """Writes a load test's report to ``path``: its settings, its levels with their figures, first errors and a sample answer, and all latencies.

    ``levels`` is what level_stats() gives. Figures are JSON lines, one a level, ``settings`` one line; latencies are
    a table beside them, in order of request, since a level may have any number of them.
    """
    spark = requests.sparkSession
    errors = first_errors(requests.where(~ok), by, order, error).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", F.col(error).alias("error")))).alias("_e"))
    sample = requests.where(ok).groupBy(*by).agg(F.min_by(output, order).alias("sample_output"))
    keyed = lambda df: [F.col(f"l.{c}").eqNullSafe(df[c]) for c in by]
    whole = levels.alias("l").join(errors, keyed(errors), "left").join(sample, keyed(sample), "left")
    told = whole.select("l.*", "sample_output", F.coalesce(F.transform("_e", lambda e: e["error"]), F.array().cast("array<string>")).alias("errors"))
    told.write.mode("overwrite").json(f"{path}/results")
    requests.where(ok).select(*by, order, F.col(latency).alias("latency")).repartitionByRange(*by, order).sortWithinPartitions(*by, order).write.mode("overwrite").parquet(f"{path}/raw_latencies")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_report(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame, DataFrame]:
    """Settings, levels of ``schema``, and latencies of a report."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    return config, spark.read.schema(schema).json(f"{path}/results"), spark.read.parquet(f"{path}/raw_latencies")
