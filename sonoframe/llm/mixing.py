"""Temperature mixing of sources, realised as budgeted permutations of blocks.

A source's weight is its share of tokens to the power of an exponent between 0 (all sources alike) and 1 (as
they come). The exponent is bisected to the least one that keeps every source's passes over its documents within
a repetition limit, or that keeps the entropy of the weights at or under a target. A source's documents form
blocks by a hash of their id; each pass runs over a new permutation of the blocks, and the last one stops where
the source's token budget is met. Only DataFrame operations are used: the exponents tried at once are columns of
one aggregate, and the places of blocks in a permutation are prefix sums over buckets, then within buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import wrapped, written
from sonoframe.llm.packing import word_count

REPETITION_LIMIT = 2.0
BLOCK_TOKENS, LEAST_BLOCKS = 200_000, 16
SEED = 17
#: The exponent is a multiple of 1 / WAYS ** ROUNDS.
WAYS, ROUNDS = 16, 3
NO_SOURCE = "(none)"
#: A column of a row's block key, which goes again.
KEY = "_mix_key"
MARKS = ("mix_source", "mix_block", "mix_epoch", "mix_weight", "mix_progress")


def source_key(source_col: str = "source") -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))


def block_of(blocks: int, id_col: str = "doc_id") -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % blocks


def block_key(docs: DataFrame, id_col: str) -> Column:
    """What deals a row to a block: its id, or where that is null a hash of the row, so that such rows don't all meet."""
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), F.xxhash64(*plain).cast("string")))


def exponent(sources: DataFrame, *, repetition_limit: float | None, entropy: float | None) -> float:
    """The least exponent that holds the limit; ``sources`` has ``tokens`` over 0. 1 if none lower does.

    ``repetition_limit`` bounds the most passes over a source when the least repeated one has one pass;
    ``entropy`` is a share of the logarithm of the number of sources.
    """
    low, width = 0.0, 1.0
    total = sources.agg(F.sum("tokens").cast("double"), F.count("*")).first()
    if not total[1]:
        return 1.0
    share = F.col("tokens") / F.lit(total[0])

    def held(tried: list[float]) -> list[bool]:
        columns = []
        for i, a in enumerate(tried):
            power = F.pow(share, F.lit(a))
            columns += [F.sum(power).alias(f"s{i}"), F.max(power / share).alias(f"most{i}"), F.min(power / share).alias(f"least{i}"), F.sum(power * F.log(power)).alias(f"l{i}")]
        r = sources.agg(*columns).first()
        out = []
        for i in range(len(tried)):
            fine = True
            if repetition_limit is not None:
                fine = r[f"most{i}"] <= repetition_limit * r[f"least{i}"] * (1 + 1e-9)
            if entropy is not None:
                h = math.log(r[f"s{i}"]) - r[f"l{i}"] / r[f"s{i}"]
                fine = fine and h <= entropy * math.log(max(2, total[1])) * (1 + 1e-9)
            out.append(fine)
        return out

    if held([0.0])[0]:
        return 0.0
    for _ in range(ROUNDS):
        width /= WAYS
        fine = held([low + width * i for i in range(1, WAYS + 1)])
        first = fine.index(True) if True in fine else WAYS - 1
        low += width * first
    return low + width


def plan(sized: DataFrame, *, repetition_limit: float | None = REPETITION_LIMIT, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> tuple[DataFrame, int]:
    """One row for each block and pass that the mix takes, and the number of blocks of a source.

    ``sized`` has (source, doc_id, tokens). Rows: source, block, epoch, weight, budget, progress, where progress
    is the share of its source's budget that comes before. Without ``budget`` the mix is the least that has every
    document at least once. A source without tokens is taken once.
    """
    sources = written(sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    real = sources.where("tokens > 0")
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    blocks = max(LEAST_BLOCKS, math.ceil((total or 0) / block_tokens))
    alpha = exponent(real, repetition_limit=repetition_limit, entropy=entropy)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha))
    scale = real.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    norm, whole = scale[0] or 1.0, (scale[1] or 0.0) * (scale[0] or 1.0)
    all_tokens = float(budget) if budget is not None else whole
    weight = F.when(F.col("tokens") > 0, power / F.lit(norm)).otherwise(0.0)
    shares = sources.select("source", F.col("tokens").alias("source_tokens"), weight.alias("weight"), F.when(F.col("tokens") > 0, F.round(weight * F.lit(all_tokens))).otherwise(0).cast("long").alias("budget"))
    summed = sized.groupBy("source", block_of(blocks).alias("block")).agg(F.sum("tokens").alias("tokens"))
    passes = F.when(F.col("source_tokens") > 0, F.ceil(F.col("budget") / F.col("source_tokens"))).otherwise(1)
    runs = summed.join(shares, "source").withColumn("epoch", F.explode(F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))))
    runs = runs.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.col("epoch").cast("string"), F.col("block").cast("string")).cast("binary"))).withColumn("bucket", F.substring("key", 1, 2))
    runs = written(runs, "runs")
    buckets = runs.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "epoch", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("within", within).join(buckets.select("source", "epoch", "bucket", before.alias("before")), ["source", "epoch", "bucket"])
    start = F.col("epoch") * F.col("source_tokens") + F.col("before") + F.col("within")
    taken = placed.withColumn("start", start).where((F.col("start") < F.col("budget")) | ((F.col("epoch") == 0) & (F.lit(budget is None) | (F.col("source_tokens") == 0))))
    return taken.select("source", "block", "epoch", "weight", "budget", (F.col("start") / F.greatest(F.col("budget"), F.lit(1))).alias("progress")), blocks


def mix(docs: DataFrame, *, tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source", marks: bool = True, **how) -> DataFrame:
    """``docs`` with each row once for each pass that takes its block, and mix_source, mix_block, mix_epoch, mix_weight, mix_progress.

    Sorted by mix_progress, any beginning of the result has nearly the target weights. ``tokens`` is a column of
    token counts (words of ``text`` by default); null counts are 0. Rows with a null source form a source of their
    own; null and repeated ids are kept, and equal ids share a block. An empty table gives no rows. Columns of
    ``docs`` that have one of the added names are replaced; without ``marks`` only the columns of ``docs`` come, as they are, sorted by progress.
    """
    sized = written(docs.select(source_key(source_col).alias("source"), block_key(docs, id_col).alias("doc_id"), F.coalesce(word_count() if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens")), "sized")
    runs, blocks = plan(sized, **how)
    runs = written(runs.select(*[F.col(c).alias(f"mix_{c}") for c in runs.columns]), "plan")
    placed = wrapped(docs.withColumn(KEY, block_key(docs, id_col)), mix_source=source_key(source_col), mix_block=block_of(blocks, KEY))
    mixed = placed.join(runs.drop("mix_budget").hint("merge"), ["mix_source", "mix_block"])
    if not marks:
        return mixed.orderBy("mix_progress", "mix_source", "mix_epoch", "mix_block", F.xxhash64(F.col("doc")[KEY])).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    return mixed.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in MARKS], *MARKS)


#: The same rows as mix() of ``documents`` gives op10, for its default parameters.
ORACLE = f"""
WITH sized AS (
  SELECT coalesce(source, '{NO_SOURCE}') AS source, doc_id,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY source),
total AS (SELECT sum(tokens)::DOUBLE AS n, greatest({LEAST_BLOCKS}, ceil(sum(tokens) / {BLOCK_TOKENS})::BIGINT) AS blocks FROM sources),
grid AS (SELECT i / {WAYS**ROUNDS}.0::DOUBLE AS a FROM range(0, {WAYS**ROUNDS} + 1) t(i)),
tried AS (
  SELECT a, max(pow(s.tokens / t.n, a) / (s.tokens / t.n)) AS most, min(pow(s.tokens / t.n, a) / (s.tokens / t.n)) AS least
  FROM grid, sources s, total t WHERE s.tokens > 0 GROUP BY a),
chosen AS (SELECT coalesce(min(a), 1.0) AS a FROM tried WHERE most <= {REPETITION_LIMIT} * least * (1 + 1e-9)),
powers AS (SELECT s.source, s.tokens, pow(s.tokens / t.n, c.a) AS p FROM sources s, total t, chosen c),
scale AS (SELECT sum(p) AS norm, max(tokens / p) * sum(p) AS whole FROM powers WHERE tokens > 0),
shares AS (
  SELECT source, tokens AS source_tokens, CASE WHEN tokens > 0 THEN p / norm ELSE 0 END AS weight,
         CASE WHEN tokens > 0 THEN round(p / norm * whole)::BIGINT ELSE 0 END AS budget
  FROM powers, scale),
placed AS (
  SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % blocks AS block FROM sized, total),
summed AS (SELECT source, block, sum(tokens)::BIGINT AS tokens FROM placed GROUP BY source, block),
runs AS (
  SELECT b.*, s.source_tokens, s.weight, s.budget, e.epoch, md5('{SEED}|' || b.source || '|' || e.epoch::VARCHAR || '|' || b.block::VARCHAR) AS key
  FROM summed b JOIN shares s USING (source), LATERAL (SELECT unnest(range(0, CASE WHEN s.source_tokens > 0 THEN ceil(s.budget / s.source_tokens)::BIGINT ELSE 1 END)) AS epoch) e),
started AS (
  SELECT *, epoch * source_tokens + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM runs)
SELECT p.doc_id, p.source, p.block, r.epoch, p.tokens::BIGINT AS tokens, round(r.weight, 9) AS weight, round(r.start / greatest(r.budget, 1), 9) AS progress
FROM placed p JOIN started r USING (source, block)
WHERE r.start < r.budget OR r.epoch = 0
"""
