"""Near-duplicate embeddings: randomised-rotation binary codes decide which pairs are recomputed exactly.

1. Equal vectors form one class, with its size.
2. Random hyperplanes give every class a bucket in each of several tables. Where buckets are crowded, classes join
   the ball of a leader within half the threshold's angle, so that all of a ball link by the triangle inequality
   and no pair of them is formed. Buckets save work; no link depends on them.
3. Leaders lie in cells around pivots, large cells in several blocks. Two blocks meet unless their cells' radii show
   that none of their vectors can link, so that the candidates are complete.
4. Where blocks meet, a leader's binary code (the signs of its randomly rotated vector) and its stored correction
   factor give an unbiased estimate of the inner product with any other leader, and a confidence bound on it. Pairs
   that the bound rules out are dropped; cosines of the others are computed exactly. The bound lies CONFIDENCE
   standard errors out, the only place where a link can be missed: for normal errors 3 in a million of those
   right at the threshold, and fewer above it.
5. Links are counted by class and ball: a vector close enough to a leader links with its whole ball, one far
   enough with none of it, and only in between are the ball's members compared one by one.

Unless cells lie apart, step 4 weighs all pairs of leaders: its time grows with the square of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.common import pieces, written
from sonoframe.llm.components import components

THRESHOLD = 0.9
#: The chance that a class half the threshold's angle from a crowded bucket's leader meets it in a table.
RECALL = 0.98
CODE_BITS = 256
#: Standard errors within which an estimate is taken to lie.
CONFIDENCE = 4.5
#: Buckets of so many classes elect a leader.
CROWDED = 24
#: Leaders of a block, about; cells around pivots, at most.
BLOCK, PIVOTS = 4096, 256
#: Queries that are weighed at once.
QUERIES = 512
SEED = 11
#: What angles near 0 are uncertain by; within it the exact cosine decides.
SLACK = 1e-7

CODED = T.StructType([T.StructField("cid", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType()))])


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """Random rotations of ``dim`` dimensions, one below the other, scaled so that lengths stay."""
    rng = np.random.default_rng(SEED + dim)
    blocks = -(-CODE_BITS // dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(blocks)]) / math.sqrt(blocks)


@lru_cache(maxsize=16)
def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED * 1000 + dim).normal(size=(dim, tables * bits))


def encode(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed signs) of unit vectors, and the inner product of each code with the vector that it stands for."""
    turned = u @ rotation(u.shape[1]).T
    signs = turned > 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    return np.packbits(signs, axis=1), factor


def estimate(query: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of rotated queries with coded vectors, and their standard errors."""
    m = query.shape[1]
    signs = np.unpackbits(code, axis=1, count=m).astype(np.float32) * 2 - 1
    along = np.einsum("ij,ij->i", signs, query) / math.sqrt(m)
    error = np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(1, m - 1)))
    return along / factor, error


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables for n classes: buckets hold a fraction of one unrelated class, and a pair at the threshold is found."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, n))) + 2))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike)))


def coded(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, vectors = part.column(0).to_numpy(), part.column(1)
                sizes = vectors.value_lengths().to_numpy()
                offsets, flat = np.concatenate(([0], np.cumsum(sizes))), vectors.flatten().to_numpy()
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    u = flat[offsets[rows][:, None] + np.arange(dim)[None, :]]
                    code, factor = encode(u)
                    side = (u @ hyperplanes(dim, tables, bits) > 0).reshape(len(rows), tables, bits)
                    value = (side @ power).astype(np.uint64)
                    salt = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
                    keys = (value ^ salt[None, :]) * np.uint64(0xD6E8FEB86659FD93)
                    keys ^= keys >> np.uint64(32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows]), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(keys.view(np.int64).reshape(-1)))], names=CODED.fieldNames()
                    )

    return classes.select("cid", "u").mapInArrow(run, CODED)


CELLED = T.StructType([T.StructField("ball", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("turn", T.DoubleType()), T.StructField("u", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("factor", T.DoubleType()), T.StructField("radius", T.DoubleType())])
BOUNDED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def celled(about: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each row (ball, u, code, factor, radius) with the nearest pivot of its dimension and the angle to it; cell -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("u")
            sizes = lists.value_lengths().to_numpy()
            offsets, flat = np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy()
            cell, turn, packed = np.full(len(sizes), -1, dtype=np.int32), np.full(len(sizes), math.pi), [b""] * len(sizes)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                u = flat[offsets[rows][:, None] + np.arange(dim)[None, :]]
                for i, x in zip(rows.tolist(), u.astype(np.float32), strict=True):
                    packed[i] = x.tobytes()
                if dim in pivots:
                    along = u @ pivots[dim].T
                    cell[rows] = along.argmax(axis=1)
                    turn[rows] = np.arccos(np.clip(along.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("ball"), pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(turn), pa.array(packed, pa.binary()), batch.column("code"), batch.column("factor"), batch.column("radius")], names=CELLED.fieldNames())

    return about.select("ball", "u", "code", "factor", "radius").mapInArrow(run, CELLED)


def meeting(sizes: list, pivots: dict[int, np.ndarray], theta: float) -> list[tuple[int, int, int, int, int]]:
    """(dim, cell, parts, other cell, its parts) of the cells (dim, cell, n, reach) that may hold a link, each two once."""
    out = []
    for i, x in enumerate(sizes):
        for y in sizes[i:]:
            if x["dim"] != y["dim"]:
                continue
            if x is not y and x["cell"] >= 0 and y["cell"] >= 0:
                cosine = float(pivots[x["dim"]][x["cell"]] @ pivots[x["dim"]][y["cell"]])
                if math.acos(max(-1.0, min(1.0, cosine))) > x["reach"] + y["reach"] + theta + 1e-6:
                    continue
            out.append((x["dim"], x["cell"], -(-x["n"] // BLOCK), y["cell"], -(-y["n"] // BLOCK)))
    return out


def weigh(a: pa.StructArray, b: pa.StructArray, dim: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks whose pairs the estimate's bound doesn't rule out."""
    query = np.frombuffer(b"".join(a.field("u").to_pylist()), dtype=np.float32).reshape(len(a), dim) @ rotation(dim).T.astype(np.float32)
    m = query.shape[1]
    code = np.frombuffer(b"".join(b.field("code").to_pylist()), dtype=np.uint8).reshape(len(b), -1)
    signs = np.unpackbits(code, axis=1, count=m).astype(np.float32) * 2 - 1
    factor, radius_a, radius_b = b.field("factor").to_numpy(), a.field("radius").to_numpy(), b.field("radius").to_numpy()
    error = estimate(np.zeros((len(b), m), dtype=np.float32), code, factor)[1]
    # a bound for the widest balls first, by one comparison a pair
    lowest = math.cos(min(math.pi, theta + radius_a.max() + radius_b.max()))
    least = ((lowest - CONFIDENCE * error - 1e-4) * factor * math.sqrt(m)).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), QUERIES):
        i, j = np.nonzero(query[at : at + QUERIES] @ signs.T >= least)
        i += at
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000], j[k : k + 20_000]
            value = estimate(query[x], code[y], factor[y])[0]
            keep = value + CONFIDENCE * error[y] + 1e-5 >= np.cos(np.minimum(theta + radius_a[x] + radius_b[y], math.pi))
            found.append((x[keep], y[keep]))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))


def undecided(about: DataFrame, theta: float) -> DataFrame:
    """(a, b) of all pairs of the rows (ball, u, code, factor, radius) that the estimate's bound doesn't rule out, each pair once."""
    k = min(PIVOTS, about.count() // BLOCK)
    chosen: dict[int, list] = {}
    for r in about.select("u", "ball").orderBy(F.xxhash64("ball"), "ball").limit(k).collect():
        chosen.setdefault(len(r["u"]), []).append(r["u"])
    pivots = {dim: np.array(u) for dim, u in chosen.items()}
    cells = written(celled(about, pivots), "cells")
    sizes = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max(F.col("turn") + F.col("radius")).alias("reach")).collect()
    spark = about.sparkSession
    pairs = meeting(sizes, pivots, theta)
    n_pairs = sum(x * (x + 1) // 2 if c == d else x * y for _, c, x, d, y in pairs)
    parts = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // BLOCK)) for r in sizes], "dim int, cell int, parts int")
    held = cells.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("ball", "dim"), "parts").cast("int"))
    one = held.groupBy("dim", F.col("cell").alias("cell_a"), F.col("part").alias("part_a")).agg(F.collect_list(F.struct("ball", "u", "radius")).alias("of_a"))
    two = held.groupBy("dim", F.col("cell").alias("cell_b"), F.col("part").alias("part_b")).agg(F.collect_list(F.struct("ball", "code", "factor", "radius")).alias("of_b"))
    met = spark.createDataFrame(pairs, "dim int, cell_a int, parts_a int, cell_b int, parts_b int")
    met = met.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    met = met.where("cell_a <> cell_b or part_a <= part_b").select("dim", "cell_a", "part_a", "cell_b", "part_b")
    met = met.join(one, ["dim", "cell_a", "part_a"]).join(two, ["dim", "cell_b", "part_b"])
    met = met.withColumn("same", (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))).select("dim", "same", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("of_a")[k].values, batch.column("of_b")[k].values
                i, j = weigh(a, b, batch.column("dim")[k].as_py(), theta)
                first, second = a.field("ball").to_numpy()[i], b.field("ball").to_numpy()[j]
                if batch.column("same")[k].as_py():
                    first, second = first[first < second], second[first < second]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second)], names=["a", "b"])

    # a few pairs of blocks a task, so that no task holds many
    return met.repartition(max(1, min(10_000, -(-n_pairs // 4)))).mapInArrow(run, BOUNDED)


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, u): unit vectors of the rows that can link; u is null where a vector is null, empty or zero, or has null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4000):
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            first = np.cumsum(sizes) - sizes
            # a null component becomes NaN
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            found, unit = np.zeros(len(sizes), dtype=bool), np.zeros(len(flat))
            for dim in np.unique(sizes[sizes > 0]).tolist():
                some = np.flatnonzero(sizes == dim)
                at = first[some][:, None] + np.arange(dim)[None, :]
                v = flat[at]
                most = np.abs(v).max(axis=1)
                fine = np.isfinite(v).all(axis=1) & (most > 0)
                scaled = v[fine] / most[fine, None]
                unit[at[fine]] = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
                found[some[fine]] = True
            kept = np.where(found, sizes, 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32))
            made = pa.ListArray.from_arrays(offsets, pa.array(unit[np.repeat(found, sizes)]), mask=pa.array(~found))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["vec_id", "u"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, u array<double>")


def near_duplicates(rows: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Vectors that are null, empty, zero or not wholly finite link with nothing; nor do vectors of unlike
    dimensions. Equal vectors, and rows with equal ids, link like any others. A row with a null id counts as a
    link of others; it has its component's least id, and isn't kept. An empty table gives no rows.
    """
    theta = math.acos(threshold)
    half = theta / 2 - SLACK
    vectors = written(unit_vectors(rows, id_col, vector_col), "units")
    # equal vectors are a class, numbered as written
    classes = vectors.where("u is not null").groupBy("u").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = table_sizes(classes.count(), math.cos(theta / 2), recall)
    codes = written(coded(classes, tables, bits), "codes")
    members = codes.select("cid", F.explode("keys").alias("key"))

    # balls: in crowded buckets, every class tries the bucket's least class as its leader
    crowded = members.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("leader")).where(F.col("m") >= CROWDED).select("key", "leader")
    tries = members.join(crowded, "key").select("cid", "leader").distinct()
    units = classes.select("cid", "u")
    leaders = units.select(F.col("cid").alias("leader"), F.col("u").alias("lu"))
    near = tries.join(units, "cid").join(leaders, "leader").where(F.size("u") == F.size("lu")).withColumn("turn", angle(dot("u", "lu"))).where(F.col("turn") <= half)
    joined = near.groupBy("cid").agg(F.min(F.struct("leader", "turn")).alias("x")).select("cid", F.col("x.leader").alias("ball"), F.col("x.turn").alias("turn"))
    placed = classes.select("cid", "n").join(joined, "cid", "left").select("cid", "n", F.coalesce("ball", "cid").alias("ball"), F.coalesce("turn", F.lit(0.0)).alias("turn"))
    placed = written(placed, "placed")
    balls = written(placed.groupBy("ball").agg(F.sum("n").alias("size"), F.max("turn").alias("radius"), F.min("cid").alias("first"), F.count("*").alias("classes")), "balls")

    # candidates: all pairs of balls that the codes don't rule out
    about = codes.select(F.col("cid").alias("ball"), "code", "factor").join(balls, "ball").join(units.withColumnRenamed("cid", "ball"), "ball")
    about = written(about, "about")
    open_pairs = written(undecided(about, theta), "open")

    # exact: leaders first, then each member against the other's ball, then member against member
    full = about.select("ball", "u", "radius", "size", "first", "classes")
    one = full.select(*[F.col(c).alias("a" if c == "ball" else f"{c}_a") for c in full.columns])
    two = full.select(*[F.col(c).alias("b" if c == "ball" else f"{c}_b") for c in full.columns])
    exact = open_pairs.join(one, "a").join(two, "b").withColumn("cosine", dot("u_a", "u_b"))
    single = (F.col("radius_a") == 0) & (F.col("radius_b") == 0) & (F.col("classes_a") == 1) & (F.col("classes_b") == 1) & (F.col("first_a") == F.col("a")) & (F.col("first_b") == F.col("b"))
    exact = written(exact.select("a", "b", "size_a", "size_b", "cosine", "radius_a", "radius_b", single.alias("single")), "exact")
    direct = exact.where(F.col("single") & (F.col("cosine") >= threshold)).select("a", "b", "size_a", "size_b")
    close = exact.where(~F.col("single") & (angle(F.col("cosine")) <= theta + F.col("radius_a") + F.col("radius_b") + SLACK)).select("a", "b")
    facing = close.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(close.select(F.col("b").alias("ball"), F.col("a").alias("other")))
    others = full.select(F.col("ball").alias("other"), F.col("u").alias("ou"), "radius", "size", "first")
    met = facing.join(placed.select("cid", "ball"), "ball").join(units, "cid").join(others, "other").withColumn("turn", angle(dot("u", "ou")))
    met = written(met.select("cid", "other", "turn", "radius", "size", "first"), "met")
    whole = met.where(F.col("turn") <= theta - F.col("radius") - SLACK)
    between = met.where((F.col("turn") > theta - F.col("radius") - SLACK) & (F.col("turn") <= theta + F.col("radius") + SLACK)).select("cid", "other")
    inner = placed.select(F.col("ball").alias("other"), F.col("cid").alias("y"), F.col("n").alias("n_y"))
    fine = between.join(inner, "other").join(units, "cid").join(units.select(F.col("cid").alias("y"), F.col("u").alias("yu")), "y").where(dot("u", "yu") >= threshold)
    fine = written(fine.select("cid", "y", "n_y"), "fine")

    counts = (
        direct.select(F.col("a").alias("cid"), F.col("size_b").alias("k")).union(direct.select("b", "size_a")).union(whole.select("cid", "size")).union(fine.select("cid", "n_y"))
        .groupBy("cid").agg(F.sum("k").alias("k"))
    )
    edges = direct.select("a", "b").union(whole.select("cid", "first")).union(fine.select("cid", "y")).union(placed.join(balls.select("ball", "first"), "ball").where("cid <> first").select("cid", "first"))
    nodes = components(edges)
    told = placed.join(balls.select("ball", "size"), "ball").join(counts, "cid", "left").join(nodes.withColumnRenamed("node", "cid"), "cid", "left").join(classes.select("cid", "least"), "cid")
    told = written(told.select("cid", (F.col("size") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"), "least"), "told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    known = told.join(least, "component").select("cid", "n_links", "component_id").join(units, "cid")
    known = written(known.select(F.xxhash64("u").alias("key"), F.col("u").alias("of"), "n_links", "component_id"), "known")
    able = vectors.where("u is not null").withColumn("key", F.xxhash64("u")).alias("v").join(known.hint("merge").alias("k"), (F.col("v.key") == F.col("k.key")) & (F.col("v.u") == F.col("k.of")))
    out = able.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.union(vectors.where("u is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
