"""Null and repeated ids, clashing columns and odd vectors among embeddings; unit vectors against plain numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from sonoframe.llm import embedding_dedup


def test_null_and_repeated_ids_and_clashing_columns(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.95, 0.3122498999, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (None, b), (4, c), (5, [c[0], c[1], 2.0]), (6, None), (7, []), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 0.0]), (10, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 1.0, 0.0]), (12, [1.0, 0.0]), (None, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("u", "cid", "ball", "component_id", "n_links", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(docs).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (None, 0, None, False), *[(k, 0, k, True) for k in (6, 7, 8, 9, 10, 11, 12)]]
    assert got == sorted(want, key=str)


def test_unit_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=d).tolist() for d in (3, 64, 3, 500, 64)] + [[1e300, -1e300], [1e-300, 0.0], [5e-324, 0.0]]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["u"] for r in embedding_dedup.unit_vectors(docs, "vec_id", "embedding").collect()}
    for i, v in enumerate(vectors):
        most = max(map(abs, v))
        norm = math.sqrt(math.fsum((x / most) ** 2 for x in v))
        np.testing.assert_allclose(got[i], [x / most / norm for x in v], rtol=1e-12)
