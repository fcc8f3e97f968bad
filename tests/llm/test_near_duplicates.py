"""SimHash, embeddings and components against brute force."""

import hashlib
import math

import numpy as np
import pytest

from sonoframe.llm import embedding_dedup, simhash
from sonoframe.llm.components import components
from tests_brute import least_reachable, plain_fingerprint


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two three", "A b C d", "x " * 5000, "Ünï cödé　words AND more of them\x0bhere", "a\x1cb c\x85d e f g"])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = least_reachable(ids, links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in ids}
    assert any(want[d] != d for d in ids)


@pytest.mark.parametrize("most", [3_000_000, 3_000])
def test_balls_link_all_pairs_within_the_radius(spark, monkeypatch, most):
    """Small groups, and groups that have to be split by more bits."""
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", most)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).tolist()
    fps = set(base)
    for fp in base[:25]:
        for flips in (1, 2, 3, 4, 5):
            fps.add(fp ^ simhash.mask(rng.choice(64, flips, replace=False)))
    centre = int(rng.integers(0, 1 << 63))
    fps.update(centre ^ simhash.mask(rng.choice(64, 3, replace=False)) for _ in range(60))
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4]
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.ball_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    assert least_reachable(fps, found) == least_reachable(fps, links)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7_000, 7_000), (-5, -9), (-9, -2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + links[:3], "a long, b long")).collect()}
    want = least_reachable({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n != 7_000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nulls_repeats_and_clashing_columns_stay(spark):
    rows = [(3, None, 1, "a"), (3, None, 1, "a"), (None, "some words of a text here", 2, "b"), (9, "some words of a text here", 3, None), (1, "another text altogether, with its own words", None, "d"), (2, "", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got) == [(False, 1, 1), (False, 2, 2), (False, 3, 2), (False, 3, 2), (False, 9, 9), (True, 0, 9)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[4], rows[5], rows[3]]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def cosines(vectors):
    v = np.array(vectors, dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


def test_embeddings_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    fine = sorted((r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"]))
    ids, c = [i for i, _ in fine], cosines([v for _, v in fine])
    links = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(c >= 0.9), strict=True) if a < b}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert set(got) == {r["vec_id"] for r in rows}
    found = sum(r["n_links"] for r in got.values())
    assert found == 2 * len(links)
    degree = {i: 0 for i in got}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    full = least_reachable(got, links)
    assert all(got[i]["component_id"] == full[i] for i in got)
    assert all(full[got[i]["component_id"]] == full[i] for i in got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_crowded_embeddings_lose_no_link(spark):
    """Many near copies of a few vectors, exact copies and rows that link with nothing."""
    rng = np.random.default_rng(4)
    hub = rng.normal(size=(3, 64))
    vectors = [(hub[k % 3] + 0.12 * rng.normal(size=64)).tolist() for k in range(240)] + [hub[0].tolist()] * 50
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] + [1.0] * 63), (1004, []), (1005, [float("inf")] + [0.0] * 63)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in odd)
    near = cosines(np.array(vectors, dtype=np.float32)) >= 0.9
    want = near.sum(axis=1) - 1
    assert sum(got[i]["n_links"] for i, _ in rows) == want.sum()
    assert all(got[i]["n_links"] <= want[i] for i, _ in rows)
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    full = least_reachable(range(len(rows)), links)
    assert all(got[i]["component_id"] == full[i] for i, _ in rows)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_lie_within_their_bounds():
    """The code's estimate of an inner product, against the exact one."""
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(2, 2000, 64))
    v = u + rng.uniform(0, 2, (2000, 1)) * v
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, v))
    code, factor = embedding_dedup.encode(u)
    found, error = embedding_dedup.estimate(v @ embedding_dedup.rotation(64).T, code, factor)
    off = found - (u * v).sum(axis=1)
    assert np.all(np.abs(off) <= embedding_dedup.CONFIDENCE * error)
    assert abs(off.mean()) < 0.01


def test_component_ids_do_not_depend_on_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    digest = lambda df: hashlib.md5(str(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert digest(simhash.near_duplicates(docs)) == digest(simhash.near_duplicates(docs.repartition(7)))
