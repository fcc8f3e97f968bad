"""Links right above the threshold, chains of them included: none is missed, whatever the blocks."""

import numpy as np
import pytest

from sonoframe.llm import embedding_dedup


def planted(n, dim, seed):
    """Chains of three: the outer two each at 0.901 to 0.93 to the middle one."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(n, dim))
    mid /= np.linalg.norm(mid, axis=1, keepdims=True)
    out = [mid]
    for _ in range(2):
        side = rng.normal(size=(n, dim))
        side -= (side * mid).sum(axis=1, keepdims=True) * mid
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        c = rng.uniform(0.901, 0.93, (n, 1))
        out.append(c * mid + np.sqrt(1 - c**2) * side)
    return np.concatenate(out).astype(np.float32)


@pytest.mark.parametrize("block", [4096, 300])
def test_every_planted_link_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block, raising=False)
    sets = [planted(1000, 64, 1), planted(100, 40, 2)]
    rows, want, component, at = [], {}, {}, 0
    for v in sets:
        w = v.astype(np.float64)
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        near = w @ w.T >= 0.9
        n = len(v) // 3
        for i in range(len(v)):
            rows.append((at + i, v[i].tolist()))
            want[at + i], component[at + i] = int(near[i].sum()) - 1, at + i % n
        assert near.sum() - len(v) >= 4 * n
        at += len(v)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    print("links", sum(r["n_links"] for r in got.values()), "of", sum(want.values()), "components right", sum(got[i]["component_id"] == component[i] for i in want), "of", len(want))
    assert {i: got[i]["n_links"] for i in want} == want
    assert {i: got[i]["component_id"] for i in want} == component
