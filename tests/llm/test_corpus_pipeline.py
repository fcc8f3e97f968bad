"""The pipeline's stages, each held against brute force on the rows of the stage before."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sonoframe.llm import packing
from sonoframe.llm.common import written
from tests_brute import least_reachable, plain_fingerprint, plain_repeats

NAMES = ["toxicity", "simhash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]


@pytest.fixture(scope="module")
def sf():
    """Large enough to have labels to learn toxicity from."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        out.append(docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go_and_others_stay(spark, sf, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in s.select("doc_id").collect()} for s in stages[:2])
    clean = [d for d in before if labels.get(d) == 0]
    assert after < before
    assert len([d for d in clean if d in after]) >= 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    label = least_reachable(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r["doc_id"] for r in stages[2].collect()} == {d for d in ids if label[d] == d}


def test_repeats_are_cut(stages):
    before = stages[2].orderBy("doc_id").collect()
    want = {r["doc_id"]: kept.decode("utf-8", "ignore") for r, (_, _, _, kept) in zip(before, plain_repeats([r["text"] for r in before]), strict=True)}
    after = stages[3].collect()
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing_repeats_whole_rows(stages):
    before, after = (Counter(map(tuple, s.collect())) for s in stages[3:5])
    assert set(before) == set(after) and all(1 <= after[r] <= 2 * before[r] for r in before)


def test_sequences_give_back_every_document(spark, sf, stages):
    """Each row of the stage before, empty ones too, is its token ids and an end, whole and in one order of pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (corpus_pipeline.END_ID,)) for r in stages[4].collect())
    pieces = {}
    for r in stages[5].collect():
        pieces.setdefault((r["doc_id"], r["copy"]), []).append((r["start"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u2").tolist(), r["bin_id"], r["bin_offset"]))
    got, placed = [], {}
    for (doc, _), parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        got.append((doc, tuple(i for p in parts for i in p[2])))
        for _, _, ids, bin_id, offset in parts:
            placed.setdefault(bin_id, []).append((offset, ids))
    assert sorted(got) == want
    for r in packing.sequences(stages[5]).collect():
        assert r["used"] <= r["capacity"]
        assert np.frombuffer(bytes(r["ids"]), "<u2").tolist() == [i for _, ids in sorted(placed[r["bin_id"]]) for i in ids]



def test_run_applies_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages[5].columns
    assert got.agg({"n_tokens": "sum"}).first()[0] == stages[5].agg({"n_tokens": "sum"}).first()[0]
