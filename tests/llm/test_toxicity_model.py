"""Scores against plain zstandard, models of few labels, and models of repeated ids."""

import math

import numpy as np
import zstandard

from sonoframe.llm import toxicity

TOXIC = [(f"w{i} x{i} wretched scoundrel beastly", 1) for i in range(60)]
ORDINARY = [(f"v{i} y{i} meadow river lantern", 0) for i in range(60)]


def test_scores_against_plain_zstandard(spark):
    model = toxicity.train(TOXIC + ORDINARY)
    texts = ["wretched river, scoundrel!", "", None, "beastly " * 50 + "meadow", "w" * 500 + " wretched"]
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=7, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0)

    def size(dictionary, window):
        return len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window))

    def plain(text):
        found = (text or "").encode().lower().split()
        hits = 0
        for w in found:
            w = w.strip(b".,;:!?\"'()[]")
            parts = [w[i : i + 200] for i in range(0, len(w), 200)] if len(w) > 200 else [w]
            hits += max(size(model.ordinary, b" " + p + b" " + model.tail) - size(model.toxic, b" " + p + b" " + model.tail) for p in parts) >= model.threshold
        a, b, c = model.weights
        return 1 / (1 + math.exp(-(a + b * math.log1p(hits) + c * math.log((hits + 0.5) / (len(found) + 50)))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts], rtol=1e-9)


def test_few_labels_still_give_a_model(spark):
    model = toxicity.train(TOXIC[:3] + ORDINARY[:20])
    docs = spark.createDataFrame([(1, "wretched scoundrel beastly"), (2, "meadow river lantern"), (3, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert scores[1] > scores[2]
    assert toxicity.train(TOXIC) is None and toxicity.train([(None, 0), *TOXIC]) is None


def test_repeated_ids_give_one_sample(spark):
    docs = spark.createDataFrame([(i % 7, t) for i, (t, _) in enumerate(TOXIC + ORDINARY)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 2, "doc_id long, toxic int")
    one = toxicity.labelled_sample(docs.repartition(5), labels, 5, 0)
    assert one == toxicity.labelled_sample(docs.repartition(2), labels.orderBy("toxic"), 5, 0)
    assert len(one[0]) == len({t for t, _ in one[0]})
