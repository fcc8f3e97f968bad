"""A worker's cache of words plays no part in what it counts."""

import pickle

from sonoframe.llm import toxicity


def test_counts_do_not_depend_on_the_cache(monkeypatch):
    toxic = [(f"w{i} x{i} wretched scoundrel beastly", 1) for i in range(60)]
    ordinary = [(f"v{i} y{i} meadow river lantern", 0) for i in range(60)]
    packed = pickle.dumps(toxicity.train(toxic + ordinary))
    texts = ["wretched scoundrel beastly wretched", "beastly meadow", "scoundrel beastly wretched river"]
    want = [toxicity.Worker(packed).count(t) for t in texts]
    assert want[0] == (4, 4)
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 1)
    small = toxicity.Worker(packed)
    assert [small.count(t) for t in texts] == want
