"""What a worker holds while it packs."""

from sonoframe.llm import packing


def test_groups_are_packed_without_the_tokenizer(spark, monkeypatch):
    import public_tokenizers

    real = packing.pack

    def watched(lengths, capacities, bin_cost):
        from sonoframe.llm import common

        assert not common._resident
        return real(lengths, capacities, bin_cost)

    monkeypatch.setattr(packing, "pack", watched)
    docs = spark.createDataFrame([(k, f"text {k} " * (k + 1)) for k in range(200)], "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2, shard_pieces=20)
    assert got.select("doc_id").distinct().count() == 200
