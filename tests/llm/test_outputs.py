"""Media, record files, mixing and packing: round trips, invariants and odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import jpeg, media, mixing, packing, queries, records
from sonoframe.llm.common import scratch

ODD = [(1, None), (2, ""), (3, "a" * 64), (3, "a" * 64), (4, "ß" * 40_000), (None, "null id"), (7, "tab\tnew\nline  two spaces "), (8, "\x00\x7f​😀 end")]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def digest_of(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_payloads_come_back_from_the_stored_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("media", F.lit("clash"))
    texts = sorted(((r["doc_id"], digest_of(r["text"])) for r in docs.collect()), key=str)
    rows = media.media_features(media.store_payloads(docs)).collect()
    assert sorted(((r["doc_id"], (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows), key=str) == texts
    same = defaultdict(set)
    for r in rows:
        same[r["payload_sha256"], r["n_bytes"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    assert len({r["media_sha256"] for r in rows}) == len(same)
    assert media.media_features(media.store_payloads(docs.limit(0))).count() == 0


def test_files_are_baseline_jpeg():
    blob = jpeg.encode([media.padded(b"hello")], [b"5"])[0]
    assert blob[:2] == b"\xff\xd8" and blob[-2:] == b"\xff\xd9" and b"\xff\xc0" in blob
    image, coefficients = jpeg.decode([blob])[0]
    assert jpeg.payload_of(image, coefficients) == media.padded(b"hello")
    with pytest.raises(Exception):  # noqa: B017
        jpeg.decode([blob[: len(blob) // 2]])


def test_thumbnail_is_the_mean_of_each_block():
    """A file's DC coefficients give each block's mean grey."""
    image, coefficients = jpeg.decode(jpeg.encode([bytes(range(64)) * 64], [b"1"]))[0]
    thumb = jpeg.thumbnail(image, coefficients)
    assert thumb.size and thumb.dtype == np.uint8
    assert len(jpeg.average_hash(thumb)) == 16


def test_token_records_against_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op9_token_records"](spark, sf).collect()}
    start, want = 0, {}
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(VOCABULARY), records.encoder(VOCABULARY, "<u2")
    rng = random.Random(5)
    alphabet = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", " ", "　", "9", "!", "é", "日本", "😀", "\x1c", "​", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_records_and_damage(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("part", F.lit("clash"))
    rows = records.token_digests(docs, scratch(spark, "records"), tokenizer=VOCABULARY, end_id=2).collect()
    assert len(rows) == len(ODD)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *[r["n_tokens"] for r in ordered[:-1]]]).tolist()
    assert ordered[0]["doc_id"] is None and all(r["n_tokens"] >= 1 for r in rows)
    assert records.token_digests(docs.limit(0), scratch(spark, "records"), tokenizer=VOCABULARY, end_id=2).count() == 0
    whole = records.frame(b"some ids")
    assert records.unframe(whole) == b"some ids"
    for at in (0, 9, len(whole) - 2):
        with pytest.raises(ValueError):
            records.unframe(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])


def compare(df, sql, sf):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted(found.fetchall(), key=str)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str), want


def test_mix_is_what_sql_says(spark, sf):
    got, want = compare(queries.QUERIES["op10_source_mix"](spark, sf), queries.ORACLES["op10_source_mix"], sf)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-8)


def made_docs(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 400), s) for s, n in (("big", 900), ("mid", 200), ("rare", 30), (None, 20)) for i in rng.sample(range(10**6), n)]
    return spark.createDataFrame([*rows, (None, None, "mid"), (5, "", "wordless"), (5, "", "wordless")], "doc_id long, text string, source string").withColumn("mix_block", F.lit("clash")).withColumn("doc", F.lit(1))


def test_mix_keeps_every_row_and_its_limits(spark):
    docs = made_docs(spark)
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    passes = defaultdict(set)
    for r in rows:
        passes[r["mix_source"]].add(r["mix_epoch"])
    assert max(max(p) for p in passes.values()) <= 1 and max(passes["big"]) == 0
    first = [r for r in rows if r["mix_epoch"] == 0]
    assert sorted((r["doc_id"] or -1, r["source"] or "", r["text"] or "") for r in first) == sorted((r["doc_id"] or -1, r["source"] or "", r["text"] or "") for r in docs.collect())
    tokens = defaultdict(int)
    for r in rows:
        tokens[r["mix_source"]] += len((r["text"] or "").split())
    weights = {r["mix_source"]: r["mix_weight"] for r in rows}
    total = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert all(abs(tokens[s] / total - w) < 0.05 for s, w in weights.items())
    plain = mixing.mix(docs, marks=False)
    assert plain.columns == docs.columns and plain.count() == len(rows)
    assert {r["mix_block"] for r in plain.select("mix_block").distinct().collect()} == {"clash"}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_meets_an_entropy_and_a_budget(spark):
    docs = made_docs(spark)
    weights = {r["mix_source"]: r["mix_weight"] for r in mixing.mix(docs, repetition_limit=None, entropy=0.6).collect() if r["mix_weight"]}
    p = np.array(list(weights.values()))
    assert -(p * np.log(p)).sum() <= 0.6 * np.log(len(p)) + 1e-6
    assert -(p * np.log(p)).sum() >= 0.55 * np.log(len(p))
    few = mixing.mix(docs, budget=20_000).collect()
    assert 15_000 < sum(len((r["text"] or "").split()) for r in few) < 60_000


def check_bins(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert {(r["used"], r["capacity"]) for r in held} == {(at, min(c for c in capacities if c >= at))}
    return bins


def test_every_piece_is_packed_once(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.QUERIES["op6_best_fit_packing"](spark, sf)
    found = rows.collect()
    bins = check_bins(found, packing.CAPACITIES)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == len(got[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) // 2
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u2").tolist()
    encode = Tokenizer.from_file(VOCABULARY).encode
    assert got == {r["doc_id"]: [*encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    assert sum(r["n_tokens"] for r in found) >= 0.9 * sum(held[0]["capacity"] for held in bins.values())
    again = defaultdict(dict)
    for s in packing.sequences(rows).collect():
        ids = np.frombuffer(s["ids"], "<u2").tolist()
        assert len(ids) == s["used"] <= s["capacity"]
        for d in s["documents"]:
            again[d["doc_id"]][d["start"]] = ids[d["offset"] : d["offset"] + d["n_tokens"]]
    assert {k: [t for _, part in sorted(v.items()) for t in part] for k, v in again.items()} == got


def least_opening(length, waiting, capacities, cost):
    """The capacity that costs least a token, by filling each with the longest waiting pieces that fit, one by one."""
    costs = {}
    for c in sorted(capacities):
        if c >= length:
            left, filled = sorted(waiting, reverse=True), length
            for n in left:
                filled += n if n <= c - filled else 0
            final = min(x for x in capacities if x >= filled)
            costs[c] = (final + cost + final * final / packing.ATTENTION) / filled
    least = min(costs.values())
    return min(c for c, x in costs.items() if x <= least + 1e-12)


@pytest.mark.parametrize("seed", range(20))
def test_opening_against_a_plain_search(seed):
    rng = random.Random(seed)
    waiting = [rng.randint(1, 64) for _ in range(rng.randint(0, 40))]
    length = rng.randint(1, 64)
    want = least_opening(length, waiting, (16, 32, 64), 2)
    assert packing.opening(length, packing.Counter(waiting), sorted(set(waiting)), (16, 32, 64), 2) == want


def best_fit(lengths, capacities, cost):
    """Best-fit decreasing by a scan of all bins, with an opening rule of its own."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, used = [], []
    for k, i in enumerate(order):
        n = lengths[i]
        fits = [room for room in rooms if room >= n]
        if fits:
            b = max(j for j, room in enumerate(rooms) if room == min(fits))
        else:
            rooms.append(least_opening(n, [lengths[j] for j in order[k + 1 :]], capacities, cost))
            used.append(0)
            b = len(rooms) - 1
        rooms[b] -= n
        used[b] += n
    return sorted(used)


@pytest.mark.parametrize("seed", range(6))
def test_packing_against_a_scan_of_all_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 16), 64, 1]) for _ in range(300)]
    where, offset, capacity, used = packing.pack(lengths, (16, 32, 64), 2)
    assert sum(used) == sum(lengths) and all(u <= c for u, c in zip(used, capacity, strict=True))
    slow = best_fit(lengths, (16, 32, 64), 2)
    cost = lambda us: sum(min(c for c in (16, 32, 64) if c >= u) + 2 for u in us)
    assert cost(used) <= 1.02 * cost(slow)


def test_odd_lengths_pack(spark):
    docs = spark.createDataFrame([(1, 0), (2, None), (3, 10_000), (3, 10_000), (None, 5), (9, 4096)], "doc_id long, n long").withColumn("copy", F.lit("clash")).withColumn("piece", F.lit(0))
    rows = packing.pack_documents(docs, length=F.col("n")).collect()
    check_bins(rows, packing.CAPACITIES)
    assert sum(r["n_tokens"] for r in rows) == 24_101 and len(rows) == 8
    assert packing.pack_documents(docs.limit(0), length=F.col("n")).count() == 0


def test_text_in_scratch_is_seen_by_id_order(spark, sf):
    index = records.write_records(spark.read.parquet(f"{sf}/documents.parquet"), scratch(spark, "records"), tokenizer=VOCABULARY, end_id=None)
    rows = sorted(index.collect(), key=lambda r: (r["part"], r["seq"]))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
