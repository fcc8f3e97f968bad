"""Personal data: rules against plain searches, trees on what the rules can't say, odd rows."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from sonoframe.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = [
    None,
    "",
    "a@b.c_d@e.f x@y é 1.2.3.4.5.6.7.8 999.1.2.3.4.5.6.7 0007.1.2.3 a@b..c @x.y %@-.-",
    "card 4111 1111-1111 1111 and 12- 34 4111-1111-1111-1111 5 4111111111111111111 4111111111111111 7",
    "+1 (487) 555-7209 4111111111111111 +1 2 +123456789012345678 ++49 30 1234567- +49(30)1234.567",
    "é😀 me@ex.org\n::1 256.1.1.1 1.1.1.01.5",
    "1.2.3.4 " * 300 + "x.y@z.w",
    "a" * 50_000 + "." * 1000 + "1" * 20_000 + "+1" + " (" * 5000,
]


def plain_valid(kind, s):
    digits = [int(c) for c in s if c in "0123456789"][::-1]
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if plain_valid(k, m.group())]


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, texts):
    assert len(rows) == len(texts)
    for i, text in texts.items():
        want = plain(text)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert rows[i]["base_sha256"] == hashlib.sha256(spelled(want).encode()).hexdigest()
        found = [s for s in rows[i]["spans"].split(",") if s]
        assert set(spelled(want).split(",")) - {""} <= set(found)
        places = [(pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])) for s in found]
        assert places == sorted(places)


def test_rules_equal_plain_searches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = docs.union(odd)
    rows = {r["doc_id"]: r for r in pii.digests(pii.find(docs, pii.train(docs))).collect()}
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.fixture(scope="module")
def learned(spark):
    """A corpus of confirmed numbers and addresses among other numbers."""
    rows = []
    for i in range(300):
        rows.append((f"row {i} {['call', 'and'][i % 2]} +1 ({200 + i}) 555-{1000 + 7 * i} or {['write to', 'at'][i % 2]} {['ann.lee', 'bo', f'user{i}'][i % 3]}@{['example.org', f'mail{i}.example.com'][i % 2]} now",))
        rows.append((f"order {10**9 + 7919 * i} of {i}.{i + 1} costs {i * 37}.50, version 3.{i}.{i * 2}.{300 + i}",))
    return pii.train(spark.createDataFrame(rows, "text string"))


def test_trees_add_what_the_rules_miss(spark, learned):
    assert learned.thresholds["phone"] is not None and learned.thresholds["email"] is not None and learned.thresholds["card"] is None
    texts = ["please call (487) 555-7210 today", "write to joe (at) example.com please", "no data: 12345678901 and 3.14, 1.2.3", "+1 (487) 555-7209 4111 1111"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [texts[0][a:b] for a, b in rows[0]["more_phone"]] == ["(487) 555-7210"] and not rows[0]["pii_phone"]
    assert [texts[1][a:b] for a, b in rows[1]["more_email"]] == ["joe (at) example.com"]
    assert not any(rows[2][f"{p}_{k}"] for p in ("pii", "more") for k in pii.KINDS)
    # the rule takes all digits that follow and drops the match; the tighter candidate stays
    assert not rows[3]["pii_phone"] and any(texts[3][a:b].endswith("555-7209") for a, b in rows[3]["more_phone"])


def test_column_and_plain_score_agree(spark, learned):
    xs = [[3, 3, 2, 2, 0, 0, 1, 1], [0, 0, 1, 0, 0, 0, 0, 1], [2, 6, 0, 0, 3, 3, 0, 0]]
    got = spark.createDataFrame([(x,) for x in xs], "x array<int>").select(learned.score(F.col("x")).alias("s")).collect()
    for x, r in zip(xs, got, strict=True):
        assert abs(learned.margin(x) - math.log(r["s"] / (1 - r["s"]))) < 1e-6


def test_redaction(spark, learned):
    rows = [(1, "a +1 (487) 555-7209 b me@x.org", 7), (2, None, 8), (3, "plain", 9)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, start int"), learned).collect()
    assert [(r["text"], r["start"]) for r in sorted(got)] == [("a [phone] b [email]", 7), ("", 8), ("plain", 9)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = pii.train(empty)
    assert pii.digests(pii.find(empty, model)).collect() == [] and model.thresholds == dict.fromkeys(pii.KINDS)
    clash = spark.createDataFrame([(None, "x@y.z", 1, 2), (None, "x@y.z", 1, 2)], "doc_id long, text string, _t int, email int")
    rows = pii.find(clash, model).collect()
    assert len(rows) == 2 and all(r["email"] == 2 and len(r["pii_email"]) == 1 for r in rows)
