"""Without marks, the order of the rows is what is left of the plan."""

from sonoframe.llm import mixing


def test_rows_come_in_order_of_progress(spark):
    rows = [(i, f"s{i % 3 if i % 7 else 0}", "word " * (1 + i % 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    marked = mixing.mix(docs).collect()
    plain = [r["doc_id"] for r in mixing.mix(docs, marks=False).collect()]
    assert sorted(plain) == sorted(r["doc_id"] for r in marked)
    at = {}
    for r in sorted(marked, key=lambda r: r["mix_progress"]):
        at.setdefault(r["doc_id"], []).append(r["mix_progress"])
    seen = dict.fromkeys(at, 0)
    order = []
    for i in plain:
        order.append(at[i][seen[i]])
        seen[i] += 1
    assert order == sorted(order)


def test_rows_without_an_id_are_dealt_to_many_blocks(spark):
    docs = spark.createDataFrame([(None, "s", f"word {i} " * 3) for i in range(300)] + [(None, "s", "same")] * 2, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len({r["mix_block"] for r in got}) > 8 and len({r["mix_block"] for r in got if r["text"] == "same"}) == 1
    assert sorted(r["text"] for r in mixing.mix(docs, marks=False).collect()) == sorted(r["text"] for r in got)
