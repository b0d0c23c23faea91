"""Benchmark items too short for an error budget."""

from kinlake.llm import decontaminate
from tests.llm.test_text_operators import table


def test_short_items_match_as_whole_words(spark):
    docs = table(spark, [(1, "Ask: what is   PI? Then go."), (2, "what is pie"), (3, "somewhat is pi"), (4, "what is pi"), (5, "whet is pi")])
    bench = spark.createDataFrame([(7, "What is pi?"), (8, " ?! "), (9, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in got) == [(1, 7, 0, 5, 17), (4, 7, 0, 0, 10)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 5]
