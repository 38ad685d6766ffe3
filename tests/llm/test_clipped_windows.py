"""A document that begins inside an item keeps each clipped window."""

from casalith.llm import decontaminate
from tests.llm.test_ops import DOCS, prose


def test_clipped_windows_of_one_start(spark):
    item, rest = prose(77, 44).split(), prose(5, 90)
    other = prose(78, 44).split()
    other[15:20] = item[20:25]  # the document's shingle at 13: raw start -7 by the item, -2 by the other
    docs = spark.createDataFrame([(1, " ".join(item[7:]) + " " + rest, "en", "a", 1)], DOCS)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.start_word, r.n_words) for r in decontaminate.op4(docs, bench).collect()]
    assert got == [(1, 1, 0, 37)]
    assert decontaminate.without_leaks(docs, bench).count() == 0
