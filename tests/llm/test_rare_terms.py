"""A term that toxic documents alone use is learnt however small its share of them is."""

from casalith.llm import toxicity
from tests.llm.test_ops import prose


def test_rare_terms_are_learnt(spark):
    """24 of 6,000 toxic documents, each in another context: 0.4 % of them."""
    rows = [(i, prose(i, 6) + (f" rareterm {prose(i + 50_000, 3)}" if i % 500 == 0 else " grumble " + prose(i + 90_000, 3) if i % 2 == 0 else ""), i % 2 == 0) for i in range(12_000)]
    rows += [(20_000 + i, prose(i + 70_000, 3), False) for i in range(12_000)]
    labelled = spark.createDataFrame([(t, int(x)) for _, t, x in rows], "text string, toxic int")
    found = toxicity.lexicon(labelled)
    assert {"w:rareterm", "w:grumble"} <= set(found)
    assert all(f.split(":")[1] in ("rareterm", "grumble", "rare", "raret", "grum", "grumb") for f in found)
    assert toxicity.lexicon(labelled.filter("toxic = 0")) == {}
