"""Copies of one document in its repository don't make its secret an example."""

from casalith.llm import secrets
from tests.llm.test_ops import DOCS, prose


def test_copies_of_one_document_are_one_owner(spark):
    key, shared = "q7Xk29fLmB4vT8zRw3Ye", "EXAMPLEkey1EXAMPLEkey2"
    own = [(i, f"{prose(1, 400)} {key} end", "en", "a", 1) for i in range(5)] + [(5, f"{prose(1, 400)} {key} End now", "en", "a", 1)]
    many = [(10 + i, f"{prose(20 + i, 40)} {shared} end", "en", "a", 1) for i in range(5)]
    spread = [(20 + i, "Zq7Xk29fLmB4vT8zRw3Ye here", "en", f"s{i}", 1) for i in range(5)]
    short = [(30 + i, f"W{shared} {'abcde'[i]}", "en", "a", 1) for i in range(5)]
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.op10(spark.createDataFrame(own + many + spread + short, DOCS)).collect()}
    assert got == {i: (1, 0) if i < 10 else (0, 1) for i in got} and len(got) == 21
