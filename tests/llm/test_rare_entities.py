"""Terms of entities that stand in one text only."""

from spanlake.llm import pii


def test_a_term_is_rated_from_one_text(spark):
    rows = [(1, "Customer Blofeld (mail ernst@spectre.example now) and Zorin or call"), (2, "the mail and the call of the customer or the shop " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: [rows[0][1][t.start : t.end] for t in r.terms] for r in pii.find(docs).collect()}
    assert "Zorin" in found[1] and "and" not in found[1] and found[2] == []
    assert "Zorin" not in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[1]
