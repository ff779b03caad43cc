"""Rare kinds of personal data are found whatever the size of the sample that the trees see."""

import math

from loamdex.llm import pii


def test_rare_kinds_keep_their_thresholds(spark):
    rows = [(i, f"order 2024-{i:05d}-{i * 7919 % 99991:05d} came in at {i} and left") for i in range(600)]
    rare = {1000 + i: f"write to ann{i} (at) example{i} (dot) org today" for i in range(4)} | {2000: "pay to GB29 NWBK 6016 1331 9268 19 now"}
    docs = spark.createDataFrame(rows + list(rare.items()), "doc_id long, text string")
    trees, cut = pii.fit(docs, 20)
    assert cut["spelt_email"] < math.inf and cut["account"] < math.inf
    found = {r.doc_id: [s.kind for s in r.all_spans] for r in pii.find(docs, (trees, cut)).collect()}
    assert all(found[k] == ["spelt_email"] for k in range(1000, 1004))
    assert "account" in found[2000]
    assert {r.doc_id: r.text for r in pii.redact(docs, (trees, cut)).collect()}[1000] == "write to [SPELT_EMAIL] today"
