import json

from quillon.operators import proposals as P
from tests.test_operators import rows


def test_cards_become_items(spark):
    cards = spark.createDataFrame([("r", "d", "c1", "Alpha", "about alpha", ["s1", "s2"]), ("r", "d", "c2", "Beta", "about beta", ["s3"]), ("r", "d", "c3", "Gamma", "g", ["s9"])],
                                  "run_id string, document_id string, card_id string, title string, content string, segment_ids array<string>")
    entities = spark.createDataFrame([("s1", "ALPHA"), ("s2", "Zed"), ("s1", "One")], "segment_id string, canonical string")
    changes = spark.createDataFrame([("s1", 0.9), ("s2", 0.5), ("s3", 0.7)], "segment_id string, confidence double")
    made = P.from_cards(cards, entities, changes)
    assert rows(made, "title", "aliases", "confidence")[0] == ("Alpha", ["One", "Zed"], 0.5)
    items = spark.createDataFrame([("i1", "Old", "", "old body", ["beta"], "current"), ("i2", "src", "", "", [], "current")], "item_id string, title string, summary string, body string, aliases array<string>, status string")
    marked = P.with_duplicates(made, items)
    assert dict(rows(marked, "title", "duplicate_item_id")) == {"Alpha": None, "Beta": "i1", "Gamma": None}
    choice = {"Alpha": "accept", "Beta": "merge", "Gamma": "reject"}
    decisions = spark.createDataFrame([(r.proposal_id, choice[r.title]) for r in made.collect()], "proposal_id string, decision string")
    decided = P.decide(marked, decisions)
    assert dict(rows(decided, "title", "status")) == {"Alpha": "accepted", "Beta": "merged", "Gamma": "rejected"}
    assert rows(P.decide(decided, decisions), "title", "status") == rows(decided, "title", "status")
    after = {r.title: r for r in P.apply_decisions(items, decided).collect()}
    assert after["Old"].body == "old body\n\nabout beta" and after["Old"].status == "needs-review" and after["src"].status == "current" and after["Alpha"].body == "about alpha"
    sources = spark.createDataFrame([("d", "i2")], "document_id string, item_id string")
    assert {r.source_id for r in P.supporting_edges(decided, sources).collect()} == {"i2"} and P.supporting_edges(decided, sources).count() == 2


def test_answers_must_keep_the_contract(spark):
    good = {"schema_version": "deep-correction-response-v2", "chunk_id": "k", "reviewed_segment_ids": ["s1", "s2"], "chapters": [], "knowledge_cards": [], "entities": [],
            "corrections": [{"segment_id": "s1", "corrected_text": "x", "reason": "r", "confidence": 0.9, "uncertain": False, "evidence": [{"kind": "source", "segment_id": "s1", "quote": "hello"}]}]}
    c = good["corrections"][0]
    cases = {
        "fine": good, "fields": good | {"more": 1}, "chunk": good | {"chunk_id": "z"}, "reviewed": good | {"reviewed_segment_ids": ["s2", "s1"]},
        "twice": good | {"corrections": [c, c]}, "range": good | {"corrections": [c | {"confidence": 1.5}]}, "quote": good | {"corrections": [c | {"evidence": [{"kind": "source", "segment_id": "s1", "quote": "bye"}]}]},
        "none": good | {"corrections": [c | {"evidence": []}]}, "other": good | {"corrections": [c | {"segment_id": "s7"}]}, "extra": good | {"corrections": [c | {"note": "n"}]},
    }
    texts = {"s1": "hello there", "s2": "more"}
    data = [(k, json.dumps(v), "k", ["s1", "s2"], texts) for k, v in cases.items()] + [("json", "```json```", "k", ["s1", "s2"], texts)]
    df = spark.createDataFrame(data, "answer_id string, payload string, chunk_id string, core_ids array<string>, source_text map<string,string>")
    found: dict = {}
    for r in P.answer_errors(df).collect():
        found.setdefault(r.answer_id, set()).add(r.code)
    assert "fine" not in found
    want = {"fields": "wrong_fields", "chunk": "wrong_chunk", "reviewed": "not_all_reviewed", "twice": "corrected_twice", "range": "confidence_out_of_range",
            "quote": "quote_not_verbatim", "none": "quote_not_verbatim", "other": "unknown_segment", "extra": "wrong_correction_fields", "json": "not_json"}
    assert all(code in found[k] for k, code in want.items()), found


def test_evidence_of_every_kind_and_overlapping_segments(spark):
    evidence = {
        "whole": {"kind": "source", "segment_id": "s1", "quote": "__FULL_SEGMENT__"}, "second": {"kind": "rerecognition", "segment_id": "s1", "quote": "again"},
        "other": {"kind": "rerecognition", "segment_id": "s2", "quote": "again"}, "term": {"kind": "glossary", "segment_id": "s1", "quote": "LIDAR"},
        "web": {"kind": "web", "evidence_id": "e1", "url": "https://x.org", "quote": "found"}, "wrong": {"kind": "web", "evidence_id": "e1", "url": "https://y.org", "quote": "found"},
    }
    one = lambda e, s="s1": {"segment_id": s, "corrected_text": "x", "reason": "r", "confidence": 0.9, "uncertain": False, "evidence": [e]}
    data = []
    for name, e in evidence.items():
        answer = {"schema_version": "deep-correction-response-v2", "chunk_id": "k", "reviewed_segment_ids": ["s1", "s2"], "corrections": [one(e), one(e, "s9")], "chapters": [], "knowledge_cards": [], "entities": []}
        data.append((name, json.dumps(answer), "k", ["s1", "s2"], {"s1": "hello there", "s2": "more"}, ["s1", "s2", "s9"], "once again", ["lidar"], [("e1", "https://x.org", "it was found")]))
    schema = "answer_id string, payload string, chunk_id string, core_ids array<string>, source_text map<string,string>, context_ids array<string>, rerecognition string, glossary array<string>, web array<struct<evidence_id:string,url:string,snippet:string>>"
    got = P.usable_corrections(spark.createDataFrame(data, schema)).collect()
    assert {(r.answer_id, r.segment_id) for r in got} == {(k, "s1") for k in ("whole", "second", "term", "web")}
