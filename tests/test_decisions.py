"""Validators of decisions on hard bodies."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from cadenza.operators import decisions as D

REFERENCES, QUERY = {"C0": ["R:C0", "shared"], "C1": ["R:C1"]}, ["Q:a", "Q:b", "shared"]


def report(**change):
    comparison = lambda c, s: {"condition_id": c, "similar": s, "similarities": ["x"], "differences": [], "evidence_ids": [f"R:{c}", "Q:a"]}
    return {"outcome": "similar", "condition_id": "C1", "comparisons": [comparison("C0", False), comparison("C1", True)], "explanation": "why"} | change


def changed(i, **change):
    body = copy.deepcopy(report())
    body["comparisons"][i] |= change
    return body


def without(key):
    body = report()
    del body[key]
    return body


def one_less(key):
    body = report()
    del body["comparisons"][0][key]
    return body


REPORTS = [
    (report(), "valid"), (report(outcome="different", condition_id=None, comparisons=[c | {"similar": False} for c in report()["comparisons"]]), "valid"), ("", "json"), (None, "json"), ("[1", "json"), ('{"outcome":"similar","outcome":"similar"}', "json"),
    ("[]", "keys"), ("3", "keys"), (without("comparisons"), "keys"), (without("explanation"), "keys"), (report(note=1), "keys"), (report(outcome="same"), "outcome"), (report(outcome=None), "outcome"), (report(outcome=["similar"]), "outcome"),
    (report(explanation=" \t"), "explanation"), (report(explanation=7), "explanation"), (report(comparisons=[]), "comparisons"), (report(comparisons={}), "comparisons"), (report(comparisons=None), "comparisons"), (report(comparisons=report()["comparisons"][:1]), "comparisons"),
    (one_less("differences"), "comparison"), (changed(0, similar="true"), "comparison"), (changed(0, similar=1), "comparison"), (changed(0, similar=None), "comparison"), (changed(0, similarities=[""]), "comparison"), (changed(0, similarities="x"), "comparison"), (changed(0, evidence_ids=[1]), "comparison"),
    (changed(0, more=1), "comparison"), (report(comparisons=[1, 2]), "comparison"), (changed(0, condition_id="C1"), "condition"), (changed(0, condition_id="C7"), "condition"), (changed(0, condition_id=None), "condition"), (changed(0, condition_id=0), "condition"),
    (changed(0, evidence_ids=["R:C0", "Q:a", "R:C1"]), "fabricated"), (changed(0, evidence_ids=["R:C0", "Q:a", "Q:z"]), "fabricated"), (changed(0, evidence_ids=["R:C0"]), "one_sided"), (changed(0, evidence_ids=["Q:a"]), "one_sided"), (changed(0, evidence_ids=[]), "one_sided"), (changed(0, evidence_ids=["shared", "Q:a"]), "one_sided"),
    (report(condition_id="C0"), "conclusion"), (report(condition_id=None), "conclusion"), (report(condition_id="C7"), "conclusion"), (report(outcome="different"), "conclusion"), (report(outcome="different", condition_id=None), "conclusion"), (changed(1, similar=False), "conclusion"),
]


def bodies(cases):
    return [(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, (b, _) in enumerate(cases)]


def check(df, cases):
    got = dict(df.collect())
    assert {i: got[i] for i in got} == {i: v for i, (_, v) in enumerate(cases)}, [(cases[i], got[i]) for i in got if got[i] != cases[i][1]]


def test_whole_reports(spark):
    x = spark.createDataFrame([(*b, REFERENCES, QUERY) for b in bodies(REPORTS)], "id long, body string, references map<string, array<string>>, query array<string>")
    check(D.whole_report(x), REPORTS)


def decision(**change):
    return {"decision": "accept", "condition_id": "A", "candidates": ["A", "B"], "evidence": ["Q1", "A.CARD"], "explanation": "so"} | change


MEMORY = [
    (decision(), "valid"), (decision(candidates=[]), "valid"), (decision(decision="review", condition_id=None, evidence=["Q1", "B.CARD"]), "valid"), ("{", "json"), (decision(more=1), "keys"), (decision(decision="Accept"), "decision"), (decision(candidates=["A", "A"]), "candidates"),
    (decision(candidates=["A", "B", "C"]), "candidates"), (decision(candidates=["A", "Z"]), "candidates"), (decision(candidates="A"), "candidates"), (decision(candidates=[None]), "candidates"), (decision(condition_id="C"), "condition"), (decision(condition_id="Z", candidates=[]), "condition"), (decision(condition_id=None), "condition"),
    (decision(decision="review"), "condition"), (decision(evidence=[]), "citations"), (decision(evidence=["A.CARD"]), "citations"), (decision(evidence=["Q1"]), "citations"), (decision(evidence=["Q1", "B.CARD"]), "citations"), (decision(evidence=["Q1", "A.CARD", "Q2"]), "citations"), (decision(evidence="Q1"), "citations"),
    (decision(explanation=""), "explanation"), (decision(explanation=None), "explanation"),
]


def test_memory_decisions(spark):
    x = spark.createDataFrame([(*b, ["Q1", "A.CARD", "B.CARD"], "Q1") for b in bodies(MEMORY)], "id long, body string, evidence array<string>, query string")
    check(D.memory_decision(x, ["A", "B", "C"]), MEMORY)


def answer(**change):
    return {"label": "L", "score": 0.5, "observations": ["o"]} | change


ANSWERS = [
    (answer(), "valid"), (answer(score=1), "valid"), (answer(score=0), "valid"), (answer(label=None, score=None), "valid"), (answer(observations=[]), "valid"), (answer(observations=['"label":"x"', '"label":"y"'] * 32), "valid"), (answer(observations=["é" * 8192]), "valid"),
    ('{"label":"a","label":"b","score":1,"observations":[]}', "json"), ('{"label":"a","score":NaN,"observations":[]}', "json"), (answer(extra=1), "keys"), ("null", "keys"), (answer(label=" "), "label"), (answer(label=3), "label"), (answer(score="0.5"), "score"), (answer(score=1.01), "score"), (answer(score=-1e-9), "score"),
    (answer(score=None), "score"), (answer(score=True), "score"), (answer(label=None), "score"), (answer(observations=["o"] * 65), "observations"), (answer(observations=["x" * 8193]), "observations"), (answer(observations=[1]), "observations"), (answer(observations=None), "observations"),
]


def test_teacher_answers(spark):
    check(D.teacher_answer(spark.createDataFrame(bodies(ANSWERS), "id long, body string")), ANSWERS)


def visual(**change):
    return {"outcome": "known", "condition_id": "A", "explanation": "so"} | change


VISUAL = [
    (visual(), "valid"), (visual(outcome="indeterminate", condition_id=None), "valid"), (visual(outcome="outside_reference", condition_id=None), "valid"), ("x", "json"), (visual(note=1), "keys"), ({"outcome": "known", "condition_id": "A"}, "keys"), (visual(outcome="maybe"), "outcome"), (visual(outcome=None), "outcome"),
    (visual(condition_id=None), "condition"), (visual(condition_id="Z"), "condition"), (visual(outcome="indeterminate"), "condition"), (visual(condition_id=["A"]), "condition"), (visual(explanation=" "), "explanation"),
]


def view(name, **change):
    return {"view": name, "figure": f"F.{name}", "finding": "clear"} | change


AUDITS = [
    ({"views": [view("a")]}, "valid"), ({"views": [view(n) for n in "abcde"]}, "valid"), ("{}", "keys"), ("[]", "keys"), ("{", "json"), ({"views": []}, "count"), ({"views": None}, "count"), ({"views": [view(n) for n in "abcdef"]}, "count"), ({"views": [view("a", more=1)]}, "entry"), ({"views": [view("a", finding="")]}, "entry"),
    ({"views": ["a"]}, "entry"), ({"views": [view("z")]}, "unavailable"), ({"views": [view("a"), view("b"), view("a")]}, "repeated"), ({"views": [view("a"), view("b", figure="F.a")]}, "figure"),
]


def test_visual_decisions_and_audits(spark):
    check(D.visual_decision(spark.createDataFrame([(*b, ["A", "B"]) for b in bodies(VISUAL)], "id long, body string, conditions array<string>")), VISUAL)
    check(D.diagram_audit(spark.createDataFrame([(*b, {n: f"F.{n}" for n in "abcdef"}) for b in bodies(AUDITS)], "id long, body string, figures map<string, string>")), AUDITS)


def test_categories(spark):
    rows = [("a", "a", False, "correct"), ("a", "b", False, "wrong"), ("a", None, False, "rejected_known"), (None, "a", False, "accepted_unknown"), (None, None, False, "correct_rejection"), ("a", "a", True, "undecided"), (None, None, True, "undecided")]
    got = spark.createDataFrame(rows, "t string, s string, u boolean, w string").select(D.outcome_category(F.col("t"), F.col("s"), F.col("u")), "w").collect()
    assert all(a == b for a, b in got)


@pytest.mark.parametrize("validate,schema", [(D.whole_report, "id long, body string, references map<string, array<string>>, query array<string>"), (D.teacher_answer, "id long, body string")])
def test_no_bodies(spark, validate, schema):
    assert validate(spark.createDataFrame([], schema)).collect() == []


def test_schema_asks_for_what_is_valid(spark):
    """Bodies that the validator takes have the schema's keys and types; what the schema forbids, the validator refuses."""
    wanted = json.loads(spark.createDataFrame([(["C0", "C1"],)], "c array<string>").select(D.report_schema(F.col("c"))).first()[0])
    schema = wanted["json_schema"]["schema"]
    assert wanted["type"] == "json_schema" and wanted["json_schema"]["strict"] is True
    assert set(schema["required"]) == set(schema["properties"]) == set(report()) and schema["additionalProperties"] is False
    item = schema["properties"]["comparisons"]["items"]
    assert set(item["required"]) == set(item["properties"]) == set(report()["comparisons"][0]) and item["additionalProperties"] is False
    assert schema["properties"]["condition_id"] == {"type": ["string", "null"], "enum": ["C0", "C1", None]} and item["properties"]["condition_id"] == {"type": "string", "enum": ["C0", "C1"]}
    kinds = {"boolean": bool, "array": list, "string": str}
    assert all(isinstance(report()["comparisons"][0][k], kinds[p["type"]]) for k, p in item["properties"].items())
    assert schema["properties"]["outcome"]["enum"] == ["similar", "different"] and item["properties"]["evidence_ids"] == {"type": "array", "items": {"type": "string"}}
