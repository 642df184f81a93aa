"""Nested JSON taken apart and put together, against the standard library."""

import json
import random

import pytest

from cadenza.operators.nested import assembled, nodes, pruned, without_texts


def any_body(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [rng.randrange(100), "text, \"quoted\" \\ {é}:0}", None, rng.random() < 0.5, "report.1.welch"][kind]
    if kind == 5:
        return [any_body(rng, depth - 1) for _ in range(rng.choice([0, 1, 3, 12]))]
    return {rng.choice(["a", "welch", "b:c", 'q"', "orders", "é", "x.y", "status"]): any_body(rng, depth - 1) for _ in range(rng.choice([0, 1, 3, 5]))}


def bodies():
    rng = random.Random(4)
    return {i: any_body(rng, 5) for i in range(60)} | {100: {}, 101: [], 102: 5, 103: {"welch": 1}, 104: {"a": {"orders": {"b": 1}}, "c": ["x.welch", "welch", "welch.x", [["y.orders"]]]}}


def cut(b, names):
    if isinstance(b, dict):
        return {k: cut(v, names) for k, v in b.items() if k not in names and not cited(v, names)}
    return [cut(v, names) for v in b if not cited(v, names)] if isinstance(b, list) else b


def cited(v, names):
    return isinstance(v, str) and v.rsplit(".", 1)[-1] in names


def quiet(b, kept, under=None):
    if isinstance(b, dict):
        return {k: quiet(v, kept, k) for k, v in b.items() if not isinstance(v, str) or k in kept}
    return [quiet(v, kept, under) for v in b if not isinstance(v, str) or under in kept] if isinstance(b, list) else b


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(i, json.dumps(b)) for i, b in bodies().items()] + [(200, None), (201, "{"), (202, '{"a":1,"a":2}')]
    return nodes(spark, spark.createDataFrame(rows, "id long, body string")).cache()


def same(df, want):
    got = {i: json.loads(b) for i, b in df.collect()}
    assert got == want, [(i, got.get(i), want[i]) for i in want if got.get(i) != want[i]][:2]


def test_round_trip(tree):
    same(assembled(tree), bodies())


def test_pruned(tree):
    names = ["welch", "orders"]
    left = {i: cut(b, names) for i, b in bodies().items() if not cited(b, names)}
    same(assembled(pruned(tree, names)), left)


def test_without_texts(tree):
    same(assembled(without_texts(tree, ["status", "é"])), {i: quiet(b, ["status", "é"]) for i, b in bodies().items() if not isinstance(b, str)})


def test_no_bodies(spark):
    none = nodes(spark, spark.createDataFrame([], "id long, body string"))
    assert none.collect() == [] and assembled(none).collect() == []
