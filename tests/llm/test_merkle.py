"""The Merkle manifest against a plain one."""

import hashlib
import zlib

import pytest

from cadenza.llm import merkle, places
from cadenza.llm.common import Cuts
from cadenza.llm.merkle import tamper_check
from cadenza.llm.places import numbered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, digest string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    i, source, lang, n, text = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climb(nodes, at):
    """The root, and for each level the siblings left and right of node `at`."""
    sides = []
    while len(nodes) > 1:
        g = at // 8 * 8
        sides.append((nodes[g:at], nodes[at + 1 : g + 8]))
        nodes, at = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], at // 8
    return nodes[0], sides


def plainly(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    sub = [climb([leaf(r) for r in groups[g]], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            root, above = climb(sub, k)
            _, below = climb([leaf(x) for x in groups[g]], at)
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in below + above:
                now = sha(*left, now, *right)
            out.append((r[0], leaf(r), sub[k], root, sha(*[x for left, right in below + above for x in left + right]), now, now == root))
    return sorted(out, key=str)


def rows():
    out = [(i, f"s{i % 3}", "en", 5, f"Text {i}\n") for i in range(1, 300)]
    out += [(i, None, "de", None, "ä ☃ 😀") for i in range(1000, 1065)]
    out += [(2000, "s", "", 1, "a"), (2001, "s", None, 1, "B"), (2002, "s", None, 1, None), (None, None, None, None, None), (None, "x", "fr", 2, "Y")]
    out += [(3000, "s", "es", 3, "Tie"), (3000, "s", "es", 3, "Tie"), (3000, "s", "es", 3, "tie"), (3001, "s", "Z" * 50, 3, "long " * 50_000)]
    return out + [(4000 + i, "s", f"l{i}", 1, "A") for i in range(20)]


def table(spark, found):
    return spark.createDataFrame([(*r, "t", 1, "d") for r in found], SCHEMA).repartition(5)


@pytest.mark.parametrize("nodes", [merkle.BROADCAST_NODES, 30, 0])
def test_manifest_is_plain(spark, monkeypatch, nodes):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", nodes)
    monkeypatch.setattr(places, "BROADCAST_BLOCKS", 0 if nodes == 0 else 100_000)
    got = tamper_check(spark, table(spark, rows()))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == plainly(rows())
    assert 0 < sum(not r[-1] for r in found) < len(found) / 2


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_sizes(spark, n):
    some = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert sorted(map(tuple, tamper_check(spark, table(spark, some)).collect()), key=str) == (plainly(some) if n else [])


def test_places_of_a_hot_group(spark):
    some = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1000) for i in range(1000)]
    df = spark.createDataFrame(some, "g string, k long").repartition(9)
    got = numbered(Cuts(spark, "places"), df, "g", ["k"]).collect()
    for g in {x for x, _ in some}:
        want = sorted(k for x, k in some if x == g)
        assert [(r.idx, r.n, r.k) for r in sorted(got, key=lambda r: r.idx) if r.g == g] == [(i, len(want), k) for i, k in enumerate(want)]
