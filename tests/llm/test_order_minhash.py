"""Order MinHash fingerprints against plain selections, whole edit reports against plain order."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.llm import order_minhash
from cadenza.llm.order_minhash import K, M, PIECE, TUPLE, edit_report, edited_and_next, least_at, likeness, with_fingerprint

SCHEMA = "doc_id long, text string, fingerprint string, next string, range int, guest boolean, tie long"
BLANK = r"[^ \t\n\x0b\f\r]"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "f", "n", 1, True, 2) for i, t in rows], SCHEMA).repartition(3)


def kmers(text):
    """Numbered k-mers in the order of the text."""
    p = re.findall(BLANK + "{1,4}", text)
    grams = [tuple(p[i : i + K]) for i in range(max(1, len(p) - K + 1))] if p else []
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def tuples(spark, texts):
    """The tuples that each entry should stand for, from hashes that Spark takes of each numbered k-mer by itself."""
    every = sorted({x for t in texts for x in kmers(t)})
    df = spark.createDataFrame([(n, list(g), i) for n, (g, i) in enumerate(every)], "n int, g array<string>, i int")
    high = lambda c: c.bitwiseAND(F.lit(-(1 << 31)).cast("long"))
    gram = high(F.when(F.size("g") > 1, F.xxhash64(F.col("g")[0], F.get("g", F.lit(1)))).otherwise(F.xxhash64(F.col("g")[0])))
    hashes = {every[r[0]]: r[1] for r in df.select("n", F.when(F.col("i") == 0, gram).otherwise(high(F.xxhash64(gram, "i")))).collect()}
    out = []
    for t in texts:
        own = kmers(t)
        entries = []
        for p in range(M):
            start = -(1 << 63) + (2 * p + 1) * (1 << 63) // M
            first = sorted(range(len(own)), key=lambda j: ((hashes[own[j]] - start) % (1 << 64), j))[:TUPLE]
            entries.append(tuple(own[j] for j in sorted(first)))
        out.append(entries)
    return out


def test_entries_are_plain_selections(spark):
    """Entries of any two texts are equal exactly where the plainly selected tuples are."""
    rng = random.Random(3)
    words = ["ab", "abc", "abcdefg", "é☃", "x", "yy", "zzz1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40]))) for _ in range(40)] + ["", " \n", "a", "a a", "a a a", "b a a", "x " * 3000, "😀" * 10]
    got = {r[0]: r[2] for r in with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f").collect()}
    want = tuples(spark, texts)
    for a in range(len(texts)):
        for b in range(a, len(texts)):
            assert [x == y for x, y in zip(got[a], got[b])] == [x == y for x, y in zip(want[a], want[b])], (texts[a][:60], texts[b][:60])


def test_order_matters(spark):
    """Passages in another order have the same k-mers, but for those where they meet, and another fingerprint."""
    rng = random.Random(8)
    p = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(8)]
    df = spark.createDataFrame([(" ".join(p), " ".join(reversed(p)))], "a string, b string")
    near = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb").select(likeness(F.col("fa"), F.col("fb"))).first()[0]
    assert near < 0.75


def test_least_at(spark):
    values = [-5, 0, 0, 7, 7, 7, 100]
    df = spark.createDataFrame([(v, values[:n]) for v in range(-7, 103) for n in range(len(values) + 1)], "v long, a array<long>")
    for v, a, at in df.select("v", "a", least_at(F.col("a"), F.col("v"))).collect():
        assert at == sum(x < v for x in a)


def rows():
    rng = random.Random(21)
    words = ["one", "two", "Three", "élan", "😀", "x\ny"]
    out = [(i * 7 % 501 - 40, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(500)]
    return out + [(1000, None), (1001, ""), (1002, "a"), (1003, " \n"), (1004, "long word " * 30_000), (1005, "twice"), (1005, "twice"), (1005, "other")]


@pytest.mark.parametrize("of", [10**9, 7, 1])
def test_report_is_plain(spark, monkeypatch, of):
    """The order and the edited texts, whatever the ranges."""
    monkeypatch.setattr(order_minhash, "RANGE", of)
    monkeypatch.setattr(order_minhash, "PER_PARTITION", 0)
    some = rows()
    ties = dict(spark.createDataFrame([(t or "",) for _, t in some], "t string").distinct().select("t", F.xxhash64("t")).collect())
    order = sorted(((i, t or "") for i, t in some), key=lambda r: (-r[0], ties[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = edit_report(spark, table(spark, [*some, (None, "no id"), (None, None)])).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted(want)
    lost = sorted((r for r in got if r.doc_id is None), key=lambda r: r.n_chars)
    assert [(r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in lost] == [(0, None, None, None), (5, None, None, None)] and all(len(r.fingerprint) == 8 * M for r in lost)
    for r in got:
        if r.doc_id is not None:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            share = sum(r.fingerprint[j : j + 8] == r.edited_fingerprint[j : j + 8] for j in range(0, 8 * M, 8)) / M
            assert r.near_edited == pytest.approx(share)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1002].near_edited == 1 and by_id[1001].near_edited == 1 and by_id[1001].fingerprint == by_id[1000].fingerprint == by_id[1003].fingerprint
    assert any(r.doc_id == 1005 and r.near_next == 1 for r in got)


def test_equal_texts_have_equal_fingerprints_and_next_is_its_own(spark):
    got = edited_and_next(spark, table(spark, rows())).collect()
    texts = {i: t or "" for i, t in rows() if i != 1005}
    prints = {}
    for r in got:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    order = sorted({r.doc_id for r in got if r.doc_id < 1005}, reverse=True)
    own = {r.doc_id: r.fingerprint for r in got}
    after = {r.doc_id: r.next_fingerprint for r in got}
    assert all(after[a] == own[b] for a, b in zip(order, order[1:]))


def test_one_row_and_none(spark):
    assert edit_report(spark, table(spark, [])).collect() == []
    r = edit_report(spark, table(spark, [(5, "abc def ghi")])).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def test_piece_is_what_the_tests_take(spark):
    assert PIECE == r"[^\s]{1,4}"
