"""Fill-in-the-middle against plain regex matching."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm.fill_middle import CHARACTERS, LINES, RUNS, WORDS, Marks, digests, fill_middle, units

SCHEMA = "doc_id long, text string, units string, h long, n long, form string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def texts():
    rng = random.Random(11)
    alphabet = ["a", "Z", "é", "\n", "\n", " ", "\t", "7", "😀", "́", "中", ".", "\r", " ", "<", ">", "P"]
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [*found, "", "\n", "\n\n", "one", "one\n", "\none", "a<P>b\nc", "x\n<S>", "<M>", "<\n<S\n>\n", "long line " * 20_000, "short\n" * 50_000]


@pytest.mark.parametrize("grammar,pattern", [(LINES, r"[^\n]*\n|[^\n]+"), (WORDS, r"\S+\s*|\s+"), (CHARACTERS, r"(?s:.)")])
def test_split_is_matching(spark, grammar, pattern):
    # blanks as Java's regexes know them
    pattern = pattern.replace(r"\S", r"[^ \t\n\x0b\f\r]").replace(r"\s+", r"[ \t\n\x0b\f\r]+").replace(r"\s*", r"[ \t\n\x0b\f\r]*")
    rows = list(enumerate(texts()))
    got = {r[0]: r[1] for r in table(spark, rows).select("doc_id", units(F.col("text"), grammar).alias("u")).collect()}
    for i, t in rows:
        assert got[i] == re.findall(pattern, t), (i, t[:80])


def test_runs_change_class(spark):
    row = table(spark, [(1, "ab12  cd, e😀")]).select(units(F.col("text"), RUNS).alias("u")).first()
    assert row.u == ["ab", "12", "  ", "cd", ",", " ", "e", "😀"]


def plainly(i, text, rate=100, first=50):
    text = text or ""
    found = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(found)
    digest = hashlib.sha256(f"7:{i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, n, "plain", None, None, sha(text), sha(text))
    spm = h[3] % 100 < first
    return (i, n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text))


@pytest.mark.parametrize("rate,first", [(100, 50), (40, 0), (100, 100)])
def test_fill_middle_is_brute_force(spark, rate, first):
    rows = [*enumerate(texts(), -5), (10_000, None), (10_001, "twice\nx"), (10_001, "twice\nx"), (2**40, "far\noff")]
    got = digests(fill_middle(table(spark, rows), rate=rate, suffix_first=first)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plainly(i, t, rate, first)) for i, t in rows)


def test_rows_without_id_stay_plain(spark):
    r = fill_middle(table(spark, [(None, "a\nb\n"), (None, None)])).orderBy("n").collect()
    assert [(x.n, x.form, x.output, x.prefix) for x in r] == [(0, "plain", "", None), (2, "plain", "a\nb\n", None)]


def test_empty_table(spark):
    assert digests(fill_middle(table(spark, []))).collect() == []


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P", "P>", "<M>"), ("x<", "<S>", "<M>")])
def test_marks_that_could_arise_are_refused(marks):
    with pytest.raises(ValueError):
        Marks(*marks)
