"""Toxicity by weak supervision.

Voters are words of a lexicon and patterns (words and beginnings of words) found significantly more often in texts labelled toxic, or in texts labelled clean. A
generative label model, fitted by expectation maximisation to the votes, estimates each voter's accuracy, that is how often it fires on toxic and on clean texts, and
the correlations of voters within both classes: a voter's rates depend on one other voter, chosen as the forest of the highest conditional mutual
information. A linear classifier on counts of votes is then trained on the model's posterior labels, and scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, held_out, small_enough

#: Distinct labelled texts sampled for each label (about), by a hash of the id: the bound of the fit. Pattern voters for toxic and for clean texts at most; memo
#: entries of a worker.
FIT_ROWS, PATTERNS, CLEAN_PATTERNS, MEMO, THRESHOLD = 4000, 60, 20, 400_000, 0.3
#: Lengths of beginnings of words that may be patterns; the odds that a pattern has at least, so many standard errors below its own odds. Both hold for samples of any size.
STEMS, LEAST_ODDS, ERRORS = (4, 5, 6), 5.0, 2.0
#: Rounds of the label model, those after which its correlations are chosen anew, and the least conditional information of two voters over all texts, in nats.
ROUNDS, CHOSEN, LEAST_INFORMATION = 30, (4, 12), 8.0
#: Common English insults.
LEXICON = "bastard clown coward crap damn disgusting dumb filthy freak garbage hate hideous idiot imbecile jerk kill loser lunatic moron nasty pathetic pig rotten scum shut stupid sucks trash ugly useless vermin vile worthless".split()
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Voters:
    """Numbers of voters by whole word and by beginning of a word."""

    words: dict[str, int]
    stems: dict[str, int]
    clean: frozenset[int] = frozenset()
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def of(self, word: str) -> tuple[int, ...]:
        if (hit := self.memo.get(word)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            hit = tuple(x for x in [self.words.get(word), *(self.stems.get(word[:n]) for n in STEMS if len(word) > n)] if x is not None)
            self.memo[word] = hit
        return hit

    def votes(self, text: str | None) -> tuple[Counter, int]:
        """How often each voter fires in a whole text, and the text's number of words."""
        words = _WORD.findall(text.lower()) if text else []
        memo, of = self.memo, self.of
        out: Counter = Counter()
        for w in words:
            hit = memo.get(w)
            if hit is None:
                hit = of(w)
            if hit:
                out.update(hit)
        return out, len(words)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label with each word and each beginning of a word."""
    for batch in batches:
        rows: Counter = Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            rows.update((toxic, w, True) for w in words)
            rows.update((toxic, stem, False) for stem in {w[:n] for w in words for n in STEMS if len(w) > n})
        keys = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([rows[k] for k in keys], pa.int64())], ["toxic", "gram", "whole", "n"])


def find_voters(sample: DataFrame, sizes: dict[int, int]) -> Voters:
    """The lexicon, and the patterns of the sample (toxic, text) that speak most for either class; beginnings stand for their longer forms."""
    counts = sample.select("toxic", "text").mapInArrow(_candidates, "toxic int, gram string, whole boolean, n long")
    wide = counts.groupBy("gram", "whole").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    words, stems = {w: k for k, w in enumerate(LEXICON)}, {}
    clean: set[int] = set()
    for own, other, most in ((1, 0, PATTERNS), (0, 1, CLEAN_PATTERNS)):
        mine, theirs = F.col(f"n{own}") + 0.5, F.col(f"n{other}") + 0.5
        odds = F.log(mine / (sizes.get(own, 0) + 1) / (theirs / (sizes.get(other, 0) + 1)))
        sure = wide.withColumn("least", odds - ERRORS * F.sqrt(1 / mine + 1 / theirs)).filter(F.col("least") >= math.log(LEAST_ODDS)).withColumn("gain", F.col(f"n{own}") * odds)
        begin = len(words) + len(stems)
        for r in sure.orderBy(F.desc("gain"), "gram", "whole").limit(4 * most).select("gram", "whole").collect():
            if len(words) + len(stems) >= begin + most:
                break
            covered = any(r["gram"].startswith(s) or not r["whole"] and s.startswith(r["gram"]) for s in stems) or not r["whole"] and any(w.startswith(r["gram"]) for w in words)
            if not covered and r["gram"] not in words:
                if not own:
                    clean.add(len(words) + len(stems))
                (words if r["whole"] else stems)[r["gram"]] = len(words) + len(stems)
    return Voters(words, stems, frozenset(clean))


def correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """The voter that each voter's rates depend on, or -1: a forest of the pairs with the highest mutual information given the class."""
    n, m = votes.shape
    information = np.zeros((m, m))
    for w in (post, 1 - post):
        size = w.sum() + 1.0
        on = (w @ votes + 0.5) / size
        both = ((votes * w[:, None]).T @ votes + 0.25) / size
        for a in (0, 1):
            for b in (0, 1):
                p = both if a and b else on[:, None] - both if a else on[None, :] - both if b else 1 - on[:, None] - on[None, :] + both
                q = np.outer(on if a else 1 - on, on if b else 1 - on)
                p = np.clip(p, 1e-9, 1)
                information += size * p * np.log(p / np.clip(q, 1e-9, 1))
    np.fill_diagonal(information, -1)
    parent, seen = np.full(m, -1), np.zeros(m, dtype=bool)
    best, source = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        at = int(np.argmax(np.where(seen, -np.inf, best)))
        if seen[at] or best[at] < LEAST_INFORMATION:
            at = int(np.argmin(seen))
        else:
            parent[at] = source[at]
        seen[at] = True
        closer = ~seen & (information[at] > best)
        best[closer], source[closer] = information[at][closer], at
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray, prior: float, clean: frozenset[int]) -> np.ndarray:
    """Posterior toxicity of each row of votes (rows by voters, 0 or 1). The given label is one more voter, of an accuracy to be estimated like the others'.

    A voter that stays silent abstains; silence of all of them is evidence by itself. A voter fires on its own class at least as often as on the other, given the voter it depends on."""
    post = np.where(labels > 0, 0.9, 0.02)
    m = votes.shape[1]
    quiet = votes.sum(axis=1) == 0
    parent = np.full(m, -1)
    speaks_clean = np.isin(np.arange(m), list(clean))
    for turn in range(ROUNDS):
        if turn in CHOSEN:
            parent = correlations(votes, post)
        given = np.where(parent[None, :] >= 0, votes[:, parent], 0.0)
        log = np.full(len(votes), math.log(prior / (1 - prior)))
        rates = []
        for w, base in ((post, 0.5), (1 - post, 0.05)):
            whole = (w @ votes + base) / (w.sum() + 1.0)
            by_parent = []
            for value in (0.0, 1.0):
                here = (given == value) * w[:, None]
                # towards the voter's rate over the class, as if four texts had shown it
                by_parent.append(((here * votes).sum(axis=0) + 4 * whole) / (here.sum(axis=0) + 4))
            rates.append(np.array(by_parent))
        on, off = rates
        off = np.where(speaks_clean, off, np.minimum(off, on))
        on = np.where(speaks_clean, np.minimum(on, off), on)
        on, off = np.clip(on, 1e-6, 1 - 1e-6), np.clip(off, 1e-6, 1 - 1e-6)
        for value in (0, 1):
            log += ((given == value) * votes) @ np.log(on[value] / off[value])
        toxic, fine = post.sum() + 1.0, (1 - post).sum() + 1.0
        log += quiet * math.log((post[quiet].sum() + 0.5) / toxic / (((1 - post)[quiet].sum() + 0.5) / fine))
        said, unsaid = (post[labels > 0].sum() + 1) / (toxic + 1), ((1 - post)[labels > 0].sum() + 1) / (fine + 1)
        told = np.where(labels > 0, math.log(said / unsaid), math.log((1 - said) / (1 - unsaid)))
        log += np.clip(told, -2.5, 2.5)
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return post


def features(votes: Counter, words: int, width: int) -> np.ndarray:
    out = np.zeros(width + 4)
    for k, c in votes.items():
        out[k] = 1.0 + 0.5 * math.log(c)
    total = sum(votes.values())
    out[width] = math.log1p(total)
    out[width + 1] = math.log1p(100.0 * total / words) if words else 0.0
    out[width + 2] = 1.0 if total else 0.0
    out[width + 3] = 1.0
    return out


def train(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last column is the intercept, without penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """Voters and classifier weights from labelled rows that aren't held out. With no toxic row the lexicon alone votes."""
    cuts = Cuts(spark, "toxicity")
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # copies of a text count once: ids and hashes are shuffled, not texts
    told = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).join(known, "doc_id")
    merged = cuts.cut(told.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic"))
    whole = {r["toxic"]: r["count"] for r in merged.groupBy("toxic").count().collect()}
    share = {k: min(1.0, FIT_ROWS / n) for k, n in whole.items()}
    limit = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * 1_000_000
    chosen = merged.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < limit)
    # about FIT_ROWS ids a label, so they go to the texts
    chosen = F.broadcast(chosen) if small_enough(chosen, 4 * FIT_ROWS) else chosen
    sample = cuts.cut(docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    voters = find_voters(sample, sizes)
    width = len(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [voters.votes(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(v, n, width).tolist() for v, n in got], pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = sample.mapInArrow(vote, "doc_id long, toxic int, x array<double>").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    cuts.close()
    if not got or not any(r["toxic"] for r in got):
        w = np.zeros(width + 4)
        w[width + 1], w[width + 3] = 2.0, -3.0
        return voters, w
    x = np.array([r["x"] for r in got])
    # rows stand for as many as their label was thinned by
    thin = np.array([1 / share[r["toxic"]] for r in got])
    toxic = np.array([r["toxic"] for r in got], dtype=float)
    prior = float(np.clip((thin * toxic).sum() / thin.sum(), 0.01, 0.5))
    post = label_model((x[:, :width] > 0).astype(float), toxic, prior, voters.clean)
    return voters, train(x, post)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = shared.value
        width = len(voters)
        blank = float(w[width + 3])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                z = []
                for text in part.column(1).to_pylist():
                    votes, n = voters.votes(text)
                    z.append(float(features(votes, n, width) @ w) if votes else blank)
                score = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels is (doc_id, toxic).

    A text that is null, empty or fires no voter gets the classifier's base score. Null labels and labels other than 0 and 1 are
    ignored; of several labels of a document the highest counts. Repeated rows stay; a null doc_id has held_out null; other columns are ignored. Whole texts are read.
    """
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with docs' columns, whatever their names. Null and empty texts have the classifier's base score, which
    decides on them; repeated rows stay or go together; an empty table gives an empty result."""
    fitted = spark.sparkContext.broadcast(fit(spark, docs, labels))
    schema = docs.schema
    at = schema.names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = fitted.value
        width = len(voters)
        cut = math.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                votes, n = voters.votes(text)
                good.append(not (float(features(votes, n, width) @ w) if votes else float(w[width + 3])) >= cut)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, schema)
