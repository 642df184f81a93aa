"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word is scored by its character n-grams: the longest that is known at each
place, or else the next shorter, down to single characters. Frequencies come from a bounded sample of labelled rows, counted by Spark. Each is a share of its
language's total, mixed with a small share of the mean over languages, so a word that a language lacks never scores higher there than in one that has it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, held_out

#: Rows sampled for each language at most (about), and words and n-grams kept for each language; these bound the fit and what is broadcast. Of more than
#: LANGUAGES languages each keeps fewer, as the model has a score for each of its grams in each language; LEAST_KEPT at least.
FIT_ROWS, KEPT_WORDS, KEPT_GRAMS = 1000, 20_000, 10_000
LONGEST, MEMO, LANGUAGES, LEAST_KEPT = 4, 200_000, 64, 100
#: Share of the mean over languages in each frequency; words put together in one step of scoring.
SHARED, STEP = 0.02, 65_536
_WORD = re.compile(r"[^\W\d_]+")


def letters(word: str) -> str:
    """A run without what is no letter, such as the numbers that aren't digits."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in _WORD.findall(text.lower()))
        rows: Counter = Counter()
        for (lang, run), n in words.items():
            if not (word := letters(run)):
                continue
            rows[lang, 0, word] += n
            edged = f"^{word}$"
            for size in range(1, LONGEST + 1):
                for i in range(len(edged) - size + 1):
                    rows[lang, size, edged[i : i + size]] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in rows], pa.int64() if i == 1 else pa.string()) for i in range(3)] + [pa.array(list(rows.values()), pa.int64())], ["lang", "size", "gram", "n"])


class Model:
    """Log frequencies of words and n-grams by language; bounded, so it may be broadcast."""

    def __init__(self, languages: list[str], rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.languages, self.grams = languages, {}
        place = {x: i for i, x in enumerate(languages)}
        for lang, size, gram, n in rows:
            self.grams.setdefault((size, gram), np.zeros(len(languages)))[place[lang]] += n
        for (size, gram), v in self.grams.items():
            shares = v / np.array([max(1, totals.get((x, size), 1)) for x in languages], dtype=float)
            self.grams[size, gram] = np.log((1 - SHARED) * shares + SHARED * shares.mean())
        self.none = np.zeros(len(languages))

    def word(self, word: str) -> np.ndarray:
        """The scores of a word in each language."""
        if (known := self.grams.get((0, word))) is not None:
            return known
        edged = f"^{word}$"
        out, i = self.none, 0
        while i < len(edged):
            for size in range(min(LONGEST, len(edged) - i), 0, -1):
                if (known := self.grams.get((size, edged[i : i + size]))) is not None:
                    # an n-gram stands for its part of the word
                    out = out + known * size / (len(edged) * 1.0)
                    i += size
                    break
            else:
                i += 1
        return out


def fit(spark: SparkSession, docs: DataFrame) -> Model:
    """Learn every language from a sample of about FIT_ROWS rows each (doc_id, text, lang) by a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return Model([], [], {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, FIT_ROWS / r["count"]))])
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    grams = chosen.select("lang", "text").mapInArrow(_counts, "lang string, size long, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    cuts = Cuts(spark, "language")
    grams = cuts.cut(grams)
    totals = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    fewer = min(1.0, (LANGUAGES / len(sizes)) ** 2)
    words, ngrams = (max(LEAST_KEPT, int(n * fewer)) for n in (KEPT_WORDS, KEPT_GRAMS))
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram"))
    best = grams.filter("n > 1 or size > 0").withColumn("r", rank).filter(F.col("r") <= F.when(F.col("size") == 0, words).otherwise(ngrams))
    rows = [(r["lang"], r["size"], r["gram"], r["n"]) for r in best.select("lang", "size", "gram", "n").collect()]
    cuts.close()
    return Model(sorted(r["lang"] for r in sizes), rows, totals)


class _Memo(dict):
    """Places of words in a matrix of scores that doubles as it fills; place 0 is that of runs without letters."""

    def __init__(self, model: Model):
        self.model = model
        self.matrix, self.used = np.zeros((4096, len(model.languages))), 1

    def __missing__(self, run: str) -> int:
        word = letters(run)
        if not word:
            self[run] = 0
            return 0
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used] = self.model.word(word)
        self[run] = at = self.used
        self.used += 1
        return at


def predict(model: Model, memo: _Memo, text: str | None) -> tuple[str, float]:
    """(language, share of its likelihood) of a whole text; ties go to the first language in order."""
    places = [memo[w] for w in _WORD.findall(text.lower())] if text else []
    if not model.languages or not any(places):
        return "und", 0.0
    total = np.zeros(len(model.languages))
    for at in range(0, len(places), STEP):
        total += memo.matrix[places[at : at + STEP]].sum(axis=0)
    p = np.exp(total - total.max())
    best = int(np.argmax(p))
    return model.languages[best], float(p[best] / p.sum())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        memo = _Memo(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = []
                for text in part.column(1).to_pylist():
                    got.append(predict(model, memo, text))
                    if len(memo) > MEMO:
                        memo = _Memo(model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang).

    lang_pred is `und`, with score 0, where the text is null, empty or has no letter, or where no row is labelled. Every text is scored whole; ties go
    to the first language in order. Rows with a null doc_id are scored, with held_out null, and never learned from. Repeated rows stay; other columns are ignored.
    """
    model = fit(spark, docs)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
