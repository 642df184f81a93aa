"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model's normaliser, pieces and byte fallback are compiled once. A text is composed with them piece of text by piece of text: an arc leads from one
place to another for each piece that lies between, or for the bytes of a character that no piece holds. For a unigram model an arc weighs
the piece's negative score. For a byte-pair model the states also hold the last piece, and an arc weighs nothing if merging leaves the
two pieces as they are, else infinity: exactly one path is finite, and it is the model's own encoding. The tropical shortest path is the encoding.
Words are independent where no piece crosses their border, and recent words' paths are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose paths a worker keeps in each of two turns, parts of words, and verdicts on pairs of pieces; these bound its memory.
MEMO, PARTS, PAIRS = 350_000, 150_000, 300_000
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4


@dataclass
class Transducer:
    """A compiled model: plain tables, small enough to broadcast (a vocabulary is bounded by its file)."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str]
    bytes_: dict[int, int]
    byte_of: dict[int, int]
    unknown: int
    unigram: bool
    prefix: bool
    squeeze: bool
    longest: int
    split: bool

    def __post_init__(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.joined = frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))
        # pieces that the model can arrive at
        self.whole = frozenset(self.ids) if self.unigram else frozenset(p for p in self.ids if len(self._merged(p)) == 1)

    @staticmethod
    def load(path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind, norm = model.trainer_spec.model_type, model.normalizer_spec
        if kind not in (1, 2) or norm.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and byte-pair models with the identity normaliser are compiled")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces aren't compiled")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        fallback = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        texts = [p.piece if p.type == NORMAL else " ⁇ " if p.type == UNKNOWN else "" for p in model.pieces]
        return Transducer(
            normal, {p.piece: p.score for p in model.pieces if p.type == NORMAL}, texts, fallback, {i: b for b, i in fallback.items()}, next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN),
            kind == 1, norm.add_dummy_prefix, norm.remove_extra_whitespaces, max(map(len, normal)), not any(SPACE in p.lstrip(SPACE) for p in normal),
        )

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def _fallback(self, char: str) -> tuple[int, ...]:
        if not self.bytes_:
            return (self.unknown,)
        return tuple(self.bytes_[b] for b in char.encode())

    def _merged(self, text: str) -> list[str]:
        """What the byte-pair model makes of a short text: the best-scored neighbours merge first, the left ones among equals."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                if (s := scores.get(parts[i] + parts[i + 1], -math.inf)) > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, left: str, right: str) -> bool:
        """Whether the arc from one piece to the next is finite."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self._merged(left + right) == [left, right]
            self.pairs[left, right] = known
        return known

    def _arcs(self, word: str, at: int) -> list[str]:
        """Labels of the arcs that leave a place, longest first; one character at least, in the vocabulary or not."""
        ids = self.ids
        out = [p for n in range(min(self.longest, len(word) - at), 1, -1) if (p := word[at : at + n]) in ids]
        out.append(word[at])
        return out

    def _path_merges(self, word: str) -> list[str]:
        """The one finite path, found depth first by longest arcs; a state (place, last piece) that leads nowhere is tried once."""
        n, longest, whole, pairs = len(word), self.longest, self.whole, self.pairs
        path: list[str] = []
        dead: set[tuple[int, str]] = set()
        at, last, size = 0, "", min(longest, n)
        while at < n:
            piece = ""
            while size:
                piece = word[at : at + size]
                if size == 1 or piece in whole:
                    fits = True if not last else pairs.get((last, piece))
                    if fits is None:
                        fits = self._stays(last, piece)
                    if fits and not (dead and (at + size, piece) in dead):
                        break
                size -= 1
            if size:
                path.append(piece)
                at += size
                last, size = piece, min(longest, n - at)
            else:
                piece = path.pop()
                dead.add((at, piece))
                at -= len(piece)
                last, size = (path[-1] if path else ""), len(piece) - 1
        return path

    def _path_scores(self, word: str) -> list[str]:
        """The shortest path by negative scores; an unknown character weighs ten more than the worst piece."""
        worst = 10.0 - min(self.scores.values())
        best = [0.0] + [math.inf] * len(word)
        back = [""] * (len(word) + 1)
        for at in range(len(word)):
            for piece in self._arcs(word, at):
                weight = best[at] - self.scores[piece] if piece in self.scores else best[at] + worst
                if weight < best[at + len(piece)]:
                    best[at + len(piece)], back[at + len(piece)] = weight, piece
        out, at = [], len(word)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word: it falls apart where two neighbours stand together in no piece, as no path's arc crosses there."""
        joined, memo, out, start = self.joined, self.parts, [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in joined:
                part = word[start:i]
                start = i
                hit = memo.get(part)
                if hit is None:
                    path = self._path_scores(part) if self.unigram else self._path_merges(part)
                    ids = self.ids
                    hit = tuple(x for p in path for x in ((ids[p],) if p in ids else self._fallback(p)))
                    if len(part) <= 32:
                        if len(memo) > PARTS:
                            memo.clear()
                        memo[part] = hit
                out += hit
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null or empty."""
        whole = self.normalise(text) if text else ""
        if not whole:
            return []
        if not self.split:
            return list(self._word(whole))
        # a word is a run of spaces with what follows up to the next run; most follow one space, which their key leaves out
        out: list[int] = []
        memo, lead = self.words, 0
        for part in whole.split(SPACE):
            if not part:
                lead += 1
                continue
            if lead == 1:
                hit = memo.get(part)
                if hit is None:
                    hit = self.older.get(part) or self._word(SPACE + part)
                    if len(part) <= 32:
                        if len(memo) > MEMO:
                            # words used since the last change stay for another turn
                            self.older, self.words = memo, (memo := {})
                        memo[part] = hit
            else:
                hit = self._word(SPACE * lead + part)
            out += hit
            lead = 1
        if lead > 1:
            out += self._word(SPACE * (lead - 1))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        if not self.byte_of.keys().isdisjoint(ids):
            out, run = [], bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.texts[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(self.texts.__getitem__, ids))
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Transducer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, same = [], []
                for text in part.column(1).to_pylist():
                    got = model.encode(text)
                    ids.append(got)
                    # a text with the model's own space sign decodes to a blank there
                    same.append(None if text is None else model.decode(got) == text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row of docs (doc_id, text).

    A null or empty text has no ids; round_trip says whether decoding gives the text back, null for null. It is false for texts that hold the space sign itself. Whole texts are encoded,
    however long; repeated rows stay; other columns are ignored. The driver reads the model's file and broadcasts its tables.
    """
    shared = spark.sparkContext.broadcast(Transducer.load(model_path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(shared), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode_documents(spark: SparkSession, encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids); null ids give a null text."""
    shared = spark.sparkContext.broadcast(Transducer.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Transducer = shared.value
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
