"""Fill-in-the-middle transformation by lookaround splitting, with DataFrame functions only.

A grammar cuts a text into units, matched left to right. Each kind of grammar has a twin: a regex of zero width that matches between two units, by the
class of the character before and that of the character after. Spark's split at that regex keeps every character, so units put together give the text.
The empty text has no units, though split gives one empty piece; it is handled by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grammar:
    """units: what a unit is, as a regex of alternatives; boundary: the same cuts as a regex of zero width. Any text is a sequence of units."""

    units: str
    boundary: str


def _inside(cls: str) -> str:
    """A class such as `[a-z]`, or a single escape such as `\\s`, without its brackets."""
    return cls[1:-1] if cls.startswith("[") else cls


def terminated(end: str) -> Grammar:
    """Units end with a character of a class: `[^E]*E|[^E]+`. One ends wherever such a character is followed by any."""
    return Grammar(f"[^{_inside(end)}]*{end}|[^{_inside(end)}]+", f"(?<={end})(?=[\\s\\S])")


def followed(body: str) -> Grammar:
    """Units are a run of a class with what follows it: `B+[^B]*|[^B]+`. One begins wherever a character of the class comes after another one."""
    return Grammar(f"{body}+[^{_inside(body)}]*|[^{_inside(body)}]+", f"(?<=[^{_inside(body)}])(?={body})")


def runs(*classes: str) -> Grammar:
    """Units are longest runs of one of the disjoint classes, or of characters of none: `A+|B+|[^AB]+`. One ends wherever the class changes."""
    rest = f"[^{''.join(_inside(c) for c in classes)}]"
    every = [*classes, rest]
    return Grammar("|".join(f"{c}+" for c in every), "|".join(f"(?<={a})(?={b})" for a, b in permutations(every, 2)))


def single() -> Grammar:
    """Units are single code points. Between the halves of a surrogate pair, as Java stores code points beyond 2^16, lies no boundary."""
    return Grammar("[\\s\\S]", "(?<=[\\s\\S])(?=[\\s\\S])(?<![\\uD800-\\uDBFF])")


LINES, WORDS, RUNS, CHARACTERS = terminated("[\\n]"), followed("\\S"), runs("\\p{L}", "\\p{N}", "\\s"), single()


@dataclass(frozen=True)
class Marks:
    """The texts that mark where prefix, suffix and middle begin."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        every = (self.prefix, self.suffix, self.middle)
        if not all(every):
            raise ValueError("marks aren't empty")
        # else a mark could arise where a part and a mark meet, and the text couldn't be rebuilt
        if any(a.endswith(b[:k]) for a in every for b in every for k in range(1, len(b))) or any(a in b for a, b in permutations(every, 2)):
            raise ValueError("no mark may end as one begins, or lie in another one")

    @property
    def any_of(self) -> str:
        return "|".join(f"\\Q{m}\\E" for m in (self.prefix, self.suffix, self.middle))


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text; none of the empty text, null of null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def _digits(seed: int, doc_id: Column) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of the SHA-256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _joined(pieces: Column, start: Column, end: Column) -> Column:
    """Pieces start + 1 to end as one text."""
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def rebuilt(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, marks.any_of, -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return F.when(form == "plain", output).otherwise(F.when(form == "psm", F.concat(*[F.get(parts, F.lit(i)) for i in at["psm"]])).otherwise(F.concat(*[F.get(parts, F.lit(i)) for i in at["spm"]])))


def fill_middle(docs: DataFrame, grammar: Grammar = LINES, seed: int = 7, rate: int = 100, suffix_first: int = 50, marks: Marks = Marks()) -> DataFrame:
    """(doc_id, n, form, output, prefix, suffix, middle) for every row of docs (doc_id, text); all other columns are ignored, whatever their names.

    Of n units the prefix takes those before the smaller of two numbers drawn from seed and doc_id, the middle those up to the larger one, the suffix the rest.
    rate percent of texts are transformed, suffix_first percent of these to the form spm, the others to psm. A null text is an empty one. Plain stay empty texts and
    those that hold a mark, and rows with a null doc_id, which draw nothing; their parts are null. Repeated rows give repeated results. A text is cut in its own row, so nothing is
    shuffled. An empty table gives an empty result.
    """
    # each step reads what the one before has computed, so nothing is computed twice
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    drawn = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("units"), F.array(*_digits(seed, F.col("doc_id"))).alias("h"))
    n = F.size("units").cast("long")
    cuts = [F.get("h", F.lit(k)) % (n + 1) for k in (0, 1)]
    plain = (F.col("text") == "") | F.col("doc_id").isNull() | F.col("text").rlike(marks.any_of) | (F.get("h", F.lit(2)) % 100 >= rate)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < suffix_first, "spm").otherwise("psm")
    placed = drawn.select("doc_id", "text", "units", n.alias("n"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"), form.alias("form"))
    moved = F.col("form") != "plain"
    parts = placed.select(
        "doc_id", "n", "form", F.when(~moved, F.col("text")).alias("whole"),
        *[F.when(moved, _joined(F.col("units"), s, e)).alias(name) for name, s, e in (("prefix", F.lit(0), F.col("a")), ("middle", F.col("a"), F.col("b")), ("suffix", F.col("b"), F.col("n").cast("int")))],
    )
    p, s, m = (F.concat(F.lit(mark), F.col(part)) for mark, part in ((marks.prefix, "prefix"), (marks.suffix, "suffix"), (marks.middle, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("whole"))
    return parts.select("doc_id", "n", "form", output.alias("output"), "prefix", "suffix", "middle")


def digests(transformed: DataFrame, marks: Marks = Marks()) -> DataFrame:
    """What fill_middle gives as sizes and digests, the text rebuilt from output and form among them."""
    back = transformed.select("doc_id", "n", "form", "output", *[F.length(part).cast("long").alias(f"{part}_chars") for part in ("prefix", "middle")], rebuilt(F.col("output"), F.col("form"), marks).alias("restored"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
