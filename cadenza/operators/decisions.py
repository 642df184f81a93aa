"""Validators of decisions in JSON, by the types and values that a body really has. Each gives the first rule that is broken, or `valid`.

Bodies are parsed to VARIANT, which refuses text that isn't JSON and objects that name a key twice, and whose values keep their types: a number isn't taken for a text, nor a text for a truth value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Observations of a teacher's answer at most, and characters of one; candidates of a decision at most.
OBSERVATIONS, CHARACTERS, CANDIDATES = 64, 8192, 2


def part(v: Column, path: str) -> Column:
    """What lies at a path, as VARIANT; null where nothing does."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL(p,s), DOUBLE, VOID, ARRAY<...> or OBJECT<...>; `NONE` where there is nothing."""
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def is_text(v: Column) -> Column:
    """Whether it is a text with more than blanks in it."""
    return (kind(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(r"\S")


def text(v: Column) -> Column:
    """A text; null of what is none."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def items(v: Column) -> Column:
    """The items of an array, as VARIANT; null of what is none."""
    return F.when(F.startswith(kind(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))


def has_keys(v: Column, keys: tuple[str, ...]) -> Column:
    """Whether it is an object of exactly these keys."""
    found = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.startswith(kind(v), F.lit("OBJECT")) & (F.size(found) == len(keys)) & (F.size(F.array_except(found, F.array(*map(F.lit, keys)))) == 0), F.lit(False))


def texts_only(v: Column) -> Column:
    """Whether it is an array of texts, which may be empty."""
    return F.coalesce(F.forall(items(v), is_text), F.lit(False))


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def whole_report(x: DataFrame) -> DataFrame:
    """(id, verdict) of x (id, body, references, query): a comparison with each of several known conditions, references being a map of condition to the ids of its evidence and query those of the query's.

    `json`; `keys`; `outcome` (similar or different); `explanation`; `comparisons`, one for each condition; then of each: `comparison` (its keys, a truth value, three lists of texts), `condition` (unknown or repeated), `fabricated`
    (cites what is neither its condition's nor the query's), `one_sided` (doesn't cite both); then `conclusion`: similar names a condition judged similar, different names none and none is.
    """
    v = F.try_parse_json("body")
    x = x.select("id", "references", "query", v.alias("v")).select("id", "references", "query", "v", items(part(F.col("v"), "$.comparisons")).alias("c"))
    named = F.transform("c", lambda c: text(part(c, "$.condition_id")))
    cited = lambda c: F.transform(items(part(c, "$.evidence_ids")), text)
    own = lambda c: F.element_at(F.col("references"), text(part(c, "$.condition_id")))
    both = lambda c: F.array_union(own(c), F.col("query"))
    sides = lambda c: F.arrays_overlap(cited(c), F.array_except(own(c), "query")) & F.arrays_overlap(cited(c), F.array_except("query", own(c)))
    alike = F.transform(F.filter("c", lambda c: F.try_variant_get(c, "$.similar", "boolean")), lambda c: text(part(c, "$.condition_id")))
    shape = lambda c: has_keys(c, ("condition_id", "similar", "similarities", "differences", "evidence_ids")) & (kind(part(c, "$.similar")) == "BOOLEAN") & texts_only(part(c, "$.similarities")) & texts_only(part(c, "$.differences")) & texts_only(part(c, "$.evidence_ids"))
    outcome, chosen = text(part(F.col("v"), "$.outcome")), part(F.col("v"), "$.condition_id")
    rules = [
        ("json", F.col("v").isNotNull()), ("keys", has_keys(F.col("v"), ("outcome", "condition_id", "comparisons", "explanation"))), ("outcome", outcome.isin("similar", "different")), ("explanation", is_text(part(F.col("v"), "$.explanation"))),
        ("comparisons", F.size("c") == F.size("references")), ("comparison", F.forall("c", shape)),
        ("condition", F.forall(named, lambda n: F.coalesce(F.map_contains_key("references", n), F.lit(False))) & (F.size(F.array_distinct(named)) == F.size(named))),
        ("fabricated", F.forall("c", lambda c: F.size(F.array_except(cited(c), both(c))) == 0)), ("one_sided", F.forall("c", sides)),
        ("conclusion", F.when(outcome == "similar", F.array_contains(alike, text(chosen))).otherwise((kind(chosen) == "VOID") & (F.size(alike) == 0))),
    ]
    return x.select("id", _first_broken(rules))


def _first_broken(rules: list[tuple[str, Column]]) -> Column:
    out = None
    for name, rule in rules:
        out = F.when(~_holds(rule), name) if out is None else out.when(~_holds(rule), name)
    return out.otherwise("valid").alias("verdict")


def memory_decision(x: DataFrame, classes: list[str]) -> DataFrame:
    """(id, verdict) of x (id, body, evidence, query): accept a class or ask for review, citing cards; evidence are the ids that may be cited, query the one that must be.

    `json`; `keys`; `decision`; `candidates` (two known classes at most, not the same twice); `condition` (accept names a class, one of the candidates if there are any; review names none); `citations` (some, all allowed, the
    query's and a card among them, and the accepted class's card); `explanation`.
    """
    v, known = F.col("v"), F.array(*map(F.lit, classes))
    x = x.select("id", "evidence", "query", F.try_parse_json("body").alias("v"))
    decision, condition, candidates = text(part(v, "$.decision")), part(v, "$.condition_id"), F.transform(items(part(v, "$.candidates")), text)
    cited = F.transform(items(part(v, "$.evidence")), text)
    accept = F.array_contains(known, text(condition)) & ((F.size(candidates) == 0) | F.array_contains(candidates, text(condition)))
    card = F.when(decision == "accept", F.array_contains(cited, F.concat(text(condition), F.lit(".CARD")))).otherwise(True)
    rules = [
        ("json", v.isNotNull()), ("keys", has_keys(v, ("decision", "condition_id", "candidates", "evidence", "explanation"))), ("decision", decision.isin("accept", "review")),
        ("candidates", (F.size(candidates) <= CANDIDATES) & (F.size(F.array_except(candidates, known)) == 0) & (F.size(F.array_distinct(candidates)) == F.size(candidates))),
        ("condition", F.when(decision == "accept", accept).otherwise(kind(condition) == "VOID")),
        ("citations", (F.size(cited) > 0) & (F.size(F.array_except(cited, "evidence")) == 0) & F.array_contains(cited, F.col("query")) & F.exists(cited, lambda c: F.endswith(c, F.lit(".CARD"))) & card),
        ("explanation", is_text(part(v, "$.explanation"))),
    ]
    return x.select("id", _first_broken(rules))


def teacher_answer(x: DataFrame) -> DataFrame:
    """(id, verdict) of x (id, body): a label, a score and what was observed.

    `json`, keys that stand twice among it; `keys`; `label` (a text, or null to abstain); `score` (a number from 0 to 1, or null where the label is); `observations` (at most 64 texts of at most 8192 characters).
    """
    v = F.col("v")
    x = x.select("id", F.try_parse_json("body").alias("v"))
    label, score, seen = part(v, "$.label"), part(v, "$.score"), part(v, "$.observations")
    number = kind(score).rlike(r"^(BIGINT|DOUBLE|DECIMAL)") & F.try_variant_get(score, "$", "double").between(0, 1)
    rules = [
        ("json", v.isNotNull()), ("keys", has_keys(v, ("label", "score", "observations"))), ("label", is_text(label) | (kind(label) == "VOID")), ("score", F.when(kind(label) == "VOID", kind(score) == "VOID").otherwise(number)),
        ("observations", texts_only(seen) & (F.size(items(seen)) <= OBSERVATIONS) & F.forall(items(seen), lambda o: F.length(text(o)) <= CHARACTERS)),
    ]
    return x.select("id", _first_broken(rules))


def visual_decision(x: DataFrame) -> DataFrame:
    """(id, verdict) of x (id, body, conditions): `json`; `keys` (outcome, condition_id, explanation); `outcome` (known, outside_reference or indeterminate); `condition` (one of the conditions if known, else null); `explanation`."""
    v = F.col("v")
    x = x.select("id", "conditions", F.try_parse_json("body").alias("v"))
    outcome, chosen = text(part(v, "$.outcome")), part(v, "$.condition_id")
    rules = [
        ("json", v.isNotNull()), ("keys", has_keys(v, ("outcome", "condition_id", "explanation"))), ("outcome", outcome.isin("known", "outside_reference", "indeterminate")),
        ("condition", F.when(outcome == "known", F.array_contains("conditions", text(chosen))).otherwise(kind(chosen) == "VOID")), ("explanation", is_text(part(v, "$.explanation"))),
    ]
    return x.select("id", _first_broken(rules))


def diagram_audit(x: DataFrame, most: int = 5) -> DataFrame:
    """(id, verdict) of x (id, body, figures), figures being a map of each available view to its figure: which views tell most, the first one first.

    `json`; `keys` (views); `count` (one to `most`); `entry` (keys view, figure and finding, texts all); `unavailable` (a view without a figure); `repeated`; `figure` (not the view's own)."""
    v = F.col("v")
    x = x.select("id", "figures", F.try_parse_json("body").alias("v")).select("id", "figures", "v", items(part(v, "$.views")).alias("e"))
    view = lambda e: text(part(e, "$.view"))
    named = F.transform("e", view)
    rules = [
        ("json", v.isNotNull()), ("keys", has_keys(v, ("views",))), ("count", F.size("e").between(1, most)),
        ("entry", F.forall("e", lambda e: has_keys(e, ("view", "figure", "finding")) & is_text(part(e, "$.view")) & is_text(part(e, "$.figure")) & is_text(part(e, "$.finding")))),
        ("unavailable", F.forall(named, lambda n: F.map_contains_key("figures", n))), ("repeated", F.size(F.array_distinct(named)) == F.size(named)),
        ("figure", F.forall("e", lambda e: text(part(e, "$.figure")) == F.element_at(F.col("figures"), view(e)))),
    ]
    return x.select("id", _first_broken(rules))


def outcome_category(truth: Column, said: Column, undecided: Column) -> Column:
    """What an answer is worth: truth and said are classes, null for one outside of those known."""
    return (
        F.when(undecided, "undecided").when(truth.isNotNull() & said.isNotNull(), F.when(truth == said, "correct").otherwise("wrong"))
        .when(truth.isNotNull(), "rejected_known").when(said.isNotNull(), "accepted_unknown").otherwise("correct_rejection")
    )


def report_schema(conditions: Column, name: str = "report_similarity") -> Column:
    """The JSON schema that asks for a body as `whole_report` takes it, of an array of conditions: what may be chosen are these, or nothing."""
    text_ = F.struct(F.lit("string").alias("type"))
    texts = F.struct(F.lit("array").alias("type"), text_.alias("items"))
    one_of = F.struct(F.lit("string").alias("type"), conditions.alias("enum"))

    def shape(**parts: Column) -> Column:
        return F.struct(F.lit("object").alias("type"), F.lit(False).alias("additionalProperties"), F.array(*map(F.lit, parts)).alias("required"), F.struct(*[c.alias(k) for k, c in parts.items()]).alias("properties"))

    comparison = shape(condition_id=one_of, similar=F.struct(F.lit("boolean").alias("type")), similarities=texts, differences=texts, evidence_ids=texts)
    chosen = F.struct(F.array(F.lit("string"), F.lit("null")).alias("type"), F.array_append(conditions, F.lit(None)).alias("enum"))
    outcome = F.struct(F.lit("string").alias("type"), F.array(F.lit("similar"), F.lit("different")).alias("enum"))
    body = shape(outcome=outcome, condition_id=chosen, comparisons=F.struct(F.lit("array").alias("type"), comparison.alias("items")), explanation=text_)
    return F.to_json(F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit(name).alias("name"), F.lit(True).alias("strict"), body.alias("schema")).alias("json_schema")))
