"""What a language model answered about a call, coerced to one shape: lists of any spelling, owners, scores, checks, accepted titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lenient
from parlance.functions.text import has_foreign_script, is_degenerate

# Titles that say nothing, what makes a summary unusable, and spellings of owners.
GENERIC = ("conversation", "customer service call", "customer service conversation")
UNUSABLE = ("misunderstandings,", "neither nor")
OWNERS = {
    "speaker_1": ("speaker_1", "speaker1", "speaker 0", "speaker_0", "agent"),
    "speaker_2": ("speaker_2", "speaker2", "customer"),
    "supervisor": ("speaker_3", "speaker3", "supervisor"),
}


def parsed(text: Column) -> Column:
    """JSON text as a variant; null if it is no JSON."""
    return F.try_parse_json(text)


def string(x: Column) -> Column:
    """A JSON string's text; null for any other value."""
    return F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))


def values(answer: Column, path: str) -> Column:
    """The values of an array or an object (in the order of its keys), or the one value that is neither; empty for none."""
    one = F.try_variant_get(answer, path, "variant")
    several = F.coalesce(F.try_variant_get(answer, path, "array<variant>"), F.map_values(F.try_variant_get(answer, path, "map<string,variant>")))
    return F.coalesce(several, F.when(one.isNotNull() & (F.schema_of_variant(one) != "VOID"), F.array(one)), F.array().cast("array<variant>"))


def strings(answer: Column, path: str) -> Column:
    """The strings among ``values``: topics and key facts."""
    return F.array_compact(F.transform(values(answer, path), string))


def _field(x: Column, names: tuple[str, ...]) -> Column:
    """The first of an object's named fields that is there, whatever it holds."""
    return F.coalesce(*[F.try_variant_get(x, f"$.{n}", "variant") for n in names])


def _first(x: Column, names: tuple[str, ...]) -> Column:
    """``_field``'s text if that is a string."""
    return string(_field(x, names))


def natural(x: Column) -> Column:
    """A JSON number that is whole and not negative; null for a quoted or fractional one, and for any other value."""
    n = F.when(F.schema_of_variant(x) == "BIGINT", x.cast("bigint"))
    return F.when(n >= 0, n)


def evidence(x: Column) -> Column:
    """The numbers of the segments that an object names as its evidence."""
    named = F.coalesce(F.try_variant_get(x, "$.evidence_segments", "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(named, natural))


def topics(answer: Column, fallback: Column) -> Column:
    """Topics as an array of strings, an object's values or one string; ``fallback`` for an array without strings and for anything else."""
    found, kind = strings(answer, "$.topics"), F.schema_of_variant(F.try_variant_get(answer, "$.topics", "variant"))
    given = F.when(kind.startswith("ARRAY"), F.size(found) > 0).otherwise(kind.startswith("OBJECT") | (kind == "STRING"))
    return F.when(given, found).otherwise(fallback)


def told(text: Column, field: str, fallback: Column) -> Column:
    """A field of the answer's text as prose (reason, resolution, customer_intent), else ``fallback``."""
    return F.coalesce(lenient.prose_of(F.get_json_object(text, f"$.{field}")), fallback)


def resolved(text: Column) -> Column:
    """Whether the matter was resolved; yes if the answer doesn't say."""
    return F.coalesce(lenient.boolean(F.get_json_object(text, "$.resolved")), F.lit(True))


def sentiment(text: Column) -> Column:
    return F.coalesce(lenient.number(F.get_json_object(text, "$.sentiment_score")), F.lit(0.0))


def _said(c: Column) -> Column:
    return F.when((F.trim(c) != "") & (F.lower(c) != "none"), c)


def owner(name: Column) -> Column:
    """A role for an owner's name; participant for any other name."""
    out = F.when(name.isNull(), None)
    for role, names in OWNERS.items():
        out = out.when(F.lower(name).isin(*names), role)
    return out.otherwise("participant")


def action_items(answer: Column) -> Column:
    """(text, owner, deadline, evidence) of each item, from strings or objects of several spellings; items that say none are left out."""

    def item(x: Column) -> Column:
        text = _said(F.coalesce(string(x), _first(x, ("text", "task", "description", "action", "item"))))
        return F.struct(text.alias("text"), owner(_first(x, ("owner", "assignee", "who"))).alias("owner"), _first(x, ("deadline",)).alias("deadline"), evidence(x).alias("evidence"))

    return F.filter(F.transform(values(answer, "$.action_items"), item), lambda i: i["text"].isNotNull())


def entities(answer: Column) -> Column:
    """(entity_type, value, evidence) of each entity, from strings or objects of several spellings."""

    def entity(x: Column) -> Column:
        value = _said(F.coalesce(string(x), _first(x, ("value", "name", "text"))))
        return F.struct(F.coalesce(_first(x, ("entity_type", "type", "category")), F.lit("entity")).alias("entity_type"), value.alias("value"), evidence(x).alias("evidence"))

    return F.filter(F.transform(values(answer, "$.entities"), entity), lambda e: e["value"].isNotNull())


def _whole(x: Column, names: tuple[str, ...], default: int) -> Column:
    return F.coalesce(natural(_field(x, names)), F.lit(default).cast("bigint"))


def _explained(x: Column) -> Column:
    return F.coalesce(_first(x, ("explanation",)), F.lit("")).alias("explanation")


def scorecard(answer: Column) -> Column:
    """(total_score, rules) if there is a whole total, with defaults for what a rule leaves out or spells in another way."""
    total = natural(F.try_variant_get(answer, "$.scorecard.total_score", "variant"))
    rules = F.coalesce(F.try_variant_get(answer, "$.scorecard.rules", "array<variant>"), F.array().cast("array<variant>"))
    rule = lambda x: F.struct(F.coalesce(_first(x, ("name", "rule_name")), F.lit("Rule")).alias("rule"), _whole(x, ("score", "score_awarded"), 0).alias("score"), _whole(x, ("max_score",), 100).alias("most"), _explained(x))
    return F.when(total.isNotNull(), F.struct(total.alias("total_score"), F.transform(rules, rule).alias("rules")))


def compliance(answer: Column) -> Column:
    """(rule, passed, explanation) of each check; one that doesn't say true or false has passed."""
    checks = F.coalesce(F.try_variant_get(answer, "$.compliance", "array<variant>"), F.array().cast("array<variant>"))

    def check(x: Column) -> Column:
        said = F.try_variant_get(x, "$.passed", "variant")
        passed = F.coalesce(F.when(F.schema_of_variant(said) == "BOOLEAN", said.cast("boolean")), F.lit(True))
        return F.struct(F.coalesce(_first(x, ("name",)), F.lit("Policy")).alias("rule"), passed.alias("passed"), _explained(x))

    return F.transform(checks, check)


def accepted_summary(summary: Column, fallback: Column) -> Column:
    """The model's summary unless it is missing, repeats itself, is in a foreign script or says what models say when they fail."""
    bad = is_degenerate(summary) | has_foreign_script(summary)
    for words in UNUSABLE:
        bad = bad | summary.contains(words)
    return F.when(summary.isNull() | bad, fallback).otherwise(summary)


def accepted_title(title: Column, fallback: Column) -> Column:
    """The model's title unless it is missing, unusable or says nothing."""
    return F.when(title.isNull() | is_degenerate(title) | has_foreign_script(title) | F.lower(title).isin(*GENERIC), fallback).otherwise(title)


def shape(text: Column) -> Column:
    """``key=type`` for each field of a JSON object, in the order of the keys."""
    kind = lambda v: F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), "null").when(F.schema_of_variant(v) == "BOOLEAN", "bool").when(F.schema_of_variant(v) == "STRING", "string").when(F.schema_of_variant(v).startswith("ARRAY"), "array").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("number")
    fields = F.try_variant_get(parsed(text), "$", "map<string,variant>")
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), kind(e["value"]))), " ")
