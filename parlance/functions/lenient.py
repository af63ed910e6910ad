"""JSON that a model wrote, read leniently; and the JSON paths of stored transcripts."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for no value, for true and for false.
ABSENT = ("null", "none", "nil", "n/a", "na", "undefined", "unknown", "-")
TRUE = ("true", "yes", "y", "1", "да", "כן")
FALSE = ("false", "no", "n", "0", "нет", "לא")


def text_or_null(c: Column) -> Column:
    """Trimmed text; null if it is empty or says that there is none."""
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).isin(*ABSENT), t)


def boolean(c: Column) -> Column:
    """A JSON scalar's text as true or false; numbers by whether they are 0; else null."""
    t = F.lower(F.trim(c))
    number = t.try_cast("double")
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False).when(number.isNotNull(), number != 0)


def number(c: Column) -> Column:
    """A JSON scalar's text as a number; quotes and a plus sign in front are fine."""
    return F.regexp_replace(F.trim(c), r"^\++", "").try_cast("double")


def prose(value: Any) -> str | None:
    """Any JSON value as prose: pieces joined by a space behind sentence marks, else by a semicolon."""
    if value is None:
        return None
    if isinstance(value, str):
        t = value.strip()
        return t if t and t.lower() not in ABSENT else None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return json.dumps(value)
    pieces = [p for x in (value.values() if isinstance(value, dict) else value) if (p := prose(x))]
    out = ""
    for p in pieces:
        out += (" " if out.endswith((".", "!", "?", "…", ":", ";")) else "; ") + p if out else p
    return out or None


def prose_of(c: Column) -> Column:
    """``prose`` of a column of JSON text, in Arrow batches; text that is no JSON stands for itself."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else prose(json.loads(t))
        except ValueError:
            return prose(t)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one, na_action="ignore")

    return run(c)


def primary_language(json_text: Column) -> Column:
    """The stored column: the first language's JSON text in lower case."""
    return F.lower(F.get_json_object(json_text, "$.languages[0].language"))


def first_text(json_text: Column) -> Column:
    return F.get_json_object(json_text, "$.segments[0].normalized_text")


def payload_options(json_text: Column) -> Column:
    """A job payload's options as a struct; speakers between 1 and 10."""
    n = F.get_json_object(json_text, "$.expected_speakers").try_cast("int")
    return F.struct(
        F.get_json_object(json_text, "$.language_hint").alias("language_hint"), F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(10))).alias("expected_speakers"),
        F.coalesce(boolean(F.get_json_object(json_text, "$.force_retranscribe")), F.lit(False)).alias("force_retranscribe"),
    )
