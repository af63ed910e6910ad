"""What analyses found: places, calendar events, and a message that sums a call up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "array<struct<entity_type:string,value:string>>"
PLACES, NOTABLE = "loc|place|address", "loc|place|address|phone|price|amount"
#: Stems in a call's reason that speak of an appointment.
APPOINTMENT = "meet|appoint|schedul|visit"


def entities(json_text: Column) -> Column:
    """The entities of an analysis' JSON; empty if there are none."""
    return F.coalesce(F.from_json(F.get_json_object(json_text, "$.entities"), ENTITY), F.array().cast(ENTITY))


def of_kind(found: Column, pattern: str) -> Column:
    return F.filter(found, lambda e: F.lower(e["entity_type"]).rlike(pattern))


def first_place(found: Column) -> Column:
    return F.get(of_kind(found, PLACES), F.lit(0))["value"]


def is_calendar_event(found: Column, reason: Column) -> Column:
    return (F.size(of_kind(found, PLACES)) > 0) | F.coalesce(F.lower(reason).rlike(APPOINTMENT), F.lit(False))


def badge(status: Column) -> Column:
    return F.when(status == "completed", "done").when(status == "failed", "error").when(status == "processing", "busy").otherwise("waiting")


def message(rows: DataFrame) -> DataFrame:
    """(call_id, message) in Markdown from title, summary, reason and ``analysis_json``; parts without a value are left out."""
    notable = F.array_join(F.transform(of_kind(entities(F.col("analysis_json")), NOTABLE), lambda e: F.concat(F.lit("- "), e["entity_type"], F.lit(": "), e["value"])), "\n")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    return rows.select("call_id", F.concat_ws("\n\n", part("*", F.concat(F.col("title"), F.lit("*"))), part("", F.col("summary")), part("Reason: ", F.col("reason")), part("Details:\n", notable)).alias("message"))
