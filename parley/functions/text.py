"""Column functions over transcripts and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_history(history: Column) -> Column:
    """"role: content" lines of an array of (role, content), each ended by a line feed."""
    return F.array_join(F.transform(history, lambda m: F.concat(F.when(m["role"] == "simulated_user", "user").otherwise(m["role"]), F.lit(": "), m["content"], F.lit("\n"))), "")


def combine_knowledge(items: Column) -> Column:
    """Numbered blocks of knowledge with a blank line between; empty for none."""
    return F.coalesce(F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("Knowledge "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n"), F.lit(""))


def score_label(score: Column) -> Column:
    return F.when(score < 2, "Poor").when(score < 3, "Needs Improvement").when(score < 4, "Good").otherwise("Excellent")


def truncate_reason(reason: Column, words: int = 10) -> Column:
    """The first words of a reason, with an ellipsis if there are more; empty for none."""
    text = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    parts = F.split(text, " ")
    return F.when(text == "", "").when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("..."))).otherwise(text)


def canonical_json(raw: Column) -> Column:
    """JSON text with sorted keys; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(raw))


def parse_arguments(raw: Column) -> Column:
    """A JSON object in canonical form; an empty object for anything else."""
    v = F.try_parse_json(raw)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).otherwise(F.lit("{}"))


def normalise_reason(reason: Column) -> Column:
    """Lower case, white space collapsed, digits masked: what equal root causes share."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(reason, F.lit(""))), r"\s+", " ")), "[0-9]+", "#")


def response_length(text: Column) -> Column:
    """One point for each hundred characters, between 1 and 5."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.length(text) / 100))


def composite(a: Column, b: Column) -> Column:
    """Two parts of a judge's verdict, 0 to 1 each, on a scale to 5."""
    return (a + b) / 2 * 5
