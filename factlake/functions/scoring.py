"""Answer scorers as Column expressions; nulls never score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlake.functions.text import NUMBER_WORDS, case, casefold, planner_normal

TRUTH = r"(?<![a-z])(yes|true|correct|no|false|incorrect)(?![a-z])"
WORDS = "|".join(NUMBER_WORDS)
NUMBER = rf"(?i)((?<!\w)[+-]?\d+(?!\w)|(?<![a-z])(?:{WORDS})(?![a-z]))"
FINAL = r"(?is)^.*(?:final\s+answer|answer)\s*[:=-]\s*"


def parse_boolean(value: Column) -> Column:
    """The last yes/no word of a text as a boolean, or null."""
    last = F.element_at(F.regexp_extract_all(casefold(value), F.lit(TRUTH), F.lit(1)), -1)
    return F.when(F.size(F.regexp_extract_all(casefold(value), F.lit(TRUTH), F.lit(1))) > 0, last.isin("yes", "true", "correct"))


def parse_number(value: Column) -> Column:
    """The last number of the final answer, in digits or words up to twenty, or null."""
    text = F.replace(F.regexp_replace(value, FINAL, ""), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    last = F.lower(F.get(found, F.size(found) - 1))
    return F.coalesce(last.try_cast("long"), case([(last == w, F.lit(n).cast("long")) for w, n in NUMBER_WORDS.items()], F.lit(None).cast("long")))


def strict_integer(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("long"))


def subem(predicted: Column, gold: Column) -> Column:
    """Case-insensitive substring; an empty gold matches anything."""
    return F.coalesce(casefold(F.coalesce(predicted, F.lit(""))).contains(casefold(gold)), F.lit(False))


def bidirectional(predicted: Column, gold: Column) -> Column:
    """One contains the other after stripping, or their first numbers are equal."""
    p, g = F.trim(F.lower(predicted)), F.trim(F.lower(gold))
    first = [F.regexp_extract(x, r"\d+", 0) for x in (p, g)]
    return F.coalesce(p.contains(g) | g.contains(p) | ((first[0] != "") & (first[0] == first[1])), F.lit(False))


def soft(predicted: Column, gold: Column) -> Column:
    """Equality or containment after squeezing white space."""
    p, g = (F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")) for x in (predicted, gold))
    return F.coalesce((p == g) | p.contains(g), F.lit(False))


def by_intent(intent: Column, predicted: Column, gold: Column) -> Column:
    """Booleans canonically, counts exactly, text by normal form with a non-empty gold."""
    p, g = planner_normal(predicted), planner_normal(gold)
    return F.coalesce(
        case(
            [
                (intent == "boolean", parse_boolean(predicted) == parse_boolean(gold)),
                (intent == "aggregation", parse_number(predicted) == strict_integer(gold)),
            ],
            (g != "") & p.contains(g),
        ),
        F.lit(False),
    )


def strict(intent: Column, predicted: Column, gold: Column) -> Column:
    """Whole-text integers and booleans, normal forms for the rest."""
    p, g = F.trim(casefold(predicted)), F.trim(casefold(gold))
    number = F.when(predicted.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(predicted) == F.trim(gold))
    return F.coalesce(case([(intent == "boolean", (p == g) & g.isin("true", "false")), (intent == "aggregation", number)], planner_normal(predicted) == planner_normal(gold)), F.lit(False))
