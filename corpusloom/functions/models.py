"""Language models as functions from a prompt column to an answer column, and parsers of what they answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: prompt column -> answer column
Generate = Callable[[Column], Column]


def callable_model(answer: Callable[[str], str]) -> Generate:
    """A Python function of one prompt as a model; it runs in Arrow batches. A null prompt has a null answer."""
    run = F.pandas_udf(lambda prompts: prompts.map(lambda p: None if p is None else str(answer(p))).astype(object), "string")
    return lambda prompt: run(prompt)


def batch_model(answer: Callable[[pd.Series], pd.Series]) -> Generate:
    """A function of a batch of prompts as a model."""
    run = F.pandas_udf(answer, "string")
    return lambda prompt: run(prompt)


def static_model(answer: str) -> Generate:
    """A model that always gives the same answer: for tests."""
    return lambda prompt: F.when(prompt.isNotNull(), F.lit(answer))


def scripted_model(answers: Mapping[str, str], default: str = "") -> Generate:
    """A model that gives the answer of the first key that the prompt contains: for tests, all in the JVM."""

    def run(prompt: Column) -> Column:
        out = F.lit(default)
        for k, v in reversed(list(answers.items())):
            out = F.when(prompt.contains(k), v).otherwise(out)
        return out

    return run


def first_line(answer: Column) -> Column:
    """The first line of an answer, trimmed."""
    return F.trim(F.substring_index(F.trim(answer), "\n", 1))


def listed_lines(answer: Column, most: int | None = None) -> Column:
    """The items of a list that a model wrote: lines without bullets, numbers and blanks, each once whatever its case."""
    bare = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])?\s*", ""))), lambda x: x != "")
    first = F.filter(bare, lambda x, i: F.array_position(F.transform(bare, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return first if most is None else F.slice(first, 1, most)


def json_block(answer: Column) -> Column:
    """The text from the first opening to the last closing brace, null where that is no JSON object."""
    found = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def json_safe(value: Column) -> Column:
    """Any value as JSON text that to-and-from conversion keeps: nested values in a struct, so nulls and scalars are objects too."""
    return F.to_json(F.struct(value.alias("value")))


def from_json_safe(payload: Column, kind: str) -> Column:
    return F.from_json(payload, f"value {kind}")["value"]


def quality_label(answer: Column) -> Column:
    """correct, ambiguous or incorrect, as an evaluator says; ambiguous if it says none of them."""
    a = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(a.contains("incorrect"), "incorrect").when(a.contains("ambigu"), "ambiguous").when(a.contains("correct"), "correct").otherwise("ambiguous")


def gate_label(answer: Column) -> Column:
    """NO_RETRIEVE, REPHRASE or RETRIEVE, as a gate says; RETRIEVE if it says none of them."""
    a = F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(a.contains("NO_RETRIEVE") | a.contains("NO-RETRIEVE") | a.startswith("NO"), "NO_RETRIEVE").when(a.contains("REPHRASE"), "REPHRASE").otherwise("RETRIEVE")
