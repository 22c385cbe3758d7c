"""Judge replies: the JSON object inside free text, and whether it makes a label."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_json_object(reply: str) -> dict:
    """The first piece of ``reply`` that reads as a JSON object; raises when there is none."""
    read = json.JSONDecoder().raw_decode
    at = reply.find("{")
    while at >= 0:
        try:
            return read(reply, at)[0]
        except json.JSONDecodeError:
            at = reply.find("{", at + 1)
    raise ValueError(f"no JSON object in the reply: {reply!r}")


def check_label(found: dict) -> tuple[str, str]:
    """Title and description of a reply; raises unless both are non-empty strings."""
    title, description = found.get("title"), found.get("description")
    for value in (title, description):
        if not (isinstance(value, str) and value):
            raise ValueError(f"title and description must be non-empty strings: {found!r}")
    return title, description


def extract_json(c: Column) -> Column:
    """The first JSON object of a text as a JSON string; null when there is none."""

    @F.pandas_udf("string")
    def extract(replies: pd.Series) -> pd.Series:
        def one(reply):
            try:
                return json.dumps(first_json_object(reply), ensure_ascii=False, sort_keys=True)
            except (ValueError, TypeError, AttributeError, RecursionError):
                return None

        return replies.map(one)

    return extract(c)


def validate_label(c: Column) -> Column:
    """``STRUCT<title, description, status, error>`` of a reply text."""

    @F.pandas_udf("title string, description string, status string, error string")
    def validate(replies: pd.Series) -> pd.DataFrame:
        def one(reply):
            try:
                return (*check_label(first_json_object(reply)), "ok", None)
            except Exception as e:
                return None, None, "error", f"{type(e).__name__}: {e}"

        return pd.DataFrame(
            [one(r) for r in replies], columns=["title", "description", "status", "error"], dtype=object
        )

    return validate(c)
