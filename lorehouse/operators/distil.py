"""Distilling documents with a model, as a table function: a summary and up to five claims a row."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from .ingest import CLAIM_TYPES, CONFIDENCES

#: What a call gives: place 0 is the summary, 1 to 5 are claims; a row that gave nothing has place null and an error.
OUTPUT = "id string, place int, type string, content string, confidence double, topics array<string>, people array<string>, error string"
MOST_CLAIMS = 5
_NUMBERS = dict(zip(CONFIDENCES, (0.9, 0.65, 0.4), strict=True))


def parsed(raw: str | None) -> dict[str, Any]:
    """The distilled object in a model's answer, without byte order mark, fences or prose around it; ValueError says what it lacks.

    It needs a summary and a claim or more, of which the first five count, each with a known type and confidence and a content.
    """
    text = (raw or "").removeprefix("﻿").strip()
    fenced = re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", text, re.S | re.I)
    text = fenced[1] if fenced else text
    if not text.startswith("{"):
        text = text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ValueError("not JSON") from e
    if not isinstance(found, dict) or not isinstance(found.get("summary"), str) or not found["summary"].strip():
        raise ValueError("no summary")
    claims = found.get("claims")
    if not isinstance(claims, list) or not claims:
        raise ValueError("no claims")
    for n, c in enumerate(claims[:MOST_CLAIMS]):
        good = isinstance(c, dict) and c.get("type") in CLAIM_TYPES and c.get("qualitative_confidence") in CONFIDENCES and isinstance(c.get("content"), str) and c["content"].strip()
        if not good:
            raise ValueError(f"claim {n}")
    return {"summary": found["summary"].strip(), "claims": claims[:MOST_CLAIMS]}


def _strings(x: Any) -> list[str]:
    return [s for s in x if isinstance(s, str)] if isinstance(x, list) else []


def register(spark: SparkSession, name: str, load: Callable[[], Callable[[str], str | None]]) -> None:
    """Makes a table function known by name: SELECT * FROM name(TABLE(SELECT id, content FROM ...)) gives OUTPUT.

    load is called once a task and gives the model, from a text to its answer; a null text is asked as an empty one. An
    answer that isn't as it must be, or a model that raises, is a row with error; the other rows go on.
    """

    class Distil:
        def __init__(self) -> None:
            self.model = load()

        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                found = parsed(self.model(row["content"] or ""))
            except Exception as e:  # noqa: BLE001 - whatever a model raises is the row's error
                yield row["id"], None, None, None, None, None, None, str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"
                return
            yield row["id"], 0, "summary", found["summary"], None, None, None, None
            for n, c in enumerate(found["claims"], 1):
                yield row["id"], n, c["type"], c["content"].strip(), _NUMBERS[c["qualitative_confidence"]], _strings(c.get("topics")), _strings(c.get("people")), None

    spark.udtf.register(name, udtf(Distil, returnType=OUTPUT))
