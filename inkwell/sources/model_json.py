"""JSON objects out of a model's reply: whole, fenced, between braces, or cut off and closed again."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)


def _loaded(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def closed(body: str) -> str | None:
    """``body`` cut at its last complete member and closed: strings, arrays and objects that are open end there."""
    waiting: list[str] = []
    safe: tuple[int, str] | None = None
    in_string = escaped = False
    for k, c in enumerate(body):
        if in_string:
            escaped, in_string = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            in_string = True
        elif c in "{[":
            waiting.append("}" if c == "{" else "]")
            safe = (k + 1, "".join(reversed(waiting)))
        elif c in "}]":
            if not waiting or waiting.pop() != c:
                break
            safe = (k + 1, "".join(reversed(waiting)))
            if not waiting:
                break
        elif c == "," and waiting:
            safe = (k, "".join(reversed(waiting)))
    return body[: safe[0]] + safe[1] if safe else None


def extract_json(text: str | None) -> dict | None:
    """The object in a reply, or None."""
    if not text:
        return None
    fence = _FENCE.search(text)
    start, end = text.find("{"), text.rfind("}")
    tries = [text, fence[1] if fence else None, text[start : end + 1] if 0 <= start < end else None, closed(text[start:]) if start >= 0 else None]
    for one in tries:
        found = _loaded(one) if one else None
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def reply_json(replies: pd.Series) -> pd.Series:
    """The object of each reply as JSON; null where there is none."""
    found = replies.map(extract_json)
    return found.map(lambda o: None if o is None else json.dumps(o, ensure_ascii=False))
