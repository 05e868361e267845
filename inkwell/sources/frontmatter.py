"""Frontmatter of notes: an indentation-based subset of YAML, parsed in an Arrow UDF to JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = re.compile(r"^---[^\S\n]*\n(.*?)\n---", re.S)


def scalar(raw: str):
    """null, booleans, quoted strings, whole and other numbers, else the text itself."""
    text = raw.strip()
    low = text.lower()
    if low in ("", "null"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if len(text) > 1 and text[0] in "\"'" and text[-1] == text[0]:
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


class _Lines:
    """The meaningful lines of a block as (indent, text), read once from front to back."""

    def __init__(self, block: str):
        self.rows = [(len(line) - len(line.lstrip(" ")), line.strip(), line) for line in block.split("\n")]
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.rows):
            indent, text, _ = self.rows[self.at]
            if text and not text.startswith("#"):
                return indent, text
            self.at += 1
        return None

    def block_scalar(self, parent: int) -> str:
        held = []
        while self.at < len(self.rows) and (self.rows[self.at][0] > parent or not self.rows[self.at][1]):
            held.append(self.rows[self.at][1])
            self.at += 1
        while held and not held[-1]:
            held.pop()
        return "\n".join(held)


def _is_item(text: str) -> bool:
    return text == "-" or text.startswith("- ")


def _pair(text: str) -> tuple[str, str] | None:
    if text[:1] in "\"'":
        return None
    key, colon, value = text.partition(":")
    return (key.strip(), value.strip()) if colon and key.strip() else None


def _value(lines: _Lines, raw: str, indent: int):
    if raw == "|":
        return lines.block_scalar(indent)
    if raw.startswith("[") and raw.endswith("]"):
        inner = raw[1:-1].strip()
        return [scalar(part) for part in inner.split(",")] if inner else []
    if raw:
        return scalar(raw)
    after = lines.peek()
    if after and (after[0] > indent or (after[0] == indent and _is_item(after[1]))):
        return _block(lines, after[0])
    return None


def _mapping(lines: _Lines, indent: int, out: dict) -> dict:
    while (now := lines.peek()) and now[0] >= indent and not _is_item(now[1]):
        lines.at += 1
        pair = _pair(now[1])
        if pair:
            out[pair[0]] = _value(lines, pair[1], now[0])
    return out


def _sequence(lines: _Lines, indent: int) -> list:
    out = []
    while (now := lines.peek()) and now[0] == indent and _is_item(now[1]):
        lines.at += 1
        text = now[1][1:].strip()
        pair = _pair(text)
        if pair:  # the item's first pair stands on its line, others may follow deeper
            item = {pair[0]: _value(lines, pair[1], indent + 2)}
            after = lines.peek()
            if after and after[0] > indent and not _is_item(after[1]):
                _mapping(lines, after[0], item)
            out.append(item)
        elif text:
            out.append(scalar(text))
        else:
            after = lines.peek()
            out.append(_block(lines, after[0]) if after and after[0] > indent else None)
    return out


def _block(lines: _Lines, indent: int):
    now = lines.peek()
    if now is None:
        return None
    return _sequence(lines, now[0]) if _is_item(now[1]) else _mapping(lines, indent, {})


def parse_frontmatter(text: str) -> dict:
    """The frontmatter of a note; empty without one."""
    found = HEAD.match(text or "")
    if not found:
        return {}
    parsed = _block(_Lines(found[1]), 0)
    return parsed if isinstance(parsed, dict) else {}


def _finite(value):
    """JSON has no NaN or infinity; they become strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def frontmatter_json(texts: pd.Series) -> pd.Series:
    """Frontmatter of each text as a JSON object."""
    return texts.map(lambda t: json.dumps(_finite(parse_frontmatter(t or "")), ensure_ascii=False))


def with_frontmatter(notes: DataFrame, schema: str | T.StructType, text: Column | str = "value") -> DataFrame:
    """``notes`` with ``meta``, the frontmatter read by ``schema``."""
    return notes.withColumn("meta", F.from_json(frontmatter_json(F.col(text) if isinstance(text, str) else text), schema))
