"""Strict JSON arrays: parsing to items, and rendering as JavaScript does."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block: compact text, indented text, whether it is an object, and its fields with values as text.
ITEMS = "array<struct<json:string,pretty:string,is_object:boolean,fields:array<struct<key:string,value:string>>>>"
_SURROGATE = re.compile("[\ud800-\udfff]")
_INDEX = re.compile(r"(?:0|[1-9][0-9]*)\Z")


def _no_constant(name: str):
    raise ValueError(name)


def number_text(x: int | float) -> str:
    """A double as JavaScript writes it."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if abs(x) < 2**53 else format(Decimal(repr(x)), "f").removesuffix(".0")
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x)), "f")
    mantissa, _, power = repr(x).partition("e")
    return f"{mantissa.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0')}"


def string_text(s: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", json.dumps(s, ensure_ascii=False))


def ordered(obj: dict) -> list[tuple[str, object]]:
    """Members in JavaScript's order: array indices first, by number, then the others as met."""
    index = sorted((k for k in obj if _INDEX.match(k) and int(k) < 2**32 - 1), key=int)
    return [(k, obj[k]) for k in [*index, *(k for k in obj if k not in set(index))]]


def render(v: object, indent: int | None = None, depth: int = 0) -> str:
    """JSON text, compact or with indent spaces a level."""
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, str):
        return string_text(v)
    gap = "" if indent is None else "\n" + " " * indent * (depth + 1)
    end = "" if indent is None else "\n" + " " * indent * depth
    if isinstance(v, list):
        return "[" + gap + ("," + gap).join(render(x, indent, depth + 1) for x in v) + end + "]" if v else "[]"
    sep = ":" if indent is None else ": "
    return "{" + gap + ("," + gap).join(string_text(k) + sep + render(x, indent, depth + 1) for k, x in ordered(v)) + end + "}" if v else "{}"


def parse_array(text: str | None) -> list | None:
    """The array in a text that is one in strict JSON, else None."""
    if text is None or not text.lstrip(" \t\n\r").startswith("["):
        return None
    try:
        found = json.loads(text.strip(" \t\n\r"), parse_constant=_no_constant, parse_int=float)
    except (ValueError, RecursionError, OverflowError):
        return None
    return found if isinstance(found, list) else None


def value_text(v: object) -> str | None:
    """A value as text for counting: scalars as they print, nested values as JSON, null for null."""
    return None if v is None else v if isinstance(v, str) else render(v)


def json_items(text: Column) -> Column:
    """The items of a JSON array, null where the text isn't one."""

    @F.pandas_udf(ITEMS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                found = parse_array(t)
                if found is None:
                    out.append(None)
                    continue
                out.append([{"json": render(v), "pretty": render(v, 2, 1), "is_object": isinstance(v, dict), "fields": [{"key": k, "value": value_text(x)} for k, x in v.items()] if isinstance(v, dict) else []} for v in found])
            yield pd.Series(out, dtype="object")

    return run(text)
