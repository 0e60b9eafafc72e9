"""Blocks of mixed content: the test, and the split into typed sections.

The test is a sum of four column predicates. The split looks ahead over lines and balances brackets across them, so
it is one Arrow pass over the blocks that the test picks; it is also registered as the table function split_sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import DOT, WHITE, lines_of

#: Fence lines, starts of JSON blocks, lines like search results, sentence ends, and how many make prose.
FENCE = r"\A```\w*\z"
JSON_START = rf"\A[{WHITE}]*[\[{{]"
RESULT_LIKE = rf"\A{DOT}+?[:-]\d+[:-]"
SENTENCE = rf"[.!?][{WHITE}]+[A-Z]"
MANY_SENTENCES = 5

SECTIONS = "array<struct<content:string,content_type:string,start_line:int,end_line:int>>"
_FENCE = re.compile(r"```[A-Za-z0-9_]*\Z")
_RESULT = re.compile(r"[^\n\r  ]+?[:-][0-9]+[:-]")
_SPACE = "\t\n\x0b\x0c\r                  　﻿"


def mixed_indicators(text: Column) -> Column:
    lines = lines_of(text)
    has = lambda pattern: F.exists(lines, lambda line: line.rlike(pattern)).cast("int")
    prose = (F.regexp_count(text, F.lit(SENTENCE)) > MANY_SENTENCES).cast("int")
    return has(FENCE) + has(JSON_START) + has(RESULT_LIKE) + prose


def is_mixed(text: Column) -> Column:
    return mixed_indicators(text) >= 2


def _json_end(lines: list[str], start: int) -> int | None:
    """The line where the brackets and braces that open at start are closed, None if they never are."""
    depth = {"[": 0, "{": 0}
    quoted = escaped = False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "[]{}":
                depth["[" if c in "[]" else "{"] += 1 if c in "[{" else -1
        if depth["["] <= 0 and depth["{"] <= 0:
            return i
    return None


def _kind(line: str) -> str:
    """What a line starts: fence, json, search or text."""
    if _FENCE.match(line):
        return "fence"
    if line.lstrip(_SPACE)[:1] in ("[", "{"):
        return "json"
    return "search" if _RESULT.match(line) else "text"


def sections_of(text: str) -> list[tuple[str, str, int, int]]:
    """(content, type, first line, last line) of each section; fence lines and blank text go."""
    lines = text.split("\n")
    out: list[tuple[str, str, int, int]] = []
    i = 0
    while i < len(lines):
        kind = _kind(lines[i])
        if kind == "fence":
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append(("\n".join(lines[i + 1 : end]), "source_code", i, end))
            i = end + 1
            continue
        if kind == "json":
            end = _json_end(lines, i)
            if end is not None:
                out.append(("\n".join(lines[i : end + 1]), "json_array", i, end))
                i = end + 1
                continue
            kind = "search" if _RESULT.match(lines[i]) else "text"
        end = i + 1
        if kind == "search":
            while end < len(lines) and _RESULT.match(lines[end]):
                end += 1
            out.append(("\n".join(lines[i:end]), "search", i, end - 1))
        else:
            while end < len(lines) and _kind(lines[end]) == "text":
                end += 1
            body = "\n".join(lines[i:end])
            if body.strip(_SPACE):
                out.append((body, "text", i, end - 1))
        i = end
    return out


def split_sections(text: Column) -> Column:
    """The sections of a text as an array of structs; null for null."""

    @F.pandas_udf(SECTIONS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else [dict(zip(("content", "content_type", "start_line", "end_line"), s)) for s in sections_of(t)] for t in batch], dtype="object")

    return run(text)


def explode_sections(blocks: DataFrame, id_col: str = "block_id", text_col: str = "text") -> DataFrame:
    """(block_id, section_no, content, content_type, start_line, end_line) of the blocks."""
    return blocks.select(F.col(id_col).alias("block_id"), F.posexplode(split_sections(F.coalesce(F.col(text_col), F.lit("")))).alias("section_no", "s")).select("block_id", "section_no", "s.*")


class SplitSections:
    """The handler of the SQL table function split_sections(text)."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, s in enumerate(sections_of(text or "")):
            yield (i, *s)


def register_split_sections(spark) -> None:
    spark.udtf.register("split_sections", F.udtf(SplitSections, returnType="section_no int, content string, content_type string, start_line int, end_line int"))
