"""Content-type detection as column expressions: seven detectors in a fixed cascade.

Each detector looks at a bounded head of the block, so a very long block costs no more than its sample. The lines
are split once and the sampled ones are matched by higher-order functions; nothing leaves the JVM but blocks that
start with a bracket, which a strict JSON parser must see.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.jsontext import parse_array
from lucerna.functions.text import BOUNDARY, END, WHITE, is_blank, lines_of, trimmed

#: Sample sizes in lines (diff, log, search, code) and UTF-16 units (HTML).
DIFF_LINES, LOG_LINES, SEARCH_LINES, CODE_LINES, HTML_UNITS = 500, 200, 100, 100, 3000

_S = rf"[{WHITE}]"
#: Patterns of diff headers and changes.
DIFF_HEADER = rf"^(?:diff --git|diff --combined |diff --cc |--- a/|\+\+\+ b/|index{_S}+[0-9a-f]+\.\.[0-9a-f]+|@@{_S}+-\d+,\d+{_S}+\+\d+,\d+{_S}+@@|@@@+{_S}+-\d+(?:,\d+)?{_S}+(?:-\d+(?:,\d+)?{_S}+)+\+\d+(?:,\d+)?{_S}+@@@+)"
DIFF_CHANGE = r"^[+-][^+-]"
SEARCH_RESULT = rf"^[^{WHITE}:]+:\d+:"
#: Patterns of log lines; the first two are error-like.
LOG_PATTERNS = (
    rf"(?i){BOUNDARY}(?:ERROR|FAIL|FAILED|FATAL|CRITICAL){BOUNDARY}",
    rf"(?i){BOUNDARY}(?:WARN|WARNING){BOUNDARY}",
    rf"(?i){BOUNDARY}(?:INFO|DEBUG|TRACE){BOUNDARY}",
    rf"^{_S}*\d{{4}}-\d{{2}}-\d{{2}}",
    rf"^{_S}*\[\d{{2}}:\d{{2}}:\d{{2}}\]",
    r"^={3,}|^-{3,}",
    rf"^{_S}*PASSED|^{_S}*FAILED|^{_S}*SKIPPED",
    r"^npm ERR!|^yarn error|^cargo error",
    r"Traceback \(most recent call last\)",
    r"^\w*(?:Error|Exception):",
    rf"^{_S}*at{_S}+[\w.$]+\(",
)
#: Patterns of source lines by language, in the order that settles ties.
CODE_PATTERNS = {
    "python": rf'^{_S}*(?:def|class|import|from|async def){_S}+\w+|^{_S}*@\w+|^{_S}*"""|^{_S}*if __name__{_S}*==',
    "javascript": rf"^{_S}*(?:function|const|let|var|class|import|export){_S}+|^{_S}*(?:async{_S}+function|=>{_S}*\{{)|^{_S}*module\.exports",
    "typescript": rf"^{_S}*(?:interface|type|enum|namespace){_S}+\w+|:{_S}*(?:string|number|boolean|any|void){END}",
    "go": rf"^{_S}*(?:func|type|package|import){_S}+|^{_S}*func{_S}+\([^)]+\){_S}+\w+",
    "rust": rf"^{_S}*(?:fn|struct|enum|impl|mod|use|pub){_S}+|^{_S}*#\[",
    "java": rf"^{_S}*(?:public|private|protected){_S}+(?:class|interface|enum)|^{_S}*@\w+|^{_S}*package{_S}+[\w.]+;",
}
PROSE_BOUNDARY = rf"[.!?]{_S}+[A-Z]"
PROSE_CODE_START = rf"^{_S}*(?:import|export|function|const|let|var|class|def){_S}"
HTML_STRUCTURE = rf"(?i)<(?:div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[{WHITE}>]"

_FIELDS = ("item_count:int", "is_dict_array:boolean", "header_matches:int", "change_lines:int", "has_doctype:boolean", "has_html_tag:boolean", "structural_tags:int", "matching_lines:int", "total_lines:int", "pattern_matches:int", "error_matches:int", "language:string", "sentences:int")

_SPACE = "\t\n\x0b\x0c\r                  　﻿"


def detection(content_type: str, confidence: Column, **metadata: Column) -> Column:
    parts = [F.lit(content_type).alias("content_type"), confidence.cast("double").alias("confidence")]
    for f in _FIELDS:
        name, kind = f.split(":")
        parts.append(metadata.get(name, F.lit(None)).cast(kind).alias(name))
    return F.struct(*parts)


def _hits(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern)))


def json_array_facts(text: Column) -> Column:
    """Items of a JSON array, and whether each is an object or array; nulls where a text isn't one."""

    @F.pandas_udf("struct<items:int,dicts:boolean>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [None if t is None else parse_array(t.strip(_SPACE)) for t in batch]
            dicts = [None if a is None else bool(a) and all(x is None or isinstance(x, (dict, list)) for x in a) for a in found]
            yield pd.DataFrame({"items": pd.array([None if a is None else len(a) for a in found], dtype="Int32"), "dicts": pd.array(dicts, dtype="boolean")})

    return run(text)


def diff_of(lines: Column) -> Column:
    head = F.slice(lines, 1, DIFF_LINES)
    h, c = _hits(head, DIFF_HEADER), _hits(head, DIFF_CHANGE)
    return F.when(h > 0, detection("diff", F.least(F.lit(1.0), 0.5 + h * 0.2 + c * 0.05), header_matches=h, change_lines=c))


def html_of(text: Column) -> Column:
    head = F.substring(text, 1, HTML_UNITS)
    doctype, tag = head.rlike(rf"(?i)\A{_S}*<!doctype{_S}+html"), head.rlike(rf"(?i)<html[{WHITE}>]")
    n = F.regexp_count(head, F.lit(HTML_STRUCTURE))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    score = part(doctype, 0.5) + part(tag, 0.3) + part(head.rlike(rf"(?i)<head[{WHITE}>]"), 0.1) + part(head.rlike(rf"(?i)<body[{WHITE}>]"), 0.1) + F.least(F.lit(0.3), n * 0.03)
    confidence = F.least(F.lit(1.0), score)
    return F.when((doctype | tag | (n >= 3)) & (confidence >= 0.5), detection("html", confidence, has_doctype=doctype, has_html_tag=tag, structural_tags=n))


def search_of(lines: Column) -> Column:
    head = F.slice(lines, 1, SEARCH_LINES)
    m, total = _hits(head, SEARCH_RESULT), F.size(F.filter(head, lambda x: ~is_blank(x)))
    ratio = F.try_divide(m, total)
    return F.when((m > 0) & (ratio >= 0.3), detection("search", F.least(F.lit(1.0), 0.4 + ratio * 0.6), matching_lines=m, total_lines=total))


def log_of(lines: Column) -> Column:
    head = F.slice(lines, 1, LOG_LINES)
    any_of = "|".join(f"(?:{p})" for p in LOG_PATTERNS)
    m, total = _hits(head, any_of), F.size(F.filter(head, lambda x: ~is_blank(x)))
    errors = _hits(head, "|".join(f"(?:{p})" for p in LOG_PATTERNS[:2]))
    ratio = F.try_divide(m, total)
    return F.when((m > 0) & (ratio >= 0.1), detection("build", F.least(F.lit(1.0), 0.3 + ratio * 0.5 + errors * 0.05), pattern_matches=m, error_matches=errors, total_lines=total))


def code_of(lines: Column) -> Column:
    head = F.slice(lines, 1, CODE_LINES)
    total = F.size(F.filter(head, lambda x: ~is_blank(x)))
    counts = {name: _hits(head, pattern) for name, pattern in CODE_PATTERNS.items()}
    best = F.greatest(*counts.values())
    # ties go to the language that is met first
    first = lambda pattern: F.array_position(F.transform(head, lambda x: x.rlike(pattern)), True)
    met = F.array(*[F.struct((-n).alias("n"), first(CODE_PATTERNS[name]).alias("line"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts.items())])
    language = F.array_min(met)["name"]
    ratio = best / F.greatest(total, F.lit(1))
    return F.when(best >= 3, detection("source_code", F.least(F.lit(1.0), 0.4 + ratio * 0.4 + best * 0.02), language=language, pattern_matches=best))


def prose_of(text: Column, lines: Column) -> Column:
    sentences = F.regexp_count(text, F.lit(PROSE_BOUNDARY))
    filled = F.filter(lines, lambda x: ~is_blank(x))
    prose = F.size(F.filter(filled, lambda x: trimmed(x).rlike("^[A-Z]") & trimmed(x).contains(" ") & ~trimmed(x).rlike(PROSE_CODE_START)))
    ratio = F.try_divide(prose, F.size(filled))
    return F.when((sentences > 0) & (ratio >= 0.5), detection("prose", F.least(F.lit(0.9), 0.5 + ratio * 0.4), sentences=sentences + 1))


def detect(df: DataFrame, text_col: str = "text", out_col: str = "detection") -> DataFrame:
    """df with a detection struct. Null and blank texts are of type text with confidence 0. Rows never move."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    # the Arrow function gets null for all but the blocks that may be arrays
    may = F.when(t.rlike(rf"\A[{WHITE}]*\["), t)
    df = df.withColumn("__facts", json_array_facts(may)).withColumn("__lines", lines_of(t))
    lines, facts = F.col("__lines"), F.col("__facts")
    as_json = F.when(facts["items"].isNotNull(), detection("json_array", F.when(facts["dicts"], 1.0).otherwise(0.8), item_count=facts["items"], is_dict_array=facts["dicts"]))
    over = lambda d, least: F.when(d["confidence"] >= least, d)
    cascade = F.coalesce(as_json, over(diff_of(lines), 0.7), over(html_of(t), 0.7), over(search_of(lines), 0.6), over(log_of(lines), 0.5), over(code_of(lines), 0.5), prose_of(t, lines), detection("text", F.lit(0.5)))
    found = F.when(is_blank(t), detection("text", F.lit(0.0))).otherwise(cascade)
    return df.withColumn(out_col, found).drop("__facts", "__lines")
