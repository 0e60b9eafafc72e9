"""Column functions on text: lengths in UTF-16 units, keys, markers, prompt normalising, savings.

JavaScript rules are spelled out where Java's differ: word boundaries are ASCII, white space includes no-break and
other Unicode spaces, lengths count UTF-16 units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class: what JavaScript's \s matches.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: ASCII word boundaries for use in Java patterns.
START, END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
BOUNDARY = rf"(?:{START}|{END})"
DOT = r"[^\n\r\x{2028}\x{2029}]"

MARKER_OPEN, MARKER_CLOSE = "<<ccr:", ">>"
HINT = " — retrieve with "

#: Volatile tokens of prompts, in the order in which they are replaced.
VOLATILE = (
    ("<<UUID>>", r"[\da-f]{8}-[\da-f]{4}-[\da-f]{4}-[\da-f]{4}-[\da-f]{12}"),
    ("<<TIMESTAMP>>", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z"),
    ("<<DATE>>", r"\d{4}-\d{2}-\d{2}"),
    ("<<SESSION_ID>>", r"[\da-f]{32,}"),
)


def utf16_length(text: Column) -> Column:
    """Code points, and one more for each beyond the basic plane (those are the four-byte characters of UTF-8)."""
    return (F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A[{WHITE}]*\z")


def lines_of(text: Column) -> Column:
    """The lines of a text, empty ones at the end included; a carriage return stays with its line."""
    return F.split(text, "\n", -1)


def content_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def marker(key: Column) -> Column:
    return F.concat(F.lit(MARKER_OPEN), key, F.lit(MARKER_CLOSE))


def marker_keys(text: Column) -> Column:
    """Keys of all markers in a text; one that isn't closed ends the search."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<<ccr:(.*?)>>"), F.lit(1))


def retrieve_hint(key: Column) -> Column:
    return F.concat(F.lit(HINT), marker(key))


def normalize_prompt(text: Column) -> Column:
    for name, pattern in VOLATILE:
        text = F.regexp_replace(text, rf"(?i){BOUNDARY}{pattern}{BOUNDARY}", name)
    return text


def prompt_changed(text: Column) -> Column:
    return normalize_prompt(text) != text


def savings_percent(consumed: Column, saved: Column) -> Column:
    return F.when(consumed > 0, F.floor(F.try_divide(saved, consumed) * 10000 + 0.5) / 100).otherwise(F.lit(0.0))


def compression_ratio(compressed: Column, text: Column) -> Column:
    return F.try_divide(utf16_length(compressed), utf16_length(text))


def register_functions(spark) -> None:
    """SQL names for the scalar functions, as temporary SQL functions: they inline into the plan."""
    bodies = {
        "lucerna_token_estimate(s STRING) RETURNS BIGINT": token_estimate,
        "lucerna_content_key(s STRING) RETURNS STRING": content_key,
        "lucerna_marker_keys(s STRING) RETURNS ARRAY<STRING>": marker_keys,
        "lucerna_normalize_prompt(s STRING) RETURNS STRING": normalize_prompt,
    }
    for head in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {_SQL[head.split('(')[0]]}")


_QUOTED = lambda s: "r'" + s.replace("'", "\\'") + "'"
_SQL = {
    "lucerna_token_estimate": r"CAST(ceil((length(s) + length(regexp_replace(s, r'[^\x{10000}-\x{10FFFF}]+', ''))) / 4) AS BIGINT)",
    "lucerna_content_key": "substring(sha2(s, 256), 1, 24)",
    "lucerna_marker_keys": "regexp_extract_all(s, r'(?s)<<ccr:(.*?)>>', 1)",
}
_body = "s"
for _name, _pattern in VOLATILE:
    _body = f"regexp_replace({_body}, {_QUOTED(f'(?i){BOUNDARY}{_pattern}{BOUNDARY}')}, '{_name}')"
_SQL["lucerna_normalize_prompt"] = _body
