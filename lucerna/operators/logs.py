"""Log blocks: line levels, stack traces, selection of the lines worth keeping, omission markers.

A block is exploded to lines; all windows are over its lines, so the exchange by block is the only one and every
window after it reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import BOUNDARY, WHITE, content_key, is_blank, lines_of, retrieve_hint, utf16_length
from lucerna.operators.kneedle import optimal_k

_S = rf"[{WHITE}]"
_B = BOUNDARY
#: Level words in the order in which they are tried.
LEVELS = (
    ("error", "ERROR|error|Error|FATAL|fatal|Fatal|CRITICAL|critical|FAIL|FAILED|fail|failed|Fail|Failed"),
    ("warn", "WARN|WARNING|warn|warning|Warn|Warning"),
    ("info", "INFO|info|Info"),
    ("debug", "DEBUG|debug|Debug"),
    ("trace", "TRACE|trace|Trace"),
)
#: Scores by level.
SCORES = {"error": 1.0, "warn": 0.5, "info": 0.1, "debug": 0.05, "trace": 0.02, "unknown": 0.1}
#: Lines that open a stack trace, lines that continue one after a blank line, summary lines.
STACK = rf'^{_S}*Traceback \(most recent call last\)|^{_S}*File ".+", line \d+|^{_S}*at .+\(.+:\d+:\d+\)|^{_S}+at [\w.$]+\(|^{_S}*--> .+:\d+:\d+|^{_S}*\d+:{_S}+0x[0-9a-f]+'
CONTINUES = rf'^{_S}+at{_S}|^{_S}+File{_S}+"|^{_S}+\d+{_S}+|(?i:^Caused by:|^During handling of the above|^The above exception was)'
SUMMARY = rf"^={{3,}}|^-{{3,}}|(?i:^\d+ (?:passed|failed|skipped|error|warning))|^(?:Tests?|Suites?):?{_S}+\d+|^(?:TOTAL|Total|Summary)|(?i:^(?:Build|Compile|Test)[^\n\r]*(?:succeeded|failed|complete))"
STACK_RUN = 20


@dataclass(frozen=True)
class LogOptions:
    max_errors: int = 10
    error_context_lines: int = 3
    keep_first_error: bool = True
    keep_last_error: bool = True
    max_stack_traces: int = 3
    stack_trace_max_lines: int = 20
    max_warnings: int = 5
    dedupe_warnings: bool = True
    keep_summary_lines: bool = True
    max_total_lines: int = 100


def explode_lines(blocks: DataFrame, id_col: str = "block_id", text_col: str = "text") -> DataFrame:
    """(block_id, idx, content), a row a line; a null text counts as one empty line."""
    return blocks.select(F.col(id_col).alias("block_id"), F.posexplode(lines_of(F.coalesce(F.col(text_col), F.lit("")))).alias("idx", "content"))


def level_of(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(rf"{_B}(?:{words}){_B}"), F.lit(name)) for name, words in LEVELS], F.lit("unknown"))


def score_of(level: Column, is_stack: Column, is_summary: Column) -> Column:
    base = F.coalesce(*[F.when(level == name, F.lit(x)) for name, x in SCORES.items()], F.lit(0.1))
    return F.least(F.lit(1.0), base + F.when(is_stack, 0.3).otherwise(0.0) + F.when(is_summary, 0.4).otherwise(0.0))


def _by_block() -> Window:
    return Window.partitionBy("block_id").orderBy("idx")


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines with level, is_stack, is_summary and score.

    A trace runs from a line that opens it, for at most STACK_RUN more lines, and ends at a blank line unless the next
    filled line continues it.
    """
    before, after = _by_block().rowsBetween(Window.unboundedPreceding, 0), _by_block().rowsBetween(1, Window.unboundedFollowing)
    earlier = _by_block().rowsBetween(Window.unboundedPreceding, -1)
    blank = is_blank(F.col("content"))
    rows = lines.withColumn("level", level_of(F.col("content"))).withColumn("is_summary", F.col("content").rlike(SUMMARY))
    rows = rows.withColumn("opened", F.last(F.when(F.col("content").rlike(STACK), F.col("idx")), ignorenulls=True).over(before))
    rows = rows.withColumn("next", F.first(F.when(~blank, F.col("content")), ignorenulls=True).over(after))
    rows = rows.withColumn("ended", F.last(F.when(blank & ~F.coalesce(F.col("next").rlike(CONTINUES), F.lit(False)), F.col("idx")), ignorenulls=True).over(earlier))
    in_run = F.col("opened").isNotNull() & (F.col("idx") - F.col("opened") <= STACK_RUN)
    rows = rows.withColumn("is_stack", in_run & (F.col("ended").isNull() | (F.col("ended") < F.col("opened"))))
    return rows.drop("opened", "next", "ended").withColumn("score", score_of(F.col("level"), F.col("is_stack"), F.col("is_summary")))


def warning_template(line: Column) -> Column:
    """The line with numbers, addresses and paths after its first colon or equals sign replaced."""
    prefix = F.regexp_extract(line, r"(?s)\A[^:=]*", 0)
    suffix = F.substr(line, F.length(prefix) + 1)
    for pattern, name in ((r"\d+", "N"), (r"0x[0-9a-fA-F]+", "ADDR"), (r"/[\w/]+/", "/PATH/")):
        suffix = F.regexp_replace(suffix, pattern, name)
    return F.concat(prefix, suffix)


def select_lines(parsed: DataFrame, options: LogOptions = LogOptions()) -> DataFrame:
    """Parsed lines with the flag selected."""
    o = options
    order = _by_block()
    of = lambda level: F.col("level") == level
    kind = Window.partitionBy("block_id", "level").orderBy("idx")
    rows = parsed.withColumn("n", F.count("*").over(Window.partitionBy("block_id", "level"))).withColumn("nth", F.row_number().over(kind))
    pinned = (F.lit(o.keep_first_error) & (F.col("nth") == 1)) | (F.lit(o.keep_last_error) & (F.col("nth") == F.col("n")))
    # the rest of the errors by score
    rows = rows.withColumn("pinned", pinned).withColumn("rank", F.row_number().over(Window.partitionBy("block_id", "level", "pinned").orderBy(F.col("score").desc(), "idx")))
    pins = F.when(F.col("n") > 1, int(o.keep_first_error) + int(o.keep_last_error)).otherwise(int(o.keep_first_error or o.keep_last_error))
    error = of("error") & ((F.col("n") <= o.max_errors) | F.col("pinned") | (F.col("rank") <= o.max_errors - pins))
    template = warning_template(F.col("content")) if o.dedupe_warnings else F.col("idx").cast("string")
    rows = rows.withColumn("error", error).withColumn("template", F.when(of("warn"), template))
    rows = rows.withColumn("fresh", of("warn") & (F.row_number().over(Window.partitionBy("block_id", "template").orderBy("idx")) == 1))
    rows = rows.withColumn("warn", F.col("fresh") & (F.sum(F.col("fresh").cast("int")).over(order) <= o.max_warnings))
    starts = F.col("is_stack") & ~F.coalesce(F.lag("is_stack").over(order), F.lit(False))
    rows = rows.withColumn("trace", F.sum(starts.cast("int")).over(order)).withColumn("in_trace", F.row_number().over(Window.partitionBy("block_id", "trace", "is_stack").orderBy("idx")))
    stack = F.col("is_stack") & (F.col("trace") <= o.max_stack_traces) & (F.col("in_trace") <= o.stack_trace_max_lines)
    picked = F.col("error") | F.col("warn") | stack | (F.lit(o.keep_summary_lines) & F.col("is_summary"))
    rows = rows.withColumn("picked", picked)
    near = F.max((F.col("picked") & of("error")).cast("int")).over(order.rangeBetween(-o.error_context_lines, o.error_context_lines)) == 1
    rows = rows.withColumn("picked", F.col("picked") | near)
    return rows.select("block_id", "idx", "content", "level", "is_stack", "is_summary", "score", F.col("picked").alias("selected"))


def capped(selected: DataFrame, caps: DataFrame) -> DataFrame:
    """At most cap selected lines a block, those of the best score, then the first; caps has block_id and cap."""
    rank = F.row_number().over(Window.partitionBy("block_id", "selected").orderBy(F.col("score").desc(), "idx"))
    rows = selected.withColumn("rank", rank).join(caps, "block_id")
    return rows.withColumn("selected", F.col("selected") & (F.col("rank") <= F.col("cap"))).drop("rank", "cap")


def with_markers(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(block_id, result): selected lines with a marker for each gap, and the footer of levels; keys has block_id and hint."""
    order = _by_block()
    rows = rows.withColumn("kept_before", F.max(F.when(F.col("selected"), F.col("idx"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("gap", F.col("idx") - F.coalesce(F.col("kept_before"), F.lit(-1)) - 1)
    count = lambda level: F.sum((F.col("level") == level).cast("int"))
    kept = F.when(F.col("selected"), F.struct("idx", "gap", "content"))
    blocks = rows.groupBy("block_id").agg(F.sort_array(F.collect_list(kept)).alias("kept"), F.count("*").alias("n"), count("error").alias("ERROR"), count("warn").alias("WARN"), count("info").alias("INFO"))
    blocks = blocks.join(keys, "block_id")
    marker_line = lambda n: F.concat(F.lit("[... "), n.cast("string"), F.lit(" lines omitted"), F.col("hint"), F.lit("]"))
    body = F.flatten(F.transform("kept", lambda k: F.when(k["gap"] > 0, F.array(marker_line(k["gap"]), k["content"])).otherwise(F.array(k["content"]))))
    tail = F.col("n") - 1 - F.coalesce(F.element_at("kept", F.when(F.size("kept") > 0, -1))["idx"], F.lit(-1))
    omitted = F.col("n") - F.size("kept")
    parts = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {c}"))) for c in ("ERROR", "WARN", "INFO")]))
    footer = F.when((omitted > 0) & (F.size(parts) > 0), F.array(F.concat(F.lit("["), omitted.cast("string"), F.lit(" lines omitted: "), F.array_join(parts, ", "), F.col("hint"), F.lit("]")))).otherwise(F.expr("cast(array() as array<string>)"))
    end = F.when(tail > 0, F.array(marker_line(tail))).otherwise(F.expr("cast(array() as array<string>)"))
    return blocks.select("block_id", F.array_join(F.concat(body, end, footer), "\n").alias("result"))


def compress_logs(blocks: DataFrame, options: LogOptions = LogOptions(), store: bool = False, id_col: str = "block_id", text_col: str = "text", size: Callable[[Column], Column] = utf16_length) -> DataFrame:
    """(block_id, result): shortened logs; a block of under ten lines or one that wouldn't shrink by size keeps its text."""
    base = blocks.select(F.col(id_col).alias("block_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("lines", lines_of(F.col("text")))
    long = base.filter(F.size("lines") >= 10)
    hint = retrieve_hint(content_key(F.col("text"))) if store else F.lit("")
    facts = long.select("block_id", optimal_k(F.col("lines"), 1.0, 10, options.max_total_lines).alias("cap"), hint.alias("hint"))
    rows = capped(select_lines(parse_log(explode_lines(long)), options), facts.select("block_id", "cap"))
    done = with_markers(rows, facts.select("block_id", "hint"))
    shorter = F.col("result").isNotNull() & (F.col("result") != "") & (size(F.col("result")) < size(F.col("text")))
    return base.select("block_id", "text").join(done, "block_id", "left").select("block_id", F.when(shorter, F.col("result")).otherwise(F.col("text")).alias("result"))
