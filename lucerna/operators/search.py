"""Grep output: parsing, ranking of files and matches under a running budget, omission markers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import BOUNDARY, DOT, content_key, is_blank, retrieve_hint, utf16_length
from lucerna.operators.logs import explode_lines

#: A result line, a drive letter, and the words that raise a match.
RESULT_LINE = rf"\A({DOT}+?)([:-])(\d+)\2({DOT}*)\z"
DRIVE = r"^[A-Za-z]:\\"
ERROR_WORDS = rf"(?i){BOUNDARY}(?:error|err|fail|exception|panic|fatal){BOUNDARY}"
WARN_WORDS = rf"(?i){BOUNDARY}(?:warn|warning){BOUNDARY}"


@dataclass(frozen=True)
class SearchOptions:
    max_matches_per_file: int = 5
    max_files: int = 20
    max_total_matches: int = 100
    keep_first_match: bool = True
    keep_last_match: bool = True


def parse_search(lines: DataFrame) -> DataFrame:
    """(block_id, idx, file, line_no, content, raw, context_type) of the lines that are results; others go."""
    drive = F.col("content").rlike(DRIVE)
    rest = F.when(drive, F.substr("content", F.lit(3))).otherwise(F.col("content"))
    part = lambda k: F.regexp_extract(rest, RESULT_LINE, k)
    found = lines.filter(~is_blank(F.col("content")) & rest.rlike(RESULT_LINE))
    return found.select("block_id", "idx", F.concat(F.when(drive, F.substring("content", 1, 2)).otherwise(F.lit("")), part(1)).alias("file"), part(3).cast("double").alias("line_no"), part(4).alias("text"), F.col("content").alias("raw"), F.when(part(2) == "-", "context").otherwise("match").alias("context_type")).withColumnRenamed("text", "content")


def match_score(line: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(line.rlike(ERROR_WORDS), 0.5).otherwise(0.0) + F.when(line.rlike(WARN_WORDS), 0.4).otherwise(0.0))


def _file_order() -> Window:
    index = F.when(F.col("file").rlike(r"\A(?:0|[1-9]\d{0,9})\z") & (F.col("file").cast("long") < 4294967295), F.col("file").cast("long"))
    return Window.partitionBy("block_id").orderBy(F.col("n").desc(), index.asc_nulls_last(), "first")


def rank_files(matches: DataFrame) -> DataFrame:
    """(block_id, file, n, rank): files by matches; ties in order of appearance, names that are array indices first."""
    files = matches.groupBy("block_id", "file").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return files.select("block_id", "file", "n", F.row_number().over(_file_order()).alias("rank"))


def select_matches(matches: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Kept matches, with n (matches of the file) and place (order among the file's picks)."""
    o = options
    first, last = int(o.keep_first_match), int(o.keep_last_match)
    offered = F.lit(first) + F.when(F.col("n") > 1, last).otherwise(0) + F.greatest(F.col("n") - 2, F.lit(0))
    # files are ranked over their matches, all by windows within the block, so that the matches move once
    of_file = Window.partitionBy("block_id", "file")
    rows = matches.withColumn("n", F.count("*").over(of_file)).withColumn("first", F.min("idx").over(of_file))
    rows = rows.withColumn("rank", F.dense_rank().over(_file_order())).filter(F.col("rank") <= o.max_files)
    want = F.when(F.col("idx") == F.col("first"), F.least(offered, F.lit(o.max_matches_per_file)))
    before = F.coalesce(F.sum(want).over(Window.partitionBy("block_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.least(F.lit(o.max_matches_per_file), F.lit(o.max_total_matches) - before)).filter("room > 0").drop("first", "rank")
    by_line = Window.partitionBy("block_id", "file").orderBy("line_no", "idx")
    rows = rows.withColumn("at", F.row_number().over(by_line))
    end = F.when(F.col("at") == 1, 0).when(F.col("at") == F.col("n"), 1).otherwise(2)
    rows = rows.withColumn("end", end).filter(f"(end = 0 and {first} = 1) or (end = 1 and {last} = 1) or end = 2")
    by_worth = Window.partitionBy("block_id", "file").orderBy("end", F.when(F.col("end") == 2, F.col("context_type") != "match"), F.when(F.col("end") == 2, -match_score(F.concat("content", "raw"))), "at")
    return rows.withColumn("place", F.row_number().over(by_worth)).filter("place <= room").drop("at", "end", "room")


def compress_search(blocks: DataFrame, options: SearchOptions = SearchOptions(), store: bool = False, id_col: str = "block_id", text_col: str = "text", size: Callable[[Column], Column] = utf16_length) -> DataFrame:
    """(block_id, result): shortened grep output; a block without results or one that wouldn't shrink by size keeps its text."""
    base = blocks.select(F.col(id_col).alias("block_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hint = retrieve_hint(content_key(F.col("text"))) if store else F.lit("")
    matches = parse_search(explode_lines(base))
    kept = select_matches(matches, options)
    files = kept.groupBy("block_id", "file").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("line_no", "place", "raw"))).alias("rows"))
    totals = matches.groupBy("block_id").agg(F.countDistinct("file").alias("files"))
    picked = files.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("file", "n", "rows"))).alias("picked"))
    done = base.select("block_id", hint.alias("hint")).join(picked, "block_id").join(totals, "block_id")
    line = lambda *parts: F.concat(F.lit("[... "), *parts, F.col("hint"), F.lit("]"))
    none = F.expr("cast(array() as array<string>)")
    body = F.flatten(F.transform("picked", lambda p: F.concat(p["rows"]["raw"], F.when(p["n"] > F.size(p["rows"]), F.array(line((p["n"] - F.size(p["rows"])).cast("string"), F.lit(" more matches in "), p["file"]))).otherwise(none))))
    left = F.col("files") - F.size("picked")
    tail = F.when(left > 0, F.array(line(left.cast("string"), F.lit(" more files with matches omitted")))).otherwise(none)
    done = done.select("block_id", F.array_join(F.concat(body, tail), "\n").alias("result"))
    shorter = F.col("result").isNotNull() & (size(F.col("result")) < size(F.col("text")))
    return base.join(done, "block_id", "left").select("block_id", F.when(shorter, F.col("result")).otherwise(F.col("text")).alias("result"))
