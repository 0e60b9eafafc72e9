"""Unified diffs: segmentation into files and hunks by running counts, ranking by change density, context trimming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import content_key, is_blank, lines_of, retrieve_hint, utf16_length
from lucerna.operators.logs import explode_lines

#: File headers, hunk headers, and file headers of diffs that have no "diff --git" line.
FILE_LINE = r"^diff --git "
HUNK_LINE = r"^@@+ -?\d+(?:,\d+)? (?:-?\d+(?:,\d+)? )*\+?\d+(?:,\d+)? @@+"
PLAIN_HEADER = r"(?:diff --git |--- a/|\+\+\+ b/|index [0-9a-f]+\.\.[0-9a-f]+)"


@dataclass(frozen=True)
class DiffOptions:
    max_context_lines: int = 3
    max_hunks_per_file: int = 10
    max_files: int = 10


def is_change(line: Column) -> Column:
    return (line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))


def segment_diff(lines: DataFrame) -> DataFrame:
    """Lines with file_id and hunk_id (0: the file's header), at (0-based within the hunk, null for its header) and is_change."""
    order = Window.partitionBy("block_id").orderBy("idx")
    rows = lines.withColumn("file_id", F.sum(F.col("content").rlike(FILE_LINE).cast("int")).over(order)).filter("file_id > 0")
    in_file = Window.partitionBy("block_id", "file_id").orderBy("idx")
    head = F.col("content").rlike(HUNK_LINE)
    rows = rows.withColumn("is_header", head).withColumn("hunk_id", F.sum(head.cast("int")).over(in_file))
    in_hunk = Window.partitionBy("block_id", "file_id", "hunk_id").orderBy("idx")
    at = F.when(~F.col("is_header") & (F.col("hunk_id") > 0), F.row_number().over(in_hunk) - 2)
    return rows.withColumn("at", at).withColumn("is_change", at.isNotNull() & is_change(F.col("content"))).drop("is_header")


def density(segmented: DataFrame) -> DataFrame:
    """(block_id, file_id, hunk_id, changes) a hunk."""
    return segmented.filter("hunk_id > 0").groupBy("block_id", "file_id", "hunk_id").agg(F.sum(F.col("is_change").cast("int")).alias("changes"))


def trim_hunks(segmented: DataFrame, context: int = 3, heads: bool = False) -> DataFrame:
    """(block_id, file_id, hunk_id, changes, lines): each hunk's lines with at most context lines around its changes.

    heads: a row of hunk 0 for each file's header too, and its lines as head (idx, content).
    """
    n = F.sum(F.col("at").isNotNull().cast("int"))
    changed = F.when(F.col("is_change"), F.col("at"))
    head = [F.sort_array(F.collect_list(F.when(F.col("hunk_id") == 0, F.struct("idx", "content")))).alias("head")] if heads else []
    hunks = (segmented if heads else segmented.filter("hunk_id > 0")).groupBy("block_id", "file_id", "hunk_id").agg(*head, n.alias("n"), F.min(changed).alias("f"), F.max(changed).alias("l"), F.sum(F.col("is_change").cast("int")).alias("changes"), F.max(F.when(F.col("at").isNull(), F.col("content"))).alias("header"), F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "content")))).alias("rows"))
    start, end = F.greatest(F.col("f") - context, F.lit(0)), F.least(F.col("l") + context, F.col("n") - 1)
    # a dropped run is announced as one more than it has
    note = lambda dropped: F.when(dropped > 0, F.array(F.concat(F.lit("[... "), (dropped + 1).cast("string"), F.lit(" context lines dropped]")))).otherwise(F.expr("cast(array() as array<string>)"))
    kept = F.transform(F.slice("rows", (start + 1).cast("int"), (end - start + 1).cast("int")), lambda r: r["content"])
    body = F.concat(note(start), kept, note(F.col("n") - 1 - end))
    bare = F.when(F.col("n") > 0, F.array(F.concat(F.lit("[... "), F.col("n").cast("string"), F.lit(" context-only lines dropped]")))).otherwise(F.expr("cast(array() as array<string>)"))
    return hunks.select("block_id", "file_id", "hunk_id", "changes", F.concat(F.array("header"), F.when(F.col("f").isNull(), bare).otherwise(body)).alias("lines"), *([F.when(F.col("hunk_id") == 0, F.col("head")).alias("head")] if heads else []))


def plain_diffs(blocks: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """(block_id, result) of diffs without file lines (block_id, text, hint), whatever their length.

    Of each run of context lines the first ones stay, of each file's hunks the first ones; what goes is announced in
    front of the next line that stays or hunk that starts, as one line more than it has.
    """
    o, order = options, Window.partitionBy("block_id").orderBy("idx")
    so_far = lambda flag, window: F.sum(flag.cast("int")).over(window)
    line = F.col("content")
    rows = explode_lines(blocks).withColumn("is_file", line.rlike("^" + PLAIN_HEADER))
    rows = rows.withColumn("is_hunk", ~F.col("is_file") & line.rlike(HUNK_LINE)).withColumn("file_id", so_far(F.col("is_file"), order))
    hunk = so_far(F.col("is_hunk"), Window.partitionBy("block_id", "file_id").orderBy("idx"))
    rows = rows.withColumn("hunk_id", hunk).withColumn("inside", ~F.col("is_file") & F.col("hunk_id").between(1, o.max_hunks_per_file))
    context = ~F.col("is_file") & ~F.col("is_hunk") & ~line.rlike(r"^[+-]") & (line.startswith(" ") | is_blank(line))
    rows = rows.withColumn("is_context", context).withColumn("run", so_far(~F.col("is_context"), order))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("block_id", "run", "is_context").orderBy("idx")))
    kept = F.col("is_file") | (F.col("inside") & (~F.col("is_context") | (F.col("nth") <= o.max_context_lines)))
    rows = rows.withColumn("kept", kept).withColumn("told", F.col("kept") | F.col("is_hunk"))
    # the lines that go up to the next one that is told of, and that one
    rows = rows.withColumn("part", F.coalesce(so_far(F.col("told"), order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = rows.groupBy("block_id", "part").agg(F.sum((~F.col("told")).cast("int")).alias("gone"), F.max(F.when(F.col("kept"), line)).alias("line"))
    parts = parts.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("part", "gone", "line"))).alias("parts")).join(blocks.select("block_id", "hint"), "block_id")
    note = lambda x: F.when(x["gone"] > 0, F.concat(F.lit("[... "), (x["gone"] + 1).cast("string"), F.lit(" context lines dropped"), F.col("hint"), F.lit("]")))
    lines = F.flatten(F.transform("parts", lambda x: F.array_compact(F.array(note(x), x["line"]))))
    return parts.select("block_id", F.array_join(lines, "\n").alias("result"))


def top_hunks(hunks: DataFrame, most: int) -> DataFrame:
    """Hunks (block_id, file_id, hunk_id, changes) with n (of the file) and place: those of most changes where there are too many. Hunk 0 stays."""
    per_file = Window.partitionBy("block_id", "file_id", F.col("hunk_id") > 0)
    hunks = hunks.withColumn("n", F.count("*").over(per_file)).withColumn("all_changes", F.sum("changes").over(per_file))
    place = F.when(F.col("n") > most, F.row_number().over(per_file.orderBy(F.col("changes").desc(), "hunk_id"))).otherwise(F.col("hunk_id"))
    return hunks.withColumn("place", place).filter(F.col("place") <= most)


def top_files(files: DataFrame, most: int) -> DataFrame:
    """Files (block_id, file_id, changes) with n (of the block) and rank: those of most changes where there are too many."""
    per_block = Window.partitionBy("block_id")
    files = files.withColumn("n", F.count("*").over(per_block))
    rank = F.when(F.col("n") > most, F.row_number().over(per_block.orderBy(F.coalesce("changes", F.lit(0)).desc(), "file_id"))).otherwise(F.col("file_id"))
    return files.withColumn("rank", rank).filter(F.col("rank") <= most)


def compress_diffs(blocks: DataFrame, options: DiffOptions = DiffOptions(), store: bool = False, id_col: str = "block_id", text_col: str = "text", size: Callable[[Column], Column] = utf16_length) -> DataFrame:
    """(block_id, result): shortened diffs; a block of under five lines or one that wouldn't shrink by size keeps its text."""
    o = options
    base = blocks.select(F.col(id_col).alias("block_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("hint", retrieve_hint(content_key(F.col("text"))) if store else F.lit(""))
    long = base.filter(F.size(lines_of(F.col("text"))) >= 5)
    has_files = F.col("text").rlike(r"(?:\A|\n)diff --git ")

    rows = segment_diff(explode_lines(long.filter(has_files)))
    # headers go with the hunks, so that a block's lines are grouped in place and no join moves them
    hunks = top_hunks(trim_hunks(rows, o.max_context_lines, heads=True), o.max_hunks_per_file)
    own = lambda c: F.max(F.when(F.col("hunk_id") > 0, F.col(c))).alias(c)
    placed = F.sort_array(F.collect_list(F.when(F.col("hunk_id") > 0, F.struct("place", "lines"))))
    bodies = hunks.groupBy("block_id", "file_id").agg(F.first("head", ignorenulls=True).alias("head"), own("n"), own("all_changes"), F.flatten(F.transform(placed, lambda h: h["lines"])).alias("body"))
    files = top_files(bodies.withColumnsRenamed({"n": "hunks", "all_changes": "changes"}), o.max_files)
    blocks_ = files.groupBy("block_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "head", F.coalesce("body", F.expr("cast(array() as array<string>)")).alias("body"), F.coalesce("hunks", F.lit(0)).alias("hunks")))).alias("files"))
    done = blocks_.join(long.select("block_id", "hint"), "block_id")
    none = F.expr("cast(array() as array<string>)")
    hinted = lambda line: F.when(line.startswith("[... ") & (F.instr(line, "]") > 0), F.concat(F.substring_index(line, "]", 1), F.col("hint"), F.substr(line, F.instr(line, "]")))).otherwise(line)
    note = lambda n, what: F.when(n > 0, F.array(F.concat(F.lit("[... "), n.cast("string"), F.lit(f" {what} omitted"), F.col("hint"), F.lit("]")))).otherwise(none)
    one = lambda f: F.concat(F.transform(f["head"], lambda h: h["content"]), F.transform(f["body"], hinted), note(f["hunks"] - o.max_hunks_per_file, "hunks"))
    structured = done.select("block_id", F.array_join(F.concat(F.flatten(F.transform("files", one)), note(F.col("n") - F.size("files"), "files")), "\n").alias("result"))

    others = plain_diffs(long.filter(~has_files), o)
    found = structured.unionByName(others)
    shorter = F.col("result").isNotNull() & (size(F.col("result")) < size(F.col("text")))
    return base.join(found, "block_id", "left").select("block_id", F.when(shorter, F.col("result")).otherwise(F.col("text")).alias("result"))
