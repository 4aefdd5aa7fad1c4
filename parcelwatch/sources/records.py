"""CSV records, read by many tasks whatever the size of a file.

A cell that starts with a quote may hold line breaks, so a line can end inside a cell. Lines are
read from the middle of files by any task, and each says by itself where it would end: the state
after it if it starts outside a quoted cell, and if it starts inside one. Lines whose two answers
agree fix the state, the others keep or flip it. Chained by running counts within a block (at most
`spark.sql.files.maxPartitionBytes`), and by one row per block across a file, that gives the
state before every line; a line that starts outside a cell starts a record. Quotes inside an
unquoted cell are plain text.

Files in which no line ends inside a cell need none of this: every line is a record.
`read_lines` takes that for granted and counts what would tell otherwise while the lines pass by;
`read_records` looks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = ("file", "block")

# Possessive repeats: a line is looked at once, however long.
_INSIDE = '(?:[^"]++|"")*+'
_CELL = f'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPENS = f'^(?:{_CELL},)*+"{_INSIDE}$'
_STAYS = f"^{_INSIDE}$"
_REOPENS = f'^{_INSIDE}"[^,]*+,(?:{_CELL},)*+"{_INSIDE}$'


def _unended(value: str) -> Column:
    """A line without the CR it may end in; the pattern is tried on lines that hold one only."""
    line = F.col(value)
    return F.when(F.contains(line, F.lit("\r")), F.regexp_replace(line, r"\r$", "")).otherwise(line)


def _opens(line: Column) -> Column:
    """Whether a line that starts outside a cell ends inside one; without a quote it cannot."""
    return F.contains(line, F.lit('"')) & line.rlike(_OPENS)


def _stays(line: Column) -> Column:
    """Whether a line that starts inside a cell ends inside one; without a quote it does."""
    return ~F.contains(line, F.lit('"')) | line.rlike(_STAYS) | line.rlike(_REOPENS)


def read_lines(spark: SparkSession, paths: Sequence[str], head: str, seen: Observation) -> DataFrame:
    """One row per line that is not empty: `text` and `file`; `head`, the first line of each, is left out.

    Right if `seen` finds no line that `opens` a cell it does not end, and as many `heads` as files.
    """
    lines = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        _unended("value").alias("text"),
    )
    is_head = (F.col("block") == 0) & F.col("text").isin(head, "\ufeff" + head)
    lines = lines.withColumns({"opens": _opens(F.col("text")), "is_head": is_head})
    lines = lines.observe(seen, F.count_if(F.col("opens")).alias("opens"), F.count_if(F.col("is_head")).alias("heads"))
    return lines.filter("NOT opens AND NOT is_head AND text != ''").select("text", "file")


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per record that is not empty: its `text`, its `file`, and whether it heads that.

    A file that ends inside a quoted cell is refused.
    """
    raw = _unended("value")
    lines = (
        spark.read.text(list(paths), lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
            _opens(raw).alias("opens"),
        )
        .withColumn("line", F.monotonically_increasing_id())
    )
    if lines.filter("opens").isEmpty():
        first = lines.filter("block = 0").groupBy("file").agg(F.min("line").alias("first"))
        heads = lines.join(first, ["file"], "left")
        return _records(heads.select("value", "file", (F.col("line") == F.col("first")).alias("header")))
    return _joined(lines.withColumn("stays", _stays(raw)))


def _records(found: DataFrame) -> DataFrame:
    text = _unended("value")
    head = F.coalesce("header", F.lit(False)).alias("header")
    return found.select(text.alias("text"), "file", head).filter("text != ''")


def _joined(lines: DataFrame) -> DataFrame:
    """Records of lines that may end inside a cell."""
    so_far = Window.partitionBy(*BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(so_far)
    lines = lines.withColumn("flips", flips)
    fixed = F.when(F.col("opens") == F.col("stays"), F.struct("opens", "flips"))
    lines = lines.withColumn("fixed", F.last(fixed, ignorenulls=True).over(so_far))
    lines = lines.join(_inside_before(lines), list(BLOCK))
    after = _state(F.col("fixed"), F.col("flips"), F.col("inside"))
    order = Window.partitionBy(*BLOCK).orderBy("line")
    before = F.coalesce(F.lag(after).over(order), F.col("inside"))
    lines = lines.withColumn("starts", (~before).cast("int"))
    lines = lines.withColumn("record", F.sum("starts").over(so_far))
    lines = lines.join(_open_record(lines), list(BLOCK), "left")

    continued = F.col("record") == 0  # the record began in an earlier block
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    found = lines.groupBy(
        "file",
        F.when(continued, F.col("open.block")).otherwise(F.col("block")).alias("start"),
        F.when(continued, F.col("open.record")).otherwise(F.col("record")).alias("number"),
    ).agg(F.array_join(pieces.getField("value"), "\n").alias("value"))
    header = (F.col("start") == 0) & (F.col("number") == 1)
    return _records(found.select("value", "file", header.alias("header")))


def _state(fixed: Column, flips: Column, start: Column) -> Column:
    """Whether a line ends inside a cell: from the last line that fixed it, or from the start."""
    known = fixed["opens"] != ((flips - fixed["flips"]) % 2 == 1)
    return F.when(fixed.isNotNull(), known).otherwise(start != (flips % 2 == 1))


def _inside_before(lines: DataFrame) -> DataFrame:
    """Per block, whether it starts inside a cell; refuses files that end in one."""
    last = F.max_by(F.struct("fixed", "flips"), "line").alias("last")
    blocks = lines.groupBy(*BLOCK).agg(last)
    # a block either fixes the state or keeps or flips it, like a line
    fixes = F.col("last.fixed").isNotNull()
    ends = _state(F.col("last.fixed"), F.col("last.flips"), F.lit(False))
    flipped = (~fixes & (F.col("last.flips") % 2 == 1)).cast("int")
    file = Window.partitionBy("file").orderBy("block")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("flips", F.sum(flipped).over(upto))
    fixed = F.when(fixes, F.struct(ends.alias("opens"), "flips"))
    blocks = blocks.withColumn("fixed", F.last(fixed, ignorenulls=True).over(upto))
    after = _state(F.col("fixed"), F.col("flips"), F.lit(False))
    blocks = blocks.withColumn("after", after)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(0, Window.unboundedFollowing)
    refused = F.raise_error(F.concat(F.lit("a quoted value has no end: "), "file"))
    inside = F.coalesce(F.lag("after").over(file), F.lit(False))
    ended = F.last("after").over(whole)
    return blocks.select(*BLOCK, F.when(~ended, inside).otherwise(refused.cast("boolean")).alias("inside"))


def _open_record(lines: DataFrame) -> DataFrame:
    """Per block, the last record that began in an earlier block of its file."""
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = lines.groupBy(*BLOCK).agg(F.max("record").alias("record"))
    begun = F.when(F.col("record") > 0, F.struct("block", "record"))
    return blocks.select(*BLOCK, F.last(begun, ignorenulls=True).over(earlier).alias("open"))
