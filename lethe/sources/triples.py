"""Triple files: CSV with subjectLabel, relation and objectLabel.

A file may be read by many tasks although its quoted fields hold line breaks.
Every physical line is a function of one bit: whether it ends inside a quoted
field, given that it starts outside or inside of one.  Such functions compose,
so a range of a file is one function as well; composed over the ranges of a
file, in order, they tell how each range, and then each line, starts.  Lines
that start outside of quotes start a record.  Files in which no line leaves a
field open need none of this, and their lines are parsed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe import schemas
from lethe.operators.order import placed
from lethe.operators.triples import FIELDS
from lethe.session import materialise

FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
MISSING, LONG_ROW, OPEN_QUOTE, NOTHING = "missing columns", "row with more fields than the header", "quote is never closed", "empty or unreadable"
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', **FILES}
RANGES = "spark.sql.files.maxPartitionBytes"
RANGES_AT_ONCE, SESSION_RANGE = 512, 1 << 27  # the latter is Spark's own default

# A field with its separator: quoted (with "" for a quote), then up to the next comma, or plain.
QUOTED = r'"(?:[^"]++|"")*+'
FIELD = rf',(?:{QUOTED}"[^,]*+|{QUOTED}$|[^,"][^,]*+|)'
# Lines after which a quoted field is open, for a start outside and inside of one.
OPEN_OUTSIDE = rf'^(?:{QUOTED}"[^,]*+,|[^,"][^,]*+,|,)*+{QUOTED}$'
OPEN_INSIDE = rf'^(?:[^"]++|"")*+(?:$|"[^,]*+,(?:{QUOTED}"[^,]*+,|[^,"][^,]*+,|,)*+{QUOTED}$)'
LONGEST = 2**28  # characters of a record; a longer one can only be an unclosed quote


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_uniform(spark: SparkSession, root: str) -> DataFrame:
    """One pass over files known to share the standard header."""
    cells = spark.read.schema(schemas.TRIPLE).options(**CSV_OPTIONS).csv(root)
    return placed(cells, *FIELDS).withColumn("source", base_name(F.col("file_path")))


# ---------------------------------------------------------------- records


def _start_states(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add `known` and `turned` for rows that are functions of one bit.

    `if_out` and `if_in` are the results for a start outside and inside.  A row
    with equal results fixes the state, one with opposite results may turn it, so
    the state before a row follows from the last row that fixed it and from the
    turns since then: it is `known`, or else the state before all rows, reversed
    if `turned`.
    """
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (F.col("if_out") & ~F.col("if_in")).cast("int")
    counted = df.withColumn("_turns", F.sum(turns).over(upto))
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_out").alias("to"), F.col("_turns").alias("at")))
    before = counted.withColumn("_fixed", fixed)
    before = before.withColumn("_last", F.last("_fixed", ignorenulls=True).over(rows)).withColumn("_seen", F.coalesce(F.lag("_turns").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0)))
    odd = (F.col("_seen") - F.coalesce("_last.at", F.lit(0))) % 2 == 1
    known = F.when(F.col("_last").isNotNull(), F.col("_last.to") != odd)
    return before.withColumn("known", known).withColumn("turned", odd).drop("_turns", "_fixed", "_last", "_seen")


def _state(entering: Column) -> Column:
    return F.coalesce("known", entering != F.col("turned"))


def _whole_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, too_long): records of files whose quoted fields hold line breaks,
    each placed at its first line, and the places of records beyond `LONGEST`."""
    block, place = ["file_path", "block_start"], ["file_path", "block_start", "row_in_block"]
    relative = materialise(_start_states(lines, block, "row_in_block"), "csv-lines")
    last = F.max_by(F.struct("known", "turned", "if_out", "if_in"), "row_in_block").alias("last")
    blocks = relative.groupBy(*block).agg(last).select(*block, "last.*")

    def after(entering: bool) -> Column:
        return F.when(_state(F.lit(entering)), F.col("if_in")).otherwise(F.col("if_out"))

    # a block is one function too; a file has one row per block here
    composed = blocks.select(*block, after(False).alias("out"), after(True).alias("in")).select(*block, F.col("out").alias("if_out"), F.col("in").alias("if_in"))
    entering = _start_states(composed, ["file_path"], "block_start").select(*block, _state(F.lit(False)).alias("entering"))
    stated = relative.join(entering, block).withColumn("inside", _state(F.col("entering"))).drop("known", "turned", "entering")
    in_block = Window.partitionBy(*block).orderBy("row_in_block")
    first = F.last(F.when(~F.col("inside"), F.col("row_in_block")), ignorenulls=True).over(in_block)
    stated = materialise(stated.withColumn("first", first).withColumn("next_inside", F.lead("inside").over(in_block)), "csv-states")
    # lines before the first start of their block continue a record of an earlier block
    starts = stated.groupBy(*block).agg(F.max("first").alias("first"))
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("first").isNotNull(), F.struct(F.col("block_start").alias("block"), F.col("first").alias("row")))
    carried = starts.select(*block, F.last(start, ignorenulls=True).over(earlier).alias("carried"))
    single = ~F.col("inside") & (F.col("next_inside") == F.lit(False))
    parts = stated.where(~F.coalesce(single, F.lit(False))).join(carried, block)
    parts = parts.select(
        "file_path",
        F.when(F.col("first").isNotNull(), F.col("block_start")).otherwise(F.col("carried.block")).alias("block"),
        F.coalesce("first", "carried.row").alias("row"),
        F.struct("block_start", "row_in_block", "line").alias("part"),
    )
    key = ["file_path", "block", "row"]
    too_long = parts.groupBy(*key).agg(F.sum(F.length("part.line")).alias("size")).where(F.col("size") > LONGEST).select(*key)
    joined = parts.join(too_long, key, "left_anti").groupBy(*key).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    record = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    renamed = [F.col("file_path"), F.col("block").alias("block_start"), F.col("row").alias("row_in_block")]
    records = joined.select(*renamed, record.alias("line")).unionByName(stated.where(single).select(*place, "line"))
    return records, too_long.select(*renamed)


# ---------------------------------------------------------------- fields


def _fields(record: Column) -> Column:
    """All fields of a record, each behind its comma."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(0))


def _value(field: Column) -> Column:
    """A field's text: null where nothing stands, without the quotes around it."""
    text = F.substr(field, F.lit(2))
    plain = F.replace(F.regexp_replace(text, rf'^"((?:[^"]++|"")*+)"?', "$1"), F.lit('""'), F.lit('"'))
    return F.when(text.startswith('"'), plain).when(text != "", text)


def _header(record: Column) -> Column:
    """Places of the wanted columns (null unless all are there) and the width of a header."""
    names = F.transform(_fields(record), lambda f: F.regexp_replace(F.coalesce(_value(f), F.lit("")), r'^[﻿\r" ]+|[﻿\r" ]+$', ""))
    places = F.array(*[F.array_position(names, f).cast("int") for f in FIELDS])
    width = F.array_max(F.transform(names, lambda n, i: F.when(n != "", i + 1).otherwise(0)))
    return F.struct(F.when(~F.array_contains(places, 0), places).alias("places"), width.alias("width"))


@contextmanager
def _range_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    before = spark.conf.get(RANGES)
    if size:
        spark.conf.set(RANGES, str(size))
    try:
        yield
    finally:
        spark.conf.set(RANGES, before)


def scan_triples(spark: SparkSession, root: str | list[str], range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of all CSV files below `root`, a folder or a list of files, whose
    columns are found by name.

    Records may hold line breaks and headers any number of columns, of which only
    the wanted ones are kept.  Large files are read in ranges of the session's
    size, or of `range_bytes`, cut anywhere.  What was read is stored and both
    results come from there.  `skipped` (file_path, reason) names files without
    the required columns, empty and unreadable ones, and each record with more
    fields than its header or with a quote that is never closed; a record with
    fewer fields has nulls.  A line break inside of a field is given as a line
    feed, and blank records are left out.
    """
    with _range_size(spark, range_bytes):
        stored, too_long = _read(spark, root)
    rows = stored.where("problem IS NULL").select(*FIELDS, "file_path", "block_start", "row_in_block", base_name(F.col("file_path")).alias("source"))
    # scans leave empty files out; only the listing that Spark itself keeps for a scan has them
    listed = list_files(spark, root).select(_one_spelling(F.col("path")).alias("file_path"))
    wrong = stored.where("problem IS NOT NULL").select(_one_spelling(F.col("file_path")).alias("file_path"), F.col("problem").alias("reason"))
    if too_long is not None:
        wrong = wrong.unionByName(too_long.select(_one_spelling(F.col("file_path")).alias("file_path"), F.lit(OPEN_QUOTE).alias("reason")))
    # a header is stored as a row without fields, so that a file with nothing else is not taken for an empty one
    read = wrong.where(F.col("reason") == "").select("file_path").distinct()
    unread = listed.join(read, "file_path", "left_anti").withColumn("reason", F.lit(NOTHING))
    return rows, wrong.where(F.col("reason") != "").unionByName(unread)


def range_size(spark: SparkSession, root: str | list[str], least: int) -> int:
    """Bytes of a range, so that all files make about `RANGES_AT_ONCE` of at least `least`.

    The driver hears of every range: more ranges than that tell it more and gain
    nothing, until they are as large as Spark's own.
    """
    total = spark.read.format("binaryFile").options(**FILES).load(root).agg(F.sum("length")).first()[0] or 0
    return max(least, min(total // RANGES_AT_ONCE, SESSION_RANGE))


def list_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(path) of all CSV files, as the listing of a scan has them; none is opened."""
    return spark.createDataFrame([(f,) for f in spark.read.options(**FILES).text(root).inputFiles()], "path string")


def _read(spark: SparkSession, root: str | list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(stored, too_long): every record with its fields and what is wrong with it."""
    place = ["file_path", "block_start", "row_in_block"]
    lines = placed(spark.read.options(**FILES).text(root), F.col("value").alias("line"))
    # a byte order mark stands before the first field, which may be quoted
    lines = lines.withColumn("line", F.when(F.col("block_start") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")))
    opens = F.col("line").contains('"') & F.col("line").rlike(OPEN_OUTSIDE)
    files = materialise(lines.groupBy("file_path").agg(F.bool_or(opens).alias("broken")), "csv-files")
    records, too_long = lines.join(files.where("NOT broken").select("file_path"), "file_path", "left_semi"), None
    if not files.where("broken").isEmpty():
        inside = ~F.col("line").contains('"') | F.col("line").rlike(OPEN_INSIDE)
        some = lines.join(files.where("broken").select("file_path"), "file_path", "left_semi")
        whole, too_long = _whole_records(some.withColumn("if_out", opens).withColumn("if_in", inside))
        records = records.unionByName(whole)
    records = records.where(F.trim("line") != "")
    # the first record of a file is its header
    first = records.groupBy("file_path").agg(F.min(F.struct("block_start", "row_in_block")).alias("head"))
    first_lines = records.join(first.select(F.col("file_path"), F.col("head.block_start"), F.col("head.row_in_block")), place)
    heads = materialise(first_lines.select(*place, _header(F.col("line")).alias("header")), "csv-headers")
    named = records.join(heads.select("file_path", F.col("header.places").alias("places"), F.col("header.width").alias("width"), *[F.col(x).alias(f"head_{x}") for x in place[1:]]), "file_path")
    body = named.where("block_start <> head_block_start OR row_in_block <> head_row_in_block").where("places IS NOT NULL")
    fields = body.withColumn("fields", _fields(F.col("line")))
    beyond = F.exists(F.slice("fields", F.col("width") + 1, F.greatest(F.size("fields") - F.col("width"), F.lit(0))), lambda f: f != ",")
    unclosed = F.col("line").contains('"') & F.col("line").rlike(OPEN_OUTSIDE)
    problem = F.when(unclosed, OPEN_QUOTE).when(beyond, LONG_ROW)
    values = [_value(F.get("fields", F.col("places")[i] - 1)).alias(f) for i, f in enumerate(FIELDS)]
    parsed = fields.select(*values, *place, problem.alias("problem"))
    empty = [F.lit(None).cast("string").alias(f) for f in FIELDS]
    reports = F.explode(F.when(F.col("header.places").isNull(), F.array(F.lit(""), F.lit(MISSING))).otherwise(F.array(F.lit("")))).alias("problem")
    return materialise(parsed.unionByName(heads.select(*empty, *place, reports)), "triples"), too_long


def _one_spelling(path: Column) -> Column:
    """Local paths are listed with one slash and tagged with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")
