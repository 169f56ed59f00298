"""CSV records of files that are read in splits, also where line breaks stand inside quoted fields.

A line is a function of two states: whether it ends inside a quoted field if it begins outside one, and if it begins inside
one. Such functions compose, so the state in which every piece of a split begins follows from one function per piece, combined
in the order of the pieces, and the state before a line from the lines of its own piece. A record begins with every line that
begins outside a quoted field. Only the lines of pieces that hold records broken over several lines are grouped; all others
are records as they stand. Lines lie stored in parts of a split, and pieces are looked at where they lie: what is shuffled is
a row per piece, and the lines of records that lie in several pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlake.session import stored_bytes

# A field in quotes with its tail up to the comma, or one that does not begin with a quote; a field that stays open.
_BLANK, _TEXT = r"[ \t]*+", r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_BLANK}"{_TEXT}"[^,]*+|{_BLANK}(?!")[^,]*+)'
_OPEN = rf'(?:{_FIELD},)*+{_BLANK}"{_TEXT}\z'
ENDS_INSIDE_FROM_OUTSIDE = rf"\A{_OPEN}"
ENDS_INSIDE_FROM_INSIDE = rf'\A{_TEXT}(?:\z|"[^,]*+,{_OPEN})'

#: So many lines of a task, as a power of two, lie together in a stored file, however large the files are that tasks read.
PART_BITS = 18
#: So many of them are looked at together; a piece also ends with its split.
PIECE_BITS = 16
PIECE = ["part", "piece", "file", "block"]
#: Bytes of input per bucket of stored lines. Parts meet in buckets by chance, so there are more buckets than parts.
INPUT_PER_BUCKET = 4 << 20


def numbered_lines(text: DataFrame) -> DataFrame:
    """Lines of a text source with their file, split, number, part and piece, and the two states in which they may end.

    Numbers of a split's lines are consecutive; they only hold for one execution, so write the result before using it twice.
    """
    quotes = F.col("value").contains('"')
    lines = text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )
    return lines.select(
        *lines.columns, F.shiftright("n", PART_BITS).alias("part"), F.shiftright("n", PIECE_BITS).alias("piece"),
        (quotes & F.col("value").rlike(ENDS_INSIDE_FROM_OUTSIDE)).alias("opens"),
        (~quotes | F.col("value").rlike(ENDS_INSIDE_FROM_INSIDE)).alias("stays"),
    )


def _composed(order: Window) -> tuple[Column, Column]:
    """The functions up to and with the current row as one: the state after it, begun outside and begun inside.

    A function with one outcome settles the state; after it, only changes of state count.
    """
    constant, change = F.col("opens") == F.col("stays"), F.col("opens") & ~F.col("stays")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changes = F.sum(F.when(change, 1).otherwise(0)).over(upto)
    settled = F.last(F.when(constant, F.col("opens")), ignorenulls=True).over(upto)
    before = F.last(F.when(constant, F.col("changes")), ignorenulls=True).over(upto)
    return changes, _state(settled, before)


def _state(settled: Column, before: Column) -> Column:
    odd = (F.col("changes") - F.coalesce(before, F.lit(0))) % 2 == 1
    return F.struct(
        (F.coalesce(settled, F.lit(False)) != odd).alias("opens"), (F.coalesce(settled, F.lit(True)) != odd).alias("stays")
    )


def _with_state(rows: DataFrame, order: Window) -> DataFrame:
    """``rows`` with ``upto``, the functions of all rows up to and with each composed."""
    changes, state = _composed(order)
    return rows.withColumn("changes", changes).withColumn("upto", state).drop("changes")


def splits(lines: DataFrame) -> DataFrame:
    """One row per piece: its lines, whether it begins and ends inside a quoted field, and where its records meet others'.

    ``busy``: a record of several lines lies in it, at least in part. ``closes``: the line that ends what the piece begins
    inside of, NULL if none does; ``record``: the line at which that record begins. ``opened``: the line at which the record
    begins that the piece leaves open, NULL if it began in an earlier piece.
    """
    inside = Window.partitionBy(*PIECE).orderBy("n")
    events = lines.where("opens OR NOT stays").select(*PIECE, "n", "opens", "stays")
    known = _with_state(events, inside).withColumn("before", F.lag("upto").over(inside))
    outside = F.max(F.when(~F.coalesce("before.opens", F.lit(False)) & F.col("upto.opens"), F.col("n")))
    within = F.max(F.when(~F.coalesce("before.stays", F.lit(True)) & F.col("upto.stays"), F.col("n")))
    last = known.groupBy(*PIECE).agg(
        F.max_by("upto", "n").alias("all"), F.max("opens").alias("any"), F.min(F.when(~F.col("stays"), F.col("n"))).alias("closes"),
        outside.alias("outside"), within.alias("within"),
    )
    ends = lines.groupBy(*PIECE).agg(F.min("n").alias("first"), F.max("n").alias("last"))
    both = ends.join(last, PIECE, "left").select(
        *PIECE, "first", "last", "any", "closes", "outside", "within", F.coalesce("all.opens", F.lit(False)).alias("opens"),
        F.coalesce("all.stays", F.lit(True)).alias("stays"),
    )
    order = Window.partitionBy("file").orderBy("block", "first")  # a row per piece of a file
    known = _with_state(both, order).withColumn("begins", F.coalesce(F.lag("upto.opens").over(order), F.lit(False)))
    known = known.withColumn("ends", F.col("upto.opens"))
    known = known.withColumn("opened", F.when(F.col("ends"), F.when(F.col("begins"), F.col("within")).otherwise(F.col("outside"))))
    record = F.last("opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return known.select(
        *PIECE, "first", "last", "begins", "ends", "closes", "opened", F.when(F.col("begins"), record).alias("record"),
        (F.col("begins") | F.coalesce("any", F.lit(False))).alias("busy"),
    )


def _glued(lines: DataFrame, *record: str, order: tuple[str, ...]) -> DataFrame:
    """One row per record: its lines in order, and the number of the first."""
    text = F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    return lines.groupBy(*record).agg(F.concat_ws("\n", text).alias("value"), F.min_by("n", F.struct(*order)).alias("begin")).select(
        "value", F.col("begin").alias("n")
    )


def records(lines: DataFrame, scratch: str) -> DataFrame:
    """(value): the records below the header of every file, line breaks inside them as they were.

    ``lines``: stored ``numbered_lines``. A file that ends inside a quoted field is refused. Blank lines between records are
    no records; the first record of a file is its header. Lines that ``stored_lines`` keeps are not shuffled, but for those
    of records that lie in several pieces.
    """
    spark = lines.sparkSession
    filled = F.trim("value") != ""
    header = lines.where(filled).groupBy("file").agg(F.min(F.struct("block", "n")).alias("at")).select(F.col("at.n").alias("n"))
    if lines.where("opens").isEmpty():
        return lines.where(filled).join(F.broadcast(header), "n", "left_anti").select("value")  # a row per file
    splits(lines).write.parquet(f"{scratch}/splits")
    blocks = spark.read.parquet(f"{scratch}/splits")
    open_ = blocks.groupBy("file").agg(F.max_by("ends", F.struct("block", "first")).alias("open")).where("open").select("file").first()
    if open_:
        raise ValueError(f"{open_[0]}: ends inside a quoted field")
    busy = blocks.where("busy")  # at most a row per piece
    whole = lines.join(F.broadcast(busy.select(*PIECE)), PIECE, "left_anti").select("value", "n")
    # What a piece begins inside of and what it leaves open belong to records that lie in several pieces.
    head, tail = F.expr("begins AND n <= coalesce(closes, last)"), F.expr("n >= opened")
    known = lines.join(F.broadcast(busy), PIECE).withColumn("seam", F.when(head, F.col("record")).when(tail, F.col("opened")))
    across = _glued(known.where("seam IS NOT NULL").select("seam", "block", "n", "value"), "seam", order=("block", "n"))
    # All other lines of the piece, which its first line names, are whole records; the first of them begins outside.
    rest = known.where("seam IS NULL").select("part", "first", "n", "value", "opens", "stays")
    inside = Window.partitionBy("part", "first").orderBy("n")
    ended = F.max(F.when(~F.col("upto.opens"), F.col("n"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rest = _with_state(rest, inside).select("part", "first", "n", "value", ended.alias("ended"))
    every = whole.unionByName(_glued(rest, "part", "first", "ended", order=("n",))).unionByName(across).where(filled)
    return every.join(F.broadcast(header), "n", "left_anti").select("value")


def stored_lines(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """The lines of ``path``, read once and written with their numbers below ``scratch``, in buckets by part."""
    lines = numbered_lines(spark.read.text(path))
    tasks = lines._jdf.queryExecution().toRdd().getNumPartitions()
    enough = max(1, 4 * tasks, stored_bytes(spark, [path]) // INPUT_PER_BUCKET)
    buckets = min(enough, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"lines_{uuid.uuid4().hex}"
    writer = lines.write.bucketBy(buckets, "part").option("compression", "zstd").option("path", f"{scratch}/lines")
    writer.format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # external: the files stay, and the frame knows them


def lines_stand_alone(spark: SparkSession, path: str, scratch: str) -> bool:
    """Whether no line of ``path`` ends inside a quoted field, so that every line is a record. One pass, in which a task ends
    at its first such line and nothing is kept but that there is one; lines of control characters alone, which Spark's CSV
    reader leaves out, count with them."""
    blank = (F.ascii("value") < 32) & F.col("value").rlike(r"\A[\x00-\x20]*\z") | F.col("value").rlike(r"\A +[\x00-\x1f][\x00-\x20]*\z")
    opens = F.col("value").contains('"') & F.col("value").rlike(ENDS_INSIDE_FROM_OUTSIDE)
    found = spark.read.text(path).where(opens | (F.col("value") != "") & blank)
    found.select(F.lit(True).alias("found")).limit(1).write.parquet(f"{scratch}/open")
    return spark.read.schema("found boolean").parquet(f"{scratch}/open").isEmpty()


def work_folder(root: str) -> str:
    """A new folder for intermediate tables below ``root``."""
    return f"{root.rstrip('/')}/_work/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
