"""CSV with quoted line breaks, read by many tasks.

Whether a line starts inside quotes depends on all lines before it. A line is a
map of that state: it leaves it, flips it or sets it whatever it was. Maps
compose, so a split needs only its composed map and the number of records it
starts in either case; a prefix over splits (one row per split) then gives each
split its true state and record number, and lines are joined to records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup_join
from ..session import materialize

_FILE, _SPLIT = "__file", "__split"
_QUOTED = r'"(?:[^"]|"")*+"(?!")'


def _ddl(schema: T.StructType) -> str:
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)


def _lines(spark: SparkSession, paths: str | list[str], delimiter: str) -> DataFrame:
    """Lines with their split, their place in it and their end state for either start state."""
    line = F.col("value")
    at_field = rf"(^|\Q{delimiter}\E)"
    opens = lambda text: F.regexp_replace(text, at_field + _QUOTED, "$1_").rlike(at_field + '"')
    closed = line.rlike(r'^(?:[^"]|"")*+"')
    # After the closing quote no field starts before the next delimiter.
    rest = F.concat(F.lit("_"), F.regexp_replace(line, r'^(?:[^"]|"")*+"', ""))
    return (
        spark.read.option("lineSep", "\n").text(paths)
        .select("value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_SPLIT))
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumns({"__e0": opens(line).cast("int"), "__e1": F.when(closed, opens(rest)).otherwise(True).cast("int")})
    )


def _states(df: DataFrame, over, start: Column | int) -> Column:
    """State before each row of a window, given the state before the first.

    The last row that sets the state counts, and the flips since.
    """
    flips = F.when((F.col("__e0") == 1) & (F.col("__e1") == 0), 1).otherwise(0)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.sum(flips).over(before), F.lit(0))
    total = F.sum(flips).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = F.coalesce(F.last("__set", ignorenulls=True).over(before), F.lit(start) if isinstance(start, int) else start)
    return df.withColumn("__set", F.when(F.col("__e0") == F.col("__e1"), F.pmod(F.col("__e0") + total, F.lit(2)))).select(
        "*", F.pmod(base + flipped, F.lit(2)).cast("int").alias("__state")
    ).drop("__set")


def split_starts(lines: DataFrame) -> DataFrame:
    """True state before each split and the records started in its file before it."""
    maps = lines.select(_FILE, _SPLIT, "__at", "__e0", "__e1")
    within = Window.partitionBy(_FILE, _SPLIT).orderBy("__at")
    both = _states(maps, within, 0).withColumnRenamed("__state", "__s0")
    both = _states(both, within, 1).withColumnRenamed("__state", "__s1")
    end = lambda s: F.max_by(F.when(F.col(s) == 1, F.col("__e1")).otherwise(F.col("__e0")), "__at")
    splits = both.groupBy(_FILE, _SPLIT).agg(
        end("__s0").alias("__e0"), end("__s1").alias("__e1"),
        F.count_if(F.col("__s0") == 0).alias("__n0"), F.count_if(F.col("__s1") == 0).alias("__n1"),
    )
    in_file = Window.partitionBy(_FILE).orderBy(_SPLIT)  # a row per split of the file
    solved = _states(splits, in_file, 0)
    begun = F.when(F.col("__state") == 1, F.col("__n1")).otherwise(F.col("__n0"))
    before = F.coalesce(F.sum(begun).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return solved.select(_FILE, _SPLIT, F.col("__state").alias("__start"), before.alias("__before"))


def read_split_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, delimiter: str = ",",
    file_column: str | None = None,
) -> DataFrame:
    """Rows of CSV files with a header, whatever line breaks their quotes hold.

    Fields are quoted by ``"`` with ``""`` for a quote inside; a quote within an
    unquoted field is an ordinary character. Files must be uncompressed to be
    split. Without a schema the columns are strings named by the first file. All
    files share one layout. Blank lines between records are no rows. Only the
    lines of records that span several lines are grouped, a record at a time.
    ``file_column`` adds the URI of each row's file. The lines are stored in the
    shared folder when this is called.
    """
    if schema is None:
        reader = spark.read.options(header=True, quote='"', escape='"', sep=delimiter)
        schema = reader.csv(paths).schema  # reads the first line; names hold no line breaks
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # Where files are split depends on the session at the time, so the lines are stored once.
    lines = materialize(_lines(spark, paths, delimiter), "lines")
    starts = materialize(split_starts(lines), "splits")
    within = Window.partitionBy(_FILE, _SPLIT).orderBy("__at")
    # A split has a bounded size, so no key of the join is hot.
    placed = _states(lookup_join(lines, starts, [_FILE, _SPLIT], "inner", ["__at"], hot=False), within, F.col("__start"))
    begun = F.sum(F.when(F.col("__state") == 0, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumns(
        {
            "__record": F.col("__before") + begun,
            "__whole": (F.col("__state") == 0) & (F.col("__e0") == 0),
        }
    )
    whole = placed.where("__whole").select(_FILE, "__record", F.col("value").alias("__text"))
    parts = F.array_sort(F.collect_list(F.struct(_SPLIT, "__at", "value")))
    spanning = placed.where(~F.col("__whole")).groupBy(_FILE, "__record").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("__text")
    )
    records = whole.union(spanning).where(F.col("__record") > 1)  # the first is the header
    records = records.withColumn("__text", F.regexp_replace("__text", r"\r\z", "")).where(F.col("__text") != "")
    options = {"quote": '"', "escape": '"', "sep": delimiter, "multiLine": "true"}
    source = [F.col(_FILE).alias(file_column)] if file_column else []
    return records.select(F.from_csv("__text", _ddl(schema), options).alias("__r"), *source).select("__r.*", *[file_column] * len(source))
