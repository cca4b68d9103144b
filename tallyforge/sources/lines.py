"""Physical lines with their line number and byte offset, in files that are read in blocks by many tasks.

Lines fill a file without gaps, so a block's first line begins after the bytes of all lines of the file's earlier blocks.
Counts by block give these starts; within a block, lines come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators import classify

#: A mark at the start of a file that readers take away, in bytes.
MARK = 3


def physical_lines(spark: SparkSession, *paths: str, glob: str = "*.csv") -> DataFrame:
    """`(value, file, block, file_bytes, at)`: lines of the files below the paths; `at` orders the lines of a block.

    A trailing CR stays. No file, or a file that two paths name or hold, is an error.
    """

    def below(*some: str) -> DataFrame:
        return spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(list(some))

    files = [f for path in paths for f in below(path).inputFiles()]
    if not files:
        raise FileNotFoundError(f"no {glob} file below {', '.join(paths)}")
    if len(set(files)) != len(files):
        raise ValueError("a file is named twice")
    about = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_bytes")
    return below(*paths).select("value", *about, F.monotonically_increasing_id().alias("at"))


def block_starts(lines: DataFrame) -> DataFrame:
    """`(file, block, first_at, lines_before, bytes_before, mark)`: what lies before each block of a file, one row a block.

    `mark` is 3 for a file that begins with a byte order mark: its size is beyond that of its lines.
    """
    sizes = lines.groupBy("file", "block", "file_bytes").agg(F.min("at").alias("first_at"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("b"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    mark = F.when(F.col("file_bytes") - F.sum("b").over(whole) >= MARK - 1, MARK).otherwise(0)
    return sizes.select("file", "block", "first_at", earlier("n").alias("lines_before"), earlier("b").alias("bytes_before"), mark.alias("mark"))


def located_lines(spark: SparkSession, *paths: str, glob: str = "*.csv") -> DataFrame:
    """`(value, file, line, offset)`: every line with its number from 1 and its first byte's place in the file.

    The starts of the blocks, one entry for each split of a file, are sent to the tasks; lines aren't shuffled.
    """
    lines = physical_lines(spark, *paths, glob=glob)
    starts = {(r.file, r.block): (r.lines_before, r.bytes_before, r.mark) for r in block_starts(lines).collect()}
    shared = spark.sparkContext.broadcast(starts)
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("value", "file")), *(T.StructField(c, T.LongType()) for c in ("line", "offset"))])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, offset, mark = None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            names, block = b.column(1).dictionary_encode(), b.column(2).to_numpy()
            name, sizes = names.indices.to_numpy(), pc.binary_length(b.column(0)).to_numpy().astype(np.int64) + 1
            edges = np.flatnonzero((np.diff(name, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            numbers, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for a, z in zip(edges, [*edges[1:], len(sizes)]):
                key = names.dictionary[int(name[a])].as_py(), int(block[a])
                if key != now:
                    now, (line, offset, mark) = key, shared.value[key]
                at = offset + np.cumsum(sizes[a:z]) - sizes[a:z]
                numbers[a:z] = line + 1 + np.arange(z - a)
                offsets[a:z] = at + np.where(numbers[a:z] > 1, mark, 0)
                line, offset = line + z - a, offset + int(sizes[a:z].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(numbers), pa.array(offsets)], names=schema.names)

    return lines.select("value", "file", "block").mapInArrow(locate, schema)


def offset_bucket(path: Column, offset: Column, seed: int, buckets: int) -> Column:
    """A bucket by SHA-256 over the path, a zero byte, and seed and offset as eight bytes each; its first four bytes are a signed integer."""
    eight = lambda number: F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))
    head = F.conv(F.substring(F.sha2(F.concat(path.cast("binary"), F.lit(b"\0"), eight(F.lit(seed)), eight(offset)), 256), 1, 8), 16, 10).cast("long")
    return F.pmod(F.when(head >= 1 << 31, head - (1 << 32)).otherwise(head), F.lit(buckets).cast("long"))


def sample_lines(located: DataFrame, rate: float, seed: int) -> DataFrame:
    """The lines, but headers, whose bucket of a million lies below the rate: the same ones however the files are split."""
    if not 0 < rate <= 1:
        raise ValueError("the rate must be above 0 and at most 1")
    drawn = located.where(offset_bucket(F.col("file"), F.col("offset"), seed, 1_000_000) < int(rate * 1_000_000))
    return classify.parse_lines(drawn, fields=classify.REVENUE_FIELDS).where(~F.col("is_header")).select(*located.columns)


def first_errors(lines: DataFrame, mode: str = "category_id", n: int = 20) -> DataFrame:
    """`(file, line, offset, error, value)`: the first n errors of `physical_lines` in order of file and line.

    An error is a malformed line, a group field that is too long, or a first line that isn't the header (a file without one).
    Lines are numbered where they are read; only the n found are looked up among the blocks, and their offsets summed.
    """
    rows = classify.classify_purchases(lines, mode)
    starts = block_starts(lines)
    first = F.col("at") == F.min("at").over(Window.partitionBy("file"))  # over the first lines of blocks only
    heads = rows.join(F.broadcast(lines.groupBy("file", "block").agg(F.min("at").alias("at")).withColumn("first", first).where("first").select("file", "block", "at")), ["file", "block", "at"])
    long_key = (F.col("reason") == "INVALID_GROUP") & S.overlong_key(mode, "category_id", "category_code")
    kinds = F.when(F.col("reason") == "MALFORMED_CSV", "MALFORMED_CSV").when(long_key, "OVERLONG_KEY")
    wrong = rows.select("file", "block", "at", "value", kinds.alias("error")).where("error is not null")
    missing = heads.where("reason <> 'HEADER'").select("file", "block", "at", "value", F.lit("MISSING_HEADER").alias("error"))
    few = wrong.unionByName(missing).orderBy("file", "block", "at", "error").limit(n)
    placed = few.join(starts, ["file", "block"]).withColumn("line", F.col("lines_before") + F.col("at") - F.col("first_at") + 1)
    asked = placed.select("file", "block", F.col("at").alias("until")).distinct()
    within = lines.select("file", "block", "at", (F.octet_length("value") + 1).alias("b")).join(F.broadcast(asked), ["file", "block"]).where("at < until")
    inside = within.groupBy("file", "block", F.col("until").alias("at")).agg(F.sum("b").alias("inside"))
    offset = F.col("bytes_before") + F.coalesce("inside", F.lit(0)) + F.when(F.col("line") > 1, F.col("mark")).otherwise(0)
    return placed.join(inside, ["file", "block", "at"], "left").select("file", "line", offset.alias("offset"), "error", "value")
