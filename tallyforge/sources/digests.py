"""SHA-256 of files of any size and number, and a digest of a whole manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.numbering import numbered

#: Bytes of a file up to which executors hash it as one value; larger ones are streamed.
WHOLE_BYTES = 1 << 30
#: Files whose lines are hashed together before their digests are.
RANGE_FILES = 10_000


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen()))
    return out


def streamed_sha256(spark: SparkSession, path: str) -> str:
    """The SHA-256 of one file of any size, read piece by piece."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_digests(spark: SparkSession, *folders: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """`(path, bytes, sha256)` of every file below the folders, hidden ones too.

    Executors hash the files where they read them. Spark's readers pass over files named with a leading `_` or `.`, and a
    file above `whole_bytes` is one stream whatever reads it, since a SHA-256 is taken from front to back: the driver's
    JVM takes those one by one, without holding them.
    """
    listed = [(f, [x for x in f[0].rsplit(folder.rstrip("/"), 1)[-1].split("/") if x]) for folder in folders for f in _listed(spark, folder)]
    hidden = lambda name: name[:1] in "_."
    streamed = [f for f, parts in listed if f[1] > whole_bytes or hidden(parts[-1])]
    below = [f[0] for f, parts in listed if f[1] <= whole_bytes and not hidden(parts[-1]) and any(map(hidden, parts))]
    reader = lambda: spark.read.format("binaryFile")
    digest = lambda df: df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = spark.createDataFrame([(p, n, streamed_sha256(spark, p)) for p, n in streamed], "path string, bytes long, sha256 string")
    if len(listed) > len(streamed) + len(below):
        out = out.unionByName(digest(reader().option("recursiveFileLookup", "true").load(list(folders)).where(F.col("length") <= whole_bytes)))
    if below:
        out = out.unionByName(digest(reader().load(below)))
    return out


def manifest_digest(manifest: DataFrame, range_files: int = RANGE_FILES) -> DataFrame:
    """One row `(n_files, n_bytes, fingerprint)` of a manifest `(uri, bytes, sha256)` of any length.

    In order of uri, each range of so many files is hashed, and then the ranges' digests in their order; the same rows give
    the same digest whatever their order and partitioning. An empty manifest has the digest of nothing.
    """
    line = F.concat_ws("\t", "uri", F.col("bytes").cast("string"), "sha256")
    rows = numbered(manifest.select("uri", "bytes", "sha256"), "uri", "sha256", "bytes").select("row", "bytes", line.alias("line"))
    joined = lambda at, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda s: s[x]), "\n")
    ranges = rows.groupBy(F.floor(F.col("row") / range_files).alias("part")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sha2(joined("row", "line"), 256).alias("digest"))
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"), F.sha2(joined("part", "digest"), 256).alias("fingerprint"))
