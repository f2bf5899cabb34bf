"""The XML export: records of readings, split by row tag, six attributes and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = {"type": "type", "unit": "unit", "value": "value", "startDate": "start", "endDate": "end", "sourceName": "source"}
SCHEMA = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in FIELDS])
#: Bytes of a file's end that are read at a time until they hold more than blanks.
TAIL = 4096


def read_records(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """type, unit, value, start, end, source and pos (file, offset of the split, row), by which records are in file order.
    Malformed records raise, see malformed_records(); a file that only ends too soon does not, see is_closed()."""
    reader = spark.readStream if streaming else spark.read
    raw = reader.format("xml").option("rowTag", "Record").option("mode", "FAILFAST").schema(SCHEMA).load(path)
    cols = [F.col(f"_{a}").alias(n) for a, n in FIELDS.items()]
    if streaming:
        return raw.select(*cols)
    return raw.select(*cols, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("pos"))


def malformed_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block_start (the first byte of the split in which it stands) and record (its text) of what read_records() raises on."""
    schema = T.StructType([*SCHEMA, T.StructField("_bad", T.StringType())])
    raw = spark.read.format("xml").option("rowTag", "Record").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema).load(path)
    found = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("_bad").alias("record"), F.concat_ws("", *[f"_{a}" for a in FIELDS]).alias("rest"))
    # Spark reads no file for that column alone
    return found.where(F.col("record").isNotNull() & (F.length("rest") >= 0)).select("file", "block_start", "record")


def record_json() -> F.Column:
    """A record's attributes as JSON, those that are there."""
    return F.to_json(F.struct(*[F.col(n).alias(a) for a, n in FIELDS.items()]))


def is_closed(spark: SparkSession, path: str, root: str = "HealthData") -> bool:
    """Does every file end with its root's closing tag, whatever blanks follow it? Reads the last bytes of each through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    status = fs.globStatus(p)
    if not status:
        raise FileNotFoundError(path)
    files = [f for s in status for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if not f.getPath().getName().startswith(("_", "."))]
    for f in files:
        end, tail = f.getLen(), b""
        while end and len(tail) < len(root) + 3:
            n = min(TAIL, end)
            stream = fs.open(f.getPath())
            try:
                stream.seek(end - n)
                tail = (bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) + tail).rstrip()
            finally:
                stream.close()
            end -= n
        if not tail.endswith(f"</{root}>".encode()):
            return False
    return bool(files)
