"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests, local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns beside those of df, which differ from all of them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation beyond the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, by: str, values: list, name: str) -> list[DataFrame]:
    """df written like written(), one table for each of the values that its column by has (which is left out), in one pass. Each can be forgotten alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    schema = df.drop(by).schema
    return [spark.read.schema(schema).option("basePath", f"{path}/{by}={v}").parquet(f"{path}/{by}={v}") if _exists(spark, f"{path}/{by}={v}") else spark.createDataFrame([], schema) for v in values]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Bytes of labelled texts that a model is fitted on at most; rows beyond, by a hash of the id, are not learnt from.
LABELLED_BYTES = 48_000_000


def labelled_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, most: int = LABELLED_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the chosen rows (_id, _y; few, and one for each id) in the order of their ids, for a fit on the driver.

    Of several documents of one id that with the least hash counts. Texts are taken in the order of a hash of the id until
    they are most bytes; a longer one alone is left out.
    """
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(chosen), "_id")
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    sizes = own.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), size.alias("n"))).alias("t")).select("_id", "t.h", "t.n").orderBy(F.xxhash64("_id"), "_id").toPandas()
    kept = sizes[sizes.n <= most]
    kept = kept[kept.n.cumsum() <= most]
    if kept.empty:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    spark = docs.sparkSession
    take = spark.createDataFrame(kept[["_id", "h"]].rename(columns={"_id": "_i"}), f"_i {own.schema['_id'].dataType.simpleString()}, h long")
    rows = own.join(F.broadcast(take), (F.col("_id") == F.col("_i")) & (F.xxhash64("_text") == F.col("h")))
    rows = rows.groupBy("_id").agg(F.first("_text").alias("_text"), F.first("_y").alias("_y")).toArrow().sort_by([("_id", "ascending")])
    return rows["_text"].combine_chunks().cast(pa.large_string()), rows["_y"].to_numpy().astype(np.int64)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced stages now rather than at the next JVM collection."""
    import gc
    import time

    for _ in range(2):  # what the first collection lets go of in Python is free in the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
