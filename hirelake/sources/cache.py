"""Sources and sinks: cache documents, compressed bodies, labelled lines, published sets."""

from __future__ import annotations

import gzip
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions.digests import dataset_fingerprint

JOB = T.StructType([T.StructField("externalPath", T.StringType()), T.StructField("title", T.StringType()), T.StructField("descriptionHtml", T.StringType()), T.StructField("descriptionCompressed", T.StringType())])
CACHE = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("companyId", T.StringType()), T.StructField("jobs", T.ArrayType(JOB)), T.StructField("_corrupt_record", T.StringType())])


def explode_cache_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per job of the JSON documents below ``path``; corrupt and empty ones are skipped."""
    docs = spark.read.schema(CACHE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    good = docs.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("companyId is not null and jobs is not null")
    return good.select("file", F.col("companyId").alias("company_id"), F.explode("jobs").alias("j")).select("file", "company_id", "j.*")


def gunzip_text(column):
    """Text of a base64 gzip column; what isn't one gives null."""

    @F.pandas_udf("string")
    def inflate(parts: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else gzip.decompress(b).decode("utf-8")
            except (OSError, EOFError, ValueError):
                return None

        return parts.map(one)

    return inflate(F.try_to_binary(column, F.lit("base64")))


def gzip_text(column):
    @F.pandas_udf("binary")
    def deflate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode("utf-8"), mtime=0))

    return F.base64(deflate(column))


def inflate_descriptions(df: DataFrame, html: str, packed: str) -> DataFrame:
    """body and error: the html if there is one, else the inflated text, else empty with an error."""
    text = gunzip_text(F.col(packed))
    d = df.withColumn("__t", text)
    has = F.trim(F.coalesce(F.col(html), F.lit(""))) != ""
    error = F.when(~has & F.col(packed).isNotNull() & F.col("__t").isNull(), "invalid compressed body")
    return d.withColumn("body", F.when(has, F.col(html)).otherwise(F.coalesce("__t", F.lit("")))).withColumn("error", error).drop("__t")


def read_labelled_jsonl(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """id, label, text of a labelled corpus; repeated ids and foreign labels are errors."""
    rows = spark.read.schema("id long, label string, text string").json(path)
    bad = rows.groupBy("id").agg(F.count("*").alias("n"), F.max((~F.col("label").isin(labels)).cast("int")).alias("foreign")).where("n > 1 or foreign = 1 or foreign is null").limit(5).collect()
    if bad:
        raise ValueError(f"repeated ids or unknown labels: {[r.id for r in bad]}")
    return rows


def publish(df: DataFrame, path: str, fields: list[str], fmt: str = "parquet") -> DataFrame:
    """Write the allowed fields once (an existing path is an error); rows and digest of what was written.

    The digest is the one of ``dataset_fingerprint``, so repeated rows count as often as they occur; a ``_manifest``
    below the data, which readers of the data pass over, holds fields, format, rows and digest.
    """
    out = df.select(*fields)
    out.write.mode("errorifexists").format(fmt).save(path)
    back = df.sparkSession.read.schema(out.schema).format(fmt).load(path)
    found = dataset_fingerprint(back, fields).select("n_rows", F.col("fingerprint").alias("digest"))
    manifest = found.select(F.lit(",".join(fields)).alias("fields"), F.lit(fmt).alias("format"), "n_rows", "digest")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")
    return df.sparkSession.read.schema("fields string, format string, n_rows long, digest string").json(f"{path}/_manifest").select("n_rows", "digest")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file or folder is there, in whatever store the path names."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")
