"""Tables from and to files."""

from __future__ import annotations

import os
import shutil
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDINGS = "user_id BIGINT, recording_id BIGINT, language STRING, duration DOUBLE, rec_url STRING, transcription_url STRING, metadata_url STRING"
PREDICTIONS = "index INT, reference STRING, pretrained_prediction STRING, finetuned_prediction STRING, pretrained_wer DOUBLE, finetuned_wer DOUBLE, wer_improvement DOUBLE"


#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches where it has none of its own: rows alone don't bound a batch's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a small file may hold many rows, and what is done with them is what takes the time."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header; every column is text unless a schema is given, types are never guessed. NA and null are words like others.

    Quoted fields may hold line breaks, for which a file must be read by one task; multi_line=False lets large files be split, where no field has any.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RECORDINGS)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PREDICTIONS)


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(recording_id, json) of the files {recording_id}_transcription.json."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_transcription.json").text(folder)
    number = F.regexp_extract(F.input_file_name(), r"([0-9]+)_transcription[.]json$", 1)
    return files.select(number.cast("long").alias("recording_id"), F.col("value").alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; white space stays, empty texts come back as nulls."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; if there is none it is built and written first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def download(url: str, dest: str, timeout: float = 60.0) -> bool:
    """Copies what a URL gives to a file; what is already there is left alone. A part never stands at the destination."""
    if os.path.exists(dest):
        return True
    with urllib.request.urlopen(url, timeout=timeout) as answer, open(f"{dest}.{uuid.uuid4().hex}", "wb") as out:  # noqa: S310  the caller's URLs
        if (getattr(answer, "status", None) or 200) != 200:
            return False
        shutil.copyfileobj(answer, out)
    os.replace(out.name, dest)
    return True


def fetch_all(rows: DataFrame, url: str, dest: str, fetch: Callable[[str, str], bool] = download, max_concurrent: int = 10) -> DataFrame:
    """rows with ok: whether fetch(url, destination) succeeded; an exception is a failure. At most max_concurrent tasks fetch at a time.

    fetch decides how, and skips what is already there (destinations of the default one are in a file system that all tasks mount);
    the result is a column, so successes are a sum and failures a filter.
    """
    at, to = rows.columns.index(url), rows.columns.index(dest)

    def one(a: str, b: str) -> bool:
        try:
            return bool(fetch(a, b))
        except Exception:  # noqa: BLE001  any failure of one file is that row's result
            return False

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ok=[one(a, b) for a, b in zip(pdf.iloc[:, at], pdf.iloc[:, to])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", ok boolean"
    return rows.repartition(max_concurrent).mapInPandas(each, schema)
