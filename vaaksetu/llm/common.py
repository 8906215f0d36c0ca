"""Helpers shared by the operators: input tables, staged tables in the shared folder, ASCII word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: the space and U+0009 to U+000D. bytes.split() without an argument splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps ASCII capitals to small letters and leaves every other byte alone, so UTF-8 stays valid.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Bytes of an Arrow batch that goes to Python: a batch is bounded by size, not only by rows, whatever the texts' lengths. A longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches where it has none of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read with bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and executors are threads of the driver (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vaaksetu-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Makes Spark delete the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans start from files that outlive any executor.

    What the write shuffled isn't needed any more once the files are there, and goes at once. The table itself goes when the driver
    ends, or before that by unstage().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vaaksetu/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that stage() wrote once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _files(df.sparkSession, folder, lambda fs, at: fs.delete(at, True))


def _files(spark: SparkSession, folder: str, do: Callable) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    do(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case of letters: `name`, longer by underscores where it is taken."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits on ASCII white space; null is the empty text."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
