"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a local session may lack it (tests); it then gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-scratch-")
    return folder.rstrip("/")


#: Temporary folders of local sessions without a shared one, by application.
_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from there.

    Lineage ends here, so that lost executors cost no more than the current step, and
    what follows knows the table's size, which lets the optimizer choose its joins.
    """
    path = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of narrow columns that are broadcast rather than shuffled to: a join with at most so many of them sends about 16 MB.
BROADCAST_IDS = 2_000_000
#: A key with over one row in so many is hot. There can be no more hot keys than this.
HOT_SHARE = 2000


def sized(ids: DataFrame) -> DataFrame:
    """``ids`` (few narrow columns), cut, and marked for broadcast if there are at most BROADCAST_IDS rows.

    Joined with documents, a small set then leaves the texts where they are; a large one is joined by a shuffle.
    """
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``side``, a cut table of one row a key whose column ``count`` says how many ``rows`` have the key.

    A small ``side`` is broadcast. Of a large one only the hot keys are (at most HOT_SHARE of them, as counts
    add up to ``total``), and the rows of the others are shuffled, so no task gets more than a small share of all rows.
    """
    if side.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(side), keys, how)
    bound = total // HOT_SHARE
    hot = F.broadcast(side.filter(F.col(count) > bound))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(side.filter(F.col(count) <= bound), keys, how)
    return rows.join(hot, keys).unionByName(cold)


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a number for each row, the same whenever they are read.

    Of a file table it is the file's number and the row's place in the file, whatever splits the file is read in; other rows are written first.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:  # not read from files
        return cut(docs.withColumn(name, F.monotonically_increasing_id()))
    files = sorted(r._path for r in placed.select("_path").distinct().collect())  # a row a file
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_path string, _file long")
    return placed.join(F.broadcast(numbers), "_path").withColumn(name, F.col("_file") * (1 << 40) + F.col("_place")).drop("_path", "_place", "_file")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it by name inside ``body``.

    A higher-order function over a one-element array: without it the optimizer
    may copy ``value`` into every iteration of an inner lambda.
    """
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can never clash with ours."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df.select(*columns)
