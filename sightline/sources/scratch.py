"""Intermediate tables in the folder that driver and executors share, and how to be rid of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that ``written`` has made, by application and what they are made for, and no ``clear`` has removed.
_left: dict[tuple[str, str], list[str]] = {}
_purpose = [""]


@contextmanager
def made_for(purpose: str) -> Iterator[None]:
    """Intermediate tables written meanwhile can be removed together, by ``clear``."""
    _purpose.append(purpose)
    try:
        yield
    finally:
        _purpose.pop()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (single-machine tests), a temporary folder that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, kept: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts the lineage like checkpoint(), but the files are columnar and compressed; a lost
    executor costs no more than its running tasks. The files stay until ``clear``, or for good if they are to be ``kept``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sightline-{uuid.uuid4().hex}"
    if not kept:
        _left.setdefault((spark.sparkContext.applicationId, _purpose[-1]), []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Characters of texts that one task has.
CHARACTERS_A_TASK = 250_000


def spread(table: DataFrame, text: str, key: str) -> DataFrame:
    """A stored table dealt by ``key`` over as many tasks as its texts need: a small file is one task, and much is made of its texts."""
    return table.repartition(1 + (table.agg(F.sum(F.length(text))).first()[0] or 0) // CHARACTERS_A_TASK, key)


def clear(spark: SparkSession, purpose: str = "") -> int:
    """Remove the intermediate tables made so far for a purpose; results that come from them must have been written or collected. How many there were."""
    paths = _left.pop((spark.sparkContext.applicationId, purpose), [])
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop.Path(path), True)
    return len(paths)
