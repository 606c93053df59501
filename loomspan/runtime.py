"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all tasks run on this machine a temporary folder
    is used; on a cluster an unset folder is an error, as every executor would
    write to a disk of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomspan-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar, so later steps
    read only the columns they use; a lost executor costs no recomputation.
    All tables of one application lie in one folder, which is deleted when the
    driver ends; :func:`drop_staged` deletes them before.
    """
    spark = df.sparkSession
    path = f"{_stage_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: dict[str, str] = {}


def _stage_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = f"{shared_dir(spark)}/loomspan-{app}-{uuid.uuid4().hex[:8]}"
        # the last chance while the JVM still answers; a killed driver leaves the folder
        atexit.register(_delete, spark, _STAGED[app])
    return _STAGED[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended before: nothing more can be done from here
        pass


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables that :func:`stage` wrote for this application; results that were not written yet lose them too."""
    path = _STAGED.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old or the new content, never part of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.getFileSystem(conf).getUri(), conf).rename(fresh, final, options)
