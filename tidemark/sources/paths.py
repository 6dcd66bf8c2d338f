"""Reading the input tables, and scratch places that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  In local mode, where one machine is all there is, the warehouse where
    that is unset; on a cluster an unset folder is an error."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return top


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def local(spark: SparkSession, path: str) -> str:
    """A path of a mounted file system as the operating system names it."""
    p, fs = _path(spark, path)
    if fs.getScheme() != "file":
        raise ValueError(f"no mounted file system: {path}")
    return fs.makeQualified(p).toUri().getPath()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no such folder."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, or None where there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replacing what was there."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file, whole or not at all, only where there is none yet; whether it was written.

    It is written aside first: HDFS refuses to rename it onto a name that is taken, and so does a link of
    the local file system.  A store of objects whose renames may overwrite is for one writer at a time."""
    p, fs = _path(spark, path)
    if fs.getScheme() == "file":
        nio = spark._jvm.java.nio.file
        local = spark._jvm.java.io.File(p.toUri().getPath())
        local.getParentFile().mkdirs()
        aside = spark._jvm.java.io.File(local.getParentFile(), f".{uuid.uuid4().hex}")
        nio.Files.write(aside.toPath(), bytearray(text.encode()), spark._sc._gateway.new_array(nio.OpenOption, 0))
        try:
            nio.Files.createLink(local.toPath(), aside.toPath())
            return True
        except Exception:
            if not local.exists():
                raise
            return False
        finally:
            aside.delete()
    aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        done = not fs.exists(p) and fs.rename(aside, p)  # HDFS renames onto nothing that exists
    finally:
        fs.delete(aside, False)
    return bool(done)
