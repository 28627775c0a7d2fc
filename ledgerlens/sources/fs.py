"""File-system calls beside Spark's readers and writers, through Hadoop's
FileSystem: they work wherever the tables lie."""
from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the entries of a folder; none if it is absent."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist yet; False if it does."""
    p, fs = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files under ``path``: it
    changes when one is added, replaced or removed."""
    p, fs = _at(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
