"""Files by the cluster's file system (local disk, HDFS or an object store), as seen from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def size(path: str) -> int:
    fs, p = _at(path)
    return fs.getFileStatus(p).getLen()


def files(folder: str) -> list[str]:
    """Plain files of a folder in name order."""
    fs, p = _at(folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile())


def name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def read_bytes(path: str, most: int) -> bytes:
    """The first ``most`` bytes of a file."""
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replaces the file."""
    fs, p = _at(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
