"""Replacing files and folders so that a crash at any moment loses neither the old nor the new."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


def handle(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_file(spark: SparkSession, fresh: str, path: str) -> None:
    """fresh takes the place of path in one rename that overwrites; the old file is there until the new one is."""
    sc = spark.sparkContext
    jvm, gateway = sc._jvm, sc._gateway
    _, source = handle(spark, fresh)
    fs, target = handle(spark, path)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), options)


def settle(spark: SparkSession, path: str) -> None:
    """Ends a swap() that was cut short: where path is missing, the complete new folder takes its place, else the old one comes back."""
    base = path.rstrip("/")
    fs, here = handle(spark, base)
    _, fresh = handle(spark, f"{base}.new")
    _, old = handle(spark, f"{base}.old")
    _, complete = handle(spark, f"{base}.new/_SUCCESS")
    if not fs.exists(here) and fs.exists(old):
        _rename(fs, fresh if fs.exists(complete) else old, here)
    if fs.exists(here):
        fs.delete(old, True)


def swap(spark: SparkSession, path: str) -> None:
    """The folder written at path + ".new" takes the place of path. The old one is moved aside first and deleted last; settle() mends what a crash between leaves."""
    base = path.rstrip("/")
    fs, here = handle(spark, base)
    _, fresh = handle(spark, f"{base}.new")
    _, old = handle(spark, f"{base}.old")
    if fs.exists(here):
        fs.delete(old, True)
        _rename(fs, here, old)
    _rename(fs, fresh, here)
    fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not put {source.toString()} in place of {target.toString()}")


class Output(io.RawIOBase):
    """A file of any Hadoop file system, written as a stream beside its place and renamed into it when closed without an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        fs, fresh = handle(spark, f"{path}.new")
        self.stream = fs.create(fresh, True)
        self.at = 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def __exit__(self, kind, *rest) -> None:
        self.stream.close()
        if kind is None:
            replace_file(self.spark, f"{self.path}.new", self.path)
