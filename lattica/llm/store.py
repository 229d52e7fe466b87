"""Files in a folder that driver and executors share, local or in any store that Arrow's file systems reach."""

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by URI; a plain path or file:// is local. Files appear whole: each is written beside its place under a
    name of its own and moved there."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        if "://" not in uri or uri.startswith("file:"):
            self.fs, self.path = None, self.uri.removeprefix("file://").removeprefix("file:")
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(self.uri)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def open(self, name: str):
        """For reading, with seek()."""
        return self.fs.open_input_file(self.at(name)) if self.fs else open(self.at(name), "rb")

    def create(self, name: str):
        """For writing; parents are made."""
        if self.fs:
            self.fs.create_dir(os.path.dirname(self.at(name)), recursive=True)
            return self.fs.open_output_stream(self.at(name))
        os.makedirs(os.path.dirname(self.at(name)), exist_ok=True)
        return open(self.at(name), "wb")

    def move(self, name: str, to: str) -> None:
        if self.fs:
            self.fs.move(self.at(name), self.at(to))
        else:
            os.replace(self.at(name), self.at(to))

    def delete(self, name: str) -> None:
        if self.fs:
            self.fs.delete_file(self.at(name))
        else:
            os.unlink(self.at(name))


def unique(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of the task has."""
    return f"{prefix}-{uuid.uuid4().hex[:12]}{suffix}"


def hadoop_path(spark: SparkSession, uri: str):
    """(file system, path) on the driver's side."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commit_text(spark: SparkSession, uri: str, text: str) -> bool:
    """Writes a small file whole, and only if no such file exists: true for the one writer that comes first."""
    fs, path = hadoop_path(spark, uri)
    _, beside = hadoop_path(spark, f"{uri}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.exists(path):
            return False
        options = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the target exists
        try:
            options.rename(beside, path, none)
        except Exception:
            if fs.exists(path):
                return False
            raise
        return True
    finally:
        fs.delete(beside, False)


def read_text(spark: SparkSession, uri: str) -> str:
    fs, path = hadoop_path(spark, uri)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
