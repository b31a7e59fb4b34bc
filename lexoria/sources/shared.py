"""The folder that all executors share, and files in it that only one of several writers can create."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexoria-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def checkpoints(spark: SparkSession) -> None:
    """Let DataFrame.checkpoint write to the shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Taken(ValueError):
    """Another writer has created the file meanwhile."""


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; of several writers one succeeds and the others get Taken. The store itself
    must refuse to create what exists: local and HDFS files do, and object stores whose Hadoop client
    honours conditional creation."""
    at, fs = _path(spark, path)
    fs.mkdirs(at.getParent())
    jvm = spark.sparkContext._jvm
    data = bytearray(text.encode())
    try:
        if fs.getUri().getScheme() == "file":
            new = jvm.java.nio.file.StandardOpenOption.CREATE_NEW
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = new, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.io.File(at.toUri().getPath()).toPath(), data, options)
        else:
            out = fs.createFile(at).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
            out.write(data)
            out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise Taken(f"{path} exists") from None
        raise


class CommitLog:
    """Numbered JSON entries in a folder. The next number is created conditionally, so that of two
    writers who saw the same state one gets Taken. An entry that is not whole is not an entry: its
    writer died while creating it; the next commit has to be of a higher number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self) -> list[str]:
        at, fs = _path(self.spark, self.folder)
        if not fs.exists(at):
            return []
        return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(at)) if n.endswith(".json") and not n.startswith("."))

    def entries(self) -> list[tuple[int, dict]]:
        """(number, entry) of all whole entries, ascending."""
        names = self._names()
        if not names:
            return []
        rows = self.spark.read.text([f"{self.folder}/{n}" for n in names], wholetext=True).selectExpr("value", "_metadata.file_name AS name").collect()
        out = []
        for r in sorted(rows, key=lambda r: r["name"]):
            try:
                out.append((int(r["name"].split(".")[0]), json.loads(r["value"])))
            except ValueError:
                continue
        return out

    def newest(self) -> tuple[int, dict | None]:
        """(highest number in use, last whole entry)."""
        names, found = self._names(), self.entries()
        return (int(names[-1].split(".")[0]) if names else 0, found[-1][1] if found else None)

    def commit(self, after: int, entry: dict) -> int:
        """Add an entry that was made from the state as of number ``after``."""
        create_once(self.spark, f"{self.folder}/{after + 1:09d}.json", json.dumps(entry, sort_keys=True))
        return after + 1
