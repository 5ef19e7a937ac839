"""Tables that jobs replace as a whole: snapshots in a shared folder.

A job writes its rows to a folder of their own. Then it writes a marker that names the folder, under a name nobody looks
for, and publishes it by giving it the name of the next snapshot, which only one job can: a rename that refuses to
overwrite, or a hard link on a local disk. A marker is whole from the moment it can be seen. A job that dies leaves
files that nobody points to, whatever it was doing; `tidy` removes them. A job whose base is no longer the newest
snapshot fails and has to be run again on the new one. Readers keep the snapshot they began with. The folder needs a
file system with such renames (HDFS and local disks have them, plain object stores don't).
"""
from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PREFIX, ROWS, PENDING = "snapshot=", "rows-", "_pending-"
#: Snapshots that stay; older ones are removed.
KEPT = 10


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _markers(spark: SparkSession, path: str) -> dict[int, bool]:
    """Numbers that are taken, and whether their marker says anything: an empty one publishes nothing, but keeps its number."""
    root, files = _path(spark, path)
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(PREFIX):
            found[int(name[len(PREFIX):])] = status.getLen() > 0
    return found


def _published(spark: SparkSession, path: str) -> list[int]:
    return sorted(number for number, whole in _markers(spark, path).items() if whole)


def _marker(path: str, number: int) -> str:
    return f"{path}/{PREFIX}{number:08d}"


def _folder(spark: SparkSession, path: str, number: int) -> str:
    """Where the rows of a snapshot are, as its marker says."""
    marker, files = _path(spark, _marker(path, number))
    stream = files.open(marker)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_published(spark, path))


def newest(spark: SparkSession, path: str) -> int:
    found = _published(spark, path)
    if not found:
        raise FileNotFoundError(f"no snapshot in {path}")
    return found[-1]


def read(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """A snapshot, the newest by default."""
    return spark.read.schema(schema).parquet(_folder(spark, path, newest(spark, path) if number is None else number))


def _noted(spark: SparkSession, path: str, name: str) -> str:
    """A marker for the folder, written and closed, that is no snapshot yet."""
    pending = f"{path}/{PENDING}{uuid.uuid4().hex}"
    place, files = _path(spark, pending)
    stream = files.create(place, False)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    return pending


def _publish(spark: SparkSession, pending: str, marker: str) -> None:
    """Give a marker its name if nobody else has; raises what the file system raises where the name is taken."""
    jvm = spark.sparkContext._jvm
    (source, files), (target, _) = _path(spark, pending), _path(spark, marker)
    if files.getUri().getScheme() == "file":
        # a rename on a local disk overwrites; a link does not
        local = jvm.java.nio.file.Paths
        none = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
        jvm.java.nio.file.Files.createLink(local.get(target.toUri().getPath(), none), local.get(source.toUri().getPath(), none))
        files.delete(source, False)
        return
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(source, target, options)


def write(df: DataFrame, path: str, base: int | None = None) -> DataFrame:
    """Make ``df`` the snapshot after ``base``, the one it was made from, and return it as read back.

    Without a base it becomes the first. Where another job has published since, nothing changes and this raises.
    """
    spark = df.sparkSession
    name = f"{ROWS}{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    pending = _noted(spark, path, name)
    markers = _markers(spark, path)
    number = 0 if base is None else base + 1
    while markers.get(number) is False:
        # all jobs on this base go past the same empty markers, so they still meet at one number
        number += 1
    if any(whole and n >= number for n, whole in markers.items()):
        raise RuntimeError(f"another job wrote {path}; run again")
    try:
        _publish(spark, pending, _marker(path, number))
    except Py4JJavaError as error:
        raise RuntimeError(f"another job wrote {path}; run again") from error
    _expire(spark, path)
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def _expire(spark: SparkSession, path: str) -> None:
    """Remove all but the newest ``KEPT`` snapshots."""
    for number in _published(spark, path)[:-KEPT]:
        folder, files = _path(spark, _folder(spark, path, number))
        marker, _ = _path(spark, _marker(path, number))
        files.delete(marker, False)
        files.delete(folder, True)


def tidy(spark: SparkSession, path: str, older_than: float = 86_400.0) -> list[str]:
    """Remove what dead jobs left: folders and pending markers that no snapshot names, untouched for so many seconds."""
    root, files = _path(spark, path)
    # listed first: what is published later was not there yet, or is too young to go
    found = list(files.listStatus(root)) if files.exists(root) else []
    named = {_folder(spark, path, number).rsplit("/", 1)[1] for number in _published(spark, path)}
    gone = []
    for status in found:
        name = status.getPath().getName()
        stale = status.getModificationTime() < (time.time() - older_than) * 1000
        if stale and name not in named and name.startswith((ROWS, PENDING)):
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
