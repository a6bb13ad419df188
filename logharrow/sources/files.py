"""Small file-system steps through Hadoop: listing, marks, versions.

Nothing here relies on a folder being renamed. What must change at once changes by the
creation of one small file, which every store does as a whole.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def size_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes stored under a path; 0 when there is none."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _statuses(spark: SparkSession, path: str) -> list:
    """What lies directly under a path; nothing where there is none, or it goes meanwhile."""
    fs, p = _fs(spark, path)
    try:
        return list(fs.listStatus(p))
    except Py4JJavaError as error:
        if "NotFound" in error.java_exception.getClass().getName():
            return []
        raise


def _names(spark: SparkSession, path: str, folders: bool) -> list[str]:
    return sorted(s.getPath().getName() for s in _statuses(spark, path) if s.isDirectory() == folders)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories directly under a path."""
    return _names(spark, path, True)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly under a path."""
    return _names(spark, path, False)


def data_files(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the data files under a path, folders included."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    sizes, found = [], fs.listFiles(p, True)
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            sizes.append(status.getLen())
    return sizes


def data_file_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the data files directly under a path."""
    found = [(s.getPath().getName(), s.getLen()) for s in _statuses(spark, path) if not s.isDirectory()]
    return sorted((name, size) for name, size in found if not name.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def remove_empty(spark: SparkSession, path: str) -> None:
    """Remove a folder unless something is in it, or just comes in."""
    fs, p = _fs(spark, path)
    try:
        fs.delete(p, False)
    except Py4JJavaError:
        if fs.exists(p) and not _statuses(spark, path):
            raise


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Create a small file; without ``replace`` an existing one is an error."""
    fs, p = _fs(spark, path)
    out = fs.create(p, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one; whether this call created it. Of several callers one does."""
    fs, p = _fs(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        if fs.getScheme() == "file":  # Hadoop's own check on local disks leaves a gap
            nio = jvm.java.nio.file
            options = gateway.new_array(nio.OpenOption, 2)
            options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
            fs.mkdirs(p.getParent())
            nio.Files.write(jvm.java.io.File(p.toUri().getPath()).toPath(), bytearray(text.encode()), options)
        else:
            write_text(spark, path, text, replace=False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    fs, p = _fs(spark, path)
    try:
        source = fs.open(p)
    except Py4JJavaError as error:
        if "NotFound" in error.java_exception.getClass().getName():
            return None
        raise
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a table kept by ``write_version``, ascending."""
    numbers = [int(n[1:]) for n in list_dirs(spark, path) if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for n in numbers if exists(spark, version_path(path, n) + "/_SUCCESS"))


def version_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/v{number}"


def write_version(spark: SparkSession, df: DataFrame, path: str, number: int | None = None) -> int:
    """Write ``df`` as a new version; returns its number.

    Readers take the last version that has its ``_SUCCESS`` file, so they see the old or the
    new table and never none. The version before stays for readers that still hold it.
    """
    known = versions(spark, path)
    number = (known[-1] + 1 if known else 0) if number is None else number
    df.write.mode("overwrite").parquet(version_path(path, number))
    for old in [n for n in known if n < number][:-1]:
        remove(spark, version_path(path, old))
    return number


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """One row with the bytes a table occupies."""
    return spark.range(1).select(F.lit(size_on_disk(spark, path)).cast("bigint").alias("bytes"))
