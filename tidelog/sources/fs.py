"""Hadoop file system calls from the driver, so that any store Spark reads can be used."""

from pyspark.sql import SparkSession


#: Schemes of file systems whose renames are atomic.
ATOMIC = frozenset(["file", "hdfs", "viewfs"])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def names(spark, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def modified_ms(spark, path: str) -> int:
    fs, p = _path(spark, path)
    return fs.getFileStatus(p).getModificationTime()


class Reads:
    """Range reads of files, counted: calls for sizes, reads, and their bytes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sizes, self.reads, self.bytes = spark, 0, 0, 0

    def size(self, path: str) -> int:
        self.sizes += 1
        return size(self.spark, path)

    def read(self, path: str, start: int, n: int) -> bytes:
        """Exactly n bytes from start on; EOFError if the file ends before."""
        if start < 0 or n < 0:
            raise ValueError("ranges begin at 0 or later and have no negative length")
        fs, p = _path(self.spark, path)
        self.reads += 1
        if start + n > fs.getFileStatus(p).getLen():
            raise EOFError(f"{path} has no bytes {start} to {start + n}")
        stream = fs.open(p)
        try:
            stream.seek(start)
            out = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
        finally:
            stream.close()
        self.bytes += n
        return out


def read_text(spark, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_exclusive(spark, path: str, text: str | bytes) -> bool:
    """Writes a new file; False when it is there already, so that one of several writers wins.

    The text goes to a file of its own first and is renamed without overwriting, so that
    readers never see half of it. Renames are atomic on HDFS and local disks; object stores,
    which copy instead, are refused."""
    import uuid

    fs, p = _path(spark, path)
    if fs.getScheme() not in ATOMIC:
        raise ValueError(f"no atomic rename on {fs.getScheme()}: {', '.join(sorted(ATOMIC))} have one")
    temp = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(temp, False)
    out.write(text.encode() if isinstance(text, str) else text)
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()) if p.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.NONE
    try:
        context.rename(temp, p, flags)
        return True
    except Exception:
        fs.delete(temp, False)
        if fs.exists(p):
            return False
        raise
