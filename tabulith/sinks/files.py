"""Single files of any store that Spark reaches: bytes, digests, and replacement as one step."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, name: str):
    """The path and its store; a local folder without the checksum files that would stand beside deliveries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    conf = spark._jsc.hadoopConfiguration()
    fs = path.getFileSystem(conf)
    return path, spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRawFileSystem() if fs.getUri().getScheme() == "file" else fs


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _at(spark, name)
    return fs.exists(path)


def read(spark: SparkSession, name: str) -> bytes:
    path, fs = _at(spark, name)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write(spark: SparkSession, name: str, content: bytes) -> None:
    path, fs = _at(spark, name)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def delete(spark: SparkSession, name: str) -> None:
    path, fs = _at(spark, name)
    fs.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a file in another's place: readers see the old one or the new one."""
    a, fs = _at(spark, source)
    b, _ = _at(spark, target)
    fs.mkdirs(b.getParent())
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = spark._jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(a), fs.makeQualified(b), over)


def replace(spark: SparkSession, name: str, content: bytes) -> None:
    """Write beside, then move."""
    beside = f"{name}.{uuid.uuid4().hex}.part"
    write(spark, beside, content)
    move(spark, beside, name)


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a folder in another's place: the old one goes aside first, comes back if that fails, and goes last."""
    new, fs = _at(spark, staged)
    final, _ = _at(spark, target)
    aside, _ = _at(spark, f"{target.rstrip('/')}.{uuid.uuid4().hex}.old")
    had = fs.exists(final)
    if had and not fs.rename(final, aside):
        raise OSError(f"{target} could not be put aside")
    if not fs.rename(new, final):
        if had:
            fs.rename(aside, final)
        raise OSError(f"{target} could not be replaced")
    if had:
        fs.delete(aside, True)


def digest(spark: SparkSession, name: str) -> str:
    """sha256 of a file's content, `unreadable` where there is none."""
    return f"sha256:{hashlib.sha256(read(spark, name)).hexdigest()}" if exists(spark, name) else "unreadable"


class FormatError(ValueError):
    """A document of another kind or version than was asked for."""


def load(spark: SparkSession, name: str, form: str) -> dict | None:
    """A versioned JSON document; None where there is none, refused where it is of another format."""
    if not exists(spark, name):
        return None
    try:
        out = json.loads(read(spark, name))
    except ValueError as e:
        raise FormatError(f"unreadable document: {e}") from e
    if not isinstance(out, dict) or out.get("format") != form:
        raise FormatError("unsupported format")
    return out


def save(spark: SparkSession, name: str, form: str, body: dict) -> None:
    replace(spark, name, (json.dumps({"format": form, **body}, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
