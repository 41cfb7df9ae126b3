"""Micro-batches that become visible whole and once.

A batch is written below a hidden folder and then renamed to ``<root>/batch=<n>``. Readers
(``<root>/batch=*``, batch or stream) never list a half-written one. A batch replayed
after a failure finds its folder and is left as it is, so no file is ever replaced. The
file system must rename folders in one step (HDFS, local); the folder's ``_manifest``
tells its files, their bytes and rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from basewise.sources.tables import FILES_PER_BATCH


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match ``pattern``, sorted."""
    fs, hadoop = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(hadoop) or []))


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path relative to ``path``, bytes) of the data files below it."""
    fs, hadoop = _fs(spark, path)
    if not fs.exists(hadoop):
        return []
    root, found, walk = fs.makeQualified(hadoop).toString(), [], fs.listFiles(hadoop, True)
    while walk.hasNext():
        status = walk.next()
        own = status.getPath().toString()[len(root) + 1 :]
        if not any(part[:1] in "._" for part in own.split("/")):
            found.append((own, status.getLen()))
    return sorted(found)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written at once: under another name first, then renamed."""
    fs, hadoop = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{hadoop.getParent()}/_{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, hadoop):
        raise OSError(f"cannot rename to {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def publish(spark: SparkSession, root: str, number: int, write: Callable[[str], None], name: str = "batch", facts: dict | None = None) -> bool:
    """Runs ``write(folder)`` and shows what it wrote as ``<root>/<name>=<number>``; False if that is there already.

    Of two attempts that run at once only one is renamed, the other is deleted. ``facts``
    go into the folder's manifest, beside the time, the files and their bytes.
    """
    if exists(spark, f"{root}/{name}={number}"):
        return False
    aside = staged(root, name, number)
    write(aside)
    return show(spark, aside, root, number, name, facts)


def staged(root: str, name: str, number: int) -> str:
    """A fresh hidden folder for what is to be shown later."""
    return f"{root}/_staged/{name}-{number}-{uuid.uuid4().hex}"


def move(spark: SparkSession, source: str, target: str, names: Iterable[str]) -> None:
    """Folders ``names`` out of one staged folder into another."""
    fs, to = _fs(spark, target)
    fs.mkdirs(to)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        if not fs.rename(path(f"{source}/{name}"), path(f"{target}/{name}")):
            raise OSError(f"cannot rename {source}/{name}")


def show(spark: SparkSession, aside: str, root: str, number: int, name: str = "batch", facts: dict | None = None) -> bool:
    """Shows the staged folder ``aside``, with its manifest, as :func:`publish` does. ``root`` may be another folder than it was staged for."""
    put_text(spark, f"{aside}/_manifest", json.dumps({**(facts or {}), "number": number, "time": time.time(), "files": files_below(spark, aside)}))
    fs, source = _fs(spark, aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}={number}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        return False
    return True


def manifest(spark: SparkSession, folder: str) -> dict:
    """``number, time, files`` and other facts of a published folder."""
    fs, hadoop = _fs(spark, f"{folder}/_manifest")
    source = fs.open(hadoop)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def stream_published(spark: SparkSession, root: str, schema: str, above: str = "batch long", **options: str) -> DataFrame:
    """Rows of ``<root>/batch=<n>/sample=<s>`` as a stream, in the order of publishing; ``root`` may still be empty.

    ``above`` are the folder levels over that of the sample.
    """
    fs, hadoop = _fs(spark, root)
    fs.mkdirs(hadoop)
    fields = StructType.fromDDL(schema).fields
    # A file stream matches columns by place: those of the folders come last, in the folders' order.
    inside = StructType([*[f for f in fields if f.name != "sample"], *StructType.fromDDL(above).fields]).add("sample", "string")
    more = {"maxFilesPerTrigger": FILES_PER_BATCH, **options}
    return spark.readStream.schema(inside).options(**more).parquet(root).select(*[f.name for f in fields])
