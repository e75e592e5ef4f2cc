"""Files beside the data, by any scheme that Hadoop knows: metadata, manifests, commits."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from brindle.functions.vectors import checked_vector
from brindle.meta import DatasetMeta
from brindle.operators.contracts import require

META, MANIFEST = "_dataset.json", "_manifest.json"


class Storage(Protocol):
    """What datasets need of a store beside Spark's own reading and writing; plug one in by dotted path."""

    def exists(self, path: str) -> bool: ...

    def read(self, path: str) -> str: ...

    def write(self, path: str, text: str) -> None: ...

    def list(self, path: str) -> list[tuple[str, int, bool]]: ...

    def copy(self, source: str, target: str) -> None: ...

    def delete(self, path: str) -> None: ...


def storage_of(spark: SparkSession, path: str | None = None, **arguments) -> Storage:
    """The store that a dotted path names, or Hadoop's file systems by scheme."""
    from brindle.plugins import load_class

    return Files(spark) if path is None else load_class(path)(spark, **arguments)


class Files:
    """Small text files and folders through Hadoop's FileSystem, local or remote alike."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: a new file is written beside and renamed."""
        fs, p = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.delete(p, False)
        require(fs.rename(beside, p), f"{path} can't be written")

    def list(self, path: str) -> list[tuple[str, int, bool]]:
        """(name, bytes, is a folder) of what a folder holds."""
        fs, p = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p))

    def stamps(self, path: str) -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of all files of a folder tree, or of one file."""
        fs, p = self._at(path)
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._at(source), self._at(target)
        b.mkdirs(q.getParent())
        require(self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self.conf), f"{source} can't be copied")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


def tree(store: Storage, path: str, below: str = "") -> list[str]:
    """The files of a folder and of all its folders, as paths from it."""
    found = []
    for name, _, folder in store.list(f"{path}/{below}" if below else path):
        found += tree(store, path, f"{below}{name}/") if folder else [below + name]
    return found


def vector_columns(df: DataFrame) -> list[str]:
    """Columns of arrays of numbers whose names say that they hold activations."""
    return [f.name for f in df.schema if f.name.startswith("activation_") and isinstance(f.dataType, ArrayType)]


def write_dataset(df: DataFrame, path: str, meta: DatasetMeta, rows_per_file: int = 65_536, partition_by: list[str] = (), schema: StructType | None = None, rows_per_group: int = 65_536) -> DatasetMeta:
    """Parquet with bounded files and row groups, then the metadata with the counted rows: a folder with metadata is complete.

    Contracts hold as the rows are written: columns are cast to the recorded ``schema`` where one is given (a column too
    many or too few is an error), activations are floats of the metadata's width, without null or non-finite components.
    """
    from dataclasses import replace

    spark = df.sparkSession
    replace(meta, row_count=0).checked()
    if schema is not None:
        require(sorted(df.columns) == sorted(schema.names), f"columns {df.columns}, recorded {schema.names}")
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if meta.width:
        held = vector_columns(df)
        df = df.select(*[checked_vector(F.col(c), meta.width, c).alias(c) if c in held else F.col(c) for c in df.columns])
    written = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", rows_per_group)
    written.partitionBy(*partition_by).parquet(path)
    meta = replace(meta, row_count=spark.read.parquet(path).count())
    require(meta.row_count > 0, f"{path} has no rows")
    Files(spark).write(f"{path}/{META}", meta.to_json())
    return meta


def read_meta(spark: SparkSession, path: str) -> DatasetMeta:
    return DatasetMeta.from_json(Files(spark).read(f"{path}/{META}"))


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DatasetMeta]:
    """A complete dataset; one whose rows are not as many as its metadata says (footers tell) is an error."""
    require(complete(spark, path), f"{path} is not complete")
    meta, df = read_meta(spark, path), spark.read.parquet(path)
    require((n := df.count()) == meta.row_count, f"{path} has {n} rows, {meta.row_count} are recorded")
    return (df.select(*columns) if columns else df), meta


def complete(spark: SparkSession, path: str) -> bool:
    files = Files(spark)
    return files.exists(f"{path}/_SUCCESS") and files.exists(f"{path}/{META}")


def push(spark: SparkSession, source: str, target: str, *, latest: str | None = None, flat: bool = False, store: Storage | None = None) -> list[str]:
    """Copy a folder with all its folders; the manifest goes last and commits. An empty folder is an error.

    ``latest``: only the last in number of the folders whose names begin so (``iter_0000500`` after ``iter_0000090``).
    ``flat``: all files into one folder, which two of one name forbid.
    """
    store = store or Files(spark)
    if latest is not None:
        number = lambda name: int(re.sub(r"\D", "", name.removeprefix(latest)) or -1)
        folders = [n for n, _, folder in store.list(source) if folder and n.startswith(latest)]
        require(bool(folders), f"{source} has no folder {latest}*")
        source = f"{source}/{max(folders, key=lambda n: (number(n), n))}"
    names = [n for n in tree(store, source) if n != MANIFEST]
    require(bool(names), f"{source} is empty")
    to = {n: n.rpartition("/")[2] if flat else n for n in names}
    require(len(set(to.values())) == len(names), "two files of one name can't be pushed flat")
    for name in names:
        store.copy(f"{source}/{name}", f"{target}/{to[name]}")
    store.write(f"{target}/{MANIFEST}", json.dumps({"files": list(to.values())}))
    return list(to.values())


def pull(spark: SparkSession, source: str, target: str, store: Storage | None = None) -> list[str]:
    """Copy what a manifest lists; without one nothing is there yet."""
    store = store or Files(spark)
    require(store.exists(f"{source}/{MANIFEST}"), f"{source} has no manifest")
    names = json.loads(store.read(f"{source}/{MANIFEST}"))["files"]
    for name in names:
        store.copy(f"{source}/{name}", f"{target}/{name}")
    return names


def fetched(spark: SparkSession, path: str, cache: str, store: Storage | None = None) -> str:
    """A copy of a file or dataset in a folder of ours, named by its path and copied once, with the metadata beside it.
    Spark reads remote paths itself; this is for what must be opened as a file."""
    store = store or Files(spark)
    at = f"{cache}/{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    folder = f"{at}/{path.rstrip('/').rpartition('/')[2]}"
    if not store.exists(f"{at}/_DONE"):
        listed = [n for n, _, _ in store.list(path)]
        if listed == [path.rpartition("/")[2]]:  # a file is its own list
            store.copy(path, folder)
            if store.exists(f"{path}.{META}"):
                store.copy(f"{path}.{META}", f"{folder}.{META}")
        else:
            for name in tree(store, path):
                store.copy(f"{path}/{name}", f"{folder}/{name}")
        store.write(f"{at}/_DONE", path)
    return folder


def lint(df: DataFrame, column: str, denied: list[str]) -> DataFrame:
    """Rows whose text holds a denied word, whatever its case, with the first such word."""
    found = F.lit(None).cast("string")
    for word in reversed(denied):
        found = F.when(F.lower(F.col(column)).contains(word.lower()), F.lit(word)).otherwise(found)
    return df.withColumn("denied", found).where(F.col("denied").isNotNull())


def scrubbed(meta: dict, rename: dict[str, str], drop: list[str]) -> dict:
    """Metadata with keys renamed and dropped, at every level."""
    if not isinstance(meta, dict):
        return meta
    return {rename.get(k, k): scrubbed(v, rename, drop) for k, v in meta.items() if k not in drop}


def card(template: str, values: dict[str, str], preset: str | None = None, licences: dict[str, str] | None = None) -> str:
    """A text card from a template; a placeholder without value is an error. The preset's licence, by the longest name
    that the preset's begins with, stands in for ``{{licence}}``."""
    if preset is not None:
        known = [k for k in licences or {} if preset.startswith(k)]
        require(bool(known), f"no licence for {preset}")
        values = {"licence": licences[max(known, key=len)], **values}
    for k, v in values.items():
        template = template.replace("{{" + k + "}}", v)
    require("{{" not in template, "a placeholder of the card has no value")
    return template
