"""Tables that operators keep in the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir`` or the checkpoint folder of its context. Only a local session may have neither, as in
tests: then a temporary folder is made and removed at exit. On any other master that is an error, as each machine would write
to a disk of its own.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster; on a local session without one, a temporary folder of this process."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if context.applicationId not in _own:
        made = tempfile.mkdtemp(prefix="inkfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[context.applicationId] = made
    return f"file://{_own[context.applicationId]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/inkfold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote to its scratch folder. Frames that still read them fail afterwards."""
    remove(spark, f"{shared_dir(spark)}/inkfold-{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and columns prune."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at(path))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at(path), True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it doesn't exist."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path))) if fs.exists(at(path)) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    fs, at = _fs(spark, path)
    out = fs.create(at(f"{path}.part"), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at(path)) or not fs.rename(at(f"{path}.part"), at(path)):
        raise FileExistsError(f"another writer was faster: {path}")


def _get(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    source = fs.open(at(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def bucket(*key: str, of: int) -> Column:
    """The number of the bucket that a key falls into."""
    return F.pmod(F.xxhash64(*key), F.lit(of)).cast("int")


@dataclass(frozen=True)
class Change:
    """What a batch does to a table. ``rows`` have a column ``bucket``; they are added to their buckets, or, with ``instead`` of given ones,
    take the place of all rows of these."""

    rows: DataFrame
    instead: tuple[int, ...] | None = None


class State:
    """Named tables in buckets that change together, a batch at a time.

    A batch writes its rows to new folders and then one small manifest, which names the folders of every table's buckets and the batches
    that are in. Only with the manifest any of it counts: a batch that stops anywhere before has changed nothing, and one that is brought
    again under its name is known. Buckets that a batch doesn't touch are neither read nor written. One writer at a time: a second one
    raises. The last ``keep`` manifests and their folders stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _numbers(self) -> list[int]:
        return [int(n[1:-5]) for n in children(self.spark, self.path) if re.fullmatch(r"m\d{8}\.json", n)]

    def _manifest(self, number: int) -> dict:
        return json.loads(_get(self.spark, f"{self.path}/m{number:08d}.json")) if number else {"batches": [], "tables": {}}

    def number(self) -> int:
        """How often the state was changed."""
        return max(self._numbers(), default=0)

    def has(self, batch: str | None) -> bool:
        return batch is not None and batch in self._manifest(self.number())["batches"]

    def parts(self, table: str) -> int:
        """The most folders that a bucket of the table is spread over."""
        return max((len(p) for p in self._manifest(self.number())["tables"].get(table, {"buckets": {}})["buckets"].values()), default=0)

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table or some of its buckets, without the column ``bucket``; None before its first change."""
        known = self._manifest(self.number())["tables"].get(table)
        if known is None:
            return None
        schema = T.StructType.fromJson(known["schema"])
        wanted = known["buckets"] if buckets is None else {str(b) for b in buckets} & known["buckets"].keys()
        folders = [f"{self.path}/{f}/bucket={b}" for b in wanted for f in known["buckets"][b]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], batch: str | None = None) -> None:
        """Make the changes of a batch, all or none. Rows may be read from this state."""
        number = self.number()
        manifest = self._manifest(number)
        for table, change in changes.items():
            folder = f"d{number + 1:08d}-{table}-{uuid.uuid4().hex}"
            change.rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written_ = [n.split("=", 1)[1] for n in children(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")]
            schema = T.StructType([f for f in change.rows.schema.fields if f.name != "bucket"]).jsonValue()
            buckets = manifest["tables"].get(table, {"buckets": {}})["buckets"]
            for b in map(str, change.instead or ()):
                buckets.pop(b, None)
            for b in written_:
                buckets[b] = [*buckets.get(b, []), folder]
            manifest["tables"][table] = {"schema": schema, "buckets": buckets}
        manifest["batches"] += [batch] if batch is not None else []
        _put(self.spark, f"{self.path}/m{number + 1:08d}.json", json.dumps(manifest))
        self._clean(number + 1)

    def _clean(self, number: int) -> None:
        """Remove what neither of the last manifests names, and what batches that stopped have left."""
        kept = [n for n in self._numbers() if n > number - self.keep]
        named = {f for n in kept for t in self._manifest(n)["tables"].values() for folders in t["buckets"].values() for f in folders}
        for n in children(self.spark, self.path):
            old = n[0] == "m" and not (n.endswith(".json") and int(n[1:9]) in kept)
            if old or n[0] == "d" and n not in named:
                remove(self.spark, f"{self.path}/{n}")
