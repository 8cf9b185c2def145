"""JSON-lines and text sources with row numbers, and their sinks.

Row numbers follow file name, then place in the file. Spark has no row order of its own: what depends on position joins
on ``row_idx``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import store
from inkfold.operators.windows import numbered


def raw_lines(spark: SparkSession, path: str, strip: str = "all", recursive: bool = False, exclude: str | None = None) -> DataFrame:
    """``(file, line, value)`` of a file or the ``*.jsonl`` and ``*.txt`` files of a folder.

    ``strip``: ``all`` takes white space off both ends, ``newline`` only the line end. ``recursive`` takes sub-folders in;
    ``exclude`` leaves out a file of that name. ``line`` grows within a file but has gaps.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    text = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_order"), "value")
    text = text.filter(F.col("_name") != exclude) if exclude else text
    value = F.regexp_replace("value", r"(?U)^\s+|\s+$", "") if strip == "all" else F.regexp_replace("value", r"\r$", "")
    within = F.col("_start").cast("decimal(38,0)") * F.lit(2**20) * F.lit(2**20) + F.col("_order").bitwiseAND(F.lit(2**33 - 1))
    return text.select("file", within.alias("line"), value.alias("value"))


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """``raw_lines`` with ``row_idx`` from 0, over all files in the order of their names."""
    return numbered(raw_lines(spark, path, **options), [F.col("file"), F.col("line")])


def json_lines(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Records of JSON lines, with ``row_idx``; a blank or broken line raises."""
    rows = numbered_lines(spark, path, **options)
    return rows.select("row_idx", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r"), "value").withColumn("_r", F.when(F.col("value") == "", F.raise_error(F.concat(F.lit("blank line "), F.col("row_idx").cast("string")))).otherwise(F.col("_r"))).select("row_idx", "_r.*")


def lenient_json_lines(spark: SparkSession, path: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """``(records, counts)``: records of the lines that hold a JSON object, with ``file``; and lines, blank and broken ones a file."""
    rows = raw_lines(spark, path, **options)
    parsed = rows.select("file", "value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("_r"))
    blank = F.col("value") == ""
    sound = ~blank & F.col("value").startswith("{") & F.col("_r._broken").isNull()
    counts = parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & ~sound).alias("broken"))
    return parsed.filter(sound).select("file", "_r.*").drop("_broken"), counts


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, content)``: one item a line, trimmed, blank lines left out."""
    return numbered(raw_lines(spark, path).filter("value <> ''"), [F.col("file"), F.col("line")]).select("row_idx", F.col("value").alias("content"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: the line ends in all files; a last line without one doesn't count. Files are split like any text: a file's lines and their ends
    are as long as the file, unless its last line has no end."""
    text = spark.read.option("lineSep", "\n").text(path)
    seen = text.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + 1).alias("n"))
    files = seen.groupBy("f").agg(F.count("*").alias("lines"), (F.sum("n") - F.max("size")).alias("beyond"))
    return files.agg(F.coalesce(F.sum(F.col("lines") - F.col("beyond")), F.lit(0)).cast("bigint").alias("lines"))


def touch_all(rows: DataFrame) -> None:
    """Read everything and keep nothing: a smoke test of a source."""
    rows.write.format("noop").mode("overwrite").save()


def write_json_lines(rows: DataFrame, path: str, chunk: int = 5000, mode: str = "errorifexists", order: list[Column] | None = None) -> None:
    """JSON lines of at most ``chunk`` rows a file, null fields left out; ``order`` sorts over all files."""
    (rows.orderBy(*order) if order else rows).write.mode(mode).option("maxRecordsPerFile", chunk).json(path)


def write_unless_there(rows: DataFrame, path: str, overwrite: bool = False, ignore: tuple[str, ...] = ("logs",)) -> bool:
    """Write Parquet to a folder that is missing or empty but for ``ignore``; leave a filled one alone, or replace it. Says whether it wrote."""
    filled = [n for n in store.children(rows.sparkSession, path) if n not in ignore]
    if filled and not overwrite:
        return False
    rows.write.mode("overwrite" if filled else "append").parquet(path)
    return True


def rewrite_by_file(rows: DataFrame, path: str, file: str = "file") -> None:
    """One folder for each source file, named after it, so that files can be told apart again."""
    named = rows.withColumn("src_file", F.regexp_extract(file, r"([^/]+)$", 1)).drop(file)
    named.repartition("src_file").write.mode("overwrite").partitionBy("src_file").json(path)


def resume_append(rows: DataFrame, path: str, key: str, shard: int = 1000) -> int:
    """Append the rows whose key isn't in the JSON lines of ``path`` yet, ``shard`` a file; says how many."""
    spark = rows.sparkSession
    if store.children(spark, path):
        done = spark.read.schema(f"`{key}` string").json(path).select(F.col(key).alias("_done")).distinct()
        rows = rows.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
    rows = store.written(rows, "resume")
    n = rows.count()
    if n:
        rows.write.mode("append").option("maxRecordsPerFile", shard).json(path)
    return n


def pack_images(rows: DataFrame, image: str, key: str, path: str, chunk: int = 5000, index: str = "row_idx") -> None:
    """``(img_hash, img_base64)`` as JSON lines in the order of the row numbers."""
    packed = rows.select(index, F.col(key).alias("img_hash"), F.regexp_replace(F.base64(image), r"[\r\n]", "").alias("img_base64"))
    write_json_lines(packed.select("img_hash", "img_base64", index), path, chunk, order=[F.col(index)])


def manifest(folders: dict[str, list[str]], columns: dict[str, str]) -> dict[str, dict]:
    """An entry for each dataset folder that holds JSON lines, with its own copy of the column names."""
    return {name: {"file_name": name, "formatting": "alpaca", "columns": dict(columns)} for name, files in sorted(folders.items()) if any(f.endswith((".jsonl", ".json")) for f in files)}


def merged_manifests(manifests: dict[str, dict[str, dict]]) -> dict[str, dict]:
    """Manifests of several folders as one, keys and files prefixed by the folder; an entry not named like its file raises."""
    out = {}
    for folder, entries in manifests.items():
        for name, entry in entries.items():
            if entry.get("file_name", name) != name:
                raise ValueError(f"{folder}: {name} points to {entry['file_name']}")
            out[f"{folder}/{name}"] = entry | {"file_name": f"{folder}/{name}"}
    return out


def split_manifest(counts: DataFrame, split: str = "split") -> str:
    """``num_samples`` and ``num_failed_samples`` of each split as a JSON object; one row a split comes to the driver."""
    return json.dumps({r[split]: {"num_samples": r["num_samples"], "num_failed_samples": r["num_failed_samples"]} for r in counts.collect()}, sort_keys=True)
