"""CSV, TSV, columnar and report sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import schemas


#: CSV is written with the blanks of its values; Spark takes them off otherwise.
UNTRIMMED = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def headerless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=False)


def family_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag rows of families; the empty second field is dropped."""
    return headerless(spark, path, schemas.FAMILY_TAG).drop("_empty")


def tag_dimension(spark: SparkSession, path: str) -> DataFrame:
    return headerless(spark, path, schemas.TAG_DIM)


def with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; fields are taken by the declared order, quotes doubled inside quotes."""
    return spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(path, header=True, enforceSchema=True)


def market_tables(spark: SparkSession, files: str, zips: str) -> tuple[DataFrame, DataFrame]:
    return with_header(spark, files, schemas.MARKET_FILE), with_header(spark, zips, schemas.MARKET_ZIP)


def in_common_shape(market: DataFrame) -> DataFrame:
    """Marketplace rows in the shape of font metadata: lists in JSON text become arrays, unreadable ones null."""
    listed = lambda c: F.from_json(c, "array<string>")
    return market.select(
        F.col("PATH_IN_ZIP").alias("filename"),
        F.col("TITLE").alias("name"),
        F.lit("market").alias("source"),
        listed("CATEGORY").alias("category"),
        listed("TAGS").alias("tags"),
        listed("SPACINGS").alias("spacings"),
        F.col("ITEM_ID").alias("font_family_dir_name"),
        F.concat("ITEM_ID", F.lit("/"), "PATH_IN_ZIP").alias("identifier"),
    )


def write_split_index(splits: DataFrame, folder: str, split: str = "split") -> list[str]:
    """A TSV folder for each split that has rows; says which. The number of splits is small and fixed."""
    names = sorted(r[split] for r in splits.select(split).distinct().collect())
    for name in names:
        splits.filter(F.col(split) == name).drop(split).write.mode("overwrite").options(sep="\t", **UNTRIMMED).csv(f"{folder}/{name}.tsv", header=True)
    return names


def split_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path, header=True)


def merged(frames: list[DataFrame], path: str | None = None) -> DataFrame:
    """Columnar datasets behind each other by column name; columns that some lack are null there. Written as Parquet if a path is given."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def copied(spark: SparkSession, source: str, target: str, form: str = "parquet") -> None:
    spark.read.format(form).load(source).write.format(form).mode("overwrite").save(target)


def metric_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(path, metric, value)`` from JSON files whose path matches ``name``, a pattern whose first group is the metric's prefix.

    Nested objects become dotted names; values that aren't numbers are left out, ``Infinity`` and ``NaN`` are numbers.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    flat = files.filter(F.col("path").rlike(name)).select("path", F.regexp_extract("path", name, 1).alias("prefix"), F.from_json("value", "map<string,string>").alias("m"))
    level = flat.select("path", "prefix", F.explode("m").alias("k", "v"))
    inner = level.select("path", "prefix", "k", F.from_json("v", "map<string,string>", {"mode": "PERMISSIVE"}).alias("m"), "v")
    leaf = inner.filter(F.col("m").isNull()).select("path", "prefix", "k", "v")
    deep = inner.filter(F.col("m").isNotNull()).select("path", "prefix", "k", F.explode("m").alias("k2", "v")).select("path", "prefix", F.concat_ws(".", "k", "k2").alias("k"), "v")
    value = F.regexp_replace("v", '^"|"$', "").try_cast("double")
    return leaf.unionByName(deep).select("path", F.concat_ws("/", F.nullif("prefix", F.lit("")), "k").alias("metric"), value.alias("value")).filter("value IS NOT NULL")


def accuracy_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, accuracy)`` of all score reports below a folder."""
    rows = spark.read.schema("accuracy double").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "score_stats*.json").json(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), "accuracy")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """``(step, loss)`` of a trainer's state file, the points of a loss curve."""
    state = spark.read.schema("log_history array<struct<step: bigint, loss: double>>").option("multiLine", True).json(path)
    return state.select(F.explode("log_history").alias("l")).select("l.step", "l.loss").filter("loss IS NOT NULL")
