"""Problem 3: how often every distinct value occurs, in how many records, and which are too rare or too common.

Counts change by signed deltas: a batch of added records counts +1, of removed ones -1, and a changed record is
both. Only the batch is aggregated; its per-term changes are merged into the persistent counts, which are parted by term hash:
parts without a changed term are neither read nor written, and a term has one row. A batch that is brought again under its name counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm.deltas import merged_in

#: Parts of the counts; a parameter, as many as make a part a file of fitting size.
BUCKETS = 16
ROWS = "\u0000rows"  # the pseudo-field whose count is the number of records


def clean_term(value: Column) -> Column:
    """Trimmed of white space of any kind, in lower case, with each space and ``_`` as ``-``."""
    return F.translate(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), " _", "--")


def listed(value: Column) -> Column:
    """The elements of a JSON array given as text; any other text is one value; null gives an empty list."""
    parsed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(value)))


def metadata_terms(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """One row a record with a complete JSON object: ``terms`` array<struct<field, term>>, repeats kept.

    Null, empty, cut-off and non-object metadata give no row; absent and null fields give no terms.
    """
    text = F.col(metadata)
    parsed = F.from_json(text, "tags STRING, category STRING, content_str STRING, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"})
    whole = rows.filter(text.rlike(r"(?s)^\s*\{.*\}\s*$")).select(parsed.alias("j")).filter(F.col("j").isNotNull() & F.col("j._broken").isNull())

    def of(field: str) -> Column:
        kept = F.filter(F.transform(F.filter(listed(F.col(f"j.{field}")), lambda x: x.isNotNull()), clean_term), lambda x: x != "")
        return F.transform(kept, lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))

    content = F.when(F.col("j.content_str").isNull(), F.array()).otherwise(F.array(F.struct(F.lit("content_str").alias("field"), F.replace(F.col("j.content_str"), F.lit("<|SEP|>"), F.lit("")).alias("term"))))
    return whole.select(F.concat(of("tags"), of("category"), content).alias("terms"))


class TermCounts:
    """Persistent counts of ``(field, term)``; state is in ``path``.

    Empty batches change nothing. A term whose records sum to 0 is gone.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.state, self.buckets = store.State(spark, path), buckets

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, batch: str | None = None) -> None:
        """Frames with a column ``terms`` as of ``metadata_terms``; for a changed record pass its old and its new state. ``batch`` names
        the batch, so that it counts once however often it is brought."""
        signed = [f.select("terms", F.lit(sign).cast("bigint").alias("sign")) for f, sign in ((added, 1), (removed, -1)) if f is not None]
        if not signed or self.state.has(batch):
            return
        rows = signed[0].unionByName(signed[-1]) if len(signed) > 1 else signed[0]
        unit = lambda occurrences, records: lambda t: F.struct(t["field"].alias("field"), t["term"].alias("term"), F.lit(occurrences).alias("o"), F.lit(records).alias("r"))
        whole = F.array(F.struct(F.lit(ROWS).alias("field"), F.lit("").alias("term"), F.lit(0).alias("o"), F.lit(1).alias("r")))
        every = F.concat(F.transform("terms", unit(1, 0)), F.transform(F.array_distinct("terms"), unit(0, 1)), whole)
        delta = rows.select("sign", F.explode(every).alias("t")).groupBy("t.field", "t.term").agg(F.sum(F.col("sign") * F.col("t.o")).alias("occurrences"), F.sum(F.col("sign") * F.col("t.r")).alias("records"))
        merged_in(self.state, {"counts": (delta, ["field", "term"], ["occurrences", "records"])}, ["field", "term"], self.buckets, batch)

    def counts(self) -> DataFrame:
        """``(field, term, occurrences, records)``."""
        return self.state.read("counts").filter(F.col("field") != ROWS)

    def marked(self, rare: int = 2, common: float = 0.05) -> DataFrame:
        """``counts`` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than ``common`` of all, else null.

        On a table so small that both hold, a term is rare.
        """
        total = self.state.read("counts").filter(F.col("field") == ROWS).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total"))
        mark = F.when(F.col("records") <= rare, "rare").when(F.col("records").cast("double") > F.col("total") * F.lit(common), "common")
        return self.counts().join(F.broadcast(total)).select("field", "term", "occurrences", "records", mark.alias("mark"))


def _sft_counts(spark: SparkSession, sf_dir: str) -> TermCounts:
    counts = TermCounts(spark, store.new_path(spark, "terms"))
    counts.update(added=metadata_terms(spark.read.parquet(f"{sf_dir}/sft.parquet").select("metadata")))
    return counts


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sft_counts(spark, sf_dir).marked().filter("mark IS NOT NULL").select("field", "term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sft_counts(spark, sf_dir).marked()


_CTE = """
WITH j AS (SELECT CAST(metadata AS JSON) AS m FROM sft WHERE json_valid(metadata) AND json_type(metadata) = 'OBJECT'),
raw AS (
  SELECT row_number() OVER () AS id, m, CASE json_type(m, '$.tags') WHEN 'ARRAY' THEN CAST(m -> '$.tags' AS VARCHAR) ELSE m ->> '$.tags' END AS tags,
         CASE json_type(m, '$.category') WHEN 'ARRAY' THEN CAST(m -> '$.category' AS VARCHAR) ELSE m ->> '$.category' END AS category, m ->> '$.content_str' AS content FROM j),
el AS (
  SELECT id, 'tags' AS field, unnest(CASE WHEN json_valid(tags) AND tags LIKE '[%' THEN from_json(tags, '["VARCHAR"]') ELSE [tags] END) AS v FROM raw WHERE tags IS NOT NULL
  UNION ALL
  SELECT id, 'category', unnest(CASE WHEN json_valid(category) AND category LIKE '[%' THEN from_json(category, '["VARCHAR"]') ELSE [category] END) FROM raw WHERE category IS NOT NULL),
t AS (
  SELECT id, field, replace(replace(lower(trim(v)), ' ', '-'), '_', '-') AS term FROM el WHERE v IS NOT NULL AND trim(v) <> ''
  UNION ALL SELECT id, 'content_str', replace(content, '<|SEP|>', '') FROM raw WHERE content IS NOT NULL),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t GROUP BY 1, 2),
m AS (SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records,
             CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM j) THEN 'common' END AS mark FROM c)
"""

QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
ORACLES = {"p3_found": _CTE + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL", "p3_counts": _CTE + "SELECT * FROM m"}
