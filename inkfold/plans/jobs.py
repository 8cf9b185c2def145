"""Whole jobs: the metadata funnel, the dataset build and the evaluation report, each one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold import store
from inkfold.functions import hashing, templates
from inkfold.metrics import ocr
from inkfold.operators import aggregates, dedup, filters, joins, splits
from inkfold.operators.skew import spread
from inkfold.plans.catalogue import query, table


def funnel(fonts: DataFrame, pangrams: DataFrame, answers: DataFrame, q: float = 0.9) -> DataFrame:
    """Fonts that pass every stage: usable name, drawing of a length below the quantile, first of equal drawings, and
    read right by the last answer about them, if there is one."""
    once = dedup.keep_first(fonts, F.col("identifier"), [F.col("filename")])
    named = once.filter(~filters.name_holds_any(F.col("filename")))
    drawn = pangrams.withColumn("_id", hashing.identifier(F.col("font_family_dir_name"), F.col("filename"))).filter("svg IS NOT NULL")
    drawn = joins.once_per_key(drawn, "_id", "last", [F.col("rendered_at"), F.col("svg_len"), F.col("svg")])
    short = filters.below_quantile(drawn.select("_id", "svg", "svg_len"), "svg_len", q)
    unique = dedup.keep_first(short, F.col("svg"), [F.col("_id")])
    joined = named.join(unique, F.col("identifier") == F.col("_id"))
    graded = ocr.graded(answers, "predict", F.col("label"), use_case=False, remove_space=True).withColumn("_vk", F.get_json_object("metadata", "$.identifier"))
    last = joins.once_per_key(graded.filter("score IS NOT NULL AND _vk IS NOT NULL"), "_vk", "last", [F.col("written_at"), F.col("sample_id")]).select("_vk", "score")
    return joined.join(last, F.col("identifier") == F.col("_vk"), "left").filter(F.coalesce("score", F.lit(True))).drop("_vk", "_id", "score")


_STAGES = r"""f AS (SELECT identifier, any_value(filename) AS filename, any_value(source) AS source, any_value(font_family_dir_name) AS font_family_dir_name FROM font_meta GROUP BY 1),
d AS (SELECT font_family_dir_name || '/' || filename AS id, svg, svg_len, row_number() OVER (PARTITION BY font_family_dir_name || '/' || filename ORDER BY rendered_at DESC, svg_len DESC NULLS LAST, svg DESC) AS k FROM pangram WHERE svg IS NOT NULL),
l AS (SELECT id, svg, svg_len FROM d WHERE k = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY svg ORDER BY id) AS u FROM l WHERE svg_len > 0 AND svg_len < (SELECT quantile_cont(svg_len, 0.9) FROM l)),
g AS (SELECT metadata->>'$.identifier' AS vk, lower(regexp_replace(replace(trim(predict, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '<|SEP|>', ''), '\s+', '', 'g')) = lower(replace(trim(label), '<|SEP|>', '')) AS score, written_at, sample_id FROM prediction WHERE json_valid(metadata) AND (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.task' = 'ocr'),
v AS (SELECT vk, score, row_number() OVER (PARTITION BY vk ORDER BY written_at DESC, sample_id DESC) AS k FROM g WHERE score IS NOT NULL AND vk IS NOT NULL),
kept AS (SELECT f.*, s.svg_len, s.svg FROM f JOIN s ON s.id = f.identifier AND s.u = 1 LEFT JOIN v ON v.vk = f.identifier AND v.k = 1
         WHERE coalesce(v.score, true) AND NOT (""" + " OR ".join(f"contains(lower(f.filename), '{m}')" for m in filters.SPECIAL) + "))"


def _funnel(spark, d):
    answers = table(spark, d, "prediction").filter(F.get_json_object("metadata", "$.task") == "ocr")
    return funnel(table(spark, d, "font_meta"), table(spark, d, "pangram"), answers)


@query(f"WITH {_STAGES} SELECT source, count(*) AS fonts, CAST(sum(svg_len) AS BIGINT) AS svg_len FROM kept GROUP BY 1")
def funnel_summary(spark, d):
    return _funnel(spark, d).groupBy("source").agg(F.count("*").alias("fonts"), F.sum("svg_len").alias("svg_len"))


_RECORD = "'Text content: ' || array_to_string(string_split(content, ''), '<|SEP|>') || chr(10)"


@query(f"""WITH {_STAGES}, c AS (SELECT DISTINCT content FROM content WHERE content IS NOT NULL),
h AS (SELECT *, CAST('0x' || substring(md5('42|' || font_family_dir_name), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM kept),
r AS (SELECT u, identifier, content, source, svg, {_RECORD} AS ask, CAST($system$ AS VARCHAR) AS sys FROM h, c),
j AS (SELECT *, '{{"identifier":' || to_json(identifier) || CASE WHEN source IS NULL THEN '' ELSE ',"source":' || to_json(source) END || ',"sft_instruction":' || to_json(ask) || ',"sft_system":' || to_json(sys) || ',"sft_output":' || to_json(svg) || ',"content_str":' || to_json(content) || '}}' AS meta FROM r)
SELECT CASE WHEN u < 0.8 THEN 'train' ELSE 'ood_test' END AS split, count(*) AS rows, count(DISTINCT identifier) AS fonts, CAST(sum(length(ask)) AS BIGINT) AS chars,
bit_xor(CAST('0x' || substring(md5(ask || sys || svg || meta), 1, 15) AS BIGINT)) AS digest FROM j GROUP BY 1""".replace("$system$", "'" + templates.WORDING.system.replace("'", "''") + "'"))
def dataset_build(spark, d):
    """Split fonts with all non-null contents -> whole records -> counts and a digest of every record. The fonts that passed are kept as a
    table; each content goes to both splits, so the product is an equal join."""
    contents = table(spark, d, "content").filter("content IS NOT NULL").select("content").distinct()
    fonts = store.written(splits.hashed(_funnel(spark, d), "font_family_dir_name", {"train": 0.8, "ood_test": 0.2}).select("split", "identifier", "source", "svg"), "fonts")
    rows = spread(fonts).join(contents.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("ood_test")))), "split")
    record = templates.sft_record(templates.instruction(F.array().cast("array<string>"), F.col("content")), F.col("svg"), [F.col("identifier"), F.col("source")], F.col("content"))
    built = rows.select("split", "identifier", record.alias("r"))
    digest = F.conv(F.substring(F.md5(F.concat("r.instruction", "r.system", "r.output", "r.metadata")), 1, 15), 16, 10).cast("bigint")
    return built.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("identifier").alias("fonts"), F.sum(F.length("r.instruction")).alias("chars"), F.bit_xor(digest).alias("digest"))


@query(r"""WITH t AS (SELECT CASE WHEN json_valid(metadata) THEN metadata->>'$.task' END AS task, predict, label, latency_sec, usage FROM prediction),
g AS (SELECT *, lower(replace(trim(predict, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '<|SEP|>', '')) = lower(replace(trim(label, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '<|SEP|>', '')) AS score FROM t)
SELECT task, count(*) AS rows, count(score) AS graded, count(*) FILTER (WHERE score) AS correct, round(avg(latency_sec), 6) AS latency, CAST(sum(usage.total_tokens) AS BIGINT) AS tokens FROM g GROUP BY 1""")
def evaluation_report(spark, d):
    """Answers graded and summed up by task in one pass."""
    rows = table(spark, d, "prediction").select("predict", "label", "latency_sec", "usage", F.get_json_object("metadata", "$.task").alias("task"))
    scored = ocr.graded(rows, "predict", F.col("label"), use_case=False)
    return scored.groupBy("task").agg(F.count("*").alias("rows"), F.count("score").alias("graded"), F.count_if(F.col("score")).alias("correct"), F.round(F.avg("latency_sec"), 6).alias("latency"), F.sum("usage.total_tokens").alias("tokens"))


@query("SELECT lang, source, count(*) AS n, grouping(lang) = 1 AS is_total FROM documents WHERE text IS NOT NULL GROUP BY GROUPING SETS ((lang, source), ())")
def inspection_counts(spark, d):
    """What an inspector shows first: how many records of each kind, and in all."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    both = aggregates.type_counts(docs.withColumn("k", F.struct("lang", "source")), "k").select("k.lang", "k.source", "n", F.lit(False).alias("is_total"))
    return both.unionByName(docs.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n", F.lit(True).alias("is_total")))
