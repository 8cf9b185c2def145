"""Queries: frequencies, distributions, totals and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.functions import tokenize
from inkfold.metrics import ocr
from inkfold.operators import aggregates, filters, sampling
from inkfold.plans.catalogue import query, table
from inkfold.streaming import requests

_LISTS = ("category", "tags", "classifications", "spacings")
_PLAIN = ("style", "weight", "source", "stroke")
_FREQUENCY = " UNION ALL ".join([f"SELECT '{f}' AS field, v AS value FROM (SELECT unnest({f}) AS v FROM font_meta) WHERE v IS NOT NULL" for f in _LISTS] + [f"SELECT '{f}', CAST({f} AS VARCHAR) FROM font_meta WHERE {f} IS NOT NULL" for f in _PLAIN])
_COUNTED = f"WITH x AS ({_FREQUENCY}), f AS (SELECT field, value, count(*) AS n FROM x GROUP BY 1, 2) "


def _frequency(spark, d):
    return aggregates.value_frequency(table(spark, d, "font_meta"), [*_LISTS, *_PLAIN])


@query(_COUNTED + "SELECT * FROM f")
def value_frequency(spark, d):
    return _frequency(spark, d)


@query(_COUNTED + "SELECT field, count(*) AS unique_count, CAST(sum(n) AS BIGINT) AS total_occurrences, count(*) FILTER (WHERE n = 1) AS singletons, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_total FROM f GROUP BY 1")
def frequency_summary(spark, d):
    return aggregates.frequency_summary(_frequency(spark, d))


@query(_COUNTED + "SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS BIGINT) AS rank, value, n FROM f")
def sorted_frequency(spark, d):
    """The values of all fields by frequency, one row a value."""
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return _frequency(spark, d).select("field", F.row_number().over(order).cast("bigint").alias("rank"), "value", "n")


@query(_COUNTED + "SELECT field, value, n FROM f WHERE field = 'tags' ORDER BY n DESC, value LIMIT 20")
def top_k_values(spark, d):
    return sampling.top_values(_frequency(spark, d).filter("field = 'tags'"), 20)


@query(_COUNTED + r", t AS (SELECT value, n FROM f WHERE field = 'tags'), w AS (SELECT value AS word, n FROM t UNION ALL SELECT w, n FROM (SELECT unnest(regexp_split_to_array(value, '[-\s]+')) AS w, n FROM t) WHERE w <> '') SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1")
def word_frequency(spark, d):
    return aggregates.tag_words(_frequency(spark, d).filter("field = 'tags'"))


@query("SELECT CAST(coalesce(len(tags), 0) AS BIGINT) AS num, count(*) AS n FROM font_meta GROUP BY 1")
def tag_count_distribution(spark, d):
    return aggregates.list_sizes(table(spark, d, "font_meta"), "tags")


@query("SELECT fullName AS value, count(*) AS n FROM font_meta WHERE fullName IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, d):
    return aggregates.repeated_values(table(spark, d, "font_meta"), "fullName")


@query("""SELECT 'l_extendedprice' AS "column", round(avg(l_extendedprice / l_quantity * 0.01), 6) AS mean, round(quantile_cont(l_extendedprice / l_quantity * 0.01, 0.5), 6) AS median FROM lineitem
UNION ALL SELECT 'l_tax', round(avg(l_tax / l_quantity * 0.01), 6), round(quantile_cont(l_tax / l_quantity * 0.01, 0.5), 6) FROM lineitem""")
def upm_normalised_stats(spark, d):
    out = aggregates.scaled_centre(table(spark, d, "lineitem"), ["l_extendedprice", "l_tax"], "l_quantity", 0.01)
    return out.select("column", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS q{round(q * 100)}" for q in aggregates.QUANTILES) + " FROM documents")
def quantile_summary(spark, d):
    rows = table(spark, d, "documents").select(F.length("text").alias("len"))
    out = aggregates.quantiles(rows, "len")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT count(svg_len) AS count, round(avg(svg_len), 6) AS mean, round(stddev_samp(svg_len), 6) AS std, CAST(min(svg_len) AS DOUBLE) AS min, round(quantile_cont(svg_len, 0.25), 6) AS q25, round(quantile_cont(svg_len, 0.5), 6) AS q50, round(quantile_cont(svg_len, 0.75), 6) AS q75, CAST(max(svg_len) AS DOUBLE) AS max FROM pangram")
def described_lengths(spark, d):
    out = aggregates.described(table(spark, d, "pangram"), "svg_len")
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


_PIECES = r"regexp_extract_all({}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]')"


@query(f"""WITH t AS (SELECT split, len({_PIECES.format('output')}) AS n FROM sft)
SELECT split, count(*) AS rows_in, count(*) FILTER (WHERE n <= 300) AS rows_out, count(*) FILTER (WHERE n > 300) AS removed, count(*) FILTER (WHERE n IS NULL) AS invalid, grouping(split) = 1 AS is_total, round(count(*) FILTER (WHERE n > 300) * 100.0::DOUBLE / count(*), 6) AS removed_pct FROM t GROUP BY ROLLUP (split)""")
def token_length_report(spark, d):
    rows = table(spark, d, "sft").select("split", "output")
    out = filters.length_report(rows, tokenize.token_count(F.col("output")), 300, "split")
    return out.withColumn("removed_pct", F.round("removed_pct", 6))


@query(f"SELECT row_idx FROM sft WHERE len({_PIECES.format('output')}) <= 300")
def token_length_filter(spark, d):
    return filters.at_most(table(spark, d, "sft"), tokenize.token_count(F.col("output")), 300).select("row_idx")


@query(f"""SELECT row_idx, CAST(length(instruction || ' ' || system) AS BIGINT) AS input_str_len, CAST(len({_PIECES.format("(instruction || ' ' || system)")}) AS BIGINT) AS input_token_len, CAST(length(output) AS BIGINT) AS output_str_len, CAST(len({_PIECES.format('output')}) AS BIGINT) AS output_token_len, CAST(length(replace(instruction, '<|SEP|>', '')) AS BIGINT) AS content_len FROM sft""")
def char_token_lengths(spark, d):
    sft = table(spark, d, "sft")
    return sft.select("row_idx", *tokenize.length_statistics(F.col("instruction"), F.col("system"), F.col("output"), F.col("instruction")))


@query("""WITH t AS (SELECT count(*) AS samples, CAST(sum(length(instruction)) AS BIGINT) AS i_total, CAST(sum(length(output)) AS BIGINT) AS o_total FROM sft)
SELECT samples, i_total, o_total, round(i_total / samples, 6) AS i_avg, round(o_total / samples, 6) AS o_avg, round(o_total / 1000000.0::DOUBLE * 2.5, 6) AS cost, round(o_total / 1000000.0::DOUBLE * 2.5 / samples, 9) AS cost_per_sample, round(o_total / 1000000.0::DOUBLE * 2.5 / samples * 1000, 6) AS cost_per_1k FROM t""")
def token_totals_cost(spark, d):
    rows = table(spark, d, "sft").select(F.length("instruction").cast("bigint").alias("i"), F.length("output").cast("bigint").alias("o"))
    out = aggregates.priced(aggregates.totals(rows, ["i", "o"]), "o", 2.5)
    return out.select("samples", "i_total", "o_total", F.round("i_avg", 6).alias("i_avg"), F.round("o_avg", 6).alias("o_avg"), F.round("cost", 6).alias("cost"), F.round("cost_per_sample", 9).alias("cost_per_sample"), F.round("cost_per_1k", 6).alias("cost_per_1k"))


@query("""SELECT count(*) AS samples, count(*) FILTER (WHERE predict IS NULL) AS errors, count(*) FILTER (WHERE usage IS NULL) AS missing_usage, CAST(sum(usage.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(usage.completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(usage.total_tokens) AS BIGINT) AS total_tokens, round(sum(latency_sec) / 8.0, 4) AS seconds, round(count(*) / (sum(latency_sec) / 8.0), 4) AS samples_per_sec, round(CAST(sum(usage.completion_tokens) AS BIGINT) / (sum(latency_sec) / 8.0), 3) AS tokens_per_sec FROM prediction""")
def throughput_summary(spark, d):
    rows = table(spark, d, "prediction").select("predict", "usage", "latency_sec")
    out = aggregates.throughput(rows, "usage", "latency_sec", F.col("predict").isNull(), 8)
    return out.withColumn("seconds", F.round("seconds", 4)).withColumn("samples_per_sec", F.round("samples_per_sec", 4)).withColumn("tokens_per_sec", F.round("tokens_per_sec", 3))


@query("SELECT split, count(*) AS num_samples, count(*) FILTER (WHERE metadata IS NULL OR NOT json_valid(metadata)) AS num_failed_samples FROM sft GROUP BY 1")
def lenient_json_counts(spark, d):
    sft = table(spark, d, "sft").select("split", "metadata")
    parsed = F.from_json("metadata", "filename string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    broken = F.col("metadata").isNull() | ~F.col("metadata").rlike(r"(?s)^\s*\{.*\}\s*$") | F.col("j._broken").isNotNull()
    return aggregates.split_counts(sft.withColumn("j", parsed), "split", broken)


@query("""WITH l AS (SELECT DISTINCT md5(output) AS k FROM sft WHERE split = 'train' AND output IS NOT NULL), r AS (SELECT DISTINCT md5(output) AS k FROM sft WHERE split <> 'train' AND output IS NOT NULL), s AS (SELECT count(*) AS n FROM l JOIN r USING (k))
SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct, n AS shared, round(n / (SELECT count(*) FROM l), 9) AS left_ratio, round(n / (SELECT count(*) FROM r), 9) AS right_ratio FROM s""")
def contamination_ratio(spark, d):
    sft = table(spark, d, "sft").select("split", F.md5("output").alias("k"))
    out = aggregates.overlap_ratios(sft.filter("split = 'train'"), sft.filter("split <> 'train'"), "k")
    return out.withColumn("left_ratio", F.round("left_ratio", 9)).withColumn("right_ratio", F.round("right_ratio", 9))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)")
def duplicate_counts(spark, d):
    return aggregates.duplicate_count(table(spark, d, "documents"), "text")


_GRADED = "json_valid(metadata) AND (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.task' = 'ocr'"


@query(rf"""WITH g AS (SELECT regexp_replace(replace(trim(predict, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '<|SEP|>', ''), '\s+', '', 'g') = replace(trim(label), '<|SEP|>', '') AS score FROM prediction WHERE {_GRADED} AND label NOT IN ('-', ''''))
SELECT count(*) AS rows_in, count(score) AS rows_out, count(*) - count(score) AS errors, count(*) FILTER (WHERE score) AS correct, round(count(*) FILTER (WHERE score) / count(score), 9) AS accuracy FROM g""")
def ocr_accuracy(spark, d):
    asked = table(spark, d, "prediction").filter((F.get_json_object("metadata", "$.task") == "ocr") & F.col("label").isNotNull())
    scored = ocr.graded(filters.gradable(asked, F.col("label")), "predict", F.col("label"), use_case=True, remove_space=True)
    return aggregates.accuracy(scored, "score").withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT size, count(*) AS groups FROM (SELECT font_family_dir_name, count(*) AS size FROM font_meta GROUP BY 1) GROUP BY 1")
def family_size_hist(spark, d):
    return aggregates.group_sizes(table(spark, d, "font_meta"), "font_family_dir_name")


@query("""WITH s AS (SELECT source, count(*) AS n FROM font_meta WHERE source IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM s) SELECT source, n FROM k WHERE k <= greatest(1, floor((SELECT count(*) FROM s) * 0.25))""")
def largest_sources(spark, d):
    return aggregates.largest_groups(table(spark, d, "font_meta").filter("source IS NOT NULL"), "source", 0.25)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark, d):
    return aggregates.type_counts(table(spark, d, "orders"), "o_orderstatus")


@query("""SELECT 'style' AS "column", count(DISTINCT style) AS distinct_values FROM font_meta UNION ALL SELECT 'weight', count(DISTINCT weight) FROM font_meta UNION ALL SELECT 'name', count(DISTINCT name) FROM font_meta""")
def distinct_counts(spark, d):
    return aggregates.distinct_counts(table(spark, d, "font_meta"), ["style", "weight", "name"])


@query("SELECT DISTINCT unnest(tags) AS element FROM font_meta")
def distinct_array_elements(spark, d):
    return aggregates.distinct_elements(table(spark, d, "font_meta"), "tags")


@query("""SELECT CASE WHEN n_chars < 0 THEN 0 WHEN n_chars > 20000 THEN 41 WHEN n_chars = 20000 THEN 40 ELSE CAST(floor(n_chars / 500.0) AS BIGINT) + 1 END AS bin, CAST(0.0 + (bin - 1) * 500.0 AS DOUBLE) AS lower, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_histogram(spark, d):
    return aggregates.histogram(table(spark, d, "documents"), "n_chars", 0.0, 20000.0, 40)


@query("SELECT CAST(length(content) AS BIGINT) AS length, count(*) AS n FROM content WHERE content IS NOT NULL GROUP BY 1")
def content_lengths(spark, d):
    return aggregates.length_distribution(table(spark, d, "content"), "content")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity), 4) AS sum, round(sum(l_quantity), 4) AS count, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS avg FROM lineitem GROUP BY 1")
def weighted_mean_meter(spark, d):
    out = aggregates.weighted_mean(table(spark, d, "lineitem"), F.col("l_discount"), F.col("l_quantity"), "l_returnflag")
    return out.select("l_returnflag", F.round("sum", 4).alias("sum"), F.round("count", 4).alias("count"), F.round("avg", 9).alias("avg"))


_KINDS_SQL = "SELECT user_id, min(value) FILTER (WHERE event_type = 'view') AS view, min(value) FILTER (WHERE event_type = 'click') AS click, min(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1"


@query(_KINDS_SQL)
def metric_pivot_report(spark, d):
    return aggregates.pivoted(table(spark, d, "events"), ["user_id"], "event_type", "value", ["view", "click", "purchase"])


@query("SELECT CAST(coalesce(sum(length(text) - length(replace(text, chr(8232), ''))), 0) AS BIGINT) AS ls, CAST(coalesce(sum(length(text) - length(replace(text, chr(8233), ''))), 0) AS BIGINT) AS ps, CAST(coalesce(sum(length(text) - length(replace(text, chr(133), ''))), 0) AS BIGINT) AS nel FROM documents")
def newline_audit(spark, d):
    return aggregates.newline_counts(table(spark, d, "documents"), "text")


@query("SELECT lang, count(DISTINCT c) AS code_points FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') WHERE c <> '' GROUP BY 1")
def codepoint_coverage(spark, d):
    return aggregates.code_points(table(spark, d, "documents"), "text", "lang")


_PATTERNS = {"errors": r"ERROR", "warnings": r"WARN", "closed": r"not closed", "sized": r"len=\d+"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS stat, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS n FROM documents" for k, p in _PATTERNS.items()))
def log_regex_counts(spark, d):
    return aggregates.matching_counts(table(spark, d, "documents"), "text", _PATTERNS)


@query(r"""WITH r AS (SELECT doc_id, TRY_CAST(regexp_extract(text, 'len=(\d+)', 1) AS BIGINT) AS v, TRY_CAST(regexp_extract(text, 'proof no\. (\d+)', 1) AS BIGINT) AS w FROM documents)
SELECT 'len' AS stat, arg_max(v, doc_id) AS value FROM r WHERE v IS NOT NULL UNION ALL SELECT 'proof', arg_max(w, doc_id) FROM r WHERE w IS NOT NULL""")
def logged_counts(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return aggregates.logged_counts(lines, "text", {"len": r"len=(\d+)", "proof": r"proof no\. (\d+)"})


@query("SELECT instruction, count(*) AS n FROM prediction GROUP BY 1")
def prompt_counts(spark, d):
    return aggregates.type_counts(table(spark, d, "prediction"), "instruction")


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice / nullif(l_discount, 0.05) AS v, l_discount FROM lineitem), x AS (SELECT l_returnflag, CASE WHEN l_discount = 0 THEN NULL ELSE v END AS v FROM r)
SELECT l_returnflag, count(*) AS n, round(avg(v), 3) AS mean FROM x WHERE v IS NOT NULL GROUP BY 1""")
def finite_mean(spark, d):
    rows = table(spark, d, "lineitem")
    endless = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_discount") == 0.05, F.lit(float("nan"))).otherwise(F.try_divide(F.col("l_extendedprice"), F.col("l_discount")))
    return filters.finite(rows.select("l_returnflag", endless.alias("v")), "v").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean"))


@query("SELECT time_bucket(INTERVAL 5 minutes, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return requests.event_windows(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return requests.sessions(table(spark, d, "events"), "user_id", "ts")
