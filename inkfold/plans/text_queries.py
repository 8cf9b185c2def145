"""Queries: text, number, template and drawing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import hashing, numbers, svg, templates, text, tokenize
from inkfold.operators import dedup, windows
from inkfold.operators.skew import spread
from inkfold.plans.catalogue import query, table


@query("SELECT doc_id, substring(sha256(text), 1, 20) AS sha_key, md5(encode(text)) AS digest FROM documents")
def hash_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.sha256_key(F.col("text")).alias("sha_key"), hashing.file_digest(F.encode("text", "UTF-8")).alias("digest"))


@query()
def blake2_keys(spark, d):
    return table(spark, d, "font_meta").select("identifier", hashing.glyph_key(F.col("font_family_dir_name"), F.col("filename"), F.lit("GgAa")).alias("key"), hashing.blake2_key(F.col("identifier"), 32).alias("wide_key"))


@query("""SELECT doc_id, doc_id || ':' || substring(sha1('{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '"}'), 1, 16) AS sample_id FROM documents""")
def sample_ids(spark, d):
    docs = table(spark, d, "documents")
    record = F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return docs.select("doc_id", hashing.sample_id(F.col("doc_id"), record).alias("sample_id"))


@query(r"""WITH p AS (SELECT sample_id, regexp_replace(predict, '<think>.*?</think>', '', 'gs') AS p FROM prediction)
SELECT sample_id, md5(CASE WHEN regexp_extract(p, '(?s)(<svg.*?</svg>)', 1) <> '' THEN regexp_extract(p, '(?s)(<svg.*?</svg>)', 1) ELSE p END) AS drawing FROM p""")
def think_strip(spark, d):
    return table(spark, d, "prediction").select("sample_id", F.md5(text.drawing_of(F.col("predict"))).alias("drawing"))


@query(r"SELECT row_idx, array_to_string(regexp_extract_all(output, '(?is)<path[^>]*?\sd=" + '"([^"]*)"' + "', 1), chr(10)) AS content FROM sft")
def path_extract(spark, d):
    return table(spark, d, "sft").select("row_idx", hashing.path_content(F.col("output")).alias("content"))


@query(r"SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 10 + 0.5) / 10 AS tenth, CAST(CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS VARCHAR) AS whole FROM lineitem")
def round_half_up(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", numbers.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("tenth"), numbers.rounded_text(F.col("l_extendedprice").cast("string")).alias("whole"))


@query("SELECT o_orderkey, strftime(TIMESTAMP '1904-01-01' + INTERVAL (o_orderkey) MINUTE, '%Y-%m-%dT%H:%M:%S') AS created, (o_custkey & 1) = 1 AS low, (o_custkey >> 3) & 1 = 1 AS fourth, TRY_CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS rank FROM orders")
def epoch_bits_casts(spark, d):
    orders = table(spark, d, "orders")
    flags = numbers.bits(F.col("o_custkey"), {"low": 0, "fourth": 3})
    return orders.select("o_orderkey", numbers.iso_time(F.col("o_orderkey") * 60).alias("created"), flags["low"].alias("low"), flags["fourth"].alias("fourth"), numbers.as_double(F.substring("o_orderpriority", 1, 1)).alias("rank"))


@query("SELECT identifier, string_split(identifier, '/')[-1] AS last, string_split(identifier, '/')[1] AS first, CASE WHEN len(string_split(identifier, '/')) >= 3 THEN string_split(identifier, '/')[-3] END AS third FROM font_meta")
def path_part_columns(spark, d):
    rows = table(spark, d, "font_meta")
    part = lambda at: text.path_part(F.col("identifier"), at)
    return rows.select("identifier", part(-1).alias("last"), part(1).alias("first"), part(-3).alias("third"))


@query(r"SELECT p_brand, CAST(row_number() OVER (ORDER BY regexp_extract(lower(p_brand), '^\D*'), CAST(regexp_extract(p_brand, '\d+') AS BIGINT), p_brand) AS BIGINT) AS rank FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort_rank(spark, d):
    brands = table(spark, d, "part").select("p_brand").distinct()
    return windows.numbered(brands, [text.natural_key(F.col("p_brand")), F.col("p_brand")]).select("p_brand", (F.col("row_idx") + 1).alias("rank"))


@query("SELECT doc_id, md5(base64(encode(text))) AS coded, true AS sound FROM documents WHERE text IS NOT NULL")
def base64_roundtrip(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("b", text.base64_of(F.encode("text", "UTF-8")))
    return docs.select("doc_id", F.md5("b").alias("coded"), text.is_base64(F.col("b")).alias("sound"))


@query(r"SELECT row_idx, array_to_string(string_split(content, ''), '<|SEP|>') AS apart, lower(replace(content, '_', '-')) AS tag, trim(regexp_replace(content, '\s+', ' ', 'g')) AS collapsed FROM content")
def separated_contents(spark, d):
    c = F.col("content")
    return table(spark, d, "content").select("row_idx", text.separated(c).alias("apart"), text.tag_text(c).alias("tag"), text.collapsed(c).alias("collapsed"))


_TAGS = """list_distinct(list_concat(list_filter([style || ' style', CAST(weight AS VARCHAR) || ' weight'], lambda v: v IS NOT NULL),
  list_transform(list_concat(coalesce(category, []), coalesce(classifications, []), list_filter([stroke], lambda v: v IS NOT NULL)), lambda v: lower(replace(v, '_', '-'))), coalesce(tags, [])))"""


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY array_to_string(tags, ',')) AS k FROM font_meta),
t AS (SELECT identifier, list_transform(list_sort(list_transform({_TAGS}, lambda v: {{'h': md5('42|' || identifier || '|' || v), 'v': v}})), lambda x: x.v) AS tags FROM f WHERE k = 1)
SELECT identifier, CASE WHEN len(tags) > 0 THEN 'Font design requirements: ' || array_to_string(tags, ', ') || chr(10) || chr(10) ELSE '' END || 'Text content: G<|SEP|>g<|SEP|>A<|SEP|>a' || chr(10) AS instruction FROM t""")
def sft_instruction(spark, d):
    fonts = dedup.keep_first(table(spark, d, "font_meta"), F.col("identifier"), [F.array_join("tags", ",")])
    tags = templates.style_tags(*[F.col(c) for c in ("category", "classifications", "stroke", "style", "weight", "tags")])
    return fonts.select("identifier", templates.instruction(templates.shuffled(tags, 42, F.col("identifier")), F.lit("GgAa")).alias("instruction"))


_KIND = "list_transform(coalesce({0}, []), lambda c: '{1} ' || replace(c, '_', ' '))"


@query(rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY array_to_string(tags, ',')) AS k FROM font_meta),
t AS (SELECT identifier, list_concat({_KIND.format("classifications", "Classification")}, list_filter(['Stroke ' || replace(stroke, '_', ' '), 'Style ' || coalesce(style, 'None'), 'Weight ' || coalesce(CAST(weight AS VARCHAR), 'None')], lambda v: v IS NOT NULL)) AS named,
  list_transform(coalesce(tags, []), lambda v: replace(trim(v, '/'), '/', ' ')) AS free FROM f WHERE k = 1)
SELECT identifier, 'Font design requirements: ' || array_to_string(list_transform(regexp_extract_all(array_to_string(list_concat(named, free), ', '), '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') || chr(10) || chr(10) || 'Text content: GgAa' AS instruction FROM t""")
def older_instruction(spark, d):
    fonts = dedup.keep_first(table(spark, d, "font_meta"), F.col("identifier"), [F.array_join("tags", ",")])
    tags = templates.prefixed_tags(F.lit(None).cast("array<string>"), F.col("classifications"), F.col("stroke"), F.col("style"), F.col("weight"), F.col("tags"), compat=True)
    return fonts.select("identifier", templates.titled_instruction(tags, F.lit("GgAa")).alias("instruction"))


@query("SELECT row_idx, CAST(CASE WHEN coalesce(system, '') <> '' THEN 2 ELSE 1 END AS BIGINT) AS turns, CASE WHEN coalesce(system, '') <> '' THEN 'system' ELSE 'user' END AS first_role, instruction AS last_content FROM sft WHERE instruction IS NOT NULL")
def message_builder(spark, d):
    sft = table(spark, d, "sft").filter("instruction IS NOT NULL").select("row_idx", templates.messages(F.col("instruction"), F.col("system")).alias("m"), "instruction")
    return sft.select("row_idx", F.size("m").cast("bigint").alias("turns"), F.col("m")[0]["role"].alias("first_role"), F.element_at("m", -1)["content"].alias("last_content"))


@query("""SELECT row_idx, 'You are an OCR engine. Read the image precisely.' AS system, metadata->>'$.content_str' AS output, 'data:image/png;base64,' || base64(encode(content)) AS image FROM (SELECT row_idx, instruction AS content, metadata FROM sft WHERE json_valid(metadata) AND instruction IS NOT NULL)""")
def ocr_tasks(spark, d):
    whole = table(spark, d, "sft").filter(F.col("metadata").rlike(r"(?s)^\s*\{.*\}\s*$") & F.col("instruction").isNotNull())
    task = templates.ocr_task(templates.data_url(F.encode("instruction", "UTF-8")), F.col("metadata"))
    return whole.select("row_idx", task.alias("t")).select("row_idx", "t.system", "t.output", F.col("t.images")[0].alias("image"))


@query("""SELECT identifier, 'Text content: x' || repeat('<image>', len(spacings)) AS instruction FROM font_meta WHERE spacings IS NOT NULL""")
def image_placeholders(spark, d):
    fonts = table(spark, d, "font_meta").filter("spacings IS NOT NULL")
    return fonts.select("identifier", templates.image_instruction(F.lit("Text content: x"), F.col("spacings")).alias("instruction"))


@query(r"SELECT doc_id, CAST(position AS INTEGER) AS position, piece FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) AS piece, generate_subscripts(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]'), 1) - 1 AS position FROM documents)")
def token_listing(spark, d):
    """The pieces of all documents. Null, empty and blank texts have none."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(tokenize.pieces(F.col("text"))).alias("position", "piece"))


@query()
def tag_word_split(spark, d):
    """Compound tags by a word list that is given, as any dictionary would be."""
    words = {w: 5.0 for w in "high contrast sans serif bold look hand drawn wide body tall logo inky ui calm slab neon poster".split()}
    tags = table(spark, d, "font_meta").select(F.explode("tags").alias("tag")).distinct()
    joined = F.regexp_replace("tag", "-", "")
    return tags.select("tag", text.split_compound(joined, words).alias("words"))


@query(r"""WITH p AS (SELECT filename, regexp_extract_all(svg, '(?s)\s(?:d|transform)="[^"]*"|\S+|\s') AS parts FROM pangram),
n AS (SELECT filename, list_transform(parts, lambda p: CASE
  WHEN regexp_matches(p, '^\sd=') THEN p[1:4] || regexp_replace(array_to_string(list_transform(regexp_extract_all(p[5:-2], '[A-DF-Za-df-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?'),
    lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]$') THEN t ELSE CAST(floor(CAST(t AS DOUBLE) * 10 + 0.5) / 10 AS VARCHAR) END), ','), ',?([A-DF-Za-df-z]),?', '\1', 'g') || '"'
  WHEN regexp_matches(p, '^\stransform=') THEN NULL ELSE p END) AS parts FROM p)
SELECT filename, CASE WHEN parts IS NOT NULL THEN regexp_replace(array_to_string(parts, ''), '>\s+<', '><', 'g') END AS svg FROM n""")
def svg_minify(spark, d):
    return spread(table(spark, d, "pangram").select("filename", "svg")).select("filename", svg.minify(F.col("svg"), 1).alias("svg"))


@query()
def svg_bbox(spark, d):
    return spread(table(spark, d, "pangram").select("filename", "svg")).select("filename", svg.box_column(F.col("svg")).alias("box"))


@query()
def svg_bake(spark, d):
    moved = F.replace(F.replace(F.col("svg"), F.lit("<path "), F.lit('<path transform="translate(3 4) scale(2 -2)" ')), F.lit("<svg "), F.lit('<svg xmlns="http://www.w3.org/2000/svg" '))
    return spread(table(spark, d, "pangram").select("filename", "svg")).select("filename", svg.bake_column(moved).alias("svg"))


@query()
def svg_encode_decode(spark, d):
    drawn = spread(table(spark, d, "sft").select("row_idx", "output"))
    return drawn.select("row_idx", svg.coded_column(svg.decode_column(F.col("output"))).alias("c")).select("row_idx", "c.lines", "c.sound")


@query()
def arc_length_sampling(spark, d):
    return spread(table(spark, d, "pangram").select("filename", "svg")).select("filename", svg.points_column(F.col("svg"), 64).alias("points"))
