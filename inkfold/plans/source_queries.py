"""Queries: sources, sinks and the request stream, each a round trip through the shared folder against the table it came from."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold import store
from inkfold.functions import hashing
from inkfold.operators import splits
from inkfold.plans.catalogue import query, table
from inkfold.sources import answers, archives, lines, tables
from inkfold.streaming import requests


@query("SELECT CAST(row_number() OVER (ORDER BY row_idx) - 1 AS BIGINT) AS row_idx, row_idx AS id, split, md5(instruction) AS asked, md5(output) AS drawn FROM sft")
def json_lines_round_trip(spark, d):
    """JSON lines in chunks, read again in their order with row numbers; null fields stay null."""
    path = store.new_path(spark, "jsonl")
    sft = table(spark, d, "sft").select(F.col("row_idx").alias("id"), "split", "instruction", "output")
    lines.write_json_lines(sft, path, chunk=700, order=[F.col("id")])
    read = lines.json_lines(spark, path, "id bigint, split string, instruction string, output string")
    return read.select("row_idx", "id", "split", F.md5("instruction").alias("asked"), F.md5("output").alias("drawn"))


@query(r"""WITH t AS (SELECT row_idx AS i, regexp_replace(content, '^[\s\p{Z}\x{85}\x{0b}]+|[\s\p{Z}\x{85}\x{0b}]+$', '', 'g') AS content FROM content)
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS row_idx, content FROM t WHERE content <> ''""")
def contents_round_trip(spark, d):
    """A text file, its lines trimmed, blank ones left out and numbered."""
    path = store.new_path(spark, "text")
    listed = table(spark, d, "content").orderBy("row_idx").select(F.coalesce("content", F.lit("")).alias("value"))
    listed.write.text(path)
    return lines.contents(spark, path)


@query("SELECT count(*) AS lines, count(*) AS counted, count(*) FILTER (WHERE coalesce(trim(metadata), '') = '') AS blank, count(*) FILTER (WHERE trim(metadata) <> '' AND NOT coalesce(json_valid(metadata) AND json_type(CASE WHEN json_valid(metadata) THEN metadata END) = 'OBJECT', false)) AS broken FROM sft")
def lenient_lines_round_trip(spark, d):
    """Lines of which some are blank or cut off, told apart and counted."""
    path = store.new_path(spark, "lenient")
    table(spark, d, "sft").select(F.coalesce("metadata", F.lit("")).alias("value")).write.text(path)
    _, counts = lines.lenient_json_lines(spark, path, "content_str string")
    told = counts.agg(F.sum("lines").alias("lines"), F.sum("blank").alias("blank"), F.sum("broken").alias("broken"))
    return told.crossJoin(F.broadcast(lines.line_count(spark, path).select(F.col("lines").alias("counted"))))


@query("SELECT t.font_family, t.raw_tags, t.tag_weight, d.low, d.high, d.tags FROM family_tag t LEFT JOIN (SELECT DISTINCT raw_tags, low, high, tags FROM tag_dim) d USING (raw_tags)")
def tag_files_round_trip(spark, d):
    """Tag rows and their dimension as CSV without a header."""
    rows, dim = store.new_path(spark, "tags"), store.new_path(spark, "dim")
    table(spark, d, "family_tag").write.options(**tables.UNTRIMMED).csv(rows)
    table(spark, d, "tag_dim").write.options(**tables.UNTRIMMED).csv(dim)
    return tables.family_tags(spark, rows).join(tables.tag_dimension(spark, dim).distinct(), "raw_tags", "left").select("font_family", "raw_tags", "tag_weight", "low", "high", "tags")


@query("""SELECT CAST(p_partkey AS VARCHAR) || '/' || p_name AS identifier, p_name || ' "' || p_brand || '", x' AS name, p_type AS first_category, CAST(2 AS BIGINT) AS categories FROM part""")
def market_files_round_trip(spark, d):
    """Marketplace files and zip records as CSV with a header, quotes doubled inside quotes, lists as JSON text."""
    part = table(spark, d, "part")
    listed = F.to_json(F.array("p_type", "p_brand"))
    title = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x'))
    files, zips = store.new_path(spark, "files"), store.new_path(spark, "zips")
    item = F.col("p_partkey").cast("string").alias("ITEM_ID")
    save = lambda frame, path: frame.write.options(escape='"', **tables.UNTRIMMED).csv(path, header=True)
    save(part.select(item, F.col("p_name").alias("PATH_IN_ZIP"), F.lit("ttf").alias("FILE_TYPE"), F.md5("p_name").alias("MD5")), files)
    save(part.select(item, title.alias("TITLE"), F.col("p_brand").alias("BRAND"), listed.alias("CATEGORY"), listed.alias("TAGS"), listed.alias("SPACINGS")), zips)
    read_files, read_zips = tables.market_tables(spark, files, zips)
    shaped = tables.in_common_shape(read_files.filter(F.col("MD5") == F.md5("PATH_IN_ZIP")).join(read_zips, "ITEM_ID"))
    return shaped.select("identifier", "name", F.col("category")[0].alias("first_category"), F.size("category").cast("bigint").alias("categories"))


@query("""WITH g AS (SELECT DISTINCT font_family_dir_name AS f, CAST('0x' || substring(md5('42|' || font_family_dir_name), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM font_meta WHERE font_family_dir_name IS NOT NULL)
SELECT CASE WHEN u < 0.8 THEN 'train' ELSE 'test' END AS split, f AS family FROM g""")
def split_index_round_trip(spark, d):
    """A TSV with a header for each split."""
    path = store.new_path(spark, "index")
    families = table(spark, d, "font_meta").filter("font_family_dir_name IS NOT NULL").select(F.col("font_family_dir_name").alias("family")).distinct()
    names = tables.write_split_index(splits.hashed(families, "family", {"train": 0.8, "test": 0.2}), path)
    read = [tables.split_index(spark, f"{path}/{name}.tsv", "family string").select(F.lit(name).alias("split"), "family") for name in names]
    return tables.merged(read)


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    import zipfile

    def pack(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in (("fonts/A.ttf", text), ("__MACOSX/A.ttf", "x"), (".hidden", "y"), ("read.ME", "z")):
                z.writestr(name, data)
        return out.getvalue()

    return texts.map(pack)


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, m.member, m.suffix, CASE WHEN m.member = 'read.ME' THEN CAST(1 AS BIGINT) ELSE octet_length(encode(text)) END AS size, CASE WHEN m.member = 'read.ME' THEN md5('z') ELSE md5(text) END AS md5,
CASE WHEN m.member = 'read.ME' THEN 'other digest' END AS reason FROM documents, (VALUES ('fonts/A.ttf', 'ttf'), ('read.ME', 'me')) AS m(member, suffix) WHERE text IS NOT NULL""")
def zip_round_trip(spark, d):
    """Archives with their listing, members, digests and the reasons of members that aren't what was wanted."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")
    files = store.written(docs.select("path", _zipped("text").alias("content")), "zips")
    members = archives.zip_members(files).withColumnRenamed("path", "item")
    wanted = docs.select(F.col("path").alias("item"), F.explode(F.array(F.lit("fonts/A.ttf"), F.lit("read.ME"))).alias("member"), F.md5("text").alias("digest"))
    sound, failed = archives.verified_members(members, wanted, "item", "member", "digest")
    told = sound.select("item", "member", F.lit(None).cast("string").alias("reason")).unionByName(failed.select("item", "member", "reason"))
    joined = archives.zip_listing(files).join(members.select(F.col("item").alias("path"), "member", "md5"), ["path", "member"])
    return joined.join(told.withColumnRenamed("item", "path"), ["path", "member"]).select("path", "member", "suffix", "size", "md5", "reason")


@F.pandas_udf(T.BinaryType())
def _array_file(values: pd.Series) -> pd.Series:
    def pack(v) -> bytes:
        out = io.BytesIO()
        np.save(out, np.asarray(v, np.float32).reshape(-1, 2))
        return out.getvalue()

    return values.map(pack)


@query("SELECT CAST(vec_id AS VARCHAR) AS path, CAST(len(embedding) // 2 AS BIGINT) AS rows, CAST(2 AS BIGINT) AS columns, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def array_round_trip(spark, d):
    """Arrays in files of their own, with their shape."""
    files = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), _array_file("embedding").alias("content"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return archives.arrays(files).select("path", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("columns"), F.round(total, 5).alias("total"))


@query("""WITH m AS (SELECT label, avg(list_sum(embedding)) AS mean, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label || '/sum.mean' AS metric, round(mean, 6) AS value FROM m UNION ALL SELECT label || '/n', CAST(n AS DOUBLE) FROM m""")
def metric_files_round_trip(spark, d):
    """Nested JSON reports below a folder, flattened to dotted names."""
    path = store.new_path(spark, "reports")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    told = table(spark, d, "embeddings").groupBy("label").agg(F.avg(total).alias("mean"), F.count("*").alias("n"))
    told.select(F.col("label").alias("of"), F.struct("mean").alias("sum"), "n").repartition("of").write.partitionBy("of").option("maxRecordsPerFile", 1).json(path)
    return tables.metric_files(spark, path, r"of=(-?\d+)/").select("metric", F.round("value", 6).alias("value"))


@query("SELECT sample_id, CAST(1 AS BIGINT) AS n FROM prediction WHERE sample_id IS NOT NULL GROUP BY 1")
def resumed_log(spark, d):
    """An appended log, stopped after a part and begun again with all: each key is there once."""
    path = store.new_path(spark, "log")
    rows = table(spark, d, "prediction").filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("latency_sec").alias("latency_sec"))
    lines.resume_append(rows.filter("latency_sec < 3"), path, "sample_id")
    lines.resume_append(rows, path, "sample_id", shard=500)
    return spark.read.schema("sample_id string").json(path).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("SELECT event_type || '.jsonl' AS src_file, event_id, value FROM events")
def rewritten_by_file(spark, d):
    """Rows put back into a folder for each file that they came from."""
    path = store.new_path(spark, "byfile")
    rows = table(spark, d, "events").select("event_id", "value", F.concat(F.lit("in/some/"), "event_type", F.lit(".jsonl")).alias("file"))
    lines.rewrite_by_file(rows, path)
    return spark.read.schema("event_id bigint, value double, src_file string").json(path).select("src_file", "event_id", "value")


@query("SELECT n_name AS name, n_regionkey AS region, NULL AS level FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def merged_datasets(spark, d):
    """Datasets of different columns behind each other, written unless they are there, and copied."""
    path, copy = store.new_path(spark, "merged"), store.new_path(spark, "copy")
    nations = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    regions = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("level"))
    both = tables.merged([nations, regions])
    lines.write_unless_there(both, path)
    lines.write_unless_there(both.limit(0), path)
    tables.copied(spark, path, copy)
    return spark.read.parquet(copy)


@query("SELECT sample_id, md5(min(instruction)) AS answer FROM prediction WHERE sample_id IS NOT NULL GROUP BY 1")
def answered_requests(spark, d):
    """Requests as a stream in bounded batches, each key answered once, the result marked complete."""
    asked, path, checkpoint = (store.new_path(spark, name) for name in ("asked", "answers", "offsets"))
    table(spark, d, "prediction").filter("sample_id IS NOT NULL").select("sample_id", "instruction").repartition(5).write.json(asked)
    stream = requests.request_stream(spark, asked, "sample_id string, instruction string", files_per_batch=2)
    requests.answer_stream(stream, "sample_id", lambda batch: batch.select("sample_id", F.md5("instruction").alias("answer")), path, checkpoint).awaitTermination()
    found = spark.read.schema("sample_id string, answer string").parquet(path)
    lines.touch_all(found)
    return found.select("sample_id", "answer")


@query("SELECT identifier, substring(sha256(identifier), 1, 20) AS hash, md5(svg) AS drawing FROM (SELECT font_family_dir_name || '/' || filename AS identifier, svg FROM pangram WHERE svg IS NOT NULL)")
def stored_tables(spark, d):
    """A table in the shared folder, in buckets, changed as a whole."""
    state = store.State(spark, store.new_path(spark, "state"))
    drawn = table(spark, d, "pangram").filter("svg IS NOT NULL").select(hashing.identifier(F.col("font_family_dir_name"), F.col("filename")).alias("identifier"), "svg")
    keyed = drawn.withColumn("hash", hashing.sha256_key(F.col("identifier"))).withColumn("bucket", store.bucket("identifier", of=8))
    state.commit({"glyphs": store.Change(keyed.filter("bucket < 4"))}, "first")
    state.commit({"glyphs": store.Change(keyed.filter("bucket >= 2"), instead=(2, 3))}, "second")
    return state.read("glyphs").select("identifier", "hash", F.md5("svg").alias("drawing"))


@query("""WITH f AS (SELECT DISTINCT name, font_family_dir_name AS path, filename, style, weight FROM font_meta WHERE name IS NOT NULL AND filename IS NOT NULL AND font_family_dir_name IS NOT NULL)
SELECT path, name, count(*) AS fonts, min(filename) AS first_file, CAST(sum(weight) AS BIGINT) AS weight, CAST(count(style) AS BIGINT) AS styles FROM f GROUP BY 1, 2""")
def family_messages_read(spark, d):
    """Family metadata in text form, a message a family, with its fonts nested in it."""
    fonts = table(spark, d, "font_meta").filter("name IS NOT NULL AND filename IS NOT NULL AND font_family_dir_name IS NOT NULL")
    fonts = fonts.select("name", F.col("font_family_dir_name").alias("path"), "filename", "style", "weight").distinct()
    said = lambda c: F.concat(F.lit(f'  {c}: "'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"\n'))
    weight = F.coalesce(F.concat(F.lit("  weight: "), F.col("weight").cast("string"), F.lit("\n")), F.lit(""))
    font = F.concat(F.lit("fonts {\n"), said("name"), said("filename"), F.coalesce(said("style"), F.lit("")), weight, F.lit("}\n"))
    text = fonts.groupBy("path", "name").agg(F.concat_ws("", F.collect_list(font)).alias("fonts")).select("path", F.encode(F.concat(said("name"), F.lit("# a note\n"), "fonts"), "UTF-8").alias("content"))
    read = archives.family_messages(text).filter("error IS NULL")
    return read.select("path", "name", F.explode("fonts").alias("f")).groupBy("path", "name").agg(F.count("*").alias("fonts"), F.min("f.filename").alias("first_file"), F.sum("f.weight").cast("bigint").alias("weight"), F.count("f.style").alias("styles"))


@query("SELECT md5(text) AS img_hash, base64(encode(text)) AS img_base64, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM documents WHERE text IS NOT NULL")
def packed_images(spark, d):
    """Images (here the bytes of texts) packed as JSON lines in their order."""
    path = store.new_path(spark, "images")
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("image"), F.md5("text").alias("hash"))
    lines.pack_images(docs, "image", "hash", path, chunk=300, index="doc_id")
    return lines.json_lines(spark, path, "img_hash string, img_base64 string").select("img_hash", "img_base64", "row_idx")


@query("SELECT event_type || '/score_stats.json' AS name, round(avg(value), 6) AS accuracy FROM events GROUP BY 1")
def accuracy_reports(spark, d):
    """The accuracy of each score report below a folder."""
    path = store.new_path(spark, "scores")
    told = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("accuracy"))
    files = told.select("event_type", F.concat("event_type", F.lit("/score_stats")).alias("at"), F.to_json(F.struct("accuracy")).alias("text"))
    failed = answers.write_each(files.select(F.col("event_type").alias("k"), "text").withColumn("k", F.concat(F.lit("score_stats-"), "k")), "k", "text", _made(spark, path), ".json")
    found = tables.accuracy_files(spark, path).select(F.concat(F.regexp_extract("path", r"score_stats-([^/]*)\.json$", 1), F.lit("/score_stats.json")).alias("name"), "accuracy")
    return found.join(failed, found["name"] == failed["k"], "left_anti")


def _made(spark, path: str) -> str:
    """A folder of the shared file system, made."""
    fs, at = store._fs(spark, path)
    fs.mkdirs(at(path))
    return path


@query("SELECT l_orderkey AS step, min(l_tax) AS loss FROM lineitem GROUP BY 1")
def training_curve(spark, d):
    """The points of a loss curve from a trainer's state file."""
    path = store.new_path(spark, "trainer")
    points = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.min("l_tax").alias("loss"))
    logged = points.select(F.pmod("step", F.lit(7)).alias("f"), F.struct("step", "loss").alias("p")).groupBy("f").agg(F.collect_list("p").alias("log_history"))
    logged.drop("f").write.option("maxRecordsPerFile", 1).json(path)  # a state a file
    return tables.training_log(spark, path)


@query("SELECT sample_id, md5(upper(coalesce(min(instruction), ''))) AS answer FROM prediction WHERE sample_id IS NOT NULL GROUP BY 1 HAVING length(coalesce(min(instruction), '')) % 5 <> 0")
def answered_with_retries(spark, d):
    """A service that fails at first, asked again, and requests that it never answers, which give no row."""
    asked = table(spark, d, "prediction").filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.coalesce(F.min("instruction"), F.lit("")).alias("ask"))

    def service(text: str) -> str:
        if len(text) % 5 == 0:
            raise OSError("busy")
        return text.upper()

    ask = answers.with_retries(service, tries=2, base=0.0, cap=0.0, sleep=lambda _: None)
    return answers.answered(asked, "sample_id", "ask", ask).select("sample_id", F.md5("predict").alias("answer"))


@query("SELECT filename, font_family_dir_name, CASE WHEN svg = '' THEN md5('blank') ELSE md5(svg) END AS image FROM pangram")
def rendered_images(spark, d):
    """Equal drawings are rendered once; those that fail give the blank image."""

    def render(svg: str) -> bytes:
        if not svg:
            raise ValueError("nothing drawn")
        return svg.encode()

    drawn = table(spark, d, "pangram").select("filename", "font_family_dir_name", "svg")
    return answers.rendered_once(drawn, "svg", render, b"blank").select("filename", "font_family_dir_name", F.md5("image").alias("image"))
