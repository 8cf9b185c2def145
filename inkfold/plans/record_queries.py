"""Queries: filters, joins, deduplication, sampling, splits and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import hashing
from inkfold.metrics import ocr
from inkfold.operators import dedup, filters, joins, sampling, sets, splits, windows
from inkfold.plans.catalogue import query, table
from inkfold.sources import archives, tables

_SPECIAL = " OR ".join(f"contains(lower(filename), '{m}')" for m in filters.SPECIAL)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM documents")
def scan_row_index(spark, d):
    return windows.numbered(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])


@query(f"SELECT identifier FROM font_meta WHERE NOT ({_SPECIAL}) AND (font_family_dir_name IS NULL OR font_family_dir_name NOT IN (SELECT font_family_dir_name FROM font_meta WHERE num_fonts = 1 AND font_family_dir_name IS NOT NULL))")
def denylist_anti(spark, d):
    fonts = table(spark, d, "font_meta")
    kept = fonts.filter(~filters.name_holds_any(F.col("filename")))
    return filters.without_listed(kept, fonts.filter("num_fonts = 1"), "font_family_dir_name").select("identifier")


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"contains(text, '{c}')" for c in "aeioust-"))
def charset_coverage(spark, d):
    return table(spark, d, "documents").filter(filters.text_covers(F.col("text"), "aeioust-")).select("doc_id")


@query("SELECT filename, svg_len FROM pangram WHERE svg_len > 0 AND svg_len < (SELECT quantile_cont(svg_len, 0.9) FROM pangram)")
def quantile_length_filter(spark, d):
    return filters.below_quantile(table(spark, d, "pangram").select("filename", "svg_len"), "svg_len", 0.9)


@query("""SELECT identifier, style FROM font_meta WHERE (contains(lower(name), 'slab') OR contains(lower(filename), 'slab') OR contains(lower(fullName), 'slab') OR contains(lower(stroke), 'slab')) AND lower(style) = 'italic'""")
def any_field_search(spark, d):
    found = filters.any_field(table(spark, d, "font_meta"), "SLAB", ["name", "filename", "fullName", "stroke"])
    return filters.key_equals(found, "style", "ITALIC").select("identifier", "style")


@query(r"SELECT row_idx, content FROM content WHERE regexp_full_match(content, '[\p{L}\p{N}]+')")
def alnum_filter(spark, d):
    from inkfold.functions.text import is_alphanumeric

    return table(spark, d, "content").filter(is_alphanumeric(F.col("content")))


@query("""SELECT row_idx FROM sft WHERE json_valid(metadata) AND (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.content_str' = 'G<|SEP|>g<|SEP|>A<|SEP|>a'""")
def json_field_filter(spark, d):
    whole = table(spark, d, "sft").filter(F.col("metadata").rlike(r"(?s)^\s*\{.*\}\s*$"))
    return filters.json_equals(whole, "metadata", "$.content_str", "G<|SEP|>g<|SEP|>A<|SEP|>a").select("row_idx")


@query("""WITH t AS (SELECT identifier, list_filter(tags, lambda t: NOT list_contains(list_transform(string_split(name, ' '), lambda w: lower(w)), lower(t))) AS kept FROM font_meta)
SELECT CAST(len(kept) AS BIGINT) AS num, count(*) AS n FROM t GROUP BY 1""")
def tag_exclusion(spark, d):
    from inkfold.operators.aggregates import list_sizes

    fonts = table(spark, d, "font_meta")
    return list_sizes(fonts.select(filters.without_name_tags(F.col("tags"), F.col("name")).alias("kept")), "kept")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def type_filter_notnull(spark, d):
    return filters.typed_and_hashed(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "F").select("o_orderkey", "o_orderpriority")


@query("SELECT sample_id, label FROM prediction WHERE label IS NOT NULL AND label NOT IN ('-', '''', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9')")
def gradable_labels(spark, d):
    return filters.gradable(table(spark, d, "prediction"), F.col("label"), skip_numbers=True).select("sample_id", "label")


@query("""WITH x AS (SELECT DISTINCT identifier, filename FROM font_meta) SELECT identifier FROM x WHERE regexp_matches(lower(filename), 'bold') AND regexp_extract(lower(filename), '\\.([^.]+)$', 1) = 'otf'""".replace("\\\\", "\\"))
def file_names(spark, d):
    fonts = table(spark, d, "font_meta").select("identifier", "filename").distinct()
    return filters.named_files(fonts, "filename", "Bold", ("otf",)).select("identifier")


@query("""WITH dim AS (SELECT raw_tags AS raw, min(tags) AS tag FROM tag_dim WHERE raw_tags IS NOT NULL GROUP BY 1),
t AS (SELECT f.font_family, f.raw_tags, f.tag_weight, CASE WHEN f.raw_tags = '/look/plain' THEN 'plain' ELSE dim.tag END AS tag FROM family_tag f LEFT JOIN dim ON dim.raw = f.raw_tags),
l AS (SELECT font_family, string_agg(tag, ',' ORDER BY raw_tags, tag_weight NULLS FIRST) AS tags, CAST(count(*) AS BIGINT) AS n FROM t WHERE tag IS NOT NULL GROUP BY 1)
SELECT DISTINCT m.name, l.tags, l.n FROM font_meta m JOIN l ON l.font_family = m.name""")
def dim_tag_collect_join(spark, d):
    shown = joins.display_tags(table(spark, d, "family_tag"), table(spark, d, "tag_dim"), {"/look/plain": "plain"})
    families = table(spark, d, "font_meta").select("name").distinct()
    out = joins.collected_tags(families, shown, "name", ["raw_tags"])
    return out.select("name", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("bigint").alias("n"))


def _overlay(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("amount"))
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_acctbal").alias("amount"))
    return joins.overlaid(files, parents, "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice AS amount, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def overlay_left_join(spark, d):
    return _overlay(spark, d)[0]


@query("SELECT count(*) AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice IS DISTINCT FROM c_acctbal")
def overlay_mismatches(spark, d):
    return _overlay(spark, d)[1]


@query("SELECT o.o_orderkey, o.o_custkey, count(l.l_orderkey) AS items FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2")
def unique_key_alignment(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("one"))
    counted = orders.select("o_orderkey", F.lit(0).alias("one")).unionByName(items).groupBy("o_orderkey").agg(F.sum("one").alias("items"))
    return joins.aligned(orders, counted, "o_orderkey")


@query("SELECT f.identifier, p.svg_len FROM (SELECT DISTINCT identifier, font_family_dir_name, filename FROM font_meta) f JOIN pangram p ON p.font_family_dir_name = f.font_family_dir_name AND p.filename = f.filename")
def glyph_lookup_join(spark, d):
    """Fonts looked up among the renderings by the hash of their names; fonts without one are dropped, renderings of unknown fonts not used."""
    key = hashing.word_key(F.col("font_family_dir_name"), F.col("filename")).alias("k")
    fonts = table(spark, d, "font_meta").select("identifier", key).distinct()
    return joins.looked_up(fonts, table(spark, d, "pangram").select(key, "svg_len"), "k").select("identifier", "svg_len")


@query("SELECT identifier AS k FROM font_meta GROUP BY 1 HAVING count(DISTINCT array_to_string(tags, ',')) > 1")
def glyph_key_conflicts(spark, d):
    """Fonts that were delivered with different lists of tags under one identifier."""
    fonts = table(spark, d, "font_meta").select(F.col("identifier").alias("k"), F.array_join("tags", ",").alias("v"))
    return dedup.conflicting_keys(fonts, "k", "v")


_PATHS = r"array_to_string(regexp_extract_all(output, '(?is)<path[^>]*?\sd=\"([^\"]*)\"', 1), chr(10))".replace('\\"', '"')


@query(f"""WITH k AS (SELECT row_idx, split, {_PATHS} AS key FROM sft)
SELECT row_idx, split FROM k WHERE split <> 'train' AND (key IS NULL OR key NOT IN (SELECT key FROM k WHERE split = 'train' AND key IS NOT NULL))""")
def decontaminate_exact(spark, d):
    sft = table(spark, d, "sft").select("row_idx", "split", "output")
    key = hashing.path_content(F.col("output"))
    return joins.decontaminated(sft.filter("split <> 'train'"), sft.filter("split = 'train'"), key, key).select("row_idx", "split")


@query(r"""SELECT doc_id, text FROM documents WHERE EXISTS (SELECT 1 FROM tag_dim WHERE tags <> '' AND contains(text, tags) AND regexp_matches(' ' || text || ' ', '[^\p{L}\p{M}\p{N}_]' || regexp_escape(tags) || '[^\p{L}\p{M}\p{N}_]'))""")
def decontaminate_contains(spark, d):
    return joins.holding_passage(table(spark, d, "documents").select("doc_id", "text"), "text", table(spark, d, "tag_dim"), "tags")


_OCR = "json_valid(metadata) AND (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.task' = 'ocr'"


@query(f"""WITH g AS (SELECT metadata->>'$.identifier' AS vk, lower(replace(trim(predict, ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '<|SEP|>', '')) = lower(replace(trim(label), '<|SEP|>', '')) AS score, written_at, sample_id FROM prediction WHERE {_OCR}),
v AS (SELECT *, row_number() OVER (PARTITION BY vk ORDER BY written_at DESC, sample_id DESC) AS k FROM g)
SELECT f.identifier, v.score AS score_given FROM (SELECT DISTINCT identifier FROM font_meta) f JOIN v ON v.vk = f.identifier AND v.k = 1 WHERE v.score""")
def ocr_filter_join(spark, d):
    asked = table(spark, d, "prediction").filter(F.get_json_object("metadata", "$.task") == "ocr")
    verdicts = ocr.graded(asked, "predict", F.col("label"), use_case=False)
    fonts = table(spark, d, "font_meta").select("identifier").distinct()
    kept, _ = joins.graded_join(fonts, verdicts, "identifier", F.get_json_object("metadata", "$.identifier"), "score", [F.col("written_at"), F.col("sample_id")])
    return filters.true_only(kept, "score_given")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents), b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS i FROM documents), c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS i FROM orders)
SELECT CAST(i - 1 AS BIGINT) AS row_idx, a.doc_id, b.doc_id AS other, b.lang, c.o_orderkey FROM a JOIN b USING (i) JOIN c USING (i)""")
def positional_zip_join(spark, d):
    """Documents beside the same in another order and beside as many orders, by row number."""
    docs = table(spark, d, "documents")
    plain = windows.numbered(docs.select("doc_id"), [F.col("doc_id")])
    mixed = windows.numbered(docs.select(F.col("doc_id").alias("other"), "lang"), [sampling.chance(7, F.col("other")), F.col("other")])
    orders = windows.numbered(table(spark, d, "orders").select("o_orderkey"), [F.desc("o_orderkey")])
    return joins.zipped(plain, mixed, orders.join(plain.select("row_idx"), "row_idx", "left_semi"))


@query("""WITH n AS (SELECT md5(text) AS h, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT count(*) AS differing FROM n a JOIN n b ON b.k = a.k + 1 WHERE a.h IS DISTINCT FROM b.h""")
def two_dataset_key_check(spark, d):
    docs = windows.numbered(table(spark, d, "documents").select("doc_id", "text"), [F.col("doc_id")])
    shifted = docs.select((F.col("row_idx") - 1).alias("row_idx"), F.md5("text").alias("other")).filter("row_idx >= 0")
    whole = docs.join(shifted.select("row_idx"), "row_idx", "left_semi").select("row_idx", F.md5("text").alias("h"))
    return joins.mismatched(joins.zipped(whole, shifted), F.col("h"), "other").agg(F.count("*").alias("differing"))


@query("""WITH done AS (SELECT sample_id, input_hash FROM prediction WHERE latency_sec < 3)
SELECT sample_id FROM prediction WHERE sample_id NOT IN (SELECT sample_id FROM done WHERE sample_id IS NOT NULL) AND (input_hash IS NULL OR input_hash NOT IN (SELECT input_hash FROM done WHERE input_hash IS NOT NULL))""")
def resume_anti_join(spark, d):
    rows = table(spark, d, "prediction").select("sample_id", "input_hash", "latency_sec")
    return joins.not_done(rows, rows.filter("latency_sec < 3"), ["sample_id", "input_hash"]).select("sample_id")


@query("""WITH r AS (SELECT label, predict, latency_sec, row_number() OVER (PARTITION BY label, latency_sec < 3 ORDER BY written_at DESC, sample_id DESC) AS k FROM prediction WHERE label IS NOT NULL AND latency_sec IS NOT NULL),
b AS (SELECT DISTINCT content FROM content WHERE content IS NOT NULL)
SELECT b.content AS label, x.predict AS predict1, y.predict AS predict2 FROM b LEFT JOIN r x ON x.label = b.content AND x.latency_sec < 3 AND x.k = 1 LEFT JOIN r y ON y.label = b.content AND NOT y.latency_sec < 3 AND y.k = 1""")
def multi_run_left_join(spark, d):
    rows = table(spark, d, "prediction")
    base = table(spark, d, "content").filter("content IS NOT NULL").select(F.col("content").alias("label")).distinct()
    return joins.compared_runs(base, [rows.filter("latency_sec < 3"), rows.filter("NOT latency_sec < 3")], "label", "predict", [F.col("written_at"), F.col("sample_id")])


@query("""WITH l AS (SELECT doc_id, lang FROM documents), r AS (SELECT doc_id, lower(lang) AS lang FROM documents WHERE source IS NOT NULL)
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'left only' WHEN l.doc_id IS NULL THEN 'right only' ELSE 'differs' END AS problem
FROM l FULL JOIN r ON l.doc_id = r.doc_id WHERE r.doc_id IS NULL OR l.doc_id IS NULL OR l.lang IS DISTINCT FROM r.lang""")
def dataset_equality(spark, d):
    docs = table(spark, d, "documents")
    return joins.differences(docs.select("doc_id", "lang"), docs.filter("source IS NOT NULL").select("doc_id", F.lower("lang").alias("lang")), ["doc_id"], ["lang"])


@query("SELECT name, stroke, filename, style, weight FROM (SELECT DISTINCT name, first_value(stroke) OVER (PARTITION BY name ORDER BY stroke NULLS LAST) AS stroke, filename, style, weight FROM font_meta WHERE name IS NOT NULL)")
def nested_unnest(spark, d):
    fonts = table(spark, d, "font_meta").filter("name IS NOT NULL")
    families = fonts.groupBy("name").agg(F.min("stroke").alias("stroke"), F.collect_set(F.struct("filename", "style", "weight")).alias("fonts"))
    return joins.unnested(families, "fonts", "name")


@query("""WITH f AS (SELECT DISTINCT identifier, font_family_dir_name, filename FROM font_meta)
SELECT f.identifier, CAST(count(*) AS BIGINT) AS n FROM f JOIN pangram p ON p.font_family_dir_name = f.font_family_dir_name AND p.filename = f.filename GROUP BY 1""")
def family_fan_out(spark, d):
    fonts = table(spark, d, "font_meta").select("identifier").distinct()
    drawn = table(spark, d, "pangram").select(hashing.identifier(F.col("font_family_dir_name"), F.col("filename")).alias("identifier"))
    return joins.fanned_out(fonts, drawn, "identifier").groupBy("identifier").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM k WHERE k = 1")
def keep_first_dedup(spark, d):
    return dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), [F.col("doc_id")]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def kept_keys(spark, d):
    return dedup.kept_keys(table(spark, d, "documents"), F.col("text"), "doc_id")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(i // 5000 AS BIGINT) AS chunk, CAST(i % 7 AS BIGINT) AS shard FROM n""")
def chunk_numbering(spark, d):
    rows = windows.numbered(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return windows.sharded(windows.chunked(rows, "row_idx", 5000), "row_idx", 7).drop("row_idx")


@query("""WITH k AS (SELECT font_family_dir_name, filename, svg_len, row_number() OVER (PARTITION BY font_family_dir_name ORDER BY rendered_at DESC, filename, svg_len NULLS FIRST) AS k FROM pangram)
SELECT font_family_dir_name, filename, svg_len FROM k WHERE k <= 5""")
def per_group_head(spark, d):
    rows = table(spark, d, "pangram").select("font_family_dir_name", "filename", "svg_len", "rendered_at")
    return windows.head_of_each(rows, "font_family_dir_name", [F.desc("rendered_at"), F.col("filename"), F.asc_nulls_first("svg_len")], 5).drop("rendered_at")


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey, arg_max(l_quantity, l_linenumber) AS l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1")
def last_step(spark, d):
    """The whole row of the highest step; steps that come twice in an order are left out, as any of their rows could be the last."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    return filters.last_step(rows.join(once, ["l_orderkey", "l_linenumber"], "left_semi"), ["l_orderkey"], "l_linenumber")


@query("SELECT sample_id, max(written_at) AS written_at, md5(arg_max(coalesce(predict, ''), written_at)) AS answer FROM prediction GROUP BY 1")
def last_duplicate_wins(spark, d):
    """Of answers written twice the last one."""
    last = windows.last_by(table(spark, d, "prediction").select("sample_id", "written_at", F.coalesce("predict", F.lit("")).alias("predict")), "sample_id", "written_at")
    return last.select("sample_id", "written_at", F.md5("predict").alias("answer"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def page_window(spark, d):
    rows = windows.numbered(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])
    return windows.page(rows, "row_idx", 3, 50).select("doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 200")
def seeded_sample(spark, d):
    return sampling.sampled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 200)


def _floyd(step: int) -> str:
    """The SQL of a draw of positions 0 to n - 1 without replacement, one step: the position that is drawn, or the last one if it was."""
    j = f"(n - k + {step})"
    return f"d{step + 1} AS (SELECT identifier, ms, n, k, CASE WHEN k > {step} THEN list_append(s, CASE WHEN list_contains(s, t) THEN {j} ELSE t END) ELSE s END AS s FROM (SELECT *, CAST('0x' || substring(md5('42|' || identifier || '|' || {j}), 1, 15) AS BIGINT) % ({j} + 1) AS t FROM d{step}))"


@query(f"""WITH m AS (SELECT g, list(f ORDER BY f) AS ms, count(*) AS n FROM (SELECT DISTINCT font_family_dir_name AS g, filename AS f FROM pangram WHERE filename IS NOT NULL) GROUP BY 1),
r AS (SELECT DISTINCT identifier, font_family_dir_name AS g FROM font_meta),
d0 AS (SELECT r.identifier, m.ms, m.n, least(1 + CAST('0x' || substring(md5('42|' || r.identifier), 1, 8) AS BIGINT) % 8, m.n) AS k, CAST([] AS BIGINT[]) AS s FROM r LEFT JOIN m USING (g)),
{", ".join(_floyd(step) for step in range(8))}
SELECT identifier, coalesce(array_to_string(list_transform(s, lambda p: ms[p + 1]), ','), '') AS refs FROM d8""")
def group_sample_refs(spark, d):
    rows = table(spark, d, "font_meta").select("identifier", "font_family_dir_name").distinct()
    members = table(spark, d, "pangram").filter("filename IS NOT NULL").select("font_family_dir_name", "filename").distinct()
    return sampling.group_samples(rows, members, "font_family_dir_name", "identifier", "filename").select("identifier", F.array_join("refs", ",").alias("refs"))


@query("""WITH w AS (SELECT row_idx + (row_idx % 3) AS at FROM content) SELECT c.row_idx, c.content FROM w JOIN content c ON c.row_idx = w.at""")
def rows_by_position(spark, d):
    contents = table(spark, d, "content")
    return sampling.by_positions(contents, "row_idx", contents.select((F.col("row_idx") + F.col("row_idx") % 3).alias("at")), "at")


_SPLIT_SQL = """g AS (SELECT DISTINCT font_family_dir_name AS f FROM font_meta WHERE font_family_dir_name IS NOT NULL),
r AS (SELECT f, row_number() OVER (ORDER BY md5('42|' || f), f) AS r FROM g),
i AS (SELECT f, row_number() OVER (ORDER BY md5('43|' || f), f) AS k FROM r WHERE r > 5),
v AS (SELECT f, row_number() OVER (ORDER BY md5('44|' || f), f) AS k FROM r WHERE r > 5),
s AS (SELECT f, CASE WHEN r <= 5 THEN 'ood_test' ELSE 'train' END AS split FROM r UNION ALL SELECT f, 'ind_test' FROM i WHERE k <= 5 UNION ALL SELECT f, 'dev' FROM v WHERE k <= 2)"""


def _splits(spark, d):
    fonts = table(spark, d, "font_meta")
    groups = fonts.filter("font_family_dir_name IS NOT NULL").select("font_family_dir_name").distinct()
    return fonts, splits.drawn(groups, "font_family_dir_name", 5, 5, 2)


@query(f"WITH {_SPLIT_SQL} SELECT m.identifier, s.split FROM font_meta m JOIN s ON s.f = m.font_family_dir_name")
def leak_free_split(spark, d):
    fonts, drawn = _splits(spark, d)
    return splits.with_splits(fonts.select("identifier", "font_family_dir_name"), drawn, "font_family_dir_name").select("identifier", "split")


@query("""WITH f AS (SELECT (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.font_family_dir_name' AS k, max(CAST(split = 'train' AS INT)) AS t, max(CAST(split = 'ood_test' AS INT)) AS o, max(CAST(split = 'ind_test' AS INT)) AS i, max(CAST(split = 'dev' AS INT)) AS v FROM sft GROUP BY 1)
SELECT 'train_and_ood' AS rule, count(*) FILTER (WHERE t = 1 AND o = 1) AS n FROM f UNION ALL SELECT 'ind_not_train', count(*) FILTER (WHERE i = 1 AND t = 0) FROM f UNION ALL SELECT 'dev_not_train', count(*) FILTER (WHERE v = 1 AND t = 0) FROM f""")
def split_overlap(spark, d):
    """The rules over the splits as they were delivered, in which families do overlap."""
    delivered = table(spark, d, "sft").filter(F.col("split").isNotNull()).select(F.get_json_object("metadata", "$.font_family_dir_name").alias("k"), "split")
    return splits.violations(delivered, "k")


@query("SELECT unnest(['train_and_ood', 'ind_not_train', 'dev_not_train']) AS rule, CAST(0 AS BIGINT) AS n")
def drawn_split_overlap(spark, d):
    """The rules over splits that were drawn: none is broken."""
    return splits.violations(_splits(spark, d)[1], "font_family_dir_name")


@query("""SELECT identifier, CASE WHEN CAST('0x' || substring(md5('42|' || font_family_dir_name), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' WHEN CAST('0x' || substring(md5('42|' || font_family_dir_name), 1, 8) AS BIGINT) / 4294967296.0 < 0.9 THEN 'validation' ELSE 'test' END AS split FROM font_meta WHERE font_family_dir_name IS NOT NULL""")
def hashed_split(spark, d):
    fonts = table(spark, d, "font_meta").filter("font_family_dir_name IS NOT NULL").select("identifier", "font_family_dir_name")
    return splits.hashed(fonts, "font_family_dir_name", {"train": 0.8, "validation": 0.1, "test": 0.1}).select("identifier", "split")


@query("SELECT font_family_dir_name FROM font_meta WHERE style = 'italic' AND font_family_dir_name IS NOT NULL INTERSECT SELECT font_family_dir_name FROM font_meta WHERE weight > 500")
def shared_families(spark, d):
    fonts = table(spark, d, "font_meta").filter("font_family_dir_name IS NOT NULL")
    return sets.shared_values(fonts.filter("style = 'italic'"), fonts.filter("weight > 500"), "font_family_dir_name")


@query("""WITH a AS (SELECT content FROM content WHERE content IS NOT NULL UNION SELECT label FROM prediction WHERE label IS NOT NULL AND label NOT LIKE '<%'),
s AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-''', '')) AS content)
SELECT content FROM a EXCEPT SELECT content FROM s""")
def word_set_ops(spark, d):
    words = table(spark, d, "content").filter("content IS NOT NULL").select("content")
    labels = table(spark, d, "prediction").filter("label IS NOT NULL AND NOT label LIKE '<%'").select(F.col("label").alias("content"))
    return sets.words_besides(sets.words_of_all("content", words, labels), sets.alphanumeric_contents(spark), "content")


@query("""WITH l AS (SELECT DISTINCT name AS v FROM font_meta), r AS (SELECT DISTINCT font_family AS v FROM family_tag)
SELECT coalesce(l.v, r.v) AS value, CASE WHEN r.v IS NULL THEN 'left' ELSE 'right' END AS side FROM l FULL JOIN r ON l.v = r.v WHERE l.v IS NULL OR r.v IS NULL""")
def two_way_denylist_diff(spark, d):
    fonts = table(spark, d, "font_meta").select(F.col("name").alias("v"))
    return sets.both_ways(fonts, table(spark, d, "family_tag").select(F.col("font_family").alias("v")), "v")


@query("SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 1 ELSE 5 END AS BIGINT) AS n FROM documents WHERE lang IN ('en', 'de')")
def repeat_and_mix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sets.mixed(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), 5).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-''', '')) AS content")
def content_generator(spark, d):
    return sets.alphanumeric_contents(spark)


@query("SELECT unnest(string_split('" + "".join(sorted({chr(n) for n in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]} - set(sets.UNACCENTED))) + sets.HOOKED + "', '')) AS content")
def accented_generator(spark, d):
    return sets.accented_contents(spark)


@query(r"SELECT DISTINCT unnest(regexp_split_to_array(trim(content), '\s+')) AS content FROM content WHERE trim(content) <> ''")
def listed_words(spark, d):
    return sets.listed_words(table(spark, d, "content"), "content")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'pl')")
def wanted_languages(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isin("en", "de", "pl")).select("doc_id", "lang")


@query("""WITH g AS (SELECT DISTINCT p_type AS f FROM part), r AS (SELECT f, row_number() OVER (ORDER BY md5('7|' || f), f) - 1 AS r FROM g),
t AS (SELECT f FROM r WHERE r BETWEEN 2 AND 5), i AS (SELECT f, row_number() OVER (ORDER BY md5('8|' || f), f) AS k FROM t), v AS (SELECT f, row_number() OVER (ORDER BY md5('9|' || f), f) AS k FROM t)
SELECT f AS p_type, 'ood_test' AS split FROM r WHERE r < 2 UNION ALL SELECT f, 'train' FROM t UNION ALL SELECT f, 'ind_test' FROM i WHERE k <= 2 UNION ALL SELECT f, 'dev' FROM v WHERE k <= 1""")
def limited_train_split(spark, d):
    """Splits of given sizes, the train set limited, too."""
    kinds = table(spark, d, "part").select("p_type").distinct()
    return splits.drawn(kinds, "p_type", 2, 2, 1, n_train=4, seed=7)


@query("""SELECT 'twice' AS pair, (SELECT count(*) FROM nation) = (SELECT count(*) FROM nation) AS equal UNION ALL SELECT 'names', (SELECT count(*) FROM nation) = (SELECT count(*) FROM region) AND NOT EXISTS (SELECT n_name FROM nation EXCEPT SELECT r_name FROM region)""")
def equal_sets(spark, d):
    """Whether two datasets are equal as sets."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region").withColumnRenamed("r_name", "n_name")
    told = [("twice", sets.equal_as_sets(nations, nations.orderBy("n_name"), "n_name")), ("names", sets.equal_as_sets(nations, regions, "n_name"))]
    return spark.createDataFrame(told, "pair string, equal boolean")


@query("SELECT split, content FROM (SELECT 'train' AS split, n_name AS content FROM nation UNION ALL SELECT 'train', r_name FROM region UNION ALL SELECT 'dev', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'dev', r_name FROM region)")
def sets_joined_by_split(spark, d):
    """Datasets behind each other, split by split."""
    of = lambda name, column: table(spark, d, name).select(F.col(column).alias("content"))
    both = sets.joined_by_split([{"train": of("nation", "n_name"), "dev": of("customer", "c_mktsegment").distinct()}, {"train": of("region", "r_name"), "dev": of("region", "r_name")}])
    return both["train"].withColumn("split", F.lit("train")).unionByName(both["dev"].withColumn("split", F.lit("dev")))


@query("SELECT CAST(row_number() OVER (ORDER BY content) - 1 AS BIGINT) AS row_idx, content FROM (SELECT DISTINCT content FROM content WHERE content IS NOT NULL)")
def sorted_word_list(spark, d):
    """The distinct words in order."""
    words = sets.sorted_words(table(spark, d, "content").filter("content IS NOT NULL"), "content")
    return windows.numbered(words, [F.col("content")])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS font_family_dir_name, CAST(p_partkey AS VARCHAR) || '/' || p_name AS identifier, p_type AS first_category, CAST(2 AS BIGINT) AS categories, p_brand = 'Brand#12' AS has_brand FROM part""")
def rename_json_projection(spark, d):
    part = table(spark, d, "part")
    listed = F.to_json(F.array("p_type", "p_brand"))
    market = part.select(F.col("p_partkey").cast("string").alias("ITEM_ID"), F.col("p_name").alias("PATH_IN_ZIP"), F.col("p_name").alias("TITLE"), listed.alias("CATEGORY"), listed.alias("TAGS"), listed.alias("SPACINGS"))
    shaped = tables.in_common_shape(market)
    return shaped.select("font_family_dir_name", "identifier", F.col("category")[0].alias("first_category"), F.size("category").cast("bigint").alias("categories"), F.array_contains("tags", "Brand#12").alias("has_brand"))


@query("""SELECT font_family_dir_name AS path, count(*) FILTER (WHERE suffix = 'ttf') AS ttf, count(*) FILTER (WHERE suffix = 'otf') AS otf FROM (SELECT font_family_dir_name, lower(regexp_extract(filename, '([^.]*)$', 1)) AS suffix FROM font_meta) GROUP BY 1""")
def suffix_pivot_fill0(spark, d):
    listing = table(spark, d, "font_meta").select(F.col("font_family_dir_name").alias("path"), F.lower(F.regexp_extract("filename", r"([^.]*)$", 1)).alias("suffix"))
    return archives.suffix_table(listing, ["ttf", "otf"])
