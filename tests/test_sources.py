"""Sources, sinks and the request stream, written and read in a temporary folder."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold import schemas, store
from inkfold.operators import filters
from inkfold.sources import answers, archives, lines, tables
from inkfold.streaming import requests


def tuples(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 3}\n')
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "z": [1]}')
    return tmp_path


def test_rows_are_numbered_by_file_and_line(spark, folder):
    rows = lines.json_lines(spark, str(folder), "a int")
    assert tuples(rows, "row_idx") == [(0, 1), (1, 2), (2, 3)]
    lines.touch_all(rows)


def test_bad_lines(spark, folder):
    (folder / "c.jsonl").write_text('\n{"a": \n7\n{"a": 4}\n')
    records, counts = lines.lenient_json_lines(spark, str(folder), "a int")
    assert sorted(r.a for r in records.collect()) == [1, 2, 3, 4]
    assert {r.file[-7:]: (r.lines, r.blank, r.broken) for r in counts.collect()}["c.jsonl"] == (4, 1, 2)
    with pytest.raises(Exception):  # noqa: B017
        lines.json_lines(spark, str(folder), "a int").collect()


def test_line_ends_are_counted(spark, folder):
    assert lines.line_count(spark, str(folder)).first().lines == 2


def test_contents_and_raw_lines(spark, tmp_path):
    (tmp_path / "c.txt").write_text("  Yes \n\n'\nà la\n")
    assert [r.content for r in lines.contents(spark, str(tmp_path)).orderBy("row_idx").collect()] == ["Yes", "'", "à la"]
    assert lines.raw_lines(spark, str(tmp_path), strip="newline").filter("value = '  Yes '").count() == 1


def test_recursive_scan_leaves_out_its_own_output(spark, folder):
    (folder / "sub").mkdir()
    (folder / "sub" / "score.jsonl").write_text('{"a": 9}\n')
    assert lines.raw_lines(spark, str(folder), recursive=True, exclude="score.jsonl").count() == 3
    assert lines.raw_lines(spark, str(folder), recursive=True).count() == 4


def test_chunked_sink_and_guard(spark, tmp_path):
    rows = spark.range(12).coalesce(1)
    lines.write_json_lines(rows, str(tmp_path / "out"), chunk=5, order=[F.col("id")])
    assert len(list((tmp_path / "out").glob("part-*.json"))) >= 3
    target = f"file://{tmp_path}/guarded"
    assert lines.write_unless_there(rows, target) and not lines.write_unless_there(rows, target)
    assert lines.write_unless_there(rows.limit(1), target, overwrite=True) and spark.read.parquet(target).count() == 1
    assert requests.is_complete(spark, target) and not requests.is_complete(spark, f"file://{tmp_path}/none")


def test_rewrite_keeps_files_apart(spark, folder):
    records, _ = lines.lenient_json_lines(spark, str(folder), "a int")
    lines.rewrite_by_file(records, str(folder / "out"))
    assert {(r.src_file, r.a) for r in spark.read.json(str(folder / "out")).collect()} == {("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 3)}


def test_resume_appends_what_is_missing(spark, tmp_path):
    target = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    assert lines.resume_append(rows, target, "sample_id") == 2
    assert lines.resume_append(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), target, "sample_id") == 1
    assert lines.resume_append(rows, target, "sample_id") == 0
    assert spark.read.json(target).count() == 3


def test_images_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"y" * 100, "h1"), (0, b"x", "h0")], "row_idx int, image binary, h string")
    lines.pack_images(rows, "image", "h", str(tmp_path / "img"))
    text = [json.loads(x) for p in sorted((tmp_path / "img").glob("part-*")) for x in p.read_text().splitlines()]
    assert [t["img_hash"] for t in text] == ["h0", "h1"] and "\n" not in text[1]["img_base64"]


def test_manifests():
    columns = {"prompt": "instruction"}
    made = lines.manifest({"train": ["0.jsonl"], "logs": ["x.txt"], "dev": ["0.jsonl"]}, columns)
    made["train"]["columns"]["images"] = "images"
    assert list(made) == ["dev", "train"] and made["dev"]["columns"] == columns
    merged = lines.merged_manifests({"a": {"dev": made["dev"]}, "b": {"dev": made["dev"]}})
    assert merged["b/dev"]["file_name"] == "b/dev"
    with pytest.raises(ValueError):
        lines.merged_manifests({"a": {"dev": {"file_name": "other"}}})


def test_split_manifest(spark):
    counts = spark.createDataFrame([("train", 3, 1)], "split string, num_samples bigint, num_failed_samples bigint")
    assert json.loads(lines.split_manifest(counts)) == {"train": {"num_samples": 3, "num_failed_samples": 1}}


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("Fam,,/look/x,12.5\nFam,,/look/y,\n")
    assert tuples(tables.family_tags(spark, str(tmp_path / "tags.csv"))) == [("Fam", "/look/x", 12.5), ("Fam", "/look/y", None)]
    (tmp_path / "dim.csv").write_text("/look/x,0,100,x\n")
    assert tables.tag_dimension(spark, str(tmp_path / "dim.csv")).first().tags == "x"
    (tmp_path / "files.csv").write_text('ITEM_ID,PATH_IN_ZIP,FILE_TYPE,MD5\n1,"a ""b"".ttf",ttf,ff\n')
    (tmp_path / "zips.csv").write_text('ITEM_ID,TITLE,BRAND,CATEGORY,TAGS,SPACINGS\n1,T,B,"[""c""]","[""t"", ""u""]",broken\n')
    files, zips = tables.market_tables(spark, str(tmp_path / "files.csv"), str(tmp_path / "zips.csv"))
    row = tables.in_common_shape(files.join(zips, "ITEM_ID")).first()
    assert (row.filename, row.tags, row.spacings, row.identifier) == ('a "b".ttf', ["t", "u"], None, '1/a "b".ttf')
    splits = spark.createDataFrame([(0, "x", "train"), (1, "y", "dev")], "index bigint, content string, split string")
    assert tables.write_split_index(splits, str(tmp_path / "split")) == ["dev", "train"]
    assert tuples(tables.split_index(spark, str(tmp_path / "split/dev.tsv"), schemas.SPLIT_CONTENT)) == [(1, "y")]


def test_merge_and_copy(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")
    tables.merged([a, b], str(tmp_path / "m"))
    tables.copied(spark, str(tmp_path / "m"), str(tmp_path / "n"))
    assert sorted(tuples(spark.read.parquet(str(tmp_path / "n"))), key=str) == [(1, None), (None, "x")]


def test_reports(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "metrics_clip.json").write_text('{"mean": 0.5, "psnr": "Infinity", "deep": {"x": 1}, "note": "text"}')
    (tmp_path / "run1" / "score_stats_a.json").write_text('{"accuracy": 0.25}')
    (tmp_path / "state.json").write_text('{"log_history": [{"step": 1, "loss": 2.5}, {"step": 2}]}')
    got = {r.metric: r.value for r in tables.metric_files(spark, str(tmp_path), r"metrics_(\w+)\.json").collect()}
    assert got == {"clip/mean": 0.5, "clip/psnr": float("inf"), "clip/deep.x": 1.0}
    assert tables.accuracy_files(spark, str(tmp_path)).first().accuracy == 0.25
    assert tuples(tables.training_log(spark, str(tmp_path / "state.json"))) == [(1, 2.5)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("f/a.ttf", b"font")
        z.writestr("__MACOSX/a.ttf", b"")
        z.writestr(".hidden", b"")
    (tmp_path / "two.zip").write_bytes(b"broken")
    files = archives.binary_files(spark, str(tmp_path), "*.zip")
    assert {(r.path[-7:], r.member, r.suffix) for r in archives.zip_listing(files).collect()} == {("one.zip", "f/a.ttf", "ttf"), ("two.zip", None, None)}
    members = archives.zip_members(files).withColumn("item", F.lit("1"))
    md5 = hashlib.md5(b"font").hexdigest()
    wanted = spark.createDataFrame([("1", "f/a.ttf", md5), ("1", "f/b.ttf", md5), ("1", "f/a.ttf", None), ("1", "f/a.ttf", "00")], "item string, m string, d string")
    good, failed = archives.verified_members(members, wanted, "item", "m", "d")
    assert [bytes(r.content) for r in good.collect()] == [b"font"]
    assert sorted(r.reason for r in failed.collect()) == ["missing", "no digest", "other digest"]


def test_arrays_and_font_headers(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.arange(6).reshape(2, 3))
    (tmp_path / "x.npy").write_bytes(buffer.getvalue())
    row = archives.arrays(archives.binary_files(spark, str(tmp_path), "*.npy")).first()
    assert row["shape"] == [2, 3] and row["values"] == [0, 1, 2, 3, 4, 5]
    head, hhea = struct.pack(">18xHq", 1000, 99), struct.pack(">4xhhh", 800, -200, 50)
    start = 12 + 32
    table = lambda tag, at, data: struct.pack(">4sIII", tag, 0, at, len(data))
    font = b"\0\1\0\0" + struct.pack(">HHHH", 2, 0, 0, 0) + table(b"head", start, head) + table(b"hhea", start + len(head), hhea) + head + hhea
    (tmp_path / "a.ttf").write_bytes(font)
    (tmp_path / "b.ttf").write_bytes(b"nothing")
    got = {r.path[-5:]: r for r in archives.font_headers(archives.binary_files(spark, str(tmp_path), "*.ttf")).collect()}
    assert (got["a.ttf"].units_per_em, got["a.ttf"].ascender, got["a.ttf"].descender, got["a.ttf"].created) == (1000, 800, -200, 99)
    assert got["b.ttf"].error == "not a font"


def test_family_messages(spark, tmp_path):
    (tmp_path / "METADATA.pb").write_text('name: "Fam"  # note\ncategory: "SERIF"\nfonts {\n  name: "Fam"\n  filename: "F.ttf"\n  style: "normal"\n  weight: 400\n  full_name: "Fam \\"R\\""\n}\nstroke: "Slab"\n')
    (tmp_path / "BAD.pb").write_text("fonts {")
    rows = {r.path.rsplit("/", 1)[1]: r for r in archives.family_messages(archives.binary_files(spark, str(tmp_path), "*.pb")).collect()}
    fam = rows["METADATA.pb"]
    assert (fam.name, fam.category, fam.stroke, fam.fonts[0].weight, fam.fonts[0].fullName) == ("Fam", ["SERIF"], "Slab", 400, 'Fam "R"')
    assert rows["BAD.pb"].error == "not closed"


def test_answers_and_retries(spark):
    calls, waits = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError
        return text.upper()

    assert answers.with_retries(flaky, 3, sleep=waits.append)("a") == "A" and len(waits) == 2 and waits[0] < waits[1] * 2
    rows = spark.createDataFrame([(1, "ok"), (2, "fail")], "k int, q string")

    def ask(text):
        if text == "fail":
            raise OSError
        return text

    assert tuples(answers.answered(rows, "k", "q", ask).select("k", "predict")) == [(1, "ok")]


def test_equal_drawings_render_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "i int, svg string")

    def render(text):
        if text == "bad":
            raise ValueError
        return text.encode() * 2

    got = {r.i: r.image for r in answers.rendered_once(rows, "svg", render, b"-").collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: b"aa", 2: b"aa", 3: b"-", 4: None}
    answers.write_each(rows.filter("i < 3"), "i", "svg", str(tmp_path), ".svg")
    assert (tmp_path / "1.svg").read_text() == "a"
    assert answers.side_by_side(rows.filter("i < 4"), "svg", "i", 3).first().svg == "a\na\nbad"


def test_stream_answers_each_key_once(spark, tmp_path):
    source, out, state = tmp_path / "in", f"file://{tmp_path}/out", str(tmp_path / "state")
    source.mkdir()
    (source / "1.json").write_text('{"k": "a"}\n{"k": "b"}\n{"k": "a"}\n')
    answer = lambda batch: batch.withColumn("v", F.upper("k"))

    def run():
        stream = requests.request_stream(spark, str(source), "k string", 1)
        requests.answer_stream(stream, "k", answer, out, state).awaitTermination()

    run()
    (source / "2.json").write_text('{"k": "b"}\n{"k": "c"}\n')
    run()
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == ["A", "B", "C"]


def test_event_time_windows_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 00:01:00", "x", 1.0), ("2025-01-01 00:02:00", "x", 2.0), ("2025-01-01 00:07:00", "x", 4.0)], "t string, kind string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "ev"))
    stream = requests.event_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev")), "t", "kind", "v")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.total for r in spark.table("windows").collect()) == [3.0, 4.0]


def test_state_changes_as_a_whole(spark, tmp_path, monkeypatch):
    state = store.State(spark, f"file://{tmp_path}/s")
    rows = lambda *xs: spark.createDataFrame([(x, x % 4) for x in xs], "x int, bucket int")
    values_ = lambda table, buckets=None: sorted(r.x for r in state.read(table, buckets).collect())
    assert state.read("a") is None and not state.has("one")
    state.commit({"a": store.Change(rows(1, 2, 5)), "b": store.Change(rows(7))}, "one")
    assert values_("a") == [1, 2, 5] and values_("a", [1]) == [1, 5] and values_("b") == [7] and state.has("one")
    state.commit({"a": store.Change(rows(9)), "b": store.Change(rows())})
    assert values_("a") == [1, 2, 5, 9] and state.parts("a") == 2
    for stop in ("_put", "children"):  # a batch that stops before its manifest has changed nothing
        with monkeypatch.context() as m:
            m.setattr(store, stop, lambda *_: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                state.commit({"a": store.Change(rows(13, 3), instead=(1, 3)), "b": store.Change(rows(8))}, "two")
        assert values_("a") == [1, 2, 5, 9] and values_("b") == [7] and not state.has("two")
    state.commit({"a": store.Change(rows(13, 3), instead=(1, 3)), "b": store.Change(rows(8))}, "two")
    assert values_("a") == [2, 3, 13] and values_("b") == [7, 8] and state.parts("a") == 1 and state.has("two")
    state.commit({"a": store.Change(rows(), instead=(0, 1, 2, 3))})
    assert values_("a") == [] and values_("b") == [7, 8]
    folders = [n for n in store.children(spark, f"file://{tmp_path}/s") if n[0] == "d"]
    assert len([n for n in folders if "-a-" in n]) <= 3 and len(store.children(spark, f"file://{tmp_path}/s")) - len(folders) == 2
    other = store.State(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(other, "number", lambda: 3)
    with pytest.raises(FileExistsError):
        other.commit({"a": store.Change(rows(1))})


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    of = lambda master, conf=None, checkpoint=None: store.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: checkpoint, master=master, applicationId="app")))
    assert of("yarn", "hdfs://x/") == "hdfs://x" and of("yarn", None, "hdfs://y") == "hdfs://y"
    assert of("local[2]").startswith("file://") and of("local") == of("local[2]")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            of(master)


def a_font(maps, names=(), os2=True):
    """A font of tables only: head, hhea and, if wanted, OS/2, name and a character map of ``(platform, encoding, subtable)``."""
    import struct

    tables = {"head": bytes(18) + struct.pack(">Hq", 1000, 3_000_000_000) + bytes(26), "hhea": bytes(4) + struct.pack(">hhh", 900, -200, 10) + bytes(26)}
    if os2:
        tables["OS/2"] = bytes(4) + struct.pack(">H", 700) + bytes(62) + struct.pack(">hhh", 800, -150, 50)
    at, body = 4 + 8 * len(maps), b""
    if maps:
        head = struct.pack(">HH", 0, len(maps))
        for platform, encoding, sub in maps:
            head += struct.pack(">HHI", platform, encoding, at + len(body))
            body += sub
        tables["cmap"] = head + body
    if names:
        texts, records = b"", b""
        for platform, language, number, text in names:
            raw = text.encode("mac-roman" if platform == 1 else "utf-16-be")
            records += struct.pack(">6H", platform, 1, language, number, len(raw), len(texts))
            texts += raw
        tables["name"] = struct.pack(">HHH", 0, len(names), 6 + len(records)) + records + texts
    out, place = b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += struct.pack(">4sIII", tag.encode(), 0, place, len(data))
        place += len(data)
    return out + b"".join(tables.values())


def test_characters_and_names_of_fonts(spark):
    import struct

    four = lambda segments: struct.pack(">HHHHHHH", 4, 0, 0, 2 * len(segments), 0, 0, 0) + b"".join(struct.pack(f">{len(segments)}H", *[s[k] % 65536 for s in segments]) + (b"\0\0" if k == 1 else b"") for k in (1, 0, 2, 3))
    plain = four([(65, 70, -60, 0), (97, 98, -97, 0), (0xFFFF, 0xFFFF, 1, 0)])  # a has glyph 0
    listed = four([(65, 67, 0, 4), (0xFFFF, 0xFFFF, 1, 0)]) + struct.pack(">HHH", 5, 0, 7)  # glyphs from an array, B has none
    wide = struct.pack(">HHIIIIIIIII", 12, 0, 0, 0, 2, 65, 66, 1, 0x1F600, 0x1F601, 3)
    fonts = {
        "plain": a_font([(3, 1, plain)], [(1, 0, 1, "Caf\u00e9"), (3, 0x409, 1, "Café Sans"), (3, 0x407, 1, "Kaffee"), (3, 0x409, 2, "Bold")]),
        "listed": a_font([(0, 3, listed)], os2=False),
        "wide": a_font([(3, 1, plain), (3, 10, wide)]),
        "bytes": a_font([(1, 0, struct.pack(">HHH", 0, 262, 0) + bytes(65) + b"\1\2" + bytes(189))]),
        "run": a_font([(0, 3, struct.pack(">HHHHHHH", 6, 0, 0, 48, 2, 9, 0))]),
        "odd": a_font([(0, 3, struct.pack(">H", 2))]), "none": a_font([]), "no": b"text",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in fonts.items()], "path string, content binary")
    got = {r.path: r for r in archives.font_headers(files).collect()}
    assert "".join(got["plain"].characters) == "ABCDEFb" and got["plain"].names == {1: "Café Sans", 2: "Bold"}
    assert "".join(got["listed"].characters) == "AC" and got["listed"].weight_class is None and got["listed"].names is None
    assert "".join(got["wide"].characters) == "AB😀😁" and "".join(got["bytes"].characters) == "AB" and "".join(got["run"].characters) == "0"
    assert (got["plain"].units_per_em, got["plain"].ascender, got["plain"].descender, got["plain"].line_gap, got["plain"].weight_class) == (1000, 900, -200, 10, 700)
    assert (got["plain"].typo_ascender, got["plain"].typo_descender, got["plain"].typo_line_gap) == (800, -150, 50)
    assert got["none"].characters is None and got["none"].error is None and got["no"].error == "not a font" and "format 2" in got["odd"].error
    covered = archives.font_headers(files).filter(filters.covers(F.col("characters"), "AB")).select("path").collect()
    assert {r.path for r in covered} == {"plain", "wide", "bytes"}
