"""Archives and binary files, read a file a row: listing, members with digests, arrays, font headers, nested text."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def binary_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)


def _ignored(name: str) -> bool:
    return name.endswith("/") or any(part == "__MACOSX" or part.startswith(".") for part in name.split("/"))


def zip_listing(files: DataFrame) -> DataFrame:
    """``(path, member, suffix, size)`` of the members of zip files, but for folders, dot files and system folders; a broken
    archive gives one row with a null member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    members = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except zipfile.BadZipFile:
                    out.append((path, None, None, None))
                    continue
                out += [(path, m.filename, m.filename.rsplit(".", 1)[-1].lower() if "." in m.filename else "", m.file_size) for m in members if not _ignored(m.filename)]
            yield pd.DataFrame(out, columns=["path", "member", "suffix", "size"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, suffix string, size bigint")


def zip_members(files: DataFrame) -> DataFrame:
    """``(path, member, content, md5)`` of all members; a member that can't be read has null content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                out = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    names = [m.filename for m in archive.infolist() if not _ignored(m.filename)]
                except zipfile.BadZipFile:
                    archive, names = None, []
                for name in names:
                    try:
                        data = archive.read(name)
                        out.append((path, name, data, hashlib.md5(data).hexdigest()))
                    except (zipfile.BadZipFile, RuntimeError, OSError):
                        out.append((path, name, None, None))
                yield pd.DataFrame(out, columns=["path", "member", "content", "md5"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, md5 string")


def verified_members(members: DataFrame, wanted: DataFrame, item: str, member: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """``(extracted, failed)``: members whose digest is the wanted one; and wanted members that are missing, unreadable, without a known
    digest or of another one, with the reason. ``members`` needs ``item``."""
    found = members.select(F.col(item).alias("_i"), F.col("member").alias("_m"), "content", F.lower("md5").alias("_md5"))
    joined = wanted.join(found, (F.col(item) == F.col("_i")) & (F.col(member) == F.col("_m")), "left")
    reason = F.when(F.col("_m").isNull(), "missing").when(F.col("content").isNull(), "unreadable").when(F.col(digest).isNull(), "no digest").when(F.lower(digest) != F.col("_md5"), "other digest")
    marked = joined.withColumn("reason", reason).drop("_i", "_m", "_md5")
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").drop("content")


def suffix_table(listing: DataFrame, suffixes: list[str]) -> DataFrame:
    """One row an archive: how many members of each suffix it has, 0 for none."""
    return listing.groupBy("path").pivot("suffix", suffixes).agg(F.count(F.lit(1))).na.fill(0, suffixes)


def arrays(files: DataFrame) -> DataFrame:
    """``(path, shape, values)`` of ``.npy`` files as doubles; objects are not loaded."""

    @F.pandas_udf("struct<shape: array<bigint>, values: array<double>>")
    def load(contents: pd.Series) -> pd.DataFrame:
        loaded = [np.load(io.BytesIO(c), allow_pickle=False) for c in contents]
        return pd.DataFrame({"shape": [list(a.shape) for a in loaded], "values": [a.astype(float).ravel().tolist() for a in loaded]})

    return files.select("path", load("content").alias("a")).select("path", "a.shape", "a.values")


def _characters(data: bytes, at: int) -> list[str]:
    """The characters that a font's character map gives a glyph, of its widest Unicode subtable (formats 0, 4, 6, 12)."""
    count = struct.unpack(">H", data[at + 2 : at + 4])[0]
    found = [struct.unpack(">HHI", data[at + 4 + 8 * k : at + 12 + 8 * k]) for k in range(count)]
    wide = {(3, 10): 3, (0, 6): 3, (0, 4): 3, (3, 1): 2, (0, 3): 2}
    ranked = sorted(((wide.get((p, e), 1 if p == 0 else 0), at + offset) for p, e, offset in found), reverse=True)
    if not ranked:
        return []
    at = ranked[0][1]
    kind = struct.unpack(">H", data[at : at + 2])[0]
    if kind == 0:
        codes = [k for k in range(256) if data[at + 6 + k]]
    elif kind == 6:
        first, n = struct.unpack(">HH", data[at + 6 : at + 10])
        codes = [first + k for k, g in enumerate(struct.unpack(f">{n}H", data[at + 10 : at + 10 + 2 * n])) if g]
    elif kind == 4:
        n = struct.unpack(">H", data[at + 6 : at + 8])[0] // 2
        rows = np.frombuffer(data, ">u2", 4 * n + 1, at + 14).astype(np.int64)
        ends, starts, deltas, offsets = rows[:n], rows[n + 1 : 2 * n + 1], rows[2 * n + 1 : 3 * n + 1], rows[3 * n + 1 :]
        codes = []
        for k in range(n):
            span = np.arange(starts[k], min(ends[k], 0xFFFE) + 1)
            if not len(span):
                continue
            glyphs = span
            if offsets[k]:
                base = at + 16 + 6 * n + 2 * k + int(offsets[k])
                glyphs = np.frombuffer(data, ">u2", len(span), base).astype(np.int64)
            codes += span[(glyphs + np.where(glyphs > 0, deltas[k], 0) if offsets[k] else glyphs + deltas[k]) % 65536 > 0].tolist()
    elif kind == 12:
        n = struct.unpack(">I", data[at + 12 : at + 16])[0]
        groups = np.frombuffer(data, ">u4", 3 * n, at + 16).reshape(n, 3).tolist()
        codes = [c for first, last, glyph in groups for c in range(first, last + 1) if glyph + c - first]
    else:
        raise ValueError(f"character map of format {kind}")
    return [chr(c) for c in sorted(set(codes)) if not 0xD800 <= c < 0xE000]


def _names(data: bytes, at: int) -> dict[int, str]:
    """The texts of a font's name table by number, the English one of several."""
    _, count, texts = struct.unpack(">HHH", data[at : at + 6])
    out: dict[int, tuple[int, str]] = {}
    for k in range(count):
        platform, _, language, number, size, start = struct.unpack(">6H", data[at + 6 + 12 * k : at + 18 + 12 * k])
        raw = data[at + texts + start : at + texts + start + size]
        text = raw.decode("mac-roman" if platform == 1 else "utf-16-be", "replace")
        out[number] = max(out.get(number, (-1, "")), ((platform == 3) * 2 + (language in (0, 0x409)), text), key=lambda x: x[0])
    return {number: text for number, (_, text) in out.items()}


_FONT = (
    "tables array<string>, units_per_em bigint, created bigint, ascender bigint, descender bigint, line_gap bigint, weight_class bigint, "
    "typo_ascender bigint, typo_descender bigint, typo_line_gap bigint, names map<int, string>, characters array<string>"
)


def _font(data: bytes) -> dict:
    """What the table directory of a font leads to; OS/2, name and cmap may be missing."""
    if data[:4] == b"ttcf":
        start = struct.unpack(">I", data[12:16])[0]
    elif data[:4] in (b"\0\1\0\0", b"OTTO", b"true"):
        start = 0
    else:
        raise ValueError("not a font")
    at = {}
    for k in range(struct.unpack(">H", data[start + 4 : start + 6])[0]):
        tag, _, place, _ = struct.unpack(">4sIII", data[start + 12 + 16 * k : start + 28 + 16 * k])
        at[tag.decode("latin-1")] = place
    number = lambda table, offset, kind: struct.unpack_from(kind, data, at[table] + offset)[0]
    out = {"tables": sorted(at), "units_per_em": number("head", 18, ">H"), "created": number("head", 20, ">q")}
    out |= {name: number("hhea", 4 + 2 * k, ">h") for k, name in enumerate(("ascender", "descender", "line_gap"))}
    if "OS/2" in at:
        out |= {"weight_class": number("OS/2", 4, ">H")} | {f"typo_{name}": number("OS/2", 68 + 2 * k, ">h") for k, name in enumerate(("ascender", "descender", "line_gap"))}
    if "name" in at:
        out["names"] = _names(data, at["name"])
    if "cmap" in at:
        out["characters"] = _characters(data, at["cmap"])
    return out


def font_headers(files: DataFrame) -> DataFrame:
    """``(path, tables, units_per_em, created, ascender, descender, line_gap, weight_class, typo_*, names, characters, error)`` of font files, read
    from their table directories; ``characters`` are those that have a glyph, as ``filters.covers`` asks for.

    A file that isn't a font gives its error. No font library is needed; ``created`` counts seconds from 1904. Tables that a font lacks give nulls.
    """
    fields = [part.split()[0] for part in re.split(r",\s(?![^<]*>)", _FONT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append({"path": path} | _font(content) | {"error": None})
                except (ValueError, KeyError, struct.error) as error:
                    out.append({"path": path, "error": str(error) or "broken"})
            rows = [{f: list(r[f].items()) if f == "names" and r.get(f) is not None else r.get(f) for f in ("path", *fields, "error")} for r in out]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = f"path string, {_FONT}, error string"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return files.dropDuplicates(["path"]).select("path", "content").mapInArrow(run, ddl)


_FIELD = re.compile(r'\s*(?:#[^\n]*\n\s*)*(?:(\w+)\s*:\s*("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[^\s{}"\']+)|(\w+)\s*:?\s*\{|(\}))')


def message_fields(text: str) -> dict[str, list]:
    """A message in protobuf text form as names with all their values, nested messages as such dictionaries."""
    root: dict[str, list] = {}
    stack, at = [root], 0
    while at < len(text.rstrip()):
        found = _FIELD.match(text, at)
        if not found:
            raise ValueError(f"unreadable at {at}")
        name, value, group, _ = found.groups()
        if name:
            quoted = value[0] in "\"'"
            stack[-1].setdefault(name, []).append(bytes(value[1:-1], "utf-8").decode("unicode_escape").encode("latin-1").decode("utf-8") if quoted else value)
        elif group:
            inner: dict[str, list] = {}
            stack[-1].setdefault(group, []).append(inner)
            stack.append(inner)
        elif len(stack) == 1:
            raise ValueError(f"closed too often at {at}")
        else:
            stack.pop()
        at = found.end()
    if len(stack) > 1:
        raise ValueError("not closed")
    return root


def family_messages(files: DataFrame) -> DataFrame:
    """Family metadata in protobuf text form, one a file, in the nested shape of a family; an unreadable file gives its error."""
    member = "struct<name: string, filename: string, style: string, weight: int, fullName: string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    m = message_fields(content.decode())
                    first = lambda d, *names: next((d[n][0] for n in names if n in d), None)
                    fonts = [{"name": first(f, "name"), "filename": first(f, "filename"), "style": first(f, "style"), "weight": int(w) if (w := first(f, "weight")) else None, "fullName": first(f, "full_name", "fullName")} for f in m.get("fonts", [])]
                    out.append((path, first(m, "name"), m.get("category", []), first(m, "stroke"), m.get("classifications", []), fonts, None))
                except (ValueError, UnicodeDecodeError) as error:
                    out.append((path, None, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["path", "name", "category", "stroke", "classifications", "fonts", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, name string, category array<string>, stroke string, classifications array<string>, fonts array<{member}>, error string")
