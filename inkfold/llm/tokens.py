"""Problem 7: encoding with a public byte-level BPE tokenizer, inside Spark's own expressions.

Texts are cut into words by the tokenizer's pattern, once. A word that is itself a piece of the vocabulary is looked up in
a literal rank map; only the distinct other words of the corpus are encoded, by a fold of ranked merges over
their byte arrays. Byte arrays are held as hexadecimal text, a piece as its bytes between blanks. The rank map
is as large as the vocabulary, whatever the corpus.

A fold costs the square of a word's length, so a word of more than ``WINDOW`` bytes is folded in windows that overlap by half. A list
of pieces is the encoding of its bytes if every two neighbours are that of theirs, so two windows may be joined before any piece
that both have at the same place. Words in which some two windows have none (none is known) are folded whole.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold import store
from inkfold.operators.skew import salted_join

#: Folder of the vocabulary files; a parameter of everything below.
TOKENIZERS = "/opt/tokenizers"
CELLS = 8192
# Fixed value: how byte_bpe_50k cuts text into words; (?U) lets \s match white space of all scripts.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LAST = 2**31 - 1
#: Codes of missed words, and bytes of theirs, that may be sent to all tasks; more are joined by a shuffle.
BROADCAST_CODES, BROADCAST_BYTES = 200_000, 16_000_000
#: Bytes of a window, twice the bytes from one to the next.
WINDOW = 256


@cache
def ranks(path: str) -> dict[str, int]:
    """``{bytes of a piece as hexadecimal text: id}`` of a vocabulary of base64 pieces and ranks."""
    return {base64.b64decode(piece).hex().upper(): int(rank) for piece, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


def _vocabulary(name: str, folder: str) -> dict[str, int]:
    return ranks(f"{folder}/{name}.tiktoken")


@cache
def _cells(name: str, folder: str, words: bool) -> str:
    """The vocabulary as an array of small maps; with ``words`` by text, of the pieces that are text, else by hexadecimal bytes."""
    cells: list[dict[str, int]] = [{} for _ in range(CELLS)]
    for piece, rank in _vocabulary(name, folder).items():
        key = piece
        if words:
            try:
                key = bytes.fromhex(piece).decode()
            except UnicodeDecodeError:
                continue
        cells[zlib.crc32(key.encode()) % CELLS][key] = rank
    return json.dumps(cells, separators=(",", ":"))


def rank_of(piece: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, words: bool = False) -> Column:
    """The id of a piece (hexadecimal bytes; with ``words``, text), null if the vocabulary hasn't got it.

    The literal is an array of small maps, picked by hash: a map in Spark is searched from its start.
    """
    cells = F.from_json(F.lit(_cells(name, folder, words)), "array<map<string,int>>")
    return F.try_element_at(F.element_at(cells, (F.crc32(piece) % F.lit(CELLS) + 1).cast("int")), piece)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(hexed: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The pieces (array of hexadecimal text) of a word given as hexadecimal bytes.

    Each round finds the pair of neighbours with the lowest rank and joins all its occurrences from the left; a pair made by
    it ranks higher, so the order of single merges is kept. No pair in the vocabulary left: the rest are no-ops.
    """
    size = (F.length(hexed) / 2).cast("int")
    start = F.regexp_replace(hexed, "(..)", " $1 ")

    def merge(state: Column, _: Column) -> Column:
        pieces = F.split(F.trim(state["text"]), "  ")

        def ranked(p: Column) -> Column:
            pair = lambda i: F.struct(F.coalesce(rank_of(F.concat(F.element_at(p, i), F.element_at(p, i + 1)), name, folder), F.lit(_LAST)).alias("rank"), F.element_at(p, i).alias("a"), F.element_at(p, i + 1).alias("b"))
            return F.array_min(F.transform(F.sequence(F.lit(1), F.size(p) - 1), pair))

        def join(best: Column) -> Column:
            found = F.replace(state["text"], F.concat(F.lit(" "), best["a"], F.lit("  "), best["b"], F.lit(" ")), F.concat(F.lit(" "), best["a"], best["b"], F.lit(" ")))
            return F.when(best["rank"] == _LAST, F.struct(state["text"].alias("text"), F.lit(True).alias("done"))).otherwise(F.struct(found.alias("text"), F.lit(False).alias("done")))

        many = _let(pieces, lambda p: F.when(F.size(p) > 1, _let(ranked(p), join)).otherwise(F.struct(state["text"].alias("text"), F.lit(True).alias("done"))))
        return F.when(state["done"], state).otherwise(many)

    rounds = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    return F.aggregate(rounds, F.struct(start.alias("text"), F.lit(False).alias("done")), merge, lambda s: F.split(F.trim(s["text"]), "  "))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _windowed(words: DataFrame, name: str, folder: str) -> DataFrame:
    """``(id, code)`` of long words ``(id, hexed)``, folded in windows; those whose windows can't be joined are left out."""
    step = WINDOW // 2
    last = F.ceil((F.length("hexed") / 2 - WINDOW) / step).cast("int")
    cut = words.select("id", last.alias("last"), F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.substr("hexed", k * (2 * step) + 1, F.lit(2 * WINDOW)))).alias("k", "part"))
    forms = cut.select("part").distinct().select("part", merged(F.col("part"), name, folder).alias("pieces"))
    each = salted_join(cut, forms, "part", F.xxhash64("id", "k")).select("id", "last", "k", F.posexplode("pieces").alias("nth", "piece"))
    size = F.length("piece") / 2
    placed = each.withColumn("at", (F.col("k") * step + F.sum(size).over(Window.partitionBy("id", "k").orderBy("nth")) - size).cast("bigint"))
    placed = store.written(placed.select("id", "last", "k", "at", rank_of(F.col("piece"), name, folder).alias("code")), "windows")
    cuts = placed.groupBy("id", "at", "code").agg(F.min("k").alias("k"), F.count("*").alias("n")).filter("n = 2").groupBy("id", "k").agg(F.min("at").alias("cut"))
    begins = placed.join(cuts.select("id", (F.col("k") + 1).alias("k"), F.col("cut").alias("begin")), ["id", "k"], "left").join(cuts.select("id", "k", F.col("cut").alias("end")), ["id", "k"], "left")
    kept = begins.filter((F.col("at") >= F.coalesce("begin", F.lit(0))) & F.coalesce(F.col("at") < F.col("end"), F.lit(True)))
    whole = F.count_distinct(F.when(F.col("begin").isNotNull(), F.col("k"))) == F.max("last")
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("found"), whole.alias("whole")).filter("whole").select("id", F.transform("found", lambda x: x["code"]).alias("code"))


def coded(words: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(word)``, distinct, -> ``(word, code)``: the ids of each word's pieces."""
    folded = lambda hexed: F.transform(merged(hexed, name, folder), lambda p: rank_of(p, name, folder))
    short = F.octet_length("word") <= WINDOW
    out = words.filter(short).select("word", folded(F.hex("word")).alias("code"))
    long_ = store.written(words.filter(~short).select(F.unhex(F.md5("word")).alias("id"), "word"), "long")
    if long_.isEmpty():
        return out
    known = store.written(_windowed(long_.select("id", F.hex("word").alias("hexed")), name, folder), "windowed")
    rest = long_.join(known.select("id"), "id", "left_anti").select("word", folded(F.hex("word")).alias("code"))
    return out.unionByName(long_.join(known, "id").select("word", "code")).unionByName(rest)


def encode(rows: DataFrame, key: str, text: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``out``, the ids of ``text`` without special tokens; an empty list for an empty and a null text.

    All columns are kept, or those of ``keep``; ``out`` replaces a column of that name. ``key`` should be unique; repeated and null keys
    are encoded right, too. Special tokens' strings in a text are ordinary text.
    """
    columns = [c for c in (rows.columns if keep is None else keep) if c != out]
    cut = rows.select(*columns, F.col(key).alias("_inkfold_key"), words_of(F.col(text)).alias("_inkfold_words"))
    # a missed word stands in the ids as a number below 0, its hash; where two of a text have one hash, the word's place among the missed ones
    mark = lambda w: (-1 - F.xxhash64(w).bitwiseAND(F.lit(2**30 - 1))).cast("int")
    looked = cut.withColumn("_inkfold_ids", F.transform("_inkfold_words", lambda w: F.coalesce(rank_of(w, name, folder, words=True), mark(w))))
    looked = looked.withColumn("_inkfold_missed", F.array_distinct(F.filter("_inkfold_words", lambda w, i: F.get("_inkfold_ids", i) < 0)))
    looked = looked.withColumn("_inkfold_placed", F.size(F.array_distinct(F.transform("_inkfold_missed", mark))) < F.size("_inkfold_missed"))
    place = lambda i, k: F.when(i < 0, -F.array_position("_inkfold_missed", F.get("_inkfold_words", k)).cast("int")).otherwise(i)
    ids = F.when(F.col("_inkfold_placed"), F.transform("_inkfold_ids", place)).otherwise(F.col("_inkfold_ids"))
    # stored, so that words are cut and looked up once
    stored = store.written(looked.select(*columns, "_inkfold_key", ids.alias("_inkfold_ids"), "_inkfold_missed", "_inkfold_placed"), "pieces")
    some = stored.filter(F.size("_inkfold_missed") > 0).select("_inkfold_key", F.xxhash64("_inkfold_missed").alias("_inkfold_list"), "_inkfold_missed", "_inkfold_placed")
    rare = some.dropDuplicates(["_inkfold_key", "_inkfold_list"]).select("_inkfold_key", "_inkfold_list", "_inkfold_placed", F.posexplode("_inkfold_missed").alias("slot", "word"))
    rare = rare.select("_inkfold_key", "_inkfold_list", F.when(F.col("_inkfold_placed"), -1 - F.col("slot")).otherwise(mark(F.col("word"))).alias("slot"), "word")
    codes = store.written(coded(store.written(some.select(F.explode("_inkfold_missed").alias("word")).distinct(), "words"), name, folder), "codes")
    size = codes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word") + 4 * F.size("code")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_CODES and size["bytes"] <= BROADCAST_BYTES:
        known = rare.join(F.broadcast(codes), "word")
    else:
        known = salted_join(rare, codes, "word", F.xxhash64("_inkfold_key", "slot"))
    known = known.groupBy("_inkfold_key", "_inkfold_list").agg(F.map_from_entries(F.collect_list(F.struct("slot", "code"))).alias("_inkfold_codes"))
    known = known.select(F.col("_inkfold_key").alias("_inkfold_known"), F.col("_inkfold_list").alias("_inkfold_same"), "_inkfold_codes")
    joined = stored.join(known, F.col("_inkfold_key").eqNullSafe(F.col("_inkfold_known")) & (F.xxhash64("_inkfold_missed") == F.col("_inkfold_same")), "left")
    filled = F.flatten(F.transform("_inkfold_ids", lambda i: F.when(i < 0, F.try_element_at("_inkfold_codes", i)).otherwise(F.array(i))))
    done = F.when(F.col("_inkfold_codes").isNull(), F.col("_inkfold_ids")).otherwise(filled)
    return joined.select(*columns, F.coalesce(done, F.array().cast("array<int>")).alias(out))


@cache
def _pieces(name: str, folder: str) -> str:
    table = _vocabulary(name, folder)
    by_id = {rank: piece for piece, rank in table.items()}
    return json.dumps([by_id.get(i, "") for i in range(max(by_id) + 1)], separators=(",", ":"))


def decoded_bytes(ids: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The bytes of a list of ids: their pieces, joined. An id outside of the vocabulary gives null."""
    pieces = F.from_json(F.lit(_pieces(name, folder)), "array<string>")
    found = F.transform(ids, lambda i: F.try_element_at(pieces, i + 1))
    return F.when(~F.exists(found, lambda p: p.isNull()), F.unhex(F.array_join(found, "")))


def decode(rows: DataFrame, ids: str, out: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``rows`` with ``out``, the text of ``ids``; null for null, for unknown ids and for bytes that aren't UTF-8."""
    raw = decoded_bytes(F.col(ids), name, folder)
    return rows.withColumn(out, F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, "doc_id", "text", keep=["doc_id"])


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
