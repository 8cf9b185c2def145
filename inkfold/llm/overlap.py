"""Problem 6: records of evaluation splits that repeat a training record, exactly or almost.

Each drawing gets a similarity hash by parity (an odd sketch): every command flips bits that its hash picks, so codes
of two drawings differ by the commands that only one of them has. There are two codes. The wide one has ``m`` segments of 64 bits, a
command flipping about half of the bits of one of them: commands that differ change at most as many segments. The narrow one has 128 bits,
a command flipping one: commands that differ change at most as many bits.

Near copies of a and b commands differ in at most a + b - 2T commands. So segments of the wide code are joined as blocks across the splits, for
one wanted text each, and of the pairs that meet those are kept whose narrow codes are within that Hamming radius; they are verified on
the drawings themselves. No near copy is lost: of ``radius + 2`` blocks of a drawing two at least are equal in any near copy, by
the pigeonhole principle. Where too many commands share segments for that (``thin`` drawings, by chance), the drawing is also in the lists of its
rarest commands, in which two of the kind can't miss each other. Blocks are ordered and cut by measured counts (see ``lists``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm import lists
from inkfold.llm.drawing import drawings, in_order, mix
from inkfold.llm.lists import LONG_LIST
from inkfold.llm.nearcopy import COMMANDS_SQL, DRAWN, SHARE, may_agree, required
from inkfold.operators.skew import filtered_by, spread

#: Segments of the wide code of drawings of up to ``FEW`` commands; each further level has ``LEVEL`` times as many, for as many more commands.
SEGMENTS, FEW, LEVEL = 128, 160, 8
TRAIN = "train"
#: Wanted text of an instruction; a parameter of the operator.
ASKED = r"(?i)text to draw:"


def wanted_text(instruction: Column, marker: str = ASKED) -> Column:
    """The text that an instruction asks to draw: the rest of the line after ``marker`` (a pattern without groups), without
    separators and outer blanks; null if the instruction has no marker."""
    line = F.regexp_extract(instruction, rf"{marker}([^\r\n]*)", 1)
    bare = F.regexp_replace(F.replace(line, F.lit("<|SEP|>"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(instruction.rlike(marker), bare)


def radius(n: np.ndarray, share: float) -> np.ndarray:
    """In how many commands a drawing of ``n`` and a near copy of any size can differ."""
    return np.floor(np.round(n * (1 - share) * max(2, 1 / share), 9)).astype(np.int64)


def _levels(n: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.round(np.log(np.maximum(n, 1) / FEW) / np.log(LEVEL), 9))).astype(np.int64)


def code_blocks(share: float, widest: int = lists.WIDEST) -> lists.Keys:
    """The blocks of a drawing's wide code that it is joined by, a key each, and one key for the drawing as a whole.

    The size of a code goes by the number of commands; drawings from whose size a near copy may be at another level have the codes
    of both. A block's list is as long as that of its rarest command at most, so blocks stand in the order of these."""
    salt = lambda x, k: mix(x ^ mix(np.uint64(k) + np.zeros(1, np.uint64)))

    def keys(offsets: np.ndarray, tokens: np.ndarray, rank: np.ndarray, long_: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        spare, need = radius(n, share), lists.required(n, share)
        stay, cut = lists.kept_and_cut(n, share, lambda m: radius(m, share) + 2, widest)
        code = mix(tokens)
        rows, found = [np.flatnonzero(n)], [salt(np.add.reduceat(salt(tokens, 1), offsets[:-1][n > 0]), 2)]
        low, high = _levels(n), _levels(np.floor(np.round(n / share, 9)))
        for level in range(int(low.min()), int(high.max()) + 1):
            here = ((low <= level) & (level <= high) & (n > 0))[row]
            if not here.any():
                continue
            of, token, bits, often = row[here], tokens[here], code[here], rank[here]
            width = SEGMENTS * LEVEL**level
            segment = (salt(token, 3) % np.uint64(width)).astype(np.int64)
            place = of * width + segment
            order = np.argsort(place)
            begin = np.flatnonzero(np.diff(place[order], prepend=-1))
            block = salt(np.bitwise_xor.reduceat(bits[order], begin) + mix(segment[order][begin].astype(np.uint64)), 16 + level)
            bound, owner = np.minimum.reduceat(often[order], begin), of[order][begin]
            order = in_order(owner, bound, block)
            block, bound, owner = block[order], bound[order], owner[order]
            many = np.bincount(owner, minlength=len(n))
            nth = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
            few = many <= spare + 1
            kept = few[owner] | (nth < spare[owner] + 2)
            got = lists.extended(owner[kept], block[kept], bound[kept] >= long_, stay[owner[kept]], cut[owner[kept]])
            rows.append(got[0])
            found.append(got[1])
            thin = few[of]
            if thin.any():
                of, token, often = of[thin], token[thin], often[thin]
                order = in_order(of, often, token)
                starts = np.searchsorted(of, of)
                kept = order[np.arange(len(of)) - starts < np.minimum(n - need + np.minimum(2, need), n)[of]]
                got = lists.extended(of[kept], salt(token[kept], 4), often[kept] >= long_, stay[of[kept]], cut[of[kept]])
                rows.append(got[0])
                found.append(got[1])
        row, key = np.concatenate(rows), np.concatenate(found)
        order = in_order(row, key)
        return row[order], key[order]

    return keys


def cross_split(rows: DataFrame, row: str, split: str, instruction: str, output: str, share: float = SHARE, long_list: int = LONG_LIST, widest: int = lists.WIDEST, marker: str = ASKED) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` over the records with a split, a wanted text and a drawing.

    members: ``(row, train, rep)``, rep being the smallest row of the same side, text and drawing. links: ``(a, b)`` of
    reps of the evaluation (a) and training side (b) that ask for the same text and whose drawings are near copies.
    ``row`` must be unique. Null splits, instructions without ``marker`` and outputs without a path are in neither: instructions of other
    tasks are compared under a marker of theirs.
    """
    wanted = wanted_text(F.col(instruction), marker)
    asked = rows.select(F.col(row).alias("row"), (F.col(split) == TRAIN).alias("train"), F.xxhash64(wanted).alias("text"), F.col(output).alias("output"), wanted.isNotNull().alias("asks"))
    drawn = store.written(drawings(asked.filter("train IS NOT NULL AND asks"), "output", ["row", "train", "text"]), "coded")
    same = ["text", "train", "print"]
    reps = drawn.groupBy(*same).agg(F.min("row").alias("rep"))
    members = store.written(drawn.select("row", *same).join(reps, same).select("row", "train", "rep"), "sides")
    sets = filtered_by(drawn.drop("print").withColumn("need", required(F.col("n"), share)), members.filter("row <> rep").select("row"), "row", present=False)
    coded = lists.keyed(sets, ["train", "text", *DRAWN], code_blocks(share, widest), *lists.ranks(sets, long_list))
    coded = store.written(coded, "blocks")
    blocks = coded.select("train", "text", F.explode("keys").alias("key"), *DRAWN).withColumn("key", F.xxhash64("text", "key"))
    side = lambda train, s: blocks.filter(F.col("train") if train else ~F.col("train")).select("key", *[F.col(c).alias(f"{c}_{s}") for c in DRAWN])
    met = side(False, "a").join(side(True, "b"), "key").filter(may_agree())
    pairs = store.written(met.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct(), "near")
    ends = store.written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
    some = filtered_by(sets.select("row", "text", "n", "tokens"), ends, "row")
    end = lambda s: some.select(F.col("row").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("text", "n", "tokens")])
    both = pairs.join(end("a"), "a").join(end("b"), "b").filter(F.col("text_a") == F.col("text_b"))
    links = both.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= required(F.greatest("n_a", "n_b"), share)).select("a", "b")
    return members, links


def cross_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(eval, train)``: every evaluation row with every training row that it repeats."""
    left = links.join(members.filter("NOT train").select(F.col("rep").alias("a"), F.col("row").alias("eval")), "a")
    return left.join(members.filter("train").select(F.col("rep").alias("b"), F.col("row").alias("train")), "b").select("eval", "train")


def report(rows: DataFrame, row: str, split: str, metadata: str, members: DataFrame, links: DataFrame) -> DataFrame:
    """``(split, source, records, repeated)`` of the evaluation splits: records, and how many repeat a training record.

    The source is ``metadata.source``, null where the metadata has none or is broken.
    """
    hit = members.filter("NOT train").join(links.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select(F.col("row").alias("_row"), F.lit(1).alias("_hit"))
    tagged = rows.filter(F.col(split) != TRAIN).select(F.col(row).alias("_row"), F.col(split).alias("split"), F.get_json_object(metadata, "$.source").alias("source"))
    return tagged.join(hit, "_row", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("_hit").alias("repeated"))


_COLUMNS = ("row_idx", "split", "instruction", "output")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = spread(spark.read.parquet(f"{sf_dir}/sft.parquet").select(*_COLUMNS))
    pairs = cross_pairs(*cross_split(sft, "row_idx", "split", "instruction", "output"))
    return pairs.select(F.least("eval", "train").alias("row_a"), F.greatest("eval", "train").alias("row_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = spark.read.parquet(f"{sf_dir}/sft.parquet").select(*_COLUMNS, "metadata")
    return report(sft, "row_idx", "split", "metadata", *cross_split(sft, "row_idx", "split", "instruction", "output"))


_OVERLAPS_SQL = rf"""WITH {COMMANDS_SQL},
s AS (SELECT row_idx AS r, split = 'train' AS train, regexp_replace(replace(regexp_extract(instruction, '(?i)text to draw:([^\r\n]*)', 1), '<|SEP|>', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text FROM sft WHERE split IS NOT NULL AND regexp_matches(instruction, '(?i)text to draw:')),
m AS (SELECT s.*, t.command, t.k FROM s JOIN t USING (r)),
o AS (SELECT x.r AS a, y.r AS b, sum(least(x.k, y.k)) AS shared FROM m x JOIN m y ON x.text = y.text AND x.command = y.command AND NOT x.train AND y.train GROUP BY 1, 2),
p AS (SELECT a, b FROM o JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 4 * shared >= 3 * greatest(na.n, nb.n))"""
P6_SQL = _OVERLAPS_SQL + " SELECT least(a, b) AS row_a, greatest(a, b) AS row_b FROM p"
P6_REPORT_SQL = _OVERLAPS_SQL + """ SELECT split, (CASE WHEN json_valid(metadata) THEN metadata END)->>'$.source' AS source, count(*) AS records, count(*) FILTER (WHERE row_idx IN (SELECT a FROM p)) AS repeated
FROM sft WHERE split <> 'train' GROUP BY 1, 2"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
ORACLES = {"p6_found": P6_SQL, "p6_report": P6_REPORT_SQL}
