"""Problem 4: records whose drawings nearly agree, by T-occurrence search in which long lists are set aside (DivideSkip).

Two drawings of a and b commands are near copies if they share at least T = ceil(share * max(a, b)). Equal drawings are
one class and are searched once. A drawing's inverted lists are taken by measured length, short ones first (see ``lists``): the
``n - T + MERGED`` first ones are merged, sorted by key in the shuffle, which stands for the heap. Near copies share ``MERGED`` tokens
at least of these, so they meet twice at least in them, whether or not some of the lists are long. A pair that meets once can't reach
T, nor can one whose 128 parity bits differ in more places than the tokens that may be missing (what is dropped by that is never a
near copy). The other, longer lists are never read through: each candidate's tokens are probed for them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm import lists
from inkfold.llm.drawing import drawings, in_order
from inkfold.llm.lists import LONG_LIST
from inkfold.operators.skew import filtered_by, spread

SHARE = 0.75
#: What is known of a drawing in a list.
DRAWN = ("row", "n", "need", "p0", "p1")
#: Tokens that near copies share at least of those they are listed by (all T, if that is less).
MERGED = 3


def required(n: Column, share: float = SHARE) -> Column:
    """The least overlap of a drawing of ``n`` commands with any near copy of its size or below."""
    return F.ceil(n * F.lit(f"{share}").cast("decimal(6,4)")).cast("int")


def may_agree(a: str = "a", b: str = "b") -> Column:
    """Whether sizes and parity bits of two drawings allow them to be near copies: columns ``n``, ``need`` (``required``), ``p0`` and
    ``p1`` of either end. All whole numbers, as this is asked of every pair that meets."""
    c = lambda name, end: F.col(f"{name}_{end}")
    apart = F.bit_count(c("p0", a).bitwiseXOR(c("p0", b))) + F.bit_count(c("p1", a).bitwiseXOR(c("p1", b)))
    need = F.greatest(c("need", a), c("need", b))
    return (apart <= c("n", a) + c("n", b) - 2 * need) & (F.least(c("n", a), c("n", b)) >= need)


def first_tokens(share: float, merged: int = MERGED, widest: int = lists.WIDEST) -> lists.Keys:
    """The lists of a drawing's ``n - T + merged`` tokens of the shortest lists."""

    def taken(n: np.ndarray) -> np.ndarray:
        need = lists.required(n, share)
        return np.minimum(n - need + np.minimum(merged, need), n)

    def keys(offsets: np.ndarray, tokens: np.ndarray, rank: np.ndarray, long_: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        order = in_order(row, rank, tokens)
        first = order[np.arange(len(row)) - offsets[:-1][row] < taken(n)[row]]
        kept, cut = lists.kept_and_cut(n, share, taken, widest)
        of = row[first]
        return lists.extended(of, tokens[first], rank[first] >= long_, kept[of], cut[of])

    return keys


def candidates(listed: DataFrame, merged: int = MERGED) -> DataFrame:
    """``(a, b)``, a < b: pairs of drawings that meet often enough in the lists and whose sizes and parity bits allow the overlap."""
    side = lambda s: listed.select(F.explode("keys").alias("key"), *[F.col(c).alias(f"{c}_{s}") for c in DRAWN])
    met = side("a").join(side("b"), "key").filter((F.col("row_a") < F.col("row_b")) & may_agree())
    least = F.when(F.least("need_a", "need_b") >= merged, merged - 1).otherwise(1)
    return met.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b"), least.alias("least")).agg(F.count("*").alias("met")).filter("met >= least").select("a", "b")


def probed(pairs: DataFrame, sets: DataFrame, share: float = SHARE) -> DataFrame:
    """``(a, b, overlap)`` of the pairs that are near copies, by probing all of their lists."""
    wanted = store.written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted")
    some = filtered_by(sets.select("row", "n", "tokens"), wanted, "row")
    left = pairs.join(some.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    both = left.join(some.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    overlap = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    return overlap.filter(F.col("overlap") >= required(F.greatest("na", "nb"), share)).select("a", "b", "overlap")


def classes(drawn: DataFrame, row: str) -> DataFrame:
    """``(row, rep)``: each drawing with the smallest row whose drawing is equal to it."""
    reps = drawn.groupBy("print").agg(F.min(row).alias("rep"))
    return drawn.select(F.col(row).alias("row"), "print").join(reps, "print").select("row", "rep")


def near_copies(rows: DataFrame, row: str, output: str, share: float = SHARE, long_list: int = LONG_LIST, widest: int = lists.WIDEST) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(row, rep)`` of every drawing, and ``(a, b, overlap)`` of the near copies among the reps.

    ``row`` must be unique. Rows with a null or empty text or without a path are in neither. An empty table gives two
    empty ones. Other columns, whatever their names, are not read.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    drawn = store.written(drawings(rows.select(F.col(row).alias("row"), F.col(output).alias("output")), "output", ["row"]), "drawings")
    members = store.written(classes(drawn, "row"), "members")
    sets = filtered_by(drawn.select("row", "n", required(F.col("n"), share).alias("need"), "p0", "p1", "tokens"), members.filter("row <> rep").select("row"), "row", present=False)
    listed = store.written(lists.keyed(sets, [*DRAWN], first_tokens(share, widest=widest), *lists.ranks(sets, long_list)), "lists")
    pairs = store.written(candidates(listed), "pairs")
    return members, probed(pairs, sets, share)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(row_a, row_b)``, a < b: every two rows of a class and of linked classes."""
    several = members.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep")
    some = members.join(several, "rep", "left_semi")
    inside = some.select("rep", F.col("row").alias("row_a")).join(some.select("rep", F.col("row").alias("row_b")), "rep").filter("row_a < row_b").select("row_a", "row_b")
    left = links.join(members.select(F.col("rep").alias("a"), F.col("row").alias("x")), "a")
    across = left.join(members.select(F.col("rep").alias("b"), F.col("row").alias("y")), "b")
    return inside.unionByName(across.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")))


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(row, class, links)``: one row a drawing, with the representative of its equals and its number of linked classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("row", F.col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = spread(spark.read.parquet(f"{sf_dir}/sft.parquet").select("row_idx", "output"))
    return expanded(*near_copies(sft, "row_idx", "output"))


#: ``(row, command, k)`` and ``(row, n)``: the commands of each drawing, counted, with their numbers as values.
COMMANDS_SQL = r"""d AS (SELECT row_idx AS r, unnest(regexp_extract_all(output, '(?is)<path\b[^<>]*?[^\w:-]d\s*=\s*("[^"<>]*|''[^''<>]*)', 1))[2:] AS d FROM sft),
c AS (SELECT r, unnest(regexp_extract_all(d, '[A-DF-Za-df-z][^A-DF-Za-df-z]*')) AS c FROM d),
v AS (SELECT r, c[1] || array_to_string(list_transform(regexp_extract_all(c[2:], '[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?'), lambda x: CAST(CAST(x AS DOUBLE) + 0.0 AS VARCHAR)), ' ') AS command FROM c),
t AS (SELECT r, command, count(*) AS k FROM v GROUP BY 1, 2),
n AS (SELECT r, CAST(sum(k) AS BIGINT) AS n FROM t GROUP BY 1)"""

P4_SQL = f"""WITH {COMMANDS_SQL},
o AS (SELECT x.r AS a, y.r AS b, sum(least(x.k, y.k)) AS shared FROM t x JOIN t y ON x.command = y.command AND x.r < y.r GROUP BY 1, 2)
SELECT a AS row_a, b AS row_b FROM o JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 4 * shared >= 3 * greatest(na.n, nb.n)"""

QUERIES = {"p4_found": p4_found}
ORACLES = {"p4_found": P4_SQL}
