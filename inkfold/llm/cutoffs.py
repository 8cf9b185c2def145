"""Problem 2: a score cutoff per source that keeps a target fraction of its records.

Scores are whole numbers. A dyadic count tree is kept per source: a node of level ``shift`` stands for the
``2**shift`` scores that agree in all but their lowest ``shift`` bits. Each batch adds its signed node counts;
a cutoff is found by going down from the root, one level at a time, to the node that holds the target rank, and
at the last level (shift 0) a node is one distinct score. What a descent reads of a source is at most
``2**STEP`` nodes a level, however many records there are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm.deltas import summed, touched
from inkfold.operators.skew import filtered_by

#: Parts of the records and of the tree; a parameter, as many as make a part a file of fitting size.
BUCKETS = 16
#: Batches after which the records are compacted.
COMPACT = 32
STEP = 8
SHIFTS = tuple(range(56, -1, -STEP))


def node_counts(scores: DataFrame) -> DataFrame:
    """``(source, score, n)`` with signed n -> ``(source, shift, node, n)`` of every level.

    Counts are summed by distinct score first, so that a source with a third of all rows sends only its
    distinct scores into the shuffle.
    """
    distinct = scores.groupBy("source", "score").agg(F.sum("n").alias("n")).filter("n <> 0")
    levels = F.array(*[F.struct(F.lit(s).alias("shift"), F.shiftright("score", s).alias("node")) for s in SHIFTS])
    return distinct.select("source", "n", F.explode(levels).alias("at")).groupBy("source", "at.shift", "at.node").agg(F.sum("n").alias("n"))


def descend(tree: DataFrame, fraction: float) -> DataFrame:
    """``(source, cutoff, kept, total)``: the smallest score at or below which lie ``fraction`` of a source's records."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    share = F.lit(Decimal(str(fraction))).cast("decimal(18,12)")
    top = tree.filter(F.col("shift") == SHIFTS[0]).groupBy("source").agg(F.sum("n").alias("total")).filter("total > 0")
    at = top.select("source", "total", F.ceil(F.col("total").cast("decimal(19,0)") * share).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("parent"))
    ordered = Window.partitionBy("source").orderBy("node")
    for shift in SHIFTS:
        level = tree.filter((F.col("shift") == shift) & (F.col("n") > 0)).select(F.col("source").alias("s"), "node", "n")
        inside = F.col("s") == F.col("source")
        if shift != SHIFTS[0]:
            inside &= F.shiftright("node", STEP) == F.col("parent")
        upto = F.col("below") + F.sum("n").over(ordered)
        reached = at.join(level, inside).withColumn("upto", upto).filter("upto >= rank")
        at = reached.groupBy("source").agg(F.min(F.struct("node", "n", "upto", "rank", "total")).alias("m")).select("source", "m.total", "m.rank", (F.col("m.upto") - F.col("m.n")).alias("below"), F.col("m.node").alias("parent"), F.col("m.upto").alias("upto"))
        if shift:
            at = at.drop("upto")
    return at.select("source", F.col("parent").alias("cutoff"), F.col("upto").alias("kept"), "total")


class SourceCutoffs:
    """Cutoffs over records that come, change and go in batches; all state is in ``path``.

    A record is a key with a source, a score and a version; of several rows of a key the one of the highest
    version counts (on a tie the larger score), a null version is the lowest. Rows with a null key, source or
    score are no records. ``ingest`` sends to the tree only +1 for what a key has now and -1 for what it had.

    Of the records only those of the batch's keys are looked up, and only changed ones are written, behind the others; ``compact`` leaves
    the last of each key. The tree's parts of untouched sources stay as they are. Records and tree change together.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.state, self.buckets = store.State(spark, path), buckets

    def ingest(self, batch: DataFrame, gone: DataFrame | None = None, name: str | None = None) -> None:
        """``batch``: ``(key, source, score, version)``; ``gone``: keys (column ``key``) to forget. ``name`` names the batch, so that it counts
        once however often it is brought."""
        if self.state.has(name):
            return
        rows = batch.filter(F.col("key").isNotNull() & F.col("source").isNotNull() & F.col("score").isNotNull())
        rows = rows.select("key", F.struct("version", F.col("score").cast("bigint").alias("score"), "source").alias("r")).groupBy("key").agg(F.max("r").alias("r"))
        rows = rows.withColumn("gone", F.lit(False))
        if gone is not None:
            out = gone.filter("key IS NOT NULL").select("key", F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.lit(True).alias("gone")).distinct()
            rows = rows.unionByName(out).groupBy("key").agg(F.max("r").alias("r"), F.max("gone").alias("gone"))
        rows = store.written(rows.withColumn("bucket", store.bucket("key", of=self.buckets)), "batch")
        before = self._held(touched(rows), rows.select("key"))
        if before is None:
            changed = rows.filter("NOT gone").select("key", "bucket", "r", F.lit(None).cast(rows.schema["r"].dataType).alias("old"))
        else:
            met = rows.join(before.select(F.col("key").alias("k"), F.col("r").alias("old")), F.col("key") == F.col("k"), "left")
            met = met.withColumn("r", F.when(~F.col("gone"), F.greatest("r", "old")))
            changed = store.written(met.filter(~F.col("r").eqNullSafe(F.col("old"))).select("key", "bucket", "r", "old"), "changed")
        signed = changed.select(F.explode(F.array(F.struct(F.col("r").alias("r"), F.lit(1).cast("bigint").alias("n")), F.struct(F.col("old").alias("r"), F.lit(-1).cast("bigint").alias("n")))).alias("x"))
        delta = node_counts(signed.filter("x.r IS NOT NULL").select("x.r.source", "x.r.score", "x.n"))
        records = changed.select("key", "r.version", "r.score", "r.source", F.lit(self.state.number() + 1).cast("bigint").alias("change"), "bucket")
        tree = summed(self.state, "tree", delta, ["source", "shift", "node"], ["n"], ["source"], self.buckets)
        self.state.commit({"records": store.Change(records), "tree": tree}, name)
        if self.state.parts("records") > COMPACT:
            self.compact()

    def _held(self, buckets: tuple[int, ...] | None, keys: DataFrame | None = None) -> DataFrame | None:
        """``(key, r)`` of the records that there are, of some keys or all."""
        log = self.state.read("records", buckets)
        if log is None:
            return None
        log = log if keys is None else filtered_by(log, keys, "key")
        last = log.groupBy("key").agg(F.max_by(F.struct("version", "score", "source"), "change").alias("r"))
        return last.filter("r.source IS NOT NULL")

    def counts(self) -> DataFrame:
        """``(source, shift, node, n)``: the tree."""
        return self.state.read("tree")

    def compact(self) -> None:
        """Leave the last of each key among the records."""
        kept = self._held(None).select("key", "r.version", "r.score", "r.source", F.lit(self.state.number()).cast("bigint").alias("change"))
        self.state.commit({"records": store.Change(kept.withColumn("bucket", store.bucket("key", of=self.buckets)), instead=tuple(range(self.buckets)))})

    def cutoffs(self, fraction: float = 0.9) -> DataFrame:
        return descend(self.counts(), fraction)


def keep_fraction(records: DataFrame, fraction: float = 0.9) -> DataFrame:
    """The records (``source, score`` and others) at or below their source's cutoff; null sources and scores are left out."""
    tree = node_counts(records.filter(F.col("source").isNotNull() & F.col("score").isNotNull()).select("source", F.col("score").cast("bigint").alias("score"), F.lit(1).cast("bigint").alias("n")))
    limit = descend(tree, fraction).select(F.col("source").alias("_inkfold_source"), F.col("cutoff").alias("_inkfold_cutoff"))
    return records.join(limit, (F.col("source") == F.col("_inkfold_source")) & (F.col("score") <= F.col("_inkfold_cutoff")), "left_semi")


def renderings(font_meta: DataFrame, pangram: DataFrame) -> DataFrame:
    """``(key, source, score, version)`` of the renderings with a length above 0 of fonts that font_meta knows."""
    fonts = font_meta.filter(F.col("identifier").isNotNull() & F.col("source").isNotNull()).groupBy(F.col("identifier").alias("key")).agg(F.min("source").alias("source"))
    drawn = pangram.filter(F.col("svg_len") > 0).select(F.concat("font_family_dir_name", F.lit("/"), "filename").alias("key"), F.col("svg_len").cast("bigint").alias("score"), F.col("rendered_at").alias("version"))
    return drawn.join(fonts, "key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.read.parquet(f"{sf_dir}/font_meta.parquet").select("identifier", "source")
    drawn = spark.read.parquet(f"{sf_dir}/pangram.parquet").select("font_family_dir_name", "filename", "svg_len", "rendered_at")
    tree = SourceCutoffs(spark, store.new_path(spark, "cutoffs"))
    tree.ingest(renderings(meta, drawn))
    return tree.cutoffs(0.9).select("source", "cutoff", "kept")


P2_SQL = """
WITH fonts AS (SELECT identifier, min(source) AS source FROM font_meta WHERE source IS NOT NULL GROUP BY 1),
latest AS (
  SELECT font_family_dir_name || '/' || filename AS identifier, svg_len,
         row_number() OVER (PARTITION BY font_family_dir_name || '/' || filename ORDER BY rendered_at DESC, svg_len DESC) AS k
  FROM pangram WHERE svg_len > 0),
r AS (SELECT f.source, l.svg_len FROM latest l JOIN fonts f USING (identifier) WHERE l.k = 1),
d AS (SELECT source, svg_len, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT source, svg_len, sum(n) OVER (PARTITION BY source ORDER BY svg_len) AS upto, sum(n) OVER (PARTITION BY source) AS total FROM d)
SELECT source, CAST(min(svg_len) AS BIGINT) AS cutoff, CAST(min(upto) AS BIGINT) AS kept FROM c WHERE upto * 10 >= total * 9 GROUP BY source
"""

QUERIES = {"p2_found": p2_found}
ORACLES = {"p2_found": P2_SQL}
