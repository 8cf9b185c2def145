"""Problem 5: train, validation and test splits in which everything that is tied together stays together.

Families are tied when their last directories are spelled alike or when they hold a file of the same name. Ties
are reduced to components by hooking (each root takes the smallest root it is tied to) and pointer jumping, both
as joins over tables in the shared folder. The component table is kept: a later batch brings only its own ties,
merged over the roots they touch. A component keeps its split; new ones fill what the splits lack; where a batch
ties components of different splits together, the merged component is quarantined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold import store
from inkfold.llm.deltas import touched
from inkfold.operators.skew import filtered_by

QUARANTINE = "quarantine"
#: Parts of each table of the state; a parameter, as many as make a part a file of fitting size.
BUCKETS = 8
CELLS = 1024


def folded(name: Column) -> Column:
    """A name without letter case, white space, ``-`` and ``_``."""
    return F.regexp_replace(F.lower(name), r"(?U)[\s_-]+", "")


def directory_key(path: Column) -> Column:
    """The last directory of a path, folded; null where nothing is left of it."""
    last = F.regexp_extract(F.regexp_replace(path, r"(?U)[\s/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.nullif(folded(last), F.lit(""))


def file_key(name: Column) -> Column:
    """A file name without folder, extension and copy marks such as ``(2)``, folded; null where nothing is left."""
    base = F.regexp_extract(F.regexp_replace(name, r"(?U)\s+$", ""), r"([^/\\]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(base, r"(?i)\.(ttf|otf|ttc|otc|woff2?|eot|svg|pfb)\s*(?=(\(\d+\)\s*)*$)", ""), r"(\s*\(\d+\))+\s*$", "")
    bare = F.regexp_replace(bare, r"(?i)\.(ttf|otf|ttc|otc|woff2?|eot|svg|pfb)$", "")
    return F.nullif(folded(bare), F.lit(""))


def ties(rows: DataFrame, family: str = "font_family_dir_name", filename: str = "filename") -> DataFrame:
    """``(node, key)``: each family value with the keys that tie it; rows without a family tie nothing."""
    known = rows.filter(F.col(family).isNotNull()).select(F.col(family).alias("node"), F.col(filename).alias("f"))
    keys = F.array(F.concat(F.lit("d:"), directory_key(F.col("node"))), F.concat(F.lit("f:"), file_key(F.col("f"))))
    return known.select("node", F.explode(keys).alias("key")).distinct()


def _hubs(tied: DataFrame) -> DataFrame:
    """Ties as edges ``(a, b)``, a > b, from each node to the smallest of its key: one edge a row, not a pair a pair."""
    hub = tied.filter("key IS NOT NULL").groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return tied.join(hub, "key").filter("node > b").select(F.col("node").alias("a"), "b").distinct()


def roots_of(edges: DataFrame, name: str = "roots") -> DataFrame:
    """``(node, root)`` for every end of an edge: root is the smallest node of its component.

    Each round hooks roots to smaller ones, jumps pointers until they are flat and carries the edges over to the new
    roots; edges inside one component fall away, so the rounds grow with the logarithm of a component's size. Every
    round is written to the shared folder: a lost executor costs one round.
    """
    edges = store.written(edges, name)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parent = store.written(nodes.select("node", F.col("node").alias("root")), name)
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to"))
        hooks = store.written(hooks, name)
        while True:  # pointer jumping: every hook ends at a root that has no hook of its own
            onward = hooks.select(F.col("from").alias("via"), F.col("to").alias("next"))
            jumped = hooks.join(onward, F.col("to") == F.col("via"), "left").select("from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            jumped = store.written(jumped, name)
            hooks = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        parent = parent.join(hooks, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        parent = store.written(parent, name)
        ends = hooks
        for end in ("a", "b"):
            edges = edges.join(ends.select(F.col("from").alias("f"), F.col("to").alias("t")), F.col(end) == F.col("f"), "left").withColumn(end, F.coalesce("t", end)).drop("f", "t")
        edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = store.written(edges, name)
    return parent


def components(tied: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``(node, key)``; a node that shares no key is its own root."""
    roots = roots_of(_hubs(tied))
    return tied.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def fill_deficits(new: DataFrame, held: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(root, split)`` for new components ``(root, weight)``, given ``(split, weight)`` that the splits hold.

    Components stand in an order of size class (largest first) and hash; each takes the split in whose part of the
    line of deficits its first record falls, the largest deficit first. The running sum is taken over cells of the order
    and then within each cell, so no task sees all components.
    """
    cell = F.struct((-F.floor(F.log2(F.col("weight")))).alias("size"), F.pmod(F.xxhash64("root"), F.lit(CELLS)).alias("h"))
    placed = new.select("root", "weight", cell.alias("cell"))
    totals = placed.groupBy("cell").agg(F.sum("weight").alias("w"))
    starts = totals.select(F.col("cell").alias("c"), (F.sum("w").over(Window.orderBy("cell")) - F.col("w")).alias("start"))
    line = placed.join(starts, F.col("cell") == F.col("c")).select("root", (F.col("start") + F.sum("weight").over(Window.partitionBy("cell").orderBy(F.xxhash64("root"), "root")) - F.col("weight")).alias("at"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("weight"))), F.lit(0))
    have = held.agg(*[part(s).alias(f"h_{s}") for s in shares]).crossJoin(totals.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("coming")))
    whole = reduce(lambda a, b: a + b, [F.col(f"h_{s}") for s in shares]) + F.col("coming")
    want = F.array(*[F.struct((F.greatest(F.lit(share) * whole - F.col(f"h_{s}"), F.lit(0.0))).alias("lack"), F.lit(s).alias("split")) for s, share in shares.items()])
    lacks = have.select(F.sort_array(want, asc=False).alias("lacks"), "coming")
    lacks = lacks.select("lacks", (F.col("coming") / F.greatest(F.aggregate("lacks", F.lit(0.0), lambda acc, x: acc + x["lack"]), F.lit(1e-9))).alias("scale"))
    pick = F.aggregate(
        "lacks",
        F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("split")),
        lambda acc, x: F.struct((acc["upto"] + x["lack"] * F.col("scale")).alias("upto"), F.coalesce(acc["split"], F.when(F.col("at") < acc["upto"] + x["lack"] * F.col("scale"), x["split"])).alias("split")),
    )
    return line.crossJoin(F.broadcast(lacks)).select("root", F.coalesce(pick["split"], F.col("lacks")[0]["split"]).alias("split"))


class FamilySplits:
    """Splits over batches of records; all state is in ``path`` and changes as a whole with each batch.

    State: ``keys`` (a tie's key and its smallest family), ``members`` (a family and the component it came into), ``merges`` (components
    that went into others, and which root they have now), ``components`` (root, split, records) and ``totals`` (records of each split).
    A batch looks up its own keys, families and the components these are in, in the parts of the state that hold them; of the rest it reads
    only ``merges``, which has a row for each component ever merged.
    """

    def __init__(self, spark: SparkSession, path: str, shares: dict[str, float] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.shares, self.buckets = spark, shares or {"train": 0.8, "validation": 0.1, "test": 0.1}, buckets
        self.state = store.State(spark, path)

    def _bucketed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("bucket", store.bucket(key, of=self.buckets))

    def _looked_up(self, table: str, keys: DataFrame, key: str, schema: str) -> DataFrame:
        """The rows of a table for some keys (stored, with their bucket)."""
        held = self.state.read(table, touched(keys))
        return self.spark.createDataFrame([], schema) if held is None else filtered_by(held, keys.select(key), key)

    def ingest(self, rows: DataFrame, family: str = "font_family_dir_name", filename: str = "filename", name: str | None = None) -> None:
        """Add records. Rows without a family are left out here; ``assign`` gives them a null split. Rows of a batch that repeat family and
        file count as one record. ``name`` names the batch, so that it counts once however often it is brought."""
        if self.state.has(name):
            return
        kind = dict(rows.dtypes)[family]
        first = not self.state.number()
        kept = store.written(rows.filter(F.col(family).isNotNull()).select(F.col(family).alias("node"), F.col(filename).alias("f")).distinct(), "rows")
        tied = store.written(self._bucketed(ties(kept, "node", "f").filter("key IS NOT NULL"), "key"), "ties")
        weights = kept.groupBy("node").agg(F.count("*").alias("weight"))
        merges = self.state.read("merges")
        if first:
            known, old = tied.select("node", "key"), weights.select("node", F.col("node").alias("root"), F.lit(True).alias("fresh"), "weight")
        else:
            hubs = self._looked_up("keys", tied.select("key", "bucket").distinct(), "key", f"node {kind}, key string").select("node", "key")
            known = store.written(tied.select("node", "key").unionByName(hubs), "known")  # a key's smallest earlier node stands for all of its nodes
            nodes = store.written(self._bucketed(known.select("node").union(weights.select("node")).distinct(), "node"), "nodes")
            was = self._looked_up("members", nodes, "node", f"node {kind}, component {kind}")
            was = was.join(merges.select(F.col("component").alias("c"), F.col("root").alias("r")), F.col("component") == F.col("c"), "left").select("node", F.coalesce("r", "component").alias("had"))
            old = nodes.join(was, "node", "left").join(weights, "node", "left").select("node", F.coalesce("had", "node").alias("root"), F.col("had").isNull().alias("fresh"), F.coalesce("weight", F.lit(0)).alias("weight"))
        old = store.written(old, "old")
        root = lambda end, r: old.select(F.col("node").alias(end), F.col("root").alias(r))
        edges = _hubs(known).join(root("a", "ra"), "a").join(root("b", "rb"), "b")
        moved = roots_of(edges.filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        moved = store.written(moved.select(F.col("node").alias("from"), F.col("root").alias("to")), "moved")
        final = lambda some, c: some.join(moved, F.col(c) == F.col("from"), "left").withColumn("to", F.coalesce("to", c)).drop("from")
        nothing = self.spark.createDataFrame([], f"root {kind}, split string, weight bigint")
        roots = None if first else store.written(self._bucketed(old.select("root").distinct(), "root"), "roots")
        parts = nothing if first else store.written(self._looked_up("components", roots, "root", f"root {kind}, split string, weight bigint"), "parts")
        coming = old.groupBy("root").agg(F.sum("weight").alias("weight")).select("root", F.lit(None).cast("string").alias("split"), "weight")
        now = final(parts.select("root", "split", "weight").unionByName(coming), "root").groupBy(F.col("to").alias("root")).agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.sum("weight").alias("weight"))
        now = store.written(now, "now")
        stay = now.filter("lo IS NOT NULL").select("root", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(QUARANTINE).alias("split"), "weight")
        totals = self.state.read("totals")
        signed = stay.select("split", "weight").union(parts.select("split", -F.col("weight")))
        held = (signed if totals is None else signed.union(totals.select("split", "weight"))).groupBy("split").agg(F.sum("weight").alias("weight"))
        added = fill_deficits(now.filter("lo IS NULL").select("root", "weight"), held, self.shares)
        placed = stay.unionByName(now.join(added, "root").select("root", "split", "weight"))
        placed = store.written(self._bucketed(placed, "root"), "placed")
        hit = tuple(range(self.buckets)) if first else tuple(sorted({*touched(roots), *touched(placed)}))
        if not first:
            others = self.state.read("components", hit)
            placed = placed.unionByName(self._bucketed(filtered_by(others, roots.select("root"), "root", present=False), "root"))
        counted = store.written(held.union(now.join(added, "root").select("split", "weight")).groupBy("split").agg(F.sum("weight").alias("weight")), "totals")
        whole = lambda frame: store.Change(frame.withColumn("bucket", F.lit(0)), instead=(0,))
        changes = {"components": store.Change(placed, instead=hit), "totals": whole(counted)}
        changes["members"] = store.Change(self._bucketed(final(old.filter("fresh"), "root").select("node", F.col("to").alias("component")), "node"))
        gone = moved.filter("from <> to").join(old.filter("NOT fresh").select(F.col("root").alias("from")).distinct(), "from", "left_semi").select(F.col("from").alias("component"), F.col("to").alias("root"))
        if merges is not None:
            gone = final(merges, "root").select("component", F.col("to").alias("root")).unionByName(gone)
        changes["merges"] = whole(gone)
        hit = tuple(range(self.buckets)) if first else touched(tied)
        changes["keys"] = store.Change(self._keys(known, hit), instead=hit)
        self.state.commit(changes, name)

    def _keys(self, known: DataFrame, buckets: tuple[int, ...]) -> DataFrame:
        """All keys of the parts that have some of the batch's, each with its smallest family."""
        held = self.state.read("keys", buckets)
        every = known.select("node", "key") if held is None else known.select("node", "key").unionByName(held.select("node", "key"))
        return self._bucketed(every.groupBy("key").agg(F.min("node").alias("node")).select("node", "key"), "key")

    def families(self) -> DataFrame:
        """``(family, root, split)``."""
        merges = self.state.read("merges").select(F.col("component").alias("c"), F.col("root").alias("r"))
        rooted = self.state.read("members").join(merges, F.col("component") == F.col("c"), "left").select(F.col("node").alias("family"), F.coalesce("r", "component").alias("root"))
        return rooted.join(self.state.read("components").select("root", "split"), "root").select("family", "root", "split")

    def assign(self, rows: DataFrame, family: str = "font_family_dir_name") -> DataFrame:
        """``rows`` with their family's ``split``; null for rows without a family or of one never ingested."""
        have = self.families().select(F.col("family").alias("_inkfold_family"), F.col("split").alias("_inkfold_split"))
        return rows.join(have, F.col(family) == F.col("_inkfold_family"), "left").drop("_inkfold_family").withColumn("split", F.col("_inkfold_split")).drop("_inkfold_split")


def family_pairs(members: DataFrame) -> DataFrame:
    """``(family_a, family_b)``, a < b by code points, for every two families of one component ``(family, root)``."""
    several = members.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    some = members.join(several, "root", "left_semi")
    other = some.select(F.col("family").alias("family_b"), F.col("root").alias("r"))
    return some.join(other, (F.col("root") == F.col("r")) & (F.col("family") < F.col("family_b"))).select(F.col("family").alias("family_a"), "family_b")


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[FamilySplits, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/font_meta.parquet").select("font_family_dir_name", "filename")
    splits = FamilySplits(spark, store.new_path(spark, "families"))
    splits.ingest(rows)
    return splits, rows


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_pairs(_ingested(spark, sf_dir)[0].families().select("family", "root"))


def p5_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, families and components of each split; records without a family have none and are the row of the null split."""
    splits, rows = _ingested(spark, sf_dir)
    sized = splits.assign(rows).groupBy("split").agg(F.count("*").alias("records"))
    told = splits.families().groupBy(F.col("split").alias("s")).agg(F.countDistinct("family").alias("families"), F.countDistinct("root").alias("components"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sized.join(told, F.col("split").eqNullSafe(F.col("s")), "full").select(F.coalesce("split", "s").alias("split"), zero("families"), zero("components"), zero("records"))


P5_SQL = r"""
WITH RECURSIVE n AS (
  SELECT DISTINCT font_family_dir_name AS v,
    regexp_replace(lower(regexp_extract(regexp_replace(font_family_dir_name, '[\s/\\]+$', ''), '([^/\\]*)$', 1)), '[\s_-]+', '', 'g') AS d,
    regexp_replace(lower(regexp_replace(regexp_replace(filename, '\.(ttf|otf|TTF|OTF)$', ''), '(\s*\(\d+\))+\s*$', '')), '[\s_-]+', '', 'g') AS f
  FROM font_meta WHERE font_family_dir_name IS NOT NULL),
e AS (
  SELECT DISTINCT a.v AS x, b.v AS y FROM n a JOIN n b ON a.d = b.d UNION SELECT DISTINCT a.v, b.v FROM n a JOIN n b ON a.f = b.f),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS family_a, y AS family_b FROM r WHERE x < y
"""

QUERIES = {"p5_found": p5_found, "p5_split_sizes": p5_split_sizes}
ORACLES = {"p5_found": P5_SQL}
