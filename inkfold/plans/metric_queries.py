"""Queries: vector, image and point-cloud metrics over the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.metrics import clouds, pixels, registry, vectors
from inkfold.plans.catalogue import query, table


def _pairs(spark, d):
    """Each vector with the next one by id."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


_PAIRS = "WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "


@query(_PAIRS + "SELECT vec_id, round((list_cosine_similarity(a, b) + 1) / 2, 6) AS dino, round(list_cosine_similarity(a, b) * 100, 4) AS clip FROM p")
def cosine_scores(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(vectors.rescaled_cosine(F.col("a"), F.col("b")), 6).alias("dino"), F.round(vectors.caption_score(F.col("a"), F.col("b")), 4).alias("clip"))


@query(_PAIRS + ", m AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / len(a) AS e FROM p) SELECT vec_id, round(e, 6) AS l2, round(10 * log10(1 / e), 5) AS psnr FROM m")
def mse_psnr(spark, d):
    scored = registry.scored(_pairs(spark, d), ["l2", "psnr"], {"predict_pixels": "a", "label_pixels": "b"})
    return scored.select("vec_id", F.round("l2", 6).alias("l2"), F.round("psnr", 5).alias("psnr"))


@query(_PAIRS + ", m AS (SELECT list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / len(a) AS e FROM p) SELECT count(*) AS rows, round(avg(e), 6) AS l2, count(*) AS l2_rows, round(10 * log10(1 / avg(e)), 5) AS psnr_of_mean FROM m")
def metric_suite(spark, d):
    scored = registry.scored(_pairs(spark, d), ["l2"], {"predict_pixels": "a", "label_pixels": "b"})
    return registry.summed_up(scored, ["l2"]).withColumn("l2", F.round("l2", 6)).withColumn("psnr_of_mean", F.round("psnr_of_mean", 5))


_POINTS = """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
q AS (SELECT x.vec_id, (x.i + 1) // 2 AS i, x.v AS x, y.v AS y FROM v x JOIN v y ON y.vec_id = x.vec_id AND y.i = x.i + 1 WHERE x.i % 2 = 1)"""


@query(_POINTS + """, b AS (SELECT vec_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS h FROM q GROUP BY 1)
SELECT q.vec_id, CAST(i AS BIGINT) AS i, round((x - cx) / h, 5) AS x, round((y - cy) / h, 5) AS y FROM q JOIN b USING (vec_id)""")
def cloud_normalise(spark, d):
    points = table(spark, d, "embeddings").select("vec_id", F.posexplode(clouds.normalised(clouds.as_points(F.col("embedding")), 32)).alias("i", "p"))
    return points.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"))


@query(_POINTS + """, d AS (SELECT a.vec_id, a.i AS i, b.i AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM q a JOIN q b ON b.vec_id = a.vec_id + 1),
f AS (SELECT vec_id, avg(m) AS m FROM (SELECT vec_id, i, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1), g AS (SELECT vec_id, avg(m) AS m FROM (SELECT vec_id, j, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT f.vec_id, round(f.m + g.m, 5) AS chamfer FROM f JOIN g USING (vec_id)""")
def chamfer_pairs(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(clouds.chamfer(clouds.as_points(F.col("a")), clouds.as_points(F.col("b"))), 5).alias("chamfer"))


@query()
def icp_chamfer(spark, d):
    return _pairs(spark, d).select("vec_id", clouds.aligned_chamfer(clouds.as_points(F.col("a")), clouds.as_points(F.col("b")), scale=True).alias("chamfer"))


@query()
def frechet_distance(spark, d):
    """Of the vectors of every label to those of label 0."""
    m = vectors.moments(table(spark, d, "embeddings"), "embedding", "label")
    base = m.filter("label = 0").select(F.col("mean").alias("mb"), F.col("covariance").alias("cb"))
    return m.join(F.broadcast(base)).select("label", "n", vectors.frechet_column(F.col("mean"), F.col("covariance"), F.col("mb"), F.col("cb")).alias("distance"))


@query()
def ssim(spark, d):
    pair = _pairs(spark, d)
    return pair.select("vec_id", pixels.structural_similarity(F.col("a"), F.col("b"), 8, 8).alias("ssim"), pixels.structural_similarity(F.col("a"), F.col("b"), 8, 8, 3).alias("ms_ssim"))
