"""Queries over the embeddings table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, clusters
from ..operators import vectors as op
from ..scratch import own_folder
from .registry import query
from .tables import table

EVERY = 100  # queries are the rows whose id is divisible by this
V_SQL = """
v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
st AS (SELECT d, avg(x) AS mean, greatest(stddev_pop(x), 1e-6) AS std FROM v GROUP BY d),
u AS (SELECT vec_id, sum(CASE WHEN x > mean THEN (1::HUGEINT << d::HUGEINT) ELSE 0::HUGEINT END)::HUGEINT AS b FROM v JOIN st USING (d) GROUP BY vec_id),
fps AS (SELECT vec_id, (CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END)::BIGINT AS fp FROM u)
"""
WITH = "WITH " + V_SQL


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def prints(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return op.fingerprints(rows, op.dimension_stats(rows))


def asked(rows, *columns):
    return rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), *columns)


@query("corpus_mean", WITH + "SELECT d::INTEGER AS d, round(mean, 6) AS mean FROM st")
def corpus_mean(spark, sf_dir):
    return op.dimension_stats(vectors(spark, sf_dir)).select("d", F.round("mean", 6).alias("mean"))


@query("corpus_std", WITH + "SELECT d::INTEGER AS d, round(std, 6) AS std FROM st")
def corpus_std(spark, sf_dir):
    return op.dimension_stats(vectors(spark, sf_dir)).select("d", F.round("std", 6).alias("std"))


@query("quantize_sign", WITH + "SELECT vec_id, fp FROM fps")
def quantize_sign(spark, sf_dir):
    return prints(spark, sf_dir).select("vec_id", "fp")


@query(
    "hamming_knn",
    WITH + f"""SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.fp, c.fp))::INTEGER AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.fp, c.fp)), c.vec_id)::INTEGER AS rank
    FROM fps q JOIN fps c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 10""",
)
def hamming_knn(spark, sf_dir):
    rows = prints(spark, sf_dir)
    return op.nearest(rows.select("vec_id", "fp"), asked(rows, F.col("fp").alias("q")), V.hamming(F.col("fp"), F.col("q")), 10, descending=False)


@query(
    "hamming_multi_index",
    WITH + f"""SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.fp, c.fp))::INTEGER AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.fp, c.fp)), c.vec_id)::INTEGER AS rank
    FROM fps q JOIN fps c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 10""",
)
def hamming_multi_index(spark, sf_dir):
    """:func:`hamming_knn` by lookups at growing distance."""
    rows = prints(spark, sf_dir).select("vec_id", "fp")
    return clusters.hamming_nearest(rows, asked(rows, F.col("fp").alias("q")), 10).drop("probed")


@query(
    "pure_semantic",
    WITH + f"""SELECT q.vec_id AS query_id, c.vec_id, (1 - bit_count(xor(q.fp, c.fp)) / 64.0)::DOUBLE AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.fp, c.fp)), c.vec_id)::INTEGER AS rank
    FROM fps q JOIN fps c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 50""",
)
def pure_semantic(spark, sf_dir):
    rows = prints(spark, sf_dir)
    signs = rows.select("vec_id", V.signs(F.col("fp")).alias("x"))
    return blocks.nearest(signs, asked(signs, F.col("x").alias("q")), blocks.shared_signs, 50)


PAIR_SQL = f"""
qd AS (SELECT vec_id AS query_id, d, x FROM v WHERE vec_id % {EVERY} = 0),
dots AS (SELECT q.query_id, v.vec_id, sum(q.x * v.x) AS dot, sqrt(sum(q.x * q.x)) AS nq, sqrt(sum(v.x * v.x)) AS nv FROM qd q JOIN v ON q.d = v.d WHERE q.query_id <> v.vec_id GROUP BY 1, 2)
"""


@query(
    "cosine_knn",
    WITH + "," + PAIR_SQL + """SELECT query_id, vec_id, round(dot / (nq * nv), 6) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (nq * nv), 6) DESC, vec_id)::INTEGER AS rank FROM dots QUALIFY rank <= 10""",
)
def cosine_knn(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("x"))
    return blocks.nearest(rows, asked(rows, F.col("x").alias("q")), blocks.cosines, 10)


@query(
    "asym_knn",
    WITH + f""", qc AS (SELECT vec_id AS query_id, d, x - mean AS x FROM v JOIN st USING (d) WHERE vec_id % {EVERY} = 0),
    bits AS (SELECT vec_id, d, x > mean AS bit FROM v JOIN st USING (d)),
    s AS (SELECT query_id, vec_id, round((sum(CASE WHEN bit THEN q.x ELSE -q.x END) / (sqrt(64) * sqrt(sum(q.x * q.x))) + 1) / 2, 6) AS score FROM qc q JOIN bits USING (d) WHERE query_id <> vec_id GROUP BY 1, 2)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
)
def asym_knn(spark, sf_dir):
    rows = prints(spark, sf_dir)
    centred = F.zip_with(V.doubles(F.col("embedding")), "mean", lambda x, m: x - m)
    return blocks.nearest(rows.select("vec_id", V.signs(F.col("fp")).alias("x")), asked(rows, centred.alias("q")), blocks.sign_scores, 10)


@query("truncate_l2", WITH + ", t AS (SELECT * FROM v WHERE d < 16), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM t GROUP BY 1) SELECT vec_id, d::INTEGER AS d, round(x / n, 6) AS x FROM t JOIN n USING (vec_id)")
def truncate_l2(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", V.truncated(V.doubles(F.col("embedding")), 16).alias("x"))
    return rows.select("vec_id", F.posexplode("x").alias("d", "x")).withColumn("x", F.round("x", 6))


@query(
    "mad_scale",
    WITH + """, f AS (SELECT d, abs(x - mean) AS far, row_number() OVER (PARTITION BY d ORDER BY abs(x - mean)) AS k, count(*) OVER (PARTITION BY d) AS n FROM v JOIN st USING (d))
    SELECT d::INTEGER AS d, round(least(greatest(2 * far, 0.05), 0.5), 6)::DOUBLE AS scale FROM f WHERE k = n // 2 + 1""",
)
def mad_scale(spark, sf_dir):
    return op.mad_scale(vectors(spark, sf_dir)).select("d", F.round("scale", 6).alias("scale"))


@query(
    "mean_pool",
    WITH + """, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), m AS (SELECT label, d, avg(x / n) AS x FROM v JOIN n USING (vec_id) GROUP BY 1, 2),
    k AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, d::INTEGER AS d, round(x / n, 6) AS x FROM m JOIN k USING (label)""",
)
def mean_pool(spark, sf_dir):
    return op.mean_pool(vectors(spark, sf_dir), "label").select("label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.round("x", 6))


@query(
    "maxsim",
    WITH + f""", s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, sum(q.x * v.x) AS dot FROM v q JOIN v ON q.d = v.d WHERE q.vec_id % {EVERY} = 0 GROUP BY 1, 2, 3)
    SELECT query_id, label, round(max(dot), 6) AS score FROM s GROUP BY 1, 2""",
)
def maxsim(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return op.max_similarity(rows, asked(rows, V.doubles(F.col("embedding")).alias("q")), "label").withColumn("score", F.round("score", 6))


@query(
    "holo16",
    WITH + """, f AS (SELECT d, abs(x - mean) AS far, row_number() OVER (PARTITION BY d ORDER BY abs(x - mean)) AS k, count(*) OVER (PARTITION BY d) AS n FROM v JOIN st USING (d)),
    sc AS (SELECT d, least(greatest(2 * far, 0.05), 0.5)::DOUBLE AS scale FROM f WHERE k = n // 2 + 1)
    SELECT vec_id, sum((x > mean + (i / 15.0::DOUBLE - 0.5) * scale)::INTEGER)::INTEGER AS bits FROM v JOIN st USING (d) JOIN sc USING (d) CROSS JOIN range(16) AS r(i) GROUP BY vec_id""",
)
def holo16(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    stats = op.dimension_stats(rows).select("d", "mean").join(F.broadcast(op.mad_scale(rows)), "d").withColumnRenamed("scale", "std")
    one = F.broadcast(op.whitening(stats))
    found = rows.crossJoin(one).select("vec_id", V.views(V.doubles(F.col("embedding")), F.col("mean"), F.col("std")).alias("views"))
    return found.select("vec_id", F.aggregate("views", F.lit(0), lambda a, v: a + F.bit_count(v)).alias("bits"))


@query(
    "s_slow",
    WITH + """, w AS (SELECT vec_id, d, x, pow(0.999::DOUBLE, (SELECT max(vec_id) FROM embeddings) - vec_id) AS w FROM v)
    SELECT a.d::INTEGER AS i, b.d::INTEGER AS j, round(sum(a.w * a.x * b.x), 6) AS value FROM w a JOIN w b ON a.vec_id = b.vec_id GROUP BY 1, 2""",
)
def s_slow(spark, sf_dir):
    return clusters.associations(vectors(spark, sf_dir), "vec_id").withColumn("value", F.round("value", 6))


@query(
    "dream_drift",
    WITH + """, q AS (SELECT d, avg(x) AS q FROM v WHERE vec_id % 10 = 0 GROUP BY d)
    SELECT d::INTEGER AS d, round(mean + 0.05::DOUBLE * (q - mean), 6) AS mean, round(std + 0.05::DOUBLE * (greatest(std, 0.5::DOUBLE * abs(q - mean)) - std), 6) AS std FROM st JOIN q USING (d)""",
)
def dream_drift(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return op.drift(op.dimension_stats(rows), rows.filter("vec_id % 10 = 0")).select("d", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    found, _ = clusters.kmeans(vectors(spark, sf_dir))
    return found


@query("cluster_health", WITH + "SELECT label AS cluster, count(*) AS n, round(avg(s), 6) AS strength FROM (SELECT vec_id, label, sqrt(sum(x * x)) AS s FROM v GROUP BY 1, 2) GROUP BY label")
def cluster_health(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").alias("cluster"), V.norm(V.doubles(F.col("embedding"))).alias("s"))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("strength"))


#: Cells of :func:`ivf_search` and how many of them a query reads.
CELLS, PROBE = 128, 80


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Cells stored by folder, the nearest of them read."""
    rows = vectors(spark, sf_dir)
    _, centres = clusters.kmeans(rows, CELLS, 4)
    path = f"{own_folder(spark)}/cells-{uuid.uuid4().hex}"
    clusters.store_cells(rows, centres, path)
    stored = spark.read.parquet(path)
    return clusters.cell_search(stored, centres, asked(rows, V.doubles(F.col("embedding")).alias("q")), PROBE, 10).withColumn("score", F.round("score", 6))


@query(
    "semantic_delta",
    WITH + """, l AS (SELECT vec_id, fp, lag(fp) OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS before FROM fps)
    SELECT vec_id, CASE WHEN before IS NOT NULL THEN bit_count(xor(fp, before)) / 64.0::DOUBLE END AS delta FROM l""",
)
def semantic_delta(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("fp").over(Window.partitionBy(F.col("vec_id") % 50).orderBy("vec_id"))
    return prints(spark, sf_dir).select("vec_id", (V.hamming(F.col("fp"), before) / 64.0).alias("delta"))
