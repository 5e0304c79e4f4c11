"""Queries over embeddings: norms, scores, projections, statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from segspark.functions import arrays as A
from segspark.operators import vectors as V
from segspark.operators.embedding import embed_windows
from segspark.sources.models import projection
from segspark.sources.text import vector_line

from . import tables as T
from .segment_queries import registry

QUERIES, ORACLES, query = registry()

D, K, P = 64, 16, 8
#: Synthetic models in closed form, the same in both engines.
TRANSFORM = V.Transform([0.01 * math.sin(d) for d in range(D)], [[math.cos(math.pi * (d + 0.5) * k / D) / 8 for k in range(K)] for d in range(D)], [0.01 * math.cos(k) for k in range(K)])
PLDA = V.Plda([0.01 * math.sin(k) for k in range(K)], [[float(i == j) * (1 + i / 10) + 0.1 * math.cos(i * j) for j in range(K)] for i in range(K)], [1 + (7 * d % 16) / 4 for d in range(K)])
MODEL = PLDA.diagonalised()


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"


def less_sql(v: str, mean) -> str:
    return f"list_transform(range(1, {len(mean) + 1}), lambda i: {v}[i] - {T.doubles(mean)}[i])"


def mat_sql(rows, v: str) -> str:
    return f"list_transform({T.doubles(rows)}, lambda r: list_dot_product(r, {v}))"


LDA_SQL = f"""{T.VECTORS},
z1 AS (SELECT rec, idx, label, {less_sql('v', TRANSFORM.mean1)} AS v FROM em),
z2 AS (SELECT rec, idx, label, {unit_sql('v')} AS v FROM z1),
z3 AS (SELECT rec, idx, label, {mat_sql(TRANSFORM.columns(), 'v')} AS v FROM z2),
z4 AS (SELECT rec, idx, label, {less_sql('v', TRANSFORM.mean2)} AS v FROM z3),
ld AS (SELECT rec, idx, label, {unit_sql('v')} AS v FROM z4)"""
PLDA_SQL = f"""{LDA_SQL},
z5 AS (SELECT rec, idx, label, {less_sql('v', MODEL.mu)} AS v FROM ld),
pr AS (SELECT rec, idx, label, {mat_sql(MODEL.tr[:P], 'v')} AS v FROM z5)"""
LONG = "SELECT idx, (generate_subscripts(v, 1) - 1)::INT AS d, round(unnest(v), 6) AS x FROM "


def long(df, vector):
    return V.elements(df, vector, "idx").withColumn("x", F.round("x", 6))


def transformed(spark, sf_dir):
    rows = T.vectors(spark, sf_dir)
    return rows.select("rec", "idx", "label", V.transform_vectors(F.col("xvec"), TRANSFORM).alias("v"))


def projected(spark, sf_dir):
    rows = transformed(spark, sf_dir)
    return rows.select("rec", "idx", "label", V.plda_project(F.col("v"), MODEL, P).alias("v"))


@query(f"WITH {T.VECTORS}, u AS (SELECT idx, {unit_sql('v')} AS v FROM em) {LONG} u")
def l2_norm(spark, sf_dir):
    return long(T.vectors(spark, sf_dir).withColumn("u", A.l2_norm(F.col("xvec"))), "u")


@query(f"""WITH {T.VECTORS} SELECT a.rec, a.idx AS i, b.idx AS j, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS s FROM em a JOIN em b USING (rec)""")
def cos_similarity(spark, sf_dir):
    return V.cosine_pairs(T.vectors(spark, sf_dir)).withColumn("s", F.round("s", 6))


@query(f"WITH {LDA_SQL} {LONG} ld")
def lda_transform(spark, sf_dir):
    return long(transformed(spark, sf_dir), "v")


@query(f"WITH {PLDA_SQL} {LONG} pr")
def plda_project(spark, sf_dir):
    return long(projected(spark, sf_dir), "v")


@query(f"""WITH {LDA_SQL}, lm AS (SELECT label, d, avg(x) AS m FROM (SELECT label, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM ld) GROUP BY label, d),
ps AS (SELECT d, var_pop(m) AS psi FROM lm GROUP BY d), p AS (SELECT unnest(range(0, {K})) AS i, unnest({T.doubles(PLDA.tr)}) AS tr),
r AS (SELECT row_number() OVER (ORDER BY psi DESC, i) - 1 AS place, psi, tr FROM p JOIN ps ON ps.d = p.i)
SELECT place::INT AS place, round(psi, 9) AS psi, (generate_subscripts(tr, 1) - 1)::INT AS d, round(unnest(tr), 6) AS x FROM r""")
def plda_diag(spark, sf_dir):
    """A model whose across-class variances are those of the labels' means, put in descending order."""
    means = V.elements(transformed(spark, sf_dir), "v", "label").groupBy("label", "d").agg(F.avg("x").alias("m"))
    psi = dict(means.groupBy("d").agg(F.var_pop("m")).collect())  # a number a dimension
    model = V.Plda(PLDA.mu, PLDA.tr, [psi[d] for d in range(K)]).diagonalised()
    rows = [(i, p, [float(x) for x in r]) for i, (p, r) in enumerate(zip(model.psi, model.tr, strict=True))]
    df = spark.createDataFrame(rows, "place int, psi double, tr array<double>")
    return V.elements(df, "tr", "place", "psi").withColumns({"psi": F.round("psi", 9), "x": F.round("x", 6)})


ACROSS = [float(x) for x in MODEL.psi[:P]]


@query(f"""WITH {PLDA_SQL}, e AS (SELECT idx, v, list_sum(list_transform(range(1, {P + 1}), lambda i: v[i] * v[i] / ({T.doubles(ACROSS)}[i] + 1))) AS q FROM pr),
n AS (SELECT idx, list_transform(v, lambda x: x * sqrt({P} / q)) AS v FROM e) {LONG} n""")
def plda_length_norm(spark, sf_dir):
    rows = projected(spark, sf_dir)
    return long(rows.withColumn("n", V.plda_length_norm(F.col("v"), ACROSS)), "n")


_G = [-0.25 * (1 / (1 + 2 * a) + 1 - 2 / (1 + a)) for a in ACROSS]
_L = [-0.5 * (1 / (1 + 2 * a) - 1) for a in ACROSS]
_C = -0.5 * (sum(math.log(1 + 2 * a) for a in ACROSS) - 2 * sum(math.log(1 + a) for a in ACROSS))


@query(f"""WITH {PLDA_SQL}, s AS (SELECT rec, idx, v, list_sum(list_transform(range(1, {P + 1}), lambda i: v[i] * v[i] * {T.doubles(_G)}[i])) AS g FROM pr)
SELECT a.rec, a.idx AS i, b.idx AS j, round(list_sum(list_transform(range(1, {P + 1}), lambda k: a.v[k] * b.v[k] * {T.doubles(_L)}[k])) + a.g + b.g + {_C!r}::DOUBLE, 6) AS llr FROM s a JOIN s b USING (rec)""")
def plda_score(spark, sf_dir):
    return V.plda_pairs(projected(spark, sf_dir), ACROSS).withColumn("llr", F.round("llr", 6))


COV_SQL = f"{T.VECTORS}, lg AS (SELECT rec, idx, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM em)"


@query(f"WITH {COV_SQL} SELECT a.rec, a.d::INT AS i, b.d::INT AS j, round(covar_pop(a.x, b.x), 9) AS c FROM lg a JOIN lg b USING (rec, idx) GROUP BY ALL")
def cov_matrix(spark, sf_dir):
    return V.covariance(T.vectors(spark, sf_dir)).withColumn("c", F.round("c", 9))


@query(f"""WITH {COV_SQL}, e AS (SELECT rec, d, var_pop(x) AS energy FROM lg GROUP BY rec, d),
s AS (SELECT rec, sum(energy) OVER (PARTITION BY rec ORDER BY energy DESC ROWS UNBOUNDED PRECEDING) / sum(energy) OVER (PARTITION BY rec) AS share FROM e)
SELECT rec, least(count(*) FILTER (share <= 0.5::DOUBLE) + 2, count(*))::INT AS pca_dim FROM s GROUP BY rec""")
def pca_dim(spark, sf_dir):
    e = V.elements(T.vectors(spark, sf_dir), "xvec", "rec").groupBy("rec", "d").agg(F.var_pop("x").alias("energy"))
    return V.pca_dimension(e, 0.5)


@query("SELECT vec_id FROM embeddings WHERE label <> 3 OR label IS NULL")
def nan_filter(spark, sf_dir):
    """Vectors of one label get a NaN first, so that there is something to drop."""
    rows = T.vectors(spark, sf_dir)
    spoiled = F.transform("xvec", lambda x, i: F.when((i == 0) & (F.col("label") == 3), F.lit(float("nan"))).otherwise(x))
    return V.without_nan(rows.withColumn("xvec", spoiled)).select(F.col("idx").alias("vec_id"))


@query(f"WITH {T.VECTORS} SELECT idx, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS lse FROM em")
def logsumexp(spark, sf_dir):
    return T.vectors(spark, sf_dir).select("idx", F.round(A.logsumexp(F.col("xvec")), 6).alias("lse"))


@query(f"WITH {T.VECTORS} SELECT idx, (list_position(v, list_max(v)) - 1)::INT AS label FROM em")
def top1_label(spark, sf_dir):
    return T.vectors(spark, sf_dir).select("idx", A.argmax(F.col("xvec")).alias("label"))


@query(f"""WITH {T.VECTORS}, l AS (SELECT idx, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM em)
SELECT idx, d::INT AS label FROM l QUALIFY row_number() OVER (PARTITION BY idx ORDER BY x DESC, d) = 2""")
def top2_label(spark, sf_dir):
    return T.vectors(spark, sf_dir).select("idx", A.nth_best(F.col("xvec"), 2).alias("label"))


@query(f"WITH {COV_SQL} SELECT rec, d::INT AS d, round(avg(x), 6) AS mean, round(sqrt(avg(x * x) - avg(x) * avg(x) + 1e-10::DOUBLE), 6) AS std FROM lg GROUP BY rec, d")
def stats_pooling(spark, sf_dir):
    got = V.mean_std_pool(T.vectors(spark, sf_dir), vector="xvec")
    return got.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_B = [[float(x) for x in r] for r in projection(2 * D, 16).T]


@query(f"""WITH {COV_SQL}, p AS (SELECT rec, d, avg(x) AS m, sqrt(avg(x * x) - avg(x) * avg(x) + 1e-10::DOUBLE) AS s FROM lg GROUP BY rec, d),
v AS (SELECT rec, list_concat(list(m ORDER BY d), list(s ORDER BY d)) AS v FROM p GROUP BY rec), e AS (SELECT rec, {mat_sql(_B, 'v')} AS v FROM v)
SELECT rec, (generate_subscripts(v, 1) - 1)::INT AS d, round(unnest(v), 6) AS x FROM e""")
def embed_stub(spark, sf_dir):
    """The stand-in model over each recording's vectors as frames: one window a recording."""
    rows = T.vectors(spark, sf_dir)
    feats = rows.select("rec", F.expr("cast(pmod(idx, 50) as bigint)").alias("frame"), F.col("xvec").alias("feat"))
    spans = feats.groupBy("rec").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("last")).withColumn("key", F.col("rec").cast("string"))
    got = embed_windows(feats, spans, unit=("rec",))
    return V.elements(got, "xvec", "rec").withColumn("x", F.round("x", 6))


@query(f"WITH {T.VECTORS} SELECT 'v' || idx || '  [ ' || array_to_string(list_transform(v, lambda x: trunc(x * 1000)::BIGINT::VARCHAR), ' ') || ' ]' AS line FROM em")
def vec_text(spark, sf_dir):
    """Text lines of the vectors in thousandths, which both engines spell alike."""
    whole = F.transform("xvec", lambda x: (x * 1000).cast("bigint"))
    return T.vectors(spark, sf_dir).select(vector_line(F.concat(F.lit("v"), "idx"), whole).alias("line"))
