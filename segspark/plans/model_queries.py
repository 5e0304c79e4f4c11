"""Queries over model fits: calibration, clustering, hidden Markov models, frame errors."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from segspark.operators import models as M
from segspark.operators import vectors as V

from . import tables as T
from .segment_queries import registry
from .vector_queries import ACROSS, LDA_SQL, MODEL, PLDA_SQL, K, P, less_sql, mat_sql, projected, transformed

QUERIES, ORACLES, query = registry()

COS_SQL = f"""{T.VECTORS}, cs AS (SELECT a.rec, a.idx AS i, b.idx AS j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM em a JOIN em b USING (rec))"""
EM_SQL = f"""{COS_SQL},
fit AS (SELECT 0 AS it, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, avg(s) - stddev_pop(s) AS m0, avg(s) + stddev_pop(s) AS m1, var_pop(s) AS v FROM cs
  UNION ALL
  SELECT it + 1, n0 / (n0 + n1), n1 / (n0 + n1), s0 / n0, s1 / n1, (n0 * (q0 / n0 - pow(s0 / n0, 2)) + n1 * (q1 / n1 - pow(s1 / n1, 2))) / (n0 + n1)
  FROM (SELECT it, sum(1 - r) AS n0, sum(r) AS n1, sum((1 - r) * s) AS s0, sum(r * s) AS s1, sum((1 - r) * s * s) AS q0, sum(r * s * s) AS q1
    FROM (SELECT it, s, 1 / (1 + exp(-(ln(w1) - ln(w0) - 0.5::DOUBLE * (pow(s - m1, 2) - pow(s - m0, 2)) / v))) AS r FROM fit, cs WHERE it < 20) GROUP BY it))"""


@query(f"""WITH RECURSIVE {EM_SQL}
SELECT round(-0.5::DOUBLE * ((ln(w0 * w0 / v) - m0 * m0 / v) - (ln(w1 * w1 / v) - m1 * m1 / v)) / (m0 / v - m1 / v), 6) AS threshold,
  round(w0, 6) AS w0, round(w1, 6) AS w1, round(m0, 6) AS m0, round(m1, 6) AS m1, round(v, 6) AS var FROM fit WHERE it = 20""")
def gmm_calibration(spark, sf_dir):
    fit = M.calibrate(V.cosine_pairs(T.vectors(spark, sf_dir)))
    return spark.range(1).select(*(F.lit(round(fit[k], 6)).alias(k) for k in ("threshold", "w0", "w1", "m0", "m1", "var")))


@query(f"""WITH RECURSIVE {EM_SQL}
SELECT rec, i, j, round(ln(w1) - 0.5::DOUBLE * pow(s - m1, 2) / v - ln(w0) + 0.5::DOUBLE * pow(s - m0, 2) / v, 5) AS llr FROM cs, fit WHERE it = 19""")
def gmm_llr(spark, sf_dir):
    pairs = V.cosine_pairs(T.vectors(spark, sf_dir))
    fit = M.calibrate(pairs)
    return pairs.select("rec", "i", "j", F.round(M.calibrated_ratio(F.col("s"), fit), 5).alias("llr"))


@query(f"""WITH RECURSIVE {COS_SQL},
fit AS (SELECT 0 AS it, rec, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, avg(s) - stddev_pop(s) AS m0, avg(s) + stddev_pop(s) AS m1, var_pop(s) AS v FROM cs GROUP BY rec
  UNION ALL
  SELECT it + 1, rec, n0 / (n0 + n1), n1 / (n0 + n1), s0 / n0, s1 / n1, (n0 * (q0 / n0 - pow(s0 / n0, 2)) + n1 * (q1 / n1 - pow(s1 / n1, 2))) / (n0 + n1)
  FROM (SELECT it, rec, sum(1 - r) AS n0, sum(r) AS n1, sum((1 - r) * s) AS s0, sum(r * s) AS s1, sum((1 - r) * s * s) AS q0, sum(r * s * s) AS q1
    FROM (SELECT it, rec, s, 1 / (1 + exp(-(ln(w1) - ln(w0) - 0.5::DOUBLE * (pow(s - m1, 2) - pow(s - m0, 2)) / v))) AS r FROM fit JOIN cs USING (rec) WHERE it < 20) GROUP BY it, rec))
SELECT rec, round(-0.5::DOUBLE * ((ln(w0 * w0 / v) - m0 * m0 / v) - (ln(w1 * w1 / v) - m1 * m1 / v)) / (m0 / v - m1 / v), 6) AS threshold FROM fit WHERE it = 20""")
def gmm_thresholds(spark, sf_dir):
    """The calibration of every recording by itself."""
    return M.thresholds(T.vectors(spark, sf_dir)).select("rec", F.round("threshold", 6).alias("threshold"))


@query(f"""WITH RECURSIVE {COS_SQL}, mg AS (SELECT 0 AS it, rec, idx, idx AS cl FROM em
  UNION ALL
  SELECT m.it + 1, m.rec, m.idx, CASE WHEN m.cl = p.cj THEN p.ci ELSE m.cl END FROM mg m JOIN (
    SELECT it, rec, arg_max(ci, (s, -ci, -cj)) AS ci, arg_max(cj, (s, -ci, -cj)) AS cj FROM (
      SELECT a.it, a.rec, a.cl AS ci, b.cl AS cj, avg(cs.s) AS s FROM mg a JOIN cs ON cs.rec = a.rec AND cs.i = a.idx JOIN mg b ON b.rec = a.rec AND b.it = a.it AND b.idx = cs.j AND a.cl < b.cl
      GROUP BY a.it, a.rec, a.cl, b.cl) GROUP BY it, rec HAVING max(s) >= 0.05::DOUBLE) p ON p.rec = m.rec AND p.it = m.it)
SELECT rec, idx, arg_max(cl, it) - min(idx) OVER (PARTITION BY rec) AS label FROM mg GROUP BY rec, idx""")
def ahc_labels(spark, sf_dir):
    return M.cluster(T.vectors(spark, sf_dir), 0.05)


STATES, SMOOTH = 4, 5.0
HIGH, LOW = math.exp(SMOOTH) / (math.exp(SMOOTH) + STATES - 1), 1 / (math.exp(SMOOTH) + STATES - 1)
SOFT_SQL = f"list_transform(range(0, {STATES}), lambda k: CASE WHEN k = idx % {STATES} THEN {HIGH!r}::DOUBLE ELSE {LOW!r}::DOUBLE END)"


def _soft(df):
    return df.withColumn("gamma", M.soft_labels(F.pmod("idx", F.lit(STATES)), STATES, SMOOTH))


@query(f"WITH {T.VECTORS}, g AS (SELECT idx, {SOFT_SQL} AS g FROM em) SELECT idx, (generate_subscripts(g, 1) - 1)::INT AS k, round(unnest(g), 6) AS g FROM g")
def soft_init(spark, sf_dir):
    return _soft(T.vectors(spark, sf_dir)).select("idx", F.posexplode("gamma").alias("k", "g")).withColumn("g", F.round("g", 6))


FA, FB, LOOP = 0.4, 17.0, 0.9
PHI = T.doubles(ACROSS)


@query(f"""WITH {PLDA_SQL}, r AS (SELECT rec, idx, generate_subscripts(v, 1) - 1 AS d, unnest(list_transform(range(1, {P + 1}), lambda i: v[i] * sqrt({PHI}[i]))) AS rho FROM pr),
k AS (SELECT unnest(range(0, {STATES})) AS k), g AS (SELECT *, CASE WHEN k = idx % {STATES} THEN {HIGH!r}::DOUBLE ELSE {LOW!r}::DOUBLE END AS g FROM r, k),
s AS (SELECT rec, k, d, sum(g) AS n, sum(g * rho) AS f FROM g GROUP BY rec, k, d)
SELECT rec, k::INT AS k, d::INT AS d, round({FA / FB!r}::DOUBLE / (1 + {FA / FB!r}::DOUBLE * n * {PHI}[d + 1]) * f, 6) AS alpha, round(1 / (1 + {FA / FB!r}::DOUBLE * n * {PHI}[d + 1]), 6) AS inv FROM s""")
def vb_mstep(spark, sf_dir):
    """The speaker-model step as aggregations over frames, states and dimensions."""
    rows = _soft(projected(spark, sf_dir))
    phi = F.array(*(F.lit(a) for a in ACROSS))
    long = rows.select("rec", "gamma", F.posexplode("v").alias("d", "x")).select("rec", "d", "x", F.posexplode("gamma").alias("k", "g"))
    across = F.element_at(phi, F.col("d") + 1)
    sums = long.groupBy("rec", "k", "d").agg(F.sum("g").alias("n"), F.sum(F.col("g") * F.col("x") * F.sqrt(across)).alias("f"))
    inv = 1 / (1 + F.lit(FA / FB) * F.col("n") * across)
    return sums.select("rec", "k", "d", F.round(F.lit(FA / FB) * inv * F.col("f"), 6).alias("alpha"), F.round(inv, 6).alias("inv"))


def lse_sql(items: str) -> str:
    """Log of the sum of exponentials of a list expression."""
    return f"list_transform([{items}], lambda q: list_max(q) + ln(list_sum(list_transform(q, lambda x: exp(x - list_max(q))))))[1]"


def vb_sql(rounds: int) -> str:
    """CTEs of ``rounds`` unrolled iterations over ``pr (rec, idx, v)``; responsibilities are ``g<rounds> (rec, t, g)``."""
    s = STATES
    out = [f"x AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS t, idx, v, list_transform(range(1, {P + 1}), lambda i: v[i] * sqrt({PHI}[i])) AS rho, -0.5::DOUBLE * (list_dot_product(v, v) + {P} * ln(2 * pi())) AS c FROM pr)",
           "len AS (SELECT rec, max(t) AS top FROM x GROUP BY rec)",
           f"g0 AS (SELECT rec, t, {SOFT_SQL} AS g FROM x)", f"p0 AS (SELECT rec, {T.doubles([1 / s] * s)} AS pi FROM len)"]
    for n in range(1, rounds + 1):
        g, p = f"g{n - 1}", f"p{n - 1}"
        out += [
            f"n{n} AS (SELECT rec, k, sum({g}.g[k + 1]) AS n FROM {g}, (SELECT unnest(range(0, {s})) AS k) GROUP BY rec, k)",
            f"s{n} AS (SELECT rec, k, d, sum({g}.g[k + 1] * x.rho[d + 1]) AS f FROM {g} JOIN x USING (rec, t), (SELECT unnest(range(0, {s})) AS k), (SELECT unnest(range(0, {P})) AS d) GROUP BY rec, k, d)",
            f"m{n} AS (SELECT rec, k, list(1 / (1 + {FA / FB!r}::DOUBLE * n * {PHI}[d + 1]) ORDER BY d) AS il, list({FA / FB!r}::DOUBLE / (1 + {FA / FB!r}::DOUBLE * n * {PHI}[d + 1]) * f ORDER BY d) AS al FROM s{n} JOIN n{n} USING (rec, k) GROUP BY rec, k)",
            f"l{n} AS (SELECT x.rec, x.t, list({FA!r}::DOUBLE * (list_dot_product(x.rho, m.al) - 0.5::DOUBLE * list_sum(list_transform(range(1, {P + 1}), lambda i: (m.il[i] + m.al[i] * m.al[i]) * {PHI}[i])) + x.c) ORDER BY m.k) AS ll FROM x JOIN m{n} m USING (rec) GROUP BY x.rec, x.t)",
            f"tr{n} AS (SELECT rec, pi, list_transform(range(1, {s + 1}), lambda i: list_transform(range(1, {s + 1}), lambda j: ln((CASE WHEN i = j THEN {LOOP!r}::DOUBLE ELSE 0 END) + {1 - LOOP!r}::DOUBLE * pi[j] + 1e-8::DOUBLE))) AS lt FROM {p})",
            f"f{n} AS (SELECT l.rec, l.t, list_transform(range(1, {s + 1}), lambda j: l.ll[j] + ln(tr.pi[j] + 1e-8::DOUBLE)) AS f FROM l{n} l JOIN tr{n} tr USING (rec) WHERE l.t = 0 UNION ALL SELECT l.rec, l.t, list_transform(range(1, {s + 1}), lambda j: l.ll[j] + {lse_sql(f'list_transform(range(1, {s + 1}), lambda i: a.f[i] + tr.lt[i][j])')}) FROM f{n} a JOIN l{n} l ON l.rec = a.rec AND l.t = a.t + 1 JOIN tr{n} tr ON tr.rec = a.rec)",
            f"w{n} AS (SELECT rec, top AS t, {T.doubles([0.0] * s)} AS b FROM len UNION ALL SELECT l.rec, l.t - 1, list_transform(range(1, {s + 1}), lambda i: {lse_sql(f'list_transform(range(1, {s + 1}), lambda j: tr.lt[i][j] + l.ll[j] + a.b[j])')}) FROM w{n} a JOIN l{n} l ON l.rec = a.rec AND l.t = a.t JOIN tr{n} tr ON tr.rec = a.rec WHERE a.t > 0)",
            f"t{n} AS (SELECT rec, {lse_sql('f')} AS tll FROM f{n} JOIN len USING (rec) WHERE t = top)",
            f"g{n} AS (SELECT rec, t, list_transform(range(1, {s + 1}), lambda k: exp(f.f[k] + w.b[k] - tll)) AS g FROM f{n} f JOIN w{n} w USING (rec, t) JOIN t{n} USING (rec))",
            f"e{n} AS (SELECT rec, tll + {FB / 2!r}::DOUBLE * sum(list_sum(list_transform(range(1, {P + 1}), lambda i: ln(il[i]) - il[i] - al[i] * al[i] + 1))) AS elbo FROM m{n} JOIN t{n} USING (rec) GROUP BY rec, tll)",
            f"u{n} AS (SELECT l.rec, k, sum(exp({lse_sql('a.f')} + l.ll[k + 1] + w.b[k + 1] - tll)) AS u FROM f{n} a JOIN l{n} l ON l.rec = a.rec AND l.t = a.t + 1 JOIN w{n} w ON w.rec = l.rec AND w.t = l.t JOIN t{n} t ON t.rec = l.rec, (SELECT unnest(range(0, {s})) AS k) GROUP BY l.rec, k)",
            f"q{n} AS (SELECT rec, k, g.g[k + 1] + {1 - LOOP!r}::DOUBLE * p.pi[k + 1] * u AS q FROM u{n} JOIN g{n} g USING (rec) JOIN {p} p USING (rec) WHERE g.t = 0)",
            f"p{n} AS (SELECT rec, list(q / z ORDER BY k) AS pi FROM (SELECT *, sum(q) OVER (PARTITION BY rec) AS z FROM q{n}) GROUP BY rec)",
        ]
    return ",\n".join(out)


def _vb(spark, sf_dir, rounds, epsilon):
    rows = projected(spark, sf_dir).withColumn("label", F.pmod("idx", F.lit(STATES)))
    return M.vb_cluster(rows, ACROSS, LOOP, FA, FB, rounds, epsilon, SMOOTH)


@query(f"""WITH RECURSIVE {PLDA_SQL}, {vb_sql(2)}
SELECT rec, idx, (generate_subscripts(g, 1) - 1)::INT AS k, round(unnest(g), 5) AS g, round(elbo, 4) AS objective FROM g2 JOIN x USING (rec, t) JOIN e2 USING (rec)""")
def vb_hmm_k(spark, sf_dir):
    got = _vb(spark, sf_dir, 2, -math.inf)
    return got.select("rec", "idx", F.posexplode("gamma").alias("k", "g"), F.round("objective", 4).alias("objective")).withColumn("g", F.round("g", 5))


ROUNDS, EPSILON = 4, 0.5


def stopped_sql(rounds: int, epsilon: float) -> str:
    """CTE ``st (rec, n, elbo)``: the round in which each recording stops, and all rounds' responsibilities ``ga``."""
    bounds = " UNION ALL ".join(f"SELECT rec, {n} AS n, elbo FROM e{n}" for n in range(1, rounds + 1))
    gammas = " UNION ALL ".join(f"SELECT rec, t, {n} AS n, g FROM g{n}" for n in range(1, rounds + 1))
    return f"""ea AS ({bounds}), ga AS ({gammas}),
sg AS (SELECT rec, n, elbo, n = {rounds} OR elbo - lag(elbo) OVER (PARTITION BY rec ORDER BY n) < {epsilon}::DOUBLE AS stops FROM ea),
st AS (SELECT rec, min(n) AS n, arg_min(elbo, n) AS elbo FROM sg WHERE stops GROUP BY rec)"""


@query(f"""WITH RECURSIVE {PLDA_SQL}, {vb_sql(ROUNDS)}, {stopped_sql(ROUNDS, EPSILON)},
o AS (SELECT rec, idx, n, elbo, list_sort(list_transform(range(1, {STATES + 1}), lambda k: (-ga.g[k], k))) AS o FROM ga JOIN st USING (rec, n) JOIN x USING (rec, t))
SELECT rec, idx, o[1][2] - 1 AS label, o[2][2] - 1 AS second, n::BIGINT AS rounds, round(elbo, 4) AS objective FROM o""")
def vb_hmm(spark, sf_dir):
    """Labels when the objective stops rising; the threshold is coarse, so that recordings stop in different rounds."""
    got = _vb(spark, sf_dir, ROUNDS, EPSILON)
    return got.select("rec", "idx", "label", "second", "rounds", F.round("objective", 4).alias("objective"))


_PSI = [float(p) for p in MODEL.psi]
_DG = [-0.25 * (1 / (1 + 2 * a) + 1 - 2 / (1 + a)) for a in _PSI]
_DL = [-0.5 * (1 / (1 + 2 * a) - 1) for a in _PSI]
_DC = -0.5 * sum(math.log(1 + 2 * a) - 2 * math.log(1 + a) for a in _PSI)


@query(f"""WITH {LDA_SQL}, z5 AS (SELECT rec, idx, {less_sql('v', MODEL.mu)} AS v FROM ld), pr AS (SELECT rec, idx, {mat_sql(MODEL.tr, 'v')} AS v FROM z5),
e AS (SELECT rec, idx, v, list_sum(list_transform(range(1, {K + 1}), lambda i: v[i] * v[i] / ({T.doubles(_PSI)}[i] + 1))) AS q FROM pr),
n AS (SELECT rec, idx, list_transform(v, lambda x: x * sqrt({K} / q)) AS v FROM e),
s AS (SELECT rec, idx, v, list_sum(list_transform(range(1, {K + 1}), lambda i: v[i] * v[i] * {T.doubles(_DG)}[i])) AS g FROM n)
SELECT a.rec, a.idx AS i, b.idx AS j, round(list_sum(list_transform(range(1, {K + 1}), lambda k: a.v[k] * b.v[k] * {T.doubles(_DL)}[k])) + a.g + b.g + {_DC!r}::DOUBLE, 4) AS llr FROM s a JOIN s b USING (rec)""")
def plda_dense(spark, sf_dir):
    """Target energy 1, the published default: all components stay, and the scores are those of the model itself."""
    got = M.plda_dense_pairs(transformed(spark, sf_dir).withColumnRenamed("v", "xvec"), MODEL, 1.0)
    return got.withColumn("llr", F.round("llr", 4))


@query()
def plda_dense_reduced(spark, sf_dir):
    """Half of each recording's energy: a real reduction, of its own size and axes per recording.  SQL has no eigenvectors."""
    got = M.plda_dense_pairs(transformed(spark, sf_dir).withColumnRenamed("v", "xvec"), MODEL, 0.5)
    return got.withColumn("llr", F.round("llr", 4))


@query(f"""WITH RECURSIVE {T.VECTORS}, g AS (SELECT rec, label AS ref, k, -(CASE WHEN k = idx % {STATES} THEN {HIGH!r}::DOUBLE ELSE {LOW!r}::DOUBLE END) AS c FROM em, (SELECT unnest(range(0, {STATES})) AS k)),
c AS (SELECT rec, ref, k, sum(c) AS c FROM g GROUP BY rec, ref, k), n AS (SELECT rec, count(*) AS n FROM em GROUP BY rec),
o AS (SELECT rec, k, ref, c FROM c UNION ALL SELECT DISTINCT rec, k, -1, 0 FROM c),
b AS (SELECT rec, 0 AS k, []::INT[] AS used, 0::DOUBLE AS cost FROM n
  UNION ALL SELECT b.rec, b.k + 1, CASE WHEN o.ref < 0 THEN used ELSE list_append(used, o.ref) END, cost + o.c FROM b JOIN o ON o.rec = b.rec AND o.k = b.k AND NOT list_contains(used, o.ref))
SELECT rec, round((n + min(cost)) / n, 6) AS error FROM b JOIN n USING (rec) WHERE k = {STATES} GROUP BY rec, n""")
def der_frames(spark, sf_dir):
    rows = _soft(T.vectors(spark, sf_dir)).withColumnRenamed("label", "ref")
    return M.frame_errors(rows).withColumn("error", F.round("error", 6))


N, HLOOP = 3, 0.9
TR = [[HLOOP * (i == j) + (1 - HLOOP) / N for j in range(N)] for i in range(N)]
LTR, LIP = T.doubles([[math.log(x + 1e-8) for x in r] for r in TR]), math.log(1 / N + 1e-8)
HMM_SQL = f"""{T.SEGMENTS},
h AS (SELECT rec, idx, row_number() OVER (PARTITION BY rec ORDER BY st, idx) - 1 AS t, [{', '.join(f'-0.5::DOUBLE * pow(value / 50.0::DOUBLE - {k}, 2)' for k in range(N))}] AS ll FROM ev),
hl AS (SELECT rec, max(t) AS top FROM h GROUP BY rec),
fw AS (SELECT rec, t, list_transform(ll, lambda x: x + {LIP!r}::DOUBLE) AS f FROM h WHERE t = 0
  UNION ALL SELECT h.rec, h.t, list_transform(range(1, {N + 1}), lambda j: h.ll[j] + {lse_sql(f'list_transform(range(1, {N + 1}), lambda i: fw.f[i] + {LTR}[i][j])')}) FROM fw JOIN h ON h.rec = fw.rec AND h.t = fw.t + 1),
bw AS (SELECT rec, top AS t, {T.doubles([0.0] * N)} AS b FROM hl
  UNION ALL SELECT h.rec, h.t - 1, list_transform(range(1, {N + 1}), lambda i: {lse_sql(f'list_transform(range(1, {N + 1}), lambda j: {LTR}[i][j] + h.ll[j] + bw.b[j])')}) FROM bw JOIN h ON h.rec = bw.rec AND h.t = bw.t WHERE bw.t > 0),
tl AS (SELECT rec, {lse_sql('f')} AS total FROM fw JOIN hl USING (rec) WHERE t = top)"""


def _hmm(spark, sf_dir, column):
    rows = T.segments(spark, sf_dir)
    ll = F.array(*(-0.5 * (F.col("value") / 50.0 - k) ** 2 for k in range(N)))
    at = F.row_number().over(Window.partitionBy("rec").orderBy("start", "idx")) - 1
    got = M.hmm(rows.select("rec", at.cast("bigint").alias("idx"), ll.alias("ll")), TR, [1 / N] * N, values=(column,))
    return got.select("rec", F.col("idx").alias("t"), F.posexplode(column).alias("k", "x")).withColumn("x", F.round("x", 5))


@query(f"WITH RECURSIVE {HMM_SQL} SELECT rec, t, (generate_subscripts(f, 1) - 1)::INT AS k, round(unnest(f), 5) AS x FROM fw")
def hmm_forward(spark, sf_dir):
    return _hmm(spark, sf_dir, "forward")


@query(f"WITH RECURSIVE {HMM_SQL} SELECT rec, t, (generate_subscripts(b, 1) - 1)::INT AS k, round(unnest(b), 5) AS x FROM bw")
def hmm_backward(spark, sf_dir):
    return _hmm(spark, sf_dir, "backward")


@query(f"""WITH RECURSIVE {HMM_SQL}, po AS (SELECT rec, t, list_transform(range(1, {N + 1}), lambda k: exp(f[k] + b[k] - total)) AS p FROM fw JOIN bw USING (rec, t) JOIN tl USING (rec))
SELECT rec, t, (generate_subscripts(p, 1) - 1)::INT AS k, round(unnest(p), 5) AS x FROM po""")
def hmm_posterior(spark, sf_dir):
    return _hmm(spark, sf_dir, "posterior")
