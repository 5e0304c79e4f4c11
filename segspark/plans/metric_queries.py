"""Queries over segmentation quality.

Reference: a segment per event.  System: the events under another label, shifted, so that misses, false
alarms and confusions all occur.  Collars and frames are on the scale of these segments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.operators import metrics as E

from . import tables as T
from .segment_queries import registry

QUERIES, ORACLES, query = registry()

SHIFT = 2_000_000_000
COLLAR = 250_000_000
STEP = 10_000_000_000
SIDES = f"""{T.SEGMENTS},
rf AS (SELECT rec, st AS s, en AS e, label AS spk FROM ev),
hy AS (SELECT rec, st + {SHIFT} AS s, en + {SHIFT} AS e, 'h' || (floor(value)::BIGINT % 4) AS spk FROM ev)"""


def sides(spark, sf_dir):
    rows = T.segments(spark, sf_dir)
    ref = rows.select("rec", "start", "end", F.col("label").alias("spk"))
    hyp = rows.select("rec", (F.col("start") + SHIFT).alias("start"), (F.col("end") + SHIFT).alias("end"), F.concat(F.lit("h"), F.pmod(F.floor("value"), F.lit(4)).cast("string")).alias("spk"))
    return ref, hyp


def best_map_sql(source: str, sign: str = "max") -> str:
    """CTEs that try every one-to-one map of ``source (rec, ref, hyp, w)``: ``bm (rec, pairs)`` is the best."""
    return f"""hs AS (SELECT rec, list(DISTINCT hyp ORDER BY hyp) AS hs FROM {source} GROUP BY rec),
op AS (SELECT rec, ref, hyp, w FROM {source} UNION ALL SELECT DISTINCT rec, '', hyp, 0 FROM {source}),
tr AS (SELECT rec, 1 AS k, []::VARCHAR[] AS used, [{{'ref': '', 'hyp': ''}}] AS pairs, 0::DOUBLE AS total FROM hs
  UNION ALL SELECT t.rec, t.k + 1, CASE WHEN o.ref = '' THEN t.used ELSE list_append(t.used, o.ref) END, list_append(t.pairs, {{'ref': o.ref, 'hyp': o.hyp}}), t.total + o.w
  FROM tr t JOIN hs USING (rec) JOIN op o ON o.rec = t.rec AND o.hyp = hs.hs[t.k] AND NOT list_contains(t.used, o.ref)),
bm AS (SELECT rec, arg_{sign}(pairs, (total, used)) AS pairs, {sign}(total) AS total FROM tr JOIN hs USING (rec) WHERE k = len(hs.hs) + 1 GROUP BY rec)"""


def der_sql(collar: int, skip: bool) -> str:
    near = f"SELECT rec, unnest([s, e]) + c AS t FROM rf, (SELECT unnest([-{collar}, {collar}]) AS c) UNION" if collar else ""
    return f"""WITH RECURSIVE {SIDES},
ts AS ({near} SELECT rec, unnest([s, e]) AS t FROM rf UNION SELECT rec, unnest([s, e]) FROM hy),
aq AS (SELECT rec, t, lead(t) OVER (PARTITION BY rec ORDER BY t) AS u FROM ts),
bd AS (SELECT DISTINCT rec, unnest([s, e]) AS b FROM rf),
a0 AS (SELECT rec, t, u, u - t AS d FROM aq WHERE u IS NOT NULL {f'AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.rec = aq.rec AND bd.b - {collar} <= aq.t AND bd.b + {collar} >= aq.u)' if collar else ''}),
ra AS (SELECT DISTINCT a.rec, a.t, spk FROM a0 a JOIN rf ON rf.rec = a.rec AND rf.s <= a.t AND rf.e >= a.u),
ha AS (SELECT DISTINCT a.rec, a.t, spk FROM a0 a JOIN hy ON hy.rec = a.rec AND hy.s <= a.t AND hy.e >= a.u),
rn AS (SELECT rec, t, count(*) AS n FROM ra GROUP BY rec, t), hn AS (SELECT rec, t, count(*) AS n FROM ha GROUP BY rec, t),
ak AS (SELECT a0.* FROM a0 LEFT JOIN rn USING (rec, t) {'WHERE coalesce(rn.n, 0) < 2' if skip else ''}),
bo AS (SELECT ak.rec, t, d, ra.spk AS ref, ha.spk AS hyp FROM ak JOIN ra USING (rec, t) JOIN ha USING (rec, t)),
ov AS (SELECT rec, ref, hyp, sum(d)::DOUBLE AS w FROM bo GROUP BY rec, ref, hyp),
{best_map_sql('ov')},
cr AS (SELECT bo.rec, t, count(*) AS n FROM bo JOIN bm USING (rec) WHERE list_contains(pairs, {{'ref': ref, 'hyp': hyp}}) GROUP BY bo.rec, t),
al AS (SELECT ak.rec, d, coalesce(rn.n, 0) AS nr, coalesce(hn.n, 0) AS nh, coalesce(cr.n, 0) AS nc FROM ak LEFT JOIN rn USING (rec, t) LEFT JOIN hn USING (rec, t) LEFT JOIN cr USING (rec, t)),
sm AS (SELECT rec, sum(d * nr) AS scored, sum(d * greatest(nr - nh, 0)) AS miss, sum(d * greatest(nh - nr, 0)) AS fa, sum(d * (least(nr, nh) - nc)) AS conf FROM al GROUP BY rec)
SELECT rec, scored::BIGINT AS scored, miss::BIGINT AS miss, fa::BIGINT AS false_alarm, conf::BIGINT AS confusion, round((miss + fa + conf)::DOUBLE / scored::DOUBLE, 6) AS error FROM sm"""


def _der(spark, sf_dir, collar, skip):
    ref, hyp = sides(spark, sf_dir)
    return E.interval_error(ref, hyp, collar, skip).withColumn("error", F.round("error", 6))


@query(der_sql(COLLAR, True))
def der_intervals_forgiving(spark, sf_dir):
    return _der(spark, sf_dir, COLLAR, True)


@query(der_sql(COLLAR, False))
def der_intervals_fair(spark, sf_dir):
    return _der(spark, sf_dir, COLLAR, False)


@query(der_sql(0, False))
def der_intervals_full(spark, sf_dir):
    return _der(spark, sf_dir, 0, False)


FRAMES = f"""{SIDES},
rfr AS (SELECT DISTINCT rec, spk, unnest(range(greatest(ceil((s - {STEP // 2}) / {float(STEP)})::BIGINT, 0), ceil((e - {STEP // 2}) / {float(STEP)})::BIGINT)) AS f FROM rf),
hfr AS (SELECT DISTINCT rec, spk, unnest(range(greatest(ceil((s - {STEP // 2}) / {float(STEP)})::BIGINT, 0), ceil((e - {STEP // 2}) / {float(STEP)})::BIGINT)) AS f FROM hy)"""


@query(f"""WITH RECURSIVE {FRAMES},
nr AS (SELECT rec, spk AS ref, count(*) AS n FROM rfr GROUP BY ALL), nh AS (SELECT rec, spk AS hyp, count(*) AS n FROM hfr GROUP BY ALL),
oc AS (SELECT r.rec, r.spk AS ref, h.spk AS hyp, count(*) AS o FROM rfr r JOIN hfr h USING (rec, f) GROUP BY ALL),
ov AS (SELECT rec, ref, hyp, o / (nr.n + nh.n - o)::DOUBLE AS w FROM oc JOIN nr USING (rec, ref) JOIN nh USING (rec, hyp)),
{best_map_sql('ov')}, c AS (SELECT rec, count(*) AS n FROM nr GROUP BY rec)
SELECT rec, round(1 - coalesce(total, 0) / n, 6) AS jer FROM c LEFT JOIN bm USING (rec)""")
def jer(spark, sf_dir):
    return E.jaccard_error(*sides(spark, sf_dir), STEP).withColumn("jer", F.round("jer", 6))


TABLE = f"""{FRAMES},
sz AS (SELECT rec, max(f) + 1 AS size FROM (SELECT rec, f FROM rfr UNION ALL SELECT rec, f FROM hfr) GROUP BY rec),
sp AS (SELECT rec, size, unnest(range(0, size)) AS f FROM sz),
ca AS (SELECT rec, f, string_agg(spk, '+' ORDER BY spk) AS a FROM rfr GROUP BY rec, f), cb AS (SELECT rec, f, string_agg(spk, '+' ORDER BY spk) AS b FROM hfr GROUP BY rec, f),
jt AS (SELECT sp.rec, coalesce(a, '') AS a, coalesce(b, '') AS b, count(*) / any_value(size)::DOUBLE AS p FROM sp LEFT JOIN ca USING (rec, f) LEFT JOIN cb USING (rec, f) GROUP BY ALL),
mt AS (SELECT *, sum(p) OVER (PARTITION BY rec, a) AS pa, sum(p) OVER (PARTITION BY rec, b) AS pb FROM jt)"""


def _table(spark, sf_dir):
    return E.contingency(*sides(spark, sf_dir), STEP)


def _rounded(df):
    return df.select("rec", *(F.round(c, 6).alias(c) for c in df.columns if c != "rec"))


@query(f"""WITH {TABLE}, s AS (SELECT rec, sum(p * p / pb) AS pr, sum(p * p / pa) AS re FROM mt GROUP BY rec)
SELECT rec, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM s""")
def b3(spark, sf_dir):
    return _rounded(E.b_cubed(_table(spark, sf_dir)))


@query(f"""WITH {TABLE}, s AS (SELECT rec, sum(p * p / pb) AS y, sum(p * p / pa) AS x, sum(p * pa) AS qa, sum(p * pb) AS qb FROM mt GROUP BY rec)
SELECT rec, round((x - qb) / (1 - qb), 6) AS tau_ref_sys, round((y - qa) / (1 - qa), 6) AS tau_sys_ref FROM s""")
def gkt(spark, sf_dir):
    return _rounded(E.tau(_table(spark, sf_dir)))


@query(f"""WITH {TABLE}, s AS (SELECT rec, sum(-p * log2(p / pb)) AS hrs, sum(-p * log2(p / pa)) AS hsr, sum(p * log2(p / (pa * pb))) AS mi, sum(-p * log2(pa)) AS hr, sum(-p * log2(pb)) AS hs FROM mt GROUP BY rec)
SELECT rec, round(hrs, 6) AS h_ref_sys, round(hsr, 6) AS h_sys_ref, round(mi, 6) AS mi, round(mi / sqrt(hr * hs), 6) AS nmi FROM s""")
def entropy_mi(spark, sf_dir):
    return _rounded(E.entropies(_table(spark, sf_dir)))
