"""Queries over segments: merging, frames, windows, formats, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from segspark.operators import segments as S
from segspark.sources import text as X

from . import tables as T


def registry():
    """Empty registries and a decorator that files a query under its name, with its oracle if it has one."""
    queries: dict = {}
    oracles: dict = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query


QUERIES, ORACLES, query = registry()


def _merged(spark, sf_dir, label="label"):
    rows = T.segments(spark, sf_dir)
    if label != "label":
        rows = rows.withColumn("label", F.expr(label))
    return S.merge_adjacent(rows, order=["start", "idx"], close=S.close_micros, doubled=True)


@query(f"WITH {T.SEGMENTS}, {T.merged_sql()} SELECT rec, run, s2::BIGINT AS start2, e2::BIGINT AS end2, label FROM mg")
def merge_adjacent(spark, sf_dir):
    return _merged(spark, sf_dir).select("rec", "run", F.col("start").alias("start2"), F.col("end").alias("end2"), "label")


@query(f"WITH {T.TURNS}, {T.merged_sql('tn')} SELECT rec, run, s2::BIGINT AS start2, e2::BIGINT AS end2, label FROM mg")
def merge_turns(spark, sf_dir):
    m = S.merge_adjacent(T.turns(spark, sf_dir), order=["start", "idx"], close=S.close_micros, doubled=True)
    return m.select("rec", "run", F.col("start").alias("start2"), F.col("end").alias("end2"), "label")


@query(f"""WITH {T.SEGMENTS}, {T.merged_sql()},
f AS (SELECT rec, label, round_even(s2 / 2000000.0::DOUBLE * 0.0001::DOUBLE, 0)::BIGINT AS lo, round_even(e2 / 2000000.0::DOUBLE * 0.0001::DOUBLE, 0)::BIGINT AS hi FROM mg),
s AS (SELECT rec, unnest(range(0, max(hi))) AS frame FROM f GROUP BY rec),
c AS (SELECT rec, label, unnest(range(lo, hi)) AS frame FROM f)
SELECT s.rec, s.frame, c.label FROM s LEFT JOIN c USING (rec, frame)""")
def frame_labels(spark, sf_dir):
    m = _merged(spark, sf_dir).withColumn("start", F.col("start") / 2000000.0).withColumn("end", F.col("end") / 2000000.0)
    return S.frame_labels(m, rate=0.0001)


@query(f"""WITH {T.TURNS}, {T.merged_sql('tn')},
f AS (SELECT rec, label, round_even(s2 / 2.0::DOUBLE * 0.01::DOUBLE, 0)::BIGINT AS lo, round_even(e2 / 2.0::DOUBLE * 0.01::DOUBLE, 0)::BIGINT AS hi FROM mg),
s AS (SELECT rec, unnest(range(0, 50)) AS frame FROM (SELECT DISTINCT rec FROM f)),
c AS (SELECT rec, label, unnest(range(lo, hi)) AS frame FROM f)
SELECT s.rec, s.frame, c.label FROM s LEFT JOIN c USING (rec, frame)""")
def turn_frame_labels(spark, sf_dir):
    m = S.merge_adjacent(T.turns(spark, sf_dir), order=["start", "idx"], close=S.close_micros, doubled=True)
    m = m.withColumn("start", F.col("start") / 2.0).withColumn("end", F.col("end") / 2.0)
    return S.frame_labels(m, length=50, rate=0.01)


@query("""WITH r AS (SELECT event_id AS idx, user_id AS rec, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
l AS (SELECT rec, max(run) AS run FROM r GROUP BY rec) SELECT rec, idx FROM r JOIN l USING (rec, run)""")
def run_split(spark, sf_dir):
    rows = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("rec"))
    return S.last_run_of_each(rows, ["idx"]).select("rec", "idx")


KIND_NO = "array_position(array(" + ", ".join(f"'{k}'" for k in T.KINDS) + "), label)"
KIND_SQL = "list_position([" + ", ".join(f"'{k}'" for k in T.KINDS) + "], label)"


def _lines(m):
    start, end = (F.expr(f"({c} - pmod({c}, 2)) div 2 / 1000000.0D") for c in ("start", "end"))
    dur = F.expr("((end - pmod(end, 2)) div 2 - (start - pmod(start, 2)) div 2) / 1000000.0D")
    return m.select("rec", "run", X.rttm_line(F.col("rec"), start, dur, F.expr(KIND_NO)).alias("line")), end


def _lines_sql(label: str = "label") -> str:
    return f"""SELECT rec, run, format('SPEAKER {{}} 1 {{:.6f}} {{:.6f}} <NA> <NA> {{}} <NA> <NA>', rec, (s2 - s2 % 2) // 2 / 1000000.0::DOUBLE,
  ((e2 - e2 % 2) // 2 - (s2 - s2 % 2) // 2) / 1000000.0::DOUBLE, {KIND_SQL}) AS line FROM mg"""


@query(f"WITH {T.SEGMENTS}, {T.merged_sql()} {_lines_sql()}")
def rttm_format(spark, sf_dir):
    return _lines(_merged(spark, sf_dir))[0]


SECOND = "element_at(array(" + ", ".join(f"'{k}'" for k in T.KINDS) + "), cast(pmod(floor(value), 5) as int) + 1)"
SECOND_SQL = "list_extract([" + ", ".join(f"'{k}'" for k in T.KINDS) + "], (floor(value)::BIGINT % 5) + 1)"


@query(f"WITH {T.SEGMENTS}, e2 AS (SELECT rec, idx, st, en, {SECOND_SQL} AS second FROM ev), {T.merged_sql('e2', 'second')} {_lines_sql()}")
def rttm_second(spark, sf_dir):
    rows = T.segments(spark, sf_dir).withColumn("second", F.expr(SECOND))
    return _lines(S.second_labels(rows, order=["start", "idx"], close=S.close_micros, doubled=True))[0]


@query(f"""WITH {T.SEGMENTS}, {T.merged_sql()}
SELECT rec::VARCHAR AS rec, 1 AS chan, (s2 - s2 % 2) // 2 / 1000000.0::DOUBLE AS start, ((e2 - e2 % 2) // 2 - (s2 - s2 % 2) // 2) / 1000000.0::DOUBLE AS dur, {KIND_SQL}::VARCHAR AS spk FROM mg""")
def rttm_parse(spark, sf_dir):
    return rttm_format(spark, sf_dir).select(X.parse_rttm(F.col("line")).alias("r")).select("r.*")


@query(f"""WITH {T.SEGMENTS}, {T.merged_sql()}, e2 AS (SELECT rec, idx, st, en, {SECOND_SQL} AS second FROM ev), {T.merged_sql('e2', 'second', 'ms')}
SELECT rec, run, s2::BIGINT AS start2, e2::BIGINT AS end2, label FROM mg UNION ALL SELECT rec, run, s2::BIGINT, e2::BIGINT, label FROM ms""")
def rttm_union(spark, sf_dir):
    one, two = _merged(spark, sf_dir), _merged(spark, sf_dir, SECOND)
    both = one.unionByName(two)
    return both.select("rec", "run", F.col("start").alias("start2"), F.col("end").alias("end2"), "label")


VAD_SQL = f"""{T.SEGMENTS},
vd AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY st, idx) - 1 AS segnum, trunc(st / 1000000.0::DOUBLE * 16000)::BIGINT AS s, trunc((st / 1000000.0::DOUBLE + value / 20.0::DOUBLE) * 16000)::BIGINT AS e FROM ev),
fr AS (SELECT *, (e - s + 120 + 200 - 400) // 160 + 1 AS frames FROM vd WHERE e - s > 160),
fl AS (SELECT *, CASE WHEN frames > 144 THEN (frames - 144 + 23) // 24 ELSE 0 END AS full_n FROM fr),
wk AS (SELECT *, unnest(range(0, full_n + 1)) AS k FROM fl),
wn AS (SELECT rec, segnum, s, e, k * 24 AS first, CASE WHEN k = full_n THEN frames ELSE k * 24 + 144 END AS last, k = full_n AS tail FROM wk),
wd AS (SELECT rec, segnum, first, last, format('{{}}_{{:04d}}-{{:08d}}-{{:08d}}', rec, segnum, first, last) AS key, ((s * 1000 + 8000) // 16000 + first * 10) / 1000.0::DOUBLE AS start,
  CASE WHEN tail THEN (e * 1000 + 8000) // 16000 / 1000.0::DOUBLE ELSE ((s * 1000 + 8000) // 16000 + (first + 144) * 10) / 1000.0::DOUBLE END AS stop FROM wn WHERE NOT tail OR last - first >= 10)"""


def _windows(spark, sf_dir):
    from pyspark.sql import Window

    rows = T.segments(spark, sf_dir)
    num = F.row_number().over(Window.partitionBy("rec").orderBy("start", "idx")) - 1
    vad = rows.select("rec", num.alias("segnum"), (F.col("start") / 1000000.0).alias("start"), (F.col("start") / 1000000.0 + F.col("value") / 20.0).alias("end"))
    return S.embedding_windows(vad)


@query(f"WITH {VAD_SQL} SELECT rec, segnum::INT AS segnum, first, last, key, start, stop FROM wd")
def xvec_windows(spark, sf_dir):
    return _windows(spark, sf_dir).withColumnRenamed("end", "stop")


@query(f"WITH {VAD_SQL} SELECT key || ' ' || rec || ' ' || start::VARCHAR || ' ' || stop::VARCHAR AS line FROM wd")
def seg_format(spark, sf_dir):
    return _windows(spark, sf_dir).select(X.timing_line(F.col("key"), F.col("rec"), F.col("start"), F.col("end")).alias("line"))


@query("SELECT DISTINCT 'conv_' || conv_id AS rec FROM conversations")
def rec_from_key(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.select(S.recording_of(F.concat_ws("_", F.lit("conv"), "conv_id", "turn")).alias("rec")).distinct()


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def list_semi(spark, sf_dir):
    listed = T.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return T.table(spark, sf_dir, "events").join(listed, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT vec_id // 50 AS rec, count(*) AS n FROM embeddings WHERE vec_id // 50 IN (SELECT user_id FROM events) GROUP BY 1")
def score_semi(spark, sf_dir):
    ref = T.segments(spark, sf_dir).select("rec")
    return T.vectors(spark, sf_dir).join(ref, "rec", "left_semi").groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VAD_SQL} SELECT rec, key, start, stop, (first // 24) % 4 AS label FROM wd")
def label_timing_join(spark, sf_dir):
    w = _windows(spark, sf_dir)
    labels = w.select("rec", "key", F.expr("pmod(first div 24, 4)").alias("label"))
    return S.labels_with_times(labels, w.select("rec", "key", "start", "end")).select("rec", "key", "start", F.col("end").alias("stop"), "label")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_counts(spark, sf_dir):
    """Batch form of the streaming tumbling count."""
    e = T.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nb FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(nb) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n FROM r GROUP BY user_id, run""")
def session_merge(spark, sf_dir):
    """Batch form of the streaming session merge."""
    e = T.table(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")
