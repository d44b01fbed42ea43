"""Queries of whole evaluations: benchmarks, cases, fused readings, injected errors and their surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators import evaluation, metrics, propagation
from strataframe.plans.catalog import BAND, HASH, IDW, QP, TAXONOMY_SQL, WITH, channels, query, told
from strataframe.plans.fixtures import BASE_SQL, points, queries_points, reference_intervals, table

_NAMED = "CAST(pk AS VARCHAR) AS lithology, concat('layer ', pk) AS description"


def _headers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    price = F.round("o_totalprice", 2).cast("decimal(14,2)")
    ref = o.select(k.alias("doc"), F.col("o_orderpriority").alias("project_name"), price.alias("final_depth_m"))
    pred = o.select(k.alias("doc"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("project_name"), F.when(k % 11 != 0, price + F.when(k % 5 == 0, 0.5).otherwise(0).cast("decimal(14,2)")).cast("decimal(14,2)").alias("final_depth_m"))
    return ref, pred


def _benchmark(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ref, a, _ = channels(spark, d)
    named = lambda x, shift: x.select("doc", "seq", "top", "bottom", F.when(F.lit(shift) & (F.col("pk") % 13 == 0), "other").otherwise(F.col("pk").cast("string")).alias("lithology"), F.when(F.lit(shift) & (F.col("pk") % 6 == 0), "layer").otherwise(F.concat(F.lit("layer "), "pk")).alias("description"))
    return evaluation.evaluate_benchmark(_headers(spark, d), (named(ref, False), named(a, True)), "0.03", ("0.01", "0.05"), {"final_depth_m": "0.25"})


_MET = f"""{WITH}, {BAND.format(t="0.03")}, h AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT te, be, ref.pk FROM pairs JOIN ref ON pairs.doc = ref.doc AND pairs.r_seq = ref.seq),
n AS (SELECT (SELECT count(*) FROM pairs) AS tp, (SELECT count(*) FROM ref) AS refs, (SELECT count(*) FROM pa) AS preds),
t(metric, numerator, denominator) AS (SELECT 'project_name_exact', count(*) FILTER (WHERE k % 7 <> 0)::DOUBLE, count(*) FROM h UNION ALL SELECT 'final_depth_m_mae', 0.5 * count(*) FILTER (WHERE k % 5 = 0 AND k % 11 <> 0), count(*) FILTER (WHERE k % 11 <> 0) FROM h
UNION ALL SELECT 'final_depth_m_coverage', count(*) FILTER (WHERE k % 11 <> 0), count(*) FROM h UNION ALL SELECT 'final_depth_m_critical', count(*) FILTER (WHERE k % 11 = 0 OR k % 5 = 0), count(*) FROM h
UNION ALL SELECT 'matched_top_mae', sum(te), count(*) FROM m UNION ALL SELECT 'matched_bottom_mae', sum(be), count(*) FROM m
UNION ALL SELECT 'matched_top_at_0.01m', count(*) FILTER (WHERE te <= 0.01), count(*) FROM m UNION ALL SELECT 'matched_top_at_0.05m', count(*) FILTER (WHERE te <= 0.05), count(*) FROM m
UNION ALL SELECT 'matched_bottom_at_0.01m', count(*) FILTER (WHERE be <= 0.01), count(*) FROM m UNION ALL SELECT 'matched_bottom_at_0.05m', count(*) FILTER (WHERE be <= 0.05), count(*) FROM m
UNION ALL SELECT 'lithology_exact', count(*) FILTER (WHERE pk % 13 <> 0), count(*) FROM m UNION ALL SELECT 'description_cer', sum(CASE WHEN pk % 6 = 0 THEN length(concat('layer ', pk)) - 5 ELSE 0 END), sum(length(concat('layer ', pk))) FROM m
UNION ALL SELECT 'interval_precision', tp, preds FROM n UNION ALL SELECT 'interval_recall', tp, refs FROM n UNION ALL SELECT 'interval_f1', 2 * tp, refs + preds FROM n)"""


@query(f"{_MET} SELECT metric, round(numerator, 6) AS numerator, CAST(denominator AS BIGINT) AS denominator, round(numerator / nullif(CAST(denominator AS DOUBLE), 0), 9) AS value FROM t")
def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    return told(_benchmark(spark, d)[0])


@query(f"""{WITH}, {BAND.format(t="0.03")}, h AS (SELECT o_orderkey AS k FROM orders), m AS (SELECT te, be, ref.pk FROM pairs JOIN ref ON pairs.doc = ref.doc AND pairs.r_seq = ref.seq),
c AS (SELECT 'OCR_digit_error' AS l, count(*) FILTER (WHERE k % 11 = 0 OR k % 5 = 0) AS n FROM h UNION ALL SELECT 'missing_interval', (SELECT count(*) FROM ref) - count(*) FROM pairs UNION ALL SELECT 'hallucination', (SELECT count(*) FROM pa) - count(*) FROM pairs
UNION ALL SELECT 'interval_boundary_error', count(*) FILTER (WHERE te > 0) + count(*) FILTER (WHERE be > 0) FROM m UNION ALL SELECT 'lithology_semantic_error', count(*) FILTER (WHERE pk % 13 = 0) FROM m),
t(label) AS ({TAXONOMY_SQL}) SELECT label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / CAST((SELECT sum(n) FROM c) AS DOUBLE), 9) AS rate, true AS known FROM t LEFT JOIN c ON label = l""")
def benchmark_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_distribution(_benchmark(spark, d)[1]).withColumn("rate", F.round("rate", 9))


_CASE = """ev AS (SELECT event_id AS k, value - floor(value) AS p, CAST(event_type IN ('click', 'purchase') AS INT) AS y FROM events),
cs AS (SELECT k, p, y, k % 5 AS ref, CASE WHEN k % 3 = 0 THEN k % 5 ELSE (k + 1) % 5 END AS orig, CASE k % 4 WHEN 0 THEN 'ACCEPT_PROPOSAL' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'ACCEPT_PROPOSAL' ELSE 'KEEP' END AS status,
CASE WHEN k % 8 < 6 THEN k % 5 ELSE (k + 2) % 5 END AS acc, k % 6 < 2 AS review, k % 2 = 0 AS fit FROM ev)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("case_id"), (k % 5).alias("reference"), F.when(k % 3 == 0, k % 5).otherwise((k + 1) % 5).alias("original"), F.element_at(F.array(*map(F.lit, ("ACCEPT_PROPOSAL", "NEEDS_REVIEW", "ACCEPT_PROPOSAL", "KEEP"))), (k % 4 + 1).cast("int")).alias("status"),
        F.when(k % 8 < 6, k % 5).otherwise((k + 2) % 5).alias("accepted_value"), (k % 6 < 2).alias("needs_review"), (F.col("value") - F.floor("value")).alias("confidence"), F.col("event_type").isin("click", "purchase").cast("int").alias("correct"),
        F.when(k % 2 == 0, "calibration").otherwise("test").alias("partition"), F.lit("synthetic").alias("truth"),
    )


def _case_sql(where: str = "NOT fit") -> str:
    """Metrics of the test cases; the temperature is the best of the grid on the others."""
    clip = "greatest(least(p, 1 - 1e-6), 1e-6)"
    return f"""o AS (SELECT ln({clip} / (1 - {clip})) AS o, y FROM cs WHERE fit), g AS (SELECT 0.05 + step * 0.05 AS t FROM range(200) r(step)), l AS (SELECT t, avg(ln(1 + exp(-(CASE WHEN y = 1 THEN o ELSE -o END) / t))) AS loss FROM o, g GROUP BY 1),
best AS (SELECT t FROM l ORDER BY loss, t LIMIT 1), x AS (SELECT cs.*, 1 / (1 + exp(-ln({clip} / (1 - {clip})) / (SELECT t FROM best))) AS q, status = 'ACCEPT_PROPOSAL' AS auto, status = 'NEEDS_REVIEW' AS flag FROM cs WHERE {where}),
b AS (SELECT 'raw' AS name, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS c, avg(CAST(y AS DOUBLE)) AS a FROM x GROUP BY 2 UNION ALL SELECT 'calibrated', CAST(least(floor(q * 10), 9) AS INT), count(*), avg(q), avg(CAST(y AS DOUBLE)) FROM x GROUP BY 2),
v AS (SELECT 'false_correction_rate' AS metric, count(*) FILTER (WHERE auto AND orig = ref AND acc <> ref) / count(*) FILTER (WHERE auto) AS value FROM x UNION ALL SELECT 'incorrect_correction_rate', count(*) FILTER (WHERE auto AND acc <> ref) / count(*) FILTER (WHERE auto) FROM x
UNION ALL SELECT 'correction_success_rate', count(*) FILTER (WHERE auto AND orig <> ref AND acc = ref) / count(*) FILTER (WHERE auto) FROM x UNION ALL SELECT 'automatic_correction_rate', count(*) FILTER (WHERE auto) / count(*) FROM x
UNION ALL SELECT 'manual_review_precision', count(*) FILTER (WHERE review AND flag) / count(*) FILTER (WHERE flag) FROM x UNION ALL SELECT 'manual_review_recall', count(*) FILTER (WHERE review AND flag) / count(*) FILTER (WHERE review) FROM x
UNION ALL SELECT 'review_rate', count(*) FILTER (WHERE flag) / count(*) FROM x UNION ALL SELECT 'auto_accept_rate', count(*) FILTER (WHERE NOT flag) / count(*) FROM x UNION ALL SELECT 'auto_accept_error_rate', count(*) FILTER (WHERE review AND NOT flag) / count(*) FILTER (WHERE NOT flag) FROM x
UNION ALL SELECT 'raw_brier', avg((p - y) * (p - y)) FROM x UNION ALL SELECT 'calibrated_brier', avg((q - y) * (q - y)) FROM x UNION ALL SELECT name || '_ece', sum(n * abs(a - c)) / sum(n) FROM b GROUP BY name UNION ALL SELECT 'temperature', t FROM best)"""


@query(f"WITH {_CASE}, {_case_sql()} SELECT metric, round(value, 6) AS value FROM v")
def case_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate_cases(_cases(spark, d), "synthetic").select("metric", F.round("value", 6).alias("value"))


@query(f"""WITH {_CASE}, {_case_sql()}, u AS (SELECT 'full' AS variant, metric, value FROM v UNION ALL SELECT 'minus_calibration', metric, CASE metric WHEN 'temperature' THEN NULL WHEN 'calibrated_brier' THEN (SELECT value FROM v WHERE metric = 'raw_brier') WHEN 'calibrated_ece' THEN (SELECT value FROM v WHERE metric = 'raw_ece') ELSE value END FROM v)
SELECT variant, metric, round(value, 6) AS value FROM u""")
def ablation_evaluation(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d)
    both = c.withColumn("variant", F.lit("full")).unionByName(c.withColumn("variant", F.lit("minus_calibration")))
    return evaluation.evaluate_ablation(both, "synthetic").select("variant", "metric", F.round("value", 6).alias("value"))


@query(f"""{WITH}, s AS (SELECT doc, top, bottom, 'r' AS w FROM ref UNION SELECT doc, top, bottom, 'o' FROM pa UNION SELECT doc, top, bottom, 'n' FROM pb), k AS (SELECT doc, top, bottom, bool_or(w = 'r') AS r, bool_or(w = 'o') AS o, bool_or(w = 'n') AS n FROM s GROUP BY ALL),
p AS (SELECT doc, count(*) FILTER (WHERE o AND r AND NOT n) AS cr, count(*) FILTER (WHERE o AND NOT r AND NOT n) AS ir, count(*) FILTER (WHERE n AND r AND NOT o) AS ca, count(*) FILTER (WHERE n AND NOT r AND NOT o) AS ia,
coalesce(2.0 * count(*) FILTER (WHERE r AND o) / nullif(count(*) FILTER (WHERE r) + count(*) FILTER (WHERE o), 0), 0) AS f0, coalesce(2.0 * count(*) FILTER (WHERE r AND n) / nullif(count(*) FILTER (WHERE r) + count(*) FILTER (WHERE n), 0), 0) AS f1 FROM k GROUP BY doc)
SELECT CAST(sum(cr) AS BIGINT) AS correct_removed, CAST(sum(ir) AS BIGINT) AS incorrect_removed, CAST(sum(ca) AS BIGINT) AS correct_added, CAST(sum(ia) AS BIGINT) AS incorrect_added, count(*) FILTER (WHERE cr + ia > 0) AS documents_harmed, count(*) FILTER (WHERE f1 < f0 - 1e-12) AS documents_worsened, count(*) AS documents,
CAST(sum(cr + ir + ca + ia) AS BIGINT) AS actions, CAST(sum(cr + ia) AS BIGINT) AS harmful, round(sum(cr + ia) / CAST(sum(cr + ir + ca + ia) AS DOUBLE), 9) AS false_correction_rate FROM p""")
def change_safety(spark: SparkSession, d: str) -> DataFrame:
    ref, a, b = channels(spark, d)
    return evaluation.change_safety(evaluation.change_taxonomy(ref, a, b)).withColumn("false_correction_rate", F.round("false_correction_rate", 9))


@query(f"""{WITH}, na AS (SELECT doc, count(*) AS n FROM pa GROUP BY 1), nb AS (SELECT doc, count(*) AS n FROM pb GROUP BY 1), ga AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i, bottom FROM pa), gb AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i, bottom FROM pb),
f AS (SELECT coalesce(na.n, 0) AS x, coalesce(nb.n, 0) AS y, ga.bottom AS g, gb.bottom AS v FROM ga FULL JOIN gb ON ga.doc = gb.doc AND ga.i = gb.i LEFT JOIN na ON na.doc = coalesce(ga.doc, gb.doc) LEFT JOIN nb ON nb.doc = coalesce(ga.doc, gb.doc))
SELECT CASE WHEN x = y THEN CASE WHEN g = v THEN 'agreement_keep_grounded_provenance' ELSE 'disagreement_keep_grounded_needs_review' END WHEN x = 0 THEN 'visual_intervals_unaligned_needs_review' ELSE 'count_mismatch_keep_grounded_needs_review' END AS decision,
CASE WHEN x = y THEN CASE WHEN g = v THEN NULL ELSE 'FUSION_DISAGREEMENT' END WHEN x = 0 THEN 'FUSION_UNALIGNED_VISUAL_INTERVAL' ELSE 'FUSION_INTERVAL_COUNT_MISMATCH' END AS warning, count(*) AS n, round(sum(CAST(CASE WHEN x = 0 THEN v ELSE g END AS DOUBLE)), 2) AS depth
FROM f WHERE x = y OR (x = 0 AND v IS NOT NULL) OR (x > 0 AND g IS NOT NULL) GROUP BY 1, 2""")
def fused_intervals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    _, a, b = channels(spark, d)
    placed = lambda x: x.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("seq")).alias("seq"), "bottom")
    f = evaluation.fuse_intervals(placed(a), placed(b), ["bottom"])
    return f.groupBy("decision", "warning").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("depth"))


@query(f"""{WITH}, na AS (SELECT doc, count(*) AS n FROM pa GROUP BY 1), nb AS (SELECT doc, count(*) AS n FROM pb GROUP BY 1), c AS (SELECT coalesce(na.doc, nb.doc) AS doc, coalesce(nb.n, 0) > coalesce(na.n, 0) AS accepted FROM na FULL JOIN nb ON na.doc = nb.doc),
u AS (SELECT pb.doc, top, bottom, accepted FROM pb JOIN c USING (doc) WHERE accepted UNION ALL SELECT pa.doc, top, bottom, accepted FROM pa JOIN c USING (doc) WHERE NOT accepted) SELECT doc, accepted, count(*) AS n, round(sum(CAST(bottom - top AS DOUBLE)), 4) AS depth FROM u GROUP BY ALL""")
def selective_policy(spark: SparkSession, d: str) -> DataFrame:
    _, a, b = channels(spark, d)
    return evaluation.selective_acceptance(a, b).groupBy("doc", "accepted").agg(F.count("*").alias("n"), F.round(F.sum((F.col("bottom") - F.col("top")).cast("double")), 4).alias("depth"))


@query(f"""WITH RECURSIVE {BASE_SQL}, p AS (SELECT doc, list(CAST(bottom AS DOUBLE) ORDER BY bottom) AS p FROM pa GROUP BY doc), e AS (SELECT doc, list(CAST(bottom AS DOUBLE) ORDER BY bottom) AS e FROM ref GROUP BY doc),
b AS (SELECT coalesce(p.doc, e.doc) AS doc, coalesce(p, []) AS p, coalesce(e, []) AS e FROM p FULL JOIN e ON p.doc = e.doc),
fold AS (SELECT doc, p, len(e) AS n, e AS free, 0 AS i, 0 AS tp FROM b UNION ALL SELECT doc, p, n, CASE WHEN d <= 0.035 THEN free[:pos - 1] || free[pos + 1:] ELSE free END, i + 1, tp + CAST(coalesce(d <= 0.035, false) AS INT)
FROM (SELECT *, list_min(list_transform(free, lambda x: abs(x - p[i + 1]))) AS d, list_position(list_transform(free, lambda x: abs(x - p[i + 1])), list_min(list_transform(free, lambda x: abs(x - p[i + 1])))) AS pos FROM fold WHERE i < len(p)))
SELECT doc, tp, CAST(len(p) - tp AS INT) AS fp, CAST(n - tp AS INT) AS fn FROM fold WHERE i = len(p)""")
def greedy_points(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    side = lambda x: x.select("doc", F.col("bottom").alias("value"))
    return evaluation.greedy_matches(side(a), side(ref), 0.035)


@query(f"""{WITH}, p AS (SELECT doc, list(CAST(bottom AS DOUBLE) ORDER BY bottom) AS p FROM pa GROUP BY doc), e AS (SELECT doc, list(CAST(bottom AS DOUBLE) ORDER BY bottom) AS e FROM ref GROUP BY doc), b AS (SELECT coalesce(p.doc, e.doc) AS doc, coalesce(p, []) AS p, coalesce(e, []) AS e FROM p FULL JOIN e ON p.doc = e.doc)
SELECT doc, len(p) = len(e) AND len(list_filter(range(1, len(p) + 1), lambda i: abs(p[i] - e[i]) > 0.045)) = 0 AS exact, len(list_filter(p, lambda a: len(list_filter(e, lambda x: abs(a - x) <= 0.045)) = 0)) = 0 AS safe FROM b""")
def sequence_agreement(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    side = lambda x: x.select("doc", F.col("bottom").alias("value"))
    return evaluation.exact_sequences(side(a), side(ref), 0.045)


@query(f"WITH {_CASE}, x AS (SELECT *, status = 'ACCEPT_PROPOSAL' AS auto FROM cs) SELECT CAST(y AS INT) AS correct, round(count(*) FILTER (WHERE auto AND orig = ref AND acc <> ref) / count(*) FILTER (WHERE auto), 9) AS false_rate, round(count(*) FILTER (WHERE auto AND orig <> ref AND acc = ref) / count(*) FILTER (WHERE auto), 9) AS success_rate FROM x GROUP BY 1")
def correction_rates(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.correction_safety(_cases(spark, d), ("correct",))
    pick = lambda n: F.round(F.max(F.when(F.col("metric") == n, F.col("value"))), 9)
    return m.groupBy("correct").agg(pick("false_correction_rate").alias("false_rate"), pick("correction_success_rate").alias("success_rate"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """doc, x, y, collar and the bottoms of each order's intervals."""
    k = F.col("doc")
    depths = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("bottom").cast("double").alias("b")))), lambda i: i["b"])
    r = reference_intervals(spark, d).groupBy("doc").agg(depths.alias("depths"))
    return r.select("doc", ((k * 37) % 101).cast("double").alias("x"), ((k * 53) % 97).cast("double").alias("y"), F.lit(100.0).alias("collar"), "depths")


_REC = "rec AS (SELECT doc, CAST((doc * 37) % 101 AS DOUBLE) AS x, CAST((doc * 53) % 97 AS DOUBLE) AS y, list(CAST(bottom AS DOUBLE) ORDER BY seq) AS d FROM ref GROUP BY doc)"
_U = lambda what: f"({HASH.format(salt=f'7:{what}:', c='doc')} / 4294967296.0)"
_CHANGES = {
    "missing_boundary": ("len(d)", "len(d) >= 1", "list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i = pos THEN NULL ELSE d[i] END)", "d[pos]"), "merged_layer": ("len(d) - 1", "len(d) >= 2", "d[:pos - 1] || d[pos + 1:]", "d[pos]"),
    "split_layer": ("len(d)", "len(d) >= 1", "d[:pos - 1] || [(CASE WHEN pos = 1 THEN 0 ELSE d[pos - 1] END + d[pos]) / 2] || d[pos:]", "(CASE WHEN pos = 1 THEN 0 ELSE d[pos - 1] END + d[pos]) / 2"), "duplicate_boundary": ("len(d)", "len(d) >= 1", "d[:pos - 1] || [d[pos]] || d[pos:]", "d[pos]"),
}


def _inject_sql(error: str) -> str:
    slots, fit, new, change = _CHANGES[error]
    return f"""SELECT '{error}' AS error, r.doc, len(n) AS slots, CAST(len(list_filter(n, lambda v: v IS NULL)) AS BIGINT) AS missing, round(coalesce(list_sum(n), 0), 4) AS total, CAST(CASE WHEN hit THEN pos END AS INT) AS place, round(CASE WHEN hit THEN c END, 4) AS change FROM
(SELECT doc, hit, pos, CASE WHEN hit THEN {new} ELSE d END AS n, {change} AS c FROM (SELECT rec.*, CAST(floor({_U('place')} * ({slots})) AS BIGINT) + 1 AS pos, doc IN (SELECT doc FROM rec WHERE {fit} ORDER BY {HASH.format(salt='7:pick:', c='doc')}, CAST(doc AS VARCHAR) LIMIT (SELECT CAST(round_even(count(*) * 0.25, 0) AS BIGINT) FROM rec WHERE {fit})) AS hit FROM rec)) r"""


@query(f"{WITH}, {_REC} " + " UNION ALL ".join(map(_inject_sql, _CHANGES)))
def injected_errors(spark: SparkSession, d: str) -> DataFrame:
    """Four classes of errors in a quarter of the records each."""
    r, out = _records(spark, d), None
    for error in _CHANGES:
        n = propagation.inject(r, error, 0.25, 7)
        told_ = n.select(F.lit(error).alias("error"), "doc", F.size("depths").cast("long").alias("slots"), F.size(F.filter("depths", lambda v: v.isNull())).cast("long").alias("missing"), F.round(F.aggregate("depths", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 4).alias("total"), "place", F.round("change", 4).alias("change"))
        out = told_ if out is None else out.unionByName(told_)
    return out


@query(f"""{WITH}, {_REC}, c AS (SELECT doc, unnest(range(1, len(d) + 1)) AS i, d FROM rec), f AS (SELECT doc, i, d[i] - 0.5 > CASE WHEN i = 1 THEN 0 ELSE d[i - 1] END AS up, i = len(d) OR d[i] + 0.5 < d[i + 1] AS down, concat(doc, '/', i - 1) AS k FROM c),
g AS (SELECT *, ('0x' || substr(sha256('7:pick:' || k), 1, 8))::BIGINT AS h, (('0x' || substr(sha256('7:side:' || k), 1, 8))::BIGINT) / 4294967296.0 AS u FROM f WHERE up OR down), p AS (SELECT * FROM g ORDER BY h, k LIMIT (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM g))
SELECT doc, count(*) AS moved, round(CAST(sum(CASE WHEN up AND down THEN CASE WHEN u < 0.5 THEN -0.5 ELSE 0.5 END WHEN up THEN -0.5 ELSE 0.5 END) AS DOUBLE), 4) AS shift FROM p GROUP BY doc""")
def shifted_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the boundaries that have room, half a metre up or down."""
    r = _records(spark, d)
    n = propagation.inject(r, "boundary_shift", 0.5, 7, 0.1).where("operation is not null").select("doc", F.col("depths").alias("now")).join(r.select("doc", "depths"), "doc")
    by = F.zip_with("now", "depths", lambda a, b: a - b)
    return n.select("doc", F.size(F.filter(by, lambda v: F.abs(v) > 1e-6)).cast("long").alias("moved"), F.round(F.aggregate(by, F.lit(0.0), lambda a, v: a + v), 4).alias("shift"))


@query(f"""{WITH}, m AS (SELECT doc, seq, top, bottom, lead(seq) OVER w IS NOT NULL AS inner_, (('0x' || substr(sha256('3:' || doc || '/' || seq), 1, 8))::BIGINT) / 4294967296.0 AS u FROM ref WINDOW w AS (PARTITION BY doc ORDER BY seq)),
b AS (SELECT doc, seq, top, CAST(bottom AS DOUBLE) + CASE WHEN inner_ THEN CASE WHEN u < 0.5 THEN -0.1 ELSE 0.1 END ELSE 0 END AS nb FROM m), t AS (SELECT doc, seq, coalesce(lag(nb) OVER (PARTITION BY doc ORDER BY seq), CAST(top AS DOUBLE)) AS nt, nb FROM b)
SELECT doc, seq, round(nt, 4) AS top, round(nb, 4) AS bottom, round(nb - nt, 4) AS thickness FROM t""")
def perturbed_intervals(spark: SparkSession, d: str) -> DataFrame:
    p = propagation.perturb(reference_intervals(spark, d).select("doc", "seq", "top", "bottom"), 0.1, 3)
    return p.select("doc", "seq", *(F.round(c, 4).alias(c) for c in ("top", "bottom", "thickness")))


@query("""WITH c AS (SELECT c_custkey AS id, c_acctbal AS z, (('0x' || substr(sha256('5:hit:' || c_custkey), 1, 8))::BIGINT) / 4294967296.0 < 0.2 AS hit, (('0x' || substr(sha256('5:side:' || c_custkey), 1, 8))::BIGINT) / 4294967296.0 < 0.5 AS up FROM customer)
SELECT id, hit AS corrupted, round(z + CASE WHEN hit THEN CASE WHEN up THEN -2.0 ELSE 2.0 END ELSE 0 END, 4) AS z FROM c""")
def corrupted_points(spark: SparkSession, d: str) -> DataFrame:
    return propagation.corrupt(points(spark, d, "customer"), 2.0, 0.2, 5).select("id", "corrupted", F.round("z", 4).alias("z"))


_FOUND = "fnd AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN d[:len(d) - 1] WHEN doc % 3 = 1 THEN list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i = 1 THEN NULL ELSE d[i] + 0.25 END) ELSE d || [d[len(d)]] END AS f, d FROM rec)"


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records and predictions of them: without the last boundary, without the first one and deeper, with the last one twice."""
    r, k, v, n = _records(spark, d), F.col("doc") % 3, F.col("depths"), F.size("depths")
    first = F.transform(v, lambda x, i: F.when(i > 0, x + 0.25))
    return r, r.withColumn("depths", F.when(k == 0, F.slice(v, 1, n - 1)).when(k == 1, first).otherwise(F.concat(v, F.array(F.element_at(v, -1)))))


@query(f"""{WITH}, {_REC}, {_FOUND}, t AS (SELECT doc, abs(len(list_filter(f, lambda v: v IS NOT NULL)) - len(d)) AS c, len(list_filter(f, lambda v: v IS NULL)) AS m, len(list_filter(range(1, len(list_filter(f, lambda v: v IS NOT NULL))), lambda i: list_filter(f, lambda v: v IS NOT NULL)[i + 1] <= list_filter(f, lambda v: v IS NOT NULL)[i])) AS o,
len(list_filter(range(1, len(d) + 1), lambda i: coalesce(abs(f[i] - d[i]) > 1e-9, true))) AS w FROM fnd)
SELECT CAST(sum(c) AS BIGINT) AS count_difference, CAST(sum(m) AS BIGINT) AS missing_slots, CAST(sum(o) AS BIGINT) AS falls, CAST(sum(w) AS BIGINT) AS misplaced, count(*) FILTER (WHERE c > 0 OR m > 0 OR o > 0) AS mismatched, count(*) AS documents FROM t""")
def topology_errors(spark: SparkSession, d: str) -> DataFrame:
    t = propagation.topology(*_found(spark, d))
    return t.agg(*(F.sum(c).alias(c) for c in ("count_difference", "missing_slots", "falls", "misplaced")), F.count_if("mismatched").alias("mismatched"), F.count("*").alias("documents"))


@query(f"""{WITH}, {_REC}, {_FOUND}, b AS (SELECT unnest(range(1, len(d) + 1)) AS i, d, f FROM fnd) SELECT CAST(i AS INT) AS boundary, count(*) AS reference_points, count(f[i]) AS predicted_points, round(count(f[i]) / count(*), 9) AS coverage, round(avg(abs(f[i] - d[i])), 6) AS mae FROM b GROUP BY 1""")
def boundary_error_profile(spark: SparkSession, d: str) -> DataFrame:
    e = propagation.boundary_errors(*_found(spark, d))
    return e.select("boundary", "reference_points", "predicted_points", F.round("coverage", 9).alias("coverage"), F.round("mae", 6).alias("mae"))


def _propagated_sql(i: int) -> str:
    return f"""SELECT {i} AS boundary, count(*) AS n, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(max(abs(e)), 5) AS worst FROM (SELECT b.z - a.z AS e FROM ({IDW.format(q='q', p=f'(SELECT x, y, 100 - d[{i}] AS z FROM rec WHERE len(d) >= {i})')}) a
JOIN ({IDW.format(q='q', p=f'(SELECT rec.x, rec.y, 100 - f[{i}] AS z FROM fnd JOIN rec USING (doc) WHERE len(rec.d) >= {i} AND f[{i}] IS NOT NULL)')}) b USING (qid))"""


@query(f"{WITH}, {_REC}, {_FOUND}, {QP} " + " UNION ALL ".join(map(_propagated_sql, (1, 2))))
def propagated_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the surfaces of the first two boundaries from predicted records."""
    ref, found = _found(spark, d)
    q, out = queries_points(spark, d), None
    for i in (0, 1):
        e = propagation.surface_errors(ref, found, i, q).select(F.lit(i + 1).alias("boundary"), "n", *(F.round(c, 5).alias(c) for c in ("mae", "rmse", "worst")))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"""{WITH} SELECT seq, count(*) AS n, round(avg(100 - CAST(bottom AS DOUBLE)), 6) AS mean_z FROM ref WHERE doc % 5 > 0 GROUP BY seq""")
def interval_surface_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of each interval's bottom, of boreholes that have a collar."""
    r = reference_intervals(spark, d)
    holes = r.select("doc").distinct().select("doc", (F.col("doc") % 7).cast("double").alias("x"), (F.col("doc") % 9).cast("double").alias("y"), F.when(F.col("doc") % 5 > 0, 100.0).alias("collar"))
    return propagation.surface_points(r, holes).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))


@query(f"""WITH {QP}, p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS y, s_acctbal AS z FROM supplier), n AS (SELECT o.id AS out_id, q.qid, p.z, (qx - p.x) * (qx - p.x) + (qy - p.y) * (qy - p.y) AS d2 FROM p o, q, p WHERE p.id <> o.id),
s AS (SELECT out_id, qid, coalesce(avg(CASE WHEN d2 = 0 THEN z END), sum(CASE WHEN d2 > 0 THEN z / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END)) AS z FROM n GROUP BY ALL) SELECT out_id AS id, round(avg(z) * 9797.0, 1) AS volume FROM s GROUP BY 1""")
def volume_jackknife(spark: SparkSession, d: str) -> DataFrame:
    return propagation.jackknife(queries_points(spark, d), points(spark, d, "supplier"), 9797.0).select("id", F.round("volume", 1).alias("volume"))


@query("""WITH p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS y, s_acctbal AS z FROM supplier), c AS (SELECT id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM p)
SELECT id, round(x * cos(radians(17)) - y * sin(radians(17)), 6) AS x, round(x * sin(radians(17)) + y * cos(radians(17)), 6) AS y, round(z, 4) AS z FROM c""")
def public_points(spark: SparkSession, d: str) -> DataFrame:
    return propagation.centred(points(spark, d, "supplier")).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 4).alias("z"))
