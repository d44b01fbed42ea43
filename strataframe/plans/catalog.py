"""Named queries over the driver tables, each with its SQL oracle where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as T
from strataframe.operators import calibration, constraints, fusion, matching, metrics, spatial, splits, statistics
from strataframe.plans.fixtures import BASE_SQL, points, predicted_intervals, queries_points, reference_intervals, table
from strataframe.sources import records
from strataframe.streaming import review

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH {BASE_SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def channels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref = reference_intervals(spark, d)
    return ref, predicted_intervals(ref, 11, 7), predicted_intervals(ref, 17, 5)


BAND = "pairs AS (SELECT r.doc, r.seq AS r_seq, p.seq AS p_seq, abs(r.top - p.top) AS te, abs(r.bottom - p.bottom) AS be FROM ref r JOIN pa p ON r.doc = p.doc AND abs(r.top - p.top) <= {t} AND abs(r.bottom - p.bottom) <= {t})"


@query(f"""{WITH}, {BAND.format(t="0.03")}, n AS (SELECT (SELECT count(*) FROM pairs) AS tp, (SELECT count(*) FROM ref) AS refs, (SELECT count(*) FROM pa) AS preds)
SELECT tp, refs, preds, round(tp / preds, 9) AS "precision", round(tp / refs, 9) AS recall, round(2.0 * (tp / preds) * (tp / refs) / ((tp / preds) + (tp / refs)), 9) AS f1 FROM n""")
def match_prf1(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    m = matching.interval_metrics(ref, a, matching.match_intervals(ref, a, "0.03"))
    return m.select("tp", "refs", "preds", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH RECURSIVE {BASE_SQL}, {BAND.format(t="0.20")}, per AS (SELECT doc, list(struct_pack(r := r_seq, p := p_seq) ORDER BY r_seq, p_seq) AS c FROM pairs GROUP BY doc),
chain AS (SELECT doc, c, 1 AS i, [1] AS best FROM per UNION ALL SELECT doc, c, i + 1, list_append(best, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN c[j].r < c[i + 1].r AND c[j].p < c[i + 1].p THEN best[j] ELSE 0 END)), 0)) FROM chain WHERE i < len(c)),
n AS (SELECT CAST((SELECT sum(list_max(best)) FROM chain WHERE i = len(c)) AS BIGINT) AS tp, (SELECT count(*) FROM ref) AS refs, (SELECT count(*) FROM pa) AS preds)
SELECT tp, refs, preds, round(tp / preds, 9) AS "precision", round(tp / refs, 9) AS recall, round(2.0 * (tp / preds) * (tp / refs) / ((tp / preds) + (tp / refs)), 9) AS f1 FROM n""")
def match_wide_tolerance(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    m = matching.interval_metrics(ref, a, matching.match_intervals(ref, a, "0.20"))
    return m.select("tp", "refs", "preds", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""{WITH}, {BAND.format(t="0.03")} SELECT count(*) AS pairs, round(avg(CAST(te AS DOUBLE)), 6) AS top_mae, round(avg(CAST(be AS DOUBLE)), 6) AS bottom_mae FROM pairs""")
def match_boundary_mae(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    m = matching.match_intervals(ref, a, "0.03")
    return m.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("top_error").cast("double")), 6).alias("top_mae"), F.round(F.avg(F.col("bottom_error").cast("double")), 6).alias("bottom_mae"))


PAIRED = "paired AS (SELECT r.doc, r.seq, r.pk, r.sk, r.top AS rt, p.top AS pt, r.bottom AS rb, p.bottom AS pb FROM ref r LEFT JOIN pa p ON r.doc = p.doc AND r.seq = p.seq)"


def paired(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    p = a.select(F.col("doc").alias("p_doc"), F.col("seq").alias("p_seq"), F.col("top").alias("pt"), F.col("bottom").alias("pb"))
    return ref.select("doc", "seq", "pk", "sk", F.col("top").alias("rt"), F.col("bottom").alias("rb")).join(p, (F.col("doc") == F.col("p_doc")) & (F.col("seq") == F.col("p_seq")), "left")


def told(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "metric", F.round("numerator", 6).alias("numerator"), "denominator", F.round("value", 9).alias("value"))


def metric_sql(name: str, top: str, below: str, source: str = "paired") -> str:
    return f"SELECT '{name}' AS metric, round(CAST({top} AS DOUBLE), 6) AS numerator, CAST({below} AS BIGINT) AS denominator, round(CAST({top} AS DOUBLE) / nullif(CAST({below} AS DOUBLE), 0), 9) AS value FROM {source}"


@query(f"{WITH}, {PAIRED} " + " UNION ALL ".join(metric_sql(f"within_{t}", f"count(*) FILTER (WHERE abs(rt - pt) <= {t})", "count(pt)") for t in ("0.01", "0.05", "0.10")))
def boundary_accuracy_tolerances(spark: SparkSession, d: str) -> DataFrame:
    return told(metrics.evaluate(paired(spark, d), [metrics.boundary_accuracy(f"within_{t}", F.col("rt"), F.col("pt"), t) for t in ("0.01", "0.05", "0.10")]))


@query(f"{WITH}, {PAIRED} " + " UNION ALL ".join((
    metric_sql("exact_top", "count(*) FILTER (WHERE rt IS NOT DISTINCT FROM pt)", "count(*)"), metric_sql("top_mae", "sum(abs(rt - pt))", "count(pt)"), metric_sql("coverage", "count(pt)", "count(*)"),
    metric_sql("critical_bottom", "count(*) FILTER (WHERE pb IS NULL OR abs(rb - pb) > 0.04)", "count(rb)"))))
def field_metrics(spark: SparkSession, d: str) -> DataFrame:
    rt, pt = F.col("rt"), F.col("pt")
    return told(metrics.evaluate(paired(spark, d), [metrics.exact_match("exact_top", rt, pt), metrics.mean_absolute_error("top_mae", rt, pt), metrics.coverage("coverage", pt), metrics.critical_error_rate("critical_bottom", F.col("rb"), F.col("pb"), "0.04")]))


FINAL_SQL = "finals AS (SELECT o_orderkey AS doc, max(bottom) + CASE WHEN o_custkey % 5 = 0 THEN 0.2 ELSE 0 END AS final_depth FROM ref JOIN orders ON o_orderkey = ref.doc GROUP BY o_orderkey, o_custkey)"
CHECK_SQL = f"""{FINAL_SQL}, w AS (SELECT *, lead(top) OVER (PARTITION BY doc ORDER BY seq) AS nt, lead(bottom) OVER (PARTITION BY doc ORDER BY seq) AS nb, lead(seq) OVER (PARTITION BY doc ORDER BY seq) IS NULL AS is_last FROM pa),
x AS (SELECT w.*, final_depth FROM w LEFT JOIN finals USING (doc)),
checks AS (SELECT doc, 'C1_depth_order' AS "constraint", 1 AS e, CAST(bottom <= top AS INT) AS v FROM x
UNION ALL SELECT doc, 'C2_thickness', 1, CAST(abs(thickness - (bottom - top)) > 0.05 AS INT) FROM x
UNION ALL SELECT doc, 'C3_gap', CAST(nt IS NOT NULL AS INT), CAST(coalesce(nt - bottom > 0.05, false) AS INT) FROM x
UNION ALL SELECT doc, 'C3_overlap', CAST(nt IS NOT NULL AS INT), CAST(coalesce(nt - bottom < -0.05, false) AS INT) FROM x
UNION ALL SELECT doc, 'C4_monotone', CAST(nt IS NOT NULL AS INT), CAST(coalesce(nt + 0.05 < top OR nb + 0.05 < bottom, false) AS INT) FROM x
UNION ALL SELECT doc, 'C5_final_depth', CAST(is_last AS INT), CAST(is_last AND abs(final_depth - bottom) > 0.05 AS INT) FROM x),
counted AS (SELECT doc, "constraint", CAST(sum(e) AS BIGINT) AS evaluated, CAST(sum(v) AS BIGINT) AS violations FROM checks GROUP BY ALL)"""


def finals(spark: SparkSession, d: str, ref: DataFrame) -> DataFrame:
    last = ref.groupBy("doc").agg(F.max("bottom").alias("last"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    extra = F.when(F.col("o_custkey") % 5 == 0, F.lit("0.20").cast("decimal(12,2)")).otherwise(F.lit("0").cast("decimal(12,2)"))
    return last.join(orders, F.col("doc") == F.col("o_orderkey")).select("doc", (F.col("last") + extra).alias("final_depth"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    return constraints.violation_counts(a, finals(spark, d, ref))


@query(f"""{WITH}, {CHECK_SQL} SELECT doc, "constraint", evaluated, violations, round(CASE WHEN evaluated > 0 THEN greatest(0.0, 1 - violations / evaluated) END, 9) AS score,
CASE WHEN evaluated = 0 THEN 'not_evaluated' WHEN violations = 0 THEN 'passed' ELSE 'violated' END AS status FROM counted""")
def constraint_scores(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).withColumn("score", F.round("score", 9))


@query(f"""{WITH}, {CHECK_SQL} SELECT "constraint", CAST(sum(evaluated) AS BIGINT) AS evaluated, CAST(sum(violations) AS BIGINT) AS violations, round(1 - sum(violations) / nullif(CAST(sum(evaluated) AS DOUBLE), 0), 9) AS consistency,
count(DISTINCT CASE WHEN evaluated > 0 THEN doc END) AS documents FROM counted GROUP BY ROLLUP ("constraint")""")
def constraint_summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return constraints.consistency(counts(spark, d)).withColumn("consistency", F.round("consistency", 9))


@query(f"""{WITH}, {FINAL_SQL}, b AS (SELECT doc, final_depth, CAST(doc % 40 - 2 AS DECIMAL(12,2)) AS water FROM finals)
SELECT doc, CAST(2 AS BIGINT) AS evaluated, CAST(CAST(water < 0 AS INT) + CAST(water > final_depth AS INT) AS BIGINT) AS violations FROM b WHERE doc % 7 <> 0 UNION ALL SELECT doc, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM b WHERE doc % 7 = 0""")
def c6_water_depth(spark: SparkSession, d: str) -> DataFrame:
    f = finals(spark, d, reference_intervals(spark, d))
    return constraints.water_checks(f.withColumn("water_depth", F.when(F.col("doc") % 7 != 0, (F.col("doc") % 40 - 2).cast("decimal(12,2)"))))


@query("""SELECT 'l_discount' AS field, count(l_discount) AS evaluated, count(*) FILTER (WHERE l_discount * 100 < 1 OR l_discount * 100 > 8) AS violations FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), count(*) FILTER (WHERE l_tax * 100 < 1 OR l_tax * 100 > 8) FROM lineitem""")
def c7_percentages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 100).alias("l_discount"), (F.col("l_tax") * 100).alias("l_tax"))
    return constraints.range_checks(rows, ["l_discount", "l_tax"], 1, 8)


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN concat(c_custkey, 'O', c_custkey) ELSE CAST(c_custkey * 7919 AS VARCHAR) END AS raw FROM customer)
SELECT id, raw, regexp_matches(raw, '[0-9][OolIS]|[OolIS][0-9]') AS confusable, length(regexp_replace(raw, '[^0-9]', '', 'g')) NOT BETWEEN 4 AND 12 AS digit_count FROM r""")
def c8_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 9 == 0, F.concat(k.cast("string"), F.lit("O"), k.cast("string"))).otherwise((k * 7919).cast("string"))
    return constraints.coordinate_checks(table(spark, d, "customer").select(k.alias("id"), raw.alias("raw")), "raw")


@query(f"""{WITH}, c AS (SELECT doc, seq, CASE WHEN pk % 10 = 0 THEN NULL ELSE ln END AS n FROM ref), p AS (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY seq) AS nx FROM c WHERE n IS NOT NULL),
k AS (SELECT doc, count(nx) AS evaluated, count(*) FILTER (WHERE nx = n) AS repeats, count(*) FILTER (WHERE nx <> n AND nx <> n + 1) AS jumps FROM p GROUP BY doc)
SELECT doc, coalesce(evaluated, 0) AS evaluated, coalesce(repeats, 0) AS repeats, coalesce(jumps, 0) AS jumps, CASE WHEN coalesce(evaluated, 0) = 0 THEN 'not_evaluated' WHEN repeats + jumps = 0 THEN 'passed' ELSE 'violated' END AS status FROM (SELECT DISTINCT doc FROM ref) LEFT JOIN k USING (doc)""")
def c9_code_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Codes are digits or circled digits; a tenth of them are neither (``-5`` among them)."""
    ref = reference_intervals(spark, d)
    ln = F.col("ln").cast("int")
    code = F.when(F.col("pk") % 20 == 0, "x").when(F.col("pk") % 10 == 0, "-5").when(F.col("pk") % 3 == 0, F.substring(F.lit(constraints.CIRCLED), ln, F.lit(1))).otherwise(F.concat(F.lit(" "), ln.cast("string")))
    return constraints.code_sequence(ref.select("doc", "seq", code.alias("code")))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS t, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS n,
p_partkey % 8 = 0 AS text_is_number, p_partkey % 6 = 0 AS number_is_text FROM part""")
def c10_field_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), F.when(k % 8 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_type")).alias("t"), F.when(k % 6 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("n"))
    return constraints.type_checks(rows, "t", "n")


#: No letter of the reading is an e, so each e of the turn costs one edit, and one substitution does.
TURNS = "turns AS (SELECT lower(text) AS a, length(lower(text)) - length(replace(lower(text), 'e', '')) AS edits FROM conversations)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn, and a reading of it in which each e is a c."""
    t = F.lower("text")
    return table(spark, d, "conversations").select(t.alias("a"), F.replace(t, F.lit("e"), F.lit("c")).alias("b"))


@query(f"WITH {TURNS} " + " UNION ALL ".join((
    metric_sql("cer", "sum(edits)", "sum(length(a))", "turns"), metric_sql("numeric_cer", "sum(0 * edits)", "sum(length(regexp_replace(a, '[^0-9.+-]', '', 'g')))", "turns"),
    metric_sql("similarity", "sum(CASE WHEN length(a) = 0 THEN 1 ELSE 1 - edits / length(a) END)", "count(*)", "turns"))))
def text_error_rates(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return told(metrics.evaluate(turns(spark, d), [metrics.character_error_rate("cer", a, b), metrics.character_error_rate("numeric_cer", metrics.numeric_text(a), metrics.numeric_text(b)), metrics.edit_similarity("similarity", a, b)]))


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a FROM conversations),
n AS (SELECT len(list_filter(a, lambda x: contains(x, 'e'))) AS edits, len(a) AS words FROM w)
SELECT 'wer' AS metric, round(CAST(sum(edits) AS DOUBLE), 6) AS numerator, CAST(sum(words) AS BIGINT) AS denominator, round(CAST(sum(edits) AS DOUBLE) / sum(words), 9) AS value FROM n""")
def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).withColumn("b", F.replace("a", F.lit("e"), F.lit("~")))
    return told(metrics.evaluate(rows, [metrics.word_error_rate("wer", F.col("a"), F.col("b"))]))


@query("""WITH p AS (SELECT [p_brand, p_type] AS r, CASE WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 3 = 0 THEN [p_brand, 'other'] ELSE [p_brand, p_type] END AS q FROM part),
s AS (SELECT sum(len(list_intersect(r, q))) AS shared, sum(len(q)) AS predicted, sum(len(r)) AS referred, count(*) FILTER (WHERE r = q) AS exact, count(*) FILTER (WHERE len(q) > 0) AS covered, count(*) AS n FROM p)
SELECT CAST(shared AS BIGINT) AS shared, CAST(predicted AS BIGINT) AS predicted, CAST(referred AS BIGINT) AS referred, round(shared / predicted, 9) AS "precision", round(shared / referred, 9) AS recall,
round(2.0 * shared / (predicted + referred), 9) AS f1, round(exact / n, 9) AS exact_share, round(covered / n, 9) AS coverage FROM s""")
def hier_prf1(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    rows = table(spark, d, "part").select(F.array("p_brand", "p_type").alias("r"), F.when(k % 5 == 0, none).when(k % 3 == 0, F.array("p_brand", F.lit("other"))).otherwise(F.array("p_brand", "p_type")).alias("q"))
    m = metrics.hierarchical(rows, "r", "q")
    return m.select("shared", "predicted", "referred", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "exact_share", "coverage")))


TAXONOMY_SQL = "VALUES ('OCR_digit_error'), ('OCR_character_error'), ('decimal_point_error'), ('column_misalignment'), ('row_merge'), ('row_split'), ('interval_boundary_error'), ('missing_interval'), ('duplicate_interval'), ('lithology_semantic_error'), ('normalization_error'), ('hallucination'), ('layout_error'), ('constraint_false_positive'), ('constraint_false_negative'), ('re_read_failure')"


@query(f"""WITH e AS (SELECT CASE p_partkey % 8 WHEN 0 THEN 'interval_boundary_error' WHEN 1 THEN CASE WHEN lower(p_type) <> p_type THEN 'lithology_semantic_error' END WHEN 2 THEN 'normalization_error'
  WHEN 3 THEN CASE WHEN p_partkey % 16 = 3 THEN 'decimal_point_error' END WHEN 4 THEN 'OCR_digit_error' WHEN 5 THEN CASE WHEN p_partkey % 16 = 5 THEN 'OCR_character_error' END WHEN 6 THEN 'hallucination' ELSE CASE WHEN p_partkey % 16 = 7 THEN 'missing_interval' ELSE 'interval_boundary_error' END END AS l FROM part),
c AS (SELECT coalesce(l, 'UNCLASSIFIED') AS l, count(*) AS n FROM e GROUP BY 1), t(label) AS ({TAXONOMY_SQL})
SELECT coalesce(label, l) AS label, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST((SELECT sum(n) FROM c) AS DOUBLE), 9) AS rate, label IS NOT NULL AS known FROM t FULL JOIN c ON label = l""")
def error_taxonomy_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Errors of eight kinds of fields, by part; some are equal and some of no sure label."""
    k, size, text = F.col("p_partkey"), F.col("p_size").cast("string"), F.concat(F.col("p_partkey").cast("string"), F.lit(".25"))
    none = F.lit(None).cast("string")
    cases = [
        ("top_depth_m", size, F.concat(size, F.lit("1"))), ("lithology_raw", F.col("p_type"), F.lower("p_type")), ("lithology_normalized", F.col("p_type"), F.lit("other")),
        ("final_depth_m", text, F.when(k % 16 == 3, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)), ("final_depth_m", text, F.concat(F.lit("9"), text)),
        ("project_name", F.col("p_name"), F.when(k % 16 == 5, F.concat("p_name", F.lit("x")))), ("project_name", none, F.col("p_brand")), (None, F.lit("3"), F.when(k % 16 == 7, none).otherwise("2")),
    ]
    pick = lambda i: F.coalesce(*(F.when(k % 8 == n, F.lit(c[i]) if i == 0 else c[i]) for n, c in enumerate(cases)), F.lit(None).cast("string"))
    field = F.when(k % 8 == 7, F.when(k % 16 == 7, "intervals").otherwise("thickness_m")).otherwise(pick(0))
    rows = table(spark, d, "part").select(metrics.error_label(field, pick(1), pick(2)).alias("label"))
    return metrics.error_distribution(rows).withColumn("rate", F.round("rate", 9))


CASES = "cases AS (SELECT event_id, value - floor(value) AS p, CAST(event_type IN ('click', 'purchase') AS INT) AS y FROM events)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("value") - F.floor("value")).alias("p"), F.col("event_type").isin("click", "purchase").cast("int").alias("y"))


@query(f"""WITH {CASES}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS c, avg(CAST(y AS DOUBLE)) AS a FROM cases GROUP BY 1)
SELECT (SELECT round(sum(n * abs(a - c)) / sum(n), 9) FROM b) AS ece, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))), 6) AS nll FROM cases""")
def calibration_measures(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d)
    one = rows.agg(F.round(calibration.brier(F.col("p"), F.col("y")), 9).alias("brier"), F.round(calibration.log_loss(F.col("p"), F.col("y"), 1e-12), 6).alias("nll"))
    return calibration.expected_calibration_error(rows, "p", "y").withColumn("ece", F.round("ece", 9)).join(one)


@query(f"WITH {CASES} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 9) AS confidence, round(avg(CAST(y AS DOUBLE)), 9) AS accuracy FROM cases GROUP BY 1")
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return calibration.reliability(cases(spark, d), "p", "y").select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {CASES}, o AS (SELECT ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS o, y FROM cases), t AS (SELECT 0.05 + k * 0.05 AS temperature FROM range(200) r(k)),
l AS (SELECT temperature, avg(ln(1 + exp(-(CASE WHEN y = 1 THEN o ELSE -o END) / temperature))) AS loss FROM o, t GROUP BY 1) SELECT round(temperature, 6) AS temperature, round(loss, 6) AS loss FROM l ORDER BY l.loss, l.temperature LIMIT 1""")
def temperature_fit(spark: SparkSession, d: str) -> DataFrame:
    return calibration.fit_temperature(cases(spark, d), "p", "y").select(F.round("temperature", 6).alias("temperature"), F.round("loss", 6).alias("loss"))


@query(f"WITH {CASES}, t AS (SELECT k / 10 AS threshold FROM range(11) r(k)) SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS accepted, count(*) FILTER (WHERE p >= threshold AND y = 1) AS correct, round(count(*) FILTER (WHERE p >= threshold) / count(*), 9) AS coverage, round(count(*) FILTER (WHERE p >= threshold AND y = 1) / nullif(count(*) FILTER (WHERE p >= threshold), 0), 9) AS accuracy FROM cases, t GROUP BY threshold")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    c = calibration.threshold_curve(cases(spark, d), "p", "y", [k / 10 for k in range(11)])
    return c.select("threshold", "accepted", "correct", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {CASES}, g AS (SELECT p AS threshold, count(*) AS n, sum(y) AS k FROM cases GROUP BY 1),
s AS (SELECT threshold, CAST(sum(n) OVER (ORDER BY threshold DESC) AS BIGINT) AS accepted, CAST(sum(k) OVER (ORDER BY threshold DESC) AS BIGINT) AS correct FROM g)
SELECT threshold, accepted, correct, round(correct / accepted, 9) AS accuracy FROM s WHERE correct / accepted >= 0.4 ORDER BY accepted DESC, correct / accepted DESC, threshold DESC LIMIT 1""")
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    return calibration.select_threshold(cases(spark, d), "p", "y", 0.4).withColumn("accuracy", F.round("accuracy", 9))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value - floor(value) END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 100) / 100 END AS b, CASE WHEN event_id % 7 = 0 THEN 1.0 END AS c FROM events)
SELECT event_id, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 0), 6) AS confidence FROM c""")
def fuse_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(k % 3 != 0, F.col("value") - F.floor("value")).alias("a"), F.when(k % 5 != 0, (k % 100) / 100).alias("b"), F.when(k % 7 == 0, 1.0).alias("c"))
    return rows.select("event_id", F.round(calibration.fuse_confidence({"a": 0.5, "b": 0.3, "c": 0.2}), 6).alias("confidence"))


@query(f"""WITH {CASES}, f AS (SELECT y = 1 AS bad, p < 0.7 AS flagged FROM cases), n AS (SELECT count(*) FILTER (WHERE bad AND flagged) AS tp, count(*) FILTER (WHERE NOT bad AND flagged) AS fp, count(*) FILTER (WHERE bad AND NOT flagged) AS fn, count(*) FILTER (WHERE NOT bad AND NOT flagged) AS tn FROM f)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(fn / (fn + tn), 9) AS missed FROM n""")
def review_detection(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.binary_rates(cases(spark, d), F.col("y") == 1, F.col("p") < 0.7)
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "missed")))


READ = """r3 AS (SELECT r.doc, r.seq, a.bottom AS a, b.bottom AS b, CASE WHEN r.pk % 19 <> 0 THEN r.bottom END AS c FROM ref r LEFT JOIN pa a ON r.doc = a.doc AND r.seq = a.seq LEFT JOIN pb b ON r.doc = b.doc AND r.seq = b.seq)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    ref, a, b = channels(spark, d)
    c = ref.where(F.col("pk") % 19 != 0)
    return fusion.join_readings(["doc", "seq"], ref.select("doc", "seq"), *(x.select("doc", "seq", F.col("bottom").alias(n)) for x, n in ((a, "a"), (b, "b"), (c, "c"))))


@query(f"{WITH}, {READ} SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_abstained' WHEN b IS NULL THEN 'grounded_only' WHEN a IS NULL THEN 'visual_only' WHEN a = b THEN 'agreement' ELSE 'disagreement' END AS decision, count(*) AS n FROM r3 GROUP BY 1")
def fusion_decisions(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy(fusion.fuse(F.col("a"), F.col("b")).alias("decision")).agg(F.count("*").alias("n"))


STATUS = "CASE WHEN a IS NULL AND b IS NULL THEN 'MISSING' WHEN a = b THEN 'AGREEMENT' WHEN a IS NOT NULL AND b IS NOT NULL AND a = c THEN 'CORROBORATED_A' WHEN a IS NOT NULL AND b IS NOT NULL AND b = c THEN 'CORROBORATED_B' WHEN a IS NULL THEN 'SINGLE_SOURCE_B' WHEN b IS NULL THEN 'SINGLE_SOURCE_A' ELSE 'DISAGREEMENT_UNRESOLVED' END"


@query(f"{WITH}, {READ} SELECT {STATUS} AS status, count(*) AS n FROM r3 GROUP BY 1")
def adjudication_status(spark: SparkSession, d: str) -> DataFrame:
    s = fusion.adjudicate(F.col("a"), F.col("b"), F.col("c"))
    return readings(spark, d).groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query(f"""{WITH}, {READ}, s AS (SELECT doc, {STATUS} AS st FROM r3), f AS (SELECT doc, st, CASE st WHEN 'AGREEMENT' THEN 0.98 WHEN 'CORROBORATED_A' THEN 0.9 WHEN 'CORROBORATED_B' THEN 0.9 WHEN 'SINGLE_SOURCE_B' THEN 0.65 WHEN 'SINGLE_SOURCE_A' THEN 0.65 WHEN 'DISAGREEMENT_UNRESOLVED' THEN 0.2 END AS cf FROM s)
SELECT doc, round(avg(CASE WHEN st = 'AGREEMENT' THEN 1.0 ELSE 0.0 END), 9) AS agreement, CAST(min(cf) AS DOUBLE) AS confidence, bool_or(st = 'DISAGREEMENT_UNRESOLVED') AS hard FROM f GROUP BY doc""")
def adjudication_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = readings(spark, d).select("doc", fusion.adjudicate(F.col("a"), F.col("b"), F.col("c")).alias("st"))
    return s.groupBy("doc").agg(F.round(F.avg((F.col("st") == "AGREEMENT").cast("double")), 9).alias("agreement"), F.min(fusion.status_confidence(F.col("st"))).alias("confidence"), F.bool_or(F.col("st") == "DISAGREEMENT_UNRESOLVED").alias("hard"))


@query("""WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS place, concat('s', o_orderkey % 3) AS source, CAST(o_orderkey % 4 AS VARCHAR) AS value, (o_orderkey % 10) / 10 AS evidence, o_orderkey % 3 - 1 AS change FROM orders),
s AS (SELECT case_id, count(DISTINCT source) AS sources FROM c GROUP BY 1), b AS (SELECT case_id, value, count(DISTINCT source) AS backers FROM c GROUP BY 1, 2),
x AS (SELECT c.*, round(evidence * 0.45 + backers / sources * 0.20 + CASE WHEN change < 0 THEN 1.0 WHEN change = 0 THEN 0.5 ELSE 0.0 END * 0.35, 9) AS score FROM c JOIN s USING (case_id) JOIN b USING (case_id, value))
SELECT case_id, place, source, value, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, place) AS INT) AS "rank" FROM x""")
def reread_rank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rank_candidates(candidates(spark, d)).select("case_id", "place", "source", "value", F.round("score", 6).alias("score"), "rank")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("place"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (k % 4).cast("string").alias("value"), ((k % 10) / 10).alias("evidence"), (k % 3 - 1).alias("violation_change"))


@query("""WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS place, concat('s', o_orderkey % 3) AS source, CAST(o_orderkey % 4 AS VARCHAR) AS value, (o_orderkey % 10) / 10 AS evidence, o_orderkey % 3 - 1 AS change FROM orders),
s AS (SELECT case_id, count(DISTINCT source) AS sources FROM c GROUP BY 1), b AS (SELECT case_id, value, count(DISTINCT source) AS backers FROM c GROUP BY 1, 2),
x AS (SELECT c.*, round(evidence * 0.45 + backers / sources * 0.20 + CASE WHEN change < 0 THEN 1.0 WHEN change = 0 THEN 0.5 ELSE 0.0 END * 0.35, 9) AS score FROM c JOIN s USING (case_id) JOIN b USING (case_id, value)),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, place) AS rk FROM x), best AS (SELECT case_id, value, score, change FROM k WHERE rk = 1),
m AS (SELECT case_id, max(v) AS most FROM (SELECT case_id, source, count(DISTINCT value) AS v FROM c GROUP BY 1, 2) GROUP BY 1), o AS (SELECT k.case_id, max(k.score) AS other FROM k JOIN best ON k.case_id = best.case_id AND k.value <> best.value GROUP BY 1)
SELECT case_id, value AS best_value, round(score, 6) AS best_score, CASE WHEN most > 1 THEN 'CONFLICTING_SOURCE' WHEN change >= 0 THEN 'NO_VIOLATION_REDUCTION' WHEN score < 0.75 THEN 'LOW_SCORE' WHEN round(coalesce(score - other, 1.0), 9) < 0.1 THEN 'LOW_MARGIN' ELSE 'ACCEPT' END AS decision
FROM best JOIN m USING (case_id) LEFT JOIN o USING (case_id)""")
def reread_decision(spark: SparkSession, d: str) -> DataFrame:
    return fusion.decide_reread(fusion.rank_candidates(candidates(spark, d))).withColumn("best_score", F.round("best_score", 6))


@query("""WITH f AS (SELECT o_orderkey AS doc, 'priority' AS field, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS value, (o_orderkey % 100) / 100 AS confidence, true AS required FROM orders
UNION ALL SELECT o_orderkey, 'status', CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END, (o_custkey % 100) / 100, false FROM orders),
r AS (SELECT doc, CASE WHEN value IS NULL AND required THEN 'missing:' || field WHEN value IS NOT NULL AND confidence < 0.7 THEN 'low_confidence:' || field END AS reason FROM f UNION ALL SELECT o_orderkey, 'constraint:C5' FROM orders WHERE o_custkey % 5 = 0),
g AS (SELECT doc, list_sort(list(DISTINCT reason)) AS reasons FROM r WHERE reason IS NOT NULL GROUP BY doc)
SELECT doc, array_to_string(reasons, ';') AS reasons, CASE WHEN len(list_filter(reasons, lambda x: starts_with(x, 'missing:'))) > 0 OR len(reasons) >= 3 THEN 'high' WHEN len(list_filter(reasons, lambda x: starts_with(x, 'constraint:'))) > 0 THEN 'medium' ELSE 'low' END AS priority FROM g""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    one = o.select(k.alias("doc"), F.lit("priority").alias("field"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("value"), ((k % 100) / 100).alias("confidence"), F.lit(True).alias("required"))
    two = o.select(k.alias("doc"), F.lit("status").alias("field"), F.when(k % 13 != 0, F.col("o_orderstatus")).alias("value"), ((F.col("o_custkey") % 100) / 100).alias("confidence"), F.lit(False).alias("required"))
    return fusion.review_queue(one.unionByName(two), o.where("o_custkey % 5 = 0").select(k.alias("doc"), F.lit("C5").alias("code")))


QP = "q AS (SELECT CAST(n_nationkey AS BIGINT) AS qid, CAST((n_nationkey * 17) % 101 AS DOUBLE) AS qx, CAST((n_nationkey * 29) % 97 AS DOUBLE) AS qy FROM nation)"
PTS = "p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS y, s_acctbal AS z FROM supplier)"
IDW = "SELECT qid, coalesce(avg(CASE WHEN d2 = 0 THEN z END), sum(CASE WHEN d2 > 0 THEN z / d2 END) / sum(CASE WHEN d2 > 0 THEN 1 / d2 END)) AS z FROM (SELECT qid, z, (qx - x) * (qx - x) + (qy - y) * (qy - y) AS d2 FROM {q}, {p}) GROUP BY qid"


@query(f"WITH {QP}, {PTS}, s AS ({IDW.format(q='q', p='p')}) SELECT qid, round(z, 4) AS z FROM s")
def idw_surface(spark: SparkSession, d: str) -> DataFrame:
    return spatial.idw(queries_points(spark, d), points(spark, d, "supplier")).select("qid", F.round("z", 4).alias("z"))


@query(f"""WITH {QP}, {PTS}, n AS (SELECT qid, id, z, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)), id) AS k FROM q, p)
SELECT qid, round(coalesce(arg_min(CASE WHEN d <= 1e-6 THEN z END, CASE WHEN d <= 1e-6 THEN k END), sum(CASE WHEN d > 1e-6 THEN z / (d * d) END) / sum(CASE WHEN d > 1e-6 THEN 1 / (d * d) END)), 4) AS z FROM n WHERE k <= 4 GROUP BY qid""")
def idw_knn(spark: SparkSession, d: str) -> DataFrame:
    return spatial.idw_nearest(queries_points(spark, d), points(spark, d, "supplier"), 4).select("qid", F.round("z", 4).alias("z"))


@query(f"""WITH {PTS}, g AS (SELECT a.id, a.z AS qz, coalesce(avg(CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) = 0 THEN b.z END), sum(CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 0 THEN b.z / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END) / sum(CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 0 THEN 1 / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) END)) AS guess FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.z)
SELECT count(*) AS n, round(avg(abs(guess - qz)), 4) AS mae, round(sqrt(avg((guess - qz) * (guess - qz))), 4) AS rmse, round(max(abs(guess - qz)), 4) AS worst FROM g""")
def loocv(spark: SparkSession, d: str) -> DataFrame:
    return spatial.leave_one_out(points(spark, d, "supplier")).select("n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "worst")))


@query(f"""WITH {PTS}, u AS (SELECT DISTINCT x, y FROM p), n AS (SELECT a.x AS qx, a.y AS qy, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM u a JOIN u b ON a.x <> b.x OR a.y <> b.y GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(dist), 6) AS mean_distance, round(avg(dist) / (0.5 / sqrt(count(*) / 9797.0)), 6) AS ratio FROM n""")
def clark_evans(spark: SparkSession, d: str) -> DataFrame:
    return spatial.clark_evans(points(spark, d, "supplier"), 9797.0).select("n", F.round("mean_distance", 6).alias("mean_distance"), F.round("ratio", 6).alias("ratio"))


@query(f"WITH {PTS}, u AS (SELECT DISTINCT x, y FROM p) SELECT a.x AS qx, a.y AS qy, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS distance FROM u a JOIN u b ON a.x <> b.x OR a.y <> b.y GROUP BY 1, 2")
def nn_distance(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_distances(points(spark, d, "supplier")).withColumn("distance", F.round("distance", 6))


#: Ordered pairs of places that are sides of the hull: all others lie to the left, those on the line between them.
HULL = f"""{PTS}, u AS (SELECT DISTINCT x, y FROM p), sides AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM u a JOIN u b ON a.x <> b.x OR a.y <> b.y WHERE NOT EXISTS (SELECT 1 FROM u c
  WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y)) > 0)))"""


@query(f"WITH {HULL} SELECT sum(ax * b_y - bx * ay) / 2 AS area FROM sides")
def hull_area(spark: SparkSession, d: str) -> DataFrame:
    return spatial.hull_area(spatial.convex_hull(points(spark, d, "supplier")))


@query(f"""WITH {HULL}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), g AS (SELECT CAST(j * 20 + i AS BIGINT) AS qid, x0 + (x1 - x0) * i / 19 AS qx, y0 + (y1 - y0) * j / 19 AS qy FROM box, range(20) a(i), range(20) b(j))
SELECT qid, qx, qy FROM g WHERE NOT EXISTS (SELECT 1 FROM sides WHERE (bx - ax) * (qy - ay) - (b_y - ay) * (qx - ax) < -1e-9)""")
def grid_in_hull(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d, "supplier")
    return spatial.inside_hull(spatial.grid(p, 20), spatial.convex_hull(p))


@query(f"""WITH {QP}, {PTS}, b AS (SELECT id, x, y, z - 100 - id % 50 AS z FROM p), s AS ({IDW.format(q='q', p='p')}), t AS ({IDW.format(q='q', p='b')}), l AS (SELECT s.z - t.z AS t FROM s JOIN t USING (qid))
SELECT count(*) AS n, round(avg(t), 4) AS mean_thickness, round(avg(t) * 9797.0, 2) AS volume, round(avg(CASE WHEN t < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative FROM l""")
def layer_volume(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d, "supplier")
    s = spatial.layer_summary(queries_points(spark, d), p, p.withColumn("z", F.col("z") - 100 - F.col("id") % 50), 9797.0)
    return s.select("n", F.round("mean_thickness", 4).alias("mean_thickness"), F.round("volume", 2).alias("volume"), F.round("negative", 6).alias("negative"))


@query(f"""WITH {QP}, {PTS}, b AS (SELECT id, x, y, z + id % 5 - 2 AS z FROM p), s AS ({IDW.format(q='q', p='p')}), t AS ({IDW.format(q='q', p='b')}), l AS (SELECT t.z - s.z AS e FROM s JOIN t USING (qid))
SELECT count(*) AS n, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(max(abs(e)), 5) AS worst FROM l""")
def surface_error(spark: SparkSession, d: str) -> DataFrame:
    p, q = points(spark, d, "supplier"), queries_points(spark, d)
    a, b = spatial.idw(q, p), spatial.idw(q, p.withColumn("z", F.col("z") + F.col("id") % 5 - 2)).withColumnsRenamed({"qid": "b", "z": "bz"})
    s = spatial.error_summary(a.join(b, F.col("qid") == F.col("b")).select((F.col("bz") - F.col("z")).alias("e")), "e")
    return s.select("n", *(F.round(c, 5).alias(c) for c in ("mae", "rmse", "worst")))


PERDOC = "per AS (SELECT r.doc, count(p.doc) FILTER (WHERE abs(r.top - p.top) <= 0.03 AND abs(r.bottom - p.bottom) <= 0.03) AS matched, count(p.doc) AS predicted, count(*) AS referred FROM ref r LEFT JOIN pa p ON r.doc = p.doc AND r.seq = p.seq GROUP BY r.doc)"


def per_document(spark: SparkSession, d: str) -> DataFrame:
    near = (F.abs(F.col("rt") - F.col("pt")) <= F.lit("0.03").cast("decimal(4,2)")) & (F.abs(F.col("rb") - F.col("pb")) <= F.lit("0.03").cast("decimal(4,2)"))
    return paired(spark, d).groupBy("doc").agg(F.count_if(near).alias("matched"), F.count("pt").alias("predicted"), F.count("*").alias("referred"))


#: Resampled documents: how often a document is drawn in a repetition.
REPETITIONS = 2000
WEIGHTS = (
    f"s0 AS (SELECT *, CAST(doc % 4294967296 AS BIGINT) AS h0 FROM per), s1 AS (SELECT *, xor(h0 >> 16, h0) * 73244475 % 4294967296 AS h1 FROM s0), s2 AS (SELECT *, xor(h1 >> 16, h1) * 73244475 % 4294967296 AS h2 FROM s1),"
    f"s3 AS (SELECT *, xor(h2 >> 16, h2) AS h3 FROM s2), k0 AS (SELECT s3.*, rep, (h3 + rep * 2654435761) % 4294967296 AS g0 FROM s3, range({REPETITIONS}) r(rep)), k1 AS (SELECT *, xor(g0 >> 16, g0) * 73244475 % 4294967296 AS g1 FROM k0),"
    f"k2 AS (SELECT *, xor(g1 >> 16, g1) * 73244475 % 4294967296 AS g2 FROM k1), k3 AS (SELECT *, xor(g2 >> 16, g2) AS u FROM k2),"
    f"drawn AS (SELECT *, {' + '.join(f'CAST(u > {c * 4294967296.0!r}::DOUBLE AS INT)' for c in statistics.COPIES)} AS w FROM k3)"
)


@query(f"""{WITH}, {PERDOC}, {WEIGHTS}, t AS (SELECT rep, sum(matched * w) AS m, sum(predicted * w) AS p, sum(referred * w) AS r FROM drawn GROUP BY rep),
f AS (SELECT coalesce(2 * m / nullif(CAST(p + r AS DOUBLE), 0), 0) AS f1 FROM t) SELECT count(*) AS repetitions, round(avg(f1), 6) AS mean_f1, round(quantile_cont(f1, 0.025), 6) AS low_f1, round(quantile_cont(f1, 0.975), 6) AS high_f1 FROM f""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    b = statistics.bootstrap_f1(per_document(spark, d), REPETITIONS)
    return b.select("repetitions", *(F.round(c, 6).alias(c) for c in ("mean_f1", "low_f1", "high_f1")))


@query(f"{WITH}, {PERDOC} SELECT CASE WHEN referred <= 2 THEN 'few' WHEN referred <= 5 THEN 'some' ELSE 'many' END AS stratum, round(coalesce(sum(matched) / nullif(CAST(sum(predicted) AS DOUBLE), 0), 0), 9) AS \"precision\", round(coalesce(sum(matched) / nullif(CAST(sum(referred) AS DOUBLE), 0), 0), 9) AS recall, round(coalesce(2 * sum(matched) / nullif(CAST(sum(predicted) + sum(referred) AS DOUBLE), 0), 0), 9) AS f1 FROM per GROUP BY 1")
def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    sums = per_document(spark, d).groupBy(statistics.stratum(F.col("referred")).alias("stratum")).agg(*(F.sum(c).alias(c) for c in ("matched", "predicted", "referred")))
    scores = sums.select("stratum", *statistics.prf(F.col("matched"), F.col("predicted"), F.col("referred")))
    return scores.select("stratum", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"{WITH}, {PERDOC}, x AS (SELECT matched / CAST(referred AS DOUBLE) AS recall FROM per) SELECT count(*) AS n, round(avg(recall), 9) AS mean, round(quantile_cont(recall, 0.5), 9) AS median, round(quantile_cont(recall, 0.9), 9) AS p90, round(min(recall), 9) AS least, round(max(recall), 9) AS most FROM x")
def document_recall_profile(spark: SparkSession, d: str) -> DataFrame:
    p = statistics.profile(per_document(spark, d).select((F.col("matched") / F.col("referred")).alias("recall")), "recall")
    return p.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "median", "p90", "least", "most")))


@query("SELECT o_custkey AS customer, count(*) AS n, round(1 - pow(0.05, 1.0 / count(*)), 9) AS bound FROM orders GROUP BY 1")
def zero_event_bound(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n")).withColumn("bound", F.round(statistics.zero_event_bound(F.col("n")), 9))


@query("SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS deviation, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 5) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 5) AS high FROM events GROUP BY 1")
def repeated_summary(spark: SparkSession, d: str) -> DataFrame:
    r = statistics.repeated_summary(table(spark, d, "events"), "value", ("event_type",))
    return r.select("event_type", "n", *(F.round(c, 5).alias(c) for c in ("mean", "deviation", "low", "high")))


@query(f"""{WITH}, {PAIRED}, e AS (SELECT CAST(abs(rt - pt) AS DOUBLE) AS x, CAST(abs(rb - pb) AS DOUBLE) AS y FROM paired WHERE pt IS NOT NULL), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE x > y) AS better, count(*) FILTER (WHERE x < y) AS worse, count(*) FILTER (WHERE x = y) AS ties,
avg(x - y) AS mean, 1.96 * stddev_samp(x - y) / sqrt(count(*)) AS half, sum(x - y) / nullif(sum(x), 0) AS relative FROM e),
tail AS (SELECT least(1.0, 2 * sum(exp(lgamma(better + worse + 1) - lgamma(k + 1) - lgamma(better + worse - k + 1) - (better + worse) * ln(2)))) AS p FROM s, LATERAL (SELECT unnest(range(0, least(better, worse) + 1)) AS k))
SELECT n, better, worse, ties, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, round(relative, 6) AS relative, round(p, 6) AS p_value FROM s, tail""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Is the error of the bottoms smaller than that of the tops?"""
    rows = paired(spark, d).select(F.abs(F.col("rt") - F.col("pt")).alias("x"), F.abs(F.col("rb") - F.col("pb")).alias("y"))
    return statistics.paired_improvement(rows, "x", "y").select("n", "better", "worse", "ties", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "relative", "p_value")))


@query(f"""{WITH}, e AS (SELECT doc, array_agg(struct_pack(t := CAST(top AS DOUBLE), b := CAST(bottom AS DOUBLE)) ORDER BY seq) AS i FROM ref GROUP BY doc)
SELECT doc, len(i) AS n, CASE WHEN len(i) > 1 THEN len(i) - 1 ELSE len(i) END AS after_missing, CASE WHEN len(i) > 1 THEN i[2].t END AS missing_top, len(i) + 1 AS after_split, round((i[1].t + i[1].b) / 2, 4) AS split_at, CASE WHEN len(i) > 1 THEN i[2].b ELSE i[1].b END AS merged_bottom FROM e""")
def inject_errors(spark: SparkSession, d: str) -> DataFrame:
    """First interval missing, split in the middle, or merged with the second."""
    i = F.array_sort(F.collect_list(F.struct("seq", F.col("top").cast("double").alias("t"), F.col("bottom").cast("double").alias("b"))))
    e = reference_intervals(spark, d).groupBy("doc").agg(i.alias("i"))
    n, first, second = F.size("i").cast("long"), F.get("i", F.lit(0)), F.get("i", F.lit(1))
    return e.select("doc", n.alias("n"), F.when(n > 1, n - 1).otherwise(n).alias("after_missing"), second["t"].alias("missing_top"), (n + 1).alias("after_split"), F.round((first["t"] + first["b"]) / 2, 4).alias("split_at"), F.coalesce(second["b"], first["b"]).alias("merged_bottom"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)', 1) AS a, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)', 2) AS b FROM documents),
u AS (SELECT doc_id, unnest(a)::DOUBLE AS lo, unnest(b)::DOUBLE AS hi FROM m) SELECT doc_id, count(*) AS n, min(lo) AS low, max(hi) AS high FROM u WHERE lo < hi AND hi - lo <= 1000 GROUP BY 1""")
def regex_number_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.explode(T.ranges(F.col("text"))).alias("r"))
    return r.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("r.low").alias("low"), F.max("r.high").alias("high"))


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(p_type), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS lithology FROM part")
def normalize_lithology(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.normalize_name(F.col("p_type")).alias("lithology"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\+?[0-9][0-9 ()-]{8,}[0-9]')) AS phones FROM documents""")
def pii_screen(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", T.personal_data(F.col("text")).alias("p"))
    return p.select("doc_id", F.col("p.emails").cast("long").alias("emails"), F.col("p.phones").cast("long").alias("phones"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_coerce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.json_number(F.col("props"), "$.k").alias("k"))


@query(f"{WITH} SELECT CAST(doc AS VARCHAR) AS document_id, CAST(seq AS INT) AS sequence_index, CAST(CAST(top AS DECIMAL(12,2)) AS VARCHAR) AS top_depth_m, CAST(CAST(bottom AS DECIMAL(12,2)) AS VARCHAR) AS bottom_depth_m, CAST(pk AS VARCHAR) AS lithology FROM ref")
def tabular_intervals(spark: SparkSession, d: str) -> DataFrame:
    ref = reference_intervals(spark, d).withColumn("lithology", F.col("pk").cast("string"))
    return records.interval_rows(records.nest(ref))


@query(f"{WITH}, n AS (SELECT doc, count(*) AS k FROM ref GROUP BY doc) SELECT CAST(doc AS VARCHAR) AS document_id, 1 + 3 * k AS envelopes FROM n")
def tabular_provenance(spark: SparkSession, d: str) -> DataFrame:
    ref = reference_intervals(spark, d).withColumn("lithology", F.col("pk").cast("string"))
    return records.provenance_rows(records.nest(ref)).groupBy("document_id").agg(F.count("*").alias("envelopes"))


@query(f"""WITH {PTS} SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}},"properties":{{"id":' || id || '}}}}' AS feature FROM p""")
def geojson_points(spark: SparkSession, d: str) -> DataFrame:
    return records.geojson(points(spark, d, "supplier"), "id", "x", "y")


HASH = "('0x' || substr(sha256('{salt}' || CAST({c} AS VARCHAR)), 1, 8))::BIGINT"


@query(f"SELECT c_custkey, CAST({HASH.format(salt='s', c='c_custkey')} % 5 AS INT) AS fold FROM customer")
def hash_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", splits.fold(F.col("c_custkey"), 5, "s").alias("fold"))


SPLIT = f"SELECT o_orderkey, o_custkey, CASE WHEN {HASH.format(salt='v1', c='o_custkey')} / 4294967296.0 < 0.7 THEN 'train' WHEN {HASH.format(salt='v1', c='o_custkey')} / 4294967296.0 < 0.85 THEN 'validation' ELSE 'test' END AS split FROM orders"


@query(f"""WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {HASH.format(salt='v1', c='o_custkey')}, o_custkey) AS place FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total FROM g),
deal AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS split, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c
UNION ALL SELECT g.place, g.k, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'validation' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END
FROM (SELECT d.*, list_sort([(a - total * 0.7, a, 1, 'train'), (b - total * 0.15, b, 2, 'validation'), (c - total * 0.15, c, 3, 'test')])[1][4] AS s FROM deal d, t) d JOIN g ON g.place = d.place + 1)
SELECT o_orderkey, o_custkey, split FROM orders JOIN deal ON o_custkey = k""")
def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.balanced_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.7, "validation": 0.15, "test": 0.15}, "v1")


@query(SPLIT)
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.7, "validation": 0.15, "test": 0.15}, "v1")


@query(f"SELECT o_custkey, count(DISTINCT split) AS splits FROM ({SPLIT}) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_guard(spark: SparkSession, d: str) -> DataFrame:
    return splits.leaks(group_split(spark, d), "o_custkey")


@query("SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS turn FROM supplier")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    return splits.round_robin(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def cohort_exclusion(spark: SparkSession, d: str) -> DataFrame:
    earlier = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return splits.exclude(table(spark, d, "orders").select("o_orderkey", "o_custkey"), earlier, "o_custkey")


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_type":"' || p_type || '"}') AS record_hash FROM part""")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", splits.record_hash(["p_type", "p_partkey", "p_brand"]).alias("record_hash"))


@query(f"{WITH}, g AS (SELECT doc, sha256(string_agg(CAST(CAST(thickness AS DECIMAL(12,2)) AS VARCHAR), ',' ORDER BY seq)) AS signature FROM ref GROUP BY doc) SELECT signature, count(*) AS documents FROM g GROUP BY 1 HAVING count(*) > 1")
def linkage_signature(spark: SparkSession, d: str) -> DataFrame:
    t = F.transform(F.array_sort(F.collect_list(F.struct("seq", "thickness"))), lambda x: x["thickness"].cast("string"))
    g = reference_intervals(spark, d).groupBy("doc").agg(F.sha2(F.array_join(t, ",").cast("binary"), 256).alias("signature"))
    return g.groupBy("signature").agg(F.count("*").alias("documents")).where("documents > 1")


@query("SELECT event_type, count(*) AS n, count(*) - count(value) AS missing, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1")
def profile_ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(f"{WITH}, s AS (SELECT CAST(round((lead(top) OVER (PARTITION BY doc ORDER BY seq) - top) * 10) AS BIGINT) AS step FROM ref) SELECT step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1")
def depth_step_hist(spark: SparkSession, d: str) -> DataFrame:
    s = constraints.with_neighbours(reference_intervals(spark, d)).select(F.round((F.col("next_top") - F.col("top")) * 10).cast("long").alias("step"))
    return s.where("step is not null").groupBy("step").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS was, lag(ts) OVER w AS since FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN was = 'view' THEN round((epoch_us(ts) - epoch_us(since)) / 1e6, 3) END AS seconds, CASE WHEN was = 'view' THEN 'completed' ELSE 'unknown' END AS status FROM e WHERE event_type = 'purchase'""")
def review_sessions(spark: SparkSession, d: str) -> DataFrame:
    return review.sessions(table(spark, d, "events"), "user_id", "view", "purchase")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return review.windowed_counts(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))
