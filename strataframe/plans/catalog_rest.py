"""Remaining named queries: schema rules, text evidence, policies, resampling, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as T
from strataframe.operators import metrics, readiness, spatial, splits, statistics
from strataframe.plans.catalog import CASES, HASH, IDW, PERDOC, PTS, QP, REPETITIONS, WEIGHTS, WITH, cases, channels, paired, per_document, query
from strataframe.plans.fixtures import points, queries_points, reference_intervals, table


@query("""WITH v AS (SELECT o_orderkey AS id, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enum:status' END, CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN 'range:price' END, CASE WHEN o_orderpriority IS NULL THEN 'null:priority' END], lambda x: x IS NOT NULL) AS r FROM orders)
SELECT id, array_to_string(r, ';') AS violations FROM v WHERE len(r) > 0""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"enum:status": ~F.col("o_orderstatus").isin("F", "O"), "range:price": ~F.col("o_totalprice").between(1000, 300000), "null:priority": F.col("o_orderpriority").isNull()}
    g = readiness.gate(table(spark, d, "orders"), rules)
    return g.where("not eligible").select(F.col("o_orderkey").alias("id"), F.array_join("reasons", ";").alias("violations"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value, json_extract_string(props, '$.none') AS missing FROM events")
def json_pointer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("value"), F.get_json_object("props", "$.none").alias("missing"))


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+'))::DOUBLE AS v FROM documents), s AS (SELECT s_suppkey AS k, CAST(s_suppkey * 10 AS DOUBLE) AS target FROM supplier)
SELECT k, count(DISTINCT doc_id) AS documents FROM s JOIN n ON abs(v - target) <= 1 GROUP BY k""")
def numeric_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("v")).withColumn("v", F.col("v").cast("double"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 10).cast("double").alias("target"))
    # Numbers and targets meet by their rounded tens, so the band is an equality of cells.
    cells = n.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("v") - 1) / 10), F.floor((F.col("v") + 1) / 10)))))
    met = s.withColumn("cell", F.floor(F.col("target") / 10)).join(cells, "cell").where(F.abs(F.col("v") - F.col("target")) <= 1)
    return met.groupBy("k").agg(F.count_distinct("doc_id").alias("documents"))


@query(f"{WITH}, a AS (SELECT doc, sha256(string_agg(CAST(CAST(bottom AS DECIMAL(12,2)) AS VARCHAR), ',' ORDER BY seq)) AS h FROM pa GROUP BY doc), b AS (SELECT doc, sha256(string_agg(CAST(CAST(bottom AS DECIMAL(12,2)) AS VARCHAR), ',' ORDER BY seq)) AS h FROM pb GROUP BY doc) SELECT count(*) FILTER (WHERE a.h = b.h) AS equal, count(*) AS documents FROM a FULL JOIN b ON a.doc = b.doc")
def canonical_equality(spark: SparkSession, d: str) -> DataFrame:
    def hashed(x: DataFrame, name: str) -> DataFrame:
        t = F.transform(F.array_sort(F.collect_list(F.struct("seq", "bottom"))), lambda r: r["bottom"].cast("string"))
        return x.groupBy("doc").agg(F.sha2(F.array_join(t, ",").cast("binary"), 256).alias(name))

    _, a, b = channels(spark, d)
    return hashed(a, "a").join(hashed(b, "b"), "doc", "full_outer").agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count("*").alias("documents"))


@query("SELECT s_suppkey, coalesce(n_name, 'none') AS place, s_nationkey % 5 = 0 AND n_nationkey IS NOT NULL AS conflict FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 4 > 0")
def attach_location(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").where("n_nationkey % 4 > 0")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("place"), ((F.col("s_nationkey") % 5 == 0) & F.col("n_nationkey").isNotNull()).alias("conflict"))


@query(f"{WITH}, d AS (SELECT o_orderkey AS doc, o_custkey % 3 > 0 AS accept FROM orders) SELECT count(*) FILTER (WHERE accept) AS kept, count(*) FILTER (WHERE NOT accept) AS emptied FROM pa JOIN d USING (doc)")
def risk_aware_predictions(spark: SparkSession, d: str) -> DataFrame:
    _, a, _ = channels(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 3 > 0).alias("accept"))
    return a.join(o, "doc").agg(F.count_if("accept").alias("kept"), F.count_if(~F.col("accept")).alias("emptied"))


@query(f"""WITH {CASES}, v AS (SELECT event_id % 4 AS variant, p, y FROM cases) SELECT variant, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, count(*) FILTER (WHERE p >= 0.5) AS accepted, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS wrong FROM v GROUP BY 1""")
def ablation_matrix(spark: SparkSession, d: str) -> DataFrame:
    v = cases(spark, d).withColumn("variant", F.col("event_id") % 4)
    ok = F.col("p") >= 0.5
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 9).alias("brier"), F.count_if(ok).alias("accepted"), F.count_if(ok & (F.col("y") == 0)).alias("wrong"))


@query(f"""{WITH}, {PERDOC}, {WEIGHTS}, t AS (SELECT rep, sum(matched * w) AS m, sum((matched - doc % 2) * w) AS o, sum(predicted * w) AS p, sum(referred * w) AS r FROM drawn GROUP BY rep),
f AS (SELECT coalesce(2 * m / nullif(CAST(p + r AS DOUBLE), 0), 0) - coalesce(2 * o / nullif(CAST(p + r AS DOUBLE), 0), 0) AS v FROM t)
SELECT count(*) AS repetitions, round(avg(v), 6) AS mean_delta, round(quantile_cont(v, 0.025), 6) AS low_delta, round(quantile_cont(v, 0.975), 6) AS high_delta, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM f""")
def bootstrap_delta(spark: SparkSession, d: str) -> DataFrame:
    """F1 of the readings against F1 of readings with a match less in every other document, drawn together."""
    x = per_document(spark, d).withColumn("other", F.col("matched") - F.col("doc") % 2)
    f1 = lambda c: lambda: statistics.prf(F.col(c), F.col("predicted"), F.col("referred"))[2]
    b = statistics.bootstrap_delta(x, f1("matched"), f1("other"), ["matched", "other", "predicted", "referred"], REPETITIONS)
    return b.select("repetitions", *(F.round(c, 6).alias(c) for c in ("mean_delta", "low_delta", "high_delta", "positive")))


@query("SELECT o_custkey, count(*) AS n, round(pow(0.99, count(*)), 9) AS p_value FROM orders GROUP BY 1")
def zero_error_p_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("p_value", F.round(F.pow(F.lit(0.99), F.col("n")), 9))


@query(f"WITH {CASES}, f AS (SELECT CAST({HASH.format(salt='cv', c='event_id')} % 5 AS INT) AS fold, p, y FROM cases) SELECT fold, count(*) AS n, round(avg(p), 9) AS confidence, round(avg(CAST(y AS DOUBLE)), 9) AS accuracy FROM f GROUP BY 1")
def calibration_by_fold(spark: SparkSession, d: str) -> DataFrame:
    f = cases(spark, d).withColumn("fold", splits.fold(F.col("event_id"), 5, "cv"))
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("confidence"), F.round(F.avg(F.col("y").cast("double")), 9).alias("accuracy"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice > 150000 AS ends, length(o_orderpriority) AS size FROM orders) SELECT o_custkey, arg_max(o_orderkey, (ends, size, -o_orderkey)) AS chosen FROM c GROUP BY 1""")
def choose_section(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("o_orderkey", F.struct((F.col("o_totalprice") > 150000).alias("a"), F.length("o_orderpriority").alias("b"), (-F.col("o_orderkey")).alias("c")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("chosen"))


@query(f"WITH {PTS}, b AS (SELECT id, z + id % 5 - 2 AS z FROM p) SELECT p.id, round((p.z + b.z) / 2, 6) AS mean_z FROM p JOIN b ON p.id = b.id WHERE abs(p.z - b.z) <= 1")
def consensus_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d, "supplier")
    b = p.select(F.col("id").alias("b_id"), (F.col("z") + F.col("id") % 5 - 2).alias("b_z"))
    return p.join(b, F.col("id") == F.col("b_id")).where(F.abs(F.col("z") - F.col("b_z")) <= 1).select("id", F.round((F.col("z") + F.col("b_z")) / 2, 6).alias("mean_z"))


@query(f"""WITH {QP}, {PTS}, b0 AS (SELECT id, x, y, z - 100 AS z FROM p), b1 AS (SELECT id, x, y, z - 250 - id % 7 AS z FROM p), s AS ({IDW.format(q='q', p='p')}), t0 AS ({IDW.format(q='q', p='b0')}), t1 AS ({IDW.format(q='q', p='b1')}),
l AS (SELECT 0 AS layer, avg(s.z - t0.z) AS m FROM s JOIN t0 USING (qid) UNION ALL SELECT 1, avg(t0.z - t1.z) FROM t0 JOIN t1 USING (qid)) SELECT layer, round(m, 4) AS mean_thickness FROM l""")
def layer_stack(spark: SparkSession, d: str) -> DataFrame:
    p, q = points(spark, d, "supplier"), queries_points(spark, d)
    levels = [p, p.withColumn("z", F.col("z") - 100), p.withColumn("z", F.col("z") - 250 - F.col("id") % 7)]
    parts = [spatial.layer_summary(q, a, b, 1.0).select(F.lit(k).alias("layer"), F.round("mean_thickness", 4).alias("mean_thickness")) for k, (a, b) in enumerate(zip(levels, levels[1:], strict=False))]
    return parts[0].unionByName(parts[1])


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'all rights reserved|copyright') THEN 'EXCLUDE' WHEN regexp_matches(lower(text), 'license|licence') THEN 'AMBIGUOUS' ELSE 'ELIGIBLE' END AS disposition FROM documents""")
def licence_screen(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.when(low.rlike("all rights reserved|copyright"), "EXCLUDE").when(low.rlike("license|licence"), "AMBIGUOUS").otherwise("ELIGIBLE").alias("disposition"))


@query(r"""SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '([0-9])[Oo]', '\10', 'g'), '([0-9])[lI]', '\11', 'g') AS fixed, round_even(s_acctbal, 2) AS amount FROM supplier""")
def comparison_keys(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.regexp_replace(F.regexp_replace("s_name", "([0-9])[Oo]", "$10"), "([0-9])[lI]", "$11")
    return table(spark, d, "supplier").select("s_suppkey", fixed.alias("fixed"), F.bround("s_acctbal", 2).alias("amount"))


@query(r"""WITH w AS (SELECT page_id, lower(html) AS t FROM pages), s AS (SELECT page_id, CAST(contains(t, '<p') AS INT) * 2 + CAST(contains(t, '<li') AS INT) AS body, CAST(contains(t, '<nav') AS INT) * 2 + CAST(contains(t, '<footer') AS INT) AS frame FROM w)
SELECT page_id, CASE WHEN greatest(body, frame) < 2 THEN 'unsupported' WHEN body >= frame THEN 'body' ELSE 'frame' END AS family FROM s""")
def page_family_scores(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("html")
    has = lambda x: F.contains(t, F.lit(x)).cast("int")
    body, frame = has("<p") * 2 + has("<li"), has("<nav") * 2 + has("<footer")
    return table(spark, d, "pages").select("page_id", F.when(F.greatest(body, frame) < 2, "unsupported").when(body >= frame, "body").otherwise("frame").alias("family"))


@query(r"""SELECT doc_id, length(text) AS size, len(regexp_extract_all(text, '[0-9]+')) AS numbers, contains(lower(text), 'http') AS link, substr(text, 1, 8) AS head FROM documents""")
def lexical_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), F.contains(F.lower("text"), F.lit("http")).alias("link"), F.substring("text", 1, 8).alias("head"))


@query(f"{WITH} SELECT doc, count(*) FILTER (WHERE top >= 0 AND bottom > top) AS valid, count(*) FILTER (WHERE NOT (top >= 0 AND bottom > top)) AS invalid FROM pa GROUP BY doc")
def interval_validation(spark: SparkSession, d: str) -> DataFrame:
    _, a, _ = channels(spark, d)
    ok = (F.col("top") >= 0) & (F.col("bottom") > F.col("top"))
    return a.groupBy("doc").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(f"{WITH}, u AS (SELECT doc, top AS b FROM ref UNION SELECT doc, bottom FROM ref) SELECT doc, count(*) AS boundaries, CAST(max(b) AS DOUBLE) AS deepest FROM u GROUP BY doc")
def boundary_union(spark: SparkSession, d: str) -> DataFrame:
    r = reference_intervals(spark, d)
    b = F.array_distinct(F.flatten(F.collect_list(F.array("top", "bottom"))))
    return r.groupBy("doc").agg(b.alias("b")).select("doc", F.size("b").cast("long").alias("boundaries"), F.array_max("b").cast("double").alias("deepest"))


@query(f"SELECT o_orderpriority AS stratum, count(*) AS n, count(*) FILTER (WHERE {HASH.format(salt='dev', c='o_custkey')} % 10 < 3) AS development FROM orders GROUP BY 1")
def stratified_fold_counts(spark: SparkSession, d: str) -> DataFrame:
    dev = splits.fold(F.col("o_custkey"), 10, "dev") < 3
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"), F.count_if(dev).alias("development"))


@query("""SELECT 'a' AS metric, CASE WHEN avg(l_discount) <= 0.06 THEN 'pass' ELSE 'fail' END AS verdict FROM lineitem UNION ALL SELECT 'b', CASE WHEN max(l_tax) < 0.01 THEN 'pass' ELSE 'fail' END FROM lineitem""")
def convergence_gate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").agg((F.avg("l_discount") <= 0.06).alias("a"), (F.max("l_tax") < 0.01).alias("b"))
    return m.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.when(F.col(k), "pass").otherwise("fail").alias("verdict")) for k in ("a", "b")))))


@query(f"{WITH}, s AS (SELECT doc, sum(thickness) AS t FROM ref GROUP BY doc) SELECT CASE WHEN t < 5 THEN '0-5' WHEN t < 15 THEN '5-15' ELSE '15+' END AS band, count(*) AS documents FROM s GROUP BY 1")
def depth_bands(spark: SparkSession, d: str) -> DataFrame:
    s = reference_intervals(spark, d).groupBy("doc").agg(F.sum("thickness").alias("t"))
    return s.groupBy(F.when(F.col("t") < 5, "0-5").when(F.col("t") < 15, "5-15").otherwise("15+").alias("band")).agg(F.count("*").alias("documents"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS a, round(min(sqrt(pow((n_nationkey * 17) % 101 - (s_suppkey * 37) % 101, 2) + pow((n_nationkey * 29) % 97 - (s_suppkey * 53) % 97, 2))), 6) AS nearest FROM nation, supplier GROUP BY 1")
def grid_support(spark: SparkSession, d: str) -> DataFrame:
    near = spatial._beside(queries_points(spark, d), points(spark, d, "supplier")).withColumn("d", F.hypot(F.col("qx") - F.col("x"), F.col("qy") - F.col("y")))
    return near.groupBy(F.col("qid").alias("a")).agg(F.round(F.min("d"), 6).alias("nearest"))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS a, regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)\\s*-\\s*([0-9]+(?:\\.[0-9]+)?)', 2) AS b FROM documents), u AS (SELECT doc_id, unnest(a)::DOUBLE AS lo, unnest(b)::DOUBLE AS hi FROM p)
SELECT doc_id, max(hi - lo) AS span FROM u WHERE lo < hi AND hi - lo <= 1000 GROUP BY 1""")
def widest_range(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", T.widest_range(F.col("text")).alias("w"))
    return w.where("w is not null").select("doc_id", F.col("w.span").alias("span"))


@query(f"{WITH}, {PERDOC} SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(predicted - matched) AS BIGINT) AS spurious, CAST(sum(referred - matched) AS BIGINT) AS lost, count(*) FILTER (WHERE matched > predicted - matched) AS net_gain FROM per")
def document_risk(spark: SparkSession, d: str) -> DataFrame:
    p = per_document(spark, d)
    return p.agg(F.sum("matched").alias("matched"), F.sum(F.col("predicted") - F.col("matched")).alias("spurious"), F.sum(F.col("referred") - F.col("matched")).alias("lost"), F.count_if(F.col("matched") > F.col("predicted") - F.col("matched")).alias("net_gain"))


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value > 100) AS high FROM events GROUP BY 1")
def metric_registry(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.evaluate(table(spark, d, "events"), [metrics.Metric("mean", F.sum("value"), F.count("value")), metrics.Metric("high", F.count_if(F.col("value") > 100), F.count("*"))], ("event_type",))
    return m.groupBy("event_type").agg(F.round(F.max(F.when(F.col("metric") == "mean", F.col("value"))), 6).alias("mean"), F.max(F.when(F.col("metric") == "high", F.col("numerator"))).cast("long").alias("high"))


@query(f"{WITH}, x AS (SELECT r.doc, sqrt(avg(CAST((r.top - p.top) * (r.top - p.top) AS DOUBLE))) AS rmse FROM ref r JOIN pa p USING (doc, seq) GROUP BY r.doc) SELECT count(*) AS n, round(avg(rmse), 6) AS mean, round(max(rmse), 6) AS worst FROM x")
def boundary_rmse(spark: SparkSession, d: str) -> DataFrame:
    e = (F.col("rt") - F.col("pt")).cast("double")
    x = paired(spark, d).where("pt is not null").groupBy("doc").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return statistics.profile(x, "rmse").select("n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("worst"))
