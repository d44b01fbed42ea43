"""Queries over positioned numbers, annotations, inventories and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators import annotations, manifests, positions, readiness
from strataframe.plans.catalog import HASH, WITH, channels, query
from strataframe.plans.fixtures import BASE_SQL, reference_intervals, table
from strataframe.sources import files

#: Numbers of a page: suppliers by nation, with a place and a value.
_NUM = "num AS (SELECT p_partkey AS id, p_partkey % 40 AS page, CAST(p_partkey * 31 % 97 AS DOUBLE) / 100 AS x, CAST(p_partkey * 17 % 1009 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS value, CAST(p_partkey % 10 AS DOUBLE) / 10 AS confidence FROM part)"


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % 40).alias("page"), ((k * 31 % 97).cast("double") / 100).alias("x"), (k * 17 % 1009).cast("double").alias("y"), F.col("p_size").cast("double").alias("value"), ((k % 10).cast("double") / 10).alias("confidence"))


@query(f"""WITH {_NUM}, j AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, y) > 0.02 THEN 1 ELSE 0 END AS jump FROM num) SELECT id, page, CAST(sum(jump) OVER (PARTITION BY page ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS INT) AS cluster FROM j""")
def number_columns(spark: SparkSession, d: str) -> DataFrame:
    return positions.numeric_clusters(_numbers(spark, d)).select("id", "page", "cluster")


@query(f"""WITH RECURSIVE {BASE_SQL}, a AS (SELECT doc, list(CAST(q_ AS DOUBLE) ORDER BY seq) AS v FROM (SELECT doc, seq, (pk * 7) % 50 AS q_ FROM ref) GROUP BY doc),
lis AS (SELECT doc, v, 1 AS i, [1] AS best FROM a UNION ALL SELECT doc, v, i + 1, list_append(best, 1 + coalesce(list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN v[j] < v[i + 1] THEN best[j] END)), 0)) FROM lis WHERE i < len(v))
SELECT doc, CAST(list_max(best) AS INT) AS length, list_max(list_transform(range(1, len(v) + 1), lambda j: CASE WHEN best[j] = list_max(best) THEN v[j] END)) AS last FROM lis WHERE i = len(v)""")
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Length and end of the longest increasing run of each document's numbers."""
    r = reference_intervals(spark, d)
    v = F.transform(F.array_sort(F.collect_list(F.struct("seq", ((F.col("pk") * 7) % 50).cast("double").alias("q")))), lambda x: x["q"])
    run = r.groupBy("doc").agg(v.alias("v")).select("doc", positions.longest_increasing(F.col("v")).alias("run"))
    return run.select("doc", F.size("run").alias("length"), F.element_at("run", -1).alias("last"))


@query(f"""{WITH}, a AS (SELECT doc, list(CAST(top AS DOUBLE) ORDER BY seq) AS v FROM ref GROUP BY doc), s AS (SELECT doc, v, list_filter(list_transform(range(1, len(v)), lambda i: round(v[i + 1] - v[i], 3)), lambda x: x > 0) AS s FROM a),
m AS (SELECT doc, v, s, list_median(s) AS c FROM s) SELECT doc, round(CASE WHEN len(v) < 5 OR len(s) = 0 OR c <= 0 THEN 0 ELSE len(list_filter(s, lambda x: abs(x - c) <= greatest(0.01, c * 0.03))) / len(s) * len(list_filter(v, lambda x: abs(x - round_even(x, 0)) <= 1e-6)) / len(v) END, 9) AS score FROM m""")
def scale_ticks(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("top").cast("double").alias("t")))), lambda x: x["t"])
    return reference_intervals(spark, d).groupBy("doc").agg(v.alias("v")).select("doc", F.round(positions.tick_score(F.col("v")), 9).alias("score"))


#: Scale points of a document: depth half of y, two of ten far off; boundaries at other places.
_SCALE = "pts AS (SELECT doc AS page, CAST(seq * 20 + pk % 5 AS DOUBLE) AS y, CAST(seq * 20 + pk % 5 AS DOUBLE) * 0.5 + 3 + CASE WHEN pk % 10 < 2 THEN 40 ELSE 0 END AS depth FROM ref)"


def _scale_points(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("seq") * 20 + F.col("pk") % 5).cast("double")
    return reference_intervals(spark, d).select(F.col("doc").alias("page"), y.alias("y"), (y * 0.5 + 3 + F.when(F.col("pk") % 10 < 2, 40).otherwise(0)).alias("depth"))


_LINES = f"""{_SCALE}, np AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, depth) AS i FROM pts), h AS (SELECT a.page, a.i AS i, b.i AS j, (b.depth - a.depth) / (b.y - a.y) AS m, a.depth - (b.depth - a.depth) / (b.y - a.y) * a.y AS c FROM np a JOIN np b ON a.page = b.page AND a.i < b.i WHERE abs(b.y - a.y) > 1e-9 AND (b.depth - a.depth) / (b.y - a.y) > 0),
n AS (SELECT h.page, h.i, h.j, m, c, count(*) AS k, sum(abs(np.depth - (m * np.y + c))) AS s FROM h JOIN np ON h.page = np.page AND abs(np.depth - (m * np.y + c)) <= 0.1 GROUP BY ALL HAVING count(*) > 1),
best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC, s, i, j) = 1), f AS (SELECT best.page, regr_slope(np.depth, np.y) AS slope, regr_intercept(np.depth, np.y) AS intercept, count(*) AS inliers FROM best JOIN np ON best.page = np.page AND abs(np.depth - (m * np.y + c)) <= 0.1 GROUP BY best.page)"""


@query(f"{WITH}, {_LINES} SELECT page, round(slope, 6) AS slope, round(intercept, 5) AS intercept, inliers FROM f WHERE slope > 0")
def robust_scales(spark: SparkSession, d: str) -> DataFrame:
    s = positions.robust_scale(_scale_points(spark, d))
    return s.select("page", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), "inliers")


@query(f"""WITH RECURSIVE {BASE_SQL}, {_LINES}, b AS (SELECT doc AS page, list(CAST(seq * 20 + 10 - CASE WHEN pk % 7 = 0 THEN 21 ELSE 0 END AS DOUBLE) ORDER BY CAST(seq * 20 + 10 - CASE WHEN pk % 7 = 0 THEN 21 ELSE 0 END AS DOUBLE)) AS ys FROM ref GROUP BY doc),
w AS (SELECT b.page, ys, slope, intercept FROM b LEFT JOIN (SELECT * FROM f WHERE slope > 0) f ON b.page = f.page),
fold AS (SELECT page, ys, slope, intercept, 0 AS i, CAST(NULL AS DOUBLE) AS last, 0 AS kept FROM w UNION ALL SELECT page, ys, slope, intercept, i + 1, CASE WHEN bad THEN last ELSE greatest(v, 0) END, kept + CASE WHEN bad THEN 0 ELSE 1 END
FROM (SELECT *, slope IS NULL OR v < -0.1 OR coalesce(greatest(v, 0) > 40.1, false) OR coalesce(greatest(v, 0) <= last + 0.005, false) AS bad FROM (SELECT *, slope * ys[i + 1] + intercept AS v FROM fold WHERE i < len(ys))))
SELECT page, kept, CAST(len(ys) - kept AS INT) AS rejected, CASE WHEN slope IS NULL THEN 'DEPTH_SCALE_UNAVAILABLE' WHEN kept < len(ys) THEN 'NON_MONOTONIC_OR_OUT_OF_RANGE_BOUNDARIES_REJECTED' ELSE '' END AS warnings FROM fold WHERE i = len(ys)""")
def decoded_depths(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("seq") * 20 + 10 - F.when(F.col("pk") % 7 == 0, 21).otherwise(0)).cast("double")
    b = reference_intervals(spark, d).select(F.col("doc").alias("page"), y.alias("y"), F.lit(40.0).alias("final_depth"))
    g = positions.decode_depths(b, positions.robust_scale(_scale_points(spark, d)))
    return g.select("page", F.size("depths").alias("kept"), "rejected", F.array_join("warnings", ";").alias("warnings"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click') AND event_id % 3 > 0 AND event_id % 10 >= 5) AS selected, count(*) FILTER (WHERE NOT (event_type IN ('view', 'click') AND event_id % 3 > 0 AND event_id % 10 >= 5)) AS rejected FROM events GROUP BY 1""")
def selected_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").select("user_id", F.upper("event_type").alias("event_type"), F.lit("Lithology").alias("owner"), F.when(k % 3 > 0, k).alias("y"), ((k % 10) / 10).alias("confidence"))
    return positions.select_events(e, ["view", "click"], ["lithology"]).groupBy("user_id").agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("rejected"))


_WORDS = ("Depth m", "Lithology", "Material descriptions", "Sub-sample", "Remarks", "page 3")
_ANCHORS = "anc AS (SELECT p_partkey % 60 AS page, CASE p_partkey % 6 WHEN 0 THEN 'depth' WHEN 1 THEN 'lithology' WHEN 2 THEN 'description' WHEN 3 THEN 'sample' WHEN 4 THEN 'comments' END AS s, (p_partkey * 7 % 100) / 100 AS x, (p_partkey * 13 % 90) / 100 AS y, p_partkey / 1000000 AS c FROM part)"


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 6 + 1).cast("int"))
    return positions.semantic_anchors(table(spark, d, "part").select((k % 60).alias("page"), text.alias("text"), ((k * 7 % 100) / 100).alias("x"), ((k * 13 % 90) / 100).alias("y"), (k / 1000000).alias("confidence")))


@query(f"WITH {_ANCHORS} SELECT page, s AS semantic, count(*) AS n, round(sum(x), 4) AS x FROM anc WHERE s IS NOT NULL GROUP BY 1, 2")
def heading_roles(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).groupBy("page", "semantic").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"))


@query(f"""WITH {_ANCHORS}, a AS (SELECT * FROM anc WHERE s IS NOT NULL), r AS (SELECT p.page, p.y, o.s, arg_max(o.x, (o.c, -o.x)) AS x FROM (SELECT DISTINCT page, y FROM a) p JOIN a o ON p.page = o.page AND abs(p.y - o.y) <= 0.0351 GROUP BY ALL),
t AS (SELECT page, y, 4 * count(*) FILTER (WHERE s IN ('lithology', 'description')) + count(*) AS score, min(x) AS x0, max(x) AS x1 FROM r GROUP BY ALL HAVING count(*) FILTER (WHERE s IN ('lithology', 'description')) > 0), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, y DESC) = 1)
SELECT page, round(y, 6) AS header_y, score, round(greatest(0, x0 - 0.16), 6) AS x_min, round(least(1, x1 + 0.22), 6) AS x_max FROM b""")
def panel_layouts(spark: SparkSession, d: str) -> DataFrame:
    p = positions.panel_layout(_anchors(spark, d), 0.0351)
    return p.select("page", F.round("header_y", 6).alias("header_y"), "score", F.round("x_min", 6).alias("x_min"), F.round("x_max", 6).alias("x_max"))


_COLUMNS = """col AS (SELECT s_suppkey AS page, k AS c, (k * 13 + s_suppkey % 7) / 100 AS centre FROM supplier, range(6) r(k)), an AS (SELECT s_suppkey AS page, CASE k WHEN 0 THEN 'depth' WHEN 1 THEN 'graphic_log' WHEN 2 THEN 'core' ELSE 'description' END AS role, (k * 14 + 2) / 100 AS x, (s_suppkey + k) % 10 / 10 AS f FROM supplier, range(4) r(k)),
best AS (SELECT col.page, c, centre, role, greatest(0, 1 - abs(centre - x) / 0.055) * (0.55 + 0.45 * f) AS score, f FROM col JOIN an ON col.page = an.page QUALIFY row_number() OVER (PARTITION BY col.page, c ORDER BY score DESC, f DESC) = 1), roles AS (SELECT page, c, CASE WHEN score >= 0.28 THEN role ELSE 'unknown' END AS role, score FROM best)"""


def _roles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"))
    c = s.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("centre", (F.col("column") * 13 + F.col("page") % 7) / 100)
    k = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    a = k.select("page", F.element_at(F.array(*map(F.lit, ("depth", "graphic_log", "core", "description"))), F.col("k") + 1).alias("role"), ((F.col("k") * 14 + 2) / 100).alias("x"), ((F.col("page") + F.col("k")) % 10 / 10).alias("confidence"))
    return positions.column_roles(c, a)


@query(f"WITH {_COLUMNS} SELECT page, CAST(c AS INT) AS \"column\", CASE WHEN score = 0 THEN 'unknown' ELSE role END AS role, round(score, 6) AS score FROM roles")
def assigned_columns(spark: SparkSession, d: str) -> DataFrame:
    return _roles(spark, d).select("page", "column", "role", F.round("score", 6).alias("score"))


@query(f"WITH {_COLUMNS} SELECT page, count(*) AS n FROM roles r WHERE ((role = 'graphic_log' AND score >= 0.45) OR (role = 'core' AND score >= 0.28)) AND EXISTS (SELECT 1 FROM roles g WHERE g.page = r.page AND g.role = 'graphic_log' AND g.score >= 0.45) GROUP BY 1")
def graphic_log_columns(spark: SparkSession, d: str) -> DataFrame:
    return positions.graphic_columns(_roles(spark, d)).groupBy("page").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT doc, CAST(seq AS BIGINT) AS seq, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, concat('rock ', pk) AS description FROM ref WHERE doc IN (SELECT doc FROM ref GROUP BY doc HAVING count(DISTINCT (top, bottom)) >= 3)")
def printed_column(spark: SparkSession, d: str) -> DataFrame:
    """Ranges printed down a column with their descriptions beside them, some a second time elsewhere, and prose with ranges."""
    r = reference_intervals(spark, d)
    y = F.col("seq") * 20.0
    box = lambda x, dy, text: r.select("doc", F.lit(1).alias("page"), F.lit(x).alias("x0"), (y + dy).alias("y0"), F.lit(x + 30.0).alias("x1"), (y + dy + 10).alias("y1"), text.alias("text"))
    ranges = F.concat(F.replace(F.col("top").cast("string"), F.lit("."), F.lit(",")), F.lit(" – "), F.col("bottom").cast("string"), F.lit(" m"))
    regions = box(100.0, 10.0, ranges).unionByName(box(300.0, 8.0, F.concat(F.lit("rock  "), F.col("pk").cast("string")))).unionByName(box(300.0, 9.0, F.lit("Description of legend"))).unionByName(box(40.0, 300.0, F.lit("samples 1-2 and 2-9")).where("seq = 0"))
    return positions.depth_column(regions).select("doc", F.col("seq").cast("long").alias("seq"), "top", "bottom", "description")


@query("""WITH b AS (SELECT o_custkey, min(o_orderkey % 50) AS x0, min(o_orderkey % 70) AS y0, max(o_orderkey % 50 + 5) AS x1, max(o_orderkey % 70 + 9) AS y1 FROM orders GROUP BY 1) SELECT o_custkey, 100 + x0 / 2.0 AS x0, 200 + y0 / 2.0 AS y0, 100 + x1 / 2.0 AS x1, 200 + y1 / 2.0 AS y1 FROM b""")
def boxes_on_page(spark: SparkSession, d: str) -> DataFrame:
    """Union of each customer's boxes in a tile, in the page's coordinates."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", (k % 50).alias("x0"), (k % 70).alias("y0"), (k % 50 + 5).alias("x1"), (k % 70 + 9).alias("y1"))
    u = positions.union_box(o, ["o_custkey"])
    return u.select("o_custkey", *(c.alias(n) for c, n in zip(positions.to_page([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(100), F.lit(200), 2.0), ("x0", "y0", "x1", "y1"), strict=True)))


@query("""WITH c AS (SELECT s_suppkey AS id, [(s_suppkey % 10) / 10, 0.95] AS b FROM supplier), t AS (SELECT id, k, list_max(list_transform(b, lambda v: exp(-0.5 * pow((k - greatest(0, least(19, v * 19))) / 1.35, 2)))) AS v FROM c, range(20) r(k)) SELECT id, round(sum(v), 6) AS total, round(max(v), 6) AS top FROM t GROUP BY 1""")
def boundary_targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), positions.gaussian_targets(F.array((F.col("s_suppkey") % 10) / 10, F.lit(0.95)), 20).alias("t"))
    return t.select("id", F.round(F.aggregate("t", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.array_max("t"), 6).alias("top"))


#: Annotations of orders: status, attestations of the present or an older record, fields of three kinds.
_ANN = """ann AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'single_verified' WHEN 2 THEN 'double_verified' ELSE 'expert_verified' END AS st, o_orderkey % 6 AS n FROM orders),
att AS (SELECT k, 'a' AS who, false AS expert FROM ann WHERE k % 5 > 0 UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END, k % 7 = 0 FROM ann), v AS (SELECT k, count(DISTINCT who) AS people, bool_or(expert) AS expert FROM att WHERE k % 11 > 0 GROUP BY 1)"""


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    digest = F.sha2(k.cast("string").cast("binary"), 256)
    status = F.element_at(F.array(*map(F.lit, ("auto", "single_verified", "double_verified", "expert_verified"))), (k % 4 + 1).cast("int"))
    a = o.select(k.alias("annotation_id"), status.alias("annotation_status"), digest.alias("record_sha256"), (k % 6).alias("intervals"))
    bound = F.when(k % 11 > 0, digest).otherwise("older")
    one = o.where("o_orderkey % 5 > 0").select(k.alias("annotation_id"), F.lit("a").alias("annotator_id"), F.lit("reviewer").alias("role"), bound.alias("record_sha256"))
    two = o.select(k.alias("annotation_id"), F.when(k % 3 == 0, "b").otherwise("a").alias("annotator_id"), F.when(k % 7 == 0, "expert").otherwise("reviewer").alias("role"), bound.alias("record_sha256"))
    f = o.select(k.alias("annotation_id"), F.lit("borehole.borehole_id").alias("path"), F.when(k % 13 > 0, "human_verified").otherwise("passed").alias("validation_status"), F.when(k % 17 > 0, "human").alias("extraction_method"), F.when(k % 19 > 0, 1).alias("source_page"))
    return a, one.unionByName(two), f


@query(f"""WITH {_ANN}, g AS (SELECT ann.k, list_filter([CASE WHEN st = 'auto' THEN 'ANNOTATION_NOT_HUMAN_VERIFIED' END, CASE WHEN st <> 'auto' AND people IS NULL THEN 'MISSING_VALID_VERIFICATION_ATTESTATION' END, CASE WHEN st = 'double_verified' AND coalesce(people, 0) < 2 THEN 'INSUFFICIENT_INDEPENDENT_ATTESTATIONS' END,
CASE WHEN st = 'expert_verified' AND NOT coalesce(expert, false) THEN 'MISSING_EXPERT_ATTESTATION' END, CASE WHEN n = 0 THEN 'NO_INTERVALS' END, CASE WHEN ann.k % 17 = 0 THEN 'FIELD_NOT_HUMAN_AUTHORED:borehole.borehole_id' END, CASE WHEN ann.k % 13 = 0 THEN 'FIELD_NOT_HUMAN_VERIFIED:borehole.borehole_id' END, CASE WHEN ann.k % 19 = 0 THEN 'MISSING_SOURCE_PAGE:borehole.borehole_id' END], lambda x: x IS NOT NULL) AS r FROM ann LEFT JOIN v ON ann.k = v.k)
SELECT k AS annotation_id, array_to_string(r, ';') AS reasons FROM g""")
def truth_gates(spark: SparkSession, d: str) -> DataFrame:
    return annotations.truth_gate(*_annotated(spark, d)).select("annotation_id", F.array_join("reasons", ";").alias("reasons"))


@query(f"""WITH {_ANN}, r AS (SELECT 'reason' AS kind, unnest(list_filter([CASE WHEN st = 'auto' THEN 'ANNOTATION_NOT_HUMAN_VERIFIED' END, CASE WHEN st <> 'auto' AND people IS NULL THEN 'MISSING_VALID_VERIFICATION_ATTESTATION' END, CASE WHEN st = 'double_verified' AND coalesce(people, 0) < 2 THEN 'INSUFFICIENT_INDEPENDENT_ATTESTATIONS' END,
CASE WHEN st = 'expert_verified' AND NOT coalesce(expert, false) THEN 'MISSING_EXPERT_ATTESTATION' END, CASE WHEN n = 0 THEN 'NO_INTERVALS' END, CASE WHEN ann.k % 17 = 0 THEN 'FIELD_NOT_HUMAN_AUTHORED' END, CASE WHEN ann.k % 13 = 0 THEN 'FIELD_NOT_HUMAN_VERIFIED' END, CASE WHEN ann.k % 19 = 0 THEN 'MISSING_SOURCE_PAGE' END], lambda x: x IS NOT NULL)) AS name FROM ann LEFT JOIN v ON ann.k = v.k)
SELECT kind, name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'status', st, count(*) FROM ann GROUP BY 2 UNION ALL SELECT 'exportable', 'exportable', count(*) FROM ann LEFT JOIN v ON ann.k = v.k WHERE st <> 'auto' AND people IS NOT NULL AND NOT (st = 'double_verified' AND people < 2) AND NOT (st = 'expert_verified' AND NOT expert) AND n > 0 AND ann.k % 17 > 0 AND ann.k % 13 > 0 AND ann.k % 19 > 0""")
def annotation_readiness(spark: SparkSession, d: str) -> DataFrame:
    return annotations.readiness_counts(annotations.truth_gate(*_annotated(spark, d)))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'REFERENCE_NOT_SILVER' END, CASE WHEN c_custkey % 3 = 0 THEN 'MISSING_SILVER_RECORD' END, CASE WHEN c_custkey % 7 = 0 THEN 'SILVER_ROW_CLAIMS_HUMAN_GT' END], lambda x: x IS NOT NULL), ';') AS reasons FROM customer""")
def silver_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 5 == 0, "gold").when(k % 2 == 0, "silver").otherwise("Silver_Uncertain").alias("tier"), F.when(k % 3 > 0, True).alias("has_record"), (k % 7 == 0).alias("claims_human"))
    return annotations.silver_gate(c).select("c_custkey", F.array_join("reasons", ";").alias("reasons"))


@query("""WITH b AS (SELECT c_custkey AS k, list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'MISSING_X_COORDINATE' END, CASE WHEN c_custkey % 13 = 0 THEN 'MISSING_COORDINATE_SYSTEM' END, CASE WHEN c_custkey % 17 = 0 THEN 'MISSING_COLLAR_ELEVATION' WHEN c_custkey % 3 = 0 THEN 'COLLAR_ELEVATION_NOT_HUMAN_VERIFIED' END,
CASE WHEN c_custkey % 5 = 0 THEN 'MISSING_TARGET_INTERVAL' WHEN c_custkey % 7 = 0 THEN 'MISSING_TARGET_BOUNDARY' WHEN c_custkey % 19 = 0 THEN 'TARGET_BOUNDARY_NOT_HUMAN_VERIFIED' END], lambda x: x IS NOT NULL) AS r FROM customer)
SELECT CAST(k AS VARCHAR) AS name, array_to_string(r, ';') AS reasons FROM b WHERE len(r) > 0 UNION ALL SELECT 'surface', CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey % 13 > 0 AND c_custkey % 2 = 0) > 0 THEN 'MIXED_COORDINATE_SYSTEMS' ELSE '' END""")
def surface_readiness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        k.cast("string").alias("document_id"), F.when(k % 11 > 0, 1.0).alias("x"), F.lit(2.0).alias("y"), F.when(k % 13 > 0, F.when(k % 2 == 0, "EPSG:1").otherwise("EPSG:2")).alias("system"), F.when(k % 17 > 0, 10.0).alias("collar"),
        F.when(k % 3 > 0, "human_verified").alias("collar_status"), (k % 5 > 0).alias("has_interval"), F.when((k % 5 > 0) & (k % 7 > 0), 3.0).alias("depth"), F.when(k % 19 > 0, "human_verified").otherwise("passed").alias("depth_status"),
    )
    told, whole = annotations.surface_gate(c)
    return told.where(F.size("reasons") > 0).select(F.col("document_id").alias("name"), F.array_join("reasons", ";").alias("reasons")).unionByName(whole.select(F.lit("surface").alias("name"), F.array_join("reasons", ";").alias("reasons")))


@query("""WITH cur AS (SELECT c_custkey AS k, c_custkey % 3 AS rev FROM customer WHERE c_custkey % 4 > 0), inc AS (SELECT c_custkey AS k, c_custkey % 5 AS rev FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_custkey % 5 FROM customer WHERE c_custkey % 14 = 0),
j AS (SELECT inc.k, inc.rev, cur.rev AS had, count(*) OVER (PARTITION BY inc.k) AS n FROM inc LEFT JOIN cur ON inc.k = cur.k), t AS (SELECT * FROM j WHERE n = 1 AND (had IS NULL OR rev = had + 1))
SELECT 'current' AS kind, count(*) AS n, CAST(sum(rev) AS BIGINT) AS revisions FROM (SELECT k, rev FROM cur WHERE k NOT IN (SELECT k FROM t) UNION ALL SELECT k, rev FROM t) UNION ALL SELECT 'history', count(*), CAST(sum(rev) AS BIGINT) FROM cur WHERE k IN (SELECT k FROM t) UNION ALL SELECT 'conflict', count(*), CAST(sum(rev) AS BIGINT) FROM j WHERE NOT (n = 1 AND (had IS NULL OR rev = had + 1))""")
def saved_revisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    row = lambda m, where: table(spark, d, "customer").where(where).select(k.alias("annotation_id"), (k % m).alias("revision"))
    parts = annotations.save_revisions(row(3, "c_custkey % 4 > 0"), row(5, "c_custkey % 2 = 0").unionByName(row(5, "c_custkey % 14 = 0")))
    told = [p.agg(F.count("*").alias("n"), F.sum("revision").alias("revisions")).select(F.lit(n).alias("kind"), "n", "revisions") for p, n in zip(parts, ("current", "history", "conflict"), strict=True)]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query("""WITH r AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'anonymize_then_review' WHEN 2 THEN 'eligible_for_annotation' WHEN 3 THEN 'eligible_for_annotation' ELSE 'maybe' END AS d FROM supplier)
SELECT k, array_to_string(list_filter([CASE WHEN d = 'maybe' THEN 'INVALID_DECISION' END, CASE WHEN k % 7 = 0 THEN 'MISSING_REVIEWER' END, CASE WHEN d = 'anonymize_then_review' AND k % 2 = 0 THEN 'REDACTIONS_NOT_REQUIRED' END, CASE WHEN d = 'eligible_for_annotation' AND k % 3 = 0 THEN 'RENDER_INCOMPLETE' END, CASE WHEN d = 'eligible_for_annotation' AND k % 2 = 1 THEN 'REDACTIONS_LEFT' END, CASE WHEN d = 'eligible_for_annotation' AND k % 4 < 2 THEN 'UNRESOLVED_CHECKS' END], lambda x: x IS NOT NULL), ';') AS faults FROM r""")
def page_decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    decision = F.element_at(F.array(*map(F.lit, ("exclude", "anonymize_then_review", "eligible_for_annotation", "eligible_for_annotation", "maybe"))), (k % 5 + 1).cast("int"))
    status, action = F.when(k % 4 == 0, "uncertain").when(k % 4 == 3, "absent").otherwise("present"), F.when(k % 4 == 2, "cleared")
    r = table(spark, d, "supplier").select(k.alias("k"), decision.alias("decision"), F.when(k % 7 > 0, "someone").otherwise(" ").alias("reviewer"), F.lit(True).alias("phase1"), (k % 3 > 0).alias("complete"), (k % 2 == 1).alias("redactions"), F.array(F.struct(F.lit("names").alias("name"), status.alias("status"), action.alias("action"))).alias("checks"))
    return annotations.review_decision(r).select("k", F.array_join("faults", ";").alias("faults"))


@query("""WITH l AS (SELECT o_custkey AS k, arg_max(o_orderkey % 4, o_orderkey) AS d FROM orders GROUP BY 1), c AS (SELECT CASE d WHEN 0 THEN 'exclude' WHEN 1 THEN 'internal_only' WHEN 2 THEN 'anonymize_then_review' WHEN 3 THEN 'eligible_for_annotation' ELSE 'unreviewed' END AS d FROM customer LEFT JOIN l ON c_custkey = k),
t(decision) AS (VALUES ('exclude'), ('internal_only'), ('anonymize_then_review'), ('eligible_for_annotation'), ('unreviewed')) SELECT decision, count(c.d) AS n FROM t LEFT JOIN c ON c.d = decision GROUP BY 1""")
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    reviews = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.element_at(F.array(*map(F.lit, annotations.DECISIONS)), (k % 4 + 1).cast("int")).alias("decision"), k.alias("revision"))
    return annotations.review_audit(table(spark, d, "customer").select(F.col("c_custkey").alias("item")), reviews)


@query("""WITH p AS (SELECT o_custkey AS source, o_orderkey AS page, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS st, o_orderkey % 9 > 0 AS ok FROM orders) SELECT source, arg_min(st, CASE WHEN st IS NOT NULL THEN page END) AS status_code, count(*) AS pages, count(DISTINCT st) > 1 AS conflict, bool_and(ok) AS verified, count(*) * 2 AS intervals, concat('I', lpad(CAST(count(*) * 2 AS VARCHAR), 3, '0')) AS last FROM p GROUP BY 1""")
def merged_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = F.array(*(F.struct(F.lit(v).alias("top")) for v in (0, 1)))
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), k.alias("page"), F.when(k % 9 > 0, "single_verified").otherwise("auto").alias("status"), F.when(k % 4 > 0, F.col("o_orderstatus")).alias("status_code"), items.alias("intervals"))
    heads, rows = annotations.merge_pages(p, ["status_code"])
    n = rows.groupBy(F.col("source").alias("i_source")).agg(F.count("*").alias("intervals"), F.max("interval_id").alias("last"))
    return heads.join(n, F.col("source") == F.col("i_source")).select("source", "status_code", "pages", (F.size("conflicts") > 0).alias("conflict"), "verified", "intervals", "last")


@query("""WITH f AS (SELECT o_orderkey AS k, list_sort(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING_REQUIRED_MVP_FIELD' END, CASE WHEN o_orderkey % 10 < 7 THEN 'LOW_CONFIDENCE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'FIELD_VALIDATION_STATUS' END, CASE WHEN o_orderkey % 8 = 0 THEN 'FINAL_DEPTH_MISMATCH' END, CASE WHEN o_orderkey % 9 = 0 THEN 'GAP' END], lambda x: x IS NOT NULL)) AS r FROM orders)
SELECT k AS annotation_id, array_to_string(r, ';') AS reason_codes, CASE WHEN k % 5 = 0 OR k % 8 = 0 THEN 'high' ELSE 'medium' END AS priority FROM f WHERE len(r) > 0""")
def field_reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    codes = F.array_compact(F.array(F.when(k % 8 == 0, "FINAL_DEPTH_MISMATCH"), F.when(k % 9 == 0, "GAP")))
    f = table(spark, d, "orders").select(k.alias("annotation_id"), F.lit("borehole.final_depth_m").alias("path"), F.when(k % 5 > 0, "1").alias("value"), ((k % 10) / 10).alias("confidence"), F.when(k % 3 == 0, "warning").otherwise("passed").alias("validation_status"), F.lit(True).alias("required"), codes.alias("codes"))
    return annotations.field_reviews(f).select("annotation_id", F.array_join("reason_codes", ";").alias("reason_codes"), "priority")


@query("SELECT s_suppkey AS item, track, substr(sha256('pack:' || track || ':' || s_suppkey), 1, 16) AS blind_id FROM supplier, (VALUES ('first'), ('second')) t(track)")
def blinded_pack(spark: SparkSession, d: str) -> DataFrame:
    return annotations.blinded_tracks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("item")), ["first", "second"], "pack")


_RULES = [("logs", "log_*.pdf", [(1, 10), (20, 30)]), ("tables", "*.pdf", [(11, 19)]), ("scans", "scan_?[!9].png", None)]


@query("""WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat('log_', o_custkey, '.pdf') WHEN 1 THEN concat('other', o_custkey, '.pdf') ELSE concat('scan_', o_custkey % 100, '.png') END AS f, o_orderkey % 40 + 1 AS page FROM orders),
r AS (SELECT k, list_filter([CASE WHEN k % 3 = 0 AND (page BETWEEN 1 AND 10 OR page BETWEEN 20 AND 30) THEN 'logs' END, CASE WHEN k % 3 < 2 AND page BETWEEN 11 AND 19 THEN 'tables' END, CASE WHEN regexp_full_match(f, 'scan_.[^9]\\.png') THEN 'scans' END], lambda x: x IS NOT NULL) AS m FROM p) SELECT k, CASE WHEN len(m) = 1 THEN m[1] END AS rule_id, CAST(len(m) AS INT) AS rules FROM r""")
def content_rules(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("log_"), c, F.lit(".pdf"))).when(k % 3 == 1, F.concat(F.lit("other"), c, F.lit(".pdf"))).otherwise(F.concat(F.lit("scan_"), (F.col("o_custkey") % 100).cast("string"), F.lit(".png")))
    return manifests.page_rules(table(spark, d, "orders").select(k.alias("k"), name.alias("filename"), (k % 40 + 1).alias("page")), _RULES).select("k", "rule_id", "rules")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 > 0 THEN 'native_pdf' WHEN p_partkey % 3 > 0 THEN 'vector_pdf_without_extractable_text' WHEN p_partkey % 5 > 0 THEN 'image_pdf_without_extractable_text' ELSE 'pdf_without_detected_content' END AS page_type FROM part""")
def page_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", manifests.page_type(k % 2, k % 5, k % 3).alias("page_type"))


@query("""SELECT o_custkey, arg_min(o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END) AS title, array_to_string(list_sort(list(DISTINCT o_orderstatus) || []), ',') AS formats FROM orders GROUP BY 1""")
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(k % 3 == 1, F.col("o_orderpriority")).when(k % 3 == 2, F.col("o_orderpriority")).otherwise("").alias("title"), F.array("o_orderstatus").alias("formats"))
    return manifests.merge_records(o, "o_custkey", "o_orderkey", ["title"], ["formats"]).select("o_custkey", "title", F.array_join("formats", ",").alias("formats"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 3 = 0, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END, -1), o_orderkey % 2 = 0, -o_orderkey)) AS inventory FROM orders GROUP BY 1""")
def preferred_inventories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", k.alias("inventory"), F.when(k % 3 == 0, 200).otherwise(404).alias("http_status"), F.when(k % 5 > 0, k).alias("file_count"), F.when(k % 2 == 0, "api").otherwise("page").alias("source"))
    return manifests.preferred_inventory(o, "o_custkey", "api", "inventory").select("o_custkey", "inventory")


_GOLD = "gold AS (SELECT DISTINCT doc AS key, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom, concat('t', pk) AS text FROM ref WHERE pk % 31 > 0 AND pk % 37 > 0)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    r = reference_intervals(spark, d)
    top = F.when(F.col("pk") % 31 == 0, "n/a").otherwise(F.col("top").cast("string"))
    return manifests.gold_intervals(r.select("doc", top.alias("top"), "bottom", F.when(F.col("pk") % 37 == 0, " ").otherwise(F.concat(F.lit(" t"), "pk")).alias("text"), F.when(F.col("pk") % 41 == 0, "?").alias("comments")), "doc")


@query(f"{WITH}, {_GOLD} SELECT key, count(*) AS n, round(sum(bottom - top), 4) AS depth FROM gold GROUP BY 1")
def gold_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(F.col("bottom") - F.col("top")), 4).alias("depth"))


@query(f"""{WITH}, {_GOLD}, c AS (SELECT doc FROM ref WHERE pk % 41 = 0 AND pk % 31 > 0 AND pk % 37 > 0), g AS (SELECT key, abs(lead(top) OVER (PARTITION BY key ORDER BY top, bottom, text) - bottom) AS gap FROM gold),
p AS (SELECT key, count(*) AS n, coalesce(count(*) FILTER (WHERE gap <= 0.01) / nullif(CAST(count(gap) AS DOUBLE), 0), 1) AS share FROM g GROUP BY 1) SELECT key, n, round(share, 9) AS share FROM p WHERE n BETWEEN 5 AND 60 AND share >= 0.8 AND key NOT IN (SELECT doc FROM c)""")
def clean_candidates(spark: SparkSession, d: str) -> DataFrame:
    return manifests.clean_candidates(_gold(spark, d), joined=0.8).withColumn("share", F.round("share", 9))


@query("""WITH h AS (SELECT c_custkey, c_nationkey, sha256('cohort' || c_custkey) AS hash FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY hash, c_custkey) AS k FROM h), o AS (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, CASE WHEN k = 1 THEN c_nationkey END, hash) AS place FROM r) SELECT c_custkey, place FROM o""")
def cohort_places(spark: SparkSession, d: str) -> DataFrame:
    """The cohort's order, told as places (a window over the hash order of a small table)."""
    from pyspark.sql import Window

    c = manifests.cohort_order(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", "cohort")
    return c.select("c_custkey", F.row_number().over(Window.orderBy("turn", "first_group", "hash")).cast("long").alias("place"))


@query("""SELECT concat('f', s_suppkey) AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'size' ELSE 'hash' END AS problem FROM supplier WHERE s_suppkey % 11 > 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 3 = 0) UNION ALL SELECT concat('f', s_suppkey), 'unlisted' FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 5 > 0""")
def verified_inventory(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("f"), k.cast("string"))
    expected = s.where("s_suppkey % 11 > 0").select(name.alias("path"), k.alias("size"), F.lit("h").alias("sha256"))
    found = s.where("s_suppkey % 5 > 0").select(name.alias("path"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("size"), F.when(k % 3 == 0, "other").otherwise("h").alias("sha256"))
    return manifests.verify_inventory(expected, found)


@query("""WITH w AS (SELECT s_suppkey AS document, unnest(range(1, s_suppkey % 6 + 1)) AS page FROM supplier), h AS (SELECT s_suppkey AS document, p AS page, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS n FROM supplier, range(2, 5) r(p)), j AS (SELECT coalesce(w.document, h.document) AS document, coalesce(w.page, h.page) AS page, CASE WHEN n IS NULL THEN 'missing' WHEN w.page IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS problem FROM w FULL JOIN h ON w.document = h.document AND w.page = h.page)
SELECT document, CAST(page AS INT) AS page, problem FROM j WHERE problem IS NOT NULL""")
def page_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    docs = table(spark, d, "supplier").select(k.alias("document"), (k % 6).cast("int").alias("pages"))
    once = docs.select("document", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("page"))
    return manifests.expected_pages(docs, once.unionByName(once.where("document % 7 = 0")))


@query(f"{WITH}, a AS (SELECT DISTINCT doc, top, bottom FROM pa), b AS (SELECT DISTINCT doc, top, bottom FROM pb) SELECT CASE WHEN a.doc IS NULL THEN 'second' WHEN b.doc IS NULL THEN 'first' ELSE 'both' END AS found, count(*) AS n FROM a FULL JOIN b ON a.doc = b.doc AND a.top = b.top AND a.bottom = b.bottom GROUP BY 1")
def two_readers(spark: SparkSession, d: str) -> DataFrame:
    _, a, b = channels(spark, d)
    return manifests.two_readers(a, b, ["doc", "top", "bottom"]).groupBy("found").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'verified' WHEN contains(lower(p_type), 'steel') THEN 'partly' ELSE 'open' END AS status FROM part")
def ledger_statuses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", manifests.statuses(F.col("p_type"), [("brass", "verified"), ("steel", "partly")], "open").alias("status"))


@query("SELECT count(*) AS features, 'EPSG:1,EPSG:2' AS systems FROM supplier WHERE s_suppkey % 4 > 0")
def feature_systems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 > 0, k.cast("double")).alias("x"), F.lit(2.0).alias("y"), F.when(k % 4 > 0, F.when(k % 2 == 0, "EPSG:1").otherwise("EPSG:2")).otherwise("EPSG:9").alias("system"))
    features, systems = files.feature_collection(s, "id", "x", "y", "system")
    return features.agg(F.count("*").alias("features")).withColumn("systems", F.lit(",".join(systems)))


@query("SELECT (SELECT bool_and(c_custkey > 0) FROM customer) AS customers_ok, (SELECT count(*) > 0 FROM orders) AS orders_ok, (SELECT bool_and(c_custkey > 0) FROM customer) AND (SELECT count(*) > 0 FROM orders) AS ready")
def project_ready(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").agg(F.every(F.col("c_custkey") > 0).alias("customers_ok"))
    return readiness.all_gates(a.join(table(spark, d, "orders").agg((F.count("*") > 0).alias("orders_ok"))))


@query("""SELECT c_custkey AS annotation_id, array_to_string(list_filter([CASE WHEN c_custkey % 6 = 5 THEN 'UNSUPPORTED_STATUS' END, CASE WHEN c_custkey % 7 = 0 THEN 'REVISION_CONFLICT' END, CASE WHEN c_custkey % 6 = 2 AND c_custkey % 5 = 0 THEN 'NEEDS_TWO_ANNOTATORS' END, CASE WHEN c_custkey % 6 = 3 AND c_custkey % 4 > 0 THEN 'NEEDS_EXPERT' END], lambda x: x IS NOT NULL), ';') AS faults FROM customer""")
def revision_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("auto", "single_verified", "double_verified", "expert_verified", "auto", "other"))), (k % 6 + 1).cast("int"))
    c = table(spark, d, "customer")
    revisions = c.select(k.alias("annotation_id"), F.lit("a").alias("annotator_id"), F.when(k % 4 == 0, "expert").otherwise("reviewer").alias("role"), status.alias("status"), F.lit("h").alias("record_sha256"), F.when(k % 7 == 0, 5).otherwise(2).alias("revision"), F.lit(1).alias("previous"))
    earlier = c.select(k.alias("annotation_id"), F.when(k % 5 == 0, "a").otherwise("b").alias("annotator_id"), F.lit("h").alias("record_sha256"))
    return annotations.revision_faults(revisions, earlier).select("annotation_id", F.array_join("faults", ";").alias("faults"))


@query("""WITH i AS (SELECT DISTINCT concat('t', o_orderkey % 3) AS track, o_custkey AS item FROM orders), d AS (SELECT concat('t', o_orderkey % 3) AS track, o_custkey AS item, bool_or(o_orderkey % 2 = 0) AS ok FROM orders WHERE o_orderkey % 5 > 0 GROUP BY ALL UNION ALL SELECT 't0', -1, true)
SELECT coalesce(i.track, d.track) AS track, count(i.item) AS items, count(*) FILTER (WHERE i.item IS NOT NULL AND ok) AS verified, count(*) FILTER (WHERE i.item IS NOT NULL AND NOT coalesce(ok, false)) AS "open", count(*) FILTER (WHERE i.item IS NULL) AS "foreign" FROM i FULL JOIN d ON i.track = d.track AND i.item = d.item GROUP BY 1""")
def track_progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("track", F.concat(F.lit("t"), (k % 3).cast("string")))
    done = o.where("o_orderkey % 5 > 0").select("track", F.col("o_custkey").alias("item"), F.when(k % 2 == 0, "single_verified").otherwise("auto").alias("status"))
    extra = spark.createDataFrame([("t0", -1, "single_verified")], "track string, item long, status string")
    return annotations.track_progress(o.select("track", F.col("o_custkey").alias("item")), done.select("track", F.col("item").cast("long").alias("item"), "status").unionByName(extra))


@query("SELECT s_suppkey AS item, 'depth' AS field, CAST(s_nationkey AS VARCHAR) AS \"first\", CAST(s_nationkey + 1 AS VARCHAR) AS \"second\" FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'name', s_name, NULL FROM supplier WHERE s_suppkey % 4 = 0")
def track_differences(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("int")
    s = table(spark, d, "supplier")
    a = s.select(k.alias("item"), F.lit("a").alias("annotator_id"), n.alias("depth"), F.col("s_name").alias("name"))
    b = s.select(k.alias("item"), F.lit("b").alias("annotator_id"), F.when(k % 3 == 0, n + 1).otherwise(n).alias("depth"), F.when(k % 4 != 0, F.col("s_name")).alias("name"))
    return annotations.compare_tracks(a, b, ["depth", "name"])


_PLACES = ("Tiefe in", "Mächtigkeit", "depth interval", "no heading", "épaisseur et profondeur")


@query("""WITH w AS (SELECT p_partkey % 30 AS page, p_partkey % 150 AS block, p_partkey * 7 % 100 / 100 AS x, p_partkey % 5 AS k FROM part), b AS (SELECT page, block, min(k) AS k, avg(x) AS x FROM w GROUP BY ALL), r AS (SELECT page, block, x, unnest(CASE k WHEN 0 THEN ['cumulative_depth'] WHEN 1 THEN ['thickness'] WHEN 2 THEN ['cumulative_depth'] WHEN 4 THEN ['cumulative_depth', 'thickness'] ELSE [] END) AS role FROM b)
SELECT page, block, role, round(x, 6) AS x FROM r""")
def block_headings(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a word each, or several of one kind."""
    k = F.col("p_partkey")
    w = table(spark, d, "part").select((k % 30).alias("page"), (k % 150).alias("block"), k.alias("line"), (k * 7 % 100 / 100).alias("x"), F.element_at(F.array(*map(F.lit, _PLACES)), (k % 5 + 1).cast("int")).alias("text"))
    return positions.block_headings(w).select("page", "block", "role", F.round("x", 6).alias("x"))


@query("""SELECT s_suppkey AS page, CAST(greatest(0, floor(500 + s_suppkey % 100 - 230)) AS INT) AS x0, CAST(floor(120 + 60) AS INT) AS y0, CAST(least(2000, floor(500 + s_suppkey % 100 + 230)) AS INT) AS x1, 2880 AS y1 FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0""")
def surface_depth_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    row = lambda x, y, bottom, text, c: s.select(k.alias("page"), F.lit(2000).alias("width"), F.lit(3000).alias("height"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(float(bottom)).alias("bottom"), text.alias("text"), F.lit(c).alias("confidence"))
    depth = row(F.lit(480) + k % 100, 90, 100, F.when(k % 7 > 0, "Depth from").otherwise("Time"), 0.9)
    surface = row(F.lit(520) + k % 100, 110, 120, F.when(k % 5 > 0, "SURFACE").otherwise("sea"), 0.8)
    far = row(F.lit(1900) + k % 50, 100, 130, F.lit("surface"), 0.99)
    return positions.surface_depth_column(depth.unionByName(surface).unionByName(far))


@query("SELECT s_suppkey, CAST((800 - 300 - s_suppkey % 10 - 50) * 2 AS DOUBLE) AS x0, CAST((20 - 10) * 3 AS DOUBLE) AS y0, CAST((800 - 100 - 50) * 2 AS DOUBLE) AS x1, CAST(greatest(0, (s_suppkey % 40 - 10) * 3) AS DOUBLE) AS y1 FROM supplier WHERE s_suppkey % 40 >= 20")
def boxes_in_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page turned by a quarter, in the pixels of a clipped rendering."""
    k = F.col("s_suppkey")
    lit = lambda *v: [F.lit(float(x)) for x in v]
    box = [F.lit(20.0), F.lit(100.0), (k % 40).cast("double"), (300 + k % 10).cast("double")]
    px = positions.to_pixels(box, lit(0, 1, -1, 0, 800, 0), lit(50, 10, 850, 610), F.lit(1600.0), F.lit(1800.0))
    return table(spark, d, "supplier").where("s_suppkey % 40 >= 20").select("s_suppkey", *(c.alias(n) for c, n in zip(px, ("x0", "y0", "x1", "y1"), strict=True)))


@query("""SELECT 'share' AS "check", s_suppkey AS text_id, CAST(CASE WHEN s_suppkey % 4 > 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 0.13 ELSE 0.12 END END AS DOUBLE) AS observed, CAST(0.125 AS DOUBLE) AS expected, s_suppkey % 4 > 0 AND s_suppkey % 3 > 0 AS passed FROM supplier""")
def told_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("a share of "), F.when(k % 3 == 0, "0.13").otherwise("0.12"), F.when(k % 4 == 0, " or a share of 0.2").otherwise(""))
    return manifests.told_numbers(table(spark, d, "supplier").select(k.alias("text_id"), text.alias("text")), [("share", r"share of ([0-9.]+)", 2)], spark.createDataFrame([("share", 0.125)], "check string, value double"))


@query("SELECT 'rows' AS assertion, (SELECT count(*) FROM nation) AS observed, CAST(25 AS BIGINT) AS expected, (SELECT count(*) FROM nation) = 25 AS passed UNION ALL SELECT 'distinct:n_regionkey', (SELECT count(DISTINCT n_regionkey) FROM nation), 4, (SELECT count(DISTINCT n_regionkey) FROM nation) = 4")
def table_assertions(spark: SparkSession, d: str) -> DataFrame:
    return manifests.table_assertions(table(spark, d, "nation"), 25, {"n_regionkey": 4})


@query("SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS \"first\" FROM documents GROUP BY 1 HAVING count(*) > 1")
def same_content(spark: SparkSession, d: str) -> DataFrame:
    return manifests.same_content(table(spark, d, "documents"), "doc_id", "text")
