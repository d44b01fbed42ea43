"""Queries of policies, audits and records built by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators import engine, policies, propagation, sequences, spatial, statistics
from strataframe.plans.catalog import CHECK_SQL, IDW, PERDOC, QP, REPETITIONS, WEIGHTS, WITH, channels, counts, query
from strataframe.plans.catalog_more import DECODE
from strataframe.plans.fixtures import BASE_SQL, points, queries_points, reference_intervals, table
from strataframe.sources import records

_NAMED = "per AS (SELECT r.doc, count(p.doc) FILTER (WHERE near) AS matched, count(p.doc) AS predicted, count(*) AS referred, count(p.doc) FILTER (WHERE near AND r.pk % 13 > 0) AS named FROM (SELECT *, true AS x FROM ref) r LEFT JOIN pa p ON r.doc = p.doc AND r.seq = p.seq, LATERAL (SELECT abs(r.top - p.top) <= 0.03 AND abs(r.bottom - p.bottom) <= 0.03 AS near) GROUP BY r.doc)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    p = a.select(F.col("doc").alias("p_doc"), F.col("seq").alias("p_seq"), F.col("top").alias("pt"), F.col("bottom").alias("pb"))
    both = ref.join(p, (F.col("doc") == F.col("p_doc")) & (F.col("seq") == F.col("p_seq")), "left")
    tol = F.lit("0.03").cast("decimal(4,2)")
    near = (F.abs(F.col("top") - F.col("pt")) <= tol) & (F.abs(F.col("bottom") - F.col("pb")) <= tol)
    return policies.error_events(both.groupBy("doc").agg(F.count_if(near).alias("matched"), F.count("pt").alias("predicted"), F.count("*").alias("referred"), F.count_if(near & (F.col("pk") % 13 > 0)).alias("named")))


@query(f"""{WITH}, {_NAMED} SELECT doc, referred - matched AS missing, predicted - matched AS spurious, matched - named AS misnamed, array_to_string(list_sort(list_filter([CASE WHEN predicted = 0 THEN 'zero_output_document' END, CASE WHEN referred > matched THEN 'boundary_omission' END, CASE WHEN predicted > matched THEN 'spurious_interval' END, CASE WHEN matched > named THEN 'lithology_semantic_error' END], lambda x: x IS NOT NULL)), ';') AS events FROM per""")
def error_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("doc", "missing", "spurious", "misnamed", F.array_join("events", ";").alias("events"))


@query(f"""{WITH}, {_NAMED}, {CHECK_SQL}, e AS (SELECT doc, unnest(list_filter([CASE WHEN predicted = 0 THEN 'zero_output_document' END, CASE WHEN referred > matched THEN 'boundary_omission' END, CASE WHEN predicted > matched THEN 'spurious_interval' END, CASE WHEN matched > named THEN 'lithology_semantic_error' END], lambda x: x IS NOT NULL)) AS event FROM per),
v AS (SELECT doc, sum(violations) AS n FROM counted GROUP BY doc) SELECT event, count(*) AS documents, count(*) FILTER (WHERE coalesce(n, 0) > 0) AS flagged, round(count(*) FILTER (WHERE coalesce(n, 0) > 0) / count(*), 9) AS share FROM e LEFT JOIN v USING (doc) GROUP BY event""")
def error_detectability(spark: SparkSession, d: str) -> DataFrame:
    v = counts(spark, d).groupBy(F.col("doc").alias("v_doc")).agg(F.sum("violations").alias("n"))
    e = _events(spark, d).join(v, F.col("doc") == F.col("v_doc"), "left").select("doc", "events", F.coalesce("n", F.lit(0)).alias("violations"))
    return policies.detectability(e).withColumn("share", F.round("share", 9))


@query("""WITH r AS (SELECT o_orderkey % 4 AS profile, o_orderpriority AS rt, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS pt, o_custkey AS rx, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END END AS px FROM orders)
SELECT profile, count(*) AS n, round(avg(CAST(rt IS NOT DISTINCT FROM pt AS INT)), 9) AS exact_text, round(avg(abs(px - rx)), 9) AS mae_x, round(avg(CAST(rt IS NOT DISTINCT FROM pt AND rx IS NOT DISTINCT FROM px AS INT)), 9) AS complete, count(*) FILTER (WHERE px <> rx) AS wrong_numbers, count(*) FILTER (WHERE pt IS NULL) + count(*) FILTER (WHERE px IS NULL) AS omissions FROM r GROUP BY 1""")
def degradation_profiles(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(spark, d, "orders").select((k % 4).alias("profile"), F.col("o_orderpriority").alias("r_t"), F.when(k % 9 == 0, None).when(k % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("p_t"), c.alias("r_x"), F.when(k % 11 != 0, c + F.when(k % 5 == 0, 3).otherwise(0)).alias("p_x"))
    return policies.profile_summary(r, "profile", "t", ["x"]).select("profile", "n", *(F.round(x, 9).alias(x) for x in ("exact_text", "mae_x", "complete")), "wrong_numbers", "omissions")


@query("""WITH c AS (SELECT s_suppkey AS k, v, CASE WHEN v = 0 THEN 2 + s_suppkey % 3 WHEN v = 1 THEN 2 + s_suppkey % 2 ELSE 1 END AS support FROM supplier, range(3) r(v)), f AS (SELECT k, v, support FROM c WHERE support >= 2 AND NOT (k % 5 = 0 AND v = 0)),
t AS (SELECT k, arg_max(v, (support, v)) AS v, max(support) AS s, count(*) FILTER (WHERE support = (SELECT max(support) FROM f g WHERE g.k = f.k)) AS ties FROM f GROUP BY k) SELECT s_suppkey AS case_id, CASE WHEN t.k IS NOT NULL AND ties = 1 THEN CAST(2 + t.v AS INT) ELSE 1 END AS intervals FROM supplier LEFT JOIN t ON s_suppkey = t.k""")
def supported_sections(spark: SparkSession, d: str) -> DataFrame:
    """Three sections a case, each longer than the last; the first lacks the first reading's interval now and then."""
    k = F.col("s_suppkey")
    piece = lambda i: F.struct(F.lit(float(i)).alias("top"), F.lit(float(i + 1)).alias("bottom"))
    s = table(spark, d, "supplier")
    section = lambda v: F.array(*(piece(i) for i in range(v + 2)))
    odd = F.array(piece(7), piece(8))
    rows = [(F.when(k % 5 == 0, odd).otherwise(section(0)), 2 + k % 3), (section(1), 2 + k % 2), (section(2), F.lit(1))]
    sections = s.select(k.alias("case_id"), F.explode(F.array(*(F.struct(x.alias("section"), n.cast("int").alias("support")) for x, n in rows))).alias("r")).select("case_id", "r.section", "r.support")
    return policies.unique_support(sections, s.select(k.alias("case_id"), F.array(piece(0)).alias("section"))).select("case_id", F.size("chosen").alias("intervals"))


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN 'peer_not_complete_or_unchanged' WHEN s_suppkey % 5 = 0 THEN 'peer_exact_highres_consensus' WHEN s_suppkey % 4 = 0 THEN 'first_pass_conflicts_with_peer' WHEN s_suppkey % 3 = 0 THEN 'peer_complementary_highres_consensus' ELSE 'insufficient_peer_corroboration' END AS decision FROM supplier""")
def peer_decisions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    piece = lambda a, b: F.struct(F.lit(float(a)).alias("top"), F.lit(float(b)).alias("bottom"))
    peer = F.when(k % 6 == 0, F.array(piece(0, 1), piece(1.5, 2))).otherwise(F.array(piece(0, 1), piece(1, 2)))
    first = F.when(k % 4 == 0, F.array(piece(5, 6))).otherwise(F.array(piece(0, 1)))
    supported = F.when(k % 3 == 0, F.array(piece(1, 2))).otherwise(F.array().cast("array<struct<top: double, bottom: double>>"))
    return table(spark, d, "supplier").select(k.alias("k"), policies.peer_decision(first, peer, supported, F.when(k % 5 == 0, 2).otherwise(1)).alias("decision"))


@query("""WITH n AS (SELECT o_custkey AS doc, concat(o_orderkey % 20, '.5') AS v, (o_orderkey % 7) / 10 AS c FROM orders UNION ALL SELECT o_custkey, CAST(o_orderkey % 3 AS VARCHAR), (o_orderkey % 7) / 10 FROM orders) SELECT doc, CAST(v AS DOUBLE) AS value, max(c) AS confidence FROM n GROUP BY doc, v""")
def number_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("bis "), (k % 20).cast("string"), F.lit(",5 m or "), (k % 3).cast("string")).alias("text"), ((k % 7) / 10).alias("confidence"))
    return policies.number_candidates(r, "ocr").select("doc", "value", "confidence")


@query("""WITH h AS (SELECT o_orderkey, sha256('freeze:' || o_custkey) AS h FROM orders), b AS (SELECT max(h) AS b FROM (SELECT DISTINCT h FROM h ORDER BY h LIMIT (SELECT CAST(round_even(count(DISTINCT h) * 0.3, 0) AS BIGINT) FROM h))) SELECT o_orderkey, CASE WHEN h <= b THEN 'development' ELSE 'heldout' END AS split FROM h, b""")
def frozen_split(spark: SparkSession, d: str) -> DataFrame:
    return policies.frozen_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 0.3, "freeze").select("o_orderkey", "split")


@query("""WITH e AS (SELECT value - floor(value) >= 0.6 AS a, event_type IN ('click', 'purchase') AS y FROM events) SELECT count(*) AS n, count(*) FILTER (WHERE a) AS accepted, count(*) FILTER (WHERE a AND y) AS exact, round(count(*) FILTER (WHERE a) / count(*), 9) AS coverage, round(count(*) FILTER (WHERE a AND y) / count(*) FILTER (WHERE a), 9) AS exact_rate FROM e""")
def accepted_policy(spark: SparkSession, d: str) -> DataFrame:
    p = policies.accepted_metrics(table(spark, d, "events"), F.col("value") - F.floor("value") >= 0.6, F.col("event_type").isin("click", "purchase"))
    return p.select("n", "accepted", "exact", F.round("coverage", 9).alias("coverage"), F.round("exact_rate", 9).alias("exact_rate"))


@query(f"""{WITH}, {PERDOC}, x AS (SELECT doc, predicted, matched, CASE WHEN doc % 3 > 0 THEN predicted ELSE 0 END AS accepted, CASE WHEN doc % 3 > 0 THEN matched ELSE 0 END AS ok FROM per)
SELECT CAST(sum(predicted) AS BIGINT) AS proposal, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(ok) AS BIGINT) AS accepted_correct, round(sum(matched) / CAST(sum(predicted) AS DOUBLE), 9) AS raw_precision, round(sum(ok) / CAST(sum(accepted) AS DOUBLE), 9) AS accepted_precision, round(sum(accepted) / CAST(sum(predicted) AS DOUBLE), 9) AS accepted_coverage,
round((sum(accepted) - sum(ok)) / CAST(sum(accepted) AS DOUBLE), 9) AS false_acceptance_rate, count(*) FILTER (WHERE accepted > 0) AS accepted_documents, round(count(*) FILTER (WHERE ok < accepted) / CAST(count(*) FILTER (WHERE accepted > 0) AS DOUBLE), 9) AS document_error_rate FROM x""")
def proposal_assurance(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.plans.catalog import per_document

    kept = F.col("doc") % 3 > 0
    p = per_document(spark, d).select(F.col("predicted").alias("proposal"), F.col("matched").alias("raw_correct"), F.when(kept, F.col("predicted")).otherwise(0).alias("accepted"), F.when(kept, F.col("matched")).otherwise(0).alias("accepted_correct"))
    a = policies.assurance(p)
    return a.select("proposal", "accepted", "accepted_correct", *(F.round(c, 9).alias(c) for c in ("raw_precision", "accepted_precision", "accepted_coverage", "false_acceptance_rate")), "accepted_documents", F.round("document_error_rate", 9).alias("document_error_rate"))


@query("""WITH c AS (SELECT o_custkey AS doc, (o_orderkey % 97) / 7.0 AS value, (o_orderkey % 10) / 10 AS p FROM orders), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc, round_even(value * 20, 0) ORDER BY p DESC, value) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY value) AS i FROM b)
SELECT a.doc, count(*) AS pairs, round(sum(b.value - a.value), 4) AS gaps, round(sum(least(a.p, b.p)), 4) AS lowest FROM n a JOIN n b ON a.doc = b.doc AND b.i > a.i AND b.i <= a.i + 4 AND b.value > a.value + 0.025 GROUP BY a.doc""")
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), ((k % 97) / 7.0).alias("value"), ((k % 10) / 10).alias("probability"))
    p = policies.ranked_pairs(c, 4)
    return p.groupBy("doc").agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("right") - F.col("left")), 4).alias("gaps"), F.round(F.sum("lowest"), 4).alias("lowest"))


@query("""WITH d AS (SELECT CAST(range AS BIGINT) AS doc, CAST(floor((('0x' || substr(sha256('9:n:' || range), 1, 8))::BIGINT) / 4294967296.0 * 5) AS BIGINT) + 2 AS n FROM range(400)), l AS (SELECT doc, CAST(unnest(range(0, n)) AS BIGINT) AS seq FROM d),
t AS (SELECT doc, seq, CAST(round(0.5 + 3.0 * ((('0x' || substr(sha256('9:t:' || doc || '/' || seq), 1, 8))::BIGINT) / 4294967296.0), 2) AS DECIMAL(8,2)) AS t FROM l) SELECT doc, CAST(seq AS INT) AS seq, CAST(sum(t) OVER (PARTITION BY doc ORDER BY seq) AS DOUBLE) AS bottom, CAST(t AS DOUBLE) AS thickness FROM t""")
def synthetic_boreholes(spark: SparkSession, d: str) -> DataFrame:
    s = policies.synthetic_boundaries(400, spark, 9)
    return s.select("doc", "seq", F.col("bottom").cast("double").alias("bottom"), F.col("thickness").cast("double").alias("thickness"))


@query(f"""{WITH}, n AS (SELECT doc, count(*) AS n, sum(CASE WHEN seq = 1 THEN 99.5 ELSE CAST(bottom AS DOUBLE) END) AS total FROM ref GROUP BY doc) SELECT CAST(doc AS VARCHAR) AS document_id, n AS intervals, round(total, 4) AS total, CASE WHEN n > 1 THEN 1 ELSE 0 END AS changed FROM n""")
def changed_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record's second bottom replaced by a candidate."""
    r = records.nest(reference_intervals(spark, d).withColumn("lithology", F.col("pk").cast("string")))
    changed = r.withColumn("intervals", policies.interval_with_candidate(F.col("intervals"), 1, "bottom_depth_m", F.lit("99.5"), F.lit("99,5 m"), F.lit(0.8), "REREAD"))
    value = lambda i: i["bottom_depth_m"]["value"].cast("double")
    new = F.filter("intervals", lambda i: F.array_contains(i["bottom_depth_m"]["warning_codes"], "REREAD") & (i["bottom_depth_m"]["validation_status"] == "needs_review"))
    return changed.select("document_id", F.size("intervals").cast("long").alias("intervals"), F.round(F.aggregate("intervals", F.lit(0.0), lambda a, i: a + value(i)), 4).alias("total"), F.size(new).alias("changed"))


@query("""SELECT doc_id % 20 AS doc, count(*) AS regions, CAST(sum(length(text)) AS BIGINT) AS characters, count(CASE WHEN doc_id % 7 > 0 THEN 1 END) AS confident, round(min(CASE WHEN doc_id % 7 > 0 THEN (doc_id % 11) / 10 END), 6) AS least, round(avg(CASE WHEN doc_id % 7 > 0 THEN (doc_id % 11) / 10 END), 6) AS mean, round(max(CASE WHEN doc_id % 7 > 0 THEN (doc_id % 11) / 10 END), 6) AS most FROM documents GROUP BY 1""")
def region_summaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    s = policies.region_summary(table(spark, d, "documents").select((k % 20).alias("doc"), "text", F.when(k % 7 > 0, (k % 11) / 10).alias("confidence")))
    return s.select("doc", "regions", "characters", "confident", *(F.round(c, 6).alias(c) for c in ("least", "mean", "most")))


@query("""WITH e AS (SELECT s_nationkey AS drawing, concat('k', s_suppkey % 3) AS kind, CASE s_suppkey % 4 WHEN 0 THEN upper(printf('%x', s_suppkey)) WHEN 1 THEN 'AB' WHEN 2 THEN NULL ELSE concat('1F', s_suppkey % 2) END AS h FROM supplier) SELECT drawing, kind, count(*) AS n, count(DISTINCT h) AS handles FROM e GROUP BY ALL""")
def entity_inventories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    h = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "0xab").when(k % 4 == 2, "").otherwise(F.concat(F.lit("1f"), (k % 2).cast("string")))
    return policies.entity_inventory(table(spark, d, "supplier").select(F.col("s_nationkey").alias("drawing"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("kind"), h.alias("handle")))


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS drawing, c_custkey % 20 AS id FROM customer WHERE c_custkey % 3 > 0), d AS (SELECT DISTINCT c_nationkey AS drawing, c_custkey % 20 AS id FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(s.drawing, d.drawing) AS drawing, count(s.id) AS source, count(*) FILTER (WHERE s.id IS NOT NULL AND d.id IS NOT NULL) AS drawn, count(*) FILTER (WHERE s.id IS NULL) AS extra,
round(count(*) FILTER (WHERE s.id IS NOT NULL AND d.id IS NOT NULL) / nullif(CAST(count(s.id) AS DOUBLE), 0), 9) AS share FROM s FULL JOIN d ON s.drawing = d.drawing AND s.id = d.id GROUP BY 1""")
def drawn_entities(spark: SparkSession, d: str) -> DataFrame:
    c = lambda where: table(spark, d, "customer").where(where).select(F.col("c_nationkey").alias("drawing"), (F.col("c_custkey") % 20).alias("id"))
    return policies.drawn_coverage(c("c_custkey % 3 > 0"), c("c_custkey % 2 = 0")).withColumn("share", F.round("share", 9))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    nodes = ref.select("doc", "seq", "ln", "pk", "top", "bottom").unionByName(a.select("doc", "seq", "ln", "pk", "top", "bottom"))
    return nodes.select("doc", (F.col("ln") % 3).alias("page"), (F.col("seq") / 10).alias("y"), "top", "bottom", (1 + F.col("pk") % 100 / 100).alias("node_score"))


_PLAIN = DECODE[: DECODE.index("best[j] + c[i + 1].s +")] + "best[j] + c[i + 1].s END)), -1e18))) FROM dp WHERE i < len(c))"


@query(f"WITH RECURSIVE {BASE_SQL}, {_PLAIN} SELECT doc, round(list_max(best), 6) AS score FROM dp WHERE i = len(c)")
def monotonic_decode(spark: SparkSession, d: str) -> DataFrame:
    """The same candidates decoded with the order alone."""
    return sequences.select_sequence(_paths(spark, d), sequences.monotonic_edge).groupBy("doc").agg(F.round(F.max("path_score"), 6).alias("score"))


@query(f"WITH RECURSIVE {BASE_SQL}, {DECODE.replace('0.0005', '0.05')} SELECT CAST(0.05 AS DOUBLE) AS penalty, count(*) AS documents, round(avg(list_max(best)), 5) AS mean_score FROM dp WHERE i = len(c)")
def start_penalty_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean objective where a deep start costs a hundred times as much."""
    s = sequences.select_sequence(_paths(spark, d), start_penalty=0.05).groupBy("doc").agg(F.max("path_score").alias("s"))
    return s.agg(F.lit(0.05).alias("penalty"), F.count("*").alias("documents"), F.round(F.avg("s"), 5).alias("mean_score"))


def _protocol_sql(m: float, rep: int) -> str:
    moved = f"(SELECT x, y, z + CASE WHEN (('0x' || substr(sha256('{rep}:side:' || id), 1, 8))::BIGINT) / 4294967296.0 < 0.5 THEN -{m} ELSE {m} END AS z FROM pts)"
    return f"SELECT CAST({m} AS DOUBLE) AS magnitude, {rep} AS rep, avg(abs(b.z - a.z)) AS mae FROM ({IDW.format(q='q', p='pts')}) a JOIN ({IDW.format(q='q', p=moved)}) b USING (qid)"


@query(f"WITH {QP}, pts AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS y, s_acctbal AS z FROM supplier), r AS (" + " UNION ALL ".join(_protocol_sql(m, rep) for m in (0.5, 2.0) for rep in (1, 2, 3)) + ") SELECT magnitude, count(*) AS n, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS deviation FROM r GROUP BY 1")
def perturbation_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Surface errors of scalars moved up or down, over magnitudes and repetitions."""
    p, q, out = points(spark, d, "supplier"), queries_points(spark, d), None
    base = spatial.idw(q, p)
    for m in (0.5, 2.0):
        for rep in (1, 2, 3):
            moved = spatial.idw(q, propagation.corrupt(p, m, 1.0, rep)).withColumnsRenamed({"qid": "b", "z": "bz"})
            e = spatial.error_summary(base.join(moved, F.col("qid") == F.col("b")).select((F.col("bz") - F.col("z")).alias("e")), "e").select(F.lit(m).alias("magnitude"), "mae")
            out = e if out is None else out.unionByName(e)
    return statistics.repeated_summary(out, "mae", ("magnitude",)).select("magnitude", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"{WITH}, g AS (SELECT doc, CAST(bottom AS DOUBLE) AS b, doc % 3 > 0 AS accepted FROM ref), p AS (SELECT doc, CAST(bottom AS DOUBLE) AS b, seq FROM pa), e AS (SELECT r.doc, r.doc % 3 > 0 AS accepted, abs(CAST(r.bottom - p.bottom AS DOUBLE)) AS e FROM ref r LEFT JOIN pa p ON r.doc = p.doc AND r.seq = p.seq) SELECT accepted, count(DISTINCT doc) AS documents, count(*) AS rows, count(e) AS read, round(avg(e), 6) AS mae FROM e GROUP BY 1")
def acceptance_groups(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.plans.catalog import paired

    e = paired(spark, d).withColumn("accepted", F.col("doc") % 3 > 0).withColumn("e", F.abs(F.col("rb") - F.col("pb")).cast("double"))
    return e.groupBy("accepted").agg(F.count_distinct("doc").alias("documents"), F.count("*").alias("rows"), F.count("e").alias("read"), F.round(F.avg("e"), 6).alias("mae"))


_ALL = f"""{CHECK_SQL}, b AS (SELECT doc, final_depth, CAST(doc % 40 - 2 AS DECIMAL(12,2)) AS water FROM finals), pc AS (SELECT doc, pk % 120 - 10 AS v FROM pa), co AS (SELECT o_orderkey AS doc, o_orderkey % 9 = 0 AS conf, CASE WHEN o_orderkey % 9 = 0 THEN concat(o_orderkey, 'O', o_orderkey) ELSE CAST(o_orderkey * 7 AS VARCHAR) END AS raw FROM orders),
cd AS (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY seq) AS nx FROM (SELECT doc, seq, ln AS n FROM pa WHERE pk % 10 > 0)), ty AS (SELECT doc, pk FROM pa),
e(c, doc, e, v) AS (SELECT 'C1_depth_validity', doc, evaluated, violations FROM counted WHERE "constraint" = 'C1_depth_order' UNION ALL SELECT 'C2_thickness_consistency', doc, evaluated, violations FROM counted WHERE "constraint" = 'C2_thickness'
UNION ALL SELECT 'C3_interval_continuity', g.doc, g.evaluated, g.violations + o.violations FROM counted g JOIN counted o ON g.doc = o.doc WHERE g."constraint" = 'C3_gap' AND o."constraint" = 'C3_overlap' UNION ALL SELECT 'C4_depth_monotonicity', doc, evaluated, violations FROM counted WHERE "constraint" = 'C4_monotone'
UNION ALL SELECT 'C5_final_depth_consistency', doc, evaluated, violations FROM counted WHERE "constraint" = 'C5_final_depth' UNION ALL SELECT 'C6_groundwater_reasonableness', doc, 2, CAST(water < 0 AS INT) + CAST(water > final_depth AS INT) FROM b
UNION ALL SELECT 'C7_percentage_range', doc, count(*), count(*) FILTER (WHERE v NOT BETWEEN 0 AND 100) FROM pc GROUP BY doc UNION ALL SELECT 'C8_coordinate_format', doc, 1, CAST(conf AS INT) + CAST(length(regexp_replace(raw, '[^0-9]', '', 'g')) NOT BETWEEN 4 AND 12 AS INT) FROM co
UNION ALL SELECT 'C9_stratum_code_sequence', d.doc, count(nx), count(*) FILTER (WHERE nx = n OR nx <> n + 1) FROM (SELECT DISTINCT doc FROM pa) d LEFT JOIN cd ON d.doc = cd.doc GROUP BY 2 UNION ALL SELECT 'C10_field_type_consistency', doc, 2 * count(*), count(*) FILTER (WHERE pk % 8 = 0) + count(*) FILTER (WHERE pk % 6 = 0) FROM ty GROUP BY doc)"""


@query(f"""{WITH}, {_ALL} SELECT c AS "constraint", CAST(sum(e) AS BIGINT) AS evaluated, CAST(sum(v) AS BIGINT) AS violations, count(*) FILTER (WHERE e > 0 AND v > 0) AS violated, count(*) FILTER (WHERE e > 0 AND v = 0) AS passed, count(*) FILTER (WHERE e = 0) AS not_evaluated FROM e GROUP BY 1""")
def engine_scores(spark: SparkSession, d: str) -> DataFrame:
    """All ten constraints over all documents in one call."""
    from strataframe.plans.catalog import finals

    ref, a, _ = channels(spark, d)
    k, pk = F.col("o_orderkey"), F.col("pk")
    water = (F.col("doc") % 40 - 2).cast("decimal(12,2)")
    raw = F.when(k % 9 == 0, F.concat(k.cast("string"), F.lit("O"), k.cast("string"))).otherwise((k * 7).cast("string"))
    tables = {
        "intervals": a.withColumn("code", F.when(pk % 10 == 0, "x").otherwise(F.col("ln").cast("string"))), "boreholes": finals(spark, d, ref).withColumn("water_depth", water),
        "coordinates": table(spark, d, "orders").select(k.alias("doc"), F.lit("x_coordinate").alias("field"), F.lit(None).cast("string").alias("value"), raw.alias("raw")), "percentages": a.select("doc", F.lit("rqd_percent").alias("field"), (pk % 120 - 10).alias("value")),
        "typed": a.select("doc", F.lit("text").alias("kind"), F.when(pk % 8 == 0, "12.5 m").otherwise("clay").alias("value"), F.lit(None).cast("string").alias("raw")).unionByName(a.select("doc", F.lit("number").alias("kind"), F.when(pk % 6 == 0, "fine sand").otherwise("3.5").alias("value"), F.lit(None).cast("string").alias("raw"))),
    }
    e = engine.evaluate(tables)
    return e.groupBy("constraint").agg(F.sum("evaluated").alias("evaluated"), F.sum("violations").alias("violations"), *(F.count_if(F.col("status") == s).alias(s) for s in ("violated", "passed", "not_evaluated")))


_SILVER = "CASE WHEN a = b THEN 'AGREEMENT' WHEN a = c THEN 'CORROBORATED_A' WHEN b = c THEN 'CORROBORATED_B' ELSE 'DISAGREEMENT_UNRESOLVED' END"


@query(f"""{WITH}, j AS (SELECT a.doc, a.seq, f, CASE f WHEN 'top' THEN a.top ELSE a.bottom END AS a, CASE f WHEN 'top' THEN b.top ELSE b.bottom END AS b, CASE f WHEN 'top' THEN c.top ELSE c.bottom END AS c FROM pa a JOIN pb b ON a.doc = b.doc AND a.seq = b.seq LEFT JOIN (SELECT * FROM ref WHERE pk % 19 > 0) c ON a.doc = c.doc AND a.seq = c.seq, (VALUES ('top'), ('bottom')) t(f))
SELECT f AS field, {_SILVER} AS status, count(*) AS n, round(sum(CAST(CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS DOUBLE)), 2) AS total FROM j GROUP BY ALL""")
def silver_values(spark: SparkSession, d: str) -> DataFrame:
    ref, a, b = channels(spark, d)
    v = policies.silver_values(a, b, ref.where("pk % 19 > 0"), ["doc", "seq"], ["top", "bottom"])
    return v.groupBy("field", "status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query(f"""{WITH}, {PERDOC}, g AS (SELECT substr(sha256(CAST(doc % 50 AS VARCHAR)), 1, 8) AS content, matched, predicted, referred FROM per) SELECT content, count(*) AS documents, round(coalesce(sum(matched) / nullif(CAST(sum(predicted) AS DOUBLE), 0), 0), 9) AS "precision", round(coalesce(sum(matched) / nullif(CAST(sum(referred) AS DOUBLE), 0), 0), 9) AS recall FROM g GROUP BY 1""")
def content_groups(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.plans.catalog import per_document

    g = per_document(spark, d).withColumn("content", F.substring(F.sha2((F.col("doc") % 50).cast("string").cast("binary"), 256), 1, 8))
    s = g.groupBy("content").agg(F.count("*").alias("documents"), *(F.sum(c).alias(c) for c in ("matched", "predicted", "referred")))
    return s.select("content", "documents", *statistics.prf(F.col("matched"), F.col("predicted"), F.col("referred"))[:2]).select("content", "documents", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""{WITH}, {PERDOC}, r AS (SELECT seed, per.*, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || doc)) AS k FROM per, range(5) s(seed)), f AS (SELECT seed, 2.0 * sum(matched) / (sum(predicted) + sum(referred)) AS f1 FROM r WHERE k <= 300 GROUP BY seed) SELECT count(*) AS n, round(avg(f1), 9) AS mean, round(stddev_samp(f1), 9) AS deviation, round(min(f1), 9) AS least, round(max(f1), 9) AS most FROM f""")
def random_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """F1 over five random cohorts of 300 documents (the feature is the sample)."""
    from strataframe.plans.catalog import per_document

    c = policies.random_cohorts(per_document(spark, d), "doc", 5, 300).groupBy("seed").agg(*(F.sum(x).alias(x) for x in ("matched", "predicted", "referred")))
    f = c.select(statistics.prf(F.col("matched"), F.col("predicted"), F.col("referred"))[2])
    return f.agg(F.count("*").alias("n"), *(F.round(x("f1"), 9).alias(n) for x, n in ((F.avg, "mean"), (F.stddev_samp, "deviation"), (F.min, "least"), (F.max, "most"))))


@query("""WITH c AS (SELECT (value - floor(value)) * 0.6 AS p, CAST(event_type = 'click' AS INT) AS y FROM events), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS c, avg(CAST(y AS DOUBLE)) AS a FROM c GROUP BY 1) SELECT CAST(r.k AS INT) AS bin, coalesce(n, 0) AS n, round(c, 9) AS confidence, round(a, 9) AS accuracy FROM range(10) r(k) LEFT JOIN b ON b.bin = r.k""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(((F.col("value") - F.floor("value")) * 0.6).alias("p"), (F.col("event_type") == "click").cast("int").alias("y"))
    return policies.all_bins(e, "p", "y").select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@query("SELECT concat_ws('|', o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE CAST(o_orderkey % 3 AS VARCHAR) END) AS signature, count(*) AS n FROM orders GROUP BY 1")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return table(spark, d, "orders").groupBy(policies.signature([F.col("o_orderstatus"), F.when(k != 0, k)]).alias("signature")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS doc, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS valid, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS invalid, round(CAST((o_orderkey % 9 + 3) * 0.3048 + CASE WHEN o_orderkey % 2 = 0 THEN 2.5 * 0.3048 ELSE 0 END AS DOUBLE), 6) AS depth FROM orders""")
def json_interval_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.concat(F.lit('{"intervals": [{"top_depth_source": 0, "bottom_depth_source": '), (k % 9 + 3).cast("string"), F.lit("}, {\"top_depth_source\": 1, \"bottom_depth_source\": "), F.when(k % 2 == 0, "2.5").otherwise('"2.5"'), F.lit('}, {"top_depth_source": true, "bottom_depth_source": 3}, 5]}'))
    rows, n = policies.json_intervals(table(spark, d, "orders").select(k.alias("doc"), p.alias("payload")), 0.3048)
    depth = rows.groupBy(F.col("doc").alias("r_doc")).agg(F.round(F.sum("bottom"), 6).alias("depth"))
    return n.join(depth, F.col("doc") == F.col("r_doc")).select("doc", "valid", "invalid", "depth")


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 > 0 THEN p_size * 0.3048 END, 6) AS metres FROM part")
def unit_references(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(policies.metres_of(F.when(k % 2 == 0, s), F.when(k % 3 > 0, s)), 6).alias("metres"))


@query("""WITH t AS (SELECT o_custkey AS doc, CAST(o_orderkey % 30 AS DOUBLE) AS top, CAST(o_orderkey % 30 + o_orderkey % 4 AS DOUBLE) AS bottom, CASE WHEN o_orderkey % 2 = 0 THEN 'basalt' ELSE 'sediment' END AS name FROM orders UNION SELECT DISTINCT o_custkey, 25.0, 40.0, 'basalt' FROM orders) SELECT doc, count(*) AS n, round(sum(bottom - top), 4) AS depth FROM (SELECT DISTINCT * FROM t WHERE bottom > top) GROUP BY 1""")
def told_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals told in prose, one of them open downwards."""
    k = F.col("o_orderkey")
    line = F.concat((k % 30).cast("string"), F.lit(" to "), (k % 30 + k % 4).cast("string"), F.lit(" ft "), F.when(k % 2 == 0, "Basalt").otherwise("Sediment"))
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.concat(F.array_join(F.collect_list(line), "; "), F.lit("; 25 ft to bottom Basalt")).alias("text")).withColumn("final", F.lit(40.0))
    r = policies.text_intervals(t, r"([0-9.]+) to ([0-9.]+) ft ([A-Za-z]+)", r"([0-9.]+) ft to bottom ([A-Za-z]+)", "final")
    return r.groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum(F.col("bottom") - F.col("top")), 4).alias("depth"))


@query(f"""{WITH}, n AS (SELECT doc, count(*) AS n, sum(CAST(bottom AS DOUBLE)) AS b FROM ref GROUP BY doc) SELECT substr(sha256('freeze' || doc), 1, 20) AS record_key, n, round(b, 4) AS bottoms FROM n""")
def public_pools(spark: SparkSession, d: str) -> DataFrame:
    p = policies.public_pools(reference_intervals(spark, d).select("doc", (F.col("ln") % 3).alias("page"), (F.col("seq") / 10).alias("y"), "top", "bottom", F.lit(1.0).alias("node_score")), "doc", "freeze")
    return p.select("record_key", F.size("pool").cast("long").alias("n"), F.round(F.aggregate("pool", F.lit(0.0), lambda a, x: a + x["bottom"]), 4).alias("bottoms"))


@query("SELECT coalesce(CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END, 'missing') AS eligibility, count(*) AS n, coalesce(CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END, 'missing') IN ('1-URGENT', '2-HIGH') AS formal FROM orders GROUP BY 1, 3")
def index_readiness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("eligibility"))
    return policies.index_readiness(o, ("1-URGENT", "2-HIGH"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer')")
def chosen_rows(spark: SparkSession, d: str) -> DataFrame:
    return policies.chosen_rows(table(spark, d, "customer"), {"c_mktsegment": "BUILDING"}, {"c_name": "Customer"}).select("c_custkey")


@query(f"""{WITH}, {PERDOC}, e AS (SELECT r.doc, sum(abs(CAST(r.top - p.top AS DOUBLE))) AS err, count(p.top) AS n FROM ref r LEFT JOIN pa p ON r.doc = p.doc AND r.seq = p.seq GROUP BY r.doc), per2 AS (SELECT doc, coalesce(err, 0) AS matched, n AS predicted, 0 AS referred FROM e), {{weights}}, t AS (SELECT rep, sum(matched * w) / sum(predicted * w) AS v FROM drawn GROUP BY rep)
SELECT count(*) AS repetitions, round(avg(v), 6) AS mean_mae, round(quantile_cont(v, 0.025), 6) AS low_mae, round(quantile_cont(v, 0.975), 6) AS high_mae FROM t""".replace("{weights}", WEIGHTS.replace("FROM per)", "FROM per2)")))
def bootstrap_mae(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean error over resampled documents."""
    from strataframe.plans.catalog import paired

    p = paired(spark, d).groupBy("doc").agg(F.coalesce(F.sum(F.abs(F.col("rt") - F.col("pt")).cast("double")), F.lit(0.0)).alias("err"), F.count("pt").alias("n"))
    s = statistics.resampled_sums(p, ["err", "n"], REPETITIONS)
    b = statistics.interval(s, F.try_divide("err", "n"), "mae")
    return b.select("repetitions", *(F.round(c, 6).alias(c) for c in ("mean_mae", "low_mae", "high_mae")))


@query("""WITH t AS (SELECT o_orderpriority AS doc, o_orderkey % 3 = 0 AS a, o_orderkey % 4 = 0 AS b FROM orders) SELECT doc, count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM t GROUP BY ROLLUP (doc)""")
def engine_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return policies.engine_table(table(spark, d, "orders"), "o_orderpriority", k % 3 == 0, k % 4 == 0)


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS name, CAST(sum(c_custkey % 4) AS BIGINT) AS actions, count(*) FILTER (WHERE c_custkey % 4 > 0) AS documents, round(1 - pow(0.05, 1.0 / nullif(sum(c_custkey % 4), 0)), 9) AS action_bound, round(1 - pow(0.05, 1.0 / nullif(count(*) FILTER (WHERE c_custkey % 4 > 0), 0)), 9) AS document_bound FROM customer GROUP BY 1""")
def risk_certificates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("name"), (F.col("c_custkey") % 4).alias("actions"), F.lit(0).alias("errors"))
    return policies.certificate(c).withColumns({n: F.round(n, 9) for n in ("action_bound", "document_bound")})


@query("""WITH c AS (SELECT o_custkey, concat('s', o_orderkey % 3) AS source FROM orders), v(variant, out_) AS (VALUES ('full', ''), ('minus_a', 's0'), ('minus_b', 's1')) SELECT variant, count(*) AS candidates, count(DISTINCT o_custkey) AS cases FROM c, v WHERE source <> out_ GROUP BY 1""")
def source_ablation(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.plans.catalog import candidates

    v = policies.without_sources(candidates(spark, d), {"full": [], "minus_a": ["s0"], "minus_b": ["s1"]})
    return v.groupBy("variant").agg(F.count("*").alias("candidates"), F.count_distinct("case_id").alias("cases"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 'expert' ELSE 'baseline' END AS route FROM supplier")
def routed_values(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return policies.routed(s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), s, "s_suppkey", "s_acctbal")


@query("WITH f AS (SELECT n_nationkey AS k, avg(s_acctbal) - 4000 AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT count(*) AS folds, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v > 0) AS positive, round(min(v), 6) AS least FROM f")
def fold_summaries(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").groupBy("s_nationkey").agg((F.avg("s_acctbal") - 4000).alias("v"))
    return policies.fold_summary(f, "v").select("folds", F.round("mean", 6).alias("mean"), "positive", F.round("least", 6).alias("least"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 3 < 2) AS role_evidence FROM orders GROUP BY 1")
def role_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.array(F.lit("text"), F.element_at(F.array(*map(F.lit, ("graphic_log", "core", "other"))), (k % 3 + 1).cast("int")))
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(k.alias("id"), p.alias("provenance"))).alias("candidates"))
    return policies.role_evidence(c, ["graphic_log", "core"]).select("o_custkey", F.col("role_evidence").cast("long").alias("role_evidence"))


@query("""SELECT s_suppkey AS doc, concat('10.1/s', s_suppkey) AS doi, CASE WHEN s_suppkey % 3 > 0 THEN concat('Title ', s_suppkey) ELSE '' END AS title, CAST(2000 + s_suppkey % 20 AS INT) AS year, CASE WHEN s_suppkey % 2 = 0 THEN 'cc-by,cc0' ELSE 'cc0' END AS rights FROM supplier""")
def dataset_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    title = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit('{"title": "Title '), k, F.lit('"}, {"title": "other"}'))).otherwise("")
    more = F.when(F.col("s_suppkey") % 2 == 0, ', {"rightsIdentifier": "cc-by"}').otherwise(', {"other": 1}')
    a = F.concat(F.lit('{"id": "x", "attributes": {"doi": "10.1/S'), k, F.lit('", "titles": ['), title, F.lit('], "publicationYear": '), (2000 + F.col("s_suppkey") % 20).cast("string"), F.lit(', "rightsList": [{"rightsIdentifier": "cc0"}, {"rightsIdentifier": "cc0"}'), more, F.lit("]}}"))
    r = policies.dataset_records(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), a.alias("answer")))
    return r.select("doc", "doi", "title", "year", F.array_join("rights", ",").alias("rights"))
