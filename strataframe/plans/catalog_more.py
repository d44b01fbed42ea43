"""Further named queries: sequences, layout, readiness and remaining metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as T
from strataframe.operators import layout, matching, readiness, sequences, statistics
from strataframe.plans.catalog import CASES, HASH, PAIRED, PERDOC, PTS, WITH, cases, channels, paired, per_document, query
from strataframe.plans.fixtures import BASE_SQL, points, reference_intervals, table
from strataframe.streaming import review


#: Best value of a path to each node in turn, over all nodes before it.
DECODE = """nodes AS (SELECT doc, list(struct_pack(page := page, y := y, t := t, b := b, s := s) ORDER BY page, y, t, b, s) AS c FROM (
  SELECT doc, ln % 3 AS page, seq / 10 AS y, CAST(top AS DOUBLE) AS t, CAST(bottom AS DOUBLE) AS b, 1 + (pk % 100) / 100 AS s FROM ref UNION ALL SELECT doc, ln % 3, seq / 10, CAST(top AS DOUBLE), CAST(bottom AS DOUBLE), 1 + (pk % 100) / 100 FROM pa) GROUP BY doc),
dp AS (SELECT doc, c, 1 AS i, [c[1].s - 0.0005 * c[1].t] AS best FROM nodes UNION ALL SELECT doc, c, i + 1, list_append(best, greatest(c[i + 1].s - 0.0005 * c[i + 1].t, coalesce(list_max(list_transform(range(1, i + 1), lambda j:
  CASE WHEN (c[i + 1].page > c[j].page OR (c[i + 1].page = c[j].page AND c[i + 1].y > c[j].y)) AND c[i + 1].t >= c[j].t AND c[j].b - c[i + 1].t <= 1.0 THEN best[j] + c[i + 1].s +
  CASE WHEN abs(c[j].b - c[i + 1].t) <= 0.05 THEN 5.0 WHEN abs(c[j].b - c[i + 1].t) <= 1.0 THEN 2.0 - abs(c[j].b - c[i + 1].t) ELSE -least(6.0, ln(1 + abs(c[j].b - c[i + 1].t))) END END)), -1e18))) FROM dp WHERE i < len(c))"""


@query(f"WITH RECURSIVE {BASE_SQL}, {DECODE} SELECT doc, round(list_max(best), 6) AS score FROM dp WHERE i = len(c)")
def sequence_decode(spark: SparkSession, d: str) -> DataFrame:
    """Objective of the best path through each document's candidates, taken along the path that was found."""
    ref, a, _ = channels(spark, d)
    nodes = ref.select("doc", "seq", "ln", "pk", "top", "bottom").unionByName(a.select("doc", "seq", "ln", "pk", "top", "bottom"))
    c = nodes.select("doc", (F.col("ln") % 3).alias("page"), (F.col("seq") / 10).alias("y"), "top", "bottom", (1 + F.col("pk") % 100 / 100).alias("node_score"))
    return sequences.select_sequence(c).groupBy("doc").agg(F.round(F.max("path_score"), 6).alias("score"))


@query(f"""{WITH}, s AS (SELECT doc, seq, CAST(top AS DOUBLE) AS t, CAST(bottom AS DOUBLE) AS b, lead(top) OVER w - bottom AS gap, lag(seq) OVER w IS NULL AS f, top FROM pa WINDOW w AS (PARTITION BY doc ORDER BY seq))
SELECT doc, bool_or(f AND abs(top) <= 0.05) AS from_zero, coalesce(bool_and(abs(gap) <= 0.05), true) AS contiguous, round(count(*) FILTER (WHERE abs(gap) <= 0.05) / nullif(CAST(count(gap) AS DOUBLE), 0), 9) AS share, count(*) AS n FROM s GROUP BY doc""")
def sequence_completeness(spark: SparkSession, d: str) -> DataFrame:
    _, a, _ = channels(spark, d)
    return sequences.complete(a).withColumn("share", F.round("share", 9))


@query(f"""WITH RECURSIVE {BASE_SQL}, own AS (SELECT doc, list(struct_pack(t := CAST(top AS DOUBLE), b := CAST(bottom AS DOUBLE)) ORDER BY seq) AS o FROM pa GROUP BY doc),
new AS (SELECT doc, list(struct_pack(t := CAST(top AS DOUBLE), b := CAST(bottom AS DOUBLE)) ORDER BY (pk % 100) / 100 DESC, top, bottom) AS c FROM pb WHERE (pk % 100) / 100 >= 0.5 GROUP BY doc),
met AS (SELECT coalesce(own.doc, new.doc) AS doc, coalesce(o, []) AS o, coalesce(c, []) AS c FROM own FULL JOIN new ON own.doc = new.doc),
fold AS (SELECT doc, CASE WHEN list_bool_or(list_transform(range(1, len(o)), lambda i: o[i + 1].t < o[i].t)) THEN [] ELSE c END AS c, o AS chosen, 0 AS i FROM met
UNION ALL SELECT doc, c, CASE WHEN len(list_filter(chosen, lambda x: x.t < c[i + 1].b AND c[i + 1].t < x.b)) = 0 THEN list_append(chosen, c[i + 1]) ELSE chosen END, i + 1 FROM fold WHERE i < len(c))
SELECT doc, CAST(len(chosen) AS BIGINT) AS n, round(list_sum(list_transform(chosen, lambda x: x.b - x.t)), 4) AS depth FROM fold WHERE i = len(c)""")
def risk_policy_additions(spark: SparkSession, d: str) -> DataFrame:
    _, a, b = channels(spark, d)
    c = b.select("doc", "top", "bottom", (F.col("pk") % 100 / 100).alias("score"))
    return sequences.add_without_overlap(a, c, 0.5).groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum(F.col("bottom") - F.col("top")), 4).alias("depth"))


@query(f"""WITH RECURSIVE {BASE_SQL}, r AS (SELECT doc, CAST(top AS DOUBLE) AS t, CAST(bottom AS DOUBLE) AS b, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i FROM pa),
fold AS (SELECT doc, CAST(0 AS BIGINT) AS i, CAST(-1e300 AS DOUBLE) AS e, CAST(0 AS BIGINT) AS kept FROM (SELECT DISTINCT doc FROM pa) UNION ALL
SELECT f.doc, r.i, CASE WHEN t >= 0 AND b > t AND t >= e - 0.05 THEN b ELSE e END, kept + CASE WHEN t >= 0 AND b > t AND t >= e - 0.05 THEN 1 ELSE 0 END FROM fold f JOIN r ON r.doc = f.doc AND r.i = f.i + 1)
SELECT doc, max(kept) AS kept FROM fold GROUP BY doc""")
def monotone_filter(spark: SparkSession, d: str) -> DataFrame:
    _, a, _ = channels(spark, d)
    return sequences.monotone_subset(a).select("doc", F.size("kept").cast("long").alias("kept"))


@query(f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY doc, CAST(round_even(CAST(top AS DOUBLE), 0) AS BIGINT) ORDER BY top, bottom, pk, sk, ln) AS k FROM pa) SELECT doc, count(*) AS n, CAST(sum(pk) AS BIGINT) AS keys FROM r WHERE k = 1 GROUP BY doc""")
def dedup_rounded(spark: SparkSession, d: str) -> DataFrame:
    _, a, _ = channels(spark, d)
    one = sequences.first_of(a, [F.col("doc"), F.bround(F.col("top").cast("double"), 0).cast("long")], [F.col(c) for c in ("top", "bottom", "pk", "sk", "ln")])
    return one.groupBy("doc").agg(F.count("*").alias("n"), F.sum("pk").alias("keys"))


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), j AS (SELECT user_id, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS jump FROM g) SELECT user_id, CAST(sum(jump) + 1 AS BIGINT) AS runs FROM j GROUP BY 1""")
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = sequences.split_runs(table(spark, d, "events").select("user_id", t.alias("t")), "user_id", "t", 86400)
    return r.groupBy("user_id").agg((F.max("run") + 1).alias("runs"))


@query("""SELECT CAST(doc_id % 50 AS BIGINT) AS page, CAST(doc_id % 7 AS BIGINT) AS line, min(n_chars) AS x0, max(n_chars) AS x1, string_agg(lang, ' ' ORDER BY n_chars, lang) AS text, round(avg(CASE WHEN doc_id % 11 > 0 THEN (doc_id % 11) / 100 END), 9) AS confidence FROM documents GROUP BY 1, 2""")
def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    w = table(spark, d, "documents").select((k % 50).alias("page"), (k % 7).alias("line"), F.col("n_chars").alias("x0"), F.lit(0).alias("y0"), F.col("n_chars").alias("x1"), F.lit(1).alias("y1"), F.col("lang").alias("text"), F.when(k % 11 > 0, k % 11).otherwise(-1).alias("confidence"))
    return layout.lines_of_words(w).select("page", "line", "x0", "x1", "text", F.round("confidence", 9).alias("confidence"))


NUM = "num AS (SELECT p_partkey % 5 AS page, CAST(p_partkey * 31 % 997 AS DOUBLE) AS cx, CAST(p_partkey * 17 % 1009 AS DOUBLE) AS cy, p_retailprice AS value FROM part)"


@query(f"""WITH {NUM}, j AS (SELECT a.page, a.cx, a.cy, a.value AS top, arg_min(b.value, (b.cx - a.cx, abs(b.cy - a.cy), b.value)) AS bottom FROM num a JOIN num b ON a.page = b.page AND b.cx - a.cx BETWEEN 12 AND 140 AND abs(b.cy - a.cy) <= 40 AND a.value < b.value GROUP BY ALL) SELECT page, cx, cy, top, bottom FROM j""")
def spatial_depth_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = table(spark, d, "part").select((k % 5).alias("page"), (k * 31 % 997).cast("double").alias("cx"), (k * 17 % 1009).cast("double").alias("cy"), F.col("p_retailprice").alias("value"))
    return layout.depth_pairs(n, 12, 140, 40)


@query("""WITH p AS (SELECT doc_id % 60 AS doc, CASE WHEN n_chars >= 300 THEN 'native' WHEN doc_id % 9 = 0 THEN 'scanned' WHEN n_chars > 100 THEN 'native' ELSE 'scanned' END AS kind FROM documents)
SELECT doc, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS document_kind, count(*) AS pages FROM p GROUP BY doc""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    p = table(spark, d, "documents").select((k % 60).alias("doc"), layout.page_kind(F.when(n > 100, n).otherwise(0), F.when(k % 9 == 0, 2_000_000).otherwise(0)).alias("kind"))
    return layout.document_kind(p, "doc")


@query("SELECT doc_id, len(range(0, greatest(n_chars - 100, 1), 400)) AS tiles, least((len(range(0, greatest(n_chars - 100, 1), 400)) - 1) * 400 + 500, n_chars) AS end_of_last FROM documents")
def page_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", layout.tiles(F.col("n_chars").cast("int"), 500, 100).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tiles"), F.element_at("t", -1)["end"].cast("long").alias("end_of_last"))


@query("SELECT event_type, CASE WHEN regr_slope(value, event_id) > 0 THEN round(regr_slope(value, event_id), 9) END AS slope, CASE WHEN regr_slope(value, event_id) > 0 THEN round(regr_intercept(value, event_id), 5) END AS intercept, count(*) AS n FROM events GROUP BY 1")
def depth_scale_fit(spark: SparkSession, d: str) -> DataFrame:
    f = layout.fit_scale(table(spark, d, "events"), "event_type", "event_id", "value")
    return f.select("event_type", F.round("slope", 9).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


@query("""WITH g AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'status:' || o_orderstatus END, CASE WHEN o_totalprice < 50000 THEN 'price:low' END, CASE WHEN o_custkey % 7 = 0 THEN 'source:excluded' END], lambda x: x IS NOT NULL) AS r FROM orders)
SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM g) GROUP BY 1""")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    g = readiness.gate(o, {"status:open": F.col("o_orderstatus") != "F", "price:low": F.col("o_totalprice") < 50000, "source:excluded": F.col("o_custkey") % 7 == 0})
    return readiness.reason_histogram(g)


@query(f"{WITH} SELECT count(*) FILTER (WHERE a.doc IS NOT NULL AND b.doc IS NOT NULL) AS \"both\", count(*) FILTER (WHERE b.doc IS NULL) AS first_only, count(*) FILTER (WHERE a.doc IS NULL) AS second_only, count(*) FILTER (WHERE a.bottom = b.bottom) AS equal, count(*) FILTER (WHERE a.bottom <> b.bottom) AS unequal FROM pa a FULL JOIN pb b ON a.doc = b.doc AND a.seq = b.seq")
def reader_agreement(spark: SparkSession, d: str) -> DataFrame:
    _, a, b = channels(spark, d)
    return readiness.agreement(a, b, ["doc", "seq"], "bottom")


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0), f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT coalesce(e.k, f.k) AS k, CASE WHEN n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM e FULL JOIN f ON e.k = f.k WHERE n IS NULL OR e.k IS NULL OR n > 1""")
def coverage_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    return readiness.coverage_guard(e, table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k")), ["k"])


@query("""SELECT o_custkey, arg_min(o_orderstatus, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END) AS status, count(DISTINCT CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END) > 1 AS status_conflict FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1
UNION ALL SELECT o_custkey, NULL, false FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 4 > 0) = 0""")
def merge_headers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("status"))
    return readiness.merge_first(o, "o_custkey", "o_orderkey", ["status"])


@query("SELECT c_custkey, substr(sha256('pepper' || c_custkey), 1, 20) AS pseudonym FROM customer")
def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", readiness.pseudonym(F.col("c_custkey"), "pepper").alias("pseudonym"))


@query(f"""{WITH}, x AS (SELECT doc, true AS a, thickness >= 1 AS b, thickness >= 1 AND bottom <= 20 AS c FROM ref)
SELECT 0 AS step, 'all' AS name, count(DISTINCT doc) AS documents, count(*) AS rows FROM x UNION ALL SELECT 1, 'thick', count(DISTINCT doc) FILTER (WHERE b), count(*) FILTER (WHERE b) FROM x UNION ALL SELECT 2, 'shallow', count(DISTINCT doc) FILTER (WHERE c), count(*) FILTER (WHERE c) FROM x""")
def selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    return readiness.funnel(reference_intervals(spark, d), {"all": F.lit(True), "thick": F.col("thickness") >= 1, "shallow": F.col("bottom") <= 20}, "doc")


@query(f"{WITH}, {PERDOC} SELECT count(*) AS documents, count(*) FILTER (WHERE predicted = 0) AS silent, count(*) FILTER (WHERE matched = referred AND predicted = referred) AS exact, round(avg(CASE WHEN matched > 0 THEN 1.0 ELSE 0.0 END), 9) AS hit FROM per")
def document_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    p = per_document(spark, d)
    return p.agg(F.count("*").alias("documents"), F.count_if(F.col("predicted") == 0).alias("silent"), F.count_if((F.col("matched") == F.col("referred")) & (F.col("predicted") == F.col("referred"))).alias("exact"), F.round(F.avg((F.col("matched") > 0).cast("double")), 9).alias("hit"))


@query(f"""{WITH}, s AS (SELECT r.doc, r.seq, r.top AS r_top, a.top AS a_top, b.top AS b_top FROM ref r LEFT JOIN pa a USING (doc, seq) LEFT JOIN pb b USING (doc, seq))
SELECT count(*) FILTER (WHERE abs(a_top - b_top) <= 0.02) AS accepted, count(*) FILTER (WHERE abs(a_top - b_top) <= 0.02 AND abs(a_top - r_top) <= 0.02) AS correct, count(*) AS n FROM s""")
def consensus_abstention(spark: SparkSession, d: str) -> DataFrame:
    ref, a, b = channels(spark, d)
    s = ref.select("doc", "seq", F.col("top").alias("rt")).join(a.select("doc", "seq", F.col("top").alias("at")), ["doc", "seq"], "left").join(b.select("doc", "seq", F.col("top").alias("bt")), ["doc", "seq"], "left")
    tol = F.lit("0.02").cast("decimal(4,2)")
    same = F.coalesce(F.abs(F.col("at") - F.col("bt")) <= tol, F.lit(False))
    return s.agg(F.count_if(same).alias("accepted"), F.count_if(same & (F.abs(F.col("at") - F.col("rt")) <= tol)).alias("correct"), F.count("*").alias("n"))


@query(f"{WITH}, {PAIRED} SELECT count(*) FILTER (WHERE pt IS NULL) AS lost, count(*) FILTER (WHERE rt IS NOT DISTINCT FROM pt AND rb IS NOT DISTINCT FROM pb) AS exact, count(*) FILTER (WHERE (rt <> pt) <> (rb <> pb)) AS one_side, count(*) FILTER (WHERE rt <> pt AND rb <> pb) AS both_sides FROM paired")
def correction_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    top, bottom = F.col("rt") != F.col("pt"), F.col("rb") != F.col("pb")
    return paired(spark, d).agg(F.count_if(F.col("pt").isNull()).alias("lost"), F.count_if(~top & ~bottom).alias("exact"), F.count_if(top != bottom).alias("one_side"), F.count_if(top & bottom).alias("both_sides"))


@query(f"WITH {PTS}, c AS (SELECT id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM p) SELECT id, round(x * 0.9563047559630354 - y * 0.29237170472273677, 6) AS x, round(x * 0.29237170472273677 + y * 0.9563047559630354, 6) AS y FROM c")
def rotated_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d, "supplier")
    c = p.join(F.broadcast(p.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    cos, sin = 0.9563047559630354, 0.29237170472273677  # 17 degrees
    return c.select("id", F.round(x * cos - y * sin, 6).alias("x"), F.round(x * sin + y * cos, 6).alias("y"))


@query(f"SELECT o_orderkey, CAST({HASH.format(salt='order', c='o_orderkey')} AS BIGINT) AS place FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {HASH.format(salt='order', c='o_orderkey')}, o_orderkey) = 1")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    from strataframe.operators.splits import hash_number

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", hash_number(F.col("o_orderkey"), "order").alias("place"))
    return sequences.first_of(o, [F.col("o_custkey")], [F.col("place"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query(f"WITH {CASES} SELECT event_id, CAST(p * 0.5 AS DOUBLE) >= 0.25 AS accepted, CASE WHEN p >= 0.5 AND y = 1 THEN 'correct' WHEN p >= 0.5 THEN 'false' WHEN y = 1 THEN 'missed' ELSE 'rejected' END AS outcome FROM cases")
def selective_outcomes(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    ok, y = F.col("p") >= 0.5, F.col("y") == 1
    return c.select("event_id", ok.alias("accepted"), F.when(ok & y, "correct").when(ok, "false").when(y, "missed").otherwise("rejected").alias("outcome"))


@query("SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(14,4)) * 0.3048 AS DOUBLE) AS metres FROM part")
def feet_to_metres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.feet_to_metres(F.col("p_size")).cast("double").alias("metres"))


@query("""WITH s AS (SELECT ts, user_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM s)
SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM g GROUP BY 1""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = review.session_counts(table(spark, d, "events"), "user_id", "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return review.windowed_counts(table(spark, d, "events"), "3 hours", "1 hour").select("start", "event_type", "n")


@query(f"""{WITH}, a AS (SELECT doc, count(*) AS n, CAST(sum(thickness) AS DOUBLE) AS depth FROM ref GROUP BY doc) SELECT n, count(*) AS documents, round(avg(depth), 6) AS mean, round(quantile_cont(depth, 0.5), 6) AS median, round(quantile_cont(depth, 0.9), 6) AS p90, round(min(depth), 6) AS least, round(max(depth), 6) AS most FROM a GROUP BY n""")
def depth_profile(spark: SparkSession, d: str) -> DataFrame:
    a = reference_intervals(spark, d).groupBy("doc").agg(F.count("*").alias("k"), F.sum("thickness").cast("double").alias("depth"))
    p = statistics.profile(a, "depth", ("k",))
    return p.select(F.col("k").alias("n"), F.col("n").alias("documents"), *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "least", "most")))


@query(f"""{WITH}, m AS (SELECT r.doc, count(*) AS tp FROM ref r JOIN pa p ON r.doc = p.doc AND r.top = p.top AND r.bottom = p.bottom GROUP BY r.doc) SELECT CAST(sum(tp) AS BIGINT) AS tp, (SELECT count(*) FROM ref) AS refs, (SELECT count(*) FROM pa) AS preds FROM m""")
def exact_interval_set(spark: SparkSession, d: str) -> DataFrame:
    ref, a, _ = channels(spark, d)
    return matching.interval_metrics(ref, a, matching.match_intervals(ref, a, "0")).select("tp", "refs", "preds")
