"""Operators on small tables with known answers."""

import itertools
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import text as T
from strataframe.operators import calibration, constraints, fusion, matching, metrics, spatial, splits
from strataframe.sources import records
from strataframe.streaming import review


def intervals(spark, rows):
    return spark.createDataFrame([(d, s, Decimal(str(a)), Decimal(str(b))) for d, s, a, b in rows], "doc long, seq long, top decimal(12,2), bottom decimal(12,2)")


def brute_matching(pairs):
    best = (0, Decimal(0))
    for k in range(len(pairs) + 1):
        for chosen in itertools.combinations(sorted(pairs), k):
            if all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(chosen)):
                best = max(best, (k, -sum((c[2] for c in chosen), Decimal(0))))
    return best


def test_matcher_takes_most_then_least_error():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pairs = sorted({(int(a), int(b)): Decimal(int(e)) / 100 for a, b, e in rng.integers(0, 4, (rng.integers(0, 8), 3))}.items())
        pairs = [(a, b, e) for (a, b), e in pairs]
        chosen = matching._best_path(pairs)
        cost = {(a, b): e for a, b, e in pairs}
        assert (len(chosen), -sum((cost[c] for c in chosen), Decimal(0))) == brute_matching(pairs)


def test_match_is_one_to_one_and_ordered(spark):
    ref = intervals(spark, [(1, 0, 0, 1), (1, 1, 0.1, 1.1), (1, 2, 5, 6), (2, 0, 0, 1)])
    pred = intervals(spark, [(1, 0, 0.05, 1.05), (1, 1, 0.12, 1.12), (1, 2, 5, 6.3)])
    got = matching.match_intervals(ref, pred, "0.20").collect()
    assert {(r["r_seq"], r["p_seq"]) for r in got} == {(0, 0), (1, 1)}
    m = matching.interval_metrics(ref, pred, matching.match_intervals(ref, pred, "0.20")).first()
    assert (m["tp"], m["refs"], m["preds"]) == (2, 4, 3)


def test_metrics_without_rows_are_null(spark):
    empty = intervals(spark, [])
    m = matching.interval_metrics(empty, empty, matching.match_intervals(empty, empty, "0.1")).first()
    assert m["tp"] == 0 and m["precision"] is None and m["recall"] is None and m["f1"] is None
    one = metrics.evaluate(empty, [metrics.mean_absolute_error("x", F.col("top"), F.col("bottom"))]).first()
    assert one["value"] is None and one["denominator"] == 0


def test_word_errors(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), ("", "new"), (None, None)], "a string, b string")
    got = metrics.evaluate(rows, [metrics.word_error_rate("wer", F.col("a"), F.col("b")), metrics.character_error_rate("cer", F.col("a"), F.col("b"))]).collect()
    assert (got[0]["numerator"], got[0]["denominator"]) == (2, 3)
    assert got[1]["denominator"] == 5


def test_constraints(spark):
    rows = intervals(spark, [(1, 0, 0, 1), (1, 1, 1.2, 1.1), (1, 2, 1, 3)]).withColumn("thickness", F.col("bottom") - F.col("top"))
    finals = spark.createDataFrame([(1, Decimal("3.00"))], "doc long, final_depth decimal(12,2)")
    got = {r["constraint"]: (r["evaluated"], r["violations"]) for r in constraints.violation_counts(rows, finals).collect()}
    assert got["C1_depth_order"] == (3, 1) and got["C3_gap"] == (2, 1) and got["C3_overlap"] == (2, 1) and got["C4_monotone"] == (2, 1) and got["C5_final_depth"] == (1, 0)


def test_fuse_and_adjudicate(spark):
    rows = spark.createDataFrame([("1", "1 ", "2"), ("1", "2", "2"), (None, "2", None), (None, None, "1"), ("1", "2", "3")], "a string, b string, c string")
    got = rows.select(fusion.fuse(F.col("a"), F.col("b")).alias("f"), fusion.adjudicate(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [r["f"] for r in got] == ["agreement", "disagreement", "visual_only", "both_abstained", "disagreement"]
    assert [r["s"] for r in got] == ["AGREEMENT", "CORROBORATED_B", "SINGLE_SOURCE_B", "MISSING", "DISAGREEMENT_UNRESOLVED"]


def test_temperature(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.9, 0), (0.1, 0)], "p double, y int")
    assert 0.5 < calibration.fit_temperature(rows, "p", "y").first()["temperature"] < 3


def test_idw_and_hull(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 10.0), (1, 10.0, 0.0, 20.0), (2, 10.0, 10.0, 20.0), (3, 5.0, 5.0, 0.0), (4, 0.0, 10.0, 0.0)], "id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 5.0, 0.0), (1, 0.0, 0.0), (2, 20.0, 20.0)], "qid long, qx double, qy double")
    z = {r["qid"]: r["z"] for r in spatial.idw(q, p.where("id < 2")).collect()}
    assert round(z[0], 9) == 15 and z[1] == 10
    hull = spatial.convex_hull(p)
    assert hull.count() == 4 and spatial.hull_area(hull).first()["area"] == 100
    assert {r["qid"] for r in spatial.inside_hull(q, hull).collect()} == {0, 1}


def test_splits_keep_groups_together(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 90)
    out = splits.group_split(rows, "g", {"a": 0.8, "b": 0.2})
    assert splits.leaks(out, "g").count() == 0 and {r["split"] for r in out.select("split").distinct().collect()} == {"a", "b"}


def test_balanced_split_meets_its_shares(spark):
    rows = spark.range(1000).withColumn("g", F.when(F.col("id") < 400, 0).when(F.col("id") < 600, 1).otherwise(F.col("id")))
    out = splits.balanced_split(rows, "g", {"a": 0.5, "b": 0.3, "c": 0.2}, "s")
    assert splits.leaks(out, "g").count() == 0
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"a": 500, "b": 300, "c": 200}
    large, splits.LARGE_GROUPS = splits.LARGE_GROUPS, 20
    try:  # most groups are dealt by their hash
        dealt = {r["split"]: r["count"] for r in splits.balanced_split(rows, "g", {"a": 0.5, "b": 0.3, "c": 0.2}, "s").groupBy("split").count().collect()}
    finally:
        splits.LARGE_GROUPS = large
    assert all(abs(dealt[k] - n) < 60 for k, n in {"a": 500, "b": 300, "c": 200}.items())
    with pytest.raises(ValueError):
        splits.balanced_split(rows, "g", {"a": 0.5})
    with pytest.raises(ValueError):
        splits.balanced_split(rows.withColumn("g", F.lit(None).cast("long")), "g", {"a": 1.0})


@pytest.mark.parametrize("block", [100, 10_000])
def test_balanced_split_places_small_groups_one_by_one(spark, monkeypatch, block):
    import hashlib
    from fractions import Fraction

    monkeypatch.setattr(splits, "LARGE_GROUPS", block)
    sizes = {g: 4000 if g == 7 else 900 if g < 9 else 1 + g % 3 for g in range(12_000)}  # most hold less than a 10,000th of the rows
    rows = spark.range(len(sizes)).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.when(F.col("id") == 7, 4000).when(F.col("id") < 9, 900).otherwise(1 + F.col("id").cast("int") % 3))).alias("i"))
    for shares in ({"a": 0.7, "b": 0.15, "c": 0.15}, {"a": 0.25, "b": 0.25, "c": 0.5}, {"a": 0.0, "b": 1.0}):
        total, counts, want = sum(sizes.values()), dict.fromkeys(shares, 0), {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], int(hashlib.sha256(f"s{g}".encode()).hexdigest()[:8], 16), g)):
            want[g] = min(shares, key=lambda s: (counts[s] - total * Fraction(str(shares[s])), counts[s]))
            counts[want[g]] += sizes[g]
        out = splits.balanced_split(rows, "g", shares, "s")
        assert out.count() == total
        assert {r["g"]: r["split"] for r in out.select("g", "split").distinct().collect()} == want


def test_manifest_hash_is_of_the_records_alone(spark):
    rows = spark.range(500).withColumn("v", F.col("id") % 7)
    one, other = splits.manifest_hash(rows, ["id", "v"]).first(), splits.manifest_hash(rows.orderBy(F.desc("id")).repartition(7), ["id", "v"]).first()
    assert one == other and one["records"] == 500
    assert splits.manifest_hash(rows.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v"))), ["id", "v"]).first()["manifest_sha256"] != one["manifest_sha256"]


def test_exact_sign_test(spark):
    from math import comb

    from strataframe.operators import statistics

    cases = [(0, 0), (1, 0), (3, 9), (12, 12), (40, 70), (500, 520), (9000, 9400)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", statistics.sign_test_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n = r["a"] + r["b"]
        want = min(1.0, 2 * sum(comb(n, k) for k in range(min(r["a"], r["b"]) + 1)) / 2**n) if n else None
        assert r["p"] is None if want is None else abs(r["p"] - want) < 1e-7 * max(want, 1e-3)


def test_resampling(spark):
    from strataframe.operators import statistics

    w = statistics.document_weights(np.arange(400), 300)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15
    rows = spark.createDataFrame([(k, k % 5, 5, 6) for k in range(300)], "doc long, matched long, predicted long, referred long").repartition(5)
    sums = {r["rep"]: r["matched"] for r in statistics.resampled_sums(rows, ["matched", "predicted"], 40).collect()}
    weights = statistics.document_weights(np.arange(300), 40)
    assert all(sums[r] == (np.arange(300) % 5 * weights[:, r]).sum() for r in range(40))
    b = statistics.bootstrap_f1(rows, 500).first()
    assert b["repetitions"] == 500 and b["low_f1"] < 2 * 2 / 11 < b["high_f1"]


def test_error_labels(spark):
    cases = [
        ("any", "1", "1", None), ("any", None, None, None), ("any", None, "x", "hallucination"), ("intervals", "3", None, "missing_interval"), ("top_depth_m", "1", None, "interval_boundary_error"), ("lithology_normalized", "a", "b", "normalization_error"),
        ("lithology_raw", "a", None, "lithology_semantic_error"), ("final_depth_m", "12.5", "125", "decimal_point_error"), ("final_depth_m", "12.5", "13.5", "OCR_digit_error"), ("final_depth_m", "12.5", None, "OCR_digit_error"), ("name", "abc", None, None), ("name", "abc", "abd", "OCR_character_error"),
    ]
    got = spark.createDataFrame(cases, "f string, r string, p string, want string").select("want", metrics.error_label(F.col("f"), F.col("r"), F.col("p")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    told = {r["label"]: r for r in metrics.error_distribution(spark.createDataFrame([("hallucination",), ("own",), (None,)], "label string")).collect()}
    assert len(told) == 18 and told["own"]["n"] == 1 and not told["own"]["known"] and told["UNCLASSIFIED"]["n"] == 1 and told["row_merge"]["n"] == 0 and len(metrics.TAXONOMY) == 16


def test_stratum_codes(spark):
    rows = spark.createDataFrame([(1, 0, "①"), (1, 1, "②"), (1, 2, "②"), (1, 3, None), (1, 4, "9"), (2, 0, "-5"), (2, 1, "+6"), (3, 0, " 7 ")], "doc long, seq long, code string")
    got = {r["doc"]: (r["evaluated"], r["repeats"], r["jumps"], r["status"]) for r in constraints.code_sequence(rows).collect()}
    assert got == {1: (3, 1, 1, "violated"), 2: (0, 0, 0, "not_evaluated"), 3: (0, 0, 0, "not_evaluated")}


def test_thresholds_over_many_scores(spark):
    rng = np.random.default_rng(6)
    p = rng.random(3000)
    y = (rng.random(3000) < p).astype(int)
    got = calibration.select_threshold(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int"), "p", "y", 0.8).first()
    best = max((int((p >= t).sum()), y[p >= t].mean(), t) for t in p if y[p >= t].mean() >= 0.8)
    assert (got["accepted"], got["threshold"]) == (best[0], best[2])
    assert calibration.select_threshold(spark.createDataFrame([], "p double, y int"), "p", "y", 0.8).count() == 0


def test_nearest_places_by_brute_force(spark):
    from strataframe.operators import spatial

    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.normal(50, 5, (40, 2)), [[1000.0, 1000.0], [-500.0, 3.0]]])
    got = {(r["qx"], r["qy"]): r["distance"] for r in spatial.nearest_distances(spark.createDataFrame([(float(a), float(b)) for a, b in [*xy, xy[0]]], "x double, y double")).collect()}
    for k, p in enumerate(xy):
        d = np.hypot(*(np.delete(xy, k, 0) - p).T).min()
        assert abs(got[tuple(p)] - d) < 1e-9
    assert spatial.nearest_distances(spark.createDataFrame([(1.0, 1.0)], "x double, y double")).count() == 0 and spatial.nearest_distances(spark.createDataFrame([], "x double, y double")).count() == 0


def test_points_in_blocks(spark):
    from strataframe.operators import spatial

    p = spark.createDataFrame([(k, float(k % 7), float(k % 5), float(k)) for k in range(60)], "id long, x double, y double, z double")
    q = spark.createDataFrame([(k, k * 0.4, k * 0.3) for k in range(12)], "qid long, qx double, qy double")
    want = sorted(map(tuple, spatial.idw(q, p).collect()))
    spatial.BROADCAST_ROWS, whole = 5, spatial.BROADCAST_ROWS
    try:
        got = sorted(map(tuple, spatial.idw(q, p).collect()))
    finally:
        spatial.BROADCAST_ROWS = whole
    assert np.allclose(got, want)


def test_guards(spark):
    from strataframe.operators import evaluation, propagation

    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc long, name string")
    evaluation.require_same_documents(a, a)
    for other in (a.where("doc = 1"), a.unionByName(a), spark.createDataFrame([(1, "x"), (3, "y")], "doc long, name string")):
        with pytest.raises(ValueError):
            evaluation.require_same_documents(a, other)
    good = (1, 1, 1, "KEEP", 1, True, 0.5, 1, "test", "synthetic")
    schema = "case_id long, reference long, original long, status string, accepted_value long, needs_review boolean, confidence double, correct int, partition string, truth string"
    fit = (2, *good[1:8], "calibration", "synthetic")
    assert evaluation.evaluate_cases(spark.createDataFrame([good, fit], schema), "synthetic").count() == 14
    for bad in ([good], [good, fit, fit], [good, (*fit[:6], 1.5, *fit[7:])], [good, (*fit[:9], "guess")]):
        with pytest.raises(ValueError):
            evaluation.evaluate_cases(spark.createDataFrame(bad, schema), "synthetic")
    with pytest.raises(ValueError):
        evaluation.evaluate_ablation(spark.createDataFrame([(*good, "minus_ocr"), (*fit, "minus_ocr")], schema + ", variant string"), "synthetic")
    records = spark.createDataFrame([(1, 0.0, 0.0, 10.0, [1.0, 2.0, 4.0])], "doc long, x double, y double, collar double, depths array<double>")
    with pytest.raises(ValueError):
        propagation.inject(records, "other", 0.1, 1)
    for error in propagation.ERROR_CLASSES:
        r = propagation.inject(records, error, 0.5, 1, 1.0).first()
        assert r["operation"] == error and (len(r["depths"]) == {"merged_layer": 2, "split_layer": 4, "duplicate_boundary": 4}.get(error, 3))
        assert (error == "coordinate_shift") == (abs(np.hypot(r["x"], r["y"]) - 0.5) < 1e-9)
        assert propagation.inject(records.limit(0), error, 0.5, 1).count() == 0


def test_texts(spark):
    row = spark.createDataFrame([("1,5", "from 2-5 and 3 - 2000 or 7-9", "Silt & Clay", '{"k": "x"}')], "n string, r string, s string, j string")
    got = row.select(T.parse_number(F.col("n")).alias("n"), T.ranges(F.col("r")).alias("r"), T.normalize_name(F.col("s")).alias("s"), T.json_number(F.col("j"), "$.k").alias("j")).first()
    assert got["n"] == 1.5 and [tuple(x) for x in got["r"]] == [(2, 5), (7, 9)] and got["s"] == "silt and clay" and got["j"] is None


def test_records_round_trip(spark, tmp_path):
    rows = intervals(spark, [(1, 0, 0, 1), (1, 1, 1, 2), (2, 0, 0, 3)]).withColumn("lithology", F.lit("clay"))
    nested = records.nest(rows)
    records.write_records(nested, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, records.interval_rows(back).collect())) == sorted(map(tuple, records.interval_rows(nested).collect()))
    records.write_tables(back, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/provenance")).count() == 3 * 3 + 2
    assert records.upsert(rows.where("doc = 1"), rows.where("doc = 2"), "doc").count() == 3


def run_stream(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_sessions_of_late_events(spark, tmp_path):
    """Events that come in a later file but within the watermark give the sessions of the whole; too late ones are left out."""
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "user_id long, event_id long, event_type string, ts timestamp, value double"
    files = [
        [(1, 1, "view", at(0), 0.0), (1, 3, "purchase", at(20), 0.0), (2, 4, "purchase", at(21), 0.0)],
        [(1, 2, "purchase", at(10), 0.0), (1, 5, "view", at(22), 0.0), (9, 6, "view", at(59), 0.0)],
        [(1, 7, "purchase", at(23), 0.0), (1, 8, "purchase", at(40), 0.0), (9, 9, "view", at(59), 0.0)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import time

    time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    got = sorted((r["user_id"], r["event_id"], r["seconds"], r["status"]) for r in run_stream(spark, review.session_stream(stream, "user_id", "view", "purchase", "30 minutes"), "late_sessions", tmp_path / "late"))
    assert (1, 2, 600.0, "completed") in got and (1, 3, None, "unknown") in [(a, b, None if c != c else c, e) for a, b, c, e in got]
    assert all(e != 8 or s != "completed" for _, e, _, s in got)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    after = events.orderBy(F.desc("ts")).limit(1).withColumns({"user_id": F.lit(-1).cast(events.schema["user_id"].dataType), "event_type": F.lit("view"), "ts": (F.col("ts") + F.expr("INTERVAL 1 DAY")).cast(events.schema["ts"].dataType)})
    events.unionByName(after).write.mode("overwrite").parquet(str(tmp_path / "in"))  # the watermark passes the last real event
    stream = review.event_stream(spark, str(tmp_path / "in"), events.schema)
    key = lambda r: (r["user_id"], r["event_id"], None if r["seconds"] is None or r["seconds"] != r["seconds"] else r["seconds"], r["status"])
    got = sorted(map(str, map(key, run_stream(spark, review.session_stream(stream, "user_id", "view", "purchase", "0 seconds"), "sessions", tmp_path / "c"))))
    assert got == sorted(map(str, map(key, review.sessions(events, "user_id", "view", "purchase").collect())))
    w = review.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count() + 1


@pytest.mark.parametrize("name", ["monotonic_edge", "continuity_edge", "column_edge"])
def test_best_path_by_enumeration(name):
    from strataframe.operators import sequences

    rng, edge = np.random.default_rng(2), getattr(sequences, name)
    fields = ("page", "y", "top", "bottom", "node_score", "x_top", "x_bottom")
    for _ in range(60):
        rows = [(int(p), float(y), float(t), float(t + h), float(s), u / 10, v / 10) for p, y, t, h, s, u, v in zip(rng.integers(0, 2, 6), rng.integers(0, 5, 6), rng.integers(0, 6, 6), rng.integers(1, 3, 6), rng.integers(1, 4, 6), rng.integers(0, 4, 6), rng.integers(0, 4, 6), strict=True)]
        nodes = [dict(zip(fields, r, strict=True)) for r in sorted(rows)]
        best = (-np.inf, 0)
        for n in range(1, 7):
            for path in itertools.combinations(range(6), n):
                try:
                    best = max(best, (round(sequences.path_score([nodes[k] for k in path], edge), 9), n))
                except ValueError:
                    continue
        path = sequences.best_path(nodes, edge)
        assert (round(sequences.path_score([nodes[k] for k in path], edge), 9), len(path)) == best
    assert sequences.best_path([], edge) == []


def test_edges():
    from strataframe.operators import sequences

    a = {"page": 1, "y": 0.1, "top": 0.0, "bottom": 5.0, "x_top": 0.1, "x_bottom": 0.2}
    b = lambda **k: {"page": 1, "y": 0.2, "top": 5.0, "bottom": 6.0, "x_top": 0.1, "x_bottom": 0.2} | k
    assert sequences.continuity_edge(a, b()) == 5.0 and sequences.continuity_edge(a, b(top=5.5)) == 1.5
    assert abs(sequences.continuity_edge(a, b(top=8.0)) + np.log1p(3.0)) < 1e-12 and sequences.continuity_edge(a, b(top=5000.0)) == -6.0
    assert sequences.continuity_edge(a, b(y=0.1)) is None and sequences.continuity_edge(a, b(top=3.9)) is None
    assert abs(sequences.column_edge(a, b(page=4, x_top=0.2)) - (5.0 - 0.4 - 0.3)) < 1e-12


def test_policies(spark):
    from strataframe.operators import sequences

    kept = intervals(spark, [(1, 0, 0, 1), (2, 0, 0, 5)])
    c = spark.createDataFrame([(1, 1.0, 2.0, 0.9), (1, 1.5, 2.5, 0.8), (1, 3.0, 4.0, 0.1), (2, 4.0, 6.0, 0.9)], "doc long, top double, bottom double, score double")
    got = sorted(tuple(r) for r in sequences.add_without_overlap(kept, c, 0.5).collect())
    assert got == [(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 0.0, 5.0)]
    rows = intervals(spark, [(1, 0, 0, 1), (1, 1, 0.5, 2), (1, 2, 1, 2)])
    assert sequences.monotone_subset(rows).first()["kept"] == [0, 2]


def brute_additions(raw, proposed, threshold):
    """The policy of one document in plain Python: raw (seq, top, bottom), proposed (score, top, bottom)."""
    chosen = [(t, b) for _, t, b in sorted(raw)]
    if all(right[0] >= left[0] for left, right in zip(chosen, chosen[1:], strict=False)):
        for _, t, b in sorted(((-s, t, b) for s, t, b in proposed if s >= threshold)):
            if not any(x < b and t < y for x, y in chosen):
                chosen.append((t, b))
    return sorted(chosen)


def test_additions_without_kept_intervals_and_to_falling_ones(spark):
    from strataframe.operators import sequences

    kept = intervals(spark, [(1, 0, 5, 6), (1, 1, 2, 3), (2, 0, 0, 1)])
    c = spark.createDataFrame([(1, 8.0, 9.0, 0.9), (2, 8.0, 9.0, 0.9), (3, 0.0, 2.0, 0.6), (3, 1.0, 3.0, 0.9), (4, 0.0, 1.0, 0.1)], "doc long, top double, bottom double, score double")
    got = sorted(tuple(r) for r in sequences.add_without_overlap(kept, c, 0.5).collect())
    assert got == [(1, 2.0, 3.0), (1, 5.0, 6.0), (2, 0.0, 1.0), (2, 8.0, 9.0), (3, 1.0, 3.0)]


@pytest.mark.parametrize("thin", [False, True])
def test_risk_policy_against_brute_force(spark, sf_dir, thin):
    """The query itself, and the operator with the first interval of each document gone (some then have none)."""
    from collections import defaultdict

    from strataframe.operators import sequences
    from strataframe.plans import catalog, catalog_more  # noqa: F401  (registers the query)

    _, a, b = catalog.channels(spark, sf_dir)
    a = a.where("seq % 2 = 1") if thin else a
    raw, proposed = defaultdict(list), defaultdict(list)
    for r in a.collect():
        raw[r["doc"]].append((r["seq"], float(r["top"]), float(r["bottom"])))
    for r in b.collect():
        proposed[r["doc"]].append((r["pk"] % 100 / 100, float(r["top"]), float(r["bottom"])))
    want = {d: brute_additions(raw[d], proposed[d], 0.5) for d in set(raw) | set(proposed)}
    want = {d: x for d, x in want.items() if x}
    if not thin:
        got = {r["doc"]: (r["n"], r["depth"]) for r in catalog.QUERIES["risk_policy_additions"](spark, sf_dir).collect()}
        assert set(got) == set(want)
        assert all(n == len(want[d]) and abs(depth - sum(b - t for t, b in want[d])) < 1e-3 for d, (n, depth) in got.items())
        return
    got = defaultdict(list)
    c = b.select("doc", "top", "bottom", (F.col("pk") % 100 / 100).alias("score"))
    for r in sequences.add_without_overlap(a, c, 0.5).collect():
        got[r["doc"]].append((r["top"], r["bottom"]))
    assert {d: sorted(x) for d, x in got.items()} == want and any(not raw[d] for d in got)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("rows_a_task", [1, 200_000])
def test_depth_pairs_are_those_of_all_pairs(spark, monkeypatch, rows_a_task):
    import random

    from strataframe.operators import layout

    monkeypatch.setattr(layout, "CELL_ROWS", rows_a_task)
    rng, inf, nan = random.Random(3), float("inf"), float("nan")
    rows = [(rng.choice("ab"), float(rng.randrange(-300, 300)), float(rng.randrange(-90, 90)), float(rng.randrange(12))) for _ in range(900)]
    rows += rows[:20] + [("a", -1e-20, 0.0, 1.0), ("a", 140.0, 0.0, 2.0), ("c", 0.0, 0.0, 1.0), ("c", 12.0, 40.0, nan), ("c", 1e300, 0.0, 5.0), ("c", inf, 0.0, 9.0), ("c", nan, 0.0, 9.0), (None, 0.0, 0.0, 1.0), (None, 20.0, 0.0, 2.0), ("d", 0.0, 0.0, None)]
    larger = lambda a, b: a == a and (b != b or a < b)
    for least, most in ((12, 140), (-30, 5)):
        want = {}
        for p, x, y, v in set(rows):
            near = [(bx - x, abs(by - y), b) for q, bx, by, b in rows if None not in (p, v, b) and p == q and least <= bx - x <= most and abs(by - y) <= 40 and larger(v, b)]
            if near:
                want[p, x, y, v] = str(min(near)[2])
        got = layout.depth_pairs(spark.createDataFrame(rows, "page string, cx double, cy double, value double"), least, most, 40).collect()
        assert len(got) == len(want)
        assert {(r["page"], r["cx"], r["cy"], r["top"]): str(r["bottom"]) for r in got} == want


def test_depth_pairs_make_no_pair_in_vain(spark):
    from strataframe.operators import layout

    alike = spark.range(40_000).select(F.lit(1).alias("page"), (F.col("id") % 400 / 4).alias("cx"), (F.col("id") / 2000).alias("cy"), F.lit(7.5).alias("value"))
    got = layout.depth_pairs(alike, 12, 140, 40)
    assert got.count() == 0
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_word_errors_of_long_and_random_rows(spark):
    import random

    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(90))], [rng.choice("abcde") for _ in range(rng.randrange(90))]) for _ in range(40)]
    for a, b in pairs:
        assert metrics.edits(a, b) == (edits(a, b) if a and b else len(a) + len(b))
    words = [f"w{k}" for k in range(9000)]
    long = (" ".join(words), "\v".join(words[:7935] + words[7936:]))  # as characters from U+E000 on, the word left out would be a byte order mark
    rows = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs] + [long, (None, "new"), ("gone", None)], "a string, b string")
    got = metrics.evaluate(rows, [metrics.word_error_rate("wer", F.col("a"), F.col("b"))]).first()
    assert got["numerator"] == sum(metrics.edits(a, b) for a, b in pairs if a) + 2
    assert got["denominator"] == sum(len(a) for a, _ in pairs) + 9001


def test_error_rates_count_every_turn(spark, tmp_path):
    from strataframe.plans import catalog

    texts = ["Plain text here", "caf\u00e9 \u65e5\u672c \u2713 e 3.5", "\U0001f600 the end", "", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "conv_id long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    low = [t.lower() for t in texts if t]
    got = {r["metric"]: r for name in ("text_error_rates", "word_error_rate") for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert (got["cer"]["numerator"], got["cer"]["denominator"]) == (sum(edits(t, t.replace("e", "c")) for t in low), sum(map(len, low)))
    assert (got["wer"]["numerator"], got["wer"]["denominator"]) == (sum(edits(t.split(), t.replace("e", "~").split()) for t in low), sum(len(t.split()) for t in low))
    assert got["numeric_cer"]["denominator"] == 3
    assert 0 < got["similarity"]["value"] < 1


def test_engine_takes_complete_configurations_only(spark):
    from strataframe.operators import engine

    good = engine.default_config()
    assert [c.name.split("_")[0] for c in engine.engine(good)] == [f"C{k}" for k in range(1, 11)]
    assert len(engine.engine(good | {"continuity": {"enabled": False, "severity": "error"}})) == 9
    for bad in ({k: v for k, v in good.items() if k != "continuity"}, good | {"more": {}}, good | {"version": "v2"}, good | {"continuity": {"enabled": True, "severity": "error", "tolerance": 1}}, good | {"continuity": {"enabled": 1, "severity": "error"}}, good | {"coordinate_format": {"enabled": True, "severity": "e", "minimum_digits": 9, "maximum_digits": 3}}, good | {"continuity": {"enabled": True, "severity": "e", "tolerance_m": "-1"}}):
        with pytest.raises(ValueError):
            engine.engine(bad)


def test_engine_takes_own_constraints(spark):
    from strataframe.operators import engine

    own = engine.Constraint("C11_few", "info", lambda t: t["intervals"].groupBy("doc").agg(F.lit(1).alias("evaluated"), (F.count("*") < 2).cast("int").alias("violations")))
    rows = intervals(spark, [(1, 0, 0, 1), (1, 1, 1, 2), (2, 0, 0, 1)]).withColumn("thickness", F.col("bottom") - F.col("top"))
    got = {(r["doc"], r["constraint"]): r["status"] for r in engine.evaluate({"intervals": rows}, [own, *engine.engine(engine.default_config())]).collect()}
    assert got[1, "C11_few"] == "passed" and got[2, "C11_few"] == "violated" and got[2, "C3_interval_continuity"] == "not_evaluated" and got[1, "C1_depth_validity"] == "passed"


def test_files(spark, tmp_path):
    from strataframe.operators import manifests
    from strataframe.sources import files

    (tmp_path / "a.csv").write_bytes("key,top,bottom,text,comments\nw1,0,1.5,Lehm \xe4 \u2013,\nw1,x,2,clay,\nw1,1.5,3, ,\nw1,0,1.5,Lehm \xe4 \u2013,\n".encode("cp1252"))
    gold = manifests.gold_intervals(files.read_interval_table(spark, str(tmp_path / "a.csv")), "key").collect()
    assert [(r["top"], r["bottom"], r["text"]) for r in gold] == [(0.0, 1.5, "Lehm ä –")]
    files.write_interval_table(intervals(spark, [(1, 0, 0, 1)]).withColumn("interval_id", F.lit("I001")), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == list(files.INTERVAL_COLUMNS) and back.first()["interval_id"] == "I001"
    (tmp_path / "p.jsonl").write_text('{"item_id": "a", "x": 1}\n\n{"item_id": "b", "x": 2}\n')
    assert files.read_predictions(spark, str(tmp_path / "p.jsonl"), "item_id string, x long").count() == 2
    for bad in ('{"item_id": "a"}\n{"item_id": "a"}\n', '{"x": 1}\n'):
        (tmp_path / "p.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            files.read_predictions(spark, str(tmp_path / "p.jsonl"), "item_id string, x long")
    p = spark.createDataFrame([(1, 1.5, 2.5, "EPSG:4326"), (2, None, 1.0, "EPSG:4326"), (3, -1.0, 0.0, "epsg:4326")], "id long, x double, y double, s string")
    files.write_geoparquet(p.where("id < 3"), str(tmp_path / "geo"), "x", "y", "s")
    import json
    import struct

    row = spark.read.parquet(str(tmp_path / "geo/data")).first()
    assert struct.unpack("<BIdd", bytes(row["geometry"])) == (1, 1, 1.5, 2.5)
    assert json.loads(spark.read.text(str(tmp_path / "geo/geo")).first()[0])["columns"]["geometry"]["bbox"] == [1.5, 2.5, 1.5, 2.5]
    with pytest.raises(ValueError):
        files.write_geoparquet(p, str(tmp_path / "geo2"), "x", "y", "s")
    files.write_feature_collection(p, str(tmp_path / "f"), "id", "x", "y", "s")
    assert json.loads(spark.read.text(str(tmp_path / "f/collection")).first()[0])["coordinate_systems"] == ["EPSG:4326", "epsg:4326"] and spark.read.text(str(tmp_path / "f/features")).count() == 2
    meta = dict.fromkeys(files.RUN_KEYS, "x") | {"date": "2024-02-03", "experiment_id": "run_1"}
    assert files.create_run(spark, str(tmp_path / "runs"), meta).endswith("2024-02-03/run_1")
    for bad in (meta, meta | {"experiment_id": "a b"}, meta | {"date": "today"}, {"date": "2024-01-01"}):
        with pytest.raises(Exception):
            files.create_run(spark, str(tmp_path / "runs"), bad)
    (tmp_path / "h").mkdir()
    (tmp_path / "h/one.txt").write_bytes(b"abc")
    import hashlib

    assert tuple(files.file_hashes(spark, str(tmp_path / "h")).first()) == ("one.txt", 3, hashlib.sha256(b"abc").hexdigest())
    places, triangles = files.surface_grid([0.0, 1.0, 2.0], [0.0, 5.0])
    assert len(places) == 6 and triangles == [(0, 1, 3), (1, 4, 3), (1, 2, 4), (2, 5, 4)]
    with pytest.raises(ValueError):
        files.surface_grid([0.0, 0.0], [0.0, 1.0])


def test_longest_runs_and_clusters(spark):
    from strataframe.operators import positions

    def brute(v):
        best = []
        for n in range(len(v), 0, -1):
            runs = [c for c in itertools.combinations(v, n) if all(a < b for a, b in itertools.pairwise(c))]
            if runs:
                return n, max(r[-1] for r in runs)
        return 0, None

    rng = np.random.default_rng(1)
    rows = [[float(x) for x in rng.integers(0, 8, rng.integers(0, 9))] for _ in range(60)]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k long, v array<double>").select("v", positions.longest_increasing(F.col("v")).alias("r")).collect()
    for r in got:
        assert all(a < b for a, b in itertools.pairwise(r["r"])) and (len(r["r"]), r["r"][-1] if r["r"] else None) == brute(r["v"])
    points = [(1, 0.1, 10.0 * k, float(k), 0.9) for k in range(8)] + [(1, 0.1, 31.0, 99.0, 0.1), (1, 0.5, 5.0, 7.0, 0.9), (1, 0.5, 50.0, 3.0, 0.9), (2, 0.3, 5.0, 1.0, 0.5)]
    scored = positions.cluster_scores(positions.numeric_clusters(spark.createDataFrame(points, "page long, x double, y double, value double, confidence double")))
    best = positions.best_clusters(scored).where("rank = 1").collect()
    assert len(best) == 1 and best[0]["values"] == [float(k) for k in range(8)]
    assert abs(best[0]["score"] - (8 + 6 + 3 * np.log1p(0.7) + 2 + 2)) < 1e-9
    peaks = spark.createDataFrame([([0.1, 0.9, 0.2, 0.8, 0.1, 0.1, 0.7],)], "v array<double>").select(positions.peaks(F.col("v"), 0.5, 3).alias("p")).first()["p"]
    assert peaks == [1, 6]


def test_field_access(spark):
    from strataframe.operators import policies

    rows = spark.createDataFrame([("a", "borehole.x", "1"), ("a", "intervals[2].y", "2"), ("b", "borehole.x", None), ("c", "other", "9")], "document_id string, field_path string, value string")
    got = {r["document_id"]: (r["borehole.x"], r["intervals[2].y"]) for r in policies.field_at(rows, ["borehole.x", "intervals[2].y"]).collect()}
    assert got == {"a": ("1", "2"), "b": (None, None)}
    told = {r["field"]: (r["records"], r["present"]) for r in policies.presence(rows).collect()}
    assert told == {"borehole.x": (2, 1), "intervals.y": (1, 1), "other": (1, 1)}


def test_logistic_against_gradient_descent(spark):
    from strataframe.operators import logistic

    rng = np.random.default_rng(12)
    x = rng.normal(2.0, 3.0, (400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] - 1)))).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1)], "a double, b double, c double, y int").repartition(4)
    for balanced in (False, True):
        model = logistic.fit(rows, ["a", "b", "c"], "y", 0.08, balanced)
        z = np.concatenate([np.ones((400, 1)), (x - x.mean(0)) / x.std(0)], axis=1)
        w, c = np.zeros(4), np.where(y == 1, max(1.0, (y == 0).sum() / (y == 1).sum()), 1.0) if balanced else np.ones(400)
        for _ in range(20_000):
            g = z.T @ ((1 / (1 + np.exp(-z @ w)) - y) * c) / c.sum()
            w -= 0.2 * (g + 0.08 * np.array([0, *w[1:]]))
        assert np.allclose(model.weights, w, atol=1e-6)
    p = rows.dropna().select(model.probability().alias("p")).toPandas().p
    assert p.between(0, 1).all()
    assert logistic.fit(rows.where("y = 1"), ["a"], "y").weights[1] == 0 and logistic.fit(rows.limit(0), ["a"], "y").weights == (0.0, 0.0)


def test_certificates_refuse_errors(spark):
    from strataframe.operators import policies

    with pytest.raises(ValueError):
        policies.certificate(spark.createDataFrame([("a", 3, 0), ("b", 2, 1)], "name string, actions long, errors long"))


def test_word_table(spark, tmp_path):
    from strataframe.operators import layout
    from strataframe.sources import files

    (tmp_path / "w.tsv").write_text('level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t90\tTo"p\n5\t1\t1\t1\t1\t2\t50\t21\t20\t8\t80\tclay\n4\t1\t1\t1\t2\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t2\t1\t5\t40\t9\t9\t-1\tx\n')
    lines = {r["line"]: r for r in layout.lines_of_words(files.read_word_table(spark, str(tmp_path / "w.tsv"))).collect()}
    assert len(lines) == 2 and lines["1/1/1"]["text"] == 'To"p clay' and (lines["1/1/1"]["x0"], lines["1/1/1"]["x1"]) == (10, 70) and abs(lines["1/1/1"]["confidence"] - 0.85) < 1e-9 and lines["1/1/2"]["confidence"] is None


def test_configuration_of_text(spark):
    import json

    from strataframe.operators import engine

    assert len(engine.load_config(json.dumps(engine.default_config()))) == 10
    with pytest.raises(ValueError):
        engine.load_config("[1]")
