"""Whole evaluations: benchmarks, case studies, fused records, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators import calibration, matching, metrics
from strataframe.operators.matching import ratio
from strataframe.operators.readiness import coverage_guard

#: Header fields told as exact matches and as errors of numbers.
EXACT_FIELDS = ("borehole_id", "project_name", "coordinate_system", "drilling_date")
NUMBER_FIELDS = ("x_coordinate", "y_coordinate", "collar_elevation_m", "final_depth_m", "groundwater_depth_m", "groundwater_elevation_m")
#: What each ablation variant leaves out.
VARIANTS = {"full": (), "minus_constraints": ("constraints",), "minus_rereading": ("rereading",), "minus_layout": ("layout",), "minus_ocr": ("ocr",), "minus_vlm": ("vlm",), "minus_normalization": ("normalization",), "minus_calibration": ("calibration",)}
HUMAN = ("single_verified", "double_verified", "expert_verified")


def require_same_documents(reference: DataFrame, prediction: DataFrame, key: str = "doc") -> None:
    """Raise unless both sides have the same keys, each once."""
    for side, name in ((reference, "reference"), (prediction, "prediction")):
        if not side.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").isEmpty():
            raise ValueError(f"repeated or missing {key} on the {name} side")
    wrong = coverage_guard(reference, prediction, [key]).limit(3).collect()
    if wrong:
        raise ValueError(f"the sides differ: {[tuple(r) for r in wrong]}")


def header_errors(reference: DataFrame, prediction: DataFrame, fields: list[str]) -> DataFrame:
    """doc, field, reference, prediction, label of header values (one row a document) that are in error."""
    r = reference.select("doc", *(F.col(f).cast("string").alias(f"r_{f}") for f in fields))
    p = prediction.select("doc", *(F.col(f).cast("string").alias(f"p_{f}") for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("reference"), F.col(f"p_{f}").alias("prediction")) for f in fields))
    return r.join(p, "doc").select("doc", F.inline(pairs)).withColumn("label", metrics.error_label(F.col("field"), F.col("reference"), F.col("prediction"))).where("label is not null")


def evaluate_benchmark(
    headers: tuple[DataFrame, DataFrame], intervals: tuple[DataFrame, DataFrame], tolerance: str = "0.05", boundary_tolerances: tuple[str, ...] = ("0.01", "0.05", "0.10"), critical: dict[str, str] | None = None, check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Metrics (metric, numerator, denominator, value) and errors (doc, field, reference, prediction, label) of predictions.

    ``headers`` are the reference and predicted header rows, one a document;
    their columns other than ``doc`` are fields.  ``intervals`` have doc, seq,
    top, bottom, lithology and description.  Intervals are matched in order
    within ``tolerance``; unmatched ones are missing or hallucinated.  Sides
    with different documents are refused unless ``check`` is false.
    """
    if check:
        require_same_documents(*headers)
    fields = [c for c in headers[0].columns if c != "doc"]
    side = lambda df, s: df.select("doc", *(F.col(f).alias(f"{s}_{f}") for f in fields))
    both = side(headers[0], "r").join(side(headers[1], "p"), "doc")
    wanted = []
    for f in fields:
        r, p = F.col(f"r_{f}"), F.col(f"p_{f}")
        if f in NUMBER_FIELDS:
            wanted += [metrics.mean_absolute_error(f"{f}_mae", r, p), metrics.Metric(f"{f}_coverage", F.count_if(r.isNotNull() & p.isNotNull()), F.count(r))]
            if f in (critical or {}):
                wanted.append(metrics.critical_error_rate(f"{f}_critical", r, p, critical[f]))
        else:
            wanted.append(metrics.exact_match(f"{f}_exact", r, p))
    told = metrics.evaluate(both, wanted)
    ref, pred = intervals
    found = matching.match_intervals(ref, pred, tolerance).select("doc", "r_seq", "p_seq")
    pick = lambda df, s: df.select(F.col("doc").alias(f"{s}_doc"), F.col("seq").alias(f"{s}_place"), *(F.col(c).alias(f"{s}_{c}") for c in ("top", "bottom", "lithology", "description")))
    m = found.join(pick(ref, "r"), (F.col("doc") == F.col("r_doc")) & (F.col("r_seq") == F.col("r_place"))).join(pick(pred, "p"), (F.col("doc") == F.col("p_doc")) & (F.col("p_seq") == F.col("p_place")))
    of = []
    for c in ("top", "bottom"):
        r, p = F.col(f"r_{c}"), F.col(f"p_{c}")
        of += [metrics.mean_absolute_error(f"matched_{c}_mae", r, p), *(metrics.boundary_accuracy(f"matched_{c}_at_{t}m", r, p, t) for t in boundary_tolerances)]
    known = F.when(F.col("r_description").isNotNull(), F.coalesce("p_description", F.lit("")))
    of += [metrics.exact_match("lithology_exact", F.col("r_lithology"), F.col("p_lithology")), metrics.character_error_rate("description_cer", F.col("r_description"), known)]
    counts = matching.interval_metrics(ref, pred, found.withColumns({"top_error": F.lit(0.0), "bottom_error": F.lit(0.0)}))
    prf = counts.select(F.inline(F.array(
        F.struct(F.lit("interval_precision").alias("metric"), F.col("tp").cast("double").alias("numerator"), F.col("preds").alias("denominator"), F.col("precision").alias("value")),
        F.struct(F.lit("interval_recall").alias("metric"), F.col("tp").cast("double").alias("numerator"), F.col("refs").alias("denominator"), F.col("recall").alias("value")),
        F.struct(F.lit("interval_f1").alias("metric"), (2 * F.col("tp")).cast("double").alias("numerator"), (F.col("refs") + F.col("preds")).alias("denominator"), F.col("f1").alias("value")),
    )))
    columns = ["metric", "numerator", "denominator", "value"]
    cast = lambda df: df.select("metric", F.col("numerator").cast("double").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), F.col("value").cast("double").alias("value"))
    all_metrics = cast(told).unionByName(cast(metrics.evaluate(m, of))).unionByName(cast(prf)).select(*columns)
    lost = ref.join(found.select("doc", F.col("r_seq").alias("seq")), ["doc", "seq"], "left_anti").select("doc", F.concat(F.lit("intervals["), F.col("seq").cast("string"), F.lit("]")).alias("field"), F.col("seq").cast("string").alias("reference"), F.lit(None).cast("string").alias("prediction"), F.lit("missing_interval").alias("label"))
    extra = pred.join(found.select("doc", F.col("p_seq").alias("seq")), ["doc", "seq"], "left_anti").select("doc", F.concat(F.lit("prediction_intervals["), F.col("seq").cast("string"), F.lit("]")).alias("field"), F.lit(None).cast("string").alias("reference"), F.col("seq").cast("string").alias("prediction"), F.lit("hallucination").alias("label"))
    parts = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"r_{c}").cast("string").alias("reference"), F.col(f"p_{c}").cast("string").alias("prediction")) for f, c in (("top_depth_m", "top"), ("bottom_depth_m", "bottom"), ("lithology_raw", "lithology"))))
    inner = m.select("doc", "r_seq", F.inline(parts)).withColumn("label", metrics.error_label(F.col("f"), F.col("reference"), F.col("prediction"))).where("label is not null")
    inner = inner.select("doc", F.concat(F.lit("intervals["), F.col("r_seq").cast("string"), F.lit("]."), "f").alias("field"), "reference", "prediction", "label")
    errors = header_errors(*headers, fields).unionByName(lost).unionByName(extra).unionByName(inner)
    return all_metrics, errors


def require_cases(cases: DataFrame, policy: str = "human") -> None:
    """Raise on repeated cases, foreign partitions, labels or confidences out of range, or truth the policy doesn't allow."""
    allowed = HUMAN if policy == "human" else ("synthetic",)
    bad = cases.agg(
        F.count_if(F.col("case_id").isNull()).alias("without id"), (F.count("case_id") - F.count_distinct("case_id")).alias("repeated"), F.count_if(~F.coalesce(F.col("partition").isin("calibration", "test"), F.lit(False))).alias("in another partition"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("with a confidence out of range"), F.count_if(~F.coalesce(F.col("correct").isin(0, 1), F.lit(False))).alias("without a label"),
        F.count_if(~F.coalesce(F.col("truth").isin(*allowed), F.lit(False))).alias("without the truth that is asked for"), (F.count_if(F.col("partition") == "test") == 0).cast("int").alias("test partitions empty"),
        (F.count_if(F.col("partition") == "calibration") == 0).cast("int").alias("calibration partitions empty"),
    ).first().asDict()
    wrong = {k: v for k, v in bad.items() if v}
    if wrong:
        raise ValueError(f"cases can't be evaluated: {wrong}")


def evaluate_cases(cases: DataFrame, policy: str = "human", bins: int = 10, calibrate: bool = True) -> DataFrame:
    """Correction, review and confidence metrics of the test cases; the temperature is fitted on the calibration cases alone.

    ``cases`` has case_id, reference, original, status, accepted_value,
    needs_review, confidence, correct, partition and truth.
    """
    require_cases(cases, policy)
    test = cases.where("partition = 'test'")
    t = calibration.fit_temperature(cases.where("partition = 'calibration'"), "confidence", "correct").first()["temperature"] if calibrate else 1.0
    edge = 1e-6
    q = F.greatest(F.least(F.col("confidence"), F.lit(1 - edge)), F.lit(edge))
    scaled = test.withColumn("calibrated", 1 / (1 + F.exp(-F.log(q / (1 - q)) / t)) if calibrate else F.col("confidence"))
    out = metrics.correction_safety(test).unionByName(metrics.review_rates(test)).select("metric", F.col("value").cast("double").alias("value"))
    for name, p in (("raw", "confidence"), ("calibrated", "calibrated")):
        out = out.unionByName(scaled.agg(calibration.brier(F.col(p), F.col("correct")).alias("value")).select(F.lit(f"{name}_brier").alias("metric"), "value"))
        out = out.unionByName(calibration.expected_calibration_error(scaled, p, "correct", bins).select(F.lit(f"{name}_ece").alias("metric"), F.col("ece").alias("value")))
    return out.unionByName(cases.sparkSession.createDataFrame([("temperature", t if calibrate else None)], "metric string, value double"))


def evaluate_ablation(variants: DataFrame, policy: str = "human") -> DataFrame:
    """variant, metric, value of each variant, all over the same cases; anything else is refused.

    ``variants`` has the columns of :func:`evaluate_cases` and ``variant``, a
    name of ``VARIANTS``; one of them is ``full``.
    """
    identity = F.xxhash64("case_id", "reference", "original", "needs_review", "partition", "truth")
    marks = {r["variant"]: (r["n"], r["a"], r["b"]) for r in variants.groupBy("variant").agg(F.count("*").alias("n"), F.bit_xor(identity).alias("a"), F.sum(identity % 1_000_003).alias("b")).collect()}
    if unknown := set(marks) - set(VARIANTS):
        raise ValueError(f"unknown variants: {sorted(map(str, unknown))}")
    if "full" not in marks or len(set(marks.values())) > 1:
        raise ValueError("the variants need the same cases and a full one among them")
    out = None
    for name in VARIANTS:
        if name in marks:
            one = evaluate_cases(variants.where(F.col("variant") == name), policy, calibrate=name != "minus_calibration").select(F.lit(name).alias("variant"), "metric", "value")
            out = one if out is None else out.unionByName(one)
    return out


def change_taxonomy(reference: DataFrame, raw: DataFrame, variant: DataFrame) -> DataFrame:
    """Per document how a variant changed the raw intervals, as sets of boundaries to five decimals.

    Right and wrong ones removed, right and wrong ones added, and the F1 of
    both against the reference.
    """
    key = lambda df, name: df.select("doc", F.round(F.col("top").cast("double"), 5).alias("t"), F.round(F.col("bottom").cast("double"), 5).alias("b")).distinct().withColumn(name, F.lit(True))
    all_ = key(reference, "in_ref").join(key(raw, "in_raw"), ["doc", "t", "b"], "full_outer").join(key(variant, "in_new"), ["doc", "t", "b"], "full_outer")
    r, o, n = (F.col(c).isNotNull() for c in ("in_ref", "in_raw", "in_new"))
    per = all_.groupBy("doc").agg(
        F.count_if(o & r & ~n).alias("correct_removed"), F.count_if(o & ~r & ~n).alias("incorrect_removed"), F.count_if(n & r & ~o).alias("correct_added"), F.count_if(n & ~r & ~o).alias("incorrect_added"),
        F.count_if(r & o).alias("raw_hits"), F.count_if(o).alias("raws"), F.count_if(r & n).alias("new_hits"), F.count_if(n).alias("news"), F.count_if(r).alias("refs"),
    )
    f1 = lambda hits, of: F.coalesce(F.try_divide(2.0 * F.col(hits), (F.col(of) + F.col("refs")).cast("double")), F.lit(0.0))
    return per.select("doc", "correct_removed", "incorrect_removed", "correct_added", "incorrect_added", f1("raw_hits", "raws").alias("raw_f1"), f1("new_hits", "news").alias("new_f1"))


def change_safety(per: DataFrame) -> DataFrame:
    """One row over documents of :func:`change_taxonomy`: actions, harmful ones, their share, documents harmed and worsened."""
    kinds = ("correct_removed", "incorrect_removed", "correct_added", "incorrect_added")
    harm = F.col("correct_removed") + F.col("incorrect_added")
    sums = per.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds), F.count_if(harm > 0).alias("documents_harmed"), F.count_if(F.col("new_f1") < F.col("raw_f1") - 1e-12).alias("documents_worsened"), F.count("*").alias("documents"))
    actions = sum((F.col(k) for k in kinds), F.lit(0))
    harmful = F.col("correct_removed") + F.col("incorrect_added")
    return sums.select("*", actions.alias("actions"), harmful.alias("harmful"), ratio(harmful, actions).alias("false_correction_rate"))


def fuse_intervals(grounded: DataFrame, visual: DataFrame, fields: list[str]) -> DataFrame:
    """Interval values of two readings of a document, field by field, with decisions and warnings.

    Both sides have doc, seq (0-based) and the value columns.  Intervals are
    paired by place where both readings have equally many.  Without grounded
    ones the visual ones are taken, else the grounded ones, both for review.
    """
    count = lambda df, n: df.groupBy(F.col("doc").alias(f"{n}_doc")).agg(F.count("*").alias(n))
    long = lambda df, n: df.select("doc", "seq", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields))))
    both = long(grounded, "g").withColumn("in_g", F.lit(True)).join(long(visual, "v").withColumn("in_v", F.lit(True)), ["doc", "seq", "field"], "full_outer")
    sized = both.join(count(grounded, "n_g"), F.col("doc") == F.col("n_g_doc"), "left").join(count(visual, "n_v"), F.col("doc") == F.col("n_v_doc"), "left")
    n_g, n_v = F.coalesce("n_g", F.lit(0)), F.coalesce("n_v", F.lit(0))
    paired, alone = n_g == n_v, n_g == 0
    kept = sized.where(paired | F.when(alone, F.col("in_v")).otherwise(F.col("in_g")))
    g, v = F.col("g"), F.col("v")
    agree = F.trim(g) == F.trim(v)
    decision = F.when(~paired, F.when(alone, "visual_intervals_unaligned_needs_review").otherwise("count_mismatch_keep_grounded_needs_review")).otherwise(fuse_decision(g, v))
    value = F.when(paired, F.coalesce(g, v)).when(alone, v).otherwise(g)
    warning = (
        F.when(paired & g.isNull() & v.isNotNull(), "FUSION_SINGLE_VISUAL_SOURCE").when(paired & g.isNotNull() & v.isNotNull() & ~agree, "FUSION_DISAGREEMENT")
        .when(~paired & value.isNotNull(), F.when(alone, "FUSION_UNALIGNED_VISUAL_INTERVAL").otherwise("FUSION_INTERVAL_COUNT_MISMATCH"))
    )
    return kept.select("doc", "seq", "field", value.alias("value"), decision.alias("decision"), warning.alias("warning"))


def fuse_decision(grounded: Column, visual: Column) -> Column:
    """Name of what fusing two readings of a field comes to."""
    return (
        F.when(grounded.isNull() & visual.isNull(), "both_abstained").when(visual.isNull(), "grounded_only").when(grounded.isNull(), "visual_only_needs_review")
        .when(F.trim(grounded.cast("string")) == F.trim(visual.cast("string")), "agreement_keep_grounded_provenance").otherwise("disagreement_keep_grounded_needs_review")
    )


def selective_acceptance(raw: DataFrame, constrained: DataFrame) -> DataFrame:
    """Intervals of each document: the constrained ones if there are more of them, else the raw ones."""
    n = lambda df, c: df.groupBy("doc").agg(F.count("*").alias(c))
    chosen = n(raw, "n_raw").join(n(constrained, "n_new"), "doc", "full_outer").select("doc", (F.coalesce("n_new", F.lit(0)) > F.coalesce("n_raw", F.lit(0))).alias("accepted"))
    mark = lambda df, a: df.select("doc", "seq", "top", "bottom").join(chosen.where(F.col("accepted") == a), "doc")
    return mark(constrained, True).unionByName(mark(raw, False))


def greedy_matches(predicted: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Per document tp, fp and fn of points: each prediction, in order, takes the nearest expected one that is free.

    Both sides have doc and value; a document's points are folded over inside
    one row.  Of equally near ones the smaller is taken.
    """
    side = lambda df, n: df.where("value is not null").groupBy(F.col("doc").alias(f"{n}_doc")).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias(n))
    both = side(predicted, "p").join(side(expected, "e"), F.col("p_doc") == F.col("e_doc"), "full_outer")
    none = F.array().cast("array<double>")
    row = both.select(F.coalesce("p_doc", "e_doc").alias("doc"), F.coalesce("p", none).alias("p"), F.coalesce("e", none).alias("e"))
    start = F.struct(F.col("e").alias("free"), F.lit(0).alias("tp"))

    def step(acc: Column, v: Column) -> Column:
        near = F.array_min(F.transform(acc["free"], lambda x, i: F.struct(F.abs(x - v).alias("d"), x.alias("x"), i.alias("i"))))
        hit = F.coalesce(near["d"] <= tolerance, F.lit(False))
        return F.struct(F.when(hit, F.filter(acc["free"], lambda x, i: i != near["i"])).otherwise(acc["free"]).alias("free"), (acc["tp"] + hit.cast("int")).alias("tp"))

    tp = F.aggregate("p", start, step, lambda a: a["tp"])
    return row.withColumn("tp", tp).select("doc", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("e") - F.col("tp")).alias("fn"))


def exact_sequences(predicted: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Per document: the same number of values, each within the tolerance in order; and every one near some expected value."""
    side = lambda df, n: df.groupBy(F.col("doc").alias(f"{n}_doc")).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias(n))
    both = side(predicted, "p").join(side(expected, "e"), F.col("p_doc") == F.col("e_doc"), "full_outer")
    none = F.array().cast("array<double>")
    row = both.select(F.coalesce("p_doc", "e_doc").alias("doc"), F.coalesce("p", none).alias("p"), F.coalesce("e", none).alias("e"))
    exact = (F.size("p") == F.size("e")) & F.forall(F.zip_with("p", "e", lambda a, b: F.abs(a - b) <= tolerance), lambda x: F.coalesce(x, F.lit(False)))
    safe = F.forall("p", lambda a: F.exists("e", lambda b: F.abs(a - b) <= tolerance))
    return row.select("doc", exact.alias("exact"), safe.alias("safe"))
