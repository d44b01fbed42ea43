"""Human annotations: gates, revisions, page reviews, merged pages, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.readiness import reasons

#: Statuses a person gives, tiers of machine-made references, decisions on a page.
HUMAN_STATUSES = ("single_verified", "double_verified", "expert_verified")
SILVER_TIERS = ("SILVER", "SILVER_HIGH_CONFIDENCE", "SILVER_UNCERTAIN")
DECISIONS = ("exclude", "internal_only", "anonymize_then_review", "eligible_for_annotation")


def matching_attestations(annotations: DataFrame, attestations: DataFrame) -> DataFrame:
    """The attestations (annotation_id, annotator_id, role, record_sha256) of each annotation's present record."""
    own = annotations.select(F.col("annotation_id").alias("a_id"), F.col("record_sha256").alias("a_hash"))
    return attestations.join(own, (F.col("annotation_id") == F.col("a_id")) & (F.col("record_sha256") == F.col("a_hash"))).drop("a_id", "a_hash")


def truth_gate(annotations: DataFrame, attestations: DataFrame, fields: DataFrame, require_intervals: bool = True) -> DataFrame:
    """annotation_id, annotation_status and the reasons why it is no ground truth; none if it is.

    ``annotations`` has annotation_id, annotation_status, record_sha256 and
    intervals (their number); ``fields`` the required fields' envelopes:
    annotation_id, path, validation_status, extraction_method, source_page.
    """
    valid = matching_attestations(annotations, attestations).groupBy(F.col("annotation_id").alias("v_id")).agg(F.count_distinct("annotator_id").alias("people"), F.bool_or(F.col("role") == "expert").alias("expert"))
    told = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("validation_status") == "human_verified", F.lit(False)), F.concat(F.lit("FIELD_NOT_HUMAN_VERIFIED:"), "path")),
        F.when(~F.coalesce(F.col("extraction_method") == "human", F.lit(False)), F.concat(F.lit("FIELD_NOT_HUMAN_AUTHORED:"), "path")), F.when(F.col("source_page").isNull(), F.concat(F.lit("MISSING_SOURCE_PAGE:"), "path")),
    ))
    per_field = fields.select(F.col("annotation_id").alias("f_id"), F.explode(told).alias("r")).groupBy("f_id").agg(F.array_sort(F.collect_list("r")).alias("field_reasons"))
    both = annotations.join(valid, F.col("annotation_id") == F.col("v_id"), "left").join(per_field, F.col("annotation_id") == F.col("f_id"), "left")
    human = F.coalesce(F.col("annotation_status").isin(*HUMAN_STATUSES), F.lit(False))
    own = reasons({
        "ANNOTATION_NOT_HUMAN_VERIFIED": ~human, "MISSING_VALID_VERIFICATION_ATTESTATION": human & F.col("people").isNull(), "INSUFFICIENT_INDEPENDENT_ATTESTATIONS": (F.col("annotation_status") == "double_verified") & (F.coalesce("people", F.lit(0)) < 2),
        "MISSING_EXPERT_ATTESTATION": (F.col("annotation_status") == "expert_verified") & ~F.coalesce("expert", F.lit(False)), "NO_INTERVALS": F.lit(require_intervals) & (F.coalesce("intervals", F.lit(0)) == 0),
    })
    none = F.array().cast("array<string>")
    return both.select("annotation_id", "annotation_status", F.concat(own, F.coalesce("field_reasons", none)).alias("reasons"))


def silver_gate(references: DataFrame) -> DataFrame:
    """``references`` (tier, has_record, claims_human) with the reasons why they aren't machine-made references."""
    return references.withColumn("reasons", reasons({
        "REFERENCE_NOT_SILVER": ~F.coalesce(F.upper("tier").isin(*SILVER_TIERS), F.lit(False)), "MISSING_SILVER_RECORD": ~F.coalesce("has_record", F.lit(False)), "SILVER_ROW_CLAIMS_HUMAN_GT": F.col("claims_human"),
    }))


def surface_gate(boreholes: DataFrame, least_points: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per document the reasons against using it in a surface, and one row with the reasons against the surface as a whole.

    ``boreholes`` has document_id, x, y, system, collar, collar_status, has_interval, depth and depth_status.
    """
    if least_points < 3:
        raise ValueError("a surface needs three points at least")
    known = lambda c: F.col(c).isNotNull()
    verified = lambda c: F.coalesce(F.col(c) == "human_verified", F.lit(False))
    has = F.coalesce("has_interval", F.lit(False))
    told = boreholes.withColumn("reasons", reasons({
        "MISSING_X_COORDINATE": ~known("x"), "MISSING_Y_COORDINATE": ~known("y"), "MISSING_COORDINATE_SYSTEM": ~known("system"), "MISSING_COLLAR_ELEVATION": ~known("collar"), "COLLAR_ELEVATION_NOT_HUMAN_VERIFIED": known("collar") & ~verified("collar_status"),
        "MISSING_TARGET_INTERVAL": ~has, "MISSING_TARGET_BOUNDARY": has & ~known("depth"), "TARGET_BOUNDARY_NOT_HUMAN_VERIFIED": has & known("depth") & ~verified("depth_status"),
    }))
    whole = told.agg(F.count_if(F.size("reasons") == 0).alias("eligible"), F.count_distinct("system").alias("systems"))
    whole = whole.withColumn("reasons", reasons({"MIXED_COORDINATE_SYSTEMS": F.col("systems") > 1, "INSUFFICIENT_ELIGIBLE_POINTS": F.col("eligible") < least_points}))
    return told, whole.withColumn("ready", F.size("reasons") == 0)


def readiness_counts(gated: DataFrame) -> DataFrame:
    """kind, name, n: annotations by status, exportable ones, and reasons by their first word."""
    by_status = gated.groupBy(F.coalesce("annotation_status", F.lit("missing")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "name", "n")
    exportable = gated.agg(F.count_if(F.size("reasons") == 0).alias("n")).select(F.lit("exportable").alias("kind"), F.lit("exportable").alias("name"), "n")
    why = gated.select(F.explode("reasons").alias("r")).groupBy(F.substring_index("r", ":", 1).alias("name")).agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    return by_status.unionByName(exportable).unionByName(why)


def save_revisions(current: DataFrame, incoming: DataFrame, key: str = "annotation_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, history, conflicts) after a batch of revisions, one a key.

    A revision is taken if its key is new or its number follows the present
    one; the present row then goes to history.  Others are conflicts, as are
    all revisions of a key that comes twice.
    """
    now = current.select(F.col(key).alias("c_key"), F.col("revision").alias("c_revision"))
    checked = incoming.withColumn("_n", F.count("*").over(Window.partitionBy(key))).join(now, F.col(key) == F.col("c_key"), "left")
    fits = (F.col("_n") == 1) & (F.col("c_revision").isNull() | (F.col("revision") == F.col("c_revision") + 1))
    taken, refused = checked.where(fits).select(*incoming.columns), checked.where(~fits).select(*incoming.columns, (F.col("c_revision") + 1).alias("expected"))
    keys = taken.select(F.col(key).alias("t_key"))
    history = current.join(keys, F.col(key) == F.col("t_key"), "left_semi")
    return current.join(keys, F.col(key) == F.col("t_key"), "left_anti").unionByName(taken), history, refused


def review_decision(reviews: DataFrame) -> DataFrame:
    """``reviews`` with what is wrong with each decision; a valid one has no faults.

    Columns: decision, reviewer, phase1, complete, redactions, and checks, an
    array of (name, status, action).
    """
    eligible = F.col("decision") == "eligible_for_annotation"
    open_ = F.exists("checks", lambda c: (c["status"] == "uncertain") | ((c["status"] == "present") & ~F.coalesce(c["action"] == "cleared", F.lit(False))))
    return reviews.withColumn("faults", reasons({
        "INVALID_DECISION": ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "MISSING_REVIEWER": F.coalesce(F.trim("reviewer"), F.lit("")) == "", "REDACTIONS_NOT_REQUIRED": (F.col("decision") == "anonymize_then_review") & ~F.coalesce("redactions", F.lit(False)),
        "NOT_BOREHOLE_CONTENT": eligible & ~F.coalesce("phase1", F.lit(False)), "RENDER_INCOMPLETE": eligible & ~F.coalesce("complete", F.lit(False)), "REDACTIONS_LEFT": eligible & F.coalesce("redactions", F.lit(False)), "UNRESOLVED_CHECKS": eligible & F.coalesce(open_, F.lit(False)),
    }))


def review_audit(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """decision, n over all decisions, zeros told, and the items without a review as ``unreviewed``.

    Of several reviews of an item that of the greatest revision counts.
    """
    latest = reviews.groupBy(F.col("item").alias("r_item")).agg(F.max_by("decision", "revision").alias("decision"))
    counts = items.join(latest, F.col("item") == F.col("r_item"), "left").groupBy(F.coalesce("decision", F.lit("unreviewed")).alias("found")).agg(F.count("*").alias("n"))
    every = items.sparkSession.createDataFrame([(d,) for d in (*DECISIONS, "unreviewed")], "decision string")
    return every.join(counts, F.col("decision") == F.col("found"), "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def merge_pages(pages: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Header rows and renumbered intervals of documents whose pages were annotated one by one.

    ``pages`` has source, page, status, the header fields and intervals, an
    array of structs.  Of a field the first value on a page counts; different
    values are a conflict, and so is a page nobody verified.
    """
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("page"))).alias(f) for f in fields]
    clash = F.array_compact(F.array(*(F.when(F.count_distinct(f) > 1, f) for f in fields)))
    heads = pages.groupBy("source").agg(*first, F.count("*").alias("pages"), clash.alias("conflicts"), F.bool_and(F.col("status").isin(*HUMAN_STATUSES)).alias("verified"))
    items = pages.select("source", "page", F.posexplode("intervals").alias("place", "i"))
    order = Window.partitionBy("source").orderBy("page", "place")
    return heads, items.select("source", F.format_string("I%03d", F.row_number().over(order)).alias("interval_id"), "page", "i.*")


def field_reviews(fields: DataFrame, low: float = 0.7) -> DataFrame:
    """annotation_id, path, priority, reason codes and confidence of every field that somebody should look at.

    ``fields`` has annotation_id, path, value, confidence, validation_status,
    required and codes, an array of the constraints' codes that name the path.
    """
    own = reasons({
        "MISSING_REQUIRED_MVP_FIELD": F.col("required") & (F.coalesce(F.col("value"), F.lit("")) == ""), "LOW_CONFIDENCE": F.col("confidence") < low, "FIELD_VALIDATION_STATUS": F.col("validation_status").isin("warning", "failed", "needs_review"),
    })
    codes = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("codes", F.array().cast("array<string>")))))
    grave = ("MISSING_REQUIRED_MVP_FIELD", "DEPTH_NOT_INCREASING", "DEPTH_SEQUENCE_INVERSION", "FINAL_DEPTH_MISMATCH")
    told = fields.select("annotation_id", "path", codes.alias("reason_codes"), "confidence").where(F.size("reason_codes") > 0)
    return told.withColumn("priority", F.when(F.arrays_overlap("reason_codes", F.array(*map(F.lit, grave))), "high").otherwise("medium"))


def blinded_tracks(items: DataFrame, tracks: list[str], salt: str) -> DataFrame:
    """Each item once for every track, under a name that tells neither the item nor the track."""
    t = F.explode(F.array(*map(F.lit, tracks)))
    return items.withColumn("track", t).withColumn("blind_id", F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "track", F.col("item").cast("string")).cast("binary"), 256), 1, 16))


def revision_faults(revisions: DataFrame, attestations: DataFrame) -> DataFrame:
    """``revisions`` (annotation_id, annotator_id, role, status, record_sha256, revision, previous) with what is wrong with each.

    A revision of a status a person gives attests its record.  For a double
    verification another person must have attested the same record, and an
    expert verification needs an expert.
    """
    others = attestations.select(F.col("annotation_id").alias("o_id"), F.col("record_sha256").alias("o_hash"), F.col("annotator_id").alias("o_who"))
    met = revisions.join(others, (F.col("annotation_id") == F.col("o_id")) & (F.col("record_sha256") == F.col("o_hash")) & (F.col("annotator_id") != F.col("o_who")), "left")
    seen = met.groupBy(F.col("annotation_id").alias("s_id"), F.col("revision").alias("s_revision")).agg(F.count("o_who").alias("others"))
    both = revisions.join(seen, (F.col("annotation_id") == F.col("s_id")) & (F.col("revision") == F.col("s_revision")), "left")
    return both.withColumn("faults", reasons({
        "UNSUPPORTED_STATUS": ~F.coalesce(F.col("status").isin("auto", *HUMAN_STATUSES), F.lit(False)), "MISSING_ANNOTATOR": F.coalesce(F.trim("annotator_id"), F.lit("")) == "", "REVISION_CONFLICT": F.col("revision") != F.col("previous") + 1,
        "NEEDS_TWO_ANNOTATORS": (F.col("status") == "double_verified") & (F.coalesce("others", F.lit(0)) < 1), "NEEDS_EXPERT": (F.col("status") == "expert_verified") & ~F.coalesce(F.col("role") == "expert", F.lit(False)),
    })).drop("s_id", "s_revision", "others")


def track_progress(items: DataFrame, done: DataFrame) -> DataFrame:
    """track, items, verified, open, foreign: how far each track of an assignment is; items nobody gave out are foreign.

    ``items`` has track and item, ``done`` track, item and status.
    """
    have = done.groupBy(F.col("track").alias("d_track"), F.col("item").alias("d_item")).agg(F.bool_or(F.col("status").isin(*HUMAN_STATUSES)).alias("ok"))
    both = items.select("track", "item").distinct().join(have, (F.col("track") == F.col("d_track")) & (F.col("item") == F.col("d_item")), "full_outer")
    ok = F.coalesce("ok", F.lit(False))
    return both.groupBy(F.coalesce("track", "d_track").alias("track")).agg(F.count("item").alias("items"), F.count_if(F.col("item").isNotNull() & ok).alias("verified"), F.count_if(F.col("item").isNotNull() & ~ok).alias("open"), F.count_if(F.col("item").isNull()).alias("foreign"))


def compare_tracks(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """item, field, first, second of fields in which two tracks of different people differ; a person in both is refused.

    Each side has item, annotator_id and the fields.
    """
    if not first.select("annotator_id").distinct().join(second.select("annotator_id").distinct(), "annotator_id", "left_semi").isEmpty():
        raise ValueError("somebody annotated in both tracks")
    side = lambda df, n: df.select("item", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields))))
    return side(first, "first").join(side(second, "second"), ["item", "field"]).where(~F.col("first").eqNullSafe(F.col("second")))
