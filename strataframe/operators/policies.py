"""Policies over several readings, their audits, and records built or changed by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.matching import ratio
from strataframe.operators.propagation import unit
from strataframe.operators.readiness import reasons


def detectability(documents: DataFrame) -> DataFrame:
    """event, documents, flagged, share: of the documents with an event, how many any constraint flags.

    ``documents`` has doc, events (array) and violations (a number).
    """
    e = documents.select("doc", "violations", F.explode(F.array_distinct("events")).alias("event"))
    return e.groupBy("event").agg(F.count("*").alias("documents"), F.count_if(F.col("violations") > 0).alias("flagged")).withColumn("share", ratio(F.col("flagged"), F.col("documents")))


def error_events(per: DataFrame) -> DataFrame:
    """``per`` (predicted, matched, referred, named: matched ones with the right name) with counts of errors and their tags."""
    missing, spurious, named = F.col("referred") - F.col("matched"), F.col("predicted") - F.col("matched"), F.col("matched") - F.col("named")
    return per.withColumns({"missing": missing, "spurious": spurious, "misnamed": named}).withColumn("events", F.array_sort(reasons({
        "zero_output_document": F.col("predicted") == 0, "boundary_omission": missing > 0, "spurious_interval": spurious > 0, "lithology_semantic_error": named > 0,
    })))


def profile_summary(rows: DataFrame, by: str, text: str, numbers: list[str]) -> DataFrame:
    """Per profile: exact texts, errors of numbers, rows right in all fields, wrong numbers and omissions.

    A field f is in the columns ``r_f`` and ``p_f``; null equals null.
    """
    fields = [text, *numbers]
    same = {f: F.col(f"r_{f}").eqNullSafe(F.col(f"p_{f}")) for f in fields}
    whole = F.lit(True)
    for f in fields:
        whole = whole & same[f]
    wrong = sum((F.count_if(F.col(f"p_{f}").isNotNull() & ~same[f]) for f in numbers), F.lit(0))
    omitted = sum((F.count_if(F.col(f"p_{f}").isNull()) for f in fields), F.lit(0))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(same[text].cast("double")).alias("exact_text"), *(F.avg(F.abs(F.col(f"p_{f}") - F.col(f"r_{f}"))).alias(f"mae_{f}") for f in numbers), F.avg(whole.cast("double")).alias("complete"), wrong.alias("wrong_numbers"), omitted.alias("omissions"),
    )


def unique_support(sections: DataFrame, first: DataFrame, least: int = 2) -> DataFrame:
    """case_id, chosen: the section with unique greatest support that holds all of the first reading, else the first reading.

    ``sections`` has case_id, section (an array of (top, bottom)) and support;
    ``first`` has case_id and section.  Sections with equal support rank by
    length, then by their intervals; equal support at the top decides nothing.
    """
    f = first.select(F.col("case_id").alias("f_case"), F.col("section").alias("f_section"))
    ok = (F.col("support") >= least) & (F.size(F.array_except("f_section", "section")) == 0)
    fit = sections.join(f, F.col("case_id") == F.col("f_case")).where(ok)
    ranked = fit.withColumns({"_r": F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("support"), F.desc(F.size("section")), F.desc("section"))), "_next": F.lead("support").over(Window.partitionBy("case_id").orderBy(F.desc("support"), F.desc(F.size("section")), F.desc("section")))})
    top = ranked.where((F.col("_r") == 1) & (F.col("support") > F.coalesce("_next", F.lit(-1)))).select(F.col("case_id").alias("t_case"), F.col("section").alias("t_section"))
    return f.join(top, F.col("f_case") == F.col("t_case"), "left").select(F.col("f_case").alias("case_id"), F.coalesce("t_section", "f_section").alias("chosen"))


def peer_decision(first: Column, peer: Column, supported: Column, exact_support: Column) -> Column:
    """What to do with a peer's section: its decision by name.

    ``first`` and ``peer`` are arrays of (top, bottom), ``supported`` the union
    of the intervals of sections with support that lie within the peer's, and
    ``exact_support`` the support of the peer's own section.
    """
    joined = (F.size(peer) > 0) & (F.get(peer, F.lit(0))["top"] == 0) & F.forall(F.zip_with(F.slice(peer, 1, F.greatest(F.size(peer) - 1, F.lit(0))), F.slice(peer, 2, F.greatest(F.size(peer), F.lit(1))), lambda a, b: a["bottom"] == b["top"]), lambda x: x)
    covered = F.size(F.array_except(peer, F.concat(first, supported))) == 0
    return (
        F.when(~joined | (peer == first), "peer_not_complete_or_unchanged").when(exact_support >= 2, "peer_exact_highres_consensus").when(F.size(F.array_except(first, peer)) > 0, "first_pass_conflicts_with_peer")
        .when(covered, "peer_complementary_highres_consensus").otherwise("insufficient_peer_corroboration")
    )


def number_candidates(regions: DataFrame, source: str) -> DataFrame:
    """doc, value, source, source_text, confidence: every number of a document's regions once, where it was read most surely."""
    hits = regions.select("doc", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.explode(F.regexp_extract_all("text", F.lit(r"([-+]?[0-9]+(?:[.,][0-9]+)?)"), 1)).alias("source_text"))
    named = hits.withColumn("number", F.replace("source_text", F.lit(","), F.lit(".")))
    best = named.groupBy("doc", "number").agg(F.max("confidence").alias("confidence"), F.max_by("source_text", F.struct("confidence", "source_text")).alias("source_text"))
    return best.select("doc", F.col("number").cast("double").alias("value"), F.lit(source).alias("source"), "source_text", "confidence")


def frozen_split(rows: DataFrame, record: str, content: str, share: float, salt: str, earlier: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``split``: whole contents in order of their salted hash, the first of them for development.

    As many contents are taken as the share says, half to even.  Records that
    repeat, or that share a record or a content with ``earlier`` rows, are
    refused.  The bound is the hash of the last content that is taken, found
    by its rank, so contents are compared with one value.
    """
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    if not rows.groupBy(record).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"repeated {record}")
    if earlier is not None:
        for c in (record, content):
            if not rows.join(earlier.select(F.col(c).alias("_e")).distinct(), F.col(c) == F.col("_e"), "left_semi").isEmpty():
                raise ValueError(f"{c} of an earlier split")
    h = F.sha2(F.concat_ws(":", F.lit(salt), F.col(content).cast("string")).cast("binary"), 256)
    contents = rows.select(h.alias("h")).distinct()
    take = round(contents.count() * share)
    if not take:
        return rows.withColumn("split", F.lit("heldout"))
    bound = contents.orderBy("h").limit(take).agg(F.max("h")).first()[0]  # the rank is found by a bounded sort in each task
    return rows.withColumn("split", F.when(h <= bound, "development").otherwise("heldout"))


def accepted_metrics(rows: DataFrame, accepted: Column, exact: Column) -> DataFrame:
    """Coverage of a policy and the exact share of what it accepts."""
    return rows.agg(F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & exact).alias("exact"), ratio(F.count_if(accepted), F.count("*")).alias("coverage"), ratio(F.count_if(accepted & exact), F.count_if(accepted)).alias("exact_rate"))


def assurance(per: DataFrame) -> DataFrame:
    """One row of shares over documents (proposal, raw_correct, accepted, accepted_correct); null where nothing is counted."""
    s = per.agg(*(F.sum(c).alias(c) for c in ("proposal", "raw_correct", "accepted", "accepted_correct")), F.count_if(F.col("accepted") > 0).alias("accepted_documents"), F.count_if(F.col("accepted_correct") < F.col("accepted")).alias("error_documents"))
    return s.select(
        "proposal", "accepted", "accepted_correct", ratio(F.col("raw_correct"), F.col("proposal")).alias("raw_precision"), ratio(F.col("accepted_correct"), F.col("accepted")).alias("accepted_precision"), ratio(F.col("accepted"), F.col("proposal")).alias("accepted_coverage"),
        ratio(F.col("accepted") - F.col("accepted_correct"), F.col("accepted")).alias("false_acceptance_rate"), "accepted_documents", ratio(F.col("error_documents"), F.col("accepted_documents")).alias("document_error_rate"),
    )


def ranked_pairs(candidates: DataFrame, reach: int = 14, least_gap: float = 0.025) -> DataFrame:
    """doc, left, right, lowest: pairs of a document's candidate depths that lie at most ``reach`` ranks apart.

    Of candidates in one twentieth of a metre the likeliest counts.  Each
    candidate meets the next ``reach`` ones only.
    """
    once = candidates.groupBy("doc", F.bround(F.col("value") * 20, 0).alias("bin")).agg(F.max_by(F.struct("value", "probability"), F.struct("probability", (-F.col("value")).alias("v"))).alias("c"))
    order = Window.partitionBy("doc").orderBy("c.value").rowsBetween(1, reach)
    ahead = once.select("doc", "c.value", "c.probability", F.collect_list("c").over(order).alias("next"))
    p = ahead.select("doc", F.col("value").alias("left"), "probability", F.explode("next").alias("n"))
    return p.where(F.col("n.value") > F.col("left") + least_gap).select("doc", "left", F.col("n.value").alias("right"), F.least("probability", "n.probability").alias("lowest"))


def synthetic_boundaries(count: int, spark, seed: int) -> DataFrame:
    """doc, seq, top, bottom, thickness of invented boreholes: 2 to 6 layers of 0.5 to 3.5 metres, told to the centimetre."""
    doc = spark.range(count).select(F.col("id").alias("doc"))
    n = (F.floor(unit(F.col("doc").cast("string"), f"{seed}:n:") * 5) + 2).cast("int")
    layers = doc.withColumn("seq", F.explode(F.sequence(F.lit(0), n - 1)))
    thick = F.round(0.5 + 3.0 * unit(F.concat_ws("/", F.col("doc").cast("string"), F.col("seq").cast("string")), f"{seed}:t:"), 2).cast("decimal(8,2)")
    upto = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return layers.withColumn("thickness", thick).withColumn("bottom", F.sum("thickness").over(upto).cast("decimal(10,2)")).withColumn("top", (F.col("bottom") - F.col("thickness")).cast("decimal(10,2)")).select("doc", "seq", "top", "bottom", "thickness")


def with_candidate(record: Column, value: Column, text: Column, confidence: Column, code: str) -> Column:
    """An envelope with a candidate's value: read again, for review, its warning told once."""
    codes = F.coalesce(record["warning_codes"], F.array().cast("array<string>"))
    return (
        record.withField("value", value.cast("string")).withField("source_text", text).withField("extraction_method", F.lit("fusion")).withField("confidence", confidence.cast("double"))
        .withField("validation_status", F.lit("needs_review")).withField("warning_codes", F.array_union(codes, F.array(F.lit(code))))
    )


def interval_with_candidate(intervals: Column, place: int, field: str, value: Column, text: Column, confidence: Column, code: str) -> Column:
    """Intervals of which the one at a place has a candidate's value in one field; all others as they were."""
    return F.transform(intervals, lambda x, i: F.when(i == place, x.withField(field, with_candidate(x[field], value, text, confidence, code))).otherwise(x))


def region_summary(regions: DataFrame) -> DataFrame:
    """Per document: regions, characters and confidences, without any text or value."""
    return regions.groupBy("doc").agg(F.count("*").alias("regions"), F.sum(F.length("text")).alias("characters"), F.count("confidence").alias("confident"), F.min("confidence").alias("least"), F.avg("confidence").alias("mean"), F.max("confidence").alias("most"))


def presence(provenance: DataFrame) -> DataFrame:
    """field, records, present of every field of records told in long form (document_id, field_path, value)."""
    f = F.regexp_replace("field_path", r"\[[0-9]+\]", "")
    return provenance.groupBy(f.alias("field")).agg(F.count_distinct("document_id").alias("records"), F.count("value").alias("present"))


def entity_inventory(entities: DataFrame) -> DataFrame:
    """drawing, kind, n, handles: entities by kind and how many distinct handles they have, handles as plain upper-case hex."""
    return entities.groupBy("drawing", "kind").agg(F.count("*").alias("n"), F.count_distinct(handle(F.col("handle"))).alias("handles"))


def handle(value: Column) -> Column:
    """A handle as upper-case hex digits without a prefix; numbers are turned into hex, empty ones are null."""
    text = F.upper(F.trim(value.cast("string")))
    bare = F.regexp_replace(text, "^0X", "")
    return F.when(text.rlike("^[0-9]+$") & ~text.rlike("^0X"), F.hex(text.cast("long"))).otherwise(F.nullif(bare, F.lit("")))


def drawn_coverage(source: DataFrame, drawn: DataFrame) -> DataFrame:
    """drawing, source, drawn, extra, share: distinct ids of a drawing that were drawn, and ids drawn from nowhere."""
    s, d = source.select("drawing", "id").distinct().withColumn("_s", F.lit(1)), drawn.select("drawing", "id").distinct().withColumn("_d", F.lit(1))
    both = s.join(d, ["drawing", "id"], "full_outer").groupBy("drawing").agg(F.count("_s").alias("source"), F.count_if(F.col("_s").isNotNull() & F.col("_d").isNotNull()).alias("drawn"), F.count_if(F.col("_s").isNull()).alias("extra"))
    return both.withColumn("share", ratio(F.col("drawn"), F.col("source")))


def silver_values(a: DataFrame, b: DataFrame, c: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, value, status, confidence of records that two readers have, with a third one's support.

    Keys that only one of the two has are left out; the third may lack any.
    The value is the agreed or supported one, the one that is there, or null
    where the readers differ.
    """
    from strataframe.operators import fusion

    side = lambda df, n: df.select(*keys, *(F.col(f).cast("string").alias(f"{n}_{f}") for f in fields))
    both = side(a, "a").join(side(b, "b"), keys).join(side(c, "c"), keys, "left")
    parts = []
    for f in fields:
        x, y, z = (F.col(f"{n}_{f}") for n in "abc")
        s = fusion.adjudicate(x, y, z)
        value = F.when(s.isin("AGREEMENT", "CORROBORATED_A", "SINGLE_SOURCE_A"), x).when(s.isin("CORROBORATED_B", "SINGLE_SOURCE_B"), y)
        parts.append(F.struct(F.lit(f).alias("field"), value.alias("value"), s.alias("status"), fusion.status_confidence(s).alias("confidence")))
    return both.select(*keys, F.inline(F.array(*parts)))


def random_cohorts(rows: DataFrame, key: str, seeds: int, size: int) -> DataFrame:
    """seed and ``rows`` of as many random cohorts of a size: those of least hash under each seed."""
    h = lambda s: F.sha2(F.concat_ws(":", F.lit(s), F.col(key).cast("string")).cast("binary"), 256)
    out = None
    for s in range(seeds):
        one = rows.withColumn("_h", h(s)).orderBy("_h").limit(size).drop("_h").withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def all_bins(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Every equal-width bin with n, mean confidence and accuracy; empty ones have n 0 and nulls."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(b.alias("f_bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, F.col("bin") == F.col("f_bin"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def signature(parts: list[Column]) -> Column:
    """Categories of a row as one text, missing ones told."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("none")) for p in parts))


def json_intervals(payloads: DataFrame, scale_to_m: float) -> tuple[DataFrame, DataFrame]:
    """(doc, place, top, bottom, lithology) of well-formed intervals of JSON answers, and (doc, valid, invalid).

    Depths have to be numbers, not texts or truth values, the top at least 0
    and above the bottom.
    """
    items = payloads.select("doc", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.intervals", "array<variant>")).alias("place", "i"))
    number = lambda f: F.when(F.schema_of_variant(F.try_variant_get("i", f"$.{f}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get("i", f"$.{f}", "double"))
    rows = items.select("doc", "place", number("top_depth_source").alias("top"), number("bottom_depth_source").alias("bottom"), F.nullif(F.trim(F.try_variant_get("i", "$.lithology_raw", "string")), F.lit("")).alias("lithology"))
    ok = F.coalesce((F.col("top") >= 0) & (F.col("bottom") > F.col("top")), F.lit(False))
    counts = rows.groupBy("doc").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    return rows.where(ok).withColumns({"top": F.col("top") * scale_to_m, "bottom": F.col("bottom") * scale_to_m}), counts


def metres_of(metres: Column, feet: Column) -> Column:
    """A depth told in metres or, where it isn't, in feet."""
    return F.coalesce(metres.cast("double"), feet.cast("double") * 0.3048)


def text_intervals(texts: DataFrame, pattern: str, open_pattern: str, final: str) -> DataFrame:
    """doc, top, bottom, name of all intervals a text tells, each once, in feet; open ones end at the final depth.

    ``pattern`` has groups top, bottom, name; ``open_pattern`` top, name.
    """
    pick = lambda p, k: F.regexp_extract_all("text", F.lit(p), k)
    closed = F.transform(F.arrays_zip(pick(pattern, 1).alias("a"), pick(pattern, 2).alias("b"), pick(pattern, 3).alias("n")), lambda x: F.struct(x["a"].cast("double").alias("top"), x["b"].cast("double").alias("bottom"), F.lower(x["n"]).alias("name")))
    ended = F.transform(F.arrays_zip(pick(open_pattern, 1).alias("a"), pick(open_pattern, 2).alias("n")), lambda x: F.struct(x["a"].cast("double").alias("top"), F.col(final).cast("double").alias("bottom"), F.lower(x["n"]).alias("name")))
    rows = texts.select("doc", F.inline(F.concat(closed, ended)))
    return rows.where("bottom > top").distinct()


def public_pools(candidates: DataFrame, key: str, salt: str) -> DataFrame:
    """record_key, pool: each record's candidates in order, rounded to six decimals, under a name that hides the record."""
    name = F.substring(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256), 1, 20)
    one = F.struct("page", "y", F.round(F.col("top").cast("double"), 6).alias("top"), F.round(F.col("bottom").cast("double"), 6).alias("bottom"), F.round("node_score", 6).alias("node_score"))
    return candidates.groupBy(name.alias("record_key")).agg(F.array_sort(F.collect_list(one)).alias("pool"))


def index_readiness(rows: DataFrame, formal: tuple[str, ...]) -> DataFrame:
    """eligibility, n, formal: entries of an index by eligibility, missing ones told."""
    e = F.coalesce("eligibility", F.lit("missing"))
    return rows.groupBy(e.alias("eligibility")).agg(F.count("*").alias("n")).withColumn("formal", F.col("eligibility").isin(*formal))


def field_at(provenance: DataFrame, paths: list[str]) -> DataFrame:
    """document_id and one column for each path (``borehole.x``, ``intervals[2].y``) of records told in long form."""
    return provenance.where(F.col("field_path").isin(*paths)).groupBy("document_id").agg(*(F.max(F.when(F.col("field_path") == p, F.col("value"))).alias(p) for p in paths))


def chosen_rows(rows: DataFrame, equal: dict[str, str], prefix: dict[str, str]) -> DataFrame:
    """Rows whose columns are the given texts or begin with them; nulls are neither."""
    ok = F.lit(True)
    for c, v in equal.items():
        ok = ok & F.coalesce(F.col(c) == v, F.lit(False))
    for c, v in prefix.items():
        ok = ok & F.coalesce(F.col(c).startswith(v), F.lit(False))
    return rows.where(ok)


def engine_table(rows: DataFrame, doc: str, a: Column, b: Column) -> DataFrame:
    """doc (null: all), both, only_a, only_b, neither: where two engines agree, per document and over all."""
    return rows.select(F.col(doc).alias("doc"), F.coalesce(a, F.lit(False)).alias("a"), F.coalesce(b, F.lit(False)).alias("b")).rollup("doc").agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
    )


def certificate(per: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Actions and documents of a group without a wrong action, with upper bounds of both error rates; a group with errors is refused.

    ``per`` has name, actions and errors of each document.
    """
    wrong = per.groupBy("name").agg(F.sum("errors").alias("e")).where("e > 0").limit(3).collect()
    if wrong:
        raise ValueError(f"groups with errors: {[r['name'] for r in wrong]}")
    bound = lambda n: F.when(F.col(n) > 0, 1 - F.pow(F.lit(alpha), F.lit(1.0) / F.col(n)))
    s = per.groupBy("name").agg(F.sum("actions").alias("actions"), F.count_if(F.col("actions") > 0).alias("documents"))
    return s.withColumns({"action_bound": bound("actions"), "document_bound": bound("documents")})


def without_sources(candidates: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """``candidates`` once for every variant, without the sources that it leaves out."""
    v = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.array(*map(F.lit, out)).cast("array<string>").alias("out")) for n, out in variants.items())))
    return candidates.withColumn("_v", v).where(~F.array_contains("_v.out", F.col("source"))).withColumn("variant", F.col("_v.variant")).drop("_v")


def routed(expert: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, route: the expert's value where it has one, else the baseline's."""
    e = expert.select(F.col(key).alias("e_key"), F.col(value).alias("e_value"))
    both = baseline.join(e, F.col(key) == F.col("e_key"), "left")
    return both.select(key, F.coalesce("e_value", value).alias(value), F.when(F.col("e_value").isNotNull(), "expert").otherwise("baseline").alias("route"))


def fold_summary(rows: DataFrame, value: str) -> DataFrame:
    """Mean of a measure over folds, and how many are over 0."""
    return rows.agg(F.count("*").alias("folds"), F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("positive"), F.min(value).alias("least"))


def role_evidence(rows: DataFrame, roles: list[str]) -> DataFrame:
    """``rows`` (candidates: an array of structs with provenance, an array of texts) with how many have evidence of a role."""
    wanted = F.array(*map(F.lit, roles))
    return rows.withColumn("role_evidence", F.size(F.filter("candidates", lambda c: F.arrays_overlap(c["provenance"], wanted))))


def dataset_records(answers: DataFrame) -> DataFrame:
    """doi, title, publisher, year, rights of a metadata service's JSON answers (doc, answer): first titles, sorted distinct rights."""
    j = F.try_parse_json("answer")
    text = lambda path: F.try_variant_get(j, path, "string")
    rights = F.try_variant_get(j, "$.attributes.rightsList", "array<struct<rightsIdentifier: string>>")
    return answers.select(
        "doc", F.lower(F.coalesce(text("$.attributes.doi"), text("$.id"), F.lit(""))).alias("doi"), F.coalesce(text("$.attributes.titles[0].title"), F.lit("")).alias("title"), text("$.attributes.publisher").alias("publisher"), F.try_variant_get(j, "$.attributes.publicationYear", "int").alias("year"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(rights, F.array().cast("array<struct<rightsIdentifier: string>>")), lambda r: r["rightsIdentifier"]), lambda r: r.isNotNull()))).alias("rights"),
    )
