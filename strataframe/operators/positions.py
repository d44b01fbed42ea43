"""Positioned numbers and headings of a page: runs, scales, columns and their roles.

Regions have page, x, y (centres) and more; a page's few points are folded over
inside one row, and pairs of points meet within their page only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a heading and the roles they tell.
SEMANTICS = {
    "depth": r"(?i)\b(depth|metres?\s+below|feet\s+below)\b", "lithology": r"(?i)\b(lithology|lithological|stratigraphy)\b", "description": r"(?i)\b(descriptions?|material\s+descriptions?)\b",
    "sample": r"(?i)\b(samples?|sub[ .-]*samples?)\b", "comments": r"(?i)\b(comments?|remarks?)\b",
}


#: Kinds of events that may be boundaries, and what they may belong to.
EVENT_TYPES = ("geological_boundary", "interval_boundary", "lithology_start", "stratum_start", "layer_start", "boundary", "lithology_change", "description_change")
EVENT_OWNERS = ("geological_description", "lithology", "stratigraphy", "graphic_log", "table_structure", "unknown")


def longest_increasing(values: Column) -> Column:
    """Longest strictly increasing run of an array, gaps allowed; of equally long ones that which ends highest.

    For each value the best run that ends there is kept: its length, and its
    values; a run before it wins only by being longer, so the earliest does.
    """
    kind = values.cast("array<double>")
    none = F.array().cast("array<struct<n: int, last: double, run: array<double>>>")

    def step(acc: Column, v: Column) -> Column:
        # Of the runs that may come before, the longest and earliest.
        fit = F.filter(acc, lambda r: r["last"] < v)
        longest = F.array_max(F.transform(fit, lambda r: r["n"]))
        before = F.get(F.filter(fit, lambda r: r["n"] == longest), F.lit(0))
        run = F.concat(F.coalesce(before["run"], F.array().cast("array<double>")), F.array(v))
        return F.concat(acc, F.array(F.struct((F.coalesce(before["n"], F.lit(0)) + 1).alias("n"), v.alias("last"), run.alias("run"))))

    def best(acc: Column) -> Column:
        top = F.array_max(F.transform(acc, lambda r: F.struct(r["n"].alias("n"), r["last"].alias("last"))))
        return F.get(F.filter(acc, lambda r: (r["n"] == top["n"]) & (r["last"] == top["last"])), F.lit(0))["run"]

    return F.coalesce(F.aggregate(kind, none, step, best), F.array().cast("array<double>"))


def steps(values: Column) -> Column:
    return F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), lambda a, b: b - a)


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def tick_score(values: Column) -> Column:
    """How much values look like the ticks of a scale: share of even steps times share of whole numbers; 0 under five values."""
    up = F.transform(F.filter(steps(values), lambda d: d > 0), lambda d: F.round(d, 3))
    common = median(up)
    share = lambda a, keep: F.size(F.filter(a, keep)) / F.size(a)
    regular = share(up, lambda d: F.abs(d - common) <= F.greatest(F.lit(0.01), common * 0.03))
    whole = share(values, lambda v: F.abs(v - F.bround(v, 0)) <= 1e-6)
    return F.when((F.size(values) < 5) | (F.size(up) == 0) | (common <= 0), 0.0).otherwise(regular * whole)


def numeric_clusters(regions: DataFrame, gap: float = 0.02) -> DataFrame:
    """``regions`` (page, x, y, value, confidence) with ``cluster``: columns of numbers, parted where x jumps by over ``gap``."""
    w = Window.partitionBy("page").orderBy("x", "y")
    jump = F.coalesce((F.col("x") - F.lag("x").over(w) > gap).cast("int"), F.lit(0))
    numbers = regions.where("value is not null").withColumn("_jump", jump)
    return numbers.withColumn("cluster", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_jump")


def cluster_scores(clusters: DataFrame, same_row: float = 8.0) -> DataFrame:
    """page, cluster, x, values (the depth run), score of each cluster with a run of two at least.

    Numbers within ``same_row`` of the one kept last are one row, the surest
    of which stays; the run is the longest increasing one down the page.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("value").cast("double").alias("value"), F.col("confidence").cast("double").alias("confidence"))))
    none = F.array().cast("array<struct<y: double, value: double, confidence: double>>")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(r["y"] - last["y"]) <= same_row)
        return F.when(~near, F.concat(acc, F.array(r))).when(r["confidence"] > last["confidence"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(r))).otherwise(acc)

    per = clusters.groupBy("page", "cluster").agg(F.avg("x").alias("x"), rows.alias("rows"))
    kept = per.withColumn("kept", F.when(F.size("rows") > 0, F.aggregate(F.col("rows"), none, lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).otherwise(step(acc, r)))))
    run = kept.withColumn("values", longest_increasing(F.transform("kept", lambda r: r["value"]))).where(F.size("values") > 1)
    v, n = F.col("values"), F.size("values")
    strict = F.size(F.filter(steps(v), lambda d: d > 0)) / (n - 1)
    span = F.array_max(v) - F.array_min(v)
    round_scale = (n <= 12) & F.forall(v, lambda x: (F.abs(x - F.bround(x, 0)) < 1e-6) & (x % 100 == 0))
    score = n + 6.0 * strict + 3.0 * F.log1p(span / 10) + 2.0 * F.size(F.array_distinct(v)) / n + F.when(F.get(v, F.lit(0)) <= 1.0, 2.0).otherwise(0.0) - F.when(round_scale, 4.0).otherwise(0.0)
    return run.select("page", "cluster", "x", "values", score.alias("score"))


def best_clusters(scored: DataFrame, keep: int = 5) -> DataFrame:
    """The best clusters of each page with their rank, of equal scores the leftmost first."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "cluster"))).where(F.col("rank") <= keep)


def robust_scale(points: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """page, slope, intercept, inliers, rmse of the line depth = slope * y + intercept that most points of a page lie on.

    Every pair of a page's scale points with a positive slope is a hypothesis;
    that with the most points within the tolerance wins, of equal ones that
    with the least sum of residuals, then the first.  The line is fitted anew
    through its points.  A scale has few points; they meet within their page.
    """
    p = points.where("y is not null and depth is not null").select("page", F.col("y").cast("double").alias("y"), F.col("depth").cast("double").alias("depth"))
    numbered = p.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("y", "depth")))
    pts = numbered.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("i", "y", "depth"))).alias("pts"))
    pairs = pts.select("page", "pts", F.explode("pts").alias("a")).select("page", "pts", "a", F.explode(F.filter("pts", lambda b: b["i"] > F.col("a.i"))).alias("b"))
    dy = F.col("b.y") - F.col("a.y")
    lines = pairs.where(F.abs(dy) > 1e-9).withColumn("slope", (F.col("b.depth") - F.col("a.depth")) / dy).where("slope > 0").withColumn("intercept", F.col("a.depth") - F.col("slope") * F.col("a.y"))
    off = lambda q: F.abs(q["depth"] - (F.col("slope") * q["y"] + F.col("intercept")))
    told = lines.withColumn("inside", F.filter("pts", lambda q: off(q) <= tolerance)).where(F.size("inside") > 1).withColumn("sum", F.aggregate("inside", F.lit(0.0), lambda s, q: s + off(q)))
    best = told.groupBy("page").agg(F.max_by("inside", F.struct(F.size("inside").alias("n"), (-F.col("sum")).alias("s"), (-F.col("a.i")).alias("a"), (-F.col("b.i")).alias("b"))).alias("inside"))
    fitted = best.select("page", F.explode("inside").alias("q")).groupBy("page").agg(F.regr_slope("q.depth", "q.y").alias("slope"), F.regr_intercept("q.depth", "q.y").alias("intercept"), F.count("*").alias("inliers"), F.collect_list("q").alias("q"))
    residual = F.aggregate("q", F.lit(0.0), lambda s, q: s + F.pow(q["depth"] - (F.col("slope") * q["y"] + F.col("intercept")), F.lit(2.0)))
    return fitted.where("slope > 0").select("page", "slope", "intercept", "inliers", F.sqrt(residual / F.col("inliers")).alias("rmse"))


def decode_depths(boundaries: DataFrame, scales: DataFrame, tolerance: float = 0.10, least_gap: float = 0.005) -> DataFrame:
    """page, depths, rejected, warnings: boundary positions as depths by their page's scale.

    Down the page a depth counts if it isn't above the surface or below
    ``final_depth`` (where the boundary rows have one) by more than the
    tolerance, and lies below the last one.  Without a scale all are rejected.
    """
    final = F.max("final_depth") if "final_depth" in boundaries.columns else F.lit(None).cast("double")
    per = boundaries.where("y is not null").groupBy("page").agg(F.array_sort(F.collect_list(F.col("y").cast("double"))).alias("ys"), final.alias("final"))
    s = scales.select(F.col("page").alias("s_page"), "slope", "intercept", "rmse")
    both = per.join(s, F.col("page") == F.col("s_page"), "left")
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.lit(0).alias("rejected"))

    def step(acc: Column, y: Column) -> Column:
        raw = F.col("slope") * y + F.col("intercept")
        value = F.greatest(raw, F.lit(0.0))
        last = F.when(F.size(acc["kept"]) > 0, F.element_at(acc["kept"], -1))
        bad = F.col("slope").isNull() | (raw < -tolerance) | F.coalesce(value > F.col("final") + tolerance, F.lit(False)) | F.coalesce(value <= last + least_gap, F.lit(False))
        return F.struct(F.when(bad, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(value))).alias("kept"), (acc["rejected"] + bad.cast("int")).alias("rejected"))

    told = both.withColumn("d", F.aggregate("ys", start, step))
    warnings = F.array_compact(F.array(
        F.when(F.col("slope").isNull(), "DEPTH_SCALE_UNAVAILABLE"), F.when(F.col("slope").isNotNull() & (F.col("d.rejected") > 0), "NON_MONOTONIC_OR_OUT_OF_RANGE_BOUNDARIES_REJECTED"), F.when(F.col("rmse") > tolerance / 2, "DEPTH_SCALE_HIGH_RESIDUAL"),
    ))
    return told.select("page", F.col("d.kept").alias("depths"), F.col("d.rejected").alias("rejected"), warnings.alias("warnings"))


def select_events(events: DataFrame, types: tuple[str, ...] = EVENT_TYPES, owners: tuple[str, ...] = EVENT_OWNERS, least: float = 0.5) -> DataFrame:
    """``events`` with ``selected``: of a named type and owner, with a position and enough confidence."""
    ok = F.lower("event_type").isin(*types) & F.lower("owner").isin(*owners) & F.col("y").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= least)
    return events.withColumn("selected", F.coalesce(ok, F.lit(False)))


def semantic_anchors(regions: DataFrame) -> DataFrame:
    """page, semantic, x, y, confidence, text of every region whose text names a role; one row for each role it names."""
    roles = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), s) for s, p in SEMANTICS.items())))
    return regions.select("page", F.explode(roles).alias("semantic"), "x", "y", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "text")


def panel_layout(anchors: DataFrame, row: float = 0.035) -> DataFrame:
    """page, header_y, score and bounds of the row of headings that tells most roles, lithology and description above all.

    Anchors of one page within ``row`` of an anchor are its row, the surest of
    a role counts.  Of equal rows the lowest on the page is taken.
    """
    other = anchors.select(F.col("page").alias("o_page"), F.col("semantic").alias("o_semantic"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("confidence").alias("o_confidence"), F.floor(F.col("y") / row).alias("o_band"))
    pivots = anchors.select("page", "y").distinct().withColumn("band", F.explode(F.array(F.floor(F.col("y") / row) - 1, F.floor(F.col("y") / row), F.floor(F.col("y") / row) + 1)))
    near = pivots.join(other, (F.col("page") == F.col("o_page")) & (F.col("band") == F.col("o_band")) & (F.abs(F.col("y") - F.col("o_y")) <= row))
    surest = near.groupBy("page", "y", "o_semantic").agg(F.max_by("o_x", F.struct("o_confidence", (-F.col("o_x")).alias("left"))).alias("x"))
    rows = surest.groupBy("page", "y").agg(F.count("*").alias("roles"), F.count_if(F.col("o_semantic").isin("lithology", "description")).alias("core"), F.min("x").alias("x0"), F.max("x").alias("x1")).where("core > 0")
    best = rows.withColumn("score", 4 * F.col("core") + F.col("roles")).groupBy("page").agg(F.max_by(F.struct("y", "score", "x0", "x1"), F.struct("score", "y")).alias("b"))
    return best.select("page", F.col("b.y").alias("header_y"), F.col("b.score").alias("score"), F.greatest(F.lit(0.0), F.col("b.x0") - 0.16).alias("x_min"), F.least(F.lit(1.0), F.col("b.x1") + 0.22).alias("x_max"), F.greatest(F.lit(0.0), F.col("b.y") - 0.015).alias("y_min"))


def column_roles(columns: DataFrame, anchors: DataFrame, least: float = 0.28) -> DataFrame:
    """``columns`` (page, column, centre) with the role of the best anchor (page, role, x, confidence) and its score.

    Nearness within 0.055 of the page counts, times 0.55 and 0.45 of the
    anchor's confidence; below ``least`` the role is unknown.
    """
    a = anchors.select(F.col("page").alias("a_page"), "role", F.col("x").alias("a_x"), F.col("confidence").alias("a_confidence"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("centre") - F.col("a_x")) / 0.055) * (0.55 + 0.45 * F.col("a_confidence"))
    met = columns.join(a, F.col("page") == F.col("a_page"), "left").withColumn("score", F.coalesce(near, F.lit(0.0)))
    best = met.groupBy("page", "column", "centre").agg(F.max_by(F.struct("role", "score"), F.struct("score", "a_confidence")).alias("b"))
    return best.select("page", "column", "centre", F.when(F.col("b.score") >= least, F.col("b.role")).otherwise("unknown").alias("role"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def graphic_columns(roles: DataFrame, least: float = 0.28) -> DataFrame:
    """Columns of pages that have a sure graphic log: those and their cores; other pages have none."""
    graphic = (F.col("role") == "graphic_log") & (F.col("score") >= max(least, 0.45))
    core = (F.col("role") == "core") & (F.col("score") >= least)
    has = F.bool_or(graphic).over(Window.partitionBy("page"))
    return roles.withColumn("_has", has).where((graphic | core) & F.col("_has")).drop("_has")


def union_box(regions: DataFrame, by: list[str]) -> DataFrame:
    """Smallest box around the boxes of each group; regions without one don't count."""
    return regions.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def to_page(box: list[Column], left: Column, top: Column, scale: float = 1.0) -> list[Column]:
    """A box in a tile, in the page's coordinates."""
    if scale <= 0:
        raise ValueError("the scale must be positive")
    return [(left if k % 2 == 0 else top) + v / scale for k, v in enumerate(box)]


def depth_column(regions: DataFrame, bin_width: float = 12.0, least_ranges: int = 3) -> DataFrame:
    """doc, seq, top, bottom, description of the ranges printed in the main column of a document.

    ``regions`` has doc, page, x0, y0, x1, y1 and text.  Ranges are gathered in
    bins of x; the bin with most distinct ranges wins, the leftmost of equal
    ones.  A range printed twice counts where it stands first.  Texts right of
    the column between two ranges describe the lower one.  A column whose tops
    would fall gives nothing.
    """
    pattern = F.lit(r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)\s*[-–—]\s*([0-9]+(?:[.,][0-9]+)?)(?![0-9])")
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).cast("double")
    pairs = F.zip_with(F.regexp_extract_all("text", pattern, 1), F.regexp_extract_all("text", pattern, 2), lambda a, b: F.struct(number(a).alias("top"), number(b).alias("bottom")))
    found = regions.where("x0 is not null").select("doc", "page", "x0", "y0", "y1", F.explode(pairs).alias("r")).select("doc", "page", "x0", "y0", "y1", "r.top", "r.bottom").where("top < bottom and bottom - top <= 1000")
    binned = found.withColumn("bin", F.bround(F.col("x0") / bin_width, 0).cast("long"))
    sizes = binned.groupBy("doc", "page", "bin").agg(F.count_distinct("top", "bottom").alias("n")).where(F.col("n") >= least_ranges)
    main = sizes.groupBy(F.col("doc").alias("m_doc")).agg(F.max_by(F.struct("page", "bin"), F.struct("n", (-F.col("bin")).alias("b"), "page")).alias("m"))
    own = binned.join(main, (F.col("doc") == F.col("m_doc")) & (F.col("page") == F.col("m.page")) & (F.col("bin") == F.col("m.bin")))
    once = own.groupBy("doc", "page", "top", "bottom").agg(F.min_by(F.struct("x0", "y0", "y1"), F.struct("y0", "x0")).alias("at"))
    order = Window.partitionBy("doc").orderBy("top", "bottom", "at.y0")
    rows = once.select("doc", "page", "top", "bottom", "at", (F.row_number().over(order) - 1).alias("seq"), ((F.col("at.y0") + F.col("at.y1")) / 2).alias("y"), F.avg("at.x0").over(Window.partitionBy("doc")).alias("column_x"))
    page_top = regions.where("x0 is not null").groupBy(F.col("doc").alias("t_doc"), F.col("page").alias("t_page")).agg(F.min("y0").alias("page_y"))
    placed = rows.join(page_top, (F.col("doc") == F.col("t_doc")) & (F.col("page") == F.col("t_page"))).withColumn("above", F.coalesce(F.lag("y").over(Window.partitionBy("doc").orderBy("seq")), F.col("page_y")))
    texts = regions.select(F.col("doc").alias("r_doc"), F.col("page").alias("r_page"), F.col("x0").alias("r_x"), ((F.col("y0") + F.col("y1")) / 2).alias("r_y"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("r_text")).where(~F.col("r_text").rlike("(?i)legend|borehole:|municipality:|description"))
    beside = (F.col("doc") == F.col("r_doc")) & (F.col("page") == F.col("r_page")) & (F.col("r_x") > F.col("column_x") + 20) & F.col("r_y").between(F.col("above"), F.col("y") + 2)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_y", "r_x", "r_text"))), lambda t: t["r_text"]), " ")
    return placed.join(texts, beside, "left").groupBy("doc", "seq", "top", "bottom").agg(F.nullif(words, F.lit("")).alias("description"))


def gaussian_targets(boundaries: Column, bins: int, sigma: float = 1.35) -> Column:
    """For each of ``bins`` places the highest of the bells around the boundaries (0 to 1 down the page)."""
    last = float(bins - 1)
    centres = F.transform(boundaries, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(last), v * last)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.array_max(F.transform(centres, lambda c: F.exp(-0.5 * F.pow((k - c) / sigma, F.lit(2.0))))), F.lit(0.0)))


def peaks(values: Column, threshold: float, separation: int) -> Column:
    """Places of local maxima of at least the threshold, the highest first, none within ``separation`` of a higher one."""
    n = F.size(values)
    high = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), lambda p: (p["v"] >= threshold) & (p["v"] >= F.coalesce(F.get(values, -p["i"] - 1), F.lit(-1.0))) & (p["v"] >= F.when(-p["i"] + 1 < n, F.get(values, -p["i"] + 1)).otherwise(-1.0)))
    ranked = F.reverse(F.array_sort(high))
    kept = F.aggregate(ranked, F.array().cast("array<int>"), lambda acc, p: F.when(F.exists(acc, lambda k: F.abs(k + p["i"]) < separation), acc).otherwise(F.concat(acc, F.array(-p["i"]))))
    return F.array_sort(kept)


#: Words of the headings of printed depth columns, the first that fits first.
COLUMN_HEADINGS = (
    ("cumulative_depth", r"(?i)depth\s*interval|teufen?intervall|intervalle?\s+de\s+profondeur|\bmetres?\b|\bmeter\b|\btiefe\b|\bteufe\b|\bprofondeur\b"),
    ("thickness", r"(?i)\bthickness\b|\bm(?:ä|ae)chtigkeit\b|\b(?:é|e)paisseur\b"),
)


def block_headings(words: DataFrame) -> DataFrame:
    """page, block, role, x, text: blocks of words (page, block, line, x, text) that name a column, a row for each role."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "text"))), lambda w: w["text"]), " ")
    per = words.groupBy("page", "block").agg(text.alias("text"), F.avg("x").alias("x"))
    roles = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), r) for r, p in COLUMN_HEADINGS)))
    return per.select("page", "block", F.explode(roles).alias("role"), "x", "text")


def surface_depth_column(rows: DataFrame) -> DataFrame:
    """page, x0, y0, x1, y1 in pixels of the column under a heading of ``depth`` beside ``surface``; none without both.

    ``rows`` has page, width, height, x, y (centres), bottom, text, confidence.
    The surest pair within 0.12 of the width and 0.08 of the height counts.
    """
    named = lambda w: rows.where(F.col("text").rlike(rf"(?i)\b{w}\b"))
    right = named("surface").select(F.col("page").alias("r_page"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("bottom").alias("r_bottom"), F.coalesce("confidence", F.lit(0.0)).alias("r_c"))
    near = (F.col("page") == F.col("r_page")) & (F.abs(F.col("x") - F.col("r_x")) <= F.col("width") * 0.12) & (F.abs(F.col("y") - F.col("r_y")) <= F.col("height") * 0.08)
    pairs = named("depth").join(right, near)
    sure = F.struct((F.coalesce("confidence", F.lit(0.0)) + F.col("r_c")).alias("c"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))
    best = pairs.groupBy("page", "width", "height").agg(F.max_by(F.struct(((F.col("x") + F.col("r_x")) / 2).alias("centre"), F.greatest("bottom", "r_bottom").alias("below")), sure).alias("b"))
    whole = lambda c: F.floor(c).cast("int")
    box = best.select(
        "page", F.greatest(F.lit(0), whole(F.col("b.centre") - F.col("width") * 0.115)).alias("x0"), F.greatest(F.lit(0), whole(F.col("b.below") + F.col("height") * 0.02)).alias("y0"),
        F.least(F.col("width").cast("int"), whole(F.col("b.centre") + F.col("width") * 0.115)).alias("x1"), F.least(F.col("height").cast("int"), whole(F.col("height") * 0.96)).alias("y1"),
    )
    return box.where("x1 > x0 and y1 > y0")


def to_pixels(box: list[Column], matrix: list[Column], clip: list[Column], width: Column, height: Column) -> list[Column]:
    """A box in a page's points through its rotation matrix (a, b, c, d, e, f) into the pixels of a clipped rendering."""
    a, b, c, d, e, f = matrix
    corner = lambda x, y: (a * x + c * y + e, b * x + d * y + f)
    (x0, y0), (x1, y1) = corner(box[0], box[1]), corner(box[2], box[3])
    sx, sy = width / (clip[2] - clip[0]), height / (clip[3] - clip[1])
    turned = [(F.least(x0, x1) - clip[0]) * sx, (F.least(y0, y1) - clip[1]) * sy, (F.greatest(x0, x1) - clip[0]) * sx, (F.greatest(y0, y1) - clip[1]) * sy]
    return [F.greatest(F.lit(0.0), v) for v in turned]
