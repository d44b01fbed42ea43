"""Inventories of files and pages: content rules, merged records, cohorts, verification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "rule_id string, glob string, first int, last int"


def glob_pattern(glob: str) -> str:
    """A file-name pattern (``*``, ``?``, ``[...]``) as a regular expression of the whole name."""
    parts, k = [], 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if close > 0:
            inside = glob[k + 1 : close].replace("\\", "\\\\")
            parts.append("[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]")
            k = close
        else:
            parts.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        k += 1
    return "^" + "".join(parts) + "$"


def page_rules(pages: DataFrame, rules: list[tuple[str, str, list[tuple[int, int]] | None]]) -> DataFrame:
    """``pages`` (filename, page, more) with ``rule_id`` and the number of rules that fit.

    A rule is a name, a file-name pattern and inclusive page ranges (None: all
    pages).  The rules are a short list, so each is a condition of one scan
    rather than a row to join with.  Only exactly one fitting rule is told.
    """
    fits = []
    for name, glob, ranges in rules:
        if ranges is not None and (not ranges or any(a < 1 or a > b for a, b in ranges)):
            raise ValueError("page ranges are pairs of increasing positive numbers")
        inside = F.lit(True) if ranges is None else F.exists(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges)), lambda r: F.col("page").between(r["a"], r["b"]))
        fits.append(F.when(F.col("filename").rlike(glob_pattern(glob)) & inside, name))
    found = F.array_compact(F.array(*fits))
    return pages.withColumns({"rule_id": F.when(F.size(found) == 1, F.get(found, F.lit(0))), "rules": F.size(found)})


def page_type(characters: Column, images: Column, drawings: Column) -> Column:
    """What a PDF page is by what lies on it, text first, drawings before images."""
    return F.when(characters > 0, "native_pdf").when(drawings > 0, "vector_pdf_without_extractable_text").when(images > 0, "image_pdf_without_extractable_text").otherwise("pdf_without_detected_content")


def merge_records(rows: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One record a key: of each scalar the first that isn't empty, of each list the sorted union."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return rows.groupBy(key).agg(
        *(F.min_by(F.col(c), F.when(~empty(c), F.col(order))).alias(c) for c in scalars), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in lists)
    )


def preferred_inventory(inventories: DataFrame, key: str, preferred: str, order: str) -> DataFrame:
    """Of each key the inventory that answered, then has most files, then comes from the preferred source, then is first in ``order`` (a number)."""
    rank = F.struct((F.coalesce("http_status", F.lit(0)) == 200).alias("a"), F.coalesce("file_count", F.lit(-1)).alias("b"), F.coalesce(F.col("source") == preferred, F.lit(False)).alias("c"), (-F.col(order)).alias("d"))
    best = inventories.groupBy(key).agg(F.max_by(F.struct(*[c for c in inventories.columns if c != key]), rank).alias("_b"))
    return best.select(key, "_b.*")


def gold_intervals(rows: DataFrame, key: str) -> DataFrame:
    """key, top, bottom, text of well-formed rows of a table of texts: numbers 0 <= top < bottom <= 5000 and a description, each once."""
    t = rows.select(F.col(key).alias("key"), F.col("top").cast("string").try_cast("double").alias("top"), F.col("bottom").cast("string").try_cast("double").alias("bottom"), F.trim("text").alias("text"), F.trim(F.coalesce("comments", F.lit(""))).alias("comments"))
    ok = t.where("top >= 0 and top < bottom and bottom <= 5000 and text <> ''")
    return ok.groupBy("key", "top", "bottom", "text").agg(F.max("comments").alias("comments"))


def clean_candidates(intervals: DataFrame, least: int = 5, most: int = 60, joined: float = 0.99, gap: float = 0.01) -> DataFrame:
    """key, n, share of records with a fit number of intervals, no comment, and nearly all neighbours joined."""
    w = Window.partitionBy("key").orderBy("top", "bottom", "text")
    near = intervals.withColumn("_gap", F.abs(F.lead("top").over(w) - F.col("bottom")))
    per = near.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("comments") != "").alias("commented"), F.count("_gap").alias("pairs"), F.count_if(F.col("_gap") <= gap).alias("close"))
    share = F.coalesce(F.try_divide(F.col("close").cast("double"), F.col("pairs").cast("double")), F.lit(1.0))
    return per.withColumn("share", share).where(F.col("n").between(least, most) & (F.col("commented") == 0) & (F.col("share") >= joined)).select("key", "n", "share")


def cohort_order(candidates: DataFrame, group: str, key: str, salt: str = "") -> DataFrame:
    """``candidates`` with ``place``-giving columns: the first of each group by hash come first, in order of group, then the rest by hash.

    Sort by (turn, first_group, hash) to read the order.
    """
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")).cast("binary"), 256)
    ranked = candidates.withColumn("hash", h).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("hash", key)))
    return ranked.withColumn("turn", F.when(F.col("_r") == 1, 0).otherwise(1)).withColumn("first_group", F.when(F.col("_r") == 1, F.col(group))).drop("_r")


def verify_inventory(expected: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """key, problem of files that are missing, unlisted, or of another size or hash (``size``, ``sha256``)."""
    e = expected.select(F.col(key).alias("e_key"), F.col("size").alias("e_size"), F.col("sha256").alias("e_hash"))
    both = e.join(found.select(key, "size", "sha256"), F.col("e_key") == F.col(key), "full_outer")
    problem = F.when(F.col(key).isNull(), "missing").when(F.col("e_key").isNull(), "unlisted").when(F.col("size") != F.col("e_size"), "size").when(F.col("sha256") != F.col("e_hash"), "hash")
    return both.select(F.coalesce("e_key", key).alias(key), problem.alias("problem")).where("problem is not null")


def expected_pages(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """document, page, problem of pages 1..n that have no prediction, and of predictions that are for no such page or come twice."""
    want = documents.where("pages > 0").select("document", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    have = predictions.groupBy("document", "page").agg(F.count("*").alias("n"))
    both = want.withColumn("wanted", F.lit(True)).join(have, ["document", "page"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("document", "page", problem.alias("problem")).where("problem is not null")


def two_readers(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found (both, first, second) and a running name within each kind, of the distinct rows of two readers."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full_outer")
    found = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second")
    return both.select(*keys, found.alias("found"))


def statuses(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose words the text holds."""
    out = F.lit(other)
    for words, name in reversed(rules):
        out = F.when(F.contains(F.lower(text), F.lit(words)), name).otherwise(out)
    return out


def told_numbers(texts: DataFrame, checks: list[tuple[str, str, int]], sources: DataFrame) -> DataFrame:
    """check, text, observed, expected, passed: numbers that texts tell against those of a source.

    A check is a name, a pattern whose first group is the number and the
    decimals to which it is told; ``texts`` has text_id and text, ``sources``
    check and value.  A pattern that doesn't match once fails.
    """
    parts = F.array(*(F.struct(F.lit(n).alias("check"), F.regexp_extract_all("text", F.lit(p), 1).alias("hits"), F.lit(d).alias("decimals")) for n, p, d in checks))
    told = texts.select("text_id", F.inline(parts))
    both = told.join(F.broadcast(sources.select(F.col("check").alias("s_check"), F.col("value").cast("double").alias("value"))), F.col("check") == F.col("s_check"), "left")
    one = F.when(F.size("hits") == 1, F.get("hits", F.lit(0)).try_cast("double"))
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    same = F.coalesce(F.bround(F.col("value") * scale, 0) / scale == one, F.lit(False))
    return both.select("check", "text_id", one.alias("observed"), F.col("value").alias("expected"), same.alias("passed"))


def table_assertions(rows: DataFrame, expected_rows: int, distinct: dict[str, int]) -> DataFrame:
    """assertion, observed, expected, passed of a table's number of rows and of distinct values of columns."""
    one = rows.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"d_{c}") for c in distinct))
    parts = [("rows", F.col("n"), expected_rows), *((f"distinct:{c}", F.col(f"d_{c}"), n) for c, n in distinct.items())]
    long = one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("assertion"), o.alias("observed"), F.lit(e).cast("long").alias("expected")) for a, o, e in parts))))
    return long.withColumn("passed", F.col("observed") == F.col("expected"))


def same_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """content_sha256, n, first of contents that more than one row has (text or binary)."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
