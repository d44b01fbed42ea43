"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, suffix_tree_lm, token_counts
from strataframe.llm._spark import documents


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; looked up only by the queries that read one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(documents(spark, sf_dir))
    counts = [secret_scan.count_of(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secret_scan.told("base").cast("binary"), 256).alias("base_sha256"), secret_scan.told("spans").alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir).select("doc_id")).select("doc_id", "slot", "shard_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.load_vocabulary(vocabulary("piece_bpe_32k.model")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", substring_dedup.span_bytes().alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_secret_scan, op4_decontamination, op5_sharding, op6_token_counts, op7_lm_scoring, op8_near_dedup, op9_packing, op10_substring_dedup)}
_METRIC_SQL = " UNION ALL ".join(
    f"SELECT rid, lang, source, base_failed, '{name}' AS metric, ({scale} * {top}) // greatest({below}, 1) AS v, ({scale} * greatest({top} - {event}, 0)) // greatest({below}, 1) AS less, {str(low).lower()} AS low FROM stats"
    for name, (top, below, scale, event, low) in quality_rules.METRICS.items()
)


def _quantile_sql(keys: str) -> str:
    """n and quantiles of each metric in groups of ``keys``, from the merged histogram."""
    by = f"{keys}, metric" if keys else "metric"
    told = ", ".join(f"min(CASE WHEN 10 * below >= {tenths} * total THEN bucket END) AS {q}" for q, tenths in quality_rules.QUANTILES.items())
    return f"""(SELECT {by}, max(total) AS n, {told}
FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM hist GROUP BY {by}, bucket)) GROUP BY {by})"""


def _shift_sql(value: str) -> str:
    return f"CAST(greatest(length(bin(CAST({value} AS BIGINT))) - {quality_rules.BITS}, 0) AS INT)"


_PICK_SQL = ", ".join(f"CASE WHEN o.n >= {quality_rules.LEAST_DOCS} THEN o.{q} WHEN l.n >= {quality_rules.LEAST_DOCS} THEN l.{q} ELSE a.{q} END AS {q}" for q in quality_rules.QUANTILES)
_HIGH_SQL = f"q90 + {quality_rules.REACH} * greatest(q90 - q50, CAST(1 AS BIGINT) << {_shift_sql('q90')})"
_LOW_SQL = f"q10 - {quality_rules.REACH} * greatest(q50 - q10, CAST(1 AS BIGINT) << {_shift_sql('q10')})"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals FROM split LEFT JOIN covered USING (rid))),
vals AS ({_METRIC_SQL}),
hist AS (SELECT lang, source, metric, (v >> {_shift_sql("v")}) << {_shift_sql("v")} AS bucket, count(*) AS n FROM vals WHERE NOT base_failed GROUP BY ALL),
quants AS (SELECT o.lang, o.source, o.metric, {_PICK_SQL}
  FROM {_quantile_sql("lang, source")} o JOIN {_quantile_sql("lang")} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN {_quantile_sql("")} a ON o.metric = a.metric),
verdict AS (SELECT rid, bool_and(coalesce(less <= {_HIGH_SQL} AND (NOT low OR v >= {_LOW_SQL}), false)) AS inside
  FROM vals LEFT JOIN quants f ON vals.metric = f.metric AND vals.lang IS NOT DISTINCT FROM f.lang AND vals.source IS NOT DISTINCT FROM f.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept, n_lines, n_capitals FROM stats JOIN verdict USING (rid)""",
    "op8_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN links ON b = u),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON doc_id = a""",
    "op10_substring_dedup": r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM dup)),
spans AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS f, a AS u FROM spans UNION ALL SELECT rid, max(b), NULL FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(u, length(h) // 2) - f)), '' ORDER BY f) AS k FROM gaps JOIN t USING (rid) GROUP BY rid),
s AS (SELECT rid, sum(b - a) AS r, count(*) AS c FROM spans GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM t LEFT JOIN s USING (rid) LEFT JOIN kept USING (rid)""",
}
