"""Secrets: fixed patterns, and a randomness test battery on tokens.

Tokens of 16 or more letters, digits and ``+/_=-`` with a letter and a digit
are held for an encoding (hex, base 32, base 36, base 62/64) by the characters
they have.  Under the hypothesis of random characters of that alphabet each
token gets three p-values: chi-squared against equal shares, the number of runs
above and below the alphabet's middle, and the serial correlation of
neighbours.  Fisher's method combines them.  A token is told if its combined
p-value reaches a bound.  The bound is chosen for each encoding and class of
length so that at most a share ``RATE`` of the told tokens is expected to be
false: natural text of a token's length passes the bound with a known chance,
which short tokens have far more of, and the sum of those chances over all
tokens of the class is held against the number told.  Everything is built from
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import fresh_names, materialize

#: The base kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
#: Encodings by pattern, with their alphabets in order.
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Chance that two letters of natural text are equal times their number, and letters that natural text has at most.
NATURAL, LETTERS = 1.73, 26
#: Rate of false discoveries held, and classes of length.
RATE = 0.05
LENGTHS = (24, 32, 48, 96)
#: Bounds of the combined p-value that a class may take, loosest first.
BOUNDS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.4)
#: Hits after which positions are summed anew, so that a text's work grows with its hits.
CHUNK = 256
MASK = "[SECRET]"


def _found(text: Column, pattern: str, hint: Column, keep=None) -> Column:
    """Array of (start, end, hit) of a pattern's leftmost matches, ``keep`` of its first group."""
    whole = F.lit(rf"([\s\S]*?)({pattern}|\z)")
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, whole, 1).alias("gap"), F.regexp_extract_all(text, whole, 2).alias("hit"),
        *([F.regexp_extract_all(text, whole, 3).alias("value")] if keep else []),
    )
    kind = "array<struct<s: int, e: int, hit: string>>"
    none = F.array().cast(kind)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["gap"])
        e = a + F.length(p["hit"])
        take = (p["hit"] != "") & (keep(p["value"]) if keep else F.lit(True))
        return F.struct(e.alias("at"), F.when(take, F.concat(acc["out"], F.array(F.struct(a.alias("s"), e.alias("e"), p["hit"].alias("hit"))))).otherwise(acc["out"]).alias("out"))

    def positions(z: Column) -> Column:
        """Positions are summed within chunks, and the chunks' lengths over chunks."""
        last = F.floor((F.size(z) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(z, c * CHUNK + 1, CHUNK), start, step))
        return F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, c: F.struct(
                (acc["at"] + c["at"]).alias("at"),
                F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["hit"].alias("hit"))))).alias("out"),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    # The matches are bound to a name, so that they are found once.
    return F.when(hint, F.get(F.transform(F.array(zipped), positions), F.lit(0))).otherwise(none)


def _digest(text: Column) -> Column:
    """SHA-256 of a text, on which alone its spans depend; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of the text, base spans by kind and candidate tokens of whole texts; no shuffle, no Python."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    keyword = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    spans = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"),
        _found(text, ASSIGN, keyword, lambda v: F.length(v) >= 6).alias("assign"),
        F.filter(_found(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: x["e"] - x["s"] >= 20).alias("access"),
        _found(text, HEX, text.rlike(HEX)).alias("hex"),
        _found(text, CANDIDATE, text.rlike(CANDIDATE)).alias("tokens"),
    )
    return spans.withColumn("row", F.monotonically_increasing_id())


def _index(c: Column) -> Column:
    return F.call_function("locate", c, F.col("alphabet")).cast("double")


def _tail(z: Column) -> Column:
    """Chance of a standard normal value over ``z`` (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _fisher_half(p: float) -> float:
    """Sum of the three tests' negative logarithms at which their combined p-value is ``p``."""
    low, high = 0.0, 100.0
    for _ in range(100):
        h = (low + high) / 2
        low, high = (h, high) if math.exp(-h) * (1 + h + h * h / 2) > p else (low, h)
    return low


def _normal_bound(p: float) -> float:
    """The value that a standard normal one exceeds with chance ``p``."""
    low, high = -9.0, 9.0
    for _ in range(100):
        z = (low + high) / 2
        low, high = (z, high) if math.erfc(z / math.sqrt(2)) / 2 > p else (low, z)
    return low


def test_battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (row, s, e, hit) with encoding, class of length, the three p-values, the combined ``p`` and ``chances``.

    ``chances`` holds, for each of ``BOUNDS``, an upper bound of the chance
    that natural text of the token's length has so great a combined p-value.
    """
    kind, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        kind = F.when(F.col("hit").rlike(pattern), name).otherwise(kind)
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    body = F.rtrim(F.col("hit"), F.lit("="))
    named = tokens.withColumn("encoding", kind).withColumn("alphabet", alphabet)
    named = named.withColumn("body", F.when(F.col("encoding") == "base64", F.translate(body, "-_", "+/")).otherwise(F.lower(body)))
    x = named.withColumn("x", F.transform(F.filter(F.split("body", ""), lambda c: c != ""), _index)).withColumn("n", F.size("x").cast("double")).withColumn("m", F.length("alphabet").cast("double")).where("n >= 12")
    zero = F.lit(0.0)
    total = lambda f: F.aggregate("x", zero, lambda a, v: a + f(v))
    equal = F.aggregate(F.transform(F.array_distinct("x"), lambda v: F.size(F.filter("x", lambda w: w == v)).cast("double")), zero, lambda a, c: a + c * (c - 1))
    pairs = F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    upper = lambda v: (v > F.col("m") / 2)
    told = x.select(
        "row", "s", "e", "encoding", "n", "m", equal.alias("equal"), (total(lambda v: v) / F.col("n")).alias("mean"), total(lambda v: v * v).alias("squares"), total(lambda v: upper(v).cast("double")).alias("above"),
        F.aggregate(pairs, zero, lambda a, p: a + (upper(p["a"]) != upper(p["b"])).cast("double")).alias("changes"),
        F.aggregate(pairs, zero, lambda a, p: a + p["a"] * p["b"]).alias("products"), F.get("x", F.lit(0)).alias("x0"), F.element_at("x", -1).alias("x9"),
    )
    n, m, above = F.col("n"), F.col("m"), F.col("above")
    # Chi-squared against equal shares is m / n * (2 * pairs + n) - n for so many pairs of equal characters: its upper
    # tail is that of the pairs, whose mean and variance are known at any length; a gamma law with them, by its cube root.
    told = told.withColumns({"mean_pairs": n * (n - 1) / (2 * m), "expected": 2 * above * (n - above) / n, "natural": n * (n - 1) / 2 * NATURAL / F.least(m, F.lit(LETTERS))})
    mean_pairs, expected, natural = F.col("mean_pairs"), F.col("expected"), F.col("natural")
    told = told.withColumn("shape", mean_pairs / (1 - 1 / m))
    shape = F.col("shape")
    chi_z = (F.cbrt(F.greatest((F.col("equal") - 1) / 2, F.lit(0.0)) / mean_pairs) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape)
    spread = F.sqrt(F.greatest(expected * (2 * above * (n - above) - n) / (n * (n - 1)), F.lit(1e-9)))
    variance = F.col("squares") - n * F.col("mean") * F.col("mean")
    shared = F.col("products") - F.col("mean") * (2 * n * F.col("mean") - F.col("x0") - F.col("x9")) + (n - 1) * F.col("mean") * F.col("mean")
    runs_z = F.when((above > 0) & (above < n), (F.col("changes") - expected) / spread).otherwise(9.0)
    serial_z = (shared / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    # A combined p-value over a bound needs a chi-squared one over exp(-half); natural text has so many more equal pairs.
    limits = {}
    for k, bound in enumerate(BOUNDS):
        z = _normal_bound(math.exp(-_fisher_half(bound)))
        most = mean_pairs * F.pow(F.greatest(1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape)), zero), F.lit(3.0)) + 0.5
        limits[f"z{k}"] = (natural - most) / F.sqrt(2 * natural)
    tested = told.withColumns({"chi_z": chi_z, "runs_z": F.abs(runs_z), "serial_z": F.abs(serial_z), **limits})
    least = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))
    tested = tested.withColumns({"p_chi": least(_tail(F.col("chi_z"))), "p_runs": least(2 * _tail(F.col("runs_z"))), "p_serial": least(2 * _tail(F.col("serial_z")))})
    tested = tested.withColumn("half", -F.log(F.col("p_chi") * F.col("p_runs") * F.col("p_serial")))
    half = F.col("half")
    combined = F.exp(-half) * (1 + half + half * half / 2)
    chances = [_tail(F.col(f"z{k}")) for k in range(len(BOUNDS))]
    size = F.lit(0)
    for k, edge in enumerate(LENGTHS):
        size = F.when(n >= edge, k + 1).otherwise(size)
    return tested.select("row", "s", "e", "encoding", size.alias("size"), "p_chi", "p_runs", "p_serial", combined.alias("p"), F.array(*chances).alias("chances"))


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of ``tested`` that keep the expected rate of false discoveries in their encoding and class of length.

    Of the bounds that keep the rate a class takes the one that tells most
    tokens; without one it tells none.
    """
    sums = [F.struct(F.lit(b).alias("bound"), F.count_if(F.col("p") >= b).alias("told"), F.sum(F.get("chances", F.lit(k))).alias("false")) for k, b in enumerate(BOUNDS)]
    per = tested.groupBy("encoding", "size").agg(F.array(*sums).alias("sums"))
    fit = F.filter("sums", lambda x: (x["told"] > 0) & (x["false"] <= rate * x["told"]))
    bound = per.select("encoding", "size", F.array_max(F.transform(fit, lambda x: F.struct(x["told"].alias("told"), x["bound"].alias("bound"))))["bound"].alias("bound")).where("bound is not null")
    # At most one row for each encoding and length class.
    return tested.join(F.broadcast(bound), ["encoding", "size"]).where(F.col("p") >= F.col("bound"))


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: row, doc_id, digest and arrays ``base`` and ``spans`` of (s, k, e).

    s and e are code points, e exclusive; k numbers ``KINDS``; both arrays are
    in order.  Random tokens that overlap a base span aren't told again.  Null
    and empty texts have no spans; repeated rows each get a row, null ids stay
    null, other columns are ignored; an empty table gives an empty result.
    """
    scanned = materialize(scan(docs.select("doc_id", "text")), "secret-spans")
    numbered = lambda name: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(name)).alias("k"), x["e"].alias("e")))
    base = scanned.withColumn("base", F.array_sort(F.concat(*map(numbered, KINDS[:3]))))
    fresh = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    tokens = base.select("row", F.explode(fresh).alias("t")).select("row", "t.s", "t.e", "t.hit")
    tested = materialize(test_battery(tokens), "randomness-tests")
    extra = discoveries(tested, rate).groupBy(F.col("row").alias("x_row")).agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).alias("extra"))
    none = F.array().cast("array<struct<s: int, k: int, e: int>>")
    joined = base.join(extra, F.col("row") == F.col("x_row"), "left")
    return joined.select("row", "doc_id", "digest", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def told(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with each secret's span replaced by a mark, overlapping ones by one; n_chars follows.

    All columns and rows stay, whatever the columns are called.  Rows are told
    apart by their text, so rows with a null or repeated doc_id each lose their
    own secrets.  Null and empty texts stay as they are.
    """
    own, found = fresh_names(docs, "digest", "found")
    cut = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s: int, e: int>>").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))
            .otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(F.element_at(acc["out"], -1)["s"].alias("s"), F.greatest(acc["at"], x["e"]).alias("e"))))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    spans = secrets(docs, rate).where(F.size("spans") > 0).select(F.col("digest").alias(own), cut.alias(found)).dropDuplicates([own])
    joined = docs.join(spans, _digest(F.col("text")) == F.col(own), "left")
    text, n = F.col("text"), F.size(found)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(found, i - 1)["e"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, F.when(i < n, F.get(found, i)["s"]).otherwise(F.length(text)) - begin(i)))
    out = joined.withColumn("text", F.when(F.col(found).isNull(), text).otherwise(F.array_join(pieces, MASK)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
