"""Operator 2: secrets, with credentials that come in several parts. DataFrame functions only.

Strong parts (base kinds: assign, access, hex) always count. Weak candidates (login, blob,
endpoint) count only where complementary parts of one credential meet within a scope of some
code points: a blob needs an identifier or an endpoint near it, a login needs a secret, an
endpoint needs both. The interval join within scopes is a sweep over the parts of a document
in order of their starts: the farthest end before and the nearest start after decide whether
any partner is in reach, so pairs of parts never appear.

Offsets are code points, ends exclusive. A null or empty text has no parts; texts of any length
are read whole. Rows with equal doc_id and text are scanned once and each gets the result; a
null doc_id is an id of its own. An empty table gives an empty result. Nothing but doc_id and
text is read. Only documents with parts are shuffled, without text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .line_dedup import NO_ID

#: Kinds in the order in which they are listed, their patterns, and how many
#: characters the whole match or its second group must have.
KINDS = ["assign", "access", "hex", "login", "blob", "endpoint"]
PATTERNS = {
    "assign": """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{12,}",  # a run of 16 or more has its first AKIA within reach or none
    "hex": "[0-9a-f]{32,}",
    "login": """(?i)(user_?name|user|login|account|client_?id|key_?id)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9@._-]+)""",
    "blob": "[A-Za-z0-9+/_=-]{20,}",
    "endpoint": """(?i)(https?|wss?|ftp|jdbc|s3|amqps?|redis|mysql|postgres(?:ql)?)://[^\\x20\\x09-\\x0D"'<>,;]+""",
}
LEAST_GROUP = {"assign": 8, "login": 4}
KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
LOGIN_WORDS = ["user", "login", "account", "client_id", "clientid", "key_id", "keyid"]
SCOPE = 300


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _pieces(kind: str) -> Column:
    """(kind, characters before the match since the last one, characters of the match, whether it counts)."""
    rx = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all("text", rx, F.lit(0))
    gaps = F.split("text", PATTERNS[kind], -1)
    if kind in LEAST_GROUP:
        good = lambda m: F.char_length(F.regexp_extract(m, PATTERNS[kind], 2)) >= LEAST_GROUP[kind]
    elif kind == "blob":
        good = lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[A-Z]"))
    else:
        good = lambda m: F.lit(True)
    return F.zip_with(
        F.slice(gaps, 1, F.size(found)), found,
        lambda g, m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.char_length(g).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("size"),
            good(m).alias("good")
        )
    )


def secret_parts(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """did, version, kind (its number), start, end: every base span and every linked weak one."""
    d = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    d = d.withColumn("version", F.xxhash64("text")).withColumn("_low", F.lower("text"))
    has = {
        "assign": _any(F.col("_low"), KEYWORDS), "access": F.contains("text", F.lit("AKIA")), "hex": F.rlike("text", F.lit("[0-9a-f]{32}")),
        "login": _any(F.col("_low"), LOGIN_WORDS), "endpoint": F.contains("text", F.lit("://"))
    }
    d = d.withColumns({f"_{k}": c for k, c in has.items()}).where(" OR ".join(f"_{k}" for k in has))
    has["blob"] = F.col("_access") | F.col("_login") | F.col("_endpoint")  # else nothing could complement it
    parts = F.flatten(
        F.array(
            *[
                F.when(
                    has["blob"] if k == "blob" else F.col(f"_{k}"), F.transform(_pieces(k), lambda x, i: x.withField("i", i))
                ).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,good:boolean,i:int>>")) for k in KINDS
            ]
        )
    )
    found = d.select("did", "version", parts.alias("parts")).where(F.size("parts") > 0).dropDuplicates(["did", "version"])
    rows = found.select("did", "version", F.inline("parts"))
    so_far = W.partitionBy("did", "version", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("good")
    rows = rows.select("did", "version", "kind", (F.col("end") - F.col("size")).alias("start"), "end")

    order = W.partitionBy("did", "version").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)

    def near(*kinds: str) -> Column:
        of = F.col("kind").isin([KINDS.index(k) for k in kinds])
        back = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        ahead = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(back <= scope, F.lit(False)) | F.coalesce(ahead <= scope, F.lit(False))

    base = F.col("kind") < 3
    inside = F.coalesce(
        F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)
    ) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    rows = rows.withColumn("inside", inside).where("kind <> 4 OR NOT inside")  # a blob within a base span is no new part
    identifier, secret, endpoint = near("access", "login"), near("assign", "hex", "blob"), near("endpoint")
    rows = rows.withColumns({"_id": identifier, "_secret": secret, "_end": endpoint})
    return rows.where(
        "kind < 3 OR (kind = 3 AND _secret) OR (kind = 4 AND (_id OR _end)) OR (kind = 5 AND _id AND _secret)"
    ).select("did", "version", "kind", "start", "end")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans: array of (start, kind, end), in order; for each row of ``docs``."""
    spans = secret_parts(docs, scope).groupBy("did", "version").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    d = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version")
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return d.join(spans, ["did", "version"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{KINDS[i]}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select(
        "doc_id", count(0), count(1), count(2), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans")
    )


def op2_sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    good = {
        "assign": f"length(regexp_extract(m, {quote(PATTERNS['assign'])}, 2)) >= 8",
        "login": f"length(regexp_extract(m, {quote(PATTERNS['login'])}, 2)) >= 4",
        "blob": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"
    }
    each = "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, {quote(k)} AS name FROM (SELECT doc_id, regexp_extract_all(t, {quote(PATTERNS[k])}) AS ms, string_split_regex(t, {quote(PATTERNS[k])}) AS gs FROM d) WHERE len(ms) > 0"
        for i, k in enumerate(KINDS)
    )
    keep = " ".join(f"WHEN {i} THEN {good[k]}" for i, k in enumerate(KINDS) if k in good)
    near = lambda ks: f"coalesce(start - max(CASE WHEN kind IN ({ks}) THEN stop END) OVER b <= {SCOPE}, false) OR coalesce(min(CASE WHEN kind IN ({ks}) THEN start END) OVER a - stop <= {SCOPE}, false)"
    frames = "WINDOW b AS (PARTITION BY doc_id ORDER BY start, kind, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY start, kind, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({each}),
q AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM p),
r AS (SELECT doc_id, kind, name, stop - length(m) AS start, stop FROM q WHERE CASE kind {keep} ELSE true END),
s AS (SELECT *, coalesce(max(CASE WHEN kind < 3 THEN stop END) OVER b > start, false) OR coalesce(min(CASE WHEN kind < 3 THEN start END) OVER a < stop,
  false) AS inside FROM r {frames}),
w AS (SELECT *, {near('1, 3')} AS near_id, {near('0, 2, 4')} AS near_secret, {near('5')} AS near_end FROM s WHERE kind <> 4 OR NOT inside {frames}),
x AS (SELECT *, name || ':' || start || ':' || stop AS said FROM w
  WHERE kind < 3 OR (kind = 3 AND near_secret) OR (kind = 4 AND (near_id OR near_end)) OR (kind = 5 AND near_id AND near_secret))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""
