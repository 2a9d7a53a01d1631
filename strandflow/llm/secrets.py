"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are found as leftmost, non-overlapping matches of their patterns. Weak parts (bare
40-character keys, user or client identifiers, endpoints) are reported only where complementary parts lie within the
same scope, the given number of code points: a bare key beside an access identifier, or identifier, secret and endpoint
all together. The interval join of parts is a range window over the parts of a document in order, so no pairs are made.

Texts are scanned where they are read; only short records of matches are shuffled, once, by document, and the running
offsets, the linking and the gathering all reuse that partitioning. Equal rows meet as one record with a count.

No pattern repeats a group, and each run of characters is walked from its start only (schemes of addresses have at most 31
characters), so the search is flat and linear in the text, whatever the text is.

Defined results: a null or empty text has no spans; repeated rows each get their own, equal, row; null ids are kept;
an empty table gives an empty table; only id and text are used, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import repeated

BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("bare_key", "identifier", "endpoint")
KINDS = (*BASE_KINDS, *LINKED_KINDS)

#: Patterns by kind. A run of access or hex characters that is too short never matches, which drops the same
#: runs as matching it and failing it; the short values of assign must be matched and then dropped, since they use up text.
PATTERNS = {
    "assign": r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "identifier": r"""(?i)(?<![a-z0-9_])(?:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "bare_key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "endpoint": r"""(?i)(?:(?<![a-z0-9_])[a-z][a-z0-9+.-]{0,30}://[^\s"'<>]++|(?<![a-z0-9.-])[a-z0-9.-]++:[0-9]{2,5}(?![a-z0-9_]))""",
}
#: An endpoint is an address with a scheme, or a host whose last two labels are not empty, and a port.
ENDPOINT = r"(?i)(?:://|[a-z0-9-]\.[a-z0-9-]++:[0-9]+$)"
LEAST_VALUE = 12
SCOPE = 300


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind in order: the code points since the match before, those of the match, and whether it is valid."""
    pattern = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    checks = {
        "assign": lambda v: F.length(v) >= LEAST_VALUE,
        "bare_key": lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"),
        "endpoint": lambda v: v.rlike(ENDPOINT),
    }
    valid = checks.get(kind, lambda v: F.lit(True))
    records = F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), valid(x["value"]).alias("valid")),
    )
    return F.when(text.rlike(pattern), records)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text), text not null, to (doc_id, spans): array of (start, kind, end), kind as an index of KINDS."""
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,valid:boolean>>")
    text = F.col("text")
    first = docs.select("doc_id", "text", *[_matches(text, k).alias(k) for k in (*BASE_KINDS, "identifier")])
    # Weak parts can be linked only in a text with an identifier.
    linkable = F.col("access").isNotNull() | F.col("identifier").isNotNull()
    records = first.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.hash("text").alias("g"),
        F.concat(*[F.coalesce(F.col(k), none) for k in (*BASE_KINDS, "identifier")], *[F.coalesce(F.when(linkable, _matches(text, k)), none) for k in ("bare_key", "endpoint")]).alias("records"),
    )
    key = ["doc_id", "h", "g"]
    rows = records.groupBy(*key).agg(F.count("*").alias("copies"), F.first("records").alias("records"))
    parts = rows.select(*key, "copies", F.explode_outer("records").alias("r")).select(*key, "copies", "r.*")
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*key, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("end", ends.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    near = Window.partitionBy(*key).orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.when(F.col("valid"), F.col("kind").isin(*[KINDS.index(k) for k in kinds]))).over(near)
    parts = parts.select("*", has("access").alias("near_access"), has("access", "identifier").alias("near_id"), has("assign", "hex", "bare_key").alias("near_secret"), has("endpoint").alias("near_endpoint"))
    kind = F.col("kind")
    all_three = F.col("near_id") & F.col("near_secret") & F.col("near_endpoint")
    reported = F.col("valid") & (kind.isin(*range(len(BASE_KINDS))) | all_three | ((kind == KINDS.index("bare_key")) & F.col("near_access")))
    spans = F.sort_array(F.collect_list(F.when(reported, F.struct("start", "kind", "end"))))
    found = parts.groupBy(*key, "copies").agg(spans.alias("spans"))
    return repeated(found, F.col("copies")).select("doc_id", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS))
