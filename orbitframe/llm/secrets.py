"""Secret scans: multipart credential linking.

A secret is often useless, and hard to tell from noise, without its other parts. Three
roles of parts are found in every text: access *identifiers* (key ids, user and client names), *secrets* and
*endpoints* (hosts, addresses with a port, connection strings). The base formats (assign, access, hex)
are always reported. Weak candidates - short hex strings, base64-like strings, bare
identifiers and endpoints - are reported only when a complementary part stands in the same scope:

* a weak secret with an identifier or an endpoint,
* a weak identifier or endpoint with a secret (weak or base).

The scope is ``SCOPE`` code points around a part. Parts are joined as intervals: each is dealt
to the cells of ``SCOPE`` code points that its surroundings touch, parts meet in an equality join on
(document, cell), and the exact distance decides. Only parts are shuffled, never texts. A part needs to know only
whether a complementary one is near, so each cell keeps, for each role, just the first and last end
of its parts before the join, and frequent parts make no pairs.

Defined results: null and empty texts have no spans and the digest of an empty string.
Repeated rows are scanned each, and so are rows with a null id, which stays null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .runtime import cut, documents, let, require

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "endpoint", "weak")
KEYWORDS = r"password|passwd|secret|token|api_?key"
ASSIGN = rf"(?i)(?:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
IDENTIFIER = r"(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}+"
ENDPOINT = r"(?i)(?<![A-Za-z0-9])(?:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ssh|ftp)://[^\s\"'<>]{3,}+|(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}+(?::[0-9]{2,5}+)?)"
#: A run of 16 characters or more; one with a digit and a letter counts.
WEAK = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
SCOPE = 300
ROLE = {"assign": "secret", "hex": "secret", "weak": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}


def base_spans(text: Column) -> Column:
    """The base formats; an assignment spans its whole match, and counts if its value has 6 characters or more."""
    found = S.matches(text, ASSIGN, "assign", 0)
    assign = F.filter(found, lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6)
    return F.concat(
        F.when(text.rlike(rf"(?i){KEYWORDS}"), assign).otherwise(S.no_spans()),
        F.when(F.contains(text, F.lit("AKIA")), S.matches(text, ACCESS, "access", 1)).otherwise(S.no_spans()),
        F.when(text.rlike(HEX), S.matches(text, HEX, "hex", 2)).otherwise(S.no_spans()),
    )


def weak_parts(text: Column, base: Column) -> Column:
    """Weak candidates of each role that don't overlap a base span."""
    found = F.concat(
        F.when(text.rlike(r"[:=]"), F.concat(S.matches(text, IDENTIFIER, "identifier", 3), S.matches(text, ENDPOINT, "endpoint", 4))).otherwise(S.no_spans()),
        F.when(text.rlike("[0-9]"), F.filter(S.matches(text, WEAK, "weak", 5), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))).otherwise(S.no_spans()),
    )
    return let(found, lambda f: S.clear_of(f, base))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Which weak parts have an end of a complementary part at most ``scope`` code points before or after them.

    ``parts(row, start, rank, end, kind)`` to the same columns of the weak parts to report.
    """
    names = ("row", "start", "rank", "end", "kind")
    parts = parts.select(*names)
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLE.items()])
    cell = lambda at: F.floor(at / scope)
    # of a role's ends in a cell the outermost two decide: a cell is no wider than the scope
    ends = parts.select("row", role.alias("role"), F.explode(F.array("start", "end")).alias("at"))
    near = ends.groupBy("row", "role", cell(F.col("at")).alias("cell")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    weak = parts.filter(~F.col("kind").isin(*BASE)).withColumn("own", role)
    met = weak.withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope)))).join(near, ["row", "cell"])
    other = F.when(F.col("own") == "secret", F.col("role") != "secret").otherwise(F.col("role") == "secret")
    within = (F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("end") + scope)
    return met.filter(other & within).select(*names).distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, secret_base, secret_linked)``: arrays of spans for each row of ``docs``."""
    docs = require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), base_spans(text).alias("secret_base"))
    rows = rows.select("doc_id", "secret_base", weak_parts(F.col("text"), F.col("secret_base")).alias("weak"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # a number for each row, fixed by the cut
    parts = rows.filter(F.size("weak") > 0).select("row", F.explode(F.concat("secret_base", "weak")).alias("s")).select("row", "s.*")
    linked = link(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end", "kind", F.lit("").alias("text"))).alias("linked"))
    out = rows.join(linked, "row", "left")
    return out.select("doc_id", "secret_base", F.coalesce(F.col("linked").cast(f"array<{S.SPAN}>"), S.no_spans()).alias("secret_linked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", *[S.count(F.col("secret_base"), k).alias(f"n_{k}") for k in BASE], F.sha2(S.joined(F.col("secret_base")), 256).alias("base_sha256"), S.joined(F.concat("secret_base", "secret_linked")).alias("spans"))
