"""Secret scans through an incremental blob ledger, by DataFrame and SQL functions only.

Each version of a text is addressed by its SHA-256 (its blob).  A ledger row says
which rule versions a blob was scanned with and what they found; ``scan`` runs only
the (blob, rule version) pairs that the ledger lacks, once per distinct blob, and
returns the rows to append.  ``findings_of`` joins the ledger back to every path.
Texts without any trigger of the rules passed enter the ledger as scanned without being
moved; of the others one copy per task and blob is shuffled.

Positions come from ``split`` and ``regexp_extract_all`` of the same pattern: the
lengths of what stands between and of what matched, summed along a blob's matches,
are code point offsets.  Work is linear in the matches of a text, redaction included.

A blob that many paths share is joined in salted parts (shared.spread_join).

Defined cases: null text is the empty text; a blob may have any number of paths,
null ids and repeated rows included, and any number of ledger rows; spans of different
rules may overlap and all are kept; an empty table gives an empty ledger; other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.shared import cut, spread_join, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  # whose length is checked
    least: int
    trigger: str | None = None  # a text without a match of this has no match of the rule; none: every text is scanned

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three kinds and their limits are those of the query's contract.
# Where only a whole run can match, the least length stands in the pattern itself.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox[abprs]-"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
)
BASE = 3

FINDING = "struct<start:int,rank:int,end:int,kind:string>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"


def _literal(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def triggered(rules: tuple[Rule, ...]) -> Column:
    """Whether any of ``rules`` can match the column ``text``; null is false."""
    if any(r.trigger is None for r in rules):
        return F.col("text").isNotNull()
    return F.coalesce(F.col("text").rlike("|".join(f"(?:{r.trigger})" for r in rules)), F.lit(False))


MATCHES = "array<struct<rank:int,i:int,gap:int,size:int,kind:string,ok:boolean>>"


def lengths(text: str, rule: Rule, rank: int) -> Column:
    """Matches of one rule in the column named ``text``, leftmost and non-overlapping: the gap before each, its size, and whether it is long enough."""
    pattern = _literal(rule.pattern)
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    checked = f"regexp_extract_all({text}, {pattern}, {rule.group})"
    return F.expr(f"""
        transform(arrays_zip(slice(split({text}, {pattern}, -1), 1, size({found})), {found}, {checked}),
            (m, i) -> struct({rank} AS rank, i AS i, length(m['0']) AS gap, length(m['1']) AS size, '{rule.kind}' AS kind, length(m['2']) >= {rule.least} AS ok))""").cast(MATCHES)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for ``versions`` (blob, text): only pairs of blob and rule version that are not in ``ledger``."""
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = versions.groupBy("blob").agg(F.max(F.when(triggered(rules), F.col("text"))).alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("rules", names)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = (blobs.join(seen, "blob", "left")
                 .withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
                 .where(F.size("rules") > 0))
    none = F.array().cast(MATCHES)
    matches = F.concat(*(F.when(F.array_contains("rules", r.name), lengths("text", r, i)).otherwise(none) for i, r in enumerate(rules)))
    rows = blobs.select("blob", "rules", F.explode_outer(matches).alias("m")).select("blob", "rules", "m.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    finding = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", "kind")
    return rows.withColumn("end", upto).groupBy("blob").agg(
        F.max("rules").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("ok"), finding))).cast(f"array<{FINDING}>").alias("findings"))


def with_blob(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def findings_of(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """``paths`` (with ``blob``) and the findings of their blobs, sorted by start and rule."""
    of_blob = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    none = F.array().cast(f"array<{FINDING}>")
    return spread_join(paths, of_blob, "blob").withColumn("findings", F.coalesce("findings", none))


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


#: Code points of the pieces that a text is cut into before spans are taken out of it.
PIECE = 1024


def cuts_of(ledger: DataFrame) -> DataFrame:
    """(blob, cuts, after): what stays before each mark, as [from, to) code points, and where the rest begins."""
    rows = ledger.where(F.size("findings") > 0).select("blob", F.posexplode("findings").alias("i", "f"))
    before = F.coalesce(F.max("f.end").over(Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_ = F.when(F.col("f.start") >= F.col("before"), F.struct(F.col("before").alias("a"), F.col("f.start").alias("b")))
    return rows.withColumn("before", before).groupBy("blob").agg(F.array_sort(F.collect_list(cut_)).alias("cuts"), F.max("f.end").alias("after"))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of a text that is held in pieces."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(piece(first), a % PIECE + 1, b - a)).otherwise(
        F.concat(F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), inner, F.substring(piece(last), F.lit(1), b % PIECE)))


def redact(text: Column, cuts: Column, after: Column, mark: str = "[SECRET]") -> Column:
    """What ``cuts`` and ``after`` (see cuts_of) keep of the text, with marks between; overlapping spans are one.

    The text is held in pieces, so a span's place is not counted from the text's begin.
    """
    kept = F.concat(cuts, F.array(F.struct(after.alias("a"), F.length(text).alias("b"))))
    held = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return F.get(F.transform(held, lambda pieces: F.array_join(F.transform(kept, lambda c: _between(pieces, c["a"], c["b"])), mark)), 0)


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with found secrets replaced, n_chars (where it is a column) brought up to date; no row goes.

    Only rows with a trigger are joined with the ledger, so other texts are not moved.
    """
    suspect = triggered(RULES)
    # Rows travel as one column, whatever their names.
    suspects = cut(with_blob(documents.where(suspect).select(F.struct("*").alias("row"), "text")))
    found = spread_join(suspects, cuts_of(scan(suspects.select("blob", "text"))), "blob")
    found = found.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("cuts"), F.col("after"))))

    def column(name: str) -> Column:
        own = F.col(f"row.`{name}`")
        if name == "text":
            return F.col("text").alias(name)
        if name == "n_chars":
            return F.when(F.col("cuts").isNotNull(), F.length("text").cast(documents.schema[name].dataType)).otherwise(own).alias(name)
        return own.alias(name)

    return documents.where(~suspect).unionByName(found.select(*map(column, documents.columns)))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = with_blob(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = findings_of(cut(versions.select("doc_id", "blob")), scan(versions.select("blob", "text")))
    of_kind = lambda i: F.size(F.filter("findings", lambda f: f["rank"] == i)).cast("long")
    base = joined(F.filter("findings", lambda f: f["rank"] < BASE))
    return found.select(
        "doc_id", *(of_kind(i).alias(f"n_{RULES[i].kind}") for i in range(BASE)),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _oracle() -> str:
    found = []
    for rank, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        found.append(f"""SELECT doc_id, u.start AS start, {rank} AS rank, u.start + u.size AS stop, '{r.kind}' AS kind FROM (
            SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
                'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                'size': length(m[i]), 'checked': length(g[i])}})) AS u
            FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS p, regexp_extract_all(t, {pattern}) AS m,
                  regexp_extract_all(t, {pattern}, {r.group}) AS g FROM texts WHERE regexp_matches(t, {pattern})))
            WHERE u.checked >= {r.least}""")
    union = " UNION ALL ".join(found)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({union}),
lists AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < {BASE}), '') AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lists USING (doc_id)
"""


ORACLE = _oracle()
