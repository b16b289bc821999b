r"""Secret scan over an incremental ledger of blobs, in DataFrame functions only.

A row of the table is a historical version of a path; its text is a blob, named
by its SHA-256. The ledger holds the (blob, rule version) pairs that have been
scanned and what was found. A scan takes the pairs that the ledger lacks, reads
each such blob once however many paths or versions hold it, and gives the ledger
with what it found; findings are joined back to all paths by blob name.

Rules are regular expressions, leftmost and non-overlapping within a rule. Spans
are code points, end exclusive. Between the matches of a rule lie the pieces that
the rule splits the text into, so positions are running sums of lengths.

Defined cases: a null text is an empty one; a row with a null doc_id is a path of
its own; repeated rows of a doc_id and text each give a row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must be ``least`` or more for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules as the contract words them (a run below the least length can't hold a longer match).
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
)
#: Public token formats that the base rules don't name.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"

_LEDGER = "blob string, rule string, version string"
_FOUND = "blob string, rule string, version string, start long, end long"


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s))


def _matches(text: Column, rule: Rule) -> Column:
    """kind, and for each match the lengths of the piece before it, of itself and of its group; null without a match."""
    pattern, every = F.lit(rule.pattern), lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    found = F.arrays_zip(
        _lengths(F.slice(F.split(text, rule.pattern, -1), 1, F.size(every(0)))).alias("gap"),
        _lengths(every(0)).alias("own"),
        _lengths(every(rule.group)).alias("part"),
    )
    return F.when(F.rlike(text, pattern), F.struct(F.lit(rule.kind).alias("rule"), found.alias("found")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...], version: str) -> DataFrame:
    """Findings in ``blobs`` (blob, text, rules still to run)."""
    tried = [F.when(F.array_contains("rules", r.kind), _matches(F.col("text"), r)) for r in rules]
    # the outer form: for the inner one the optimiser adds a filter that runs the rules once more
    each = blobs.select("blob", F.explode_outer(F.array_compact(F.array(*tried))).alias("m")).where(F.col("m").isNotNull()).select("blob", "m.rule", F.posexplode("m.found").alias("k", "f"))
    each = each.dropDuplicates(["blob", "rule", "k"])  # a path may have the same version twice
    running = F.sum(F.col("f.gap") + F.col("f.own")).over(Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.select("blob", "rule", running.alias("end"), F.col("f.own").alias("own"), F.col("f.part").alias("part"))
    least = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.least)))
    kept = spans.where(F.col("part") >= least[F.col("rule")])
    return kept.select("blob", "rule", F.lit(version).alias("version"), (F.col("end") - F.col("own")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@dataclass
class Ledger:
    """What has been scanned (blob, rule, version) and what was found."""

    scanned: DataFrame
    found: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Ledger:
        return Ledger(spark.createDataFrame([], _LEDGER), spark.createDataFrame([], _FOUND))


def _paths(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    return named.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("path"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("blob"))


def update(spark: SparkSession, docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION, first_run: bool = False) -> tuple[Ledger, DataFrame]:
    """The ledger after a scan of what it lacks, and the paths (doc_id, blob) of ``docs``."""
    scratch = Scratch(spark, "ledger")
    paths = scratch.save(_paths(docs).select("doc_id", "path", "blob"), "paths")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    distinct = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if first_run:
        lacking = distinct.withColumn("rules", kinds)
    else:
        done = ledger.scanned.where(F.col("version") == version).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        lacking = distinct.join(done, "blob", "left").withColumn("rules", F.array_except(kinds, F.coalesce("done", F.expr("cast(array() as array<string>)")))).where(F.size("rules") > 0).drop("done")
    lacking = scratch.save(lacking, "lacking")
    # a blob's text is read at one of its paths; where that path has other versions their rows fall away by name
    wanted = lacking.select("path", "blob", "rules").hint("shuffle_hash")
    texts = _paths(docs).join(wanted, ["path", "blob"]).select("blob", "text", "rules")
    new = scratch.save(scan(texts, rules, version).distinct(), "found")
    scanned = ledger.scanned.unionByName(lacking.select("blob", F.explode("rules").alias("rule"), F.lit(version).alias("version")))
    return Ledger(scanned, ledger.found.unionByName(new)), paths


def joined(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob and ``spans`` (start, rank of the rule, kind, end), ordered, for every path."""
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    found = ledger.found.where(F.col("version") == version)
    by_blob = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), "end"))).alias("spans"))
    return paths.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")))


def digest(result: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return result.select("doc_id", *(count(k) for k in base), F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Findings of a first scan, for every path."""
    ledger, paths = update(spark, docs, Ledger.empty(spark), first_run=True)
    return joined(paths, ledger)
