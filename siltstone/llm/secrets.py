"""Secret scans with an incremental blob ledger, in DataFrame operations alone.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds the pairs of
blob and rule version that have been scanned; only pairs that it lacks are scanned, each once however many
paths share the blob, and findings are joined back to all paths.

Results: null text is the empty blob, without findings. Repeated rows and ties share one blob and get the
same findings, a row each. Extra columns are not read. Positions count code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that a group has at least.
    group: int = 0
    least: int = 1
    #: The group that is the finding: what stands before it in a match is context.
    span: int = 0
    #: What every match holds: texts without it are passed over by a plain search.
    holds: str = ""


#: Base rules in their order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, holds="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules. Runs are of one class each and start where no such run is open, so that every rule
#: takes time in proportion to the text, and no group repeats, which Java's matcher would do by recursion.
FURTHER = (
    Rule("pem", r"-----BEGIN (?:[A-Z ]*[A-Z] )?PRIVATE KEY-----", holds="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", holds="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", span=1, holds="eyJ"),
)
RULES, VERSION = BASE + FURTHER, "r2"


def content_addressed(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``(path, blob, body)`` of every version."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("body"))


def unseen(keyed: DataFrame, ledger: DataFrame | None, version: str = VERSION) -> DataFrame:
    """The blobs that the ledger has not under this rule version."""
    blobs = keyed.select("blob").distinct()
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")


def _matches(rule: Rule) -> Column:
    hits = F.regexp_extract_all("body", F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split("body", rule.pattern, -1), F.length)
    found = F.when(F.contains("body", F.lit(rule.holds)) & F.col("body").rlike(rule.pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(RULES.index(rule)).alias("rank"), found.alias("found"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, findings)`` of ``(blob, body)``; blobs without findings have no row.

    Matches of a rule are leftmost and do not overlap. The text between matches gives their places: a
    match starts where the lengths of all gaps and matches before it end.
    """
    by_rule = blobs.select("blob", F.explode(F.array(*[_matches(r) for r in rules])).alias("m")).where("m.found is not null")
    each = by_rule.select("blob", "m.kind", "m.rank", F.posexplode("m.found").alias("n", "x")).where("x.hit is not null")
    sizes = each.select("blob", "kind", "rank", "n", F.col("x.gap").alias("gap"), F.length("x.hit").alias("size"), F.col("x.hit").alias("hit"))
    ends = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sizes.withColumn("end", ends)
    least = F.lit(True)
    for rule in rules:
        if rule.least > 1:
            least = least & ((F.col("kind") != rule.kind) | (F.length(F.regexp_extract("hit", rule.pattern, rule.group)) >= rule.least))
    size = F.col("size")
    for rule in rules:
        if rule.span:
            size = F.when(F.col("kind") == rule.kind, F.length(F.regexp_extract("hit", rule.pattern, rule.span))).otherwise(size)
    kept = placed.where(least).select("blob", F.struct((F.col("end") - size).alias("start"), F.col("rank"), F.col("end"), F.col("kind")).alias("f"))
    return kept.groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("findings"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(paths with findings, ledger, findings by blob)``; the latter two are what the next call is given."""
    keyed = content_addressed(versions, path, text)
    new = written(unseen(keyed, ledger, version), "ledger-new")
    # One body a blob, taken before texts are dealt: a blob that a third of all paths share is sent once a task.
    bodies = keyed.groupBy("blob").agg(F.any_value("body").alias("body"))
    if ledger is not None:
        bodies = bodies.join(new, "blob", "left_semi")
    found = written(scan_blobs(bodies, rules).withColumn("findings", F.array_distinct("findings")).withColumn("rule_version", F.lit(version)), "ledger-findings")
    found = found if findings is None else findings.unionByName(found)
    seen = new.select("blob", F.lit(version).alias("rule_version"))
    seen = seen if ledger is None else ledger.unionByName(seen)
    of_version = found.where(F.col("rule_version") == version).select("blob", "findings")
    joined = keyed.select("path", "blob").join(of_version, "blob", "left")
    return joined.select("path", "blob", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings")), seen, found


def rendered(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
