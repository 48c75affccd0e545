"""Documents and a schema in, schema-shaped JSON with issues and a trace out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.chunking import MAX_CHARS, chunk
from siltstone.operators import budgets, copies, corrections, evals, execution, routing, verdicts
from siltstone.plans import schema as schemas
from siltstone.plans.quota import Quota, parse_quota
from siltstone.plans.units import Unit, decompose, stripped, units_table, yields
from siltstone.sources.runner import Runner, ask
from siltstone.sources.shared import kept
from siltstone.sources.shipping import ship

SPECIALIST = "You extract the fields of one unit from the material below. The document is background: it may complete a value, it adds no entries. Give only data of the output schema.\nUnit:\n{card}"
WHOLE = "\nThe output is a list: every instance in the material is an entry of its own, none is merged, summarised or made up."
PATCH = "Answer with a JSON Patch (RFC 6902) of your last reply that changes what is named and nothing else; pointers may begin with the unit's path. An empty patch says that what is asked for is not there. If no patch can say it, give the whole value."
#: The shape of a patch.
PATCH_SHAPE = {"type": "array", "items": {"type": "object", "properties": {"op": {"type": "string", "enum": ["add", "remove", "replace", "move", "copy", "test"]}, "path": {"type": "string"}, "from": {"type": "string"}, "value": {}}, "required": ["op", "path"]}}


@dataclass(frozen=True)
class ExtractionConfig:
    """What can be set for an extraction; templates and quotas are checked when it is made."""

    quota: int | str = 8
    router_quota: int | str | None = None
    max_chars: int = MAX_CHARS
    rounds: int = corrections.ROUNDS
    batch_cap: int = execution.BATCH_CAP
    strategies: dict[str, str] = field(default_factory=dict)
    output_budgets: dict[str, list[int]] = field(default_factory=dict)
    router_instructions: str | None = None
    recount_instructions: str | None = None
    specialist_instructions: str | None = None

    def __post_init__(self) -> None:
        if self.router_instructions is not None:
            schemas.require_slots(self.router_instructions, ["legend", "parts"], "the router's instructions")
        if self.specialist_instructions is not None:
            schemas.require_slots(self.specialist_instructions, ["card"], "the specialist's instructions")
        parse_quota(self.quota)
        self.router_limits  # noqa: B018

    @property
    def limits(self) -> Quota:
        return parse_quota(self.quota)

    @property
    def router_limits(self) -> Quota:
        return parse_quota(self.quota if self.router_quota is None else self.router_quota)

    def prompts(self) -> dict[str, str]:
        return {name: schemas.provenance(getattr(self, f"{name}_instructions")) for name in ("router", "recount", "specialist")}


@dataclass
class Extraction:
    """``data`` (doc_id, data), ``issues``, and the trace's tables."""

    data: DataFrame
    issues: DataFrame
    chunks: DataFrame
    maps: DataFrame
    calls: DataFrame
    counts: DataFrame
    errors: DataFrame
    recounts: DataFrame
    corrections: DataFrame
    prompts: dict[str, str]


def _contract(unit: Unit, array: bool) -> str:
    shown = schemas.shown(unit.contract)
    return json.dumps({"type": "array", "items": shown} if array else shown, ensure_ascii=False)


def requests(calls: DataFrame, documents: DataFrame, units: list[Unit], template: str, dropped: DataFrame | None = None, gives_way: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """A request a call: the document, then the unit's card, then its material.

    ``dropped (doc_id, call_seq, siblings)`` names lifted siblings whose fields that give way are not asked for.
    """
    spark = calls.sparkSession
    wanted = {(u.path, ""): u for u in units}
    rows = calls.withColumn("variant", F.lit(""))
    if dropped is not None:
        met = calls.join(dropped, ["doc_id", "call_seq"], "left")
        rows = met.withColumn("variant", F.array_join(F.coalesce("siblings", F.array().cast("array<string>")), ","))
        by_path = {u.path: u for u in units}
        # As many variants as the schema has sets of such siblings.
        for row in rows.where("variant <> ''").select("unit", "variant").distinct().collect():
            gone = {name for sibling in row.variant.split(",") for name in (gives_way or {})[row.unit][sibling]}
            wanted[row.unit, row.variant] = stripped(by_path[row.unit], gone)
    plans = spark.createDataFrame([(path, variant, template.replace("{card}", u.card), _contract(u, False), _contract(u, True), u.kind == "array") for (path, variant), u in wanted.items()], "unit string, variant string, lead string, one string, many string, is_array boolean")
    rows = rows.join(F.broadcast(plans), ["unit", "variant"]).join(documents.select("doc_id", F.col("text").alias("content")), "doc_id")
    listed = F.col("batch").isNotNull() | (F.col("is_array") & F.col("item").isNull())
    none = F.lit(None).cast("string")
    return rows.select("doc_id", F.concat(F.lit("call-"), F.col("call_seq").cast("string")).alias("call_key"), F.concat("lead", F.when(listed, WHOLE).otherwise("")).alias("instructions"), F.when(listed, F.col("many")).otherwise(F.col("one")).alias("contract"), "content", "scope", none.alias("history"), none.alias("feedback"))


def _seq(replies: DataFrame) -> DataFrame:
    return replies.withColumn("call_seq", F.substring("call_key", 6, 20).cast("long"))


def _text(reply: Column) -> Column:
    return F.coalesce(F.from_json(F.concat(F.lit('{"t":'), reply, F.lit("}")), "t string")["t"], F.lit(""))


def _budgets(config: ExtractionConfig, schema: dict, units: list[Unit], lines: DataFrame, table: DataFrame, assigned: DataFrame, chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id, unit, budgets``: the router's, over them the host's, over both what copied fields cost."""
    told = routing.route_map.declarations(lines, table).join(F.broadcast(table.select("code", "path")), "code")
    material = budgets.material(assigned, chunks)
    arranged = routing.route_map.resolved_budgets(told.drop("code").withColumnRenamed("path", "code"), material.withColumnRenamed("unit", "code")).withColumnRenamed("code", "unit")
    router = budgets.per_item(arranged)
    host = groups.select("doc_id", "unit").distinct().where(F.col("unit").isin(list(config.output_budgets)))
    pinned = F.lit(None).cast("array<bigint>")
    for path, values in config.output_budgets.items():
        pinned = F.when(F.col("unit") == path, F.array(*map(F.lit, values)).cast("array<bigint>")).otherwise(pinned)
    copied = [path for path, _ in schemas.copied_paths(schema)]
    marked = [u.path for u in units if any(p == u.path or p.startswith(u.path + ".") for p in copied)]
    found = budgets.precedence(router.withColumnRenamed("unit", "path"), host.select("doc_id", F.col("unit").alias("path"), pinned.alias("budgets")), copies.copy_budgets(material, marked))
    return found.withColumnRenamed("path", "unit")


def extract(documents: DataFrame, schema: dict, factory: Callable[[], Runner], validator: Callable[[DataFrame], DataFrame] | None = None, config: ExtractionConfig | None = None, router_factory: Callable[[], Runner] | None = None) -> Extraction:
    """Extract from ``documents (doc_id, text)``.

    ``validator`` makes issues from ``(doc_id, data)``: ``doc_id, path, message``, and ``report_only``, ``code``,
    ``expected``, ``got`` if it has them. ``router_factory`` makes the runner that maps and checks, if that is another
    one. Documents without chunks, or a schema without units, have empty data and no calls.
    """
    config = config or ExtractionConfig()
    spark = documents.sparkSession
    ship(spark)
    units = decompose(schema)
    table = units_table(spark, units)
    router, quota = router_factory or factory, config.limits
    chunks = kept(chunk(documents, config.max_chars), "chunks")
    lead = "".join(f"{part}\n" for part in (schemas.head(schema), schemas.instruction(schema)) if part)
    lines, errors = routing.route(documents, chunks, units, table, router, instructions=config.router_instructions or routing.INSTRUCTIONS, quota=config.router_limits, lead=lead, recount_instructions=config.recount_instructions)
    lines = kept(lines, "lines")
    assigned, counts = (kept(rows, name) for rows, name in zip(routing.routed_items(lines, table), ("assigned", "counts"), strict=True))
    groups = kept(execution.groups(assigned, chunks.withColumn("chunk_id", F.col("chunk_id").cast("long"))), "groups")
    calls = kept(execution.plan_calls(groups, _budgets(config, schema, units, lines, table, assigned, chunks, groups), config.batch_cap, config.strategies), "calls")
    lifted = {u.parent: {v.field for v in units if v.parent == u.parent} for u in units if u.parent}
    gives_way = {u.path: found for u in units if u.path in lifted and (found := {k: sorted(v) for k, v in yields(u, lifted[u.path]).items()})}
    dropped = kept(execution.overridden(calls, assigned, gives_way), "dropped") if gives_way else None
    asked = kept(requests(calls, documents, units, config.specialist_instructions or SPECIALIST, dropped, gives_way), "requests")
    first = kept(_seq(ask(asked, factory, quota)), "replies")
    marked = schemas.marked_fields(schema)

    def merged(replies: DataFrame) -> DataFrame:
        return execution.documents_of(execution.values(calls, replies), gives_way)

    # Counts that differ are looked at afresh before anything is repaired.
    start = first.where("error is null").select("doc_id", "call_seq", "data", "history")
    values = kept(execution.values(calls, start), "values")
    apart = corrections.mismatches(counts, corrections.list_sizes(values))
    cases = kept(verdicts.checks(apart, values, documents), "checks")
    answers = kept(ask(verdicts.check_requests(cases), router, config.router_limits), "answers")
    told = answers.where("error is null").select("doc_id", F.substring("call_key", 7, 1 << 30).alias("path"), _text(F.col("data")).alias("text"))
    recounts = kept(verdicts.arbitrated(cases, told), "recounts")
    settled, disputed = verdicts.settled(counts, recounts)
    settled, disputed = kept(settled, "counts"), kept(disputed, "disputed")

    def validate(replies: DataFrame) -> DataFrame:
        own = kept(execution.values(calls, replies), "values")
        data = kept(documents.select("doc_id").join(execution.documents_of(own, gives_way), "doc_id", "left").select("doc_id", F.coalesce("data", F.lit("{}")).alias("data")), "data")
        found = [corrections.issue_rows(corrections.count_messages(corrections.count_issues(settled, corrections.list_sizes(own), disputed)), 2)]
        if marked:
            found.append(corrections.issue_rows(copies.copy_issues(copies.breaches(copies.marked_values(data, marked), documents)), 1))
        if validator is not None:
            found.append(corrections.issue_rows(validator(data), 0))
        issues = found[0]
        for more in found[1:]:
            issues = issues.unionByName(more)
        return issues

    def again(rows: DataFrame) -> DataFrame:
        base = _seq(asked).drop("history", "feedback")
        patch = F.col("remedy") == "patch"
        shape = F.concat(F.lit('{"anyOf": [' + json.dumps(PATCH_SHAPE) + ", "), "contract", F.lit("]}"))
        ready = base.join(rows.select("doc_id", "call_seq", "remedy", "messages", F.col("history").alias("past")), ["doc_id", "call_seq"])
        # A call with a history has its instructions and material in it.
        sent = ready.select("doc_id", "call_key", F.when(patch, "").otherwise(F.col("instructions")).alias("instructions"), F.when(patch, shape).otherwise(F.col("contract")).alias("contract"), "content", F.when(patch, "").otherwise(F.col("scope")).alias("scope"), F.when(F.col("remedy") != "fresh", F.col("past")).alias("history"), corrections.feedback(F.col("messages"), F.when(patch, PATCH)).alias("feedback"))
        return kept(_seq(ask(sent, factory, quota)).where("error is null").select("doc_id", "call_seq", F.col("data").alias("reply"), F.col("history").alias("after")), "repairs")

    replies, issues, trace = corrections.correct(start, calls, validate, again, config.rounds)
    data = documents.select("doc_id").join(merged(replies), "doc_id", "left").select("doc_id", F.coalesce("data", F.lit("{}")).alias("data"))
    failed = first.where("error is not null").select("doc_id", F.lit("call failed").alias("rule"), F.col("error").alias("detail"))
    return Extraction(data, issues, chunks, routing.spans_of(lines), calls, counts, errors.unionByName(failed), recounts, trace, config.prompts())


def audited(extraction: Extraction, schema: dict) -> DataFrame:
    """``doc_id, key, budget, chars, fits``: how the values of budgeted units keep what they were to have."""
    return evals.value_fit(extraction.data, extraction.calls, [u.path for u in decompose(schema)])


def typed(extraction: Extraction, ddl: str) -> DataFrame:
    """The data as columns of a Spark schema."""
    return extraction.data.select("doc_id", F.from_json("data", ddl).alias("value")).select("doc_id", "value.*")
