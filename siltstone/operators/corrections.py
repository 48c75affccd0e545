"""Issues, the calls that own them, and bounded rounds of repair."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.json_values import apply_patch, value_chars
from siltstone.operators.budgets import at_item
from siltstone.operators.execution import value_path
from siltstone.sources.shared import discard, kept

#: Rounds of repair, and the share of a whole call's items that may be missing.
ROUNDS, SLIVER = 2, 10


def list_sizes(values: DataFrame) -> DataFrame:
    """``doc_id, path, actual``: entries of each value; what is no list has none."""
    return values.select("doc_id", "path", F.coalesce(F.json_array_length("value"), F.lit(0)).cast("long").alias("actual"))


def count_issues(counts: DataFrame, sizes: DataFrame, disputed: DataFrame | None = None) -> DataFrame:
    """``doc_id, key, path, expected, got, report_only``: one issue for each missing index, one for a surplus.

    ``counts`` have ``doc_id, path, declared``. A surplus of a disputed path is reported and not repaired.
    """
    both = mismatches(counts, sizes).select("doc_id", F.col("path").alias("key"), F.col("declared").alias("expected"), F.col("actual").alias("got"))
    if disputed is not None:
        both = both.join(disputed.select("doc_id", F.col("path").alias("key")).distinct().withColumn("soft", F.lit(True)), ["doc_id", "key"], "left")
    else:
        both = both.withColumn("soft", F.lit(False))
    short = both.where("got < expected").withColumn("n", F.explode(F.sequence("got", F.col("expected") - 1)))
    missing = short.select("doc_id", "key", F.concat("key", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("path"), "expected", "got", F.lit(False).alias("report_only"))
    surplus = both.where("got > expected").select("doc_id", "key", F.col("key").alias("path"), "expected", "got", F.coalesce("soft", F.lit(False)).alias("report_only"))
    return missing.unionByName(surplus)


def mismatches(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, path, declared, actual`` of counts that differ from the entries that there are."""
    both = counts.join(sizes, ["doc_id", "path"], "left").select("doc_id", "path", F.col("declared").cast("long").alias("declared"), F.coalesce("actual", F.lit(0).cast("long")).alias("actual"))
    return both.where("declared <> actual")


#: Columns of issues: ``origin`` ranks their sources (host, copies, counts), ``key`` is the path whose count is meant.
ISSUES = {"origin": "int", "key": "string", "path": "string", "message": "string", "code": "string", "expected": "string", "got": "string", "report_only": "boolean"}


def issue_rows(rows: DataFrame, origin: int) -> DataFrame:
    """Issues of one source with all columns; those that it lacks are null, and issues are to be repaired if it does not say."""
    given = {name: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind) for name, kind in ISSUES.items()}
    given |= {"origin": F.lit(origin), "report_only": F.coalesce(given["report_only"], F.lit(False))}
    return rows.select("doc_id", *(column.alias(name) for name, column in given.items()))


def count_messages(issues: DataFrame) -> DataFrame:
    """Count issues with what is told of them."""
    short = F.concat(F.lit("the document has "), F.col("expected").cast("string"), F.lit(" entries of this list and "), F.col("got").cast("string"), F.lit(" were given; this one is missing"))
    over = F.concat(F.lit("the document has "), F.col("expected").cast("string"), F.lit(" entries of this list and "), F.col("got").cast("string"), F.lit(" were given; take out what is no entry of its own"))
    return issues.withColumns({"code": F.lit("count"), "message": F.when(F.col("got") < F.col("expected"), short).otherwise(over)})


def _prefixes(path: Column) -> Column:
    """A path and the paths above it, which end before a ``.`` or ``[``."""
    ends = F.filter(F.sequence(F.lit(1), F.length(path) + 1), lambda n: (n > F.length(path)) | F.substr(path, n, F.lit(1)).isin(".", "["))
    return F.transform(ends, lambda n: F.substr(path, F.lit(1), n - 1))


def owners(issues: DataFrame, calls: DataFrame) -> DataFrame:
    """``doc_id, path, call_seq``: the call of the longest unit that covers an issue's path and its item, else the scalars' call.

    An issue meets calls by the paths above its own and the item that its path names below them: equi-joins alone.
    """
    none = F.lit(-1).cast("long")
    named = calls.where("unit <> '$misc'")
    slots = F.when(F.col("batch").isNotNull(), F.col("batch")).when(F.col("item").isNotNull(), F.array("item")).otherwise(F.array(none))
    covers = named.select("doc_id", "call_seq", F.length("unit").alias("rank"), value_path(F.col("unit"), F.col("parent")).alias("scope"), F.explode(slots).alias("slot"))
    paths = issues.select("doc_id", "path").distinct()
    above = paths.withColumn("scope", F.explode(_prefixes(F.col("path"))))
    tail = F.substr("path", F.length("scope") + 1)
    index = F.nullif(F.regexp_extract(tail, r"^\[(\d+)\](?:[.\[].*)?$", 1), F.lit("")).cast("long")
    asked = above.withColumn("slot", F.explode(F.array_compact(F.array(none, index))))
    met = asked.join(covers, ["doc_id", "scope", "slot"])
    best = met.groupBy("doc_id", "path").agg(F.min_by("call_seq", F.struct(-F.col("rank"), F.col("call_seq"))).alias("own"))
    rest = calls.where("unit = '$misc'").groupBy("doc_id").agg(F.min("call_seq").alias("rest"))
    found = paths.join(best, ["doc_id", "path"], "left").join(rest, "doc_id", "left")
    return found.select("doc_id", "path", F.coalesce("own", "rest").alias("call_seq")).where("call_seq is not null")


def produced(calls: DataFrame, state: DataFrame) -> DataFrame:
    """``doc_id, call_seq, got``: entries of each reply; of a call for one entry, or an unwrapped one, that is one."""
    known = calls.join(state.select("doc_id", "call_seq", "data"), ["doc_id", "call_seq"])
    listed = F.when((F.col("strategy") == "whole") | F.col("batch").isNotNull(), F.json_array_length("data"))
    return known.select("doc_id", "call_seq", F.when(F.col("data").isNull() | (F.col("data") == "null"), 0).otherwise(F.coalesce(listed, F.lit(1))).cast("long").alias("got"))


def count_owners(issues: DataFrame, calls: DataFrame, produced: DataFrame) -> DataFrame:
    """``doc_id, path, call_seq``: calls that gave too much always, calls that gave too little only for what is missing.

    A whole call that lacks a tenth or less is let be. ``produced`` has ``doc_id, call_seq, got``.
    """
    c = calls.join(produced.withColumnRenamed("got", "made"), ["doc_id", "call_seq"]).select("doc_id", "call_seq", "strategy", "item", "batch", "made", value_path(F.col("unit"), F.col("parent")).alias("key"))
    told = issues.where("not report_only").select("doc_id", "key", "path", F.col("expected").cast("long").alias("expected"), F.col("got").cast("long").alias("got"))
    both = told.join(c, ["doc_id", "key"])
    slots = F.when(F.col("batch").isNotNull(), F.size("batch")).when(F.col("item").isNotNull(), 1).otherwise(F.col("expected"))
    sliver = (F.col("strategy") == "whole") & ((slots - F.col("made")) * 100 <= slots * SLIVER)
    mine = (F.col("made") > slots) | ((F.col("expected") >= F.col("got")) & (F.col("made") < slots) & ~sliver)
    return both.where(mine).select("doc_id", "path", "call_seq").distinct()


def routed(issues: DataFrame, calls: DataFrame, made: DataFrame, seen: DataFrame | None = None, absent: DataFrame | None = None) -> DataFrame:
    """``doc_id, call_seq, paths, messages``: issues by owning call.

    Counts go to the calls that gave too much or too little, other issues to the call that covers their path. What a
    call has declared absent is left out, and so are calls whose issues are those of their last round. Messages are
    in the order of their sources and paths.
    """
    live = issues.where("not report_only")
    found = owners(live.where("key is null"), calls).unionByName(count_owners(live.where("key is not null"), calls, made)).distinct()
    if absent is not None:
        found = found.join(absent.select("doc_id", "call_seq", "path"), ["doc_id", "call_seq", "path"], "left_anti")
    told = found.join(live.select("doc_id", "path", "origin", "message"), ["doc_id", "path"])
    line = F.concat_ws(": ", "path", "message")
    grouped = told.groupBy("doc_id", "call_seq").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.transform(F.array_sort(F.collect_set(F.struct("origin", "path", line.alias("line")))), lambda x: x["line"]).alias("messages"))
    return grouped if seen is None else grouped.join(seen.select("doc_id", "call_seq", "paths"), ["doc_id", "call_seq", "paths"], "left_anti")


def remedies(rows: DataFrame) -> DataFrame:
    """How calls are asked again: in full after a broken protocol or without a reply, afresh after an empty list, else for a patch."""
    asked = F.when(F.col("data").isNull() | F.coalesce("broken", F.lit(False)), "full").when(F.col("data") == "[]", "fresh").otherwise("patch")
    return rows.withColumn("remedy", asked)


def replied(rows: DataFrame) -> DataFrame:
    """Rows ``(data, history, reply, after, unit, remedy)`` with the new ``data`` and ``history``, whether the protocol broke, and whether nothing can be fixed."""
    applied = rows.withColumn("patch", apply_patch("data", "reply", "unit"))
    no_fix = (F.col("remedy") == "patch") & (F.col("reply") == "[]")
    broke = (F.col("remedy") == "patch") & F.col("patch.error").isNotNull()
    new = F.when(no_fix, F.col("data")).when(F.col("remedy") != "patch", F.col("reply")).otherwise(F.coalesce("patch.value", "data"))
    columns = {"data": new, "no_fix": no_fix, "broken": F.coalesce("broken", F.lit(False)) | broke, "broke": broke}
    if "after" in rows.columns:
        columns["history"] = F.when(no_fix | broke, F.col("history")).otherwise(F.coalesce("after", "history"))
    return applied.withColumns(columns).drop("patch")


def correct(replies: DataFrame, calls: DataFrame, validate: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(replies, issues, trace)`` after at most so many rounds; ``trace`` has ``doc_id, round, call_seq, remedy, paths``.

    ``validate`` makes issues (``ISSUES``) from replies ``(doc_id, call_seq, data)``; ``ask`` answers rows
    ``(doc_id, call_seq, unit, data, history, remedy, paths, messages)`` with ``(doc_id, call_seq, reply, after)``.
    Every round begins and ends at written tables, so that its plan does not grow with the rounds before it; a round
    without work ends them. A call that broke the patch protocol is asked in full from then on.
    """
    history = F.col("history") if "history" in replies.columns else F.lit(None).cast("string")
    state = kept(replies.select("doc_id", "call_seq", "data", history.alias("history")).withColumn("broken", F.lit(False)), "state")
    issues = kept(validate(state), "issues")
    seen = absent = None
    done = []
    for number in range(rounds):
        todo = kept(routed(issues, calls, produced(calls, state), seen, absent), "todo")
        if todo.isEmpty():
            discard(todo)
            break
        rows = kept(remedies(todo.join(state, ["doc_id", "call_seq"], "left").join(calls.select("doc_id", "call_seq", "unit"), ["doc_id", "call_seq"])), "asked")
        after = kept(replied(rows.join(ask(rows), ["doc_id", "call_seq"])), "repaired")
        done.append(rows.select("doc_id", F.lit(number).alias("round"), "call_seq", "remedy", "paths"))
        nothing = after.where("no_fix").select("doc_id", "call_seq", F.explode("paths").alias("path"))
        absent = nothing if absent is None else absent.unionByName(nothing)
        fresh = after.where("not broke").select("doc_id", "call_seq", "paths")
        seen = fresh if seen is None else fresh.unionByName(seen.join(after, ["doc_id", "call_seq"], "left_anti"))
        old_state, old_issues = state, issues
        state = kept(after.select("doc_id", "call_seq", "data", "history", "broken").unionByName(state.join(after, ["doc_id", "call_seq"], "left_anti")), "state")
        issues = kept(validate(state), "issues")
        discard(todo, old_state, old_issues)
    empty = state.sparkSession.createDataFrame([], f"doc_id {state.schema['doc_id'].dataType.simpleString()}, round int, call_seq long, remedy string, paths array<string>")
    return state.select("doc_id", "call_seq", "data"), issues, reduce(DataFrame.unionByName, done, empty)


def feedback(messages: Column, how: Column) -> Column:
    """Messages of a round as a JSON list; how to answer is told with the last one."""
    last = F.concat_ws("\n", F.element_at(messages, -1), how)
    return F.when(F.size(messages) > 0, F.to_json(F.concat(F.slice(messages, F.lit(1), F.size(messages) - 1), F.array(last)))).otherwise(F.lit("[]"))


def item_chars(budgets: DataFrame, values: DataFrame, whole: DataFrame) -> DataFrame:
    """``doc_id, key, budget, chars``: what each item of a budgeted path was to have and has.

    ``budgets (doc_id, path, budgets)``, ``values (doc_id, path, value)`` as JSON texts; paths of ``whole (doc_id,
    path)`` came from one call over a shared run, so their total is judged. A short list's last budget goes on.
    """
    both = budgets.join(values.select("doc_id", "path", "value"), ["doc_id", "path"]).join(whole.select("doc_id", "path").distinct().withColumn("total", F.lit(True)), ["doc_id", "path"], "left")
    listed = both.withColumn("entries", F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v: F.to_json(v)))
    together = F.coalesce("total", F.lit(False)) | F.col("entries").isNull()
    one = listed.where(together).select("doc_id", F.when(F.col("entries").isNotNull(), F.concat("path", F.lit(" (total)"))).otherwise(F.col("path")).alias("key"), F.when(F.col("entries").isNotNull(), F.aggregate("budgets", F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.element_at("budgets", -1)).alias("budget"), F.col("value").alias("part"))
    each = listed.where(~together).select("doc_id", "path", "budgets", F.posexplode("entries").alias("n", "part"))
    items = each.select("doc_id", F.concat("path", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("key"), at_item(F.col("budgets"), F.col("n")).alias("budget"), "part")
    return one.unionByName(items).select("doc_id", "key", "budget", value_chars("part").alias("chars"))
