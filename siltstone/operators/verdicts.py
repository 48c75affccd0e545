"""Arbitration between a declared count and an extracted list, by what a fresh look finds missing or extra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import one_spaced
from siltstone.operators.recounts import sections

#: Entries that are listed, and characters of each.
LISTED, OPENING = 120, 80
CHECK = """The document below holds instances of one kind, and this list was made of them. Each line is how an entry begins:

{list}

Go through the document once more with the list beside it. Under `missing:` write how each instance begins that the
list lacks, and under `extra:` how each entry begins that the document does not hold. One a line, in the very words
and long enough to be told from others, without comment. If nothing is missing or extra, leave a section empty, but
write both.

missing:

extra:
"""


def openings(items: DataFrame) -> DataFrame:
    """``doc_id, openings``: the longest string (the first of equals) of each item ``(doc_id, seq, strings)``, cut, blank ones left out."""
    longest = F.aggregate("strings", F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best))
    cut = items.withColumn("opening", F.substring(longest, 1, OPENING)).where("opening <> ''")
    rows = F.sort_array(F.collect_list(F.struct("seq", "opening")))
    return cut.groupBy("doc_id").agg(F.slice(F.transform(rows, lambda r: r["opening"]), 1, LISTED).alias("openings"))


def verdict_label(line: Column) -> Column:
    bare = F.lower(F.regexp_replace(line, ":+$", ""))
    return F.when(bare.isin("missing", "extra"), bare)


def verdicts(replies: DataFrame, documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``doc_id, missing, extra`` of usable replies ``(doc_id, text)``.

    Usable: both sections are there, all that is missing stands in the document, and all that is extra stands in
    the list and not in the document.
    """
    label = verdict_label(F.col("line"))
    there = replies.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_replace(F.trim(x), ":+$", ""))).alias("heads"))
    both = there.where(F.array_contains("heads", "missing") & F.array_contains("heads", "extra")).select("doc_id")
    quotes = sections(replies, label).groupBy("doc_id", "label").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("line_no", one_spaced(F.col("line")).alias("q")))), lambda r: r["q"])).alias("quotes"))
    side = lambda name: quotes.where(F.col("label") == name).select("doc_id", F.col("quotes").alias(name))
    none = F.array().cast("array<string>")
    rows = both.join(side("missing"), "doc_id", "left").join(side("extra"), "doc_id", "left").join(documents.select("doc_id", one_spaced(F.col("text")).alias("body")), "doc_id").join(listed, "doc_id", "left")
    rows = rows.select("doc_id", "body", F.coalesce("missing", none).alias("missing"), F.coalesce("extra", none).alias("extra"), F.transform(F.coalesce("openings", none), one_spaced).alias("listed"))
    found = F.forall("missing", lambda q: (q != "") & F.contains("body", q))
    spare = F.forall("extra", lambda q: (q != "") & ~F.contains("body", q) & F.exists("listed", lambda e: F.contains(e, q)))
    return rows.where(found & spare).select("doc_id", "missing", "extra")


def revised(actual: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """``doc_id, actual, revised``: the count with what is missing, less what is extra; null if there is no usable verdict.

    An empty list cannot confirm itself.
    """
    joined = actual.join(verdicts_, "doc_id", "left")
    count = F.col("actual") + F.size("missing") - F.size("extra")
    return joined.select("doc_id", "actual", F.when(F.col("missing").isNotNull() & ~((F.size("missing") == 0) & (F.col("actual") == 0)), count).alias("revised"))


def strings_of(entries: DataFrame) -> DataFrame:
    """``doc_id, seq, strings`` of ``entries (doc_id, seq, entry)``, JSON texts: an object's strings, or the text of what is none."""
    fields = F.map_values(F.from_json("entry", "map<string,variant>"))
    texts = F.transform(F.filter(fields, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    own = F.try_variant_get(F.try_parse_json("entry"), "$", "string")
    return entries.where("entry <> 'null'").select("doc_id", "seq", F.when(F.startswith("entry", F.lit("{")), texts).otherwise(F.array(F.coalesce(own, F.col("entry")))).alias("strings"))


def checks(mismatched: DataFrame, values: DataFrame, documents: DataFrame) -> DataFrame:
    """A case for each mismatch ``(doc_id, path, declared, actual)``: these, ``case``, the list's ``openings`` and the document's ``text``.

    ``values (doc_id, path, value)`` are JSON texts.
    """
    cases = mismatched.withColumn("case", F.concat_ws("\x01", F.col("doc_id").cast("string"), "path"))
    entries = F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v: F.to_json(v))
    items = cases.join(values.select("doc_id", "path", "value"), ["doc_id", "path"]).select(F.col("case").alias("doc_id"), F.posexplode(entries).alias("seq", "entry"))
    listed = openings(strings_of(items)).withColumnRenamed("doc_id", "case")
    none = F.array().cast("array<string>")
    return cases.join(listed, "case", "left").withColumn("openings", F.coalesce("openings", none)).join(documents.select("doc_id", "text"), "doc_id")


def check_requests(cases: DataFrame) -> DataFrame:
    """A request a case, in a conversation of its own: no reply is shown that it could repeat."""
    lines = F.array_join(F.transform("openings", lambda o: F.concat(F.lit("- "), o)), "\n")
    none = F.lit(None).cast("string")
    return cases.select("doc_id", F.concat(F.lit("check-"), "path").alias("call_key"), F.replace(F.lit(CHECK), F.lit("{list}"), lines).alias("instructions"), F.lit('{"type": "string"}').alias("contract"), F.col("text").alias("content"), F.lit("").alias("scope"), none.alias("history"), none.alias("feedback"))


def arbitrated(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, path, declared, actual, revised, answer`` for ``answers (doc_id, path, text)``; a case without a usable one has no revised count."""
    told = cases.join(answers.select("doc_id", "path", F.col("text").alias("answer")), ["doc_id", "path"], "left")
    by_case = lambda column, name: told.select(F.col("case").alias("doc_id"), F.col(column).alias(name))
    found = verdicts(by_case("answer", "text").where("text is not null"), by_case("text", "text"), by_case("openings", "openings"))
    counts = revised(by_case("actual", "actual"), found).select(F.col("doc_id").alias("case"), "revised")
    return told.join(counts, "case").select("doc_id", "path", "declared", "actual", F.col("revised").cast("long").alias("revised"), "answer")


def settled(counts: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(counts, disputed)``: declared counts with those that a check revised, and paths whose surplus no check settled."""
    new = counts.join(checked.select("doc_id", "path", "revised"), ["doc_id", "path"], "left").select("doc_id", "path", F.coalesce("revised", "declared").alias("declared"))
    return new, checked.where("revised is null and actual > declared").select("doc_id", "path")
