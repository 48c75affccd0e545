"""Quotes to chunks: where the instances of a fresh count begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import one_spaced, unmarked

#: A listing's number before a line.
LISTED = r"^[<\[(（【〔]\s*\d+\s*[>\])）】〕]\s*"
#: Characters that a quote's beginning has at least, or so many ideographs.
LEAST_CHARS, LEAST_CJK = 12, 2
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


def seek_form(quote: Column) -> Column:
    """A quote as it would stand in a chunk: no mark or number, no quotation marks, spaces made one."""
    return one_spaced(F.regexp_replace(F.replace(unmarked(quote), F.lit("\\n"), F.lit(" ")), "^[\"'“‘「]+|[\"'”’」]+$", ""))


def seek_forms(quote: Column) -> Column:
    """What is sought for a quote: its form as written, and without the number in brackets that a listing puts before it."""
    form = seek_form(quote)
    bare = F.regexp_replace(form, LISTED, "")
    return F.array_distinct(F.filter(F.array(form, bare), lambda x: x != ""))


def beginnings(form: Column) -> Column:
    """Beginnings of a quote at word ends that are long enough to seek by, longest first."""
    words = F.split(form, " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.filter(parts, lambda p: (F.length(p) >= LEAST_CHARS) | (F.length(F.regexp_replace(p, f"[^{CJK[1:]}", "")) >= LEAST_CJK))


def sections(replies: DataFrame, label: Column) -> DataFrame:
    """``doc_id, line_no, label, line``: lines of a reply under the label line before them. ``label`` is over ``line`` and null for other lines."""
    lines = replies.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", unmarked(F.trim("raw"))).where("line <> ''")
    marked = lines.withColumn("own", label)
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("label", F.last("own", ignorenulls=True).over(order)).where("own is null and label is not null").select("doc_id", "line_no", "label", "line")


def anchors(quotes: DataFrame, chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``doc_id, quote_no, chunk_id``: for each quote in order the first chunk with its form that no quote before it took.

    A quote that spans a break of the listing (a written ``\\n``) and is found nowhere is sought by its beginnings. A
    document's quotes are folded over its chunks: both sides are gathered by document (and further ``keys``), which
    bounds the group by the document's own size. A document of which a quote finds no chunk has no anchors.
    """
    keys = keys or ["doc_id"]
    forms = seek_forms(F.col("quote"))
    spans = F.contains("quote", F.lit("\\n"))
    sought = F.concat(forms, F.when(spans, F.flatten(F.transform(forms, beginnings))).otherwise(F.array().cast("array<string>")))
    asked = quotes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("quote_no", sought.alias("forms")))), lambda q: q["forms"]).alias("forms"))
    texts = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk_id", one_spaced(F.col("text")).alias("form")))).alias("texts"))
    none, no_chunk = F.array().cast("array<long>"), F.lit(None).cast("long")

    def take(taken: Column, forms_: Column, texts_: Column) -> Column:
        first = lambda form: F.get(F.filter(texts_, lambda t: F.contains(t["form"], form) & ~F.array_contains(taken, t["chunk_id"].cast("long"))), F.lit(0))["chunk_id"].cast("long")
        return F.concat(taken, F.array(F.aggregate(forms_, no_chunk, lambda found, form: F.coalesce(found, first(form)))))

    found = asked.join(texts, keys).withColumn("taken", F.aggregate("forms", none, lambda taken, forms_: take(taken, forms_, F.col("texts"))))
    whole = found.where(~F.exists("taken", lambda c: c.isNull()))
    return whole.select(*keys, F.posexplode("taken").alias("quote_no", "chunk_id"))


def laid(points: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks of a merged run given to the instance whose anchor is the last at or before them."""
    from siltstone.operators.intervals import latest_anchor

    return latest_anchor(points, found).where("item is not null")


def claims_of(replies: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``doc_id, label, n, quotes``: what a fresh count says of each label, as ``label: n`` and a quote a line.

    Quotes outvote a zero. ``labels`` are the units asked about; without them every code or chain of a map is one.
    """
    head = r"^\s*([A-Za-z.0-9]+)\s*[:=]\s*(\d+)\s*$"
    label = F.regexp_extract("line", head, 1)
    is_label = label.rlike(r"^[a-z]+(\.\d+\.[a-z]+)?$") if labels is None else label.isin(labels)
    known = F.when(is_label, F.concat_ws(":", label, F.regexp_extract("line", head, 2)))
    lines = replies.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line", unmarked(F.trim("raw"))).where("line <> ''").withColumn("own", known)
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = lines.withColumn("head", F.last("own", ignorenulls=True).over(order)).where("head is not null")
    rows = F.sort_array(F.collect_list(F.when(F.col("own").isNull(), F.struct("line_no", "line"))))
    found = under.groupBy("doc_id", "head").agg(F.transform(rows, lambda r: r["line"]).alias("quotes"))
    n = F.get(F.split("head", ":"), F.lit(1)).cast("long")
    return found.select("doc_id", F.get(F.split("head", ":"), F.lit(0)).alias("label"), F.when((n == 0) & (F.size("quotes") > 0), F.size("quotes").cast("long")).otherwise(n).alias("n"), "quotes")


def resplit(assigned: DataFrame, found: DataFrame, code: str) -> DataFrame:
    """Assignments ``(doc_id, code, item, parent_code, parent, chunk_id)`` in which a merged unit's chunks go to the instances that anchors begin.

    The unit's chunks are its own and those of chains under it; what stands before the first anchor is the first
    instance's. A chain that shares a chunk with its parent follows the parent's new number; one that is left on a
    chunk of another instance goes, and the chunk is that instance's. Documents without anchors stay as they are.
    """
    keys = ["doc_id", "chunk_id"]
    rows = assigned.select("doc_id", "code", "item", "parent_code", "parent", "chunk_id")
    touched = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    own = touched.where((F.col("code") == code) & F.col("parent").isNull())
    chains = touched.where(F.col("parent_code") == code)
    domain = own.select(*keys).unionByName(chains.select(*keys)).distinct()
    from siltstone.operators.intervals import latest_anchor

    items = latest_anchor(domain, found).select(*keys, F.coalesce("item", F.lit(0).cast("long")).alias("io"))
    joint = own.select(*keys).distinct().withColumn("joint", F.lit(True))
    moved = chains.join(items, keys).join(joint, keys, "left").withColumn("joint", F.coalesce("joint", F.lit(False)))
    stays = (F.col("parent") == F.col("io")) | F.col("joint")
    kept_chains = moved.where(stays).select("doc_id", "code", "item", "parent_code", F.col("io").alias("parent"), "chunk_id").distinct()
    stranded = moved.where(~stays).select(*keys)
    plain = own.select(*keys).unionByName(stranded).unionByName(found.select(*keys)).distinct().join(items, keys)
    none = F.lit(None)
    redrawn = plain.select("doc_id", F.lit(code).alias("code"), F.col("io").alias("item"), none.cast("string").alias("parent_code"), none.cast("long").alias("parent"), "chunk_id")
    other = rows.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    rest = touched.where(~((F.col("code") == code) & F.col("parent").isNull()) & ~F.coalesce(F.col("parent_code") == code, F.lit(False)))
    return other.unionByName(rest).unionByName(redrawn).unionByName(kept_chains)


def lay_entries(points: DataFrame, found: DataFrame, opens: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, item``: a parent's chunks given to nested entries that anchors begin.

    Chunks before the first anchor stay the parent's. So do those after the last one, unless that one opens a section
    (``opens (doc_id, chunk_id)``): then they are its own up to the next section.
    """
    last = found.groupBy("doc_id").agg(F.max("chunk_id").alias("last"))
    head = last.join(opens.select("doc_id", F.col("chunk_id").alias("last")).withColumn("is_head", F.lit(True)), ["doc_id", "last"], "left")
    later = points.join(opens, ["doc_id", "chunk_id"], "left_semi").join(last, "doc_id").where("chunk_id > last").groupBy("doc_id").agg(F.min("chunk_id").alias("next"))
    limits = head.join(later, "doc_id", "left").select("doc_id", F.when(F.col("is_head"), F.coalesce("next", F.lit(1 << 40))).otherwise(F.least(F.col("last") + 1, F.coalesce("next", F.lit(1 << 40)))).alias("limit"))
    return laid(points, found).join(limits, "doc_id").where("chunk_id < limit").drop("limit")


def spliced(dests: DataFrame, answer: DataFrame) -> DataFrame:
    """Lines of a fresh answer that may join a map: those whose every chunk the map gives to no unit."""
    from siltstone.operators import intervals

    free = intervals.expand(dests.where("code = '-'").select("doc_id", "start", "end")).distinct()
    wide = answer.where("error is null and code <> '-'")
    lines = wide.select("doc_id", "line_no", "start", "end").distinct()
    covered = intervals.expand(lines.withColumn("size", F.col("end") - F.col("start") + 1)).join(free, ["doc_id", "chunk_id"], "left_semi").groupBy("doc_id", "line_no", "size").agg(F.count("*").alias("n")).where("n = size")
    return wide.join(covered.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
