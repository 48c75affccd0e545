"""Registered queries: each applies one operator to whole tables, with SQL that gives the same rows.

The tables hold no routing traces, so segments, calls and replies are derived from documents, turns and
orders by plain arithmetic that SQL repeats.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import chunking, json_values, text
from siltstone.operators import budgets, copies, corrections, evals, execution, hints, intervals, recounts, route_map, verdicts
from siltstone.plans.schema import marked_fields
from siltstone.plans.units import decompose, units_table
from siltstone.sources.documents import spread
from siltstone.sources.shared import kept
from siltstone.sources.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[run.__name__] = functools.wraps(run)(shipped)
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived tables, in both languages

LINES_SQL = """
WITH split AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS chunk_id FROM split),
coded AS (SELECT doc_id, chunk_id, text, length(regexp_replace(text, '\\s+', '', 'g')) AS content_len,
  CASE length(text) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '-' END AS code FROM lines),
runs AS (SELECT doc_id, code, min(chunk_id) AS start, max(chunk_id) AS "end" FROM
  (SELECT *, chunk_id - row_number() OVER (PARTITION BY doc_id, code ORDER BY chunk_id) AS island FROM coded) GROUP BY doc_id, code, island),
spans AS (SELECT doc_id, chunk_id AS start, chunk_id + length(text) % 4 AS "end" FROM coded WHERE content_len % 3 = 0)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    full = F.filter(F.split(text.normalize_newlines(F.col("text")), "\n"), lambda x: ~text.is_blank(x))
    rows = docs.select("doc_id", F.posexplode(full).alias("chunk_id", "text"))
    code = F.element_at(F.array(*map(F.lit, "abc-")), (F.length("text") % 4 + 1).cast("int"))
    return rows.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", text.content_len(F.col("text")).cast("long").alias("content_len"), code.alias("code"))


#: Bytes of the documents' files for one part of what is keyed by document.
PART_BYTES = 8 << 20


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts that grow with the documents, however well their rows compress in a shuffle."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "code", "chunk_id")
    # Adaptive plans join small shuffles to a part a core, and all steps behind them keep that many.
    return intervals.runs(rows.repartition(parts(spark, sf_dir), "doc_id"), ["doc_id", "code"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("content_len % 3 = 0").select("doc_id", F.col("chunk_id").alias("start"), (F.col("chunk_id") + F.length("text") % 4).alias("end"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("size"))


# --- chunks and text


@query(LINES_SQL + "SELECT doc_id, chunk_id, length(text) AS n_chars, content_len, regexp_matches(text, '^#{1,6}\\s') AS opens_section FROM coded")
def chunk_lines(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select("doc_id", "chunk_id", F.length("text").cast("long").alias("n_chars"), "content_len", chunking.is_heading(F.col("text")).alias("opens_section"))


#: The documents have no bullets, clause ends, list items, rows or headings at the start of a line at this size, so
#: sentences and packing are what the SQL repeats.
@query(
    """
WITH split AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
shape AS (SELECT *, len(l) AS n, list_sum(list_transform(l, lambda x: length(x))) AS s, list_sum(list_transform(l, lambda x: length(x) * length(x))) AS q FROM split WHERE len(l) > 0),
parts AS (SELECT doc_id, CASE WHEN s > n * 250 OR n * q - s * s <= 4 * n * n OR 100 * (n * q - s * s) <= s * s
  THEN list_transform(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S')), lambda x: regexp_replace(x, '^\\n+|\\n+$', '', 'g')) ELSE l END AS p FROM shape),
blocks AS (SELECT doc_id, unnest(p) AS block, unnest(range(len(p))) AS b FROM parts),
pieces AS (SELECT doc_id, b, string_split(regexp_replace(regexp_replace(block, '([!?])', '\\1' || chr(1), 'g'), '\\.(\\s|$)', '.' || chr(1) || '\\1', 'g'), chr(1)) AS ps FROM blocks),
packed AS (SELECT doc_id, b, list_reduce(list_transform(ps, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, x:
  CASE WHEN length(x.open) > 250 THEN {'done': list_concat(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, list_transform(range(0, length(x.open), 250), lambda i: substr(x.open, i + 1, 250))), 'open': ''}
       WHEN length(a.open) + length(x.open) > 250 THEN {'done': list_append(a.done, a.open), 'open': x.open}
       ELSE {'done': a.done, 'open': a.open || x.open} END, {'done': []::VARCHAR[], 'open': ''}) AS f FROM pieces),
flat AS (SELECT doc_id, b, CASE WHEN f.open = '' THEN f.done ELSE list_append(f.done, f.open) END AS c FROM packed),
every AS (SELECT doc_id, b, unnest(range(len(c))) AS k, unnest(c) AS chunk FROM flat)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, k) - 1 AS chunk_id, length(chunk) AS n_chars, length(regexp_replace(chunk, '\\s+', '', 'g')) AS content_len, md5(chunk) AS text_md5 FROM every
"""
)
def chunk_documents(spark, sf_dir):
    found = chunking.chunk(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length("text").cast("long").alias("n_chars"), F.col("content_len").cast("long").alias("content_len"), F.md5("text").alias("text_md5"))


@query()
def chunk_structures(spark, sf_dir):
    """Documents whose lines are made headings, items, rows, entries and clauses by their number; tests hold the chunks against a plain chunker."""
    marks = F.array(*map(F.lit, ["# ", "- ", "1. ", "| ", "\u2022 ", "", "(", "", "", ""]))
    kept = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(marks, (i % 10 + 1).cast("int")), F.regexp_replace(x, ", ", "; "), F.when(i % 10 == 7, F.lit(")")).when(i % 10 == 9, F.lit("\n")).otherwise(F.lit(""))))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("text")))
    return chunking.chunk(docs).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", "opens_section")


@query("SELECT doc_id, CAST(round_even((length(text) + length(lang)) / 1.6, 0) AS BIGINT) AS tokens, length(regexp_replace(text, '\\s+', '', 'g')) AS content FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text"), F.col("lang")).alias("tokens"), text.content_len(F.col("text")).cast("long").alias("content"))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(text, '[*_`#]', '', 'g'), '\\s+', '', 'g') AS copy_form, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one_spaced FROM documents"
)
def normal_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.copy_form(F.col("text")).alias("copy_form"), text.one_spaced(F.col("text")).alias("one_spaced"))


@query("SELECT p_partkey, '#' || substr(sha1(p_name), 1, 8) AS provenance, trim(split_part(p_type, ' ', 1)) AS label FROM part")
def prompt_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    labelled = F.replace(F.col("p_type"), F.lit(" "), F.lit(": "))
    return rows.select("p_partkey", text.provenance(F.col("p_name")).alias("provenance"), text.heading_label(labelled).alias("label"))


# --- intervals


@query(LINES_SQL + 'SELECT doc_id, code, start, "end" FROM runs')
def segment_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("doc_id", "code", "start", "end")


@query(LINES_SQL + 'SELECT doc_id, code, unnest(range(start, "end" + 1)) AS chunk_id FROM runs')
def expanded_segments(spark, sf_dir):
    return intervals.expand(runs(spark, sf_dir)).select("doc_id", "code", "chunk_id")


@query(
    LINES_SQL
    + """, m AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY doc_id ORDER BY chunk_id) = code THEN 0 ELSE 1 END AS fresh FROM coded),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS run FROM m)
SELECT doc_id, min(chunk_id) AS start, max(chunk_id) AS "end", first(code) AS value, count(*) AS n FROM r GROUP BY doc_id, run"""
)
def merged_neighbours(spark, sf_dir):
    return intervals.merged_neighbours(lines(spark, sf_dir), F.col("code"), ["doc_id"]).select("doc_id", "start", "end", "value", "n")


@query(
    LINES_SQL
    + """, cover AS (SELECT DISTINCT doc_id, unnest(range(start, "end" + 1)) AS chunk_id FROM spans),
open AS (SELECT c.doc_id, c.chunk_id FROM coded c ANTI JOIN cover v ON c.doc_id = v.doc_id AND c.chunk_id = v.chunk_id),
i AS (SELECT *, chunk_id - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS g FROM open)
SELECT doc_id, min(chunk_id) AS hole_start, max(chunk_id) AS hole_end FROM i GROUP BY doc_id, g"""
)
def coverage_holes(spark, sf_dir):
    return intervals.holes(spans(spark, sf_dir), sizes(spark, sf_dir))


@query(
    LINES_SQL
    + """, w AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
SELECT doc_id, start, "end", reach FROM w WHERE start <= reach"""
)
def overlapping_segments(spark, sf_dir):
    return intervals.overlaps(spans(spark, sf_dir)).select("doc_id", "start", "end", "reach")


@query(
    LINES_SQL
    + """, hosts AS (SELECT doc_id, code, start // 3 AS item, start, "end" FROM runs)
SELECT s.doc_id, s.start, s."end" FROM spans s WHERE EXISTS (SELECT 1 FROM hosts h WHERE h.doc_id = s.doc_id AND h.code = 'a' AND h.item = s.start // 3 AND h.start <= s.start AND s."end" <= h."end")"""
)
def hosted_chains(spark, sf_dir):
    third = F.floor(F.col("start") / 3).cast("long")
    chains = spans(spark, sf_dir).withColumns({"parent_code": F.lit("a"), "parent": third})
    return intervals.hosted(chains, runs(spark, sf_dir).withColumn("item", third)).select("doc_id", "start", "end")


@query(
    LINES_SQL
    + """, anchors AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS n FROM coded WHERE length(text) % 5 = 0)
SELECT c.doc_id, c.chunk_id, a.n AS item FROM coded c ASOF LEFT JOIN anchors a ON c.doc_id = a.doc_id AND c.chunk_id >= a.chunk_id"""
)
def anchored_chunks(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return intervals.latest_anchor(rows, rows.where(F.length("text") % 5 == 0)).select("doc_id", "chunk_id", "item")


@query(
    LINES_SQL
    + """, b AS (SELECT doc_id, start, "end", unnest(range(0, 3)) AS block, ("end" - start + 1) AS span FROM runs WHERE "end" - start >= 2)
SELECT doc_id, start + span * block // 3 AS block_start, start + span * (block + 1) // 3 - 1 AS block_end, 7 * block // 3 AS item_lo, 7 * (block + 1) // 3 - 1 AS item_hi FROM b"""
)
def even_blocks(spark, sf_dir):
    wide = runs(spark, sf_dir).where("end - start >= 2").withColumn("items", F.lit(7).cast("long"))
    return intervals.even_blocks(wide, F.lit(3).cast("long")).drop("block")


@query(LINES_SQL + "SELECT doc_id, code, min(start) AS first_start FROM runs GROUP BY ALL")
def first_claims(spark, sf_dir):
    return intervals.first_claim(runs(spark, sf_dir), ["code"]).select("doc_id", "code", "first_start")


# --- budgets

ASSIGNED_SQL = LINES_SQL + ", assigned AS (SELECT doc_id, code AS unit, chunk_id // 3 AS item, chunk_id FROM coded UNION ALL SELECT doc_id, code, chunk_id // 3 + 1, chunk_id FROM coded WHERE chunk_id % 2 = 0), material AS (SELECT a.doc_id, a.unit, a.item, sum(c.content_len / a.k) AS material FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, unit, chunk_id) AS k FROM assigned) a JOIN coded c USING (doc_id, chunk_id) GROUP BY ALL)"


def assigned(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    third = F.floor(F.col("chunk_id") / 3).cast("long")
    own = rows.select("doc_id", F.col("code").alias("unit"), third.alias("item"), "chunk_id")
    return own.unionByName(rows.where("chunk_id % 2 = 0").select("doc_id", F.col("code").alias("unit"), (third + 1).alias("item"), "chunk_id"))


@query(ASSIGNED_SQL + "SELECT doc_id, unit, item, CAST(round(material * 2) AS BIGINT) AS halves FROM material")
def routed_material(spark, sf_dir):
    found = budgets.material(assigned(spark, sf_dir), lines(spark, sf_dir))
    return found.select("doc_id", "unit", "item", F.round(F.col("material") * 2).cast("long").alias("halves"))


@query(ASSIGNED_SQL + ", m AS (SELECT doc_id, unit, item, CAST(round(material * 2) AS BIGINT) AS halves FROM material) SELECT * FROM m UNION ALL SELECT doc_id, 'z', item, halves FROM m WHERE unit = 'a'")
def mirrored_units(spark, sf_dir):
    found = routed_material(spark, sf_dir)
    derived = found.select("doc_id").distinct().withColumns({"unit": F.lit("z"), "source": F.lit("a")})
    return budgets.mirrored(found, derived).select("doc_id", "unit", "item", "halves")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ratio' WHEN 1 THEN 'kw' WHEN 2 THEN 'abs' END AS kind,
CASE p_partkey % 4 WHEN 0 THEN CAST(round_even(p_size * p_partkey / 100.0, 0) AS BIGINT) WHEN 1 THEN p_size * (p_partkey % 7 + 1) WHEN 2 THEN p_size END AS chars FROM part"""
)
def budget_forms(spark, sf_dir):
    size = F.col("p_size").cast("string")
    token = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit("%"))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit("x"), (F.col("p_partkey") % 7 + 1).cast("string"))).when(F.col("p_partkey") % 4 == 2, size).otherwise(F.concat(size, F.lit("?")))
    rows = table(spark, sf_dir, "part").select("p_partkey", budgets.parsed(token).alias("b"))
    return rows.select("p_partkey", F.col("b.kind").alias("kind"), budgets.chars(F.col("b"), F.col("p_partkey")).alias("chars"))


@query(
    """WITH r AS (SELECT o_custkey AS doc_id, 'p' || (o_orderkey % 3) AS path, max(o_orderkey) AS b FROM orders GROUP BY ALL)
SELECT doc_id, path, b + CASE WHEN b % 5 = 0 THEN 2 WHEN b % 2 = 0 THEN 1 ELSE 0 END AS first_budget FROM r"""
)
def budget_precedence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("path")).agg(F.max("o_orderkey").alias("b"))
    made = lambda part, add: part.select("doc_id", "path", F.array(F.col("b") + add).alias("budgets"))
    found = budgets.precedence(made(rows, 0), made(rows.where("b % 2 = 0"), 1), made(rows.where("b % 5 = 0"), 2))
    return found.select("doc_id", "path", F.get("budgets", F.lit(0)).alias("first_budget"))


@query(
    ASSIGNED_SQL
    + """, m AS (SELECT * FROM material WHERE unit = 'a' AND item % 3 <> 1), e AS (SELECT doc_id, unnest(range(max(item) + 1)) AS item FROM m GROUP BY doc_id),
f AS (SELECT e.doc_id, e.item, coalesce(last_value(m.material IGNORE NULLS) OVER (PARTITION BY e.doc_id ORDER BY e.item), 0) AS cost FROM e LEFT JOIN m ON m.doc_id = e.doc_id AND m.item = e.item)
SELECT doc_id, 'a' AS path, count(*) AS n, CAST(sum(round_even(cost, 0)) AS BIGINT) AS total FROM f GROUP BY doc_id"""
)
def copy_budgets(spark, sf_dir):
    found = budgets.material(assigned(spark, sf_dir), lines(spark, sf_dir)).where("unit <> 'a' or item % 3 <> 1")
    listed = copies.copy_budgets(found, ["a"])
    return listed.select("doc_id", "path", F.size("budgets").cast("long").alias("n"), F.aggregate("budgets", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# --- the routing map

SCHEMA = {
    "type": "object",
    "description": "A record",
    "properties": {
        "basic": {"type": ["object", "null"], "description": "Basics", "properties": {"name": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}},
        "jobs": {"type": "array", "description": "Jobs", "items": {"type": "object", "properties": {"company": {"type": "string"}, "roles": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}}}}}}},
        "created": {"type": "string", "format": "date"},
    },
}


@query("SELECT * FROM (VALUES ('a', 'basic', 'object', NULL, 'basic'), ('b', 'basic.tags', 'array', NULL, 'tags'), ('c', 'jobs', 'array', NULL, 'jobs'), ('d', 'jobs.roles', 'array', 'c', 'roles'), ('e', '$misc', 'scalar', NULL, '$misc')) AS t(code, path, kind, parent_code, field)")
def schema_units(spark, sf_dir):
    return units_table(spark, decompose(SCHEMA)).select("code", "path", "kind", "parent_code", "field")


def map_texts(spark, sf_dir) -> DataFrame:
    """A map a document: runs of its lines as lines of the map, with items for ``b`` and ``c``."""
    rows = runs(spark, sf_dir).withColumn("n", F.row_number().over(route_map.Window.partitionBy("doc_id", "code").orderBy("start")) - 1)
    dest = F.when(F.col("code").isin("a", "-"), F.col("code")).otherwise(F.concat_ws(".", "code", F.col("n").cast("string")))
    line = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" "), dest)
    counts = F.transform(F.array(F.lit("b"), F.lit("c")), lambda c: F.concat(c, F.lit(": "), F.aggregate("all", F.lit(0), lambda a, x: a + F.when(x["code"] == c, 1).otherwise(0)).cast("string")))
    gathered = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "code", line.alias("line")))).alias("all"))
    return gathered.select("doc_id", F.array_join(F.concat(F.transform("all", lambda x: x["line"]), counts), "\n").alias("text"))


@query(LINES_SQL + "SELECT doc_id, start, \"end\", code, CASE WHEN code IN ('b', 'c') THEN row_number() OVER (PARTITION BY doc_id, code ORDER BY start) - 1 END AS item FROM runs")
def parsed_maps(spark, sf_dir):
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.destinations(route_map.lines_of(map_texts(spark, sf_dir)), units).where("error is null")
    return found.select("doc_id", "start", "end", "code", F.col("item_lo").alias("item"))


@query(LINES_SQL + ", c AS (SELECT DISTINCT doc_id FROM coded) SELECT c.doc_id, k.code, count(r.code) AS n FROM c JOIN (VALUES ('b'), ('c')) AS k(code) ON true LEFT JOIN runs r ON r.doc_id = c.doc_id AND r.code = k.code GROUP BY ALL")
def map_declarations(spark, sf_dir):
    units = units_table(spark, decompose(SCHEMA))
    return route_map.declarations(route_map.lines_of(map_texts(spark, sf_dir)), units).select("doc_id", "code", "n")


#: A broken map for each of the thirteen rules, over ``s`` chunks, and what is wrong with it.
BROKEN = [
    ("0-{s3} a\n{s2} c.0\n{s1} -\nc: 1\nhello", [("unread", "hello")]),
    ("b: 0\n0-{s3} a\n{s2} c.0\n{s1} -\nc: 1", [("declared before the map", "b")]),
    ("0-{s3} a\n{s2} c.0\n{s1} q\nc: 1", [("destination", "no such unit: q"), ("not covered", "{s1} {s1}")]),
    ("0-{s3} a\n0-1 a\n{s2} c.0\n{s1} -\nc: 1", [("overlap", "0 {s3}")]),
    ("0-{s3} a\n{s2} c.0\n{s1}-{s} -\nc: 1", [("beyond the text", "{s1} {s}")]),
    ("0-{s3} a\n{s2} c.0\nc: 1", [("not covered", "{s1} {s1}")]),
    ("0-{s3} a\n{s2} c.0\n{s1} -", [("not declared", "c")]),
    ("0-{s3} a\n{s2} c.0\n{s1} -\nc: 2", [("items differ from the count", "c 2")]),
    ("0-{s3} a\n{s2} c.0\n{s1} c.3.d.0\nc: 1\nc.3.d: 1", [("parent without a line", "c 3")]),
    ("0-{s3} a\n{s2} c.0\n{s1} -\nc: 1\nb = d", [("source is not mapped", "b d")]),
    ("0-{s3} a\n{s2} c.0\n{s1} -\nc = a", [("mirrors and is mapped", "c a")]),
    ("0-{s3} a\n{s2} c.0\n{s1} -\nc: 1\ne: 1", [("declared and not mapped", "e")]),
    ("0-{s3} a\n{s2} c.0-2\n{s1} c.2-3\nc: 4", [("in two ranges", "c 2")]),
]


def _said(text_: str) -> str:
    """A text over ``s`` as SQL."""
    out = "'" + text_.replace("\n", "' || chr(10) || '") + "'"
    for name, less in (("{s3}", " - 3"), ("{s2}", " - 2"), ("{s1}", " - 1"), ("{s}", "")):
        out = out.replace(name, f"' || (s{less}) || '")
    return out


BROKEN_SQL = "WITH d AS (SELECT doc_id, 10 + doc_id % 5 AS s FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, {_said(detail)} AS detail FROM d WHERE doc_id % {len(BROKEN)} = {n}" for n, (_, wrong) in enumerate(BROKEN) for rule, detail in wrong)


@query(BROKEN_SQL)
def map_errors(spark, sf_dir):
    """Each document has a map that breaks one of the thirteen rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 + 10).alias("s"))
    said = F.element_at(F.array(*(F.lit(shown) for shown, _ in BROKEN)), (F.col("doc_id") % len(BROKEN) + 1).cast("int"))
    for name, less in (("{s3}", 3), ("{s2}", 2), ("{s1}", 1), ("{s}", 0)):
        said = F.replace(said, F.lit(name), (F.col("s") - less).cast("string"))
    found = route_map.lines_of(docs.select("doc_id", said.alias("text")))
    return route_map.errors(found, units_table(spark, decompose(SCHEMA)), docs.select("doc_id", F.col("s").alias("size")))


@query(LINES_SQL + "SELECT doc_id, 'not covered' AS rule, start || ' ' || \"end\" AS detail FROM runs WHERE code = '-' UNION ALL SELECT doc_id, 'declared before the map', k.code FROM (SELECT doc_id FROM runs GROUP BY doc_id HAVING count(*) FILTER (code <> '-') = 0) JOIN (VALUES ('b'), ('c')) AS k(code) ON true")
def map_holes(spark, sf_dir):
    """Maps of whole documents without their lines for no unit: what they leave uncovered, or counts without a map."""
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.lines_of(map_texts(spark, sf_dir)).where(~F.col("line").endswith(" -"))
    return route_map.errors(found, units, sizes(spark, sf_dir))


@query(LINES_SQL + "SELECT doc_id, string_agg(CASE WHEN start = \"end\" THEN start || '' ELSE start || '-' || \"end\" END || ' ' || CASE WHEN code IN ('b', 'c') THEN code || '.' || n ELSE code END, chr(10) ORDER BY start) || chr(10) || 'b: ' || count(*) FILTER (code = 'b') || chr(10) || 'c: ' || count(*) FILTER (code = 'c') AS map_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY start) - 1 AS n FROM runs) GROUP BY doc_id")
def rendered_maps(spark, sf_dir):
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.lines_of(map_texts(spark, sf_dir))
    shown = route_map.rendered(route_map.destinations(found, units), route_map.declarations(found, units))
    return shown.select("doc_id", F.col("text").alias("map_lines"))


CHANGES_SQL = "WITH ch AS (SELECT conv_id AS doc_id, turn AS line_no, CASE WHEN length(text) % 2 = 0 THEN '+' ELSE '-' END AS sign, role || length(text) % 3 AS line FROM conversations)"


def changes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.when(F.length("text") % 2 == 0, "+").otherwise("-").alias("sign"), F.concat("role", (F.length("text") % 3).cast("string")).alias("line"))


@query(CHANGES_SQL + " SELECT doc_id, line, CASE WHEN d > 0 THEN '+' ELSE '-' END AS sign, abs(d) AS copies FROM (SELECT doc_id, line, CAST(sum(CASE sign WHEN '+' THEN 1 ELSE -1 END) AS BIGINT) AS d FROM ch GROUP BY ALL) WHERE d <> 0")
def net_edits(spark, sf_dir):
    return route_map.net_edits(changes(spark, sf_dir)).groupBy("doc_id", "line", "sign").agg(F.count("*").alias("copies"))


@query(
    CHANGES_SQL
    + """, base AS (SELECT conv_id AS doc_id, turn AS line_no, role || length(text) % 2 AS line FROM conversations),
kept AS (SELECT doc_id, line_no, line, 0 AS new FROM base b WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.doc_id = b.doc_id AND ch.line = b.line AND sign = '-')),
more AS (SELECT doc_id, min(line_no) AS line_no, line, 1 AS new FROM ch WHERE sign = '+' GROUP BY doc_id, line), every AS (SELECT * FROM kept UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = m.doc_id AND k.line = m.line))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY new, line_no) - 1 AS line_no, line FROM every"""
)
def applied_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    base = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.concat("role", (F.length("text") % 2).cast("string")).alias("line"))
    return route_map.applied(base, changes(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(LINES_SQL + "SELECT doc_id, code, 1 AS n, \"end\" - start + 1 AS span, CASE WHEN \"end\" - start >= 7 THEN \"end\" - start + 1 END AS merged FROM runs WHERE code IN ('b', 'c') AND \"end\" > start AND (SELECT count(*) FROM runs r WHERE r.doc_id = runs.doc_id AND r.code = runs.code) = 1")
def shared_runs(spark, sf_dir):
    """Units whose only instance has a run of several chunks."""
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.lines_of(map_texts(spark, sf_dir))
    return hints.shared_runs(route_map.destinations(found, units), route_map.declarations(found, units)).select("doc_id", "code", F.col("n").cast("int").alias("n"), "span", "merged")


# --- recounts and verdicts


@query(
    LINES_SQL
    + """, l AS (SELECT doc_id, chunk_id, text, CASE WHEN length(text) % 6 = 0 THEN 'h' || chunk_id END AS own FROM coded), f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS label FROM l)
SELECT doc_id, label, 'n:' || chunk_id || ':' || length(text) AS line FROM f WHERE own IS NULL AND label IS NOT NULL"""
)
def reply_sections(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "chunk_id", "text").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", F.concat_ws(":", F.lit("n"), F.col("chunk_id").cast("string"), F.length("text").cast("string")).alias("t")))).alias("r"))
    replies = rows.select("doc_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text"))
    parts = F.split("line", ":")
    label = F.when(F.get(parts, F.lit(2)).cast("int") % 6 == 0, F.concat(F.lit("h"), F.get(parts, F.lit(1))))
    return recounts.sections(replies, label).select("doc_id", "label", "line")


@query("SELECT * FROM (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, o AS opening FROM (SELECT conv_id, turn, substr(CASE WHEN length(text) > length(role) THEN text ELSE role END, 1, 80) AS o FROM conversations) WHERE o <> '') WHERE n < 120")
def item_openings(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.array("role", "text").alias("strings"))
    found = verdicts.openings(items)
    return found.select("doc_id", F.posexplode("openings").alias("n", "opening")).withColumn("n", F.col("n").cast("long"))


@query()
def quote_anchors(spark, sf_dir):
    """Every second line of every document sought among all its lines; tests hold it against brute force."""
    rows = lines(spark, sf_dir)
    quotes = rows.where("chunk_id % 2 = 1").select("doc_id", F.floor(F.col("chunk_id") / 2).cast("int").alias("quote_no"), F.col("text").alias("quote"))
    return recounts.anchors(quotes, rows).select("doc_id", "quote_no", "chunk_id")


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars % 7 + 1 - CASE WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END END AS revised FROM documents")
def arbitration(spark, sf_dir):
    """Replies that quote the document's first words as missing, with an invented extra, or no sections."""
    docs = table(spark, sf_dir, "documents")
    first = F.array_join(F.slice(F.split(text.one_spaced(F.col("text")), " "), 1, 3), " ")
    extra = F.lit("@@ no such entry")
    reply = F.when(F.col("n_chars") % 3 == 0, "nothing").when(F.col("n_chars") % 3 == 1, F.concat(F.lit("missing:\n- "), first, F.lit("\nextra:\n- "), extra)).otherwise(F.concat(F.lit("Missing:\n"), first, F.lit("\nExtra:")))
    listed = docs.select("doc_id", F.array(extra).alias("openings"))
    found = verdicts.verdicts(docs.select("doc_id", reply.alias("text")), docs, listed)
    return verdicts.revised(docs.select("doc_id", (F.col("n_chars") % 7).alias("actual")), found).select("doc_id", F.col("revised").cast("long").alias("revised"))


# --- calls, values, corrections


@query(
    """WITH RECURSIVE items AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN NULL ELSE length(text) % 160 END AS b FROM conversations),
walk AS (SELECT conv_id, turn, 0 AS batch, CASE WHEN b IS NULL OR b > 300 THEN NULL ELSE b END AS total FROM items WHERE turn = 0
UNION ALL SELECT i.conv_id, i.turn, w.batch + CASE WHEN i.b IS NULL OR i.b > 300 OR w.total IS NULL OR w.total + i.b > 300 THEN 1 ELSE 0 END,
 CASE WHEN i.b IS NULL OR i.b > 300 THEN NULL WHEN w.total IS NULL OR w.total + i.b > 300 THEN i.b ELSE w.total + i.b END FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.turn = w.turn + 1)
SELECT conv_id AS doc_id, min(turn) AS first_item, count(*) AS n FROM walk GROUP BY conv_id, batch"""
)
def call_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("item"), F.when(F.col("turn") % 7 == 6, F.lit(None)).otherwise(F.length("text") % 160).cast("long").alias("budget")).alias("x"))
    items = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list("x")).alias("items"))
    found = items.select("doc_id", F.explode(execution.batches(F.col("items"))).alias("b"))
    return found.select("doc_id", F.array_min("b").alias("first_item"), F.size("b").cast("long").alias("n"))


def call_groups(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    item = F.when(F.col("code").isin("b", "c"), F.col("chunk_id"))
    placed = rows.where("code <> '-'").select("doc_id", F.col("code").alias("unit"), F.lit(None).cast("long").alias("parent"), item.alias("item"), "chunk_id")
    return execution.groups(placed, rows)


@query(LINES_SQL + ", g AS (SELECT doc_id, code AS unit, start, \"end\" FROM runs WHERE code = 'a' UNION ALL SELECT doc_id, code, chunk_id, chunk_id FROM coded WHERE code IN ('b', 'c')) SELECT doc_id, unit, CASE WHEN unit = 'a' OR count(*) = 1 THEN 'whole' ELSE 'per-item' END AS strategy FROM g GROUP BY doc_id, unit")
def call_strategies(spark, sf_dir):
    return execution.strategies(call_groups(spark, sf_dir)).select("doc_id", "unit", "strategy")


@query(
    LINES_SQL
    + """, s AS (SELECT doc_id, code, chunk_id, text, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY doc_id, code) AS k FROM coded WHERE code IN ('b', 'c') WINDOW w AS (PARTITION BY doc_id, code ORDER BY chunk_id)),
g AS (SELECT r.doc_id, r.start, count(*) AS n, string_agg(c.text, chr(10) ORDER BY chunk_id) AS t FROM runs r JOIN coded c ON c.doc_id = r.doc_id AND c.chunk_id BETWEEN r.start AND r."end" WHERE r.code = 'a' GROUP BY ALL)
SELECT doc_id, code AS unit, CASE WHEN k = 1 THEN 'whole' ELSE 'per-item' END AS strategy, CASE WHEN k > 1 AND count(*) = 1 THEN min(chunk_id) END AS item, min(chunk_id) AS first_chunk, count(*) AS chunks, CASE WHEN k = 1 THEN 1 ELSE count(*) END AS budgets, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id)) AS scope_md5 FROM s GROUP BY doc_id, code, k, r // 3
UNION ALL SELECT doc_id, 'a', 'whole', NULL, min(start), CAST(sum(n) AS BIGINT), 1, md5(string_agg(t, chr(10) || chr(10) ORDER BY start)) FROM g GROUP BY doc_id"""
)
def planned_calls(spark, sf_dir):
    """Calls of all documents with a budget of 100 an item, so that three items share a call."""
    # Written, as an extraction does: the plan reads groups several times.
    groups = kept(call_groups(spark, sf_dir), "groups")
    told = groups.select("doc_id", "unit").distinct().withColumn("budgets", F.array(F.lit(100).cast("long")))
    calls = execution.plan_calls(groups, told)
    return calls.select("doc_id", "unit", "strategy", "item", F.get("chunk_ids", F.lit(0)).alias("first_chunk"), F.size("chunk_ids").cast("long").alias("chunks"), F.size("budget").cast("long").alias("budgets"), F.md5("scope").alias("scope_md5"))


@query("SELECT conv_id AS doc_id, 'jobs' AS path, '[' || string_agg(to_json(text), ',' ORDER BY turn) || ']' AS value FROM conversations GROUP BY conv_id")
def call_values(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("call_seq"), F.to_json(F.array("text")).alias("j"), F.lit("jobs").alias("unit"), F.lit(None).cast("long").alias("parent"), F.lit("per-item").alias("strategy"), F.lit(None).cast("array<bigint>").alias("batch"))
    replies = rows.select("doc_id", "call_seq", F.expr("substring(j, 2, length(j) - 2)").alias("data"))
    return execution.values(rows.drop("j"), replies).select("doc_id", "path", "value")


@query("SELECT conv_id AS doc_id, '{\"career\":{\"jobs\":[' || string_agg('{\"role\":' || to_json(role) || ',\"turn\":' || turn || '}', ',' ORDER BY turn) || ']},\"n\":' || count(*) || '}' AS data FROM conversations GROUP BY conv_id")
def merged_documents(spark, sf_dir):
    """Roles as one value, turn numbers grafted item by item, a count as a top-level scalar."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    jobs = whole.select("doc_id", F.lit("career.jobs").alias("path"), F.lit(0).cast("long").alias("value_seq"), F.to_json(F.transform("r", lambda x: F.struct(x["role"].alias("role")))).alias("value"))
    graft = rows.select("doc_id", F.concat(F.lit("career.jobs["), F.col("turn").cast("string"), F.lit("].turn")).alias("path"), (F.col("turn") + 1).alias("value_seq"), F.col("turn").cast("string").alias("value"))
    count = whole.select("doc_id", F.lit("$misc").alias("path"), F.lit(1 << 40).alias("value_seq"), F.to_json(F.struct(F.size("r").alias("n"))).alias("value"))
    return execution.documents_of(jobs.unionByName(graft).unionByName(count))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS none FROM events")
def json_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", json_values.at(F.col("props"), "k", "bigint").alias("k"), json_values.at(F.col("props"), "k.b[0].c").alias("none"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{\"a\":[1,2' || CASE WHEN event_id % 3 = 0 THEN ',3' ELSE '' END || '],\"k\":' || event_id || '}' END AS value, event_id % 3 = 2 AS failed FROM events")
def patched_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    put = F.concat(F.lit('{"op":"replace","path":"/unit/k","value":'), number, F.lit("}"))
    add = F.lit('{"op":"add","path":"/a","value":[1,2]}')
    more = F.when(F.col("event_id") % 3 == 0, F.lit(',{"op":"add","path":"/a/-","value":3}')).when(F.col("event_id") % 3 == 2, F.lit(',{"op":"remove","path":"/none"}')).otherwise("")
    found = rows.select("event_id", json_values.apply_patch("props", F.concat(F.lit("["), put, F.lit(","), add, more, F.lit("]")), F.lit("unit")).alias("p"))
    return found.select("event_id", F.col("p.value").alias("value"), F.col("p.error").isNotNull().alias("failed"))


@query(
    """WITH s AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 AS declared, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT doc_id, 'items[' || i || ']' AS path, declared AS expected, actual AS got, false AS report_only FROM (SELECT *, unnest(range(actual, declared)) AS i FROM s)
UNION ALL SELECT doc_id, 'items', declared, actual, doc_id % 2 = 0 FROM s WHERE actual > declared"""
)
def count_issues(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("items").alias("path"), (F.col("o_orderkey") % 7).alias("declared"))
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("actual")).withColumn("path", F.lit("items"))
    found = corrections.count_issues(orders, actual, orders.where("doc_id % 2 = 0"))
    return found.select("doc_id", "path", "expected", "got", "report_only")


@query("SELECT conv_id AS doc_id, 'jobs[' || turn || '].' || role AS path, CASE WHEN turn % 3 = 0 THEN turn ELSE 1000 END AS call_seq FROM conversations")
def issue_owners(spark, sf_dir):
    """Every third turn has a call of its own; other turns' issues fall to the scalars' call."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role")
    none = F.lit(None).cast("long")
    own = rows.where("turn % 3 = 0").select("doc_id", F.col("turn").alias("call_seq"), F.lit("jobs").alias("unit"), none.alias("parent"), F.col("turn").alias("item"), F.lit(None).cast("array<bigint>").alias("batch"))
    misc = rows.select("doc_id").distinct().select("doc_id", F.lit(1000).cast("long").alias("call_seq"), F.lit("$misc").alias("unit"), none.alias("parent"), none.alias("item"), F.lit(None).cast("array<bigint>").alias("batch"))
    issues = rows.select("doc_id", F.concat(F.lit("jobs["), F.col("turn").cast("string"), F.lit("]."), F.col("role")).alias("path"))
    return corrections.owners(issues, own.unionByName(misc)).select("doc_id", "path", "call_seq")


OWNED_SQL = """WITH t AS (SELECT conv_id AS doc_id, turn // 4 AS call_seq, count(*) AS slots FROM conversations GROUP BY ALL), m AS (SELECT *, greatest(slots + call_seq % 3 - 1, 0) AS made FROM t),
x AS (SELECT doc_id, sum(slots) AS expected, sum(made) AS got FROM m GROUP BY doc_id), p AS (SELECT doc_id, expected, got, unnest(CASE WHEN got < expected THEN list_transform(range(CAST(got AS BIGINT), CAST(expected AS BIGINT)), lambda i: 'jobs[' || i || ']') WHEN got > expected THEN ['jobs'] END) AS path FROM x)"""


@query(OWNED_SQL + " SELECT doc_id, path, call_seq FROM p JOIN m USING (doc_id) WHERE made > slots OR expected >= got AND made < slots")
def count_owners(spark, sf_dir):
    """Calls of four turns, of which some gave one entry too few and some one too many."""
    calls = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 4).cast("long").alias("call_seq")).agg(F.sort_array(F.collect_list("turn")).alias("batch"))
    none = F.lit(None).cast("long")
    calls = calls.select("doc_id", "call_seq", F.lit("jobs").alias("unit"), none.alias("parent"), F.lit("per-item").alias("strategy"), none.alias("item"), "batch")
    entries = F.slice(F.array_repeat(F.lit("{}"), 5), F.lit(1), F.greatest(F.size("batch") + (F.col("call_seq") % 3).cast("int") - 1, F.lit(0)))
    made = corrections.produced(calls, calls.select("doc_id", "call_seq", F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]")).alias("data")))
    declared = calls.groupBy("doc_id").agg(F.lit("jobs").alias("path"), F.sum(F.size("batch")).alias("declared"))
    actual = made.groupBy("doc_id").agg(F.lit("jobs").alias("path"), F.sum("got").alias("actual"))
    return corrections.count_owners(corrections.count_issues(declared, actual), calls, made)


@query(
    """WITH r AS (SELECT conv_id AS doc_id, turn, role || length(text) % 2 AS e, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, e ORDER BY turn) AS again FROM r)
SELECT doc_id, 'jobs' AS path, '[' || string_agg('"' || e || '"', ',' ORDER BY turn) || ']' AS value FROM f WHERE doc_id % 2 = 0 OR again = 1 GROUP BY doc_id"""
)
def ranged_values(spark, sf_dir):
    """Ranged replies of every turn; the calls of odd conversations are for one item less, so exact repeats go."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", (F.length("text") % 2).cast("string")).alias("e")))).alias("r"))
    none = F.lit(None).cast("long")
    size = F.size("r") - (F.col("doc_id") % 2).cast("int")
    calls = rows.select("doc_id", none.alias("parent"), F.lit(0).cast("long").alias("call_seq"), F.lit("jobs").alias("unit"), F.lit("ranged").alias("strategy"), none.alias("item"), F.transform(F.slice("r", F.lit(1), size), lambda x: x["turn"]).alias("batch"))
    replies = rows.select("doc_id", F.lit(0).cast("long").alias("call_seq"), F.to_json(F.transform("r", lambda x: x["e"])).alias("data"))
    return execution.values(calls, replies).select("doc_id", "path", "value")


@query("SELECT doc_id, CAST(greatest(n_chars % 6, least(n_chars % 6 + 2, 3)) AS BIGINT) AS n, CAST(least(greatest(3 - n_chars % 6, 0), 2) AS BIGINT) AS rounds, CAST(CASE WHEN n_chars % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS open FROM documents WHERE n_chars IS NOT NULL")
def repair_rounds(spark, sf_dir):
    """A value for each document that is to be 3 at least and is patched by one a round, over the two rounds that there are."""
    docs = spread(table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", "n_chars"))
    none = F.lit(None).cast("long")
    calls = docs.select("doc_id", F.lit(0).cast("long").alias("call_seq"), F.lit("basic").alias("unit"), none.alias("parent"), F.lit("whole").alias("strategy"), none.alias("item"), F.lit(None).cast("array<bigint>").alias("batch"))
    replies = docs.select("doc_id", F.lit(0).cast("long").alias("call_seq"), F.to_json(F.struct((F.col("n_chars") % 6).alias("n"))).alias("data"))
    number = F.get_json_object("data", "$.n").cast("long")

    def validate(state):
        low = state.where(number < 3)
        return corrections.issue_rows(low.select("doc_id", F.concat(F.lit("basic.n"), number.cast("string")).alias("path"), F.lit("is less than 3").alias("message")), 0)

    def ask(rows):
        patch = F.concat(F.lit('[{"op":"replace","path":"/n","value":'), (number + 1).cast("string"), F.lit("}]"))
        return rows.select("doc_id", "call_seq", patch.alias("reply"), F.lit(None).cast("string").alias("after"))

    state, issues, trace = corrections.correct(replies, calls, validate, ask)
    rounds = trace.groupBy("doc_id").agg(F.count("*").alias("rounds"))
    left = issues.groupBy("doc_id").agg(F.count("*").alias("open"))
    zero = F.lit(0).cast("long")
    return state.join(rounds, "doc_id", "left").join(left, "doc_id", "left").select("doc_id", number.alias("n"), F.coalesce("rounds", zero).alias("rounds"), F.coalesce("open", zero).alias("open"))


@query(
    """WITH w AS (SELECT doc_id, n_chars % 5 AS declared, n_chars % 3 AS how FROM documents WHERE n_chars IS NOT NULL AND regexp_matches(text, '\\S')),
c AS (SELECT doc_id, declared, CASE how WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 3 END AS revised FROM w WHERE declared <> 2)
SELECT w.doc_id, CAST(coalesce(revised, w.declared) AS BIGINT) AS declared, c.doc_id IS NOT NULL AND revised IS NULL AND w.declared < 2 AS disputed FROM w LEFT JOIN c USING (doc_id)"""
)
def arbitrated_counts(spark, sf_dir):
    """Lists of a document's beginning and an invented entry, declared with other counts; replies say what is missing, what is extra, or nothing of use."""
    docs = spread(table(spark, sf_dir, "documents").where("n_chars is not null").where(~text.is_blank(F.col("text"))))
    first = F.array_join(F.slice(F.split(text.one_spaced(F.col("text")), " "), 1, 3), " ")
    extra = F.lit("@@ no such entry")
    values = docs.select("doc_id", F.lit("jobs").alias("path"), F.to_json(F.array(F.struct(first.alias("a"), F.lit(1).alias("b")), F.struct(extra.alias("a"), F.lit(2).alias("b")))).alias("value"))
    counts = docs.select("doc_id", F.lit("jobs").alias("path"), (F.col("n_chars") % 5).alias("declared"))
    apart = counts.withColumn("actual", F.lit(2).cast("long")).where("declared <> actual")
    cases = verdicts.checks(apart, values, docs)
    reply = F.when(F.col("n_chars") % 3 == 0, "nothing of use").when(F.col("n_chars") % 3 == 1, F.concat(F.lit("missing:\n- "), first, F.lit("\nextra:\n"), extra)).otherwise(F.concat(F.lit("missing:\n"), first, F.lit("\nextra:")))
    checked = verdicts.arbitrated(cases, docs.select("doc_id", F.lit("jobs").alias("path"), reply.alias("text")))
    settled, disputed = verdicts.settled(counts, checked)
    return settled.join(disputed.withColumn("disputed", F.lit(True)), ["doc_id", "path"], "left").select("doc_id", "declared", F.coalesce("disputed", F.lit(False)).alias("disputed"))


# --- copies and audits


#: Lines of a few characters, whose first sixteen begin no other line, can be spoiled to just above and just below the ratio.
SPOILED_SQL = LINES_SQL + ", k AS (SELECT doc_id, chunk_id, regexp_replace(regexp_replace(text, '[*_`#]', '', 'g'), '\\s+', '', 'g') AS t FROM coded), n AS (SELECT *, length(t) BETWEEN 20 AND 100 AND (length(d.x) - length(replace(d.x, substr(k.t, 1, 16), ''))) = 16 AS short FROM k JOIN (SELECT doc_id AS i, regexp_replace(regexp_replace(text, '[*_`#]', '', 'g'), '\\s+', '', 'g') AS x FROM documents) d ON d.i = k.doc_id) "


def spoiled_lines(spark, sf_dir) -> DataFrame:
    """``doc_id, chunk_id, value``: lines under a heading, lines of marks that no document has, lines with some such marks, and plain copies with blanks and marks put in."""
    rows = lines(spark, sf_dir).withColumn("t", text.copy_form(F.col("text"))).join(spread(table(spark, sf_dir, "documents")).select("doc_id", text.copy_form(F.col("text")).alias("x")), "doc_id")
    short = F.length("t").between(20, 100) & (F.length("x") - F.length(F.replace("x", F.substr("t", F.lit(1), F.lit(16)), F.lit(""))) == 16)
    five, spoil = F.col("chunk_id") % 5, F.floor(F.length("t") / 9).cast("int")
    snow = lambda n: F.concat("text", F.repeat(F.lit("☃"), n))
    value = F.when(five == 0, F.concat(F.lit("Duties: "), "text")).when(five == 1, F.repeat(F.lit("☃"), F.lit(40))).when((five == 2) & short, snow(spoil)).when((five == 3) & short, snow(spoil + 1)).otherwise(F.concat(F.lit(" **"), F.regexp_replace("text", " ", "\n "), F.lit("**")))
    return rows.where("content_len > 0").select("doc_id", "chunk_id", value.alias("value"))


SPOILED_CASE = "CASE WHEN chunk_id % 5 = 0 THEN 'heading' WHEN chunk_id % 5 = 1 OR chunk_id % 5 = 3 AND short THEN 'verbatim' END"


@query(SPOILED_SQL + f"SELECT doc_id, 'v' || chunk_id AS path, {SPOILED_CASE} AS code FROM n WHERE {SPOILED_CASE} IS NOT NULL")
def copy_breaches(spark, sf_dir):
    """Lines as values; some of them just above and just below the ratio of 0.9."""
    rows = spoiled_lines(spark, sf_dir)
    values = rows.select("doc_id", F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("path"), "value", F.array(F.lit("Duties")).alias("labels"), F.lit(0.9).alias("ratio"))
    return copies.breaches(values, table(spark, sf_dir, "documents")).select("doc_id", "path", "code")


COPY_SCHEMA = {"type": "object", "properties": {"notes": {"type": "array", "items": {"type": "object", "properties": {"duty": {"type": "string", "description": "Duties: all of them", "x-verbatim": 0.9}}}}}}


@query(SPOILED_SQL + f"SELECT doc_id, 'notes[' || (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1) || '].duty' AS path, {SPOILED_CASE} AS code, false AS report_only FROM n QUALIFY code IS NOT NULL")
def verbatim_issues(spark, sf_dir):
    """The same lines as entries of each document's data, walked along a schema that marks them."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "value"))), lambda r: F.struct(r["value"].alias("duty")))
    data = spoiled_lines(spark, sf_dir).groupBy("doc_id").agg(F.to_json(F.struct(entries.alias("notes"))).alias("data"))
    values = copies.marked_values(data, marked_fields(COPY_SCHEMA))
    return copies.copy_issues(copies.breaches(values, table(spark, sf_dir, "documents"))).select("doc_id", "path", "code", "report_only")


@query("SELECT conv_id AS doc_id, role AS unit, count(*) AS n, max(length(text)) AS top FROM conversations GROUP BY ALL")
def item_budgets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    calls = rows.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("unit"), F.col("turn").alias("call_seq"), F.lit("per-item").alias("strategy"), F.col("turn").alias("item"), F.lit(None).cast("array<bigint>").alias("batch"), F.array(F.length("text")).alias("budget"))
    found = evals.per_item_budgets(calls)
    return found.select("doc_id", "unit", F.size("budgets").cast("long").alias("n"), F.array_max("budgets").cast("long").alias("top"))


@query("SELECT conv_id AS doc_id, CAST(sum(CASE WHEN turn % 4 = 3 THEN 2 ELSE 0 END) AS BIGINT) AS overlap, count(*) FILTER (turn % 4 = 3) AS lost, count(*) FILTER (turn % 4 = 3) = 0 AS passed FROM conversations GROUP BY conv_id HAVING count(*) > 0")
def routed_and_done(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("jobs").alias("unit"), F.col("turn").alias("item"), F.array(F.col("turn"), F.col("turn") + 1).alias("chunks"))
    calls = rows.where("item % 4 <> 3").withColumns({"strategy": F.lit("per-item"), "batch": F.lit(None).cast("array<bigint>")}).withColumnRenamed("chunks", "chunk_ids")
    return evals.overlap(rows, calls)


FIT_SQL = "WITH i AS (SELECT l_orderkey AS doc_id, l_returnflag AS unit, CAST(l_quantity AS BIGINT) * 4 AS budget, l_partkey % 240 AS chars, CASE WHEN l_linestatus = 'O' THEN 'kw' ELSE 'abs' END AS kind FROM lineitem), b AS (SELECT doc_id, unit, budget, chars FROM i WHERE kind <> 'kw' AND budget > 0 AND chars > 0 UNION ALL SELECT doc_id, unit, CAST(sum(budget) AS BIGINT), CAST(sum(chars) AS BIGINT) FROM i WHERE kind = 'kw' AND budget > 0 GROUP BY doc_id, unit)"


@query(FIT_SQL + " SELECT doc_id, unit, count(*) AS wild FROM b WHERE NOT (chars * 10 BETWEEN budget * 4 AND budget * 20 OR abs(chars - budget) <= 25) GROUP BY ALL")
def budget_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("unit"), (F.col("l_quantity").cast("long") * 4).alias("budget"), (F.col("l_partkey") % 240).alias("chars"), F.when(F.col("l_linestatus") == "O", "kw").otherwise("abs").alias("kind"))
    return evals.budget_fit(rows).where("wild > 0").select("doc_id", "unit", "wild")


# --- hints


@query(
    LINES_SQL
    + """, cover AS (SELECT DISTINCT doc_id, unnest(range(start, "end" + 1)) AS chunk_id FROM spans), open AS (SELECT c.doc_id, c.chunk_id FROM coded c ANTI JOIN cover v ON c.doc_id = v.doc_id AND c.chunk_id = v.chunk_id),
h AS (SELECT doc_id, min(chunk_id) AS hole_start, max(chunk_id) AS hole_end FROM (SELECT *, chunk_id - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS g FROM open) GROUP BY doc_id, g),
r AS (SELECT h.*, s.start, s."end", row_number() OVER (PARTITION BY h.doc_id, hole_start ORDER BY s."end" DESC, s.start DESC) AS k FROM h LEFT JOIN spans s ON s.doc_id = h.doc_id AND s."end" <= h.hole_start)
SELECT doc_id, hole_start, hole_end, start, "end" FROM r WHERE k = 1"""
)
def coverage_hints(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return hints.coverage_hints(intervals.holes(rows, sizes(spark, sf_dir)), rows)


@query(LINES_SQL + "SELECT DISTINCT doc_id, 'c' AS code, 1 AS n FROM coded WHERE doc_id NOT IN (SELECT doc_id FROM coded WHERE code = 'c')")
def undrawn_units(spark, sf_dir):
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.destinations(route_map.lines_of(map_texts(spark, sf_dir)), units)
    told = sizes(spark, sf_dir).select("doc_id", F.lit("c").alias("code"), F.lit(1).cast("int").alias("n"), F.lit(None).cast("string").alias("parent_code"))
    return hints.undrawn(told, found)


@query(
    """WITH h AS (SELECT conv_id AS doc_id, turn AS round, role AS rule, length(text) % 3 || '' AS detail FROM conversations), l AS (SELECT doc_id, max(round) AS last FROM h GROUP BY ALL),
t AS (SELECT h.doc_id, rule, detail FROM h JOIN l USING (doc_id) GROUP BY ALL HAVING max(CASE WHEN round = last THEN 1 ELSE 0 END) = 0)
SELECT DISTINCT doc_id, rule, detail FROM t WHERE detail <> '1'"""
)
def error_regressions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("round"), F.col("role").alias("rule"), (F.length("text") % 3).cast("string").alias("detail"))
    return hints.regressions(rows, rows.where("detail <> '1'")).distinct()


@query(
    LINES_SQL
    + """, m AS (SELECT doc_id, count(*) AS s, sum(content_len) AS m FROM coded GROUP BY doc_id), b AS (SELECT *, CAST(least(round_even(m / 300.0, 0), s - 1) AS BIGINT) AS blocks FROM m WHERE s >= 6 AND m >= 1000)
SELECT doc_id, 'b' AS code, 0 AS start, s - 1 AS "end", s - 1 AS items, blocks FROM b WHERE blocks >= 2"""
)
def block_plans(spark, sf_dir):
    """Documents that are one range of nearly as many instances as lines, cut by their material."""
    units = units_table(spark, decompose(SCHEMA))
    size = F.col("size").cast("string")
    said = F.concat(F.lit("0-"), (F.col("size") - 1).cast("string"), F.lit(" b.0-"), (F.col("size") - 2).cast("string"), F.lit("\nb: "), (F.col("size") - 1).cast("string"))
    found = route_map.lines_of(sizes(spark, sf_dir).where("size > 2").select("doc_id", said.alias("text"), size.alias("s")))
    dests, told = route_map.destinations(found, units), route_map.declarations(found, units)
    # A range of as many items as chunks has the square of them as assignments, and a plan needs the unit's material alone.
    material = budgets.unit_material(route_map.drawn_chunks(dests).withColumnRenamed("code", "unit"), lines(spark, sf_dir))
    none = material.select("doc_id", "unit", F.lit(0).cast("long").alias("chars")).where("false")
    return hints.block_plans(hints.shared_runs(dests, told), dests, material, none).select("doc_id", "code", "start", "end", "items", "blocks")


@query("SELECT conv_id AS doc_id, 'jobs[' || (turn) || ']' AS key, 20 + turn AS budget, length(text) AS chars, length(text) / (20.0 + turn) BETWEEN 0.4 AND 2.0 OR abs(length(text) - 20 - turn) <= 25 AS fits FROM conversations")
def value_fit(spark, sf_dir):
    """Turns as a list's entries, against a budget for each."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    data = rows.groupBy("doc_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda r: F.struct(r["text"].alias("t"))).alias("jobs"))).alias("data"))
    none = F.lit(None).cast("array<bigint>")
    calls = rows.select("doc_id", F.col("turn").alias("call_seq"), F.lit("jobs").alias("unit"), F.lit("per-item").alias("strategy"), F.col("turn").alias("item"), none.alias("batch"), F.array(F.col("turn") + 20).alias("budget"))
    return evals.value_fit(data, calls, ["jobs"])


@query(
    LINES_SQL
    + """, a AS (SELECT doc_id, chunk_id FROM coded WHERE code = 'b'), f AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS n FROM a WHERE chunk_id % 2 = 0)
SELECT a.doc_id, a.chunk_id, coalesce(f.n, 0) AS item FROM a ASOF LEFT JOIN f ON a.doc_id = f.doc_id AND a.chunk_id >= f.chunk_id"""
)
def resplit_units(spark, sf_dir):
    """A unit that one item holds, split at its even chunks."""
    rows = lines(spark, sf_dir).where("code = 'b'").select("doc_id", "code", F.lit(0).cast("long").alias("item"), F.lit(None).cast("string").alias("parent_code"), F.lit(None).cast("long").alias("parent"), "chunk_id")
    return recounts.resplit(rows, rows.where("chunk_id % 2 = 0"), "b").select("doc_id", "chunk_id", "item")
