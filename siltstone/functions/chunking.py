"""Text to chunks, in one column expression.

Lines are chunks where line breaks mean layout. Where they don't (lines longer than a chunk on average, or
all of about one length), the whole text is cut by structure, sentences and size; an overlong line is cut
the same way by itself. Every step is a higher-order function, so chunks of all documents are made inside
the JVM without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import BLANK, content_len, is_blank, normalize_newlines

MAX_CHARS = 250
#: Items that are folded at once.
GROUP = 256
#: Line classes and sentence ends.
HEADING = rf"^#{{1,6}}{BLANK}"
ITEM = rf"^{BLANK}*(?:[-*+]+{BLANK}+|•{BLANK}*|\p{{Nd}}+[、)]{BLANK}*|\p{{Nd}}+\.{BLANK}+)"
ROW = rf"^{BLANK}*\|"
ENTRY = rf"^{BLANK}*[\x80-\x9f•]"
CLAUSE = rf"[；;]{BLANK}*\z"
SENTENCE = rf"(?<=[。．！？；;!?])|(?<=\.)(?={BLANK}|$)"

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _folded(items: Column, name: str, start: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column]) -> Column:
    """An array of strings from a fold with a state of ``done`` strings and one more field.

    A fold's state is copied at every step, so one fold over a long text would copy it as often as it has pieces. Items
    are folded in groups from an empty ``done``, and groups into the whole.
    """

    def finished(a: Column) -> Column:
        return F.when(last(a[name]), a["done"]).otherwise(F.concat(a["done"], F.array(a[name])))

    def over(all_: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(all_) - 1) / GROUP), F.lit(0)).cast("int")), lambda i: F.slice(all_, i * GROUP + 1, F.lit(GROUP)))
        state = lambda done, open_: F.struct(done.alias("done"), open_.alias(name))
        return F.aggregate(groups, state(_none(), start), lambda a, g: F.aggregate(g, state(_none(), a[name]), step, lambda s: state(F.concat(a["done"], s["done"]), s[name])), finished)

    # The array is bound once, as the only element of an outer transform.
    return F.get(F.transform(F.array(items), over), F.lit(0))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def measures(lines: Column) -> Column:
    """Sum ``s`` and sum of squares ``q`` of the lines' lengths, in one pass."""
    zero = F.lit(0).cast("long")
    return F.aggregate(lines, F.struct(zero.alias("s"), zero.alias("q")), lambda a, x: F.struct((a["s"] + F.length(x)).alias("s"), (a["q"] + F.length(x).cast("long") * F.length(x)).alias("q")))


def breaks_meaningless(n: Column, m: Column, max_chars: int = MAX_CHARS) -> Column:
    """Whether line breaks carry no layout: the mean length of n lines is over the limit, or its spread is at most 2 or a tenth of it.

    In whole numbers, with v = n * (sum of squares) - (sum) * (sum).
    """
    v = n * m["q"] - m["s"] * m["s"]
    return (m["s"] > n * max_chars) | (v <= 4 * n * n) | (100 * v <= m["s"] * m["s"])


def blocks(text: Column) -> Column:
    """Paragraphs, and list items and table rows by themselves; a heading begins a paragraph.

    Blank lines are put where blocks end, and the text is cut at them: no state grows with the text.
    """

    def parted(line: Column) -> Column:
        alone = line.rlike(ITEM) | line.rlike(ROW)
        return F.when(is_heading(line), F.concat(F.lit("\n"), line)).when(is_blank(line), "").when(alone, F.concat(F.lit("\n"), line, F.lit("\n"))).otherwise(line)

    whole = F.concat(F.lit("\n\n"), F.array_join(F.transform(F.split(text, "\n", -1), parted), "\n"), F.lit("\n\n"))
    return F.filter(F.split(whole, "\n{2,}", -1), lambda block: block != "")


def _count(text: Column, marks: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{marks}]", ""))


def healed(pieces: Column) -> Column:
    """Pieces that a sentence end cut out of an open bracket are joined again."""

    def step(a: Column, piece: Column) -> Column:
        goes_on = a["last"].isNotNull() & ~piece.rlike(ENTRY) & (_count(a["last"], "(（") > _count(a["last"], ")）"))
        done = F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"])))
        return F.when(goes_on, F.struct(a["done"].alias("done"), F.concat(a["last"], piece).alias("last"))).otherwise(F.struct(done.alias("done"), piece.alias("last")))

    return _folded(pieces, "last", F.lit(None).cast("string"), step, lambda x: x.isNull())


def windows(piece: Column, max_chars: int) -> Column:
    count = F.greatest(F.floor((F.length(piece) - 1) / max_chars), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.substr(piece, i * max_chars + 1, F.lit(max_chars)))


def marked(pieces: Column) -> Column:
    """Pieces as ``(text, alone)``: two or more entries in a row stand alone."""
    entries = F.transform(pieces, lambda p: F.struct(p.alias("text"), (p.rlike(ENTRY) | p.rlike(CLAUSE)).alias("entry")))

    def in_run(x: Column, i: Column, all_: Column) -> Column:
        left = F.when(i > 0, F.get(all_, i - 1)["entry"]).otherwise(False)
        right = F.coalesce(F.get(all_, i + 1)["entry"], F.lit(False))
        return F.struct(x["text"].alias("text"), (x["entry"] & (left | right)).alias("alone"))

    # The array is bound once, as the only element of an outer transform.
    return F.flatten(F.transform(F.array(entries), lambda m: F.transform(m, lambda x, i: in_run(x, i, m))))


def packed(pieces: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pieces ``(text, alone)`` packed up to the limit; overlong pieces are cut."""

    def step(a: Column, x: Column) -> Column:
        piece = x["text"]
        closed = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return (
            F.when(x["alone"] | (F.length(piece) > max_chars), F.struct(F.concat(closed, windows(piece, max_chars)).alias("done"), F.lit("").alias("open")))
            .when(F.length(a["open"]) + F.length(piece) > max_chars, F.struct(closed.alias("done"), piece.alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], piece).alias("open")))
        )

    return _folded(pieces, "open", F.lit(""), step, lambda x: x == "")


def cut_block(block: Column, max_chars: int = MAX_CHARS) -> Column:
    """A block as it is if it fits and can hold no entries, else its packed pieces."""
    plain = ~block.rlike("[；;•\x80-\x9f]")
    split = F.split(block, SENTENCE, -1)
    alone = lambda pieces: F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(False).alias("alone")))
    # Only blocks with brackets can have pieces to join again, and only those with marks can have entries.
    opened = block.rlike("[(（]")
    pieces = F.when(plain & ~opened, alone(split)).when(plain, alone(healed(split))).when(~opened, marked(split)).otherwise(marked(healed(split)))
    return F.when(plain & (F.length(block) <= max_chars), F.array(block)).otherwise(packed(pieces, max_chars))


def chunk(documents: DataFrame, max_chars: int = MAX_CHARS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, chunk_id, text, opens_section, content_len)``."""
    # Each step is a column of its own, so that none is computed twice.
    whole = documents.select(id_column, normalize_newlines(F.col(text_column)).alias("whole"))
    lines = whole.withColumn("lines", F.filter(F.split("whole", "\n", -1), lambda line: ~is_blank(line))).where(F.size("lines") > 0)
    flat = breaks_meaningless(F.size("lines").cast("long"), F.col("m"), max_chars)
    parts = lines.withColumn("m", measures(F.col("lines"))).withColumn("parts", F.when(flat, blocks(F.col("whole"))).otherwise(F.col("lines")))
    cut = F.flatten(F.transform("parts", lambda part: cut_block(part, max_chars)))
    pieces = parts.select(id_column, F.posexplode(cut).alias("chunk_id", "text"))
    return pieces.withColumns({"opens_section": is_heading(F.col("text")), "content_len": content_len(F.col("text"))})
