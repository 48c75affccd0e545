"""The chunker against a plain program, and its edges one by one."""

import random
import re
from statistics import fmean, pstdev

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.chunking import chunk

HEAD, ITEM, ROW, ENTRY = re.compile(r"#{1,6}\s"), re.compile(r"\s*(?:[-*+]+\s+|•\s*|\d+[、)]\s*|\d+\.\s+)"), re.compile(r"\s*\|"), re.compile(r"\s*[\x80-\x9f•]")
ENDS = re.compile(r"(?<=[。．！？；;!?])|(?<=\.)(?=\s|$)")


def cut(block, most):
    pieces = []
    for piece in ENDS.split(block):
        last = pieces[-1] if pieces else ""
        if pieces and not ENTRY.match(piece) and sum(last.count(c) for c in "(（") > sum(last.count(c) for c in ")）"):
            pieces[-1] += piece
        else:
            pieces.append(piece)
    entry = [bool(ENTRY.match(p) or re.search(r"[；;]\s*\Z", p)) for p in pieces]
    out, held = [], ""
    for n, piece in enumerate(pieces):
        alone = entry[n] and (entry[n - 1 : n] == [True] or entry[n + 1 : n + 2] == [True])
        if alone or len(piece) > most:
            out += [held] if held else []
            out += [piece[k : k + most] for k in range(0, len(piece), most)]
            held = ""
        elif len(held) + len(piece) > most:
            out.append(held)
            held = piece
        else:
            held += piece
    return out + ([held] if held else [])


def chunks(source, most=250):
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    lines = [line for line in source.split("\n") if line.strip()]
    if not lines:
        return []
    sizes = [len(line) for line in lines]
    if fmean(sizes) <= most and pstdev(sizes) > max(2.0, 0.1 * fmean(sizes)):
        return [c for line in lines for c in cut(line, most)]
    blocks, open_ = [], []
    for line in [*source.split("\n"), ""]:
        if HEAD.match(line) or not line.strip() or ITEM.match(line) or ROW.match(line):
            blocks += ["\n".join(open_)] if open_ else []
            open_ = [line] if HEAD.match(line) else []
            blocks += [line] if line.strip() and not open_ else []
        else:
            open_.append(line)
    return [c for block in blocks for c in cut(block, most)]


def run(spark, sources, most=250):
    rows = spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string")
    found = {}
    for row in chunk(rows, most).orderBy("doc_id", "chunk_id").collect():
        assert row.chunk_id == len(found.setdefault(row.doc_id, []))
        assert row.opens_section == bool(HEAD.match(row.text)) and row.content_len == len("".join(row.text.split()))
        found[row.doc_id].append(row.text)
    return [found.get(n, []) for n in range(len(sources))]


def test_equals_plain_program(spark):
    draw = random.Random(11)
    parts = ["a", "word ", "。", "；", ";", "! ", ". ", ".", "06228.HK", "\n", "\n\n", "# h\n", "## 中\n", "- item ", "1. x", "2、y", "| c |", "(", "（", ")", "）", "•", "\x85", "\r\n", "　", "long" * 8, " ", "\x1c", "* b\n"]
    sources = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(600)]
    for most in (15, 250):
        assert run(spark, sources, most) == [chunks(s, most) for s in sources]


def test_edges(spark):
    sources = [None, "", " \n\t", "Section one\nA line that is longer than the first\nx", "word " * 400, "甲公司；乙公司；丙", "某公司(CHA. US)；next；", "2015.3 to 2016.4 at 06228.HK. Done", "a\r\n\r\nbbbbbbbbbbbbbbbbbbbbbb\rc"]
    got = run(spark, sources)
    assert got[:3] == [[], [], []]
    assert got[3] == sources[3].split("\n")
    assert "".join(got[4]) == sources[4] and max(map(len, got[4])) <= 250
    assert got[5] == ["甲公司；", "乙公司；", "丙"]
    assert got[6] == ["某公司(CHA. US)；", "next；"]
    assert got[7] == [sources[7]]
    assert got[8] == ["a", "bbbbbbbbbbbbbbbbbbbbbb", "c"]


def test_text_measures(spark):
    rows = spark.createDataFrame([("a\x1c b　c\xa0d\x85",), ("",), (" **bold** `x`_y_#\n",), ("1. item",), ("- x",), ("Label： rest: more",)], "t string")
    t = F.col("t")
    got = rows.select(text.content_len(t), text.is_blank(t), text.copy_form(t), text.unmarked(t), text.heading_label(t), text.estimate_tokens(F.lit("abcd"))).collect()
    assert [r[0] for r in got] == [4, 0, 15, 6, 2, 15]
    assert [r[1] for r in got] == [False, True, False, False, False, False]
    assert got[2][2] == "boldxy" and got[3][3] == "item" and got[4][3] == "x" and got[5][4] == "Label"
    assert got[0][5] == 2  # 2.5 to the even number


def plain_chunks(whole, limit=250):
    """The chunker line by line, for comparison."""
    import regex

    blank = r"[\s\x1c-\x1f\x85\p{Z}]"
    is_blank = lambda x: regex.fullmatch(f"{blank}*", x) is not None
    heading = lambda x: regex.match(f"#{{1,6}}{blank}", x)
    alone = lambda x: regex.match(rf"{blank}*(?:[-*+]+{blank}+|•{blank}*|\p{{Nd}}+[、)]{blank}*|\p{{Nd}}+\.{blank}+|\|)", x)
    entry = lambda x: regex.match(rf"{blank}*[\x80-\x9f•]", x)
    lines = [x for x in whole.split("\n") if not is_blank(x)]
    if not lines:
        return []
    sizes = [len(x) for x in lines]
    n, s, q = len(sizes), sum(sizes), sum(x * x for x in sizes)
    parts = lines
    if s > n * limit or n * q - s * s <= 4 * n * n or 100 * (n * q - s * s) <= s * s:
        parts, held = [], None
        for line in whole.split("\n"):
            if heading(line) or is_blank(line) or alone(line):
                if held is not None:
                    parts.append(held)
                held = line if heading(line) else None
                if alone(line) and not heading(line):
                    parts.append(line)
            else:
                held = line if held is None else f"{held}\n{line}"
        if held is not None:
            parts.append(held)
    out = []
    for part in parts:
        if len(part) <= limit and not regex.search("[；;•\x80-\x9f]", part):
            out.append(part)
            continue
        pieces = []
        for piece in regex.split(rf"(?<=[。．！？；;!?])|(?<=\.)(?={blank}|$)", part, flags=regex.V1):
            opened = pieces and sum(pieces[-1].count(c) for c in "(（") > sum(pieces[-1].count(c) for c in ")）")
            if opened and not entry(piece):
                pieces[-1] += piece
            else:
                pieces.append(piece)
        marked = [bool(regex.search("[；;•\x80-\x9f]", part)) and bool(entry(p) or regex.search(rf"[；;]{blank}*\Z", p)) for p in pieces]
        held = ""
        for k, piece in enumerate(pieces):
            single = marked[k] and (k and marked[k - 1] or k + 1 < len(pieces) and marked[k + 1])
            if single or len(piece) > limit:
                out += [held] * bool(held) + ([piece[i : i + limit] for i in range(0, len(piece), limit)] or [""])
                held = ""
            elif len(held) + len(piece) > limit:
                out += [held] * bool(held)
                held = piece
            else:
                held += piece
        out += [held] * bool(held)
    return out


def test_structures_equal_a_plain_chunker(spark):
    from siltstone.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    marks = ["# ", "- ", "1. ", "| ", "• ", "", "(", "", "", ""]
    got = {}
    for row in QUERIES["chunk_structures"](spark, sf).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(row.doc_id, []).append(row.text)
    kinds = set()
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [marks[i % 10] + x.replace(", ", "; ") + (")" if i % 10 == 7 else "\n" if i % 10 == 9 else "") for i, x in enumerate((row.text or "").split("\n"))]
        want = plain_chunks("\n".join(lines).replace("\r\n", "\n").replace("\r", "\n")) if row.text is not None else []
        assert got.get(row.doc_id, []) == want
        kinds |= {x[:2] for x in want}
    assert kinds >= {"# ", "- ", "1.", "| ", "• "}


def test_long_texts_take_linear_time(spark):
    import time

    from siltstone.functions.chunking import chunk

    one = "This is a sentence of some words that ends here. " * 60_000
    rows = [(0, one), (1, one.replace("here. ", "here.\n")), (2, "\n" * 500_000 + "x" + "\n" * 500_000), (3, "# h\n- i\n" * 50_000)]
    began = time.monotonic()
    got = {r.doc_id: r.n for r in chunk(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert time.monotonic() - began < 60
    assert got[0] == got[1] == 12_000 and got[2] == 1 and got[3] == 100_000
