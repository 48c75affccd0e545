"""Every registered core query gives the rows of its SQL on DuckDB."""

import math

import duckdb
import pytest

import siltstone.case_queries  # noqa: F401
from siltstone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_quotes_are_sought_in_all_lines(spark, tmp_path):
    """Lines that hold others and lines that repeat: a line that an earlier quote took is not free."""
    import random

    draw = random.Random(12)
    words = ["alpha", "beta", "gamma"]
    texts = ["\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 12))) for _ in range(120)]
    texts.append("\n".join(f"line {'x' * n} end" for n in range(60)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, not_free = set(), 0
    for doc, source in enumerate(texts):
        found, taken = source.split("\n"), []
        for quote in found[1::2]:
            not_free += any(quote in found[n] for n in taken)
            taken.append(next((n for n, line in enumerate(found) if quote in line and n not in taken), None))
        if None not in taken:
            want |= {(doc, n, at) for n, at in enumerate(taken)}
    got = {(r.doc_id, r.quote_no, r.chunk_id) for r in QUERIES["quote_anchors"](spark, str(tmp_path)).collect()}
    assert got == want and not_free > 50 and max(at for _, _, at in got) > 50 and max(n for _, n, _ in got) > 20


def test_core_stands_without_the_llm_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['siltstone.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport siltstone.queries, siltstone.case_queries, siltstone.extraction, siltstone.streaming.chunks\nprint(len(siltstone.queries.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(done.stdout) == len(QUERIES), done.stderr
