"""Operators that look across rows: near-duplicates, components, nearest neighbours, page templates, the pipeline."""

import html as entities
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, components, html, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def shingles(text, k):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    k = min(k, len(found))
    return frozenset(tuple(found[n : n + k]) for n in range(len(found) - k + 1))


def brute_components(rows, k, percent=80):
    sets, parent = {}, {}
    for n, text in rows:
        sets[n], parent[n] = shingles(text, k), n

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: (len(sets[n]), root(n), root(n) == n) for n in names}


def docs(spark, texts):
    return spark.createDataFrame([(n, t, "en", "s", 1) for n, t in enumerate(texts)], DOCS)


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)] + [(n, n + 1) for n in range(1000, 1150)] + [(5000, n) for n in range(4000, 4200)] + [(7, 7), (1, None)]
    parent = {n: n for pair in links if None not in pair for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent if n in got}
    assert {n for a, b in links if b is not None and a != b for n in (a, b)} == set(got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("bounds", [(3, 1_000_000), (3, 1), (0, 1_000_000)])
def test_hubs(spark, monkeypatch, bounds):
    """Hubs told by broadcast, too many to be, and every node a hub."""
    monkeypatch.setattr(components, "HUB", bounds[0])
    monkeypatch.setattr(components, "BROADCAST_HUBS", bounds[1])
    links = [(100, n) for n in range(101, 160)] + [(7, n) for n in range(100, 130, 7)] + [(500 + n, 501 + n) for n in range(20)] + [(900, 900 + n) for n in range(1, 30)] + [(929, 505)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for pair in links for n in pair}
    assert got == {n: 7 if n < 200 else 500 for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"w{n}" for n in range(300)]
    texts = []
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(1, 14)):
            copy = [draw.choice(vocabulary) if draw.random() < draw.choice([0, 0.02, 0.06, 0.1]) else w for w in base]
            texts.append(draw.choice([" ", "\n", "\t "]).join(copy))
    texts += [None, "", " \n", "One", "one", "one two", "ONE\x0btwo", texts[0], texts[0].upper(), "é É", "long " * 50_000, "z\x1cz"]
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts), k).collect()}
        assert got == brute_components(enumerate(texts), k)


def test_ambiguous_group_loses_no_link(spark):
    """A chain in which each text is linked with its neighbours alone, in shared buckets."""
    draw = random.Random(6)
    base = [f"w{n}" for n in range(160)]
    texts = []
    for n in range(40):
        base = list(base)
        for place in draw.sample(range(len(base)), 5):
            base[place] = f"x{n}_{place}"
        texts.append(" ".join(base))
    draw.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts), 2).collect()}
    assert got == brute_components(enumerate(texts), 2)


def test_salted_joins_lose_nothing(spark, monkeypatch):
    """Small bounds, so that pivots and runs of a few texts are dealt to several tasks."""
    monkeypatch.setattr(minhash, "PIVOT_PAIRS", 3)
    monkeypatch.setattr(minhash, "RUN_NODES", 2)
    draw = random.Random(16)
    base = [f"w{n}" for n in range(120)]
    texts = []
    for n in range(60):
        copy = list(base) if n % 3 else list(texts[-1].split()) if texts else list(base)
        for place in draw.sample(range(len(copy)), draw.choice([1, 4, 8])):
            copy[place] = f"x{n}_{place}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts), 2).collect()}
    assert got == brute_components(enumerate(texts), 2)


def rows_made(spark, run):
    """The most rows that a join or generator of the plans that ``run`` executes gave."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, found = 0, store.executionsList()
    for e in (found.apply(n) for n in range(before, found.size())):
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            if node.name() == "Generate" or "Join" in node.name():
                metrics = node.metrics()
                own = (metrics.apply(n) for n in range(metrics.size()))
                most = max([most, *(int(values.apply(m.accumulatorId()).replace(",", "")) for m in own if m.name() == "number of output rows" and values.contains(m.accumulatorId()))])
    return most


def test_group_of_near_copies_is_told_to_few(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RUN_NODES", 4)

    def searched(n):
        words = [f"w{i}" for i in range(40)]
        texts = [" ".join(words[: i % 39] + [f"own{i}"] + words[i % 39 + 1 :]) for i in range(n)]
        rest = minhash.written(spark.createDataFrame([(i, 0 if i < n - 3 else i) for i in range(n)], "node long, component long"), "rest")
        made = minhash.written(docs(spark, texts).select("doc_id", "text"), "texts")
        found = []
        made_rows = rows_made(spark, lambda: found.extend(minhash.across_components(rest, made, 2, 80).collect()))
        sets = [shingles(t, 2) for t in texts]
        links = {(a, b) for b in range(n - 3, n) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        assert links and links <= {(r.a, r.b) for r in found}
        return made_rows

    # Four times the group: four times the rows, not sixteen times.
    assert searched(400) <= 6 * searched(100)


def test_near_duplicate_edges(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "x", "en", "s", 1)]
    made = spark.createDataFrame(rows, DOCS).withColumn("keys", F.lit(1)).withColumn("node", F.lit(2))
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(made).collect())
    assert got == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert sorted((r.doc_id or -1) for r in minhash.one_of_each(made).collect()) == [-1, 1, 3]


def test_word_hashes_depend_on_bytes_alone():
    a = list(minhash.run_sets(["x y", "pad pad pad x y"], 2))
    assert set(a[0].tolist()) <= set(a[1].tolist())
    many = [f"t{n} u{n}" for n in range(300_000)]
    assert len({int(s[0]) for s in minhash.run_sets(many, 2)}) == len(many)


def test_op4_equals_brute_force(spark):
    from siltstone.llm.queries import op4_near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op4_near_duplicates(spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 2)


# --- nearest neighbours


def exact(x, ids, q, k):
    norms = np.linalg.norm(x, axis=1)
    score = x @ x[q] / norms / norms[q]
    order = sorted((n for n in range(len(ids)) if ids[n] != ids[q]), key=lambda n: (-round(score[n], 12), ids[n]))[:k]
    return [(int(ids[n]), score[n]) for n in order]


def test_recall_against_brute_force(spark):
    from siltstone.llm.queries import op7_nearest

    sf = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in op7_nearest(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        own = sorted(found[int(ids[q])])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        want = exact(x, ids, q, 5)
        hits += len({r[1] for r in own} & {w[0] for w in want})
        total += 5
        for _, vec, score in own:
            n = int(np.flatnonzero(ids == vec)[0])
            assert abs(score - x[q] @ x[n] / np.linalg.norm(x[q]) / np.linalg.norm(x[n])) < 1e-12
    assert hits / total >= 0.9


def test_recall_beside_a_hot_vector(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(2000, 24))
    hot = draw.permutation(2000)[:700]
    x[hot] = x[hot[0]]
    x[hot[1:200]] *= 2.0 ** draw.integers(1, 5, (199, 1))
    # Queries whose true neighbours lie just before and after the copies.
    for n, q in enumerate(np.setdiff1d(np.arange(2000), hot)[:20]):
        x[q] = x[hot[0]] / np.linalg.norm(x[hot[0]]) + 0.15 * draw.normal(size=24)
    ids = draw.permutation(10_000)[:2000]
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    near = np.setdiff1d(np.arange(2000), hot)[:60]
    asked = made.where(F.col("vec_id").isin([int(ids[q]) for q in [*near, *hot[:40:8]]]))
    found = {}
    for r in ann.nearest(asked, made, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in near:
        hits += len(set(found[int(ids[q])]) & {n for n, _ in exact(x, ids, q, 5)})
    assert hits / (5 * len(near)) >= 0.97
    for q in hot[:40:8]:
        assert found[int(ids[q])] == [n for n, _ in exact(x, ids, q, 5)]
    few = np.array([9, 3, 1, 2, 8, 1])
    assert few[ann.leading(few, np.ones((6, 2)), 1)].tolist() == [3, 1, 2, 1][1:]


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, [0.0, 1e-30, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1.0, float("nan"), 0.0]), (8, [1.0, float("inf"), 0.0]), (9, [1.0]), (None, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("part", F.lit(1))
    got = [tuple(r) for r in ann.nearest(made.where("vec_id in (0, 4, 5, 9)"), made, 5).orderBy("query_id", "rank").collect()]
    assert [(q, n, v, round(s, 9)) for q, n, v, s in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 1, -1.0)]
    assert ann.nearest(made.where("false"), made.where("false"), 5).count() == 0
    one = made.where("vec_id = 0")
    assert ann.nearest(one, one, 5).count() == 0


def test_cells_keep_recall_and_save_work(spark, monkeypatch):
    """Clustered vectors, a third of them in one cluster: queries look into few cells, and nearly all neighbours are found."""
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    draw = np.random.default_rng(9)
    centres = 3 * draw.normal(size=(40, 16))
    of = np.where(draw.random(8000) < 0.33, 0, draw.integers(0, 40, 8000))
    x = centres[of] + 0.4 * draw.normal(size=(8000, 16))
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    _, cells = ann.fit(ann.usable(made))
    assert len(cells.centroids) == 40 and cells.probes <= 12
    found = {}
    for r in ann.nearest(made.where("vec_id % 50 = 0"), made, 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(8000)
    hits = sum(len(found[q] & {n for n, _ in exact(x, ids, q, 5)}) for q in range(0, 8000, 50))
    assert hits / (5 * 160) >= 0.95
    # Without clusters every query scans every row.
    plain = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(draw.normal(size=(8000, 64)))], "vec_id long, embedding array<double>")
    assert len(ann.fit(ann.usable(plain))[1].centroids) == 1


def test_repeated_queries(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 8))
    rows = [(n, v.tolist()) for n, v in enumerate(x)]
    rows += [rows[50], rows[100], rows[100], (150, (-x[150]).tolist()), (None, x[0].tolist()), (50, None)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.nearest(made.where("vec_id % 50 = 0"), made, 5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    kept = [r for r in rows if r[0] is not None and r[1] is not None]
    ids, every = np.array([r[0] for r in kept]), np.array([r[1] for r in kept])
    assert sorted(found) == [0, 50, 100, 150, 200, 250]
    for q, own in found.items():
        vectors = {tuple(v) for n, v in kept if n == q}
        assert sorted(r[0] for r in own) == sorted([1, 2, 3, 4, 5] * len(vectors)) and len(vectors) == 1 + (q == 150)
        want = sorted((vec, round(score, 9)) for v in vectors for vec, score in exact(every, ids, kept.index((q, list(v))), 5))
        assert sorted((vec, round(score, 9)) for _, vec, score in own) == want


def test_quantiser_weighs_parallel_error():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 16))
    parallel = {}
    for weight in (1.0, 6.0):
        q = ann.Quantiser(x, weight)
        codes = q._codes(q._cut(ann.unit(x)))
        decoded = np.concatenate([q.centroids[p][codes[:, p]] for p in range(q.pieces)], 1)
        residual = ann.unit(x) - decoded
        parallel[weight] = ((residual * ann.unit(x)).sum(1) ** 2).mean()
    assert parallel[6.0] < 0.7 * parallel[1.0]


# --- pages


def test_fitting_holds_little_at_once(spark, monkeypatch):
    draw = np.random.default_rng(6)
    wide = draw.normal(size=(4096, 256))
    tracemalloc.start()
    quantiser = ann.Quantiser(wide, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    whole = quantiser.encode(wide[:300])
    monkeypatch.setattr(ann, "SLAB_VALUES", 7 * quantiser.pieces * ann.CENTROIDS)
    assert (quantiser.encode(wide[:300]) == whole).all()
    monkeypatch.setattr(ann, "SAMPLE_VALUES", 50 * 16)
    seen = []
    monkeypatch.setattr(ann, "Quantiser", lambda x, **_: seen.append(x.shape))
    ann.fit(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(draw.normal(size=(400, 16)))], "vec_id long, embedding array<double>"))
    assert seen[0][1] == 16 and 20 <= seen[0][0] <= 50


def test_blocks_of_queries_are_not_broadcast(spark):
    """A copy of every block goes to every slot, and the driver must hold none of them, however small the queries look."""
    draw = np.random.default_rng(31)
    made = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(draw.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    found = ann.nearest(made.where("vec_id % 50 = 0"), made, 5, parts=40)
    assert len(found.collect()) == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def page(n, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="nav-open"><nav><a href="/">Home {n}</a></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><article><h2>Title {n}</h2>{body}<p>Subscribe   to our letter</p></article><div class="comments"><p>Nice {n}</p></div>{extra}<footer>&copy; {n}</footer></body></html>'


def pages(spark, sources, host="a.example"):
    return spark.createDataFrame([(n, f"http://{host}/{n}", s) for n, s in enumerate(sources)], "page_id long, url string, html string")


def test_constant_nodes_are_template(spark):
    sources = [page(n, f"<p>Body <b>bold</b>er {n} &amp; more<br>line {n}</p><ul><li>x{n}<li>y</ul>") for n in range(30)]
    got = {r.page_id: r for r in html.extract(pages(spark, sources).withColumn("host", F.lit("z")).withColumn("template", F.lit("z"))).collect()}
    for n in range(30):
        assert got[n].text == f"Title {n} Body bolder {n} & more line {n} x{n}" and got[n].n_chars == len(got[n].text)
    few = {r.page_id: r.text for r in html.extract(pages(spark, sources[:3])).collect()}
    assert few[1] == "Title 1 Body bolder 1 & more line 1 x1"
    two = {r.page_id: r.text for r in html.extract(pages(spark, sources[:2])).collect()}
    assert two[1] == "Title 1 Body bolder 1 & more line 1 x1 y Subscribe to our letter"
    copies = {r.text for r in html.extract(pages(spark, [sources[0]] * 40)).collect()}
    assert copies == {"Title 0 Body bolder 0 & more line 0 x0 y Subscribe to our letter"}


def test_pages_of_any_kind(spark):
    sources = [None, "", "plain text", "<p>a<p>b", "<div>a</div>b<script>x", "<article><p>one</article><article class='comment'><p>no</article>", "<main><p>m</p></main><p>out</p>", "a &lt;b&gt; &nbsp;c <!-- no --> d", "<p>cut <b>here</b", "<p hidden>h</p><p style='display: none'>i</p><p aria-hidden=true>j</p>k", "<" * 2000 + "p>" * 2000, "<ul>" + "<li>i" * 3000, "<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>"]
    got = {r.page_id: r.text for r in html.extract(pages(spark, sources)).collect()}
    assert [got[n] for n in range(10)] == ["", "", "plain text", "a b", "a b", "one", "m", "a <b> c d", "cut here", "k"]
    assert got[11].startswith("i i i") and got[12] == "T x"
    assert html.extract(pages(spark, [])).count() == 0
    strange = spark.createDataFrame([(1, None, "<p>x"), (2, "no url", "<p>y"), (2, "no url", "<p>y")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract(strange).collect()) == ["x", "y", "y"]


def test_tree_matching():
    def tree(*nodes):
        return html.Tree([html.LABEL[label] for label, _ in nodes], [parent for _, parent in nodes])

    a = tree(("body", -1), ("nav", 0), ("div", 0), ("footer", 0), ("p", 2))
    b = tree(("body", -1), ("aside", 0), ("nav", 0), ("div", 0), ("h1", 3), ("p", 3))
    score, pairs = html.match(a, b, 0, 0, {})
    assert score == 4 and pairs == [(1, 2), (2, 3)]
    assert html.match(a, tree(("p", -1)), 0, 0, {}) == (0, [])
    merged = html.merge(a, b)
    assert [html.LABELS[merged.labels[n]] for n in merged.children[0]] == ["aside", "nav", "div", "footer"]
    assert [html.LABELS[merged.labels[n]] for n in merged.children[2]] == ["h1", "p"]


def test_matching_equals_brute_force():
    draw = random.Random(12)

    def best(a, b, x, y):
        """The most pairs that any order-keeping choice of child pairs gives."""
        if a.labels[x] != b.labels[y]:
            return 0

        def children(p, q):
            if not p or not q:
                return 0
            return max(children(p[1:], q), children(p, q[1:]), best(a, b, p[0], q[0]) + children(p[1:], q[1:]))

        return 1 + children(a.children[x], b.children[y])

    for _ in range(150):
        a, b = (html.Tree([0] + [draw.choice([2, 3]) for _ in range(n - 1)], [-1] + [draw.randrange(k) for k in range(1, n)]) for n in (draw.randint(1, 8), draw.randint(1, 8)))
        assert html.match(a, b, 0, 0, {})[0] == best(a, b, 0, 0)
        home = html.align(a, b)
        assert sum(node >= 0 for node in home) == best(a, b, 0, 0)


def bare(n, body):
    """A page without telling names: menu, advert, article and footer are div elements."""
    return f'<html><body><div id="x{n}"><div><a href="/">Home {n}</a> <a href="/b">Area {n % 7}</a></div></div><div class="k{n}">Buy {n} things now</div><div class="k{n + 1}"><h1>Title {n}</h1>{body}</div><div>Letter {n} of us all</div></body></html>'


def test_template_decides_without_marks(spark):
    sources = [bare(n, f"<p>First text {n} of the page with quite a few words more than others have</p><div><p>And more {n} of it</p></div><p>Sign up</p>") for n in range(25)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, sources)).collect()}
    assert got == {n: f"Title {n} First text {n} of the page with quite a few words more than others have And more {n} of it" for n in range(25)}
    alone = html.main_text(sources[3])
    assert "Buy 3" in alone and "Home 3" in alone and "Sign up" in alone


def test_op3_by_the_template_alone(spark):
    """Where article, nav, class and so on say nothing, the template finds the text of nearly all pages that have others of their host beside them."""
    sf = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    plain = [re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", r.html)) for r in rows]
    made = spark.createDataFrame([(r.page_id, r.url, h) for r, h in zip(rows, plain, strict=True)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(made).collect()}
    right = sum(got[r.page_id] == marked_text(r.html) for r in rows)
    assert right >= 0.99 * len(rows)
    assert sum(html.main_text(h) == marked_text(r.html) for r, h in zip(rows, plain, strict=True)) < 0.05 * len(rows)


def test_deep_and_wide_pages(spark):
    import time

    deep = ["<div>" * 30_000 + f"inner {n}" + "</div>" * 30_000 for n in range(4)]
    wide = ["<ul>" + "".join(f"<li><b>i{k}</b><p>x" for k in range(20_000)) + f"</ul>{n}" for n in range(4)]
    mixed = ["".join(f"<{t}>t{n}</{t}>" for t in ("h2", "p", "div", "ul", "section") for _ in range(1000)) * 2 + str(n) for n in range(4)]
    odd = ["<b>" * 30_000 + "</i>" * 30_000 + "<p>" * 30_000 + f"end {n}" for n in range(4)]
    began = time.monotonic()
    got = {}
    for name, sources in (("deep", deep), ("wide", wide), ("mixed", mixed), ("odd", odd)):
        got[name] = {r.page_id: r.text for r in html.extract(pages(spark, sources, f"{name}.example")).collect()}
    assert time.monotonic() - began < 90
    assert got["deep"] == {n: f"inner {n}" for n in range(4)} and got["odd"] == {n: f"end {n}" for n in range(4)}
    assert all(t.endswith(f"{n}") for n, t in got["wide"].items())


def test_template_is_bounded(spark):
    """Classes and the number of pages add nothing to a template, and other structures add up to a bound."""
    same = [f'<div class="a{n}"><div class="post-{n}"><p class="p{n}">t{n}</p></div></div>' for n in range(5000)]
    made = spark.createDataFrame([(n, "http://a.example/", s) for n, s in enumerate(same)], "page_id long, url string, html string").repartition(8)
    (row,) = html.induce(html.shapes(made)).collect()
    assert len(html.Tree.unpacked(bytes(row.structure)).labels) == 4
    draw = random.Random(3)
    other = [(n, "http://b.example/", "".join(draw.choice(["<div>", "</div>", "<section>", "<ul>", "</section>", "<p>x", "<table>"]) for _ in range(200))) for n in range(300)]
    (row,) = html.induce(html.shapes(spark.createDataFrame(other, "page_id long, url string, html string"))).collect()
    assert len(html.Tree.unpacked(bytes(row.structure)).labels) <= html.NODES


def test_plans_joined_equal_broadcast(spark, monkeypatch):
    sources = [bare(n, f"<p>First text {n} of the page with quite a few words more than others have</p>") for n in range(9)]
    made = pages(spark, sources).unionByName(pages(spark, sources[:2], "b.example"))
    want = sorted(map(tuple, html.extract(made).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html.extract(made).collect())) == want


def marked_text(source):
    part = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    part = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div)[^>]*>", " ", part))
    return " ".join(entities.unescape(part).split())


def test_op3_against_the_pages_markup(spark):
    from siltstone.llm.queries import op3_main_text

    got = {r.page_id: r.text for r in op3_main_text(spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[row.page_id] == marked_text(row.html)


# --- pipeline


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline
    from test_text_operators import brute_runs

    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = source.orderBy("doc_id").collect()
    texts = brute_runs([r.text for r in rows], 50)
    lines = {rows[n].doc_id: t for n, t in texts.items()}
    classes = brute_components(lines.items(), 5)
    left = {n for n, (_, _, kept) in classes.items() if kept}
    found = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, SF)
        assert found.columns == source.columns
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in found.collect()} == lines
        if name == "near_dedup":
            assert {r.doc_id for r in found.collect()} == left
    last = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert last == {r.doc_id for r in found.collect()} and last <= left


def test_no_exact_copy_reaches_the_end(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    planted = source.where("length(text) > 0 and doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    source.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = {}
    for row in source.orderBy("doc_id").collect():
        first.setdefault(row.text, row.doc_id)
    firsts = {n for text, n in first.items()}
    assert planted.count() > 50
    last = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last and last <= firsts


def test_every_operator_has_a_query():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 11)) and "pipeline" in found
