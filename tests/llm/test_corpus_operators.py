import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from packsight.llm import components, mixing, ngram_join, nn_descent, queries


def brute_components(texts, n, threshold):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * threshold.denominator >= threshold.numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))], [len(s) for s in sets]


def near_copies(rng, groups=6, copies=12):
    words = [f"w{k}" for k in range(400)]
    texts = []
    passage = rng.choices(words, k=60)
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 60, 150]))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w + (passage if rng.random() < 0.3 else [])))
    return texts


@pytest.mark.parametrize("n, threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_links_equal_brute_force(spark, n, threshold):
    rng = random.Random(n)
    texts = near_copies(rng) + ["", None, "one two", "ONE  two", "one", "one two three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "sig", "keys", "root")})
    got = {r.doc_id: r for r in ngram_join.link(rows, n, threshold).collect()}
    roots, sizes = brute_components(texts, n, threshold)
    assert [got[k].component_id for k in range(len(texts))] == roots
    assert [got[k].n_shingles for k in range(len(texts))] == sizes


def test_links_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.link(rows).collect()) == [("2", "2"), ("3", "2"), ("3", "2"), ("None", "2"), ("None", "None")]


def test_one_large_group_of_near_copies_stays_linear(spark):
    rng = random.Random(8)
    base = [f"x{k}" for k in range(120)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.link(rows, 3, Fraction(9, 10)).collect()}
    assert [got[k] for k in range(400)] == brute_components(texts, 3, Fraction(9, 10))[0]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = defaultdict(set)
    for r in components.components(edges).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(61)), [100, 101]]
    assert components.components(edges.limit(0)).count() == 0


def water(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess again and again."""
    left, budget, target = dict(enumerate(sizes)), 1.5 * sum(sizes), {}
    weight = {k: weights[k % 3] for k in left}
    while left:
        share = {k: budget * weight[k] / sum(weight[j] for j in left) for k in left}
        over = [k for k in left if share[k] > 2 * left[k]]
        for k in over or list(left):
            target[k] = 2.0 * left[k] if over else share[k]
            budget -= target[k] if over else 0
            left.pop(k)
    return [target[k] for k in range(len(sizes))]


def test_targets_equal_resharing(spark):
    rng = random.Random(9)
    for sizes in ([10, 0, 500, 3, 80, 7], [rng.randint(1, 1000) for _ in range(13)], [5]):
        rows = spark.createDataFrame([(f"s{k:02}" if k else None, n) for k, n in enumerate(sizes)], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        order = [f"s{k:02}" for k in range(1, len(sizes))] + [None]
        assert [got[s] for s in order] == pytest.approx(water(sizes[1:] + sizes[:1]))


def test_mix_takes_whole_targets(spark):
    rng = random.Random(10)
    rows = [(k, None if rng.random() < 0.05 else "w " * rng.choice([0, 1, 30, 900]), rng.choice(["a", "a", "a", "b", None])) for k in range(300)] + [(1, "w w", "a"), (1, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "slot": F.lit(2), "number": F.lit(3)})
    mixed, listed = mixing.mix(docs, block_words=16)
    parts = mixed.collect()
    info = {r.row: r for r in listed.collect()}
    assert len(info) == len(rows)
    taken, seen = defaultdict(int), defaultdict(list)
    for p in parts:
        taken[p.row] += p.to_word - p.from_word
        seen[p.row, p["pass"]].append((p.from_word, p.to_word))
    by_source = defaultdict(int)
    for row, r in info.items():
        assert taken[row] <= 2 * r.size
        by_source[r.source] += taken[row]
    for r in info.values():
        assert by_source[r.source] == int(r.target + 1e-9)
    for spans in seen.values():  # no word twice within a pass
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    again, _ = mixing.mix(docs, block_words=16)
    key = lambda p: (p.slot, p.doc_id, p["pass"], p.from_word, p.to_word)
    assert sorted(map(key, parts)) == sorted(map(key, again.collect()))


def test_mix_order_keeps_to_the_shares(spark):
    docs = spark.createDataFrame([(k, "w " * 64, "abc"[k % 3]) for k in range(600)], "doc_id long, text string, source string")
    mixed, listed = mixing.mix(docs)
    source = {r.row: r.source for r in listed.collect()}
    slots = sorted({(p.slot, source[p.row]) for p in mixed.collect()})
    for n in (100, 300, 600):
        counts = [sum(s == c for _, s in slots[:n]) / n for c in "abc"]
        total = [sum(s == c for _, s in slots) / len(slots) for c in "abc"]
        assert max(abs(a - b) for a, b in zip(counts, total)) < 0.03


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    mixed, listed = mixing.mix(docs)
    assert mixed.count() == 0 and listed.count() == 0
    mixed, listed = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string"))
    assert mixed.count() == 0 and {r.target for r in listed.collect()} == {0.0}


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = defaultdict(set)
    rows = queries.op2_neighbours(spark, folder).collect()
    for r in rows:
        got[r.query_id].add(r.vec_id)
    data = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], dtype=float)
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits += len(found & set(ids[best]))
        for r in rows:
            if r.query_id == q:
                assert r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12)
    assert len(got) == sum(ids % 100 == 0) and hits / (10 * len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "v": F.lit(2), "half": F.lit(3)})
    nodes, graph = nn_descent.index(table)
    got = nn_descent.search(nodes, graph, nn_descent.own_queries(table)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 8, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 8, 0.0), (100, 3, 6, 1.0)]
    nodes, graph = nn_descent.index(table.limit(0))
    assert nn_descent.search(nodes, graph, nn_descent.own_queries(table.limit(0))).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", "en", "src0", 0), (None, "some text of no id", "en", "src0", 18)], docs.schema)
    first = docs.orderBy("doc_id").limit(5)
    docs = docs.unionByName(extra).unionByName(first).withColumns({"score": F.lit(1), "row": F.lit(2), "sig": F.lit(3)})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if name == "near_duplicates":
            roots, _ = brute_components([r.text for r in docs.collect()], 5, Fraction(4, 5))
            assert roots == list(range(len(roots)))
    tokens = corpus_pipeline.tokens(spark, docs, DATA)
    assert tokens.count() == docs.count() > 0
    assert tokens.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "none")
    assert docs.count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()}) == list(range(1, 11)) and "pipeline" in names


def test_neighbour_graph_has_no_fixed_caps(spark):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes, graph = nn_descent.index(table, inward=2)
    assert graph.where(F.size("near") < 24).count() == 0  # a node keeps its own edges
    got = defaultdict(set)
    for r in nn_descent.search(nodes, graph, nn_descent.own_queries(table, every=30), beam=10, step=10, entries=20, probes=16).collect():
        got[r.query_id].add(r.vec_id)
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, 1500, 30)}
    assert sum(len(near[q] & got[q]) for q in near) >= 0.9 * 10 * len(near)


def test_neighbours_in_a_dense_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[:120] = x[0] + rng.normal(size=(120, 16)) * 1e-5
    x *= 1e6
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes, graph = nn_descent.index(table)
    got = defaultdict(set)
    for r in nn_descent.search(nodes, graph, nn_descent.own_queries(table, every=20), probes=8).collect():
        got[r.query_id].add(r.vec_id)
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, 300, 20)}
    assert sum(len(near[q] & got[q]) for q in near) >= 0.95 * 10 * len(near)
