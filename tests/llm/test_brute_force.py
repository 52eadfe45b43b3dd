"""Each query, and each stage of the pipeline, over its whole tables against a plain version of the same."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, water
from test_text_operators import base_spans, path

import corpus_pipeline
from packsight.llm import bpe, html_text, license_scan, mixing, ngram_join, nn_descent, pii, quality_crf, queries, url_filter

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


def test_op1(spark, docs):
    got = {r.doc_id: r for r in queries.op1_pii(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, r = base_spans(d.text or ""), got[d.doc_id]
        count = Counter(k for _, _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        listed = [f"{k}:{a}:{e}" for a, _, k, e in spans]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_op1_takes_short_passwords_and_dashed_numbers(spark):
    rows = [(1, "password=hunter2secret"), (2, "call 555-123-4567"), (3, "order no 555-123-4567"), (4, "token: required"), (5, "x" * 90 + "abc.def [at] mail [dot] example"), (6, "token=" + "aB3d" * 500)]
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["secret"], 2: ["phone_local"], 3: [], 4: [], 5: ["email_spelled"], 6: ["secret"]}


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e6, 0.0), (1e-9, 0.0), (1.0, 3000.0)])
def test_op2_recall_at_any_scale(spark, scale, shift):
    x = np.random.default_rng(3).normal(size=(3000, 24)) * scale + shift
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes, graph = nn_descent.index(table, trees=3)
    got = defaultdict(set)
    for r in nn_descent.search(nodes, graph, nn_descent.own_queries(table), entries=40, starts=4, beam=60).collect():
        got[r.query_id].add(r.vec_id)
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, 3000, 100)}
    assert sum(len(near[q] & got[q]) for q in near) >= 0.9 * 10 * len(near)
    with pytest.raises(ValueError):
        nn_descent.search(nodes, graph, nn_descent.own_queries(table), k=11)


def test_op2_of_other_queries(spark):
    x = np.random.default_rng(4).normal(size=(800, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes, graph = nn_descent.index(table)
    asked = np.random.default_rng(5).normal(size=(20, 8))
    rows = nn_descent.search(nodes, graph, spark.createDataFrame([(10_000 + k, v.tolist()) for k, v in enumerate(asked)], "query_id long, v array<double>"), k=5).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.query_id - 10_000].add(r.vec_id)
    assert sum(len(got[k] & set(np.argsort(((x - v) ** 2).sum(axis=1))[:5].tolist())) for k, v in enumerate(asked)) >= 0.9 * 5 * 20


def test_op2_of_many_shards(spark, monkeypatch):
    """Every query searches every shard, and the jobs don't grow with rounds and expansions."""
    monkeypatch.setattr(nn_descent, "SHARD", 1200, raising=False)
    monkeypatch.setattr(nn_descent, "ASKED", 40, raising=False)
    x = np.random.default_rng(7).normal(size=(6000, 32))
    x[5000:] = x[3] + np.random.default_rng(8).normal(size=(1000, 32)) * 1e-4
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.sparkContext.setJobGroup("op2", "op2")
    nodes, graph = nn_descent.index(table)
    rows = nn_descent.search(nodes, graph, nn_descent.own_queries(table)).collect()
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("op2")) < 60
    assert graph.select("shard").distinct().count() == 5
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()))
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, 6000, 100)}
    assert sum(len(near[q] & got[q]) for q in near) >= 0.9 * 10 * len(near)


def test_op3(spark, docs):
    terms = [set(license_scan.terms((d.text or "").lower())) for d in docs]
    vocabulary = {t for _, text in license_scan.TEMPLATES for t in license_scan.terms(text.lower())}
    frequency = Counter(t for found in terms for t in found & vocabulary)
    m = license_scan.Matcher(license_scan.TEMPLATES, frequency, len(docs), license_scan.THRESHOLD)
    m.anchor = re.compile(r"[^\n]")  # every block is scored
    places, own = {}, {}
    for d in docs:
        name = "LICENSE" if d.doc_id % 10 == 0 else f"{d.doc_id}.txt"
        places[d.doc_id] = "/".join([d.source or "unknown", str(d.doc_id // 1000), str(d.doc_id // 10), name])
        own[d.doc_id] = m.match(d.text or "")
    holders = {}
    for k in sorted(places, key=lambda k: (-own[k][1], places[k])):
        if own[k][0] and (places[k].endswith("/LICENSE") or own[k][2] >= 0.8):
            holders.setdefault(places[k].rpartition("/")[0], (own[k][0], places[k]))
    for r in queries.op3_licences(spark, DATA).collect():
        name, score, _ = own[r.doc_id]
        assert r.own_licence == name and r.score == pytest.approx(score)
        if name:
            want = name, places[r.doc_id]
        else:
            parts = places[r.doc_id].split("/")[:-1]
            want = next((holders[d] for k in range(len(parts), -1, -1) if (d := "/".join(parts[:k])) in holders), (None, None))
        assert (r.licence, r.licence_from) == want


def test_op3_notices_of_several_lines():
    m = license_scan.Matcher(license_scan.TEMPLATES, {}, 1000, license_scan.THRESHOLD)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    two = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    three = two + "\n\nNeither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."
    texts = {"GPL-3.0": gpl, "ISC": isc, "BSD-2-Clause": two, "BSD-3-Clause": three, "MIT": "// SPDX-License-Identifier: MIT", "Unlicense": "This is free and unencumbered software released into the public domain.", None: "word " * 200_000}
    for name, text in texts.items():
        assert m.match(f"some code\n\n{text}\n\nmore code")[0] == name


def test_op4(spark, docs):
    size = lambda t: len(WORD.findall(t or ""))
    by = Counter()
    for d in docs:
        by[d.source] += size(d.text)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    target = dict(zip(order, water([by[s] for s in order])))
    source, taken = {d.doc_id: d.source for d in docs}, Counter()
    for r in queries.op4_mix(spark, DATA).collect():
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in by)


def test_op4_points_and_equal_ids(spark):
    slots = [0, 1, 2**32 - 1, 2**33 + 12345, 2**39 + 987654321, 2**40 - 1]
    rows = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", mixing._point(F.col("slot")).alias("p")).collect()
    assert all(r.p == r.slot * mixing.GOLDEN % mixing.POINTS for r in rows)
    mixed, listed = mixing.mix(spark.createDataFrame([(None, f"w{k} w", "a") for k in range(4000)], "doc_id long, text string, source string"))
    assert mixed.groupBy().agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0] == 12_000 and listed.count() == 4000


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path())
    got = {r.doc_id: r for r in queries.op5_bpe(spark, DATA).collect()}
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


class Visible(HTMLParser):
    """The words of a page outside of elements that aren't shown."""

    def __init__(self):
        super().__init__()
        self.hidden, self.found = [], []

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        if tag in html_text.VOID:
            return
        gone = tag in html_text.HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "")
        if self.hidden or gone:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.found += re.findall(r"\w\w+", data)


def test_op6(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op6_html(spark, DATA).collect():
        plain = Visible()
        plain.feed(pages[r.page_id] or "")
        missing = Counter(plain.found) - Counter(re.findall(r"\w\w+", r.text))
        assert not missing, (r.page_id, missing)


def test_op6_nesting_order_and_layout():
    assert html_text.render("<ul><li>" * 20_000 + "deep").endswith("- deep")
    assert html_text.render("<table><tr><td>" * 20_000 + "deep") == "deep"
    assert html_text.render("<table><thead><tr><th>Name<th>Qty</thead><tr><td>Pie<td>3</table>") == "Name  Qty\nPie   3"
    assert html_text.render("<table><tfoot><tr><td>Sum<td>3</tfoot><tr><td>Pie<td>3</table>") == "Pie  3\nSum  3"
    assert html_text.render("<table><tr><td>a<p>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f</table>") == "a  c\nb\nd\ne  f"
    assert html_text.render("<math><mi>x</mi>=<mn>2</mn></math> <svg><text>label</text><desc>no</desc></svg>") == "x=2 label"
    assert html_text.render("<div style='visibility: hidden'>no<b style='visibility:visible'>yes</b></div><input type=submit value=Go><input type=checkbox value=no>") == "yes\nGo"
    assert html_text.render("<ul><li><p>one<p>two<li><ul><li>deep</ul><li></ul>after") == "- one\n  two\n- - deep\n\nafter"
    assert unescape("&amp;") == html_text.render("&amp;")


def test_op7(spark, docs):
    roots, sizes = brute_components([d.text for d in docs], 3, Fraction(9, 10))
    first = defaultdict(list)
    for d, root in zip(docs, roots):
        first[root].append(d.doc_id)
    got = {r.doc_id: r for r in queries.op7_ngrams(spark, DATA).collect()}
    for d, root, n in zip(docs, roots, sizes):
        assert (got[d.doc_id].component_id, got[d.doc_id].n_shingles) == (min(first[root]), n)


def test_op7_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = spark.createDataFrame([(None, text), (None, text + " more"), (6, text + " other"), (None, "alone in the world of words"), (9, None)], "doc_id long, text string")
    got = {r.n_shingles: r for r in ngram_join.link(rows).collect() if r.doc_id is None}
    assert got[76].component_id == got[77].component_id == 6 and got[2].component_id is None
    nulls = ngram_join.link(rows.where("doc_id is null")).collect()
    groups = defaultdict(list)
    for r in nulls:
        groups[r.group].append(r.n_shingles)
    assert sorted(map(sorted, groups.values())) == [[2], [76, 77]]


def test_op7_same_id_on_many_texts(spark):
    rows = spark.createDataFrame([(7, " ".join(f"x{k}_{j}" for j in range(30))) for k in range(300)], "doc_id long, text string")
    assert ngram_join.link(rows).select("group").distinct().count() == 300


def test_op8(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    weights, bias = url_filter.train(url_filter.labelled_urls())
    for r in queries.op8_urls(spark, DATA).collect():
        _, mark, rest = (urls[r.page_id] or "").partition("://")
        host = re.split("[/?#]", rest)[0] if mark else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        where = re.split("[?#]", rest[len(host) :])[0] if mark else ""
        fits = [(len(rule), rule, verdict) for verdict, rule in queries.URL_RULES if (host == (h := rule.partition("/")[0]) or host.endswith("." + h)) and where.startswith("/" + rule.partition("/")[2])]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        if verdict is None:
            verdict = "block" if url_filter._logits(weights, bias, [url_filter._string(host, where)])[0] > 0 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, where, rule, verdict)


def test_op8_long_and_no_urls(spark):
    rows = spark.createDataFrame([(1, "http://net/" + "a" * 300_000), (2, "://" * 50_000)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
    assert got[1].rule == "net/" and len(got[1].path) == 300_001 and got[2].host == ":"
    assert url_filter.judge_urls(rows.limit(0), queries.URL_RULES).count() == 0


def test_op10_scores(spark, docs):
    model = queries.quality_model(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op10_quality(spark, DATA).collect()}
    for d in docs[:60]:
        features, lengths, _ = quality_crf.line_features([(d.text or "").encode()])
        odds = features @ model.weights
        ahead = [(0.0, odds[0])]  # log weights of bad and good
        for x in odds[1:]:
            b, g = ahead[-1]
            ahead.append((np.logaddexp(b + model.stay, g), np.logaddexp(g + model.stay, b) + x))
        behind = [(0.0, 0.0)]
        for x in odds[:0:-1]:
            b, g = behind[-1][0], behind[-1][1] + x
            behind.append((np.logaddexp(b + model.stay, g), np.logaddexp(g + model.stay, b)))
        good = np.array([1 / (1 + np.exp((a[0] + z[0]) - (a[1] + z[1]))) for a, z in zip(ahead, reversed(behind))])
        mean = np.clip((good * lengths).sum() / lengths.sum(), 1e-4, 1 - 1e-4)
        assert got[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.bias))), abs=1e-4)


def test_op10_repeated_ids_and_bounds(spark, docs):
    rows = spark.createDataFrame([(d.doc_id % 20, d.text) for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3, "doc_id long, label int")
    model = quality_crf.fit(rows, labels, sample=10, chains=30)
    assert all(0 <= r.score <= 1 for r in quality_crf.score(rows, model).collect())


def test_stages(spark, docs):
    spent = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = {r.doc_id: r.score for r in queries.op10_quality(spark, DATA).collect()}
    kept = corpus_pipeline.stored(corpus_pipeline.quality(spark, spent, DATA), "quality")
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs if scores[d.doc_id] >= 0.7)

    roots, _ = brute_components([r.text for r in rows], 5, Fraction(4, 5))
    least = defaultdict(list)
    for r, root in zip(rows, roots):
        least[root].append(r.doc_id)
    kept = corpus_pipeline.stored(corpus_pipeline.near_duplicates(spark, kept, DATA), "near_duplicates")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, least.values()))

    before = {r.doc_id: r for r in pii.find(kept).collect()}
    clean = corpus_pipeline.stored(corpus_pipeline.personal_data(spark, kept, DATA), "personal_data")
    for r in clean.collect():
        text, at, out = before[r.doc_id].text, 0, ""
        spans = []
        for s in before[r.doc_id].pii:
            if spans and s.start < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], s.end)
            else:
                spans.append([s.start, s.end, s.kind])
        for start, end, kind in spans:
            out, at = out + text[at:start] + f"[{kind.upper()}]", end
        assert r.text == out + text[at:] and r.n_chars == len(r.text)

    mixed, listed = mixing.mix(clean.withColumn("number", F.col("doc_id")), row="number")
    uses = Counter(r.row for r in mixed.collect() if r.from_word == 0)
    uses.update({r.row: 1 for r in listed.collect() if r.size == 0})
    dealt = corpus_pipeline.stored(corpus_pipeline.mixture(spark, clean, DATA), "mixture")
    assert Counter(r.doc_id for r in dealt.collect()) == uses

    ids = bpe.ForcedBoundaryBpe(path())
    for r in corpus_pipeline.tokens(spark, dealt, DATA).join(clean.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(r.ids) and ids.decode(r.ids) == r.text


def test_mixture_of_repeated_ids_keeps_each_text_whole(spark):
    rows = spark.createDataFrame([(1, f"{k} " * (k + 1), "en", "a", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r.text for r in corpus_pipeline.mixture(spark, rows, DATA).collect())
    assert set(got) <= {r.text for r in rows.collect()} and max(got.values()) <= 2


def test_few_documents_take_one_pass(spark, docs, monkeypatch):
    """Fewer tables between steps, and so fewer of the driver's threads; the same links as in several passes."""
    made, kept = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name, *a, **b: made.append(name) or kept(df, name, *a, **b))
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    one = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(table).collect()}
    assert made.count("members") == 3 and made.count("overlaps") <= 2
    monkeypatch.setattr(ngram_join, "FEW", 0)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(table).collect()} == one
    assert made.count("members") == 3 + 6
