import hashlib
import random
import re

import numpy as np
import pytest
from compare import DATA, assert_same, connection
from pyspark.sql import functions as F

from packsight.llm import bpe, html_text, license_scan, line_rules, pii, quality_crf, queries, sql, url_filter

ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word " * 30_000), (5, "same text of ten words that is here to be read twice"), (6, "same text of ten words that is here to be read twice"), (6, "same text of ten words that is here to be read twice"), (7, "é漢字😀 a@b.co <|endoftext|> don't")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in ("ids", "score", "n", "sig", "keys", "found", "lines", "row", "size", "kind", "__found", "licence", "path")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), sql.ORACLE_SQL[name], connection())


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path())
    random.seed(4)
    alphabet = [*" \n\t\r'sdtlvABé漢字  　😀०१2.,!-_#", "<|endoftext|>", "'s", "'re", "  ", "\x85", "\x1c"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(3000)]
    own = bpe.ForcedBoundaryBpe(path())
    for t in texts:
        ids = np.frombuffer(own.encode(t.encode()), dtype=np.int32).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids and own.decode(ids) == t
    got = bpe.decode(bpe.encode(odd.drop("path"), path()), path(), text="back").collect()
    assert sorted((r.doc_id, r.back) for r in got) == sorted((i, t or "") for i, t in ODD)
    assert {tuple(r.ids) for r in got if r.doc_id in (1, 2)} == {()}
    assert bpe.decode(bpe.encode(none, path()), path()).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                found.append((m.start(), n, kind, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def test_pii_base_spans_equal_brute_force(spark, odd, none, model):
    random.seed(5)
    parts = [*"0123456789" * 2, *" -.@+()aB_%:=é\n", "4111111111111111", "127.0.0.1", "a@b.co", "+1 (234) 567-8901", "password=abcdef12", "DE89 3704 0044 0532 0130 00", "123-45-6789"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(800)] + ["1" * 20_000, "a" * 20_000, "1 " * 9000, "a@b.c" * 400, "1." * 9000, "+1 " * 4000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(rows, model=model).collect():
        assert [(s.start, s.kind, s.end) for s in r.pii if s.base] == [(a, k, e) for a, _, k, e in base_spans(r.text)]
        assert all(r.text[s.start : s.end] == s.value for s in r.pii)
    assert pii.find(odd, model=model).where("doc_id < 4 and size(pii) > 0").count() == 0
    assert pii.find(none, model=model).count() == 0


def test_pii_redaction_leaves_the_rest(spark, odd, model):
    rows = spark.createDataFrame([(1, "write a@b.co or +1 (234) 567-8901!"), (2, None), (3, ""), (4, "plain words only"), (5, "token = \"11acdfb36bb72224148e6160f674b4be45601bff\" end")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(rows, model=model).collect()}
    assert got == {1: "write [EMAIL] or [PHONE]!", 2: None, 3: "", 4: "plain words only", 5: "token = \"11acdfb36bb72224148e6160f674b4be45601bff\" end" if "[SECRET]" not in got[5] else "[SECRET] end"}
    assert "[SECRET]" in got[5]
    assert pii.redact(odd, model=model).columns == odd.columns


def test_pii_thresholds_reject_look_alikes(spark, model):
    rows = spark.createDataFrame([(1, "version 999.10.20.300 order no 8007782375593431")], "doc_id long, text string")
    assert pii.find(rows, model=model).first().pii == []


def test_line_rules_edges(spark, odd, none):
    got = {r.doc_id: r for r in line_rules.clean_lines(odd).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[2].kept
    assert got[4].n_words == 30_000 and got[4].n_repeat_words == 30_000 and got[4].base_failed
    assert got[5].kept and got[5].clean_text == ODD[4][1]
    assert line_rules.clean_lines(none).count() == 0


def test_line_rules_drop_bad_lines(spark):
    good = "A sentence of ordinary words that anybody could have written on a quiet day."
    other = "Later in the evening there was time for tea, a long walk and one more chapter."
    rows = spark.createDataFrame([(1, f"{good}\nHome | News | Sport | Shop | Help\n{other}"), (2, "\n".join(["Home | News | Sport | Shop | Help"] * 9 + [good]))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_rules.clean_lines(rows).collect()}
    assert got[1].kept and "Home" not in got[1].clean_text and not got[2].kept


def test_html_layout():
    page = "<head><title>no</title></head><nav><ul><li>One<li>Two<ol start=3><li>a<li>b</ol></ul></nav><p>Hello<p>x &amp; y<br>z<div hidden>no</div><table><tr><th>Name<th>Qty<tr><td>Pie<td>3</table><pre>a\n  b</pre><script>no</script>5 < 6"
    assert html_text.render(page) == "- One\n- Two\n  3. a\n  4. b\n\nHello\n\nx & y\nz\n\nName  Qty\nPie   3\n\na\n  b\n\n5 < 6"
    assert html_text.render("") == "" and html_text.render("<") == "<"
    assert html_text.render("<div>" * 20_000 + "deep") == "deep"


def test_html_text_is_complete():
    random.seed(6)
    tags = ["p", "div", "b", "li", "td", "tr", "table", "ul", "span", "h2", "a", "br"]
    for _ in range(300):
        words, page = [], ""
        for k in range(random.randint(1, 25)):
            page += random.choice([f"<{random.choice(tags)}>", f"</{random.choice(tags)}>", "<!-- c -->", f" w{k}x "])
            if page.endswith("x "):
                words.append(f"w{k}x")
        assert sorted(re.findall(r"w\d+x", html_text.render(page))) == sorted(words), page


def test_html_frames(spark, odd, none):
    got = html_text.extract(odd.withColumn("html", F.col("text"))).collect()
    assert {r.text for r in got if r.doc_id < 4} == {""} and len(got) == len(ODD)
    assert html_text.extract(none.withColumn("html", F.col("text"))).count() == 0


def test_licences_and_inheritance(spark, none):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [("r/LICENSE", apache), ("r/a/b/c.txt", "plain"), ("r/a/LICENSE", "Released under the MIT License"), ("r/a/b/d.txt", f"text\n{apache}\nmore text"), ("q/x.txt", "plain"), (None, apache), (None, "plain"), ("r/x.txt", None), ("r/x.txt", None), ("top.txt", "")]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({"score": F.lit("x"), "dir": F.lit("y")})
    got = sorted(((r.path, r.licence, r.licence_from) for r in license_scan.scan(files.withColumns({"file": F.lit(1), "up": F.lit(2), "best": F.lit(3)})).collect()), key=str)
    assert got == sorted([("r/LICENSE", "Apache-2.0", "r/LICENSE"), ("r/a/b/c.txt", "MIT", "r/a/LICENSE"), ("r/a/LICENSE", "MIT", "r/a/LICENSE"), ("r/a/b/d.txt", "Apache-2.0", "r/a/b/d.txt"), ("q/x.txt", None, None), (None, "Apache-2.0", None), (None, None, None), ("r/x.txt", "Apache-2.0", "r/LICENSE"), ("r/x.txt", "Apache-2.0", "r/LICENSE"), ("top.txt", None, None)], key=str)
    assert license_scan.scan(none.select(F.lit("p").alias("path"), "text")).count() == 0


def test_licence_anchors_change_nothing():
    texts = ["Licensed under CC BY 4.0", "this file is plain", "All rights reserved.", "the following files are free of charge", "under the terms of use", "GNU General Public License version 3"]
    m = license_scan.Matcher(license_scan.TEMPLATES, {}, 1000, license_scan.THRESHOLD)
    fast = [m.match(t)[:2] for t in texts]
    m.anchor = re.compile(r"[^\n]")
    assert fast == [m.match(t)[:2] for t in texts]


def test_url_parts_rules_and_verdicts(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.com/de/1", "https://x.org/fr/", "https://x.org", None, "no scheme", "https://m.ads-track.example.com/es/1", "https://net/", "https://planet/x", "https://WWW.library.Example/about"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: r for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(10)] == [("a.example.net", "/en/x", "example.net/en/"), ("example.com", "/de/1", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("x.org", "", None), ("", "", None), ("", "", None), ("m.ads-track.example.com", "/es/1", None), ("net", "/", "net/"), ("planet", "/x", None), ("www.library.example", "/about", None)]
    assert [got[k].verdict for k in (0, 1, 2, 6, 7, 9)] == ["allow", "block", "allow", "block", "block", "allow"]


def test_url_model_on_unseen_hosts():
    table = url_filter.labelled_urls()
    train = [t for k, t in enumerate(table) if k % 4]
    weights, bias = url_filter.train(train)
    held = [t for k, t in enumerate(table) if not k % 4]
    z = url_filter._logits(weights, bias, [url_filter._string(h, p) for h, p, _ in held])
    assert np.mean((z > 0) == np.array([label for *_, label in held])) > 0.9


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(7)
    counts = np.array([1, 4, 3])
    odds, stay = rng.normal(size=8), 0.7
    got, at = quality_crf._marginals(odds, stay, counts), 0
    for n in counts:
        o, total, good = odds[at : at + n], 0.0, np.zeros(n)
        for k in range(2**n):
            y = np.array([k >> j & 1 for j in range(n)])
            w = np.exp((o * y).sum() + stay * (y[1:] == y[:-1]).sum())
            total, good = total + w, good + w * y
        assert np.allclose(got[at : at + n], good / total)
        at += n
    assert np.isclose(quality_crf._log_z(odds[:1], stay, np.array([1])), np.logaddexp(odds[0], 0))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.op10_quality(spark, folder)
    known = spark.read.parquet(f"{folder}/labels.parquet").join(scored, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = [r.score for r in known if r.quality], [r.score for r in known if not r.quality]
    assert np.mean([(np.array(good) > b).mean() for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in known]) > 0.93


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (4, 0), (9, None)], "doc_id long, label int")
    model = quality_crf.fit(odd, labels)
    got = quality_crf.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = quality_crf.fit(none, labels)
    assert quality_crf.score(none, empty).count() == 0 and quality_crf.score(odd, empty).count() == len(ODD)


def test_held_out_rows(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), quality_crf.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_digest_columns(spark):
    row = queries.op5_bpe(spark, DATA).orderBy("doc_id").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><p>Hello", "Hello"),
        ("<html><head><title>t</title> Hello <b>there</b>", "Hello there"),
        ("<head><meta charset=utf-8><link rel=x href=y><style>p{}</style><script>a<b</script><noscript><p>no</p></noscript><div>one</div><p>two", "one\n\ntwo"),
        ("<html><head> <title>t</title>\n</head>\n<body><p>Hello</body>", "Hello"),
        ("<head><template><p>no</p></template><body>Hello", "Hello"),
    ],
)
def test_head_without_its_end_tag(page, text):
    assert html_text.render(page) == text


def test_pii_long_secrets_and_capitals(spark, model):
    secret = "eyJhbGciOiJIUzI1NiJ9." + "aB3dE5fG7h" * 40
    rows = spark.createDataFrame([(1, f"token = {secret} end"), (2, "JOHN [AT] MAIL [DOT] COM")], "doc_id long, text string")
    got = {r.doc_id: r for r in rows.select("doc_id", *(pii._matches(F.col("text"), k)["value"].alias(k) for k in ("secret", "email_spelled"))).collect()}
    assert got[1].secret == [f"token = {secret}"]
    assert got[2].email_spelled == ["JOHN [AT] MAIL [DOT] COM"]
    assert secret[-20:] not in pii.redact(rows, model=model).where("doc_id = 1").first().text
