import random
import re
from collections import Counter

from helpers_llm import awkward, clean_rows, documents, prose
from pyspark.sql import Window
from pyspark.sql import functions as F

from redpen.llm import quality, urls

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/in", "block"), ("org", "", "block"), ("example.org", "/a", "allow"),
]


def judged(page_id, url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, False, None, "allow"))
    return page_id, url, host, path, best[3], best[4]


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, "h", "p", "x") for i, u in rows], "page_id long, url string, host string, path string, short_hash string"
    )


def test_urls_against_brute_force(spark):
    draw = random.Random(1)
    rows = [
        (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://"), (5, "http://COM/"), (6, "x://a.Example.com/en/1?q=/fr/#top"),
        (7, "https://www.example.com/en/"), (7, "https://www.example.com/en/"), (None, "http://b.net/fr/index"),
        (8, "http://b.net/fr/other"), (9, "http://example.org/abc"), (10, "http://example.org?x=1"),
        (11, "http://netcom/es/"), (12, "http://a.net/es/" + "x/" * 3000), (13, "http://" + "a." * 200 + "com/#"),
        (14, "https://example.com#://net/es/"), (15, "http://é.com/en/ü"), (16, "a\n://b.net/es/\n"),
    ]
    rows += [
        (100 + i, f"http://{draw.choice(['', 'www.', 'm.'])}{draw.choice(['example', 'b'])}.{draw.choice(['com', 'net', 'org'])}"
                  f"{draw.choice(['', '/', '/en', '/en/', '/es/x', '/fr/i', '/fr/in', '/a/b'])}") for i in range(100)
    ]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge_urls(pages(spark, rows), rules).collect()
    assert clean_rows(got) == clean_rows([judged(*r) for r in rows])


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.judge_urls(pages(spark, [(1, "http://a.com/b")]), none).collect()
    assert [tuple(r) for r in got] == [(1, "http://a.com/b", "a.com", "/b", None, "allow")]
    assert urls.judge_urls(pages(spark, []), none).collect() == []


def base(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_base_and_verdict(spark):
    good = [(100 + i, prose(i, 150)) for i in range(60)]
    junk = [(200 + i, re.sub(r"\s", "!! | ", prose(i, 150)).upper()) for i in range(12)]
    rows = awkward() + good + junk + [(300, "a line\nb line\na line\n\n\na line"), (301, "* # | <x>")]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:40]] + [(i, 0) for i, _ in junk] + [(None, 1)], "doc_id long, quality int")
    got = quality.judge_quality(documents(spark, rows), labels).collect()
    assert clean_rows([(r.doc_id, *r[1:6], r.base_failed) for r in got]) == clean_rows([(i, *base(t)) for i, t in rows])
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in junk}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge_quality(documents(spark, [(1, prose(1, 50)), (2, None)]), none).collect()
    assert {(r.doc_id, r.kept, r.score) for r in got} == {(1, True, 0.0), (2, False, 0.0)}
    assert quality.judge_quality(documents(spark, []), none).collect() == []


def test_every_trusted_document_counts(spark):
    """Of 20,040 trusted documents the 40 that any bound by hash would leave out have words of their own."""
    ids = spark.range(20_040).select(F.col("id").alias("doc_id"))
    ids = ids.withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    late = F.col("at") > 20_000
    text = F.when(late, " ".join(f"late{i}" for i in range(12))).otherwise(" ".join(f"early{i}" for i in range(12)))
    docs = ids.select("doc_id", text.alias("text"), late.alias("late"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"))
    got = quality.judge_quality(docs.drop("late"), labels).join(docs, "doc_id").where("late").collect()
    assert len(got) == 40 and all(r.score > -0.1 and r.kept for r in got)


def test_quality_joins_alike_at_every_size(spark):
    # A broadcast of the ids for few labels only made disk grow faster than the input.
    rows = [(i, prose(i, 60) + " #" * (i % 3)) for i in range(30)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    hinted = []
    plain = type(docs).hint
    try:
        type(docs).hint = lambda self, name, *rest: hinted.append(name) or plain(self, name, *rest)
        got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    finally:
        type(docs).hint = plain
    assert hinted == ["merge"] and all(got[i].n_symbols == i % 3 for i, _ in rows)


def test_repeated_windows_at_any_distance(spark):
    words = "a b c d e".split()
    for gap in range(0, 9):
        text = " ".join([*words, *[f"w{i}" for i in range(gap)], *words])
        row = documents(spark, [(1, text)]).select(quality.base_measures(F.col("text"))["n_repeat_words"].alias("n")).first()
        assert row.n == 10, gap
    for text in ("a b c d", "a b c d e", "a b c d e f", "e d c b a b c d e", ""):
        row = documents(spark, [(1, text)]).select(quality.base_measures(F.col("text"))["n_repeat_words"].alias("n")).first()
        assert row.n == 0, text
