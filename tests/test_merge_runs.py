import datetime
import random
import statistics

from pyspark.sql import functions as F

from redpen.functions import scores as S
from redpen.operators import classify, fanout, merge, runs
from redpen.operators import correctors as C
from redpen.operators.skew import SHARES, hot_keys, key_counts, running_total, spread_join
from redpen.plans import check

MATCH = "doc_id long, sent_idx int, corrector_idx int, match_idx int, offset int, length int, replacement string"


def test_distinct_and_order(spark):
    rows = [(1, 0, 0, 0, 2, 5, "boats"), (1, 0, 1, 0, 9, 2, "at"), (1, 0, 1, 1, 2, 5, "boats"), (1, 0, 1, 2, 2, 5, "ships")]
    df = merge.order_matches(merge.distinct_matches(spark.createDataFrame(rows, MATCH), ["doc_id", "sent_idx"]), ["doc_id", "sent_idx"])
    got = [(r.offset, r.replacement, r.corrector_idx) for r in df.orderBy("rank").collect()]
    assert got == [(2, "boats", 0), (2, "ships", 1), (9, "at", 1)]


def test_no_correctors_gives_empty_results(spark):
    df = spark.createDataFrame([(1, 0, "en", "some text")], "doc_id long, sent_idx int, lang string, text string")
    assert check.check_sentences(df, []).first().matches == []


def test_failing_corrector_leaves_the_others(spark):
    def broken():
        def run(texts):
            raise RuntimeError("down")
        return run

    bad = C.Corrector("bad", kind="openai", batch_function=broken)
    good = C.Corrector("good", rules=[("was", "were")])
    df = spark.createDataFrame([(1, 0, "en", "they was late again this morning")], "doc_id long, sent_idx int, lang string, text string")
    row = check.check_sentences(df, [bad, good]).first()
    assert [(m.replacement, m.rule_id, m.corrector_idx) for m in row.matches] == [("were", "good", 1)]
    assert [(e.rule_id, "down" in e.error) for e in row.errors] == [("bad", True)]


def test_every_sentence_stays(spark):
    rows = [(1, 0, "en", "they was late"), (1, 1, None, "they was late"), (2, 0, "fr", "was was"), (3, 0, "en", None), (4, 0, "en", "was " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, lang string, text string")
    good = C.Corrector("good", rules=[("was", "were")])
    got = {(r.doc_id, r.sent_idx): len(r.matches) for r in check.check_sentences(df, [good]).collect()}
    assert len(got) == 5 and got[1, 0] == got[1, 1] == 1 and got[4, 0] == 400
    asked = check.check_sentences(df, [good], language="^en", max_length=100)
    assert {(r.doc_id, r.sent_idx): len(r.matches) for r in asked.collect()} == {(1, 0): 1, (1, 1): 0, (2, 0): 0, (3, 0): 0, (4, 0): 0}


def test_null_keys_stay_in_run_reports(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, k, start + datetime.timedelta(seconds=i), True, float(i), i) for k in (None, "a") for i in range(9)]
    calls = spark.createDataFrame(rows, "run_id string, rule_id string, ts timestamp, ok boolean, latency_ms double, call_id long")
    assert {r.rule_id for r in runs.latency_percentiles(calls, [0.5]).collect()} == {None, "a"}
    left = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    right = spark.createDataFrame([(None, "n"), (1, "o")], "k int, y string")
    assert {(r.k, r.x, r.y) for r in spread_join(left, right, ["k"]).collect()} == {(None, 1, "n"), (1, 2, "o")}


def test_batch_function_isolates_failures_and_fills_empty_output(spark):
    def factory():
        def run(texts):
            assert len(texts) <= 3
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return ["" if t == "empty" else t.upper() for t in texts]
        return run

    df = spark.createDataFrame([("a",), ("bad",), ("empty",), ("d",)], "text string").coalesce(1)
    out = {r.text: r for r in C.rewrite_batches(df, factory, prompt="text", batch_size=3).collect()}
    assert out["a"].corrected == "A" and out["empty"].corrected == "empty" and out["d"].corrected == "D"
    assert out["bad"].corrected is None and "no" in out["bad"].error and out["a"].error is None


def test_registry_defaults():
    assert C.Corrector("m").effective_rule_id == "m"
    assert C.Corrector("m", kind="coedit").template == "Fix grammatical errors: {{ text }}"
    assert C.Corrector("m", kind="text2text").template is None


def test_spread_join_with_one_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(6000)]
    left = spark.createDataFrame(rows, "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    hot = hot_keys(key_counts(left, ["k"]), ["k"]).collect()
    assert [h.k for h in hot] == ["hot"] and 100 < hot[0]["_parts"] <= SHARES
    out = spread_join(left, right, ["k"], "left")
    assert out.count() == 6000
    assert out.agg(F.sum("v")).first()[0] == 2000 + 2
    assert spread_join(left, right, ["k"]).count() == 2001
    assert spread_join(left, right, ["k"], "left_anti").count() == 6000 - 2001


def test_once_per_text_computes_each_text_once(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(500)], "id int, text string")
    seen = []

    def compute(texts):
        seen.append(texts)
        return texts.withColumn("n", F.length("text"))

    out = fanout.once_per_text(df, compute)
    assert out.count() == 500 and seen[0].count() == 251
    assert out.where(F.col("n") != F.length("text")).count() == 0


def test_reuse_splits_hits_and_misses(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    cache = spark.createDataFrame([("a", "cached"), ("z", "old")], "text string, out string")
    results, refilled = fanout.reuse(req, cache, lambda t: t.withColumn("out", F.upper("text")))
    assert {(r.id, r.out, r.hit) for r in results.collect()} == {(1, "cached", True), (3, "cached", True), (2, "B", False)}
    assert {(r.text, r.out) for r in refilled.collect()} == {("a", "cached"), ("z", "old"), ("b", "B")}


def test_running_total_over_levels(spark):
    rng = random.Random(3)
    rows = [("r" if rng.random() < 0.7 else None, t, rng.randrange(5)) for t in rng.sample(range(100000), 800)]
    df = spark.createDataFrame(rows, "k string, t int, n int").withColumns(
        {"coarse": F.floor(F.col("t") / 10000), "fine": F.floor(F.col("t") / 500)})
    for r in running_total(df, ["k"], ["coarse", "fine"], "t", "n", "sum").collect():
        assert r["sum"] == sum(n for k, t, n in rows if k == r.k and t <= r.t)


def calls(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    data = [(run, i, rule, start + datetime.timedelta(seconds=s), ok, lat) for i, (run, rule, s, ok, lat) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, call_id long, rule_id string, ts timestamp, ok boolean, latency_ms double")


def test_running_throughput_with_ties(spark):
    rows = [("r", "x", 0, True, 1.0)] * 10 + [("r", "x", 5, True, 1.0)] * 250 + [("r", "x", 100000, True, 1.0)] * 7
    got = sorted((r.completed, r.elapsed_s) for r in runs.running_throughput(calls(spark, rows)).collect())
    assert got == [(100, 5.0), (200, 5.0), (267, 100000.0)]


def test_failure_rates_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("r", rng.choice("ab"), rng.randrange(2000), rng.random() > 0.4, 1.0) for _ in range(1500)]
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    for r in runs.failure_rates(calls(spark, rows), 60, 10, 50.0).collect():
        seen = [ok for _, rule, s, ok, _ in rows if rule == r.rule_id and r.second - 60 < base + s <= r.second]
        assert (r.calls, r.failures) == (len(seen), seen.count(False))
        assert r.open == (len(seen) >= 10 and seen.count(False) * 2 >= len(seen))


def test_percentiles_exact_on_a_large_key(spark):
    rng = random.Random(9)
    rows = [("r", "big", 0, True, rng.lognormvariate(3, 1)) for _ in range(30000)]
    rows += [("r", "small", 0, True, float(v)) for v in (5, 1, 3)]
    out = {(r.rule_id, r.point): r for r in runs.latency_percentiles(calls(spark, rows).repartition(4), [0.25, 0.5, 0.99]).collect()}
    for rule in ("big", "small"):
        v = sorted(x[4] for x in rows if x[1] == rule)
        for p in (0.25, 0.5, 0.99):
            at = p * (len(v) - 1)
            lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert abs(out[rule, p].value - (lo + (hi - lo) * (at - int(at)))) < 1e-9
    assert out["small", 0.5].value == statistics.median([5, 1, 3])


FEATURE = "text string, matches array<struct<offset:int,length:int,replacement:string>>"


def test_features_golden(spark):
    o, c = "<|start_of_replace|>", "<|end_of_replace|>"
    df = spark.createDataFrame([("We saw a owl.", [(9, 3, "an owl")]), ("She run to harbour.", [(4, 3, "runs"), (11, 7, "the harbour")])], FEATURE)
    got = [r.feature for r in classify.features_per_match(df).collect()]
    assert got == [
        f"We saw a <CLS>{o}owl<SEP>an owl{c}.",
        f"She <CLS>{o}run<SEP>runs{c} to {o}harbour<SEP>the harbour{c}.",
        f"She {o}run<SEP>runs{c} to <CLS>{o}harbour<SEP>the harbour{c}.",
    ]
    one = df.select(classify.feature(F.col("text"), F.col("matches"), F.lit(0))).first()[0]
    assert one == got[0]


def test_features_follow_given_order_even_with_overlaps(spark):
    def walk(text, matches, idx):
        out, at = [], 0
        for i, (off, n, new) in enumerate(matches):
            if off > at:
                out.append(text[at:off])
            out.append(("<CLS>" if i == idx else "") + f"<|start_of_replace|>{text[off:off+n]}<SEP>{new}<|end_of_replace|>")
            at = off + n
        return "".join(out) + (text[at:] if at < len(text) else "")

    ms = [(4, 3, "x"), (0, 9, "y"), (5, 1, "z"), (10, 2, "q")]
    df = spark.createDataFrame([("some text to mark", ms)], FEATURE)
    got = [r.feature for r in classify.features_per_match(df).orderBy("selected").collect()]
    assert got == [walk("some text to mark", ms, i) for i in range(4)]
    kept = df.select(classify.without_overlaps(F.col("matches")).alias("m")).first().m
    assert [tuple(m) for m in kept] == [(0, 9, "y"), (10, 2, "q")]


def test_scores_golden(spark):
    df = spark.createDataFrame([([0.0, 1.0],)], "logits array<double>")
    row = classify.best_label(classify.with_probabilities(df), {0: "NEGATIVE", 1: "POSITIVE"}).first()
    assert row.label == "POSITIVE" and abs(row.score - 0.731) < 1e-3
    import math
    logit = lambda p: math.log(p / (1 - p))
    cal = [([0.0, 0.0], logit(0.8)), ([0.0, 0.0], logit(0.4))]
    top = classify.top_labels(classify.with_probabilities(df, cal), 2, {0: "A", 1: "B"}).orderBy("rank").collect()
    assert [t.label for t in top] == ["A", "B"] and abs(top[0].score - 2 / 3) < 1e-9 and abs(top[1].score - 1 / 3) < 1e-9
    tie = spark.createDataFrame([([0.5, 0.5],)], "probs array<double>")
    assert classify.top_labels(tie).first().class_id == 0


def test_parsed_output(spark):
    cases = ['{"label": "none", "score": 0.55}', "{broken", "", None]
    got = [tuple(r.o) for r in spark.createDataFrame([(c,) for c in cases], "p string").select(S.parsed_output(F.col("p")).alias("o")).collect()]
    assert got == [("none", 0.55)] + [("unknown", 0.0)] * 3


def test_tags_in_passes(spark):
    s = spark.createDataFrame([(1, "he go to the school"), (2, "fine text")], "id long, text string")
    t = spark.createDataFrame([
        (1, 1, 1, "$REPLACE_goes", 0.9, 0.9), (1, 1, 3, "$DELETE", 0.6, 0.9), (1, 1, 3, "$KEEP", 0.5, 0.9),
        (1, 2, 0, "$APPEND_never_ever", 0.9, 0.9), (1, 3, 0, "$DELETE", 0.9, 0.1), (1, 9, 0, "$DELETE", 0.9, 0.9),
    ], "id long, pass_no int, pos int, tag string, prob double, p_error double")
    out = {r.id: r.corrected for r in C.apply_tags(s, t, ["id"], 0.0, 0.5).collect()}
    assert out == {1: "he never_ever goes to school", 2: "fine text"}
    biased = C.apply_tags(s, t, ["id"], 0.2, 0.5).where("id = 1").first().corrected
    assert biased == "he never_ever goes to the school"
