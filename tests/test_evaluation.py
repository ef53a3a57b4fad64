import random

import pytest
from pyspark.sql import functions as F

from hushlake.operators import annotation_qa, ensemble, evaluation
from hushlake.operators.detectors import ModelDetector, PatternDetector, TokenRuleDetector
from hushlake.plans import jobs
from hushlake.sources.metrics import append_absent, append_method, combined, read_metrics, write_metrics

P, A = "PERSON", "AGE"


def rows(spark, spans, scope="d"):
    return spark.createDataFrame([(scope, s, e, t) for s, e, t in spans], "scope string, start long, end long, type string")


def counts(spark, gold, predicted, threshold=1.0):
    r = evaluation.overall_metrics(rows(spark, gold), rows(spark, predicted), threshold).first()
    return r.tp, r.tp + r.fn, r.tp + r.fp


MATCHES = [
    ([(10, 20, P), (30, 35, A)], [(10, 20, P), (30, 35, A)], 1.0, (2, 2, 2)),
    ([(10, 20, P)], [(11, 20, P)], 1.0, (1, 1, 1)),
    ([(10, 20, P)], [(10, 21, P)], 1.0, (1, 1, 1)),
    ([(10, 20, P)], [(11, 21, P)], 1.0, (0, 1, 1)),
    ([(10, 20, P)], [(11, 20, A)], 1.0, (0, 1, 1)),
    ([(10, 20, P)], [(12, 22, P)], 1.0, (0, 1, 1)),
    ([(10, 20, P)], [(15, 25, P)], 0.3, (1, 1, 1)),
    ([(10, 20, P)], [(10, 20, P), (10, 20, P)], 1.0, (1, 1, 1)),
    ([(10, 20, P), (11, 21, P)], [(11, 20, P)], 1.0, (1, 2, 1)),
    ([(0, 10, P), (2, 10, P)], [(0, 9, P), (3, 10, P)], 0.5, (2, 2, 2)),
]


@pytest.mark.parametrize("gold,predicted,threshold,expected", MATCHES)
def test_matching(spark, gold, predicted, threshold, expected):
    assert counts(spark, gold, predicted, threshold) == expected


@pytest.mark.parametrize("b,expected", [((10, 20), 1.0), ((25, 30), 0.0), ((15, 25), 1 / 3)])
def test_overlap_score(spark, b, expected):
    got = spark.range(1).select(evaluation.overlap_score(F.lit(10), F.lit(20), F.lit(b[0]), F.lit(b[1]))).first()[0]
    assert got == pytest.approx(expected)


def test_rates_by_type(spark):
    gold = rows(spark, [(10, 20, P), (30, 35, A), (40, 50, P)])
    predicted = rows(spark, [(10, 20, P), (32, 37, A), (60, 70, "LOCATION")])
    m = {r.entity_type: r for r in evaluation.metrics_by_type(gold, predicted).collect()}
    assert (m[P].tp, m[P].fp, m[P].fn, m[P].precision, m[P].recall) == (1, 0, 1, 1.0, 0.5)
    assert (m[A].tp, m[A].fp, m[A].fn) == (0, 1, 1) and (m["LOCATION"].fp, m["LOCATION"].class_proportion) == (1, 0.0)
    assert m[P].class_proportion == pytest.approx(2 / 3)
    assert (m["ALL_MICRO"].tp, m["ALL_MICRO"].fp, m["ALL_MICRO"].fn) == (1, 2, 2)
    assert m["ALL_MACRO"].f1 == pytest.approx(1 / 3)
    assert "accuracy" not in evaluation.metrics_by_type(gold, predicted).columns


def test_micro_and_macro_differ(spark):
    gold = rows(spark, [(10, 20, P), (30, 40, P), (50, 60, P), (70, 80, P), (90, 95, A)])
    m = {r.entity_type: r for r in evaluation.metrics_by_type(gold, rows(spark, [(10, 20, P), (30, 40, P)])).collect()}
    assert (m["ALL_MICRO"].precision, m["ALL_MICRO"].recall) == (1.0, 0.4) and m["ALL_MACRO"].f1 == pytest.approx(1 / 3)


def test_empty_sides_are_zero(spark):
    none, one = rows(spark, []), rows(spark, [(0, 1, P)])
    for g, p in ((none, none), (one, none), (none, one)):
        r = evaluation.overall_metrics(g, p).first()
        assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


ISLANDS = [
    ([(0, 4, P, "Иван"), (7, 10, P, "Ким")], [(0, 10, "Иван Ким")]),
    ([(0, 4, P, "Иван"), (8, 11, P, "Ким")], [(0, 4, "Иван"), (8, 11, "Ким")]),
    ([(0, 4, P, "Иван"), (5, 6, A, "5"), (7, 10, P, "Ким")], [(0, 4, "Иван"), (5, 6, "5"), (7, 10, "Ким")]),
    ([(0, 8, P, "Иван Ким"), (5, 8, P, "Ким")], [(0, 8, "Иван Ким")]),
]


@pytest.mark.parametrize("spans,expected", ISLANDS)
def test_names_merge(spark, spans, expected):
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,type:string,text:string>>")
    assert [(s.start, s.end, s.text) for s in df.select(evaluation.merge_names(F.col("s")).alias("m")).first().m] == expected
    islands = evaluation.name_islands(evaluation.span_rows(df.withColumn("doc_id", F.lit(1)), "s")).orderBy("start").collect()
    assert [(r.start, r.end) for r in islands] == [(a, b) for a, b, _ in expected]


def test_ages_are_trimmed(spark):
    df = spark.createDataFrame([("и мне 25 лет", [(2, 12, A, "мне 25 лет"), (0, 1, A, "и")])], "t string, s array<struct<start:int,end:int,type:string,text:string>>")
    got = df.select(evaluation.trim_ages(F.col("s"), F.col("t")).alias("x")).first().x
    assert [(s.start, s.end, s.text) for s in got] == [(6, 12, "25 лет"), (0, 1, "и")]


def test_scopes(spark):
    df = spark.createDataFrame([(1, [(0, 5, P, "")]), (2, [(0, 5, P, "")])], "doc_id long, spans array<struct<start:int,end:int,type:string,text:string>>")
    assert evaluation.span_rows(df).distinct().count() == 2 and evaluation.span_rows(df, pooled=True).distinct().count() == 1


VOTES = [(["natasha"], False), (["natasha", "regexp"], True), (["spacy", "bert"], True), (["regexp"], False), (["bert"], False)]


@pytest.mark.parametrize("sources,kept", VOTES)
def test_consensus(spark, sources, kept):
    names = list(ensemble.WEIGHTS)
    votes = sorted((0, 5, P, names.index(s), s, s) for s in sources)
    df = spark.createDataFrame([(votes,)], f"votes array<{ensemble.VOTE}>")
    got = df.select(ensemble.agreed(F.col("votes"), ensemble.WEIGHTS).alias("a")).first().a
    assert bool(got) is kept
    if kept:
        assert got[0].text == max(sources, key=ensemble.WEIGHTS.get)


def test_repeated_keys_and_spans_do_not_add_votes(spark):
    one, two = PatternDetector(types=["EMAIL"], name="one"), PatternDetector(types=["URL"], name="two")
    df = spark.createDataFrame([(1, "a@b.ru", "x"), (1, "a@b.ru", "y"), (1, None, "z"), (2, "", "w")], "doc_id long, text string, spans string")
    rows = ensemble.consensus(df, [one, two], {"one": 0.4, "two": 1.0}, 0.5)
    assert rows.count() == 4 and rows.where(F.size("spans") > 0).count() == 0
    again = df.select(ensemble.agreed(F.array(*[F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(P).alias("type"), F.lit(0).alias("source_order"), F.lit("one").alias("source"), F.lit(t).alias("text")) for t in "ab"]), {"one": 0.4, "two": 1.0}, 0.5).alias("a"))
    assert again.where(F.size("a") > 0).count() == 0
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_comparison_counts_errors_and_silent_texts(spark):
    def make():
        def model(texts):
            if any("fail" in t for t in texts):
                raise ValueError("no")
            return [[{"start": 0, "end": 1, "label": "PER"}] for _ in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "fail"), (3, None), (3, "b")], "doc_id long, text string")
    both = [ModelDetector([make], name="model"), PatternDetector()]
    r = {x.source: x for x in ensemble.compare_detectors(df, both).collect()}
    assert (r["model"].n_texts, r["model"].n_spans, r["model"].errors, r["model"].success_rate, r["model"].n_types) == (4, 2, 1, 0.75, 1)
    assert (r["regexp"].n_spans, r["regexp"].errors, r["regexp"].success_rate) == (0, 0, 1.0)
    texts = ensemble.analyse_texts(df, both).collect()
    assert len(texts) == 8 and [x.error for x in texts if x.doc_id == 2 and x.source == "model"] == ["ValueError: no"]
    assert ensemble.compare_detectors(df.limit(0), both).first().success_rate == 0.0
    assert ensemble.described(both, threshold=None)["consensus_enabled"] is False and ensemble.described(both)["weights"] == {"model": 1.0, "regexp": 0.7}


def test_greedy_equals_one_by_one(spark):
    rng = random.Random(8)
    some = lambda n: sorted({(s, s + rng.randint(1, 90), rng.choice([P, A])) for s in (rng.randint(0, 400) for _ in range(n))})
    gold, guess = some(80), some(80)

    def iou(a, b):
        both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
        return both / (a[1] - a[0] + b[1] - b[0] - both)

    for threshold in (0.2, 0.5):
        free, n = set(guess), 0
        for g in gold:
            best = max((x for x in free if x[2] == g[2] and iou(g, x) >= threshold), key=lambda x: (iou(g, x), -x[0], -x[1]), default=None)
            if best:
                free.discard(best)
                n += 1
        assert evaluation.match_spans(rows(spark, gold, "*"), rows(spark, guess, "*"), threshold).count() == n


def jobs_of(spark, action) -> int:
    """How many Spark jobs an action takes."""
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, "")
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_chain_of_any_length_takes_the_same_jobs(spark):
    def links(n):
        gold = spark.range(n).select(F.lit("d").alias("scope"), F.col("id").alias("start"), (F.col("id") + 10).alias("end"), F.lit(P).alias("type"))
        return gold, gold.withColumn("start", F.col("start") + 1)

    found = {}
    counted = {n: jobs_of(spark, lambda n=n: found.update({n: evaluation.match_spans(*links(n), 0.5).count()})) for n in (20, 10_000)}
    assert found == {20: 20, 10_000: 10_000} and counted[20] == counted[10_000]


def one_by_one(gold, guess, score, least):
    free, out = sorted(guess), []
    for g in sorted(gold):
        best = max((x for x in free if x[2] == g[2] and score(g, x) >= least), key=lambda x: (score(g, x), -x[0], -x[1]), default=None)
        if best:
            free.remove(best)
            out.append((*g[:2], *best[:2], g[2]))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.01, 0.3, 0.5, 0.9, 1.0])
def test_chains_and_ties_over_many_parts(spark, threshold):
    rng = random.Random(threshold)
    some = lambda n: {(s, s + rng.choice([0, 1, 2, 3, 8, 9, 200]), rng.choice([P, A])) for s in (rng.randint(0, 900) for _ in range(n))}
    gold, guess = some(700), some(700)
    iou = lambda a, b: evaluation.overlap(a[:2], b[:2])
    if threshold == 1.0:
        want = one_by_one(gold - guess, guess - gold, lambda a, b: evaluation.nearness(a[:2], b[:2]), 0) + [(a, b, a, b, t) for a, b, t in gold & guess]
    else:
        want = one_by_one(gold, guess, iou, threshold)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = evaluation.match_spans(rows(spark, sorted(gold)), rows(spark, sorted(guess)), threshold).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.start, r.end, r.p_start, r.p_end, r.type) for r in got) == sorted(want)


@pytest.mark.parametrize("most", [5, 60, 10**6])
@pytest.mark.parametrize("threshold", [0.4, 1.0])
def test_only_large_scopes_are_cut_into_islands(spark, monkeypatch, most, threshold):
    rng, calls = random.Random(4), []
    rows = [(f"d{k % 9}" if k % 2 else "big", s := rng.randint(0, 900), s + rng.randint(1, 25), rng.choice("AB")) for k in range(500)]
    moved = [(scope, s + rng.randint(-2, 2), e + rng.randint(0, 2), t) for scope, s, e, t in rows if rng.random() < 0.8]
    shape = "scope string, start long, end long, type string"
    gold, predicted = spark.createDataFrame(rows, shape), spark.createDataFrame(moved, shape)
    cut = evaluation.ordered.islands
    monkeypatch.setattr(evaluation.ordered, "islands", lambda *a, **k: calls.append(1) or cut(*a, **k))
    monkeypatch.setattr(evaluation, "MOST_IN_ORDER", 0)
    want = sorted(evaluation.match_spans(gold, predicted, threshold).collect())
    assert len(calls) == 1 and len(want) > 100
    monkeypatch.setattr(evaluation, "MOST_IN_ORDER", most)
    assert sorted(evaluation.match_spans(gold, predicted, threshold).collect()) == want
    assert len(calls) == (2 if most < 100 else 1)


def test_spans_with_nulls_match_nothing(spark):
    holes = spark.createDataFrame([(None, 0, 5, P), ("d", None, 5, P), ("d", 0, None, P), ("d", 0, 5, None), ("d", 0, 5, P)], "scope string, start long, end long, type string")
    assert [tuple(r) for r in evaluation.match_spans(holes, holes, 0.5).select("start", "end", "p_start", "p_end").collect()] == [(0, 5, 0, 5)]


def test_pooled_names_need_no_window_over_the_scope(spark):
    rng = random.Random(6)
    spans = [(s, s + rng.choice([1, 2, 3, -9]), rng.choice([P, P, P, A])) for s in (rng.randint(0, 3000) for _ in range(2500))] + [(7, 9, P)] * 900 + [(8, 9, A)] * 900
    want, last = [], None
    for s, e, t in sorted(spans):
        if last and last[2] == t == P and s <= last[1] + evaluation.NAME_GAP:
            last[1], last[3] = e, last[3] + 1
        else:
            last = [s, e, t, 1]
            want.append(last)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        islands = evaluation.name_islands(rows(spark, spans, "*").repartition(5))
        got = sorted((r.start, r.end, r.type, r.members) for r in islands.collect())
        assert "Window [" not in islands._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(tuple, want))
    assert evaluation.name_islands(rows(spark, [])).count() == 0


def test_islands_that_fill_whole_parts(spark):
    from hushlake.operators import ordered

    df = spark.createDataFrame([("a", i, 5000 if i == 3 else i + 1) for i in range(2000)] + [("b", i, i) for i in range(50)], "g string, start long, reach long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ordered.islands(df, ["g"], ["start", "reach"], "reach").groupBy("g", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("at"), F.count_distinct("part").alias("parts")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.g, r.at, r.n) for r in found) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 1997), *[("b", i, 1) for i in range(50)]]
    assert max(r.parts for r in found) > 1


def test_evaluation_job_and_metric_files(spark, tmp_path):
    text = "мне 25 лет, a@b.ru"
    dialogs = spark.createDataFrame([(1, text, [(4, 10, A, "25 лет"), (12, 18, "EMAIL", "a@b.ru")])], "id long, text string, entities array<struct<start:long,end:long,type:string,text:string>>")
    metrics = jobs.evaluate(dialogs, [PatternDetector(), TokenRuleDetector()])
    jobs.show_ranking(metrics)
    t = jobs.timed(dialogs, [PatternDetector()]).first()
    assert t.n_texts == 1 and t.total_seconds > 0
    best = evaluation.ranking(metrics).first()
    assert (best.method, best.f1) == ("regexp", 1.0)
    write_metrics(metrics, f"{tmp_path}/m")
    table = read_metrics(spark, f"{tmp_path}/m")
    assert table.count() == metrics.count()
    assert append_absent(table, table).count() == table.count()
    more = combined({"new": metrics.where("method = 'regexp'").drop("method")})
    assert append_absent(table, more).where("method = 'new'").count() == more.count()


def test_a_method_is_appended_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    metrics = evaluation.metrics_by_type(rows(spark, [(0, 5, P)]), rows(spark, [(0, 5, P)]))
    path = f"{tmp_path}/table"
    assert append_method(metrics, "one", path) is False and not (tmp_path / "table").exists()
    write_metrics(combined({"base": metrics}), path)
    assert append_method(metrics, "base", path) is False and append_method(metrics, "one", path) is True and append_method(metrics, "one", f"file://{path}") is False
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda m: append_method(metrics, m, path), ["two", "three", "two", "three", "two", "a/b ü"]))
    assert sum(done) == 3 and done[5]
    table = read_metrics(spark, path)
    assert {(r.method, r.n) for r in table.groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()} == {(m, metrics.count()) for m in ("base", "one", "two", "three", "a/b ü")}
    assert table.where("method = 'two'").drop("method").exceptAll(metrics.select(table.columns[1:])).count() == 0
    assert not [p for p in (tmp_path / "table").iterdir() if p.is_dir()]


def test_annotation_quality(spark):
    shape = "id long, text string, has_pd boolean, entities array<struct<start:long,end:long,type:string,text:string>>, pos int"
    original = spark.createDataFrame([(1, "Иван тут", False, [], 0), (2, "нет", True, [], 1), (3, "x", None, [], 2)], shape)
    annotated = spark.createDataFrame([(1, "Иван тут", True, [(0, 4, P, "Иван"), (5, 8, P, "там")], 0), (2, "нет!", False, [], 1), (9, "y", True, [(0, 1, P, "y")], 2), (1, "old", True, [], -1)], shape)
    last = annotation_qa.last_of_each_id(annotated)
    r = annotation_qa.annotation_quality(original, last).first()
    assert (r.total, r.annotated, r.text_changes, r.position_errors, r.false_to_true, r.true_to_false, r.valid_entities, r.quality) == (3, 1, 1, 1, 1, 1, 1, "ХОРОШЕЕ")
    assert annotation_qa.annotation_quality(original.unionByName(original.where("id = 1").withColumn("text", F.lit("x")).withColumn("pos", F.lit(-5))), last).first() == r
    assert [(x.type, x.n) for x in annotation_qa.annotation_types(original, last).collect()] == [(P, 1)]
    assert [(x.id, x.kind) for x in annotation_qa.annotation_issues(original, last).collect()] == [(1, "position"), (2, "text")]
    assert annotation_qa.annotation_issues(original, last, 1).count() == 1
    assert annotation_qa.annotation_quality(original, last.limit(0)).first().quality == "ОТЛИЧНОЕ"
