import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgermint.operators import boosting, calibration, dataset, embedding, evaluate, jobs, learn, ml, resolve, similarity, tuning, vote


# --- similarity joins -----------------------------------------------------------------------------------
FIRST = "apex blue cedar delta ember frost grand haven iron jade kite lunar maple north ocean pearl quartz river solar terra ultra vivid willow xenon young zenith".split()
SECOND = "foods stores travels motors pharma cinemas traders telecom bakery fuels books garments sweets optics hotels dairy electricals stationers jewellers finance".split()


def names_of(rng, n):
    return sorted({f"{rng.choice(FIRST)} {rng.choice(SECOND)} {rng.randrange(100, 999)}".upper() for _ in range(3 * n)})[:: 2][:n]


def test_jaccard_pairs_lose_nothing(spark):
    rng = random.Random(2)
    names, texts = names_of(rng, 150), names_of(rng, 150) + ["", "A", "AB", "ABC"]
    grams = lambda s: {s.replace(" ", "")[i : i + 3] for i in range(max(1, len(s.replace(" ", "")) - 2))}
    n = spark.createDataFrame([(x, i) for i, x in enumerate([*names, "AB"])], "alias string, row_pos int")
    t = spark.createDataFrame([(x,) for x in texts], "clean string")
    for threshold in (0.3, 0.5, 0.7, 1.0):
        got = {(r.clean, r.alias): r.score for r in similarity.jaccard_pairs(t, n, threshold, "clean", 200).collect()}
        want = {(x, y): s for x in texts for y in [*names, "AB"] if (s := len(grams(x) & grams(y)) / len(grams(x) | grams(y))) >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sequence_pairs_lose_nothing_and_are_few(spark):
    rng = random.Random(3)
    names = [*names_of(rng, 60), "AB", "PVR", "UBER", "DMART"]
    changed = ["".join(c for c in x if rng.random() > 0.15) or "B" for x in names]
    texts = sorted({*names_of(rng, 60), *changed, "A", "ABBA", "PVR CINEMAS", "X" * 300})
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "alias string, row_pos int")
    t = spark.createDataFrame([(x,) for x in texts], "clean string")
    for threshold in (0.5, 0.7, 0.8, 0.95):
        pairs = similarity.sequence_pairs(t, n, threshold, "clean", 100).collect()
        got = {(r.clean, r.alias) for r in pairs}
        want = {(x, y) for x in texts for y in names if SequenceMatcher(None, x, y).ratio() >= threshold}
        assert want <= got and len(got) == len(pairs), threshold


def test_candidates_of_many_names_stay_near_the_matches(spark):
    rng = random.Random(5)
    names, texts = names_of(rng, 600), names_of(random.Random(6), 600)
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "alias string, row_pos int")
    t = spark.createDataFrame([(x,) for x in texts], "clean string")
    for threshold in (0.8, 0.7):
        pairs = similarity.sequence_pairs(t, n, threshold, "clean", 600).count()
        matches = resolve.fuzzy_matches(t, n, threshold, n=600).count()
        assert matches <= pairs <= 5 * matches, (threshold, pairs, matches)


# --- weights of the vote -----------------------------------------------------------------------------------
def test_weight_search_is_the_vote_and_the_report_of_every_vector(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice(["a", "b", "c", None])
    rows = [(i, rng.choice("abc"), *[x for _ in range(4) for x in (pick(), round(rng.random(), 3))]) for i in range(400)]
    votes = spark.createDataFrame(rows, "txn_key int, label string, mcc_category string, mcc_conf double, rule_category string, rule_conf double, ml_category string, ml_conf double, llm_category string, llm_conf double")
    grid = tuning.weight_grid(0.5)
    assert len(grid) == 10 and all(abs(sum(g.values()) - 1) < 1e-9 for g in grid)
    got = {r.vector: r for r in tuning.judged_weights(votes, grid).collect()}
    for i, weights in enumerate(grid):
        voted = vote.vote(votes, vote.Config(**weights)).withColumn("pred", F.col("vote.category"))
        want = evaluate.summary(evaluate.class_report(voted)).first()
        assert (got[i].macro_f1, got[i].accuracy) == (pytest.approx(want.macro_f1, abs=2e-6), want.accuracy) and got[i].rows == 400
    best = tuning.best_weights(tuning.judged_weights(votes, grid)).first()
    assert best.macro_f1 == max(g.macro_f1 for g in got.values())
    assert tuning.judged_weights(votes.limit(0), grid).count() == 0


# --- boosting ------------------------------------------------------------------------------------------------
def brute_split(x, g, h, l2, least):
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for b in range(x[:, j].max()):
            left = x[:, j] <= b
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
            if gain > best[0] + 1e-9:
                best = (gain, j, b)
    return best


def test_first_trees_split_as_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 8, (300, 5)).astype(float), rng.integers(0, 3, 300), rng.integers(1, 4, 300).astype(float)
    y[x[:, 2] > 5] = 1
    rows = spark.createDataFrame(pd.DataFrame({"label": [f"c{k}" for k in y], "features": x.tolist(), "w": w})).repartition(3)
    model = boosting.fit(rows, weight="w", rounds=1, depth=2, bins=8, l2=1.0, least=1e-3)
    bins = model.binned(x).astype(int)
    p, splits = boosting.softmax(np.tile(model.base, (300, 1))), 0
    for k, tree in enumerate(model.rounds[0]):
        g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
        for node, inside in ((0, np.ones(300, bool)), (1, bins[:, tree.feature[0]] <= tree.bin[0]), (2, bins[:, tree.feature[0]] > tree.bin[0])):
            if not inside.any() or node and tree.feature[0] < 0:
                continue
            gain, j, b = brute_split(bins[inside], g[inside], h[inside], 1.0, 1e-3)
            gains = boosting.split_gains(*[np.array([np.bincount(bins[inside, f], v[inside], 8) for f in range(5)]) for v in (g, h)], 1.0, 1e-3)
            if not gain:
                assert tree.feature[node] < 0
                continue
            assert gains[tree.feature[node], tree.bin[node]] == pytest.approx(gain)
            splits += 1
            left = inside & (bins[:, tree.feature[node]] <= tree.bin[node])
            assert tree.value[2 * node + 1] == pytest.approx(-0.3 * g[left].sum() / (h[left].sum() + 1.0))
    assert splits >= 6


def test_boosting_learns_what_no_single_feature_says(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    rows = spark.createDataFrame(pd.DataFrame({"txn_key": range(900), "label": [f"c{k}" for k in y], "features": x.tolist()}))
    trained = jobs.train(ml.vectors(rows.withColumnRenamed("features", "embedding")), kind="boosted", vector="vector", rounds=12, depth=3, bins=16)
    assert trained.metrics.first().accuracy > 0.85
    jobs.save(trained.model, f"{tmp_path}/m", spark)
    again = jobs.load(f"{tmp_path}/m", boosted=True)
    scored = ml.vectors(rows.withColumnRenamed("features", "embedding"))
    a, b = (jobs.score(scored, m).orderBy("txn_key").select("ml_category", "ml_conf").collect() for m in (trained.model, again))
    assert a == b
    top = ml.importance(spark, trained.model, ["f0", "f1", "f2", "f3"]).collect()
    assert {r.feature for r in top[:3]} == {"f0", "f1", "f2"} and sum(r.importance for r in top) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        boosting.fit(rows.limit(0))


# --- calibration ---------------------------------------------------------------------------------------------
def brute_isotonic(x, y):
    """The least squares monotone fit by its min-max formula."""
    order = np.argsort(x, kind="stable")
    v = y[order]
    n = len(v)
    mean = lambda a, b: v[a : b + 1].mean()
    out = np.empty(n)
    out[order] = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    return out


def test_curves_are_the_isotonic_regression_of_each_class(spark):
    rng = np.random.default_rng(3)
    n = 120
    p = np.round(rng.choice(np.arange(1, 1000), (n, 1), replace=False) / 1000 + 0.0004, 6)
    p = np.hstack([p, 1 - p])
    y = np.where(rng.random(n) < p[:, 0] ** 2, "a", "b")
    rows = spark.createDataFrame(pd.DataFrame({"k": range(n), "label": y, "probability": p.tolist()}))
    curves = calibration.isotonic(calibration.step_sums(rows, ["a", "b"]))
    points = {r["class"]: [(q.x, q.y) for q in r.points] for r in calibration.curve_points(curves).collect()}
    for j, name in enumerate("ab"):
        xs, ys = zip(*points[name])
        assert list(xs) == sorted(xs) and all(b >= a - 1e-12 for a, b in zip(ys, ys[1:]))
        assert np.allclose(np.interp(p[:, j], xs, ys), brute_isotonic(p[:, j], (y == name).astype(float)), atol=1e-9)
    made = calibration.calibrated(rows, curves, ["a", "b"]).orderBy("k").collect()
    raw = np.array([np.interp(p[:, j], *zip(*points[c])) for j, c in enumerate("ab")]).T
    total = raw.sum(1, keepdims=True)
    assert np.allclose([r.calibrated for r in made], np.where(total > 0, raw / np.where(total > 0, total, 1), p))


def test_scores_are_out_of_fold(spark):
    """Labels are noise, keys are features: a model that has seen a row knows it, one that has not does not."""
    rng = np.random.default_rng(4)
    rows = ml.vectors(spark.createDataFrame(pd.DataFrame({"txn_key": range(300), "label": rng.choice(["a", "b"], 300), "embedding": [[float(i)] for i in range(300)]})))
    scored, labels = ml.out_of_fold(rows, "txn_key", kind="boosted", vector="vector", rounds=8, depth=3, bins=200, l2=0.01)
    assert labels == ["a", "b"] and scored.count() == 300 and {r.fold for r in scored.select("fold").distinct().collect()} == {0, 1, 2}
    hit = scored.select(F.avg(((F.get("probability", F.lit(0)) > 0.5) == (F.col("label") == "a")).cast("int"))).first()[0]
    assert hit < 0.65


# --- vectors ---------------------------------------------------------------------------------------------------
def test_words_in_the_same_company_are_neighbours(spark):
    rng = random.Random(8)
    food, ride = ["pizza burger dinner lunch".split(), "cab trip airport driver".split()]
    texts = [(i, " ".join(rng.choice(c) for c in (g, n, g)).replace("12", str(i))) for i in range(900) for g, n in [rng.choice([(food, ["swiggy", "zomato"]), (ride, ["uber", "ola"])])]]
    rows = spark.createDataFrame(texts, "k int, text string")
    words = embedding.word_vectors(rows, size=6, steps=6)
    near = {r.word: r.other for r in embedding.neighbours(words, ["swiggy", "uber"], 1).collect()}
    assert near == {"swiggy": "zomato", "uber": "ola"}
    a, b = ({r.word: r.v for r in embedding.word_vectors(x, size=6, steps=6).collect()} for x in (rows, rows.repartition(7)))
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-6) for w in a)
    made = embedding.text_vectors(spark.createDataFrame([(1, "uber driver"), (2, "ola airport"), (3, "zomato lunch"), (4, None), (5, "nothing known")], "k int, text string"), words, "k", size=6)
    v = {r.k: np.array(r.text_vector) for r in made.collect()}
    assert v[1] @ v[2] > 0.8 > v[1] @ v[3] and not v[4].any() and not v[5].any()


# --- corrections and retraining ---------------------------------------------------------------------------------
def test_corrections_keep_all_columns_and_retraining_sees_dates(spark, tmp_path):
    base = spark.createDataFrame([("Uber trip", "a", "a", "x", 1, 5.0, "2024-01-31", "k1"), ("uber TRIP ", "a", "a", "x", 2, 6.0, "2024-02-01", "k2"), ("dmart", "b", "b", None, 3, None, None, "k3")], "text string, label string, category string, subcategory string, pos int, amount double, date string, extra string")
    fixes = spark.createDataFrame([("UBER trip", "c", "s1", 1, 1.0, "2024-03-01"), ("uber trip", "d", "", 2, 2.0, "2024-03-02"), ("new one", "e", "s3", 3, 3.0, "2024-03-03"), ("New One", "f", "s4", 4, 4.0, None)], "text string, label string, subcategory string, pos int, amount double, date string")
    got = {r.extra or "new": r for r in dataset.merge_corrections(base, fixes).collect()}
    assert (got["k1"].label, got["k1"].category, got["k1"].subcategory, got["k1"].date, got["k1"].corrected) == ("d", "d", "x", "2024-01-31", True)
    assert got["k2"].label == "a" and not got["k2"].corrected and got["k3"].date is None
    assert (got["new"].text, got["new"].label, got["new"].subcategory, got["new"].amount, got["new"].date) == ("new one", "f", "s4", 3.0, "2024-03-03")
    rows = spark.createDataFrame([(f"{w} shop {i}", l, i, 10.0 + i, f"2024-0{1 + i % 9}-1{i % 9}") for i in range(30) for w, l in (("zomato", "food"), ("uber", "ride"))], "text string, label string, pos int, amount double, date string")
    trained = jobs.retrain(spark, rows, fixes.where("false"), str(tmp_path), kind="regression")
    written = jobs.prepared(spark.read.parquet(f"{tmp_path}/rows"))
    assert written.where("f_month > 0").count() == 60 if "f_month" in written.columns else written.where("f_day_of_month > 0").count() == 60
    assert trained.metrics.first().accuracy > 0.9


def test_missing_sources_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    found = dataset.existing(spark, f"{tmp_path}/a", f"{tmp_path}/none")
    assert len(found) == 1 and dataset.union_sources(*found).count() == 3


def test_queue_priority_and_retrain_points(spark):
    rows = spark.createDataFrame([(i, 0.1 * i, "ml", True, i % 2 == 0, f"2024-01-{10 + i}") for i in range(1, 9)], "txn_key int, confidence double, method string, requires_review boolean, reviewed boolean, created string")
    queue = learn.review_queue(rows.withColumn("created", F.to_date("created")), created="created", today=F.to_date(F.lit("2024-01-22")))
    assert [r.txn_key for r in queue.collect()] == [5, 7]
    marked = learn.prioritise(spark.createDataFrame([(0.31, 0.9), (0.3, 0.6), (0.1, 0.59)], "uncertainty double, confidence double")).collect()
    assert [r.for_review for r in marked] == [True, False, True]
    assert [r.pos for r in learn.retrain_points(spark.createDataFrame([(i,) for i in range(1, 151)], "pos int")).orderBy("pos").collect()] == [50, 100, 150]
    weights = [r.w for r in spark.createDataFrame([("2024-01-10",), ("2024-01-09",), (None,)], "d string").select(dataset.recency_weight(F.to_date("d"), F.to_date(F.lit("2024-01-10"))).alias("w")).collect()]
    assert weights[0] == 1.0 and weights[1] == pytest.approx(0.99)


def test_nearest_centroid_and_its_sql_take_near_ties_and_round_once(spark, tmp_path):
    import duckdb

    from ledgermint.plans import queries

    rows = [(1, [-1.0000001], 1), (2, [1.0], 2), (3, [0.0], 3), (4, [100.0], 3), (5, [1.0 + 0.00049999996**0.5], 3), (6, [1.0], 4), (7, [1.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.pred, r.distance, r.label) for r in queries.m5_nearest_centroid(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in duck.execute(queries.SQL["m5_nearest_centroid"]).fetchall()}
    assert got[3][0] == 2  # nearer by 2e-7
    assert got[5][1] == 0.0  # 0.0005 after nine digits, which would round up
    assert got[6][0] == 2  # a tie goes to the smaller label


def test_texts_that_differ_in_numbers_are_paired_once(spark):
    rows = spark.range(2000).select(F.concat(F.lit("pay "), F.col("id").cast("string"), F.lit(" to bob")).alias("text"))
    counts = embedding.cooccurrence(rows)
    got = {(r.word, r.other): r.n for r in counts.collect()}
    words = ["pay", "0", "to", "bob"]
    assert got == {(a, b): 2000 for a in words for b in words if a != b}
    assert "Aggregate" not in counts._jdf.queryExecution().optimizedPlan().toString()  # written once


def test_forms_are_made_without_a_join(spark):
    from ledgermint.operators import export
    from ledgermint.plans import model_queries

    made = model_queries.k9_other_forms(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # those of the transactions
    t = spark.createDataFrame([(1, "a", "b", 2.0, "2024-01-02")], "txn_key long, text string, category string, amount double, date string")
    for form in ("standard", "ledger", "coded"):
        assert export.nested_json(t, form).first().json == t.select(export.json_column(t, form)).first()[0]
