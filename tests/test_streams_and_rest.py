import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgermint.functions import text
from ledgermint.operators import evaluate, export, external, merchant_codes, preprocess, route, rules
from ledgermint.sources import readers
from ledgermint.streaming import monitor


def events(rng, n, hot=0.9, days=3):
    at = np.sort(rng.integers(0, days * 86_400_000_000, n))
    at[: n // 50] = at[0]  # ties
    user = np.where(rng.random(n) < hot, 1, rng.integers(2, 6, n)).astype(object)
    user[rng.random(n) < 0.02] = None
    frame = pd.DataFrame({"event_id": range(n), "user_id": user, "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(at, unit="us")})
    return frame.astype({"user_id": "Int64"})


def table(spark, frame):
    rows = [(int(i), None if pd.isna(u) else int(u), t.to_pydatetime()) for i, u, t in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


# --- hot keys --------------------------------------------------------------------------------------------------
def test_rate_limit_of_a_hot_key_by_slices(spark):
    frame = events(np.random.default_rng(1), 1500, days=1)
    rows = table(spark, frame)
    got = {(r.user_id, r.ts): (r.used, r.allowed, r.remaining) for r in monitor.rate_limit(rows, limit=5, seconds=600, slice_seconds=900).collect()}
    want = {}
    for user, own in frame.groupby("user_id", dropna=False):
        times = np.unique(own["ts"].to_numpy().astype("datetime64[us]").astype(np.int64))
        for t in times:
            used = int(((times > t - 600_000_000) & (times < t)).sum())
            want[None if pd.isna(user) else int(user), pd.Timestamp(t, unit="us").to_pydatetime()] = (used, used < 5, max(5 - used - 1, 0))
    assert got == want
    assert monitor.rate_limit(rows.limit(0)).count() == 0


def test_cache_of_a_hot_key_by_slices(spark):
    frame = events(np.random.default_rng(2), 1500)
    rows = table(spark, frame)
    want = {}
    for _, own in frame.groupby("user_id", dropna=False):
        entered = None
        for ts, i in sorted(zip(own["ts"], own["event_id"])):
            hit = entered is not None and ts - entered <= pd.Timedelta(seconds=600)
            entered = entered if hit else ts
            want[i] = hit
    for slices in (600, 3600, 7 * 86_400):
        assert {r.event_id: r.hit for r in monitor.ttl_cache(rows, "user_id", seconds=600, slice_seconds=slices).collect()} == want, slices
    assert monitor.ttl_cache(rows.limit(0), "user_id").count() == 0


def test_a_hot_key_is_many_groups(spark):
    rows = table(spark, events(np.random.default_rng(3), 1000, hot=1.0))
    length = monitor.SLICE_LIVES * 600 * 1_000_000
    assert rows.select(F.floor(monitor.micros(F.col("ts")) / length)).distinct().count() >= 15


# --- alerts on a stream ---------------------------------------------------------------------------------------
def test_alerts_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 3000
    at = np.sort(rng.integers(0, 3 * 3600, n))
    bad = (at // 1800) % 2 == 0
    frame = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(at, unit="s"), "error": rng.random(n) < np.where(bad, 0.3, 0.0), "review": rng.random(n) < np.where(bad, 0.1, 0.6), "seconds": rng.random(n) * np.where(bad, 5, 1), "agreement": rng.random(n) < np.where(bad, 0.2, 0.95), "hit": rng.random(n) < np.where(bad, 0.05, 0.9)})
    end = pd.DataFrame({"ts": [pd.Timestamp("2024-01-02")], "error": [False], "review": [False], "seconds": [0.1], "agreement": [True], "hit": [True]})
    parts = [frame.iloc[:1200], frame.iloc[1200:2500], frame.iloc[2500:], end, end.assign(ts=pd.Timestamp("2024-01-03"))]
    batch = spark.createDataFrame(frame)
    metrics = monitor.service_metrics(batch)
    want = {(r.measure, r["from"], r["to"], r.evaluations) for r in monitor.rule_alerts(metrics).collect()}
    schema, source = batch.schema, f"{tmp_path}/in"
    stream = monitor.stream_rule_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source + "/*"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{source}/{k}")

    def run():
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    run()  # a restart from the checkpoint adds nothing twice
    got = [(r.measure, r["from"], r["to"], r.evaluations) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {m for m, *_ in got} == {"errors", "reviews", "p95", "agreement", "hits"}


# --- state with timers -----------------------------------------------------------------------------------------
def test_streams_of_limits_and_caches_late_rows_expiry_and_restart(spark, tmp_path):
    frame = events(np.random.default_rng(6), 400, hot=0.5, days=1).dropna()
    rows = table(spark, frame).select("user_id", "ts")
    first, second = frame.iloc[:250], frame.iloc[250:]
    late = second.iloc[[0]].assign(ts=second["ts"].iloc[-1] - pd.Timedelta(minutes=3), user_id=9)  # within the watermark
    gone = second.iloc[[0]].assign(ts=frame["ts"].iloc[0], user_id=8)  # hours behind it
    source = f"{tmp_path}/in"
    for name, make in (("limit", lambda s: monitor.stream_rate_limit(s, limit=3, seconds=1800)), ("cache", lambda s: monitor.stream_ttl_cache(s, "user_id", seconds=1800))):
        stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}-{name}/*"))

        def run():
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
            return {(r[0], r[1]): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

        table(spark, first).select("user_id", "ts").coalesce(1).write.parquet(f"{source}-{name}/0")
        run()
        for k, part in enumerate((second, late, gone), 1):
            table(spark, part).select("user_id", "ts").coalesce(1).write.parquet(f"{source}-{name}/{k}")
            got = run()  # each run starts again from the state that the one before has left
        batch = monitor.rate_limit(rows, limit=3, seconds=1800).drop("remaining") if name == "limit" else monitor.ttl_cache(table(spark, frame), "user_id", seconds=1800).drop("event_id")
        want = {}
        for r in batch.collect():
            want.setdefault((r[0], r[1]), tuple(r)[2:]) if name == "limit" else want.__setitem__((r[0], r[1]), tuple(r)[2:])
        in_time = late["ts"].iloc[0].to_pydatetime()
        assert got.pop((9, in_time)) == ((0, True) if name == "limit" else (False,))
        assert (8, gone["ts"].iloc[0].to_pydatetime()) not in got
        same = {k for k in want if sum(t == k[1] for t in frame["ts"]) == 1}  # of equal times a cache has one miss
        assert got.keys() == want.keys() and all(got[k] == want[k] for k in same)


# --- what had no test ------------------------------------------------------------------------------------------
def test_json_of_every_depth(spark):
    deep = {"a": [{"merchant": "no"}], "b": {"c": {"Store-Name": "THIRD", "d": {"payee": "fourth"}}}, "amount": {"value": 7, "currency": "INR"}}
    rows = [json.dumps(deep), json.dumps({"b": {"x": {"payee": "P1", "seller": "longer name"}}, "z": {"vendor": "later"}}), json.dumps({"k": {"l": [1], "m": {"n": 1}, "o": 2}, "p": None, "q": 3.5, "r": "s", "t": "u"}), "{broken", "{}"]
    got = [r.prepared for r in preprocess.preprocess(spark.createDataFrame([(r,) for r in rows], "text string")).collect()]
    assert (got[0].merchant, got[0].amount) == ("THIRD", 7.0) and got[1].merchant == "longer name"
    assert got[2].text == "o: 2, q: 3.5, r: s" and got[2].merchant is None


def test_request_fields_win_where_they_should(spark):
    rows = spark.createDataFrame([('{"merchant":"M","amount":5,"currency":"USD","date":"2024-01-02","mcc":"5812"}', 9.0, None, "INR", "own", "1111"), ("plain", None, "2024-02-02", "EUR", "own", "1111")], "text string, amount double, date string, currency string, merchant string, mcc string")
    a, b = preprocess.with_request_fields(preprocess.preprocess(rows)).collect()
    assert (a.final_amount, a.final_date, a.final_currency, a.final_merchant, a.final_mcc) == (9.0, "2024-01-02", "USD", "M", "5812")
    assert (b.final_amount, b.final_date, b.final_currency, b.final_merchant, b.final_mcc) == (None, "2024-02-02", "EUR", "own", "1111")


def test_keyword_labels_in_order(spark):
    texts = ["LIC premium", "temple donation", "Gym", "dog food", "IKEA", "car service", "GST challan", "macbook", "legal fee", "baby toy", "icloud", "birthday bouquet", "zzz", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(route.label_by_keywords(F.col("t"))).collect()]
    assert got[:2] == ["insurance", "charity_donations"] and got[-2:] == [None, None] and len(set(got[:12])) == 12


def test_closest_category(spark):
    ids = ["food_dining", "rent", "other"]
    got = [r[0] for r in spark.createDataFrame([("Food",), ("the RENT of may",), ("zzz",), ("food_dining out",)], "t string").select(merchant_codes.closest_category(F.col("t"), ids)).collect()]
    assert got == ["food_dining", "rent", "other", "food_dining"]


def test_small_functions(spark):
    one = spark.createDataFrame([("A b--C!", "x {\"a\": {\"b\": 1}} y")], "a string, b string")
    r = one.select(text.slug(F.col("a")).alias("slug"), text.embedded_json(F.col("b")).alias("json"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("j")).first()
    assert r.slug == "a_b_c" and json.loads(r.json) == {"a": {"b": 1}} and r.j == pytest.approx(1 / 3)


def test_predictions_meet_labels(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "txn_key int, pred string")
    l = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a")], "txn_key int, label string")
    assert {(r.txn_key, r.pred, r.label) for r in evaluate.joined(p, l).collect()} == {(1, "a", "a"), (2, "b", "a")}
    report = evaluate.class_report(evaluate.joined(p, l))
    assert [(r["class"], r.incorrect, r.accuracy) for r in evaluate.misclassified(report).collect()] == [("a", 1, 0.5)]
    assert evaluate.report_totals(report).first().total_errors == 1


def test_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "2024-01-02"), (2, None, "2024-01-03")], "k int, text string, date string")
    export.write_jsonl(rows, f"{tmp_path}/j")
    assert readers.read_jsonl(spark, f"{tmp_path}/j", "k int, text string, date string").orderBy("k").collect() == rows.collect()
    (tmp_path / "lines").write_text('{"k": 1}\n\n{broken\n')
    assert sorted(str(r.k) for r in readers.read_jsonl(spark, f"{tmp_path}/lines", "k int").collect()) == ["1", "None"]
    export.append_feedback(rows.withColumn("timestamp", F.to_timestamp("date")), f"{tmp_path}/f")
    export.append_feedback(rows.withColumn("timestamp", F.to_timestamp("date")), f"{tmp_path}/f")
    saved = readers.read_saved(spark, f"{tmp_path}/f")
    assert saved.count() == 4 and {str(r.day) for r in saved.collect()} == {"20240102", "20240103"}
    gazetteer = spark.createDataFrame([(i, i + 1, n, a, "c", "s") for i, (n, a) in enumerate([("ZED", "z,zed shop"), ("ANT", 'a "quoted",b')])], "row_pos int, merchant_id int, canonical_name string, aliases string, category string, subcategory string")
    export.write_gazetteer(gazetteer.coalesce(1), f"{tmp_path}/g")
    assert {r.canonical_name: r.merchant_id for r in readers.read_gazetteer(spark, f"{tmp_path}/g").collect()} == {"ZED": 1, "ANT": 2}
    export.write_metrics(rows.limit(1), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().text == "x"
    (tmp_path / "few").write_text("\n".join(json.dumps({"text": f"t{i}", "category": "ab"[i % 2], "amount": 1.0, "currency": "INR"}) for i in range(8)))
    assert sorted(r.text for r in readers.read_few_shot(spark, f"{tmp_path}/few").collect()) == ["t0", "t1", "t2", "t3"]
    (tmp_path / "card").write_text("Category,Merchant Name,Transaction Amount\nFuel,PUMP,\"1,200.5\"\nOther,X,1\n")
    assert [tuple(r) for r in readers.read_card_csv(spark, f"{tmp_path}/card", spark.createDataFrame([("Fuel", "fuel")], "foreign string, label string")).collect()] == [("PUMP", "fuel", 1200.5)]
    (tmp_path / "bank").write_text("TRANSACTION DETAILS,WITHDRAWAL AMT,DEPOSIT AMT\nTEA SHOP,,20\n,5,\n")
    assert [tuple(r) for r in readers.read_bank_csv(spark, f"{tmp_path}/bank").collect()] == [("TEA SHOP", 20.0)]
    assert [r.text for r in readers.admitted(spark.createDataFrame([(" a ", 2), ("", 1), (None, 3), ("b", 0)], "text string, at int"), most=1, order="at").collect()] == ["b"]


def test_feedback_is_cached_as_sure(spark):
    rows = spark.createDataFrame([("t", 1.0, "2024-01-01", "food", "sub")], "text string, amount double, date string, correct_category string, correct_subcategory string")
    r = export.confirmed_cache_rows(rows, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).first()
    assert json.loads(r.answer)["method"] == "user_feedback_cached" and len(r.cache_key) == 64 and str(r.expires_at) == "2024-01-01 00:10:00"


def test_cached_requests_are_found_by_the_bytes_of_their_keys(spark):
    from ledgermint.functions.text import cache_digest, cache_key
    from ledgermint.operators import tenancy

    df = spark.createDataFrame([(1, "a", 5, None, "INR"), (2, "", 5, None, "INR"), (3, None, 5, None, "INR"), (4, "a", 5, None, "INR"), (5, "b", 5, None, "INR")], "k int, text string, amount_cents long, date string, currency string")
    parts = [F.col(c) for c in ("text", "amount_cents", "date", "currency")]
    digits = df.where("k IN (1, 2, 5)").select(F.when(F.col("k") == 5, F.upper(cache_key(*parts))).otherwise(cache_key(*parts)).alias("cache_key"), F.col("k").cast("string").alias("category"))
    digits = digits.unionByName(spark.createDataFrame([("no digits", "x"), (None, "y")], digits.schema))  # keys are compared as they stand
    as_bytes = df.where("k IN (1, 2)").select(cache_digest(*parts).alias("cache_key"), F.col("k").cast("string").alias("category"))
    for cache in (digits, as_bytes):
        found = tenancy.with_cached(df, cache)
        assert found.columns == ["cache_key", *df.columns, "cached_category"]
        rows = {r.k: r for r in found.collect()}
        assert {k: r.cached_category for k, r in rows.items()} == {1: "1", 2: "2", 3: None, 4: "1", 5: None}
        assert rows[1].cache_key == df.where("k = 1").select(cache_key(*parts)).first()[0]
