import datetime as dt

from ledgermint.functions.text import parsed_date
from ledgermint.operators import dataset, evaluate, export, learn
from ledgermint.sources import readers
from ledgermint.streaming import monitor
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def events(spark, n=60, gap=7):
    return spark.createDataFrame([(i, DAY + dt.timedelta(seconds=gap * i), i % 3, float(i % 11)) for i in range(n)], "event_id long, ts timestamp, user_id long, value double")


def test_rate_limit_counts_rejected_ones(spark):
    rows = events(spark).collect()
    got = {(r.user_id, r.ts): r.used for r in monitor.rate_limit(events(spark), limit=2, seconds=60).collect()}
    for r in rows:
        assert got[(r.user_id, r.ts)] == sum(x.user_id == r.user_id and 0 < (r.ts - x.ts).total_seconds() < 60 for x in rows)


def test_cache_hits_do_not_refresh(spark):
    got = [r.hit for r in monitor.ttl_cache(events(spark, 30, 100).where("user_id = 0"), "user_id", seconds=600).orderBy("event_id").collect()]
    entered, want = None, []
    for i in range(0, 30, 3):
        at = i * 100
        hit = entered is not None and at - entered <= 600
        entered = entered if hit else at
        want.append(hit)
    assert got == want


def test_streams_equal_batches(spark, tmp_path):
    e = events(spark)
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    for name, s, batch in [
        ("limit", monitor.stream_rate_limit(stream, limit=2), monitor.rate_limit(e, limit=2).select("user_id", "ts", "used", "allowed")),
        ("cache", monitor.stream_ttl_cache(stream, "user_id"), monitor.ttl_cache(e, "user_id").select("user_id", "ts", "hit")),
    ]:
        q = s.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"out_{name}").collect())) == sorted(map(tuple, batch.collect()))


def test_hot_keys_are_walked_like_any(spark):
    import random

    rng = random.Random(3)
    rows = [(None if k == 0 else k, DAY + dt.timedelta(seconds=rng.randrange(40_000))) for k in (0, 1, 1, 1, 2) for _ in range(300)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "event_id long, user_id long, ts timestamp")
    entered, want = {}, {}
    for k, t, i in sorted(((k, t, i) for i, (k, t) in enumerate(rows)), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])):
        want[i] = k in entered and (t - entered[k]).total_seconds() <= 500
        entered[k] = entered[k] if want[i] else t
    got = {r.event_id: r.hit for r in monitor.ttl_cache(df.select("event_id", "user_id", "ts"), "user_id", seconds=500).collect()}
    assert got == want


def test_runtime_stats_over_chunks(spark):
    rows = [(i, DAY + dt.timedelta(seconds=1700 * (i // 3)), "a" if i % 7 else None, float(i * i % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double")
    got = {r.event_id: r for r in monitor.runtime_stats(df, ["kind"], last=10, chunk_rows=25, review=F.col("value") > 50).collect()}
    assert len(got) == 400
    for kind in ("a", None):
        mine = [r for r in rows if r[2] == kind]
        for k, r in enumerate(mine):
            last = [x[3] for x in mine[max(0, k - 9) : k + 1]]
            g = got[r[0]]
            assert g.running_count == k + 1 and abs(g.rolling_mean - sum(last) / len(last)) < 1e-9 and abs(g.running_mean - sum(x[3] for x in mine[: k + 1]) / (k + 1)) < 1e-9
            assert abs(g.running_review_rate - sum(x[3] > 50 for x in mine[: k + 1]) / (k + 1)) < 1e-9


def test_stream_figures_and_triggers(spark, tmp_path):
    e = events(spark, 90).select("event_id", "ts", "user_id", "value").coalesce(1)
    schema = e.schema
    for part, low in enumerate((0, 40)):
        e.where((F.col("event_id") >= low) & (F.col("event_id") < (40 if low == 0 else 90))).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = monitor.stream_runtime_stats(stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), ["user_id"], f"{tmp_path}/state", last=8).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()}
    want = {r.event_id: r for r in monitor.runtime_stats(e, ["user_id"], last=8).collect()}
    assert set(got) == set(want)
    if all(got[i].running_count == want[i].running_count for i in want):  # files in order of time
        assert all(abs(got[i].rolling_mean - want[i].rolling_mean) < 1e-9 and abs(got[i].running_mean - want[i].running_mean) < 1e-9 for i in want)
    q = monitor.stream_retrain_trigger(stream, 25).writeStream.format("memory").queryName("trigger").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.at for r in spark.table("trigger").collect()) == [25, 50, 75]


def test_alert_needs_a_run(spark):
    m = spark.createDataFrame([(i, x) for i, x in enumerate([0, 1, 1, 0, 1, 1, 1, 0])], "start int, v int")
    got = monitor.alerts(m, F.col("v") == 1, 3).collect()
    assert [(r["from"], r["to"], r.evaluations) for r in got] == [(4, 6, 3)]


def test_balance_and_split(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(100)], "txn_key long, label string")
    b = dataset.balance(df, 25).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("txn_key").alias("k")).collect()
    assert {(r.label, r.n, r.k) for r in b} == {("big", 25, 25), ("small", 25, 10)}
    s = dataset.split(df, by="label").where("part = 'train'").groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in s} == {("big", 72), ("small", 8)}


def test_oversampled_rows_and_examples(spark):
    df = spark.createDataFrame([(i, f"a-b/{i}", "big" if i < 90 else "small") for i in range(94)], "txn_key long, text string, label string")
    rows = dataset.oversample(df, least=10).collect()
    assert sum(r.label == "big" for r in rows) == 90 and sum(r.label == "small" for r in rows) == 72
    assert all(r.text.replace("-", "").replace("/", "").replace(" ", "").lower() == f"ab{r.txn_key}" for r in rows) and len({r.text for r in rows if r.label == "small"}) > 4
    assert {r.label: r.n for r in dataset.class_examples(df, 3, 5, order="txn_key").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"big": 3}
    texts = ["UPI-ZOMATO ORDER 12", "POS PURCHASE D-MART", "12 34", "", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dataset.augmentation_merchant(F.col("t"))).collect()]
    assert got == ["ZOMATO ORDER", "DMART", "12 34", "", "x"]


def test_training_jobs(spark, tmp_path):
    from ledgermint.operators import jobs

    rows = [(i, f"{('ZOMATO', 'UBER')[i % 2]} ORDER {i}", ("food_dining", "transport")[i % 2], 10.0 + i, "2024-01-05") for i in range(60)]
    base = spark.createDataFrame(rows, "txn_key long, text string, label string, amount double, date string")
    done = jobs.train(jobs.prepared(base), kind="forest")
    m = done.metrics.first()
    assert m.accuracy == 1.0 and m.passes and done.predictions.count() == 12 and done.labels == ["food_dining", "transport"]
    jobs.save(done.model, f"{tmp_path}/m")
    again = jobs.score(jobs.prepared(base.limit(4)), jobs.load(f"{tmp_path}/m")).collect()
    assert all(r.ml_category == r.label for r in again)
    feedback = base.withColumn("was_incorrect", F.col("txn_key") < 5)
    accepted = base.select("txn_key", "text", F.col("label").alias("category"), F.lit(0.95).alias("confidence"), F.lit(False).alias("requires_review"))
    joined, shots, _ = jobs.feedback_learning(base, feedback, accepted, kind="regression")
    assert joined.count() == 65 and shots.count() == 30
    fix = base.where("txn_key < 4").select("text", F.lit("transport").alias("label"), F.col("txn_key").alias("pos"), "amount")
    jobs.retrain(spark, base.withColumn("pos", F.col("txn_key")), fix, f"{tmp_path}/r", kind="regression")
    assert spark.read.parquet(f"{tmp_path}/r/rows").where("label = 'transport'").count() == 32 and jobs.load(f"{tmp_path}/r/model") is not None


def test_corrections(spark):
    base = spark.createDataFrame([("A x", "p", 1, 1.0), ("a X ", "p", 2, 2.0), ("b", "q", 3, 3.0)], "text string, label string, pos int, amount double")
    fix = spark.createDataFrame([("a x", "r", 1, 9.0), ("A X", "s", 2, 8.0), ("new", "t", 3, 7.0), ("NEW", "u", 4, 6.0)], "text string, label string, pos int, amount double")
    assert {(r.text, r.label, r.amount) for r in dataset.merge_corrections(base, fix).collect()} == {("A x", "s", 1.0), ("a X ", "p", 2.0), ("b", "q", 3.0), ("new", "u", 7.0)}


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, pred string")
    got = {r["class"]: (r.support, r.precision, r.recall, r.f1) for r in evaluate.class_report(df).collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 0.666667), "c": (1, 0.0, 0.0, 0.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text('merchant_id,canonical_name,aliases,category,subcategory\n7,ACME,"acme, acme inc",shopping,Retail\n7,OTHER,acme,food_dining,X\n')
    g = readers.read_gazetteer(spark, str(tmp_path / "g.csv"))
    from ledgermint.operators.resolve import aliases

    assert {(r.alias, r.canonical_name) for r in aliases(g).collect()} == {("ACME", "OTHER"), ("ACME INC", "ACME"), ("OTHER", "OTHER")}
    (tmp_path / "t.yaml").write_text("categories:\n- {id: a, name: A, keywords: [K], patterns: ['(?i)x.*', '(bad'], subcategories: [S]}\n")
    (c,) = readers.load_taxonomy(str(tmp_path / "t.yaml"))
    assert c.keywords == ("k",) and c.patterns == ("x.*",)
    files = spark.createDataFrame([("a.json", '{"transactions":[{"description":"one"},"two"]}'), ("b", "date,amount\nx,1\ny,2\n"), ("c.txt", "p\n\n q "), ("d", "[broken")], "name string, content string")
    got = {}
    for r in readers.upload_rows(files).orderBy("name", "pos").collect():
        got.setdefault(r.name, []).append(r.text)
    assert got == {"a.json": ["one", "two"], "b": ["x,1", "y,2"], "c.txt": ["p", "q"], "d": ["[broken"]}
    t = spark.createDataFrame([(1, 1, 0, ["Date", "Particulars", "Amount"]), (1, 1, 1, ["01/02/2024", "NETFLIX SUB", "INR 649.00"])], "doc int, table int, row_pos int, cells array<string>")
    r = readers.statement_table(t).first()
    assert (r.text, r.amount, str(r.date)) == ("NETFLIX SUB", 649.0, "2024-02-01")
    bank = readers.bank_rows(spark.createDataFrame([("x", None, "1,200.50")], "Narration string, `WITHDRAWAL AMT` string, `DEPOSIT AMT` string")).first()
    assert (bank.text, bank.amount) == ("x", 1200.5)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", 10.0, "2024-01-05", "INR", "fuel", None, 0.9, "rule", False), (2, "u", 5.0, "bad", "INR", "odd", None, 0.4, "ml", True)], "txn_key long, text string, amount double, date string, currency string, category string, subcategory string, confidence double, method string, requires_review boolean")
    export.write_interchange(df, f"{tmp_path}/iif")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/iif").collect()]
    assert sum(x.startswith("TRNS") for x in lines) == 2 and sum(x.startswith("!") for x in lines) == 3
    export.append_accepted(df, f"{tmp_path}/acc")
    assert [(r.txn_key, r.month) for r in spark.read.parquet(f"{tmp_path}/acc").collect()] == [(1, "2024-01")]
    coded = export.coded_csv(df).first()
    assert list(coded.asDict()) == export.CODED_COLUMNS and (coded["AccountCode"], coded["TaxAmount"], coded["*TaxType"], coded["*InvoiceNumber"]) == ("202", "1.80", "GST", "TXN-1")
    assert '"category":"fuel"' in export.nested_json(df).first().json and '"AccountRef":{"name":"fuel"}' in export.nested_json(df, "ledger").first().json and '"AccountCode":"200"' in export.nested_json(df, "coded").first().json
    first = export.ledger_csv(df).first()
    assert list(first.asDict()) == ["date", "amount", "currency", "category", "subcategory", "merchant", "description", "confidence", "method", "requires_review"] and first.confidence == 0.9
    assert [r[0] for r in df.select(export.account(F.col("category"))).collect()] == ["Auto & Travel", "Other Expenses"] and export.INTERCHANGE_HEADER[0] == "!TRNS\tDATE\tACCNT\tAMOUNT\tMEMO"
    assert "TRNS\t2024-01-05\tAuto & Travel\t-10.00\tt" in lines and "SPL\t2024-01-05\tBank Account\t10.00\tt" in lines
    kept = export.cache_rows(df, F.lit(DAY)).collect()
    assert len(kept) == 1 and kept[0].expires_at == DAY + dt.timedelta(seconds=600)
    report = export.fairness_report(*[spark.createDataFrame(r, s) for r, s in (([("small", 2, 0.5), ("large", 1, 1.0), ("medium", 0, None)], "range string, n long, accuracy double"), ([("b", 1, 1.0), ("a", 2, 0.5)], "class string, n long, accuracy double"), ([(0.666667,)], "accuracy double"))])
    text = [r.line for r in report.orderBy("pos").collect()]
    assert text[:2] == ["# Fairness report", "**Overall accuracy**: 66.67%"] and text[5:9] == ["| small | 2 | 50.00% |", "| medium | 0 | nan% |", "| large | 1 | 100.00% |", "**Max disparity**: 50.00% (warning)"] and text[-2:] == ["| b | 1 | 100.00% |", "| a | 2 | 50.00% |"]
    export.write_report(report, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == text


def test_learning(spark):
    rows = [(f"POS {i} BIG BAZAAR", "shopping" if i else "fuel", None, i) for i in range(4)] + [("ONCE ONLY", "x", None, 9)]
    got = learn.learned_merchants(spark.createDataFrame(rows, "text string, label string, subcategory string, pos int"), 3).collect()
    assert [(r.merchant_id, r.canonical_name, r.category, r.n) for r in got] == [(1, "BIG BAZAAR", "shopping", 4)]
    known = spark.createDataFrame([(0, 7, "ACME", "acme", "x", "y"), (1, 9, "BIG BAZAAR", "bb", "x", "y")], "row_pos int, merchant_id int, canonical_name string, aliases string, category string, subcategory string")
    more = learn.extended_gazetteer(known, spark.createDataFrame([("BIG BAZAAR", "a", "b", "c"), ("NEW", "n", "o", "p")], "canonical_name string, aliases string, category string, subcategory string")).collect()
    assert [(r.row_pos, r.merchant_id, r.canonical_name) for r in more] == [(0, 7, "ACME"), (1, 9, "BIG BAZAAR"), (2, 10, "NEW")]
    scores = {r.m: (r.v.agreement, r.v.methods) for r in spark.createDataFrame([("ensemble_unanimous",), ("ensemble_rule+ml",), ("rule",)], "m string").select("m", learn.votes_of_method(F.col("m")).alias("v")).collect()}
    assert scores == {"ensemble_unanimous": (1, 1), "ensemble_rule+ml": (0, 2), "rule": (0, 1)}
    q = spark.createDataFrame([(1, 0.2, "rule", True), (2, 0.55, "ensemble_rule+ml", True), (3, 0.1, "ml", False)], "txn_key long, confidence double, method string, requires_review boolean")
    assert [r.txn_key for r in learn.review_queue(q).orderBy("txn_key").collect()] == [1, 2]


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "ledgermint", tmp_path / "ledgermint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert out.stdout.split()[1] == "False", out.stderr


def test_totals_of_a_report_judge_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judged(label):
        seen.add(1)
        return label if label != "b" else "a"

    rows = spark.createDataFrame([(x,) for x in "aabbbc"], "label string").withColumn("pred", judged("label"))
    for made, want in ((evaluate.report_totals, [(3, 6, 3, 1, 1)]), (evaluate.misclassified, [("b", 3, 3, 0.0)])):
        seen.value = 0
        assert [tuple(r) for r in made(evaluate.class_report(rows)).collect()] == want
        assert seen.value == 6
    for made in (evaluate.summary, evaluate.best_and_worst):
        seen.value = 0
        made(evaluate.class_report(rows)).collect()
        assert seen.value == 6


def test_statement_lines_are_read_once_and_dates_by_their_form(spark):
    text = "STATEMENT OF X\n03/04/2024  SHOP 1,200.50\n  31-12-69 CARD ab 7  \nshort\nSEE 1/2/2024 ROAD\nONLY TEXT HERE 12.5\nTotal Amount 12\n1/2/24 abc 99"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, content string")
    found = readers.statement_rows(docs, "id", "content")
    rows = [(r.pos, str(r.date), r.text, r.amount) for r in found.orderBy("pos").collect()]
    assert rows == [(0, "2024-04-03", "SHOP", 1200.5), (1, "1969-12-31", "CARD ab", 7.0), (2, "None", "SEE 1/2/2024 ROAD", None), (3, "None", "ONLY TEXT HERE", None), (4, "2024-02-01", "abc", 99.0)]
    assert readers.statement_rows(docs, "id", "content", amounts=False).where("date IS NULL AND amount IS NULL").count() == 3  # two texts are short
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\d,]+\.?\d*)\s*$") == 3  # a search for each part of a line
    texts = ["2024-1-31", "2024/01/31", "31-1-2024", "31/01/2024", "31-01-24", "31/1/69", "31/1/70", "3 Jan 2024", "3 January 2024", "12024-1-2", "+12024-1-2", "0003/1/2024", "1234/5/06", "24-1-1", "2024-1-1 ", " 2024-1-1", "1/2", "", None, "31-02-2024", "2024-13-01", "2024-1/2", "1-2-+2024", "1-2--2024", "1-2-24\n", "१/२/२०२४"]
    forms = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "d-M-yy", "d/M/yy", "d MMM yyyy", "d MMMM yyyy"]
    every = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in forms]).cast("date")
    every = F.when(F.year(every) >= 2069, F.add_months(every, -1200)).otherwise(every).cast("string")
    dates = spark.createDataFrame([(t,) for t in texts], "t string").select("t", every.alias("a"), parsed_date(F.col("t")).cast("string").alias("b")).collect()
    assert [r for r in dates if r.a != r.b] == [] and sum(r.a is not None for r in dates) >= 12


def test_corrections_are_merged_by_one_join(spark, tmp_path):
    rows = [(None, "n", 1), ("a", "p", 2), (" A", "q", 1), ("b", "r", 5), ("b", "s", 5), ("c", "t", None), ("C ", "u", None), ("d", "v", 7), ("e", "w", 5), ("", "x", 8), ("f", "y", 9)]
    fixes = [("A", "1", 1), ("a", "2", 2), ("B", "3", 3), ("c", "4", 4), ("new", "5", 5), ("NEW", "6", 6), (None, "7", 7), ("", "8", 8), ("e", None, 9), ("d", "9", None)]
    spark.createDataFrame(rows, "text string, label string, pos int").withColumn("extra", F.concat("label", F.lit("!"))).withColumn("m", F.create_map("label", "pos")).write.parquet(f"{tmp_path}/base")
    spark.createDataFrame(fixes, "text string, label string, pos int").write.parquet(f"{tmp_path}/fixes")
    key = lambda t: None if t is None else t.strip(" ").lower()
    last, first, least = {}, {}, {}
    for t, label, at in fixes:
        if at is not None:
            last[key(t)] = label
            first.setdefault(key(t), t)
        else:
            last.setdefault(key(t), "no place")
    for t, _, pos in rows:
        least[key(t)] = min((p for p in (least.get(key(t)), pos) if p is not None), default=None)
    want = []
    for t, label, pos in rows:
        hit = t is not None and key(t) in last and last[key(t)] != "no place" and pos is not None and pos == least[key(t)]
        want.append((t, (last[key(t)] or label) if hit else label, label + "!", hit))
    want += [(first[k], label, None, True) for k, label in last.items() if k is None or k not in least]
    base = spark.read.parquet(f"{tmp_path}/base")
    found = dataset.merge_corrections(base, spark.read.parquet(f"{tmp_path}/fixes"))
    assert sorted(((r.text, r.label, r.extra, r.corrected) for r in found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Scan parquet") == 3  # corrections once, the base for first rows and for its own
    dealt = base.drop("m").groupBy("pos").agg(*[F.max(n).alias(n) for n in ("text", "label", "extra")])
    again = dataset.merge_corrections(dealt, spark.read.parquet(f"{tmp_path}/fixes"))
    again.collect()
    assert "ReusedExchange" in again._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
