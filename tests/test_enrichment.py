from difflib import SequenceMatcher

import pytest
from ledgermint.functions import text as T
from ledgermint.operators import external, learn, merchant_codes, normalize, preprocess, resolve, rules, similarity, vote
from ledgermint.plans.fixture import TAXONOMY, gazetteer
from pyspark.sql import functions as F


def one(spark, value, expr, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first().x


CASES = [
    ("REFUND UPI ZOMATO", "transfer_refund"), ("REFUND AMAZON", "refund"), ("CHARGEBACK dispute", "refund"), ("rakesh pan shop", "shop_0"), ("sharma kirana store", "shop_5"), ("UPI-123-RAHUL", "person_name_upi"), ("UPI/vikas shop", None),
    ("atm wdl fee", "bank_fee"), ("ATM WDL 12 MUMBAI", "atm"), ("HOME LOAN", "mortgage"), ("NEFT TO LANDLORD", "rent"), ("SOCIETY MAINTENANCE", "maintenance"), ("EMI-4455", "emi"), ("my vi recharge", "utilities"), ("movie service visit", None), ("SALARY APRIL", "salary"), ("temple donation", "charity"),
    ("PROPERTY TAX", "property_tax"), ("gst payment", "tax"), ("lic insurance", "insurance"), ("apollo pharmacy", "health"), ("shell station", "fuel"), ("netflix.com", "streaming"), ("fraud alert", "fraud"), ("home depot", "home_improvement"), ("petsmart", "pets"), ("hamleys", "kids_family"), ("new laptop", "electronics"), ("udemy course", "subscription"), ("car wash", "automotive"), ("plain words", None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t, None, 900.0) for i, (t, _) in enumerate(CASES)], "i int, t string, c string, a double")
    got = {r.i: r.r for r in df.select("i", rules.cascade(rules.fields_of(F.col("t"), F.col("c"), F.col("a")))["rule"].alias("r")).collect()}
    assert {CASES[i][0]: r for i, r in got.items()} == dict(CASES)


@pytest.mark.parametrize(("amount", "rule"), [(100.0, "fee"), (-5.0, "fee"), (0.0, None), (None, None), (500.0, None)])
def test_fee_by_amount(spark, amount, rule):
    df = spark.createDataFrame([("late fee", None, amount)], "t string, c string, a double")
    assert df.select(rules.cascade(rules.fields_of(F.col("t"), F.col("c"), F.col("a")))["rule"]).first()[0] == rule


def test_normalize(spark):
    rows = [("UPI-12345678-ZOMATO PAY", None, None), ("POS 123 STARBUCKS Mumbai", 0.0, "15/01/24"), ("paid Rs 1,234.50 on 2025-11-10", None, None), ("Café  ÀÉ ₹249.00", None, "bad"), (None, None, None), ("x" * 2000, -5.0, "5/1/1969")]
    out = normalize.normalize(spark.createDataFrame(rows, "text string, amount double, date string")).collect()
    assert [r.channel for r in out] == ["UPI", "POS", None, None, None, None]
    assert out[0].merchant == "-ZOMATO" or out[0].merchant == "ZOMATO"
    assert out[1].merchant == "STARBUCKS" and str(out[1].norm_amount) == "0.00" and str(out[1].norm_date) == "2024-01-15"
    assert str(out[2].norm_amount) == "1234.50" and str(out[2].norm_date) == "2025-11-10"
    assert out[3].cleaned_text.startswith("Cafe AE") and out[3].norm_date is None and out[4].cleaned_text == "" and str(out[5].norm_date) == "1969-01-05"
    assert len([c for c in normalize.features(normalize.normalize(spark.createDataFrame(rows, "text string, amount double, date string"))).columns if c.startswith("f_")]) == normalize.FEATURES


def test_preprocess(spark):
    rows = ['{"transaction":{"merchant_name":"ZOMATO LTD","amount":"1,234.5","status":"x"},"currency":"USD","date":"2024-01-05"}', "plain   text", '{"a":1,"b":{"c":2}}', "[1,2]", None, '{"merchant":{"name":"X","mcc":"5812"},"type":"SUCCESS"}', "y" * 600]
    got = [r.prepared for r in preprocess.preprocess(spark.createDataFrame([(r,) for r in rows], "text string")).collect()]
    assert got[0].text == "ZOMATO LTD USD 1,234.50" and got[0].date == "2024-01-05" and got[0].amount == 1234.5
    assert [g.text for g in got[1:5]] == ["plain text", "a: 1, c: 2", "[1,2]", None]
    assert got[5].mcc == "5812" and got[5].text == "X" and len(got[6].text) == 500


def test_codes(spark):
    assert one(spark, "POS / 5541 / X", merchant_codes.code_in_text(F.col("t"))) == "5541"
    assert one(spark, "9999 MCC:5812", merchant_codes.code_in_text(F.col("t"))) == "5812"
    df = spark.createDataFrame([("5812",), ("5999",), ("0000",), (None,)], "mcc string")
    got = {r.mcc: (r.mcc_category, r.mcc_conf) for r in merchant_codes.classify_codes(df, merchant_codes.code_table(spark)).collect()}
    assert got == {"5812": ("food_dining", 0.95), "5999": ("shopping", 0.85), "0000": ("Other", 0.0), None: (None, None)}
    assert len(merchant_codes.code_rows()) == 188
    assert one(spark, "Food & Dining", merchant_codes.category_id(F.col("t"))) == "food_dining"


def test_resolver(spark):
    names = resolve.aliases(gazetteer(spark))
    listed = [(r.alias, r.canonical_name) for r in names.collect()]
    queries = ["ZOMATO", "AMAZN INDIA", "XZOMATOX 12", "FLIPKRT", "NOTHING LIKE IT", "netflix*PAY"]
    got = resolve.resolve(spark.createDataFrame([(x,) for x in queries], "merchant string"), gazetteer(spark), threshold=0.7, top_k=1).collect()
    found = {r.clean: (r.m_canonical_name, r.match_type) for r in got}
    assert found["ZOMATO"] == ("ZOMATO", "exact") and found["XZOMATOX 12"] == ("ZOMATO", "substring") and found["NETFLIX"] == ("NETFLIX", "exact") and "NOTHING LIKE IT" not in found
    for name in ("AMAZN INDIA", "FLIPKRT"):
        score = max(SequenceMatcher(None, name, a).ratio() for a, _ in listed)
        best = next(r.score for r in got if r.clean == name)
        assert best >= score - 1e-9


def test_vote_formula(spark):
    rows = [("fuel", 0.9, "fuel", 0.8, None, None), ("fuel", 0.9, "rent", 0.9, "rent", 0.5), (None,) * 6, ("fuel", 0.2, None, None, None, None), ("fuel", 0.6, "rent", 0.9, None, None)]
    df = spark.createDataFrame(rows, "rule_category string, rule_conf double, ml_category string, ml_conf double, llm_category string, llm_conf double")
    got = [r.vote for r in vote.vote(df, vote.SERVICE).collect()]
    w = vote.SERVICE.weights()
    mean = (0.9 * w["rule"] + 0.8 * w["ml"]) / (w["rule"] + w["ml"])
    assert got[0].method == "ensemble_unanimous" and got[0].confidence == pytest.approx(min(1.0, mean + 0.2), abs=1e-6)
    assert got[1].category == "rent" and got[1].confidence == pytest.approx((0.9 * w["ml"] + 0.5 * w["llm"]) / (w["ml"] + w["llm"]) + 0.1, abs=1e-6)
    assert (got[2].category, got[2].method, got[2].requires_review) == ("Other", "none", True)
    assert got[3].method == "rule" and got[3].confidence == pytest.approx(0.2) and got[3].requires_review
    assert got[4].category == "rent" and got[4].confidence == pytest.approx(0.75, abs=1e-6) and got[4].alternatives[0].category == "fuel"


def test_text_functions(spark):
    assert set(one(spark, "AB CD", T.trigrams(F.col("t")))) == {"ABC", "BCD"} and one(spark, "AB", T.trigrams(F.col("t"))) == ["AB"]
    assert one(spark, "Ünï ½", T.nfkd_ascii(F.col("t"))) == "Uni 12"
    assert one(spark, "x {\"a\": 1} y", T.embedded_json(F.col("t"))) == '{"a": 1}'
    assert one(spark, "POS PAYMENT SHARMA STORES 12 TO BIG BAZAAR MALL", learn.correction_merchant(F.col("t"))) == "BIG BAZAAR MALL"
    assert one(spark, "a.b@c.com 4111 1111 1111 1111 ABCDE1234F", learn.mask_personal(F.col("t"))) == "[EMAIL] [CARD] [TAXID]"


def test_external_answers(spark):
    raw = spark.createDataFrame([("a", 'Sure: {"category": "Food & Dining", "confidence": 0.9, "reasoning": "x"}'), ("b", "no json"), ("c", '{"category": "fuel", "confidence": 7}')], "request_key string, body string")
    got = {r.request_key: (r.llm_category, r.llm_conf) for r in external.responses(raw, ["food_dining", "fuel"]).collect()}
    assert got == {"a": ("food_dining", 0.9), "b": ("Other", 0.5), "c": ("fuel", 0.5)}


def test_rule_scores(spark):
    df = spark.createDataFrame([("bistro lunch", "POS", 50.0, "bistro", "2024-01-12"), ("unknown words", None, 50.0, None, None)], "search_text string, channel string, amount double, merchant string, date string")
    a, b = [r.rule_result for r in rules.categorize_by_rules(df, TAXONOMY).collect()]
    assert (a.rule, a.category, a.confidence) == ("merchant", "food_dining", 0.95) and (b.rule, b.category, b.confidence) == ("scores", "other", 0.4)


def test_word_index_equals_contains(spark):
    import random

    rng = random.Random(2)
    words = [w for r in rules.CASCADE for x in r.when.leaves() if hasattr(x, "words") for w in x.words]
    pieces = [*words, *rules.SHOP_WORDS, "vikas", "mr x", "pan shop", "monthly subscription", "late fee", "gst", "vi", " ", "-", "ap", "e"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", "/"]) for _ in range(rng.randrange(1, 5))), rng.choice([None, "ATM"]), rng.choice([None, 0.0, 90.0, 900.0])) for i in range(1500)] + [(9998, "", None, None), (9999, None, None, None)]
    df = spark.createDataFrame(rows, "i long, t string, c string, a double")
    fields = rules.fields_of(F.col("t"), F.col("c"), F.col("a"))
    indexed, _ = rules.with_cascade(df, fields)
    got, want = {r.i: r._rule for r in indexed.collect()}, {r.i: r.n for r in df.select("i", rules.cascade_number(fields).alias("n")).collect()}
    assert got == want and len(set(got.values())) > 20
    listed = [(k.lower(), n) for n, (k, _, _) in enumerate(rules._keywords(TAXONOMY))]
    for r in df.select(F.coalesce("t", F.lit("")).alias("t"), rules.keywords_in(F.coalesce("t", F.lit("")), TAXONOMY).alias("k")).collect():
        assert sorted(r.k) == [n for k, n in listed if k in r.t]


def test_fuzzy_pairs_lose_nothing(spark):
    import random

    rng = random.Random(6)
    make = lambda: "".join(rng.choice("ABCDE ") for _ in range(rng.randrange(1, 16))).strip() or "A"
    names = sorted({make() for _ in range(60)})
    texts = sorted({make() for _ in range(80)} | {"".join(c for c in n if rng.random() > 0.2) or "B" for n in names})
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "alias string, row_pos int")
    for threshold in (0.7, 0.8):
        got = {(r.clean, r.row_pos): r.score for r in resolve.fuzzy_matches(spark.createDataFrame([(t,) for t in texts], "clean string"), n, threshold).collect()}
        want = {(t, i): s for t in texts for i, x in enumerate(names) if (s := SequenceMatcher(None, t, x).ratio()) >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_every_exit_of_the_route(spark):
    from ledgermint.operators import route

    rows = [
        (1, "ATM WDL 12 MUMBAI", 500.0, "2024-01-05", None), (2, "SWGY dinner", 300.0, None, None), (3, "REFUND AMAZON ORDER 9", 20.0, None, None), (4, "payment / 5541 / station", 900.0, None, None), (5, "unknown words", 50.0, "invalid-date", "5999"),
        (6, "", None, None, None), (7, None, 0.0, "2099-01-01", None), (8, "zomto", 10.0, None, None), (9, "paid TO FLIPKRT", 10.0, None, None), (10, "x" * 1000, -5.0, None, None), (11, "SWGY return", 300.0, None, None), (12, "@@@ ###", None, None, "9999"),
    ]
    df = spark.createDataFrame(rows, "txn_key long, text string, amount double, date string, mcc string")
    got = {r.txn_key: r for r in route.categorize(df, TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark)).collect()}
    assert len(got) == len(rows) and {k: r.method for k, r in got.items() if k in (1, 2, 3, 4, 8, 9)} == {1: "rule_deterministic", 2: "merchant_gazetteer", 3: "rule_deterministic", 4: "mcc_deterministic", 8: "merchant_gazetteer", 9: "merchant_gazetteer"}
    assert (got[1].category, got[1].requires_review, got[1].vote.methods) == ("atm_cash", False, 1) and (got[2].category, got[2].confidence, got[2].merchant_resolved) == ("food_dining", 0.95, "SWIGGY")
    assert got[4].category == "fuel" and got[4].confidence == 0.95 and got[8].merchant_resolved == "ZOMATO" and got[9].merchant_resolved == "FLIPKART"
    # the extracted name needs 0.8, the whole text 0.7; a return takes no merchant's word for it
    assert got[11].method != "merchant_gazetteer" and got[5].method.startswith("ensemble") and got[5].requires_review is not None
    assert all(got[k].category == "other" for k in (6, 7, 10)) and all(0 <= r.confidence <= 1 for r in got.values())
    answers = {r.txn_key: r for r in route.assembled(route.categorize(df.withColumn("currency", F.lit("INR")), TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark))).collect()}
    assert answers[2].alternatives is None and answers[5].alternatives[0].method == answers[5].method and answers[1].normalized.channel == "ATM"
    shown = learn.explanation_json(learn.explain(route.categorize(df, TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark)))).where("txn_key = 2").first().json
    assert '"final_category":"food_dining"' in shown and '"method_used":"merchant_gazetteer"' in shown


def test_a_stream_is_routed_like_a_table(spark, tmp_path):
    from ledgermint.operators import route

    df = spark.createDataFrame([(i, t, 10.0, None, None) for i, t in enumerate(["ATM WDL 1", "ZOMATO x", "plain words"])], "txn_key long, text string, amount double, date string, mcc string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    parts = (TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark))
    q = route.stream_categorize(stream, lambda rows, n: rows.select("txn_key", "category", "method").write.mode("overwrite").parquet(f"{tmp_path}/out/{n}"), *parts).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in route.categorize(df, *parts).select("txn_key", "category", "method").collect())


def test_batches_under_other_names(spark):
    df = spark.createDataFrame([(1, None, "UPI-1-ZOMATO PAY", "2024-01-05"), (2, "ATM WDL 5", "x", None)], "k int, text string, description string, timestamp string")
    got = {r.k: (r.channel, r.currency, str(r.norm_date)) for r in normalize.normalize_batch(df).collect()}
    assert got == {1: ("UPI", "INR", "2024-01-05"), 2: ("ATM", "INR", "None")}


def test_word_index_finds_the_lists_of_all_words_in_one_pass():
    import random

    import pyarrow as pa
    from ledgermint.functions.predicates import PIECE, WordIndex

    rng = random.Random(4)
    index = WordIndex([("a", "ab"), ("bab", "b c"), ("abab",), ("c" * 20, "x1"), ("a", "ab")])
    texts = [None, "", "é ab", "z" * (PIECE - 2) + "abab" + "z" * PIECE, "z" * 236 + "c" * 20, "ab" * 2000]
    texts += ["".join(rng.choice(["a", "b", " c", "c" * 19, "x", "1", "日"]) for _ in range(rng.choice([1, 3, 8, 400]))) for _ in range(300)]
    want = [None if t is None else sorted(i for words, i in index.lists.items() if any(w in t for w in words)) for t in texts]
    assert index.numbers_in(pa.array(texts)).to_pylist() == want
    assert index.numbers_in(pa.array(["x", *texts])[1:]).to_pylist() == want
    assert WordIndex([]).numbers_in(pa.array(["a", None])).to_pylist() == [[], None]


def test_words_are_looked_for_without_regular_expressions(spark):
    rows = spark.createDataFrame([("PAID TO RAHUL NETFLIX", "UPI", 5.0), (None, None, None)], "search_text string, channel string, amount double")
    ruled, _ = rules.with_cascade(rows, rules.fields_of(F.col("search_text"), F.col("channel"), F.col("amount")))
    plan = ruled._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("lists_of") == 2
    assert [rules.CASCADE[r[0] - 1].name if r[0] else None for r in ruled.select("_rule").collect()] == ["person_name_upi", None]


def test_texts_without_a_needed_word_match_no_pattern(spark):
    import random

    rng = random.Random(9)
    parts = ["UPI", "imps-", "Neft ", "RTGS", "pos ", "ATM WDL", "card", "Debit", "CREDIT", "REF", "txn#", "transaction", "RRN:", "AT", "@ ", "in ", "Mumbai", "to ", "*PAY", "-pmt", "paid to ", "FROM ", "inr", "Rs ", "₹", "12", "1,200.5", "5 jan 24", "2024-01-05", "7/8/2024", "/", "-", " "]
    rows = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 7)))) for i in range(3000)], "i int, t string")
    t = F.col("t")
    for p in normalize.NEEDS:
        assert rows.where(t.rlike(p) & ~normalize.may_match(t, p)).count() == 0
    for p in (*normalize.REFERENCES, *normalize.LOCATIONS, *normalize.MERCHANTS):
        assert rows.where(~normalize.searched(t, p).eqNullSafe(T.found(t, p))).count() == 0
    assert rows.select(normalize.clean_text(t)).collect() == rows.select(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(t, "₹", ""), r"\s+", " ")), r"[^\w\s\-./:*@]", ""), r"[\-./:*@]{2,}", ""))).collect()


def test_exact_and_substring_derive_their_texts_once(spark, monkeypatch, tmp_path):
    listed = [(0, 1, "UBER", "uber,uber trip,ubereats,a*star,été"), (1, 2, "EATS", "eats,😀😀x😀y"), (2, 3, "ABC", "abc")]
    names = resolve.aliases(spark.createDataFrame([(*r, "c", "s") for r in listed], "row_pos int, merchant_id int, canonical_name string, aliases string, category string, subcategory string"))
    texts = ["UBER", "UBER TRIP", "MY UBER TRIP", "XUBEREATSY", "EATS AND UBER", "ABC", "ABCD", "UB ER", "ÉTÉ", "AB", "A STAR", "Q😀😀X😀YQ", "UBE", "SEATS\nUBERX", "*UBER*"]
    spark.createDataFrame([(t,) for t in texts * 3], "clean string").write.parquet(f"{tmp_path}/t")
    known = [(r.alias, r.m) for r in names.select("alias", F.struct("pos", "canonical_name").alias("m")).collect()]
    want = {}
    for t in texts:
        whole = [m for a, m in known if a == t]
        within = [m for a, m in known if len(a) >= 4 and not set(a) & {"*", " "} and a in t]
        if whole or within:
            want[t] = (min(whole or within).canonical_name, 1.0 if whole else 0.85, "exact" if whole else "substring")
    distinct = spark.read.parquet(f"{tmp_path}/t").distinct()
    for most in (resolve.MOST_NAMES, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(resolve, "MOST_NAMES", most)
        found = resolve.exact_and_substring(distinct, names)
        rows = found.collect()
        assert len(rows) == len(want) and {r.clean: (r.m_canonical_name, r.score, r.match_type) for r in rows} == want
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Scan parquet") == 1
    marks = ["SHOP*PAY -PAYMENT x", "a.-/ *b", "INTL TRX PAY*", None, " \t*-PAY\n", "uber-payments"]
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce("t", F.lit(""))), r"\*PAYMENT|\*PAY|-PAYMENT|-PAY|INTL TRX ", ""), r"[*\-/.]+", " "), r"\s+", " "))
    assert all(r.a == r.b for r in spark.createDataFrame([(t,) for t in marks], "t string").select(resolve.clean_merchant(F.col("t")).alias("a"), plain.alias("b")).collect())


@pytest.mark.parametrize("most", [200_000, 0])
def test_rows_without_a_name_do_not_meet_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "MOST_NAMES", most)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 1000 == 0, "ZOMATO").alias("merchant"), F.when(F.col("id") % 1000 == 1, "MY SWIGGY").alias("text"))
        out = resolve.attach_merchant(rows, gazetteer(spark), text="text")
        found = {r["id"]: r.merchant_resolved for r in out.collect()}
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert found == {i: {0: "ZOMATO", 1: "SWIGGY"}.get(i % 1000) for i in range(4000)}
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_tokens_are_made_after_the_texts_are_dealt(spark):
    texts = spark.createDataFrame([("ZOMATTO",)], "clean string")
    names = resolve.aliases(gazetteer(spark))
    pairs = similarity.jaccard_pairs(texts, names, 0.7, "clean", names.count())
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line and "clean" in line]
    assert dealt and not [line for line in plan[dealt[0] :] if "substring" in line and "Filter" in line and "clean" in line]


def test_the_first_matching_pattern_decides_even_where_its_group_is_empty(spark):
    texts = ["UPI/5/ZOMATO", "IMPS-12-TO-", "IMPS-12-TO VIKAS", "POS 12 SHOP", "POS", "UPI", "A-UPI x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("channel", normalize.channel_of(F.col("t")))
    for compat, groups in ((False, normalize.NAME_GROUP), (True, normalize.COMPAT_GROUP)):
        expected = None
        for name in groups:
            for p, g in zip(normalize.CHANNELS[name], groups[name], strict=True):
                test, value = (F.col("channel") == name) & F.col("t").rlike(p), F.trim(F.nullif(F.regexp_extract("t", p, g), F.lit("")))
                expected = F.when(test, value) if expected is None else expected.when(test, value)
        other = normalize.merchant_of(F.col("t"), F.lit(None).cast("string"), compat)
        got = rows.select(normalize.merchant_of(F.col("t"), F.col("channel"), compat).alias("got"), expected.otherwise(other).alias("want")).collect()
        assert [r.got for r in got] == [r.want for r in got]


def test_rows_that_a_rule_settles_are_written_once_and_not_searched(spark, monkeypatch):
    from ledgermint.operators import route

    rows = spark.createDataFrame([(1, "ATM WDL 42 MUMBAI", 500.0, "2024-01-05", None, "INR"), (2, "POS PUR / 5411 / old ring", 90.0, "2024-01-06", None, "INR"), (3, "IMPS-17-TO-VIKAS", 70.0, None, None, "INR")], "txn_key long, text string, amount double, date string, mcc string, currency string")
    written, searched = [], []
    write, attach = route.materialise, route.attach_merchant
    monkeypatch.setattr(route, "materialise", lambda df: (written.append(df.columns), write(df))[1])
    monkeypatch.setattr(route, "attach_merchant", lambda df, *a: (searched.append(df), attach(df, *a))[1])
    routed = route.categorize(rows, TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark))
    assert len(written) == 1 and not {"reference", "norm_amount", "norm_date"} & set(written[0])
    assert sorted(r.txn_key for r in searched[0].collect()) == [2, 3]
    got = {r.txn_key: r for r in routed.collect()}
    assert [got[k].method for k in (1, 2, 3)] == ["rule_deterministic", "mcc_deterministic", "rule"] and str(got[1].norm_date) == "2024-01-05"
    settled = got[1].vote
    assert (settled.category, settled.method, settled.agreement, settled.methods, settled.alternatives, settled.requires_review, settled.weighted) == ("atm_cash", "rule_deterministic", 1, 1, [], False, {"atm_cash": 0.95})


def test_scores_equal_brute_force_without_lambdas(spark):
    import random
    import re

    rng = random.Random(12)
    twice = [rules.Category("a", keywords=("ring", "ring", "atm")), rules.Category("b", patterns=(".*food.*delivery.*", ".*(hotel|flight).*"))]
    pieces = [*[k for c in TAXONOMY for k in c.keywords], "food", "delivery", "pharma", "order", "neft", " ", "-", "x"]
    df = spark.createDataFrame([(" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 5))),) for _ in range(400)], "t string").select("t", F.lit(None).cast("string").alias("c"), F.lit(None).cast("double").alias("a"))
    for taxonomy in (TAXONOMY, twice):
        indexed, fields = rules.with_cascade(df, rules.fields_of(F.col("t"), F.col("c"), F.col("a")), taxonomy)
        assert "lambda" not in indexed.select(rules.scores(fields, taxonomy))._jdf.queryExecution().optimizedPlan().toString()
        for r in rules.best_score(indexed, fields, taxonomy, F.lit(True)).select("t", "_best", rules.keyword_scores(fields, taxonomy).alias("all")).collect():
            want = [(round(sum(k in r.t for k in c.keywords) + 1.2 * sum(bool(re.search(p, r.t)) for p in c.patterns), 6), -i, c.id) for i, c in enumerate(taxonomy)]
            want = [s for s in want if s[0] > 0]
            assert [tuple(s) for s in r["all"]] == want and (tuple(r._best) if r._best else None) == max(want, default=None)


def test_a_session_keeps_its_own_bound_on_methods(spark):
    from ledgermint.functions.lineage import compiled_by_parts

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        for own, kept in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, own)
            compiled_by_parts(spark)
            assert spark.conf.get(name) == kept
    finally:
        spark.conf.set(name, before)
