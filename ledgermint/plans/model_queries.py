"""Registered queries of learning, tuning and the later additions, with SQL for the check."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermint.functions.lineage import materialise
from ledgermint.functions.text import cache_digest
from ledgermint.operators import calibration, embedding, evaluate, export, jobs, learn, ml, preprocess, route, tenancy, tuning
from ledgermint.streaming import monitor

from .fixture import txn, with_txn
from .queries import _SCORED, _scored, _voted, _with_vote, q, query, read

# --- weights of the vote ---------------------------------------------------------------------------------
_GRID = tuning.weight_grid(0.25)
_VECTORS = ", ".join(f"({i}, {w['mcc']}::double, {w['rule']}::double, {w['ml']}::double, {w['llm']}::double)" for i, w in enumerate(_GRID))
_WAYS = (("mcc", "mc", "a"), ("rule", "rc", "b"), ("ml", "lc", "c"), ("llm", "xc", "d"))
_SUM_OF = lambda cat: "round(" + " + ".join(f"CASE WHEN {m} = {cat} THEN round({c}, 6) * {w} ELSE 0 END" for m, c, w in _WAYS) + ", 9)"
_WINNER = "CASE WHEN coalesce(d > 0 AND rule <> ml AND llm IS NOT NULL, false) THEN llm ELSE coalesce(list_max(list_filter([" + ", ".join(f"CASE WHEN {m} IS NOT NULL THEN {{'s': {_SUM_OF(m)}, 'o': {-i}, 'c': {m}}} END" for i, (m, _, _) in enumerate(_WAYS)) + "], lambda x: x IS NOT NULL)).c, 'Other') END"


@query("d9_weight_search", with_txn(f""", grid(vector, a, b, c, d) AS (VALUES {_VECTORS}), won AS (SELECT vector, label, {_WINNER} AS pred FROM v, grid),
t AS (SELECT vector, label AS class, count(*) AS support, count_if(label = pred) AS tp FROM won GROUP BY ALL), p AS (SELECT vector, pred AS class, count(*) AS predicted FROM won GROUP BY ALL)
SELECT t.vector, round(avg(coalesce(2 * tp / (support + coalesce(predicted, 0)), 0)), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS accuracy, sum(support)::bigint AS rows FROM t LEFT JOIN p ON t.vector = p.vector AND t.class = p.class GROUP BY t.vector""", _SCORED))
def d9_weight_search(spark, sf):
    """All weight vectors in steps of a quarter, judged over all votes."""
    return tuning.judged_weights(_scored(spark, sf), _GRID).drop("weights")


# --- evaluation ---------------------------------------------------------------------------------------------
@query("j23_joined_labels", with_txn("""SELECT count(*) AS n, count_if(t.label = p.rule)::bigint AS correct, p.rule AS pred FROM (SELECT txn_key, rule FROM v WHERE rule IS NOT NULL) p JOIN (SELECT txn_key, min(label) AS label FROM txn GROUP BY txn_key) t ON p.txn_key = t.txn_key GROUP BY p.rule""", _SCORED))
def j23_joined_labels(spark, sf):
    """Predictions of one table joined to labels of another by the transaction's key."""
    predictions = _scored(spark, sf).where("rule_category IS NOT NULL").select("txn_key", F.col("rule_category").alias("pred"))
    found = evaluate.joined(predictions, txn(spark, sf).select("txn_key", "label"))
    return found.groupBy("pred").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("correct"))


_F1 = "c AS (SELECT label AS class, count(*) AS support, count_if(label = pred) AS tp FROM p GROUP BY label), k AS (SELECT pred AS class, count(*) AS predicted FROM p GROUP BY pred), f AS (SELECT c.class, support, tp, coalesce(2 * tp / (support + predicted), 0) AS f1 FROM c LEFT JOIN k ON c.class = k.class)"


@query("g23_report_totals", _with_vote(f", {_F1} SELECT count(*) AS classes, sum(support)::bigint AS total_rows, sum(support - tp)::bigint AS total_errors, count_if(round(f1, 6) = 1)::bigint AS perfect, count_if(round(f1, 6) >= 0.99)::bigint AS nearly_perfect FROM f"))
def g23_report_totals(spark, sf):
    return evaluate.report_totals(evaluate.class_report(_voted(spark, sf)))


@query("g24_misclassified", _with_vote(f", {_F1} SELECT class, support, (support - tp)::bigint AS incorrect, round(1 - (support - tp) / support, 6) AS accuracy FROM f WHERE support > tp"))
def g24_misclassified(spark, sf):
    return evaluate.misclassified(evaluate.class_report(_voted(spark, sf)))


# --- request cache and exports ----------------------------------------------------------------------------
_CENTS = "cast(round(amount * 100) as bigint)"


@query("j25_request_cache", with_txn(f", c AS (SELECT text, {_CENTS} AS cents, date, currency, min(label) AS category FROM txn WHERE flag = 'R' GROUP BY ALL) SELECT txn_key, sha256(concat_ws(chr(31), text, cast({_CENTS} as varchar), date, currency)) AS cache_key, c.category AS cached_category FROM txn t LEFT JOIN c USING (text, date, currency) WHERE c.cents IS NULL OR c.cents = cast(round(t.amount * 100) as bigint) UNION ALL SELECT txn_key, sha256(concat_ws(chr(31), text, cast({_CENTS} as varchar), date, currency)), NULL FROM txn t WHERE EXISTS (SELECT 1 FROM c WHERE c.text = t.text AND c.date = t.date AND c.currency = t.currency) AND NOT EXISTS (SELECT 1 FROM c WHERE c.text = t.text AND c.date = t.date AND c.currency = t.currency AND c.cents = cast(round(t.amount * 100) as bigint))"))
def j25_request_cache(spark, sf):
    """Requests looked up by text, amount, date and currency in the cache of returned ones."""
    t = txn(spark, sf).withColumn("amount_cents", F.round(F.col("amount") * 100).cast("long"))
    key = cache_digest(*[F.col(c) for c in ("text", "amount_cents", "date", "currency")])
    cache = t.where("flag = 'R'").groupBy(key.alias("cache_key")).agg(F.min("label").alias("category"))
    return tenancy.with_cached(t, cache).select("txn_key", "cache_key", "cached_category")


@query("k9_other_forms", with_txn("SELECT txn_key, text, label, round(abs(amount), 2) AS amount, date, 'ACCREC' AS type, text AS described, 1 AS quantity, round(abs(amount), 2) AS unit, '200' AS account FROM txn"))
def k9_other_forms(spark, sf):
    """The standard and the coded form, both made of the row, read again from their JSON."""
    t = txn(spark, sf).withColumn("category", F.col("label")).select("txn_key", "text", "category", "amount", "date")
    get = lambda form, path: F.get_json_object(form, path)
    both = t.select("txn_key", export.json_column(t, "standard").alias("standard"), export.json_column(t, "coded").alias("coded"))
    line = "$.LineItems[0]."
    return both.select("txn_key", get("standard", "$.text").alias("text"), get("standard", "$.category").alias("label"), F.round(F.abs(get("standard", "$.amount").cast("double")), 2).alias("amount"), get("coded", "$.Date").alias("date"), get("coded", "$.Type").alias("type"), get("coded", f"{line}Description").alias("described"), get("coded", f"{line}Quantity").cast("int").alias("quantity"), F.round(get("coded", f"{line}UnitAmount").cast("double"), 2).alias("unit"), get("coded", f"{line}AccountCode").alias("account"))


# --- labels by keywords ------------------------------------------------------------------------------------
_KEYWORDS = "CASE " + " ".join("WHEN " + " OR ".join([*(f"contains(x, {q(w)})" for w in words), *(f"regexp_matches(x, {q(p)})" for p in patterns)]) + f" THEN '{label}'" for label, words, patterns in route.KEYWORD_LABELS) + " END"


@query("c15_keyword_labels", f"SELECT label, count(*) AS n, sum(k)::bigint AS keys FROM (SELECT doc_id AS k, {_KEYWORDS} AS label FROM (SELECT doc_id, lower(text) AS x FROM documents) UNION ALL SELECT conv_id, {_KEYWORDS} FROM (SELECT conv_id, lower(text) AS x FROM conversations)) GROUP BY label")
def c15_keyword_labels(spark, sf):
    """The twelve further categories over the texts of documents and conversations."""
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text").unionByName(read(spark, sf, "conversations").select(F.col("conv_id").alias("k"), "text"))
    return texts.groupBy(route.label_by_keywords(F.col("text")).alias("label")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


# --- JSON of several shapes --------------------------------------------------------------------------------
_DEEP = "'{\"id\":[1,2],\"outer\":{\"list\":[{\"merchant\":\"no\"}],\"inner\":{\"store-name\":\"' || event_type || ' SHOP\",\"amount\":{\"value\":' || cast(user_id as string) || ',\"unit\":\"x\"}}}}'"
_ODD = "'{\"k1\":{\"list\":[],\"deep\":{\"z\":1},\"n\":' || cast(user_id as string) || '},\"k2\":[3],\"k3\":\"' || event_type || '\",\"k4\":{\"e\":{}},\"k5\":5,\"k6\":6}'"


@query("n9_json_shapes", """SELECT event_id, CASE event_id % 2 WHEN 0 THEN event_type || ' SHOP Rs ' || format('{:,}', user_id) || '.00' ELSE 'n: ' || user_id || ', k3: ' || event_type || ', k5: 5' END AS text, CASE WHEN event_id % 2 = 0 THEN user_id::double END AS amount, CASE WHEN event_id % 2 = 0 THEN event_type || ' SHOP' END AS merchant FROM events""")
def n9_json_shapes(spark, sf):
    """Fields at the third level, in a list that is not entered and under `value`; and a document without any known field."""
    e = read(spark, sf, "events").selectExpr("event_id", f"CASE event_id % 2 WHEN 0 THEN {_DEEP} ELSE {_ODD} END AS text")
    return preprocess.preprocess(e).select("event_id", "prepared.text", "prepared.amount", "prepared.merchant")


# --- monitoring ---------------------------------------------------------------------------------------------
@query("z9_errors_by_endpoint", """SELECT * FROM (SELECT start, kind, endpoint, n, row_number() OVER (PARTITION BY start ORDER BY n DESC, kind, endpoint) AS rank FROM (SELECT floor(epoch(ts))::bigint // 86400 * 86400 AS start, event_type AS kind, '/v' || (json_extract_string(props, '$.k')::bigint % 5) AS endpoint, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL)) WHERE rank <= 10""")
def z9_errors_by_endpoint(spark, sf):
    """The ten most frequent failures of each day by type and endpoint."""
    e = read(spark, sf, "events").where("event_type IN ('error', 'signup')").select("ts", F.col("event_type").alias("kind"), F.concat(F.lit("/v"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")).alias("endpoint"))
    counts = monitor.rates(e, "1 day", by=("kind", "endpoint"))
    return monitor.top_per_window(counts, 10, ties=("kind", "endpoint")).select(F.unix_timestamp("start").alias("start"), "kind", "endpoint", "n", "rank")


def requests(events: DataFrame) -> DataFrame:
    """Events as requests of the service: failures, reviews, seconds, agreement of the votes and cache hits."""
    return events.select("ts", (F.col("event_type") == "error").alias("error"), (F.col("event_type") == "signup").alias("review"), (F.col("value") / 50).alias("seconds"), (F.col("user_id") % 3 == 0).alias("agreement"), (F.col("user_id") % 5 == 0).alias("hit"))


_RULES = (("errors", "errors > 0.05", 1), ("reviews", "reviews > 0.3", 1), ("p95", "p95 > 2.0", 1), ("agreement", "agreement < 0.6", 1), ("hits", "hits < 0.2", 1))
_BOUNDED = [*monitor.LATENCY_BOUNDS]
_P95 = "CASE " + " ".join(f"WHEN le_{i} >= 0.95 * n THEN " + (f"CASE WHEN le_{i} - {f'le_{i - 1}' if i else 0} > 0 THEN {_BOUNDED[i - 1] if i else 0.0} + {b - (_BOUNDED[i - 1] if i else 0.0)} * (0.95 * n - {f'le_{i - 1}' if i else 0}) / (le_{i} - {f'le_{i - 1}' if i else 0}) ELSE {_BOUNDED[i - 1] if i else 0.0} END") for i, b in enumerate(_BOUNDED)) + f" ELSE {_BOUNDED[-1]} END"
_HOURS = f"m AS (SELECT floor(epoch(ts))::bigint // 3600 * 3600 AS start, count(*) AS n, avg((event_type = 'error')::int) AS errors, avg((event_type = 'signup')::int) AS reviews, avg((user_id % 3 = 0)::int) AS agreement, avg((user_id % 5 = 0)::int) AS hits, {', '.join(f'count_if(value / 50 <= {b}) AS le_{i}' for i, b in enumerate(_BOUNDED))} FROM events GROUP BY 1), w AS (SELECT *, round({_P95}, 6) AS p95 FROM m)"


@query("z11_rule_alerts", f"WITH {_HOURS}, " + ", ".join(f"o_{n} AS (SELECT '{n}' AS measure, start, row_number() OVER (ORDER BY start) - row_number() OVER (PARTITION BY coalesce({t}, false) ORDER BY start) AS island, coalesce({t}, false) AS live FROM w)" for n, t, _ in _RULES) + " SELECT measure, min(start) AS \"from\", max(start) AS \"to\", count(*) AS evaluations FROM (" + " UNION ALL ".join(f"SELECT * FROM o_{n}" for n, _, _ in _RULES) + ") WHERE live GROUP BY measure, island")
def z11_rule_alerts(spark, sf):
    """The five alert rules on hourly windows; each window of an hour fills the time that a rule asks for."""
    m = monitor.service_metrics(requests(read(spark, sf, "events")), "1 hour").withColumn("start", F.unix_timestamp("start"))
    return monitor.rule_alerts(m, minutes=60).select("measure", "from", "to", "evaluations")


@query("t2_recent_reviews", with_txn(""", d AS (SELECT txn_key, min(date) AS date FROM txn GROUP BY txn_key), x AS (SELECT min(txn_key) AS txn_key, 0.5 AS confidence, date FROM d GROUP BY date)
SELECT txn_key, round(least(1.0, (1 - c) + 0.3), 6) AS uncertainty FROM (SELECT txn_key, (txn_key % 50) / 100 AS c FROM x WHERE date::date >= date '1998-06-01' - 7 AND NOT (txn_key % 3 = 0) ORDER BY c, txn_key LIMIT 50)"""))
def t2_recent_reviews(spark, sf):
    """The review queue of one day: rows of the last seven days that nobody has reviewed."""
    d = txn(spark, sf).groupBy("txn_key").agg(F.min("date").alias("date")).groupBy("date").agg(F.min("txn_key").alias("txn_key"))
    rows = d.select("txn_key", F.to_date("date").alias("created"), (F.col("txn_key") % 50 / 100).alias("confidence"), F.lit("ml").alias("method"), F.lit(True).alias("requires_review"), (F.col("txn_key") % 3 == 0).alias("reviewed"))
    return learn.review_queue(rows, created="created", today=F.to_date(F.lit("1998-06-01"))).select("txn_key", "uncertainty")


# --- models -------------------------------------------------------------------------------------------------
_WORDS = "list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '0' ELSE w END)"


@query("m1_word_information", with_txn(f""", d AS (SELECT {_WORDS} AS w, n FROM (SELECT text, count(*) AS n FROM txn GROUP BY text)), p AS (SELECT w, n, unnest(range(1, len(w) + 1)) AS i FROM d), o AS (SELECT w[i] AS word, w, n, i, unnest(range(1, 5)) AS k FROM p),
h AS (SELECT word, w[i + k] AS other, n FROM o WHERE i + k <= len(w)), b AS (SELECT word, other, sum(n) AS n FROM (SELECT word, other, n FROM h UNION ALL SELECT other, word, n FROM h) GROUP BY ALL), t AS (SELECT word, sum(n) AS t FROM b GROUP BY word)
SELECT b.word, b.other, round(ln(b.n * (SELECT sum(t) FROM t) / (x.t * y.t)), 6) AS value FROM b JOIN t x ON b.word = x.word JOIN t y ON b.other = y.word WHERE ln(b.n * (SELECT sum(t) FROM t) / (x.t * y.t)) > 0"""))
def m1_word_information(spark, sf):
    """How much more often than by chance words of the transactions stand near each other."""
    return embedding.information(embedding.cooccurrence(txn(spark, sf))).select("word", "other", F.round("value", 6).alias("value"))


@query("m1_neighbours")
def m1_neighbours(spark, sf):
    """The nearest words of some brands, by vectors learned from all texts; tests look at planted synonyms."""
    words = embedding.word_vectors(txn(spark, sf), size=16, steps=3)
    return embedding.neighbours(words, ["zomato", "uber", "amazon", "rent"], 3)


def _cases(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("txn_key"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


@query("m3_boosted")
def m3_boosted(spark, sf):
    """Boosted trees on four fifths of the embeddings; the metrics of the rest, which they have not seen."""
    rows = _cases(spark, sf).withColumn("features", array_to_vector("features"))
    return jobs.train(rows, kind="boosted", vector="features", weighted=False, rounds=6, depth=2, bins=16).metrics


@query("m4_calibrated")
def m4_calibrated(spark, sf):
    """Out-of-fold probabilities of the embeddings made monotone in the truth: rows, mean log loss before and after."""
    rows = _cases(spark, sf).withColumn("features", array_to_vector("features"))
    scored, labels = ml.out_of_fold(rows, "txn_key", kind="boosted", vector="features", rounds=4, depth=2, bins=16)
    scored = materialise(scored)
    curves = calibration.isotonic(calibration.step_sums(scored, labels))
    made = calibration.calibrated(scored, curves, labels)
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    loss = lambda p: F.round(F.avg(-F.log(F.greatest(F.get(p, at), F.lit(1e-6)))), 6)
    return made.agg(F.count("*").alias("n"), loss("probability").alias("loss_before"), loss("calibrated").alias("loss_after"))
