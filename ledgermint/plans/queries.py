"""Registered queries: each runs an operator over its whole tables, with SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermint.functions.lineage import materialise
from ledgermint.functions.predicates import first_of_sql
from ledgermint.operators import dataset, evaluate, export, external, jobs, learn, merchant_codes, merchant_index, ml, normalize, preprocess, resolve, route, rules, tenancy, vote
from ledgermint.sources import readers
from ledgermint.streaming import monitor

from .fixture import BRANDS, TAXONOMY, _case, gazetteer, txn, txn_sql, with_txn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- normalisation -------------------------------------------------------------------------------
_CLEAN = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\w\s\-./:*@]', '', 'g'), '[\-./:*@]{2,}', '', 'g'))"
_GOT = lambda c, p, g=1: f"nullif(regexp_extract({c}, {q(p)}, {g}), '')"
_CHANNEL = "CASE " + " ".join(f"WHEN regexp_matches(t, {q('|'.join(f'(?:{p})' for p in ps))}) THEN '{c}'" for c, ps in normalize.CHANNELS.items()) + " END"
_MERCHANT = (
    "CASE " + " ".join(f"WHEN channel = '{c}' AND regexp_matches(t, {q(p)}) THEN nullif(trim(regexp_extract(t, {q(p)}, {g})), '')" for c, gs in normalize.NAME_GROUP.items() for p, g in zip(normalize.CHANNELS[c], gs, strict=True))
    + " ELSE coalesce(trim(" + "), trim(".join(_GOT("t", p) for p in normalize.MERCHANTS) + r"), nullif(CASE WHEN length(r) >= 3 THEN r END, '')) END"
)
_REST = r"trim(regexp_replace(regexp_replace(regexp_replace(t, '^\W+|\W+$', '', 'g'), '\s+\d{6,}.*$', '', 'g'), '(?i)\b(transaction|payment|purchase|order|bill)\b', '', 'g'))"
NORMAL_SQL = f"""n1 AS MATERIALIZED (SELECT *, {_CLEAN} AS t FROM txn), n2 AS MATERIALIZED (SELECT *, {_CHANNEL} AS channel, {_REST} AS r FROM n1),
n3 AS MATERIALIZED (SELECT *, coalesce({', '.join(_GOT('t', p) for p in normalize.REFERENCES)}) AS reference, coalesce({', '.join(_GOT('t', p) for p in normalize.LOCATIONS)}) AS location, {_MERCHANT} AS merchant FROM n2),
n4 AS MATERIALIZED (SELECT *, concat_ws(' ', t, 'channel:' || channel, 'merchant:' || merchant, 'location:' || location) AS search_text FROM n3)"""


def with_normal(select: str) -> str:
    return with_txn(select, NORMAL_SQL)


@query("n20_normalize", with_normal("SELECT txn_key, t AS cleaned_text, channel, reference, location, merchant, cast(cast(amount as decimal(15,2)) as varchar) AS norm_amount, date AS norm_date, search_text FROM n4"))
def n20_normalize(spark, sf):
    n = normalize.normalize(txn(spark, sf))
    return n.select("txn_key", "cleaned_text", "channel", "reference", "location", "merchant", F.col("norm_amount").cast("string").alias("norm_amount"), F.col("norm_date").cast("string").alias("norm_date"), "search_text")


@query("n13_channels", with_normal("SELECT template, channel, count(*) AS n FROM n3 GROUP BY ALL"))
def n13_channels(spark, sf):
    return normalize.normalize(txn(spark, sf)).groupBy("template", "channel").agg(F.count("*").alias("n"))


@query("n12_abbreviations", with_txn("SELECT text, " + "trim(" + "list_aggregate(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in normalize.ABBREVIATIONS.items()) + " ELSE w END), 'string_agg', ' ')" + ") AS expanded, count(*) AS n FROM txn GROUP BY ALL"))
def n12_abbreviations(spark, sf):
    return txn(spark, sf).groupBy("text", normalize.expand_abbreviations(F.col("text")).alias("expanded")).agg(F.count("*").alias("n"))


@query("n23_features", with_normal("""SELECT channel, count(*) AS n, sum(length(t)) AS text_length, sum(length(t) - length(replace(t, ' ', '')) + 1) AS words, sum(CASE WHEN amount < 100 THEN 1 WHEN amount < 500 THEN 2 WHEN amount < 2000 THEN 3 WHEN amount < 10000 THEN 4 ELSE 5 END) AS buckets,
round(sum(ln(1 + amount)), 4) AS logs, sum(cast(day(cast(date as date)) >= 25 as int)) AS month_ends, sum(isodow(cast(date as date)) - 1) AS week_days, sum(cast(isodow(cast(date as date)) >= 6 as int)) AS weekends, sum(quarter(cast(date as date))) AS quarters,
sum(cast(contains(lower(t), 'zomato') OR contains(lower(t), 'swiggy') OR contains(lower(t), 'food') OR contains(lower(t), 'restaurant') OR contains(lower(t), 'cafe') OR contains(lower(t), 'dining') as int)) AS food, sum(length(coalesce(merchant, ''))) AS merchant_length FROM n3 GROUP BY channel"""))
def n23_features(spark, sf):
    f = normalize.features(normalize.normalize(txn(spark, sf)))
    total = lambda c, name: F.sum(F.col(f"f_{c}").cast("int")).alias(name)
    return f.groupBy("channel").agg(F.count("*").alias("n"), total("text_length", "text_length"), total("word_count", "words"), total("amount_bucket", "buckets"), F.round(F.sum("f_amount_log"), 4).alias("logs"), total("is_month_end", "month_ends"), total("day_of_week", "week_days"), total("is_weekend", "weekends"), total("quarter", "quarters"), total("contains_food", "food"), total("merchant_length", "merchant_length"))


_JSON = "'{\"event_id\":' || cast(event_id as string) || ',\"data\":{\"merchant_name\":\"' || upper(event_type) || ' STORE\",\"total_amount\":\"' || cast(user_id as string) || ',000.5\"},\"currency\":\"USD\",\"date\":\"' || substr(cast(ts as string), 1, 10) || '\"}'"


@query("n2_preprocess_json", "SELECT event_id, upper(event_type) || ' STORE USD ' || format('{:,}', user_id * 1000) || '.50' AS text, cast(user_id as double) * 1000 + 0.5 AS amount, substr(cast(ts as varchar), 1, 10) AS date, 'USD' AS currency, upper(event_type) || ' STORE' AS merchant FROM events")
def n2_preprocess_json(spark, sf):
    e = read(spark, sf, "events").selectExpr("event_id", f"{_JSON} AS text")
    p = preprocess.preprocess(e)
    return p.select("event_id", "prepared.text", "prepared.amount", "prepared.date", "prepared.currency", "prepared.merchant")


# --- rules, codes, merchants, votes ----------------------------------------------------------------
_FIELDS = {"lower": "lower(search_text)", "upper": "upper(search_text)", "channel": "channel", "amount": "amount"}
_RULE = first_of_sql(_FIELDS, [(r.when, r.name) for r in rules.CASCADE], None)
_SUB = "CASE " + " ".join(f"WHEN RULE_NAME = '{r.name}' THEN {first_of_sql(_FIELDS, list(r.choices), r.subcategory)}" for r in rules.CASCADE if r.choices) + " ELSE v.sub END"
_RULE_VALUES = ", ".join(f"('{r.name}', '{r.category}', {q(r.subcategory)}, {r.confidence}::double)" for r in rules.CASCADE)


@query("c1_rule_cascade", with_normal(f", c AS MATERIALIZED (SELECT *, {_RULE} AS rule FROM n4) SELECT c.rule, v.category, {_SUB.replace('RULE_NAME', 'c.rule')} AS subcategory, v.confidence, count(*) AS n FROM c LEFT JOIN (VALUES {_RULE_VALUES}) v(rule, category, sub, confidence) ON c.rule = v.rule GROUP BY ALL"))
def c1_rule_cascade(spark, sf):
    n = normalize.normalize(txn(spark, sf))
    ruled, fields = rules.with_cascade(n, rules.fields_of(F.col("search_text"), F.col("channel"), F.col("amount")))
    made = ruled.select(rules.rule_struct(F.col("_rule"), fields).alias("r"))
    return made.groupBy("r.rule", "r.category", "r.subcategory", "r.confidence").agg(F.count("*").alias("n"))


def _scores_sql() -> str:
    pos = {c.id: i for i, c in enumerate(TAXONOMY)}
    low = "lower(search_text)"
    parts = {c.id: [f"CASE WHEN contains({low}, {q(k)}) THEN 1.0 ELSE 0.0 END" for k in c.keywords] + [f"CASE WHEN regexp_matches({low}, {q(p)}) THEN 1.2 ELSE 0.0 END" for p in c.patterns] for c in TAXONOMY}
    for group in rules.HINTS:
        before: list[str] = []
        for p, category, score in group:
            if category in parts:
                test = " AND ".join([p.sql(_FIELDS), *[f"NOT {b}" for b in before]])
                parts[category].append(f"CASE WHEN {test} THEN {score} ELSE 0.0 END")
            before.append(p.sql(_FIELDS))
    rows = ", ".join(f"{{'s': round(cast({' + '.join(v)} as double), 6), 'o': -{pos[k]}, 'c': '{k}'}}" for k, v in parts.items())
    return f"list_max([{rows}])"


@query("g1_keyword_scores", with_normal(f", s AS MATERIALIZED (SELECT CASE WHEN {_RULE} IS NULL THEN {_scores_sql()} END AS b FROM n4) SELECT b.c AS category, b.s AS score, count(*) AS n FROM s GROUP BY ALL"))
def g1_keyword_scores(spark, sf):
    n = normalize.normalize(txn(spark, sf))
    # no filter on the rule: it would be pushed down, and the texts' expressions with it
    ruled, fields = rules.with_cascade(n, rules.fields_of(F.col("search_text"), F.col("channel"), F.col("amount")), TAXONOMY)
    best = rules.best_score(ruled, fields, TAXONOMY, F.col("_rule").isNull()).select(F.col("_best").alias("b"))
    return best.groupBy(F.col("b.category"), F.col("b.score")).agg(F.count("*").alias("n"))


_TEMPORAL = "CASE " + " ".join("WHEN (" + " OR ".join(f"day(cast(date as date)) BETWEEN {a} AND {b}" for a, b in days) + ")" + (f" AND amount >= {least}" if least else "") + " AND (" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f") THEN '{tag}'" for days, least, words, _, _, tag in rules.TEMPORAL) + " END"


@query("c2_temporal_hints", with_txn(f"SELECT {_TEMPORAL} AS tag, count(*) AS n FROM txn GROUP BY ALL"))
def c2_temporal_hints(spark, sf):
    t = txn(spark, sf)
    hint = rules.temporal_hint(rules.fields_of(F.col("text"), F.lit(None).cast("string"), F.col("amount")), F.to_date("date"))
    return t.select(hint.alias("h")).groupBy(F.col("h.tag").alias("tag")).agg(F.count("*").alias("n"))


_LOWER = "lower(search_text)"
_KEYWORDS = [(k.lower(), c.id) for c in TAXONOMY for k in c.keywords]
_MERCHANT_RULE = "CASE " + " ".join(f"WHEN contains(lower(merchant), {q(k)}) THEN '{c}'" for k, c in _KEYWORDS) + " END"
_HINT = lambda what: "CASE " + " ".join("WHEN (" + " OR ".join(f"day(cast(date as date)) BETWEEN {a} AND {b}" for a, b in days) + ")" + (f" AND amount >= {least}" if least else "") + " AND (" + " OR ".join(f"contains({_LOWER}, '{w}')" for w in words) + f") THEN {what(category, boost)}" for days, least, words, category, boost, _ in rules.TEMPORAL) + " END"
_SUB_OF = "CASE soft " + " ".join(
    f"WHEN '{c.id}' THEN CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, {q(w)})" for w in name.lower().split()) + f" THEN {q(name)}" for name in c.subcategories) + f" ELSE {q(c.subcategories[0])} END" for c in TAXONOMY
) + " END"
RULES_SQL = f"""c1 AS MATERIALIZED (SELECT *, {_RULE} AS hard, {_MERCHANT_RULE} AS named, {_HINT(lambda c, b: q(c))} AS hint, {_HINT(lambda c, b: b)} AS boost FROM n4),
c2 AS MATERIALIZED (SELECT *, CASE WHEN hard IS NULL AND named IS NULL THEN {_scores_sql()} END AS best FROM c1),
c3 AS MATERIALIZED (SELECT *, coalesce(named, best.c) AS soft, lower(CASE WHEN named IS NOT NULL THEN merchant ELSE search_text END) AS low, CASE WHEN named IS NOT NULL THEN 0.95 ELSE least(1.0, best.s / 3.0) END AS base FROM c2),
c4 AS MATERIALIZED (SELECT c.*, coalesce(hard, CASE WHEN named IS NOT NULL THEN 'merchant' ELSE 'scores' END) AS rule, coalesce(v.category, soft) AS rule_category, CASE WHEN hard IS NOT NULL THEN {_SUB.replace('RULE_NAME', 'c.hard')} ELSE {_SUB_OF} END AS rule_sub,
round(CASE WHEN hard IS NOT NULL THEN v.confidence WHEN hint = soft THEN least(0.98, base + boost) ELSE base END, 6) AS rule_conf FROM c3 c LEFT JOIN (VALUES {_RULE_VALUES}) v(rule, category, sub, confidence) ON c.hard = v.rule)"""


@query("c5_rules", with_txn("SELECT template, rule, rule_category AS category, rule_sub AS subcategory, rule_conf AS confidence, count(*) AS n FROM c4 GROUP BY ALL", NORMAL_SQL, RULES_SQL))
def c5_rules(spark, sf):
    r = rules.categorize_by_rules(normalize.normalize(txn(spark, sf)), TAXONOMY)
    return r.groupBy("template", "rule_result.rule", "rule_result.category", "rule_result.subcategory", "rule_result.confidence").agg(F.count("*").alias("n"))


_CODE_VALUES = ", ".join(f"('{c}', '{k}', {str(h).lower()})" for c, k, h in merchant_codes.code_rows())
_TEXT_CODES = "coalesce(" + ", ".join(f"(SELECT c.code FROM codes c WHERE c.code = regexp_extract(text, {q(p)}, 1))" for p in merchant_codes.IN_TEXT) + ")"


_CODES_SQL = f"""codes AS (SELECT * FROM (VALUES {_CODE_VALUES}) AS v(code, category, high)), m AS (SELECT coalesce(mcc, {_TEXT_CODES}) AS code FROM txn)"""


@query("j7_merchant_codes", with_txn("""SELECT m.code AS mcc, CASE WHEN m.code IS NULL THEN NULL ELSE coalesce(c.category, 'Other') END AS category, CASE WHEN m.code IS NULL THEN NULL WHEN c.code IS NULL THEN 0.0 WHEN c.high THEN 0.95 ELSE 0.85 END AS confidence, count(*) AS n
FROM m LEFT JOIN codes c ON m.code = c.code GROUP BY ALL""", _CODES_SQL))
def j7_merchant_codes(spark, sf):
    t = txn(spark, sf).select(F.coalesce("mcc", merchant_codes.code_in_text(F.col("text"))).alias("mcc"))
    c = merchant_codes.classify_codes(t, merchant_codes.code_table(spark))
    return c.groupBy("mcc", F.col("mcc_category").alias("category"), F.col("mcc_conf").alias("confidence")).agg(F.count("*").alias("n"))


@query("g33_code_reconciliation", f"""WITH codes AS (SELECT * FROM (VALUES {_CODE_VALUES}) AS v(mcc, map_category, high)), seen AS (SELECT DISTINCT cast(p_size + 5800 as varchar) AS mcc, 'food_dining' AS taxonomy_category FROM part)
SELECT coalesce(c.mcc, s.mcc) AS mcc, map_category, taxonomy_category, map_category IS NOT DISTINCT FROM taxonomy_category AS agrees FROM codes c FULL OUTER JOIN seen s ON c.mcc = s.mcc""")
def g33_code_reconciliation(spark, sf):
    seen = read(spark, sf, "part").select((F.col("p_size") + 5800).cast("string").alias("mcc")).distinct().withColumn("category", F.lit("food_dining"))
    return merchant_codes.reconcile_codes(merchant_codes.code_table(spark), seen)


def _names_sql() -> str:
    """The names of the gazetteer: an alias stands in its first place and belongs to the last row that lists it."""
    found: dict[str, list] = {}
    for i, (brand, category, sub, listed) in enumerate(BRANDS):
        for j, a in enumerate([brand, *listed.split(",")]):
            name = a.strip().upper()
            found[name] = [i, brand, category, sub, name, found[name][5] if name in found else i * 1000 + j]
    return ", ".join(f"({i}, {q(b)}, {q(c)}, {q(u)}, {q(n)}, {p})" for i, b, c, u, n, p in found.values())


_CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce(name, '')), '\*PAYMENT|\*PAY|-PAYMENT|-PAY|INTL TRX ', '', 'g'), '[*\-/.]+', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMES = f"""a AS (SELECT * FROM (VALUES {_names_sql()}) AS v(row_pos, canonical, category, sub, alias, pos)), x AS (SELECT DISTINCT {_CLEANED} AS clean FROM (SELECT text AS name FROM txn)), xs AS (SELECT clean FROM x WHERE clean <> '')"""


@query("j2_exact_and_substring", with_txn(f"""SELECT clean, canonical AS merchant, score, match_type FROM (
SELECT x.clean, a.canonical, 1.0 AS score, 'exact' AS match_type FROM xs x JOIN a ON x.clean = a.alias
UNION ALL SELECT clean, arg_min(canonical, pos), 0.85, 'substring' FROM (SELECT x.clean, a.canonical, a.pos FROM xs x JOIN a ON len(list_filter(string_split(x.clean, ' '), lambda w: contains(w, a.alias))) > 0 WHERE length(a.alias) >= 4 AND NOT contains(a.alias, '*') AND x.clean NOT IN (SELECT alias FROM a)) GROUP BY clean)""", _NAMES))
def j2_exact_and_substring(spark, sf):
    texts = txn(spark, sf).select(resolve.clean_merchant(F.col("text")).alias("clean")).where("clean <> ''").distinct()
    found = resolve.exact_and_substring(texts, resolve.aliases(gazetteer(spark)))
    return found.select("clean", F.col("m_canonical_name").alias("merchant"), "score", "match_type")


_GRAMS = lambda c: f"CASE WHEN length(replace({c}, ' ', '')) < 3 THEN [replace({c}, ' ', '')] ELSE list_distinct([substr(replace({c}, ' ', ''), i, 3) for i in range(1, greatest(length(replace({c}, ' ', '')) - 2, 1) + 1)]) END"


@query("j4_trigram_matches", with_txn(f"""SELECT clean, row_pos, max(score) AS score FROM (SELECT x.clean, a.row_pos, round(len(list_intersect({_GRAMS('x.clean')}, {_GRAMS('a.alias')})) / (len({_GRAMS('x.clean')}) + len({_GRAMS('a.alias')}) - len(list_intersect({_GRAMS('x.clean')}, {_GRAMS('a.alias')}))), 6) AS score
FROM xs x, a) WHERE score >= 0.2 GROUP BY ALL""", _NAMES.replace('SELECT text AS name FROM txn', f"SELECT {_case('(p_partkey % 16)', [b[0] for b in BRANDS])} || ' ' || p_name AS name FROM part")))
def j4_trigram_matches(spark, sf):
    names = read(spark, sf, "part").selectExpr(f"{_case('(p_partkey % 16)', [b[0] for b in BRANDS])} || ' ' || p_name AS name")
    texts = names.select(resolve.clean_merchant(F.col("name")).alias("clean")).where("clean <> ''").distinct()
    found = resolve.trigram_matches(texts, resolve.listed_names(gazetteer(spark)), 0.2)
    return found.select("clean", "row_pos", F.round("score", 6).alias("score"))


@query("j5_resolve")
def j5_resolve(spark, sf):
    """All strategies together; the fuzzy one has no SQL, tests compare it with brute force."""
    found = resolve.resolve(normalize.normalize(txn(spark, sf)), gazetteer(spark), "merchant", 0.5, 3)
    return found.select("clean", "rank", F.col("m_canonical_name").alias("merchant"), F.round("score", 6).alias("score"), "match_type")


def _scored(spark, sf) -> DataFrame:
    """Votes of four scorers by formulas of the row, so that every case of the vote occurs."""
    t = txn(spark, sf)
    pick = lambda k: F.when(k == 0, None).when(k == 1, "fuel").when(k == 2, "shopping").otherwise("rent")
    k = F.col("txn_key")
    conf = lambda m: ((k * m) % 50 + 50) / 100.0
    return t.select("txn_key", "label", "amount", pick(k % 4).alias("mcc_category"), conf(3).alias("mcc_conf"), pick(F.floor(k / 4) % 4).alias("rule_category"), conf(7).alias("rule_conf"), pick(F.floor(k / 16) % 4).alias("ml_category"), conf(11).alias("ml_conf"), pick(F.floor(k / 64) % 4).alias("llm_category"), conf(13).alias("llm_conf"))


_PICK = lambda k: f"CASE {k} WHEN 0 THEN NULL WHEN 1 THEN 'fuel' WHEN 2 THEN 'shopping' ELSE 'rent' END"
_CONF = lambda m: f"((txn_key * {m}) % 50 + 50) / 100.0::double"
_SCORED = f"""v AS (SELECT txn_key, label, amount, {_PICK('txn_key % 4')} AS mcc, {_CONF(3)} AS mc, {_PICK('(txn_key // 4) % 4')} AS rule, {_CONF(7)} AS rc, {_PICK('(txn_key // 16) % 4')} AS ml, {_CONF(11)} AS lc, {_PICK('(txn_key // 64) % 4')} AS llm, {_CONF(13)} AS xc FROM txn)"""
_W = vote.SERVICE.weights()
_ONE = {"mcc": "mc", "rule": "rc", "ml": "lc", "llm": "xc"}
_SUM = lambda cat: "round(" + " + ".join(f"CASE WHEN {m} = '{cat}' THEN {c} * {_W[m]} ELSE 0 END" for m, c in _ONE.items()) + ", 9)"
_FIRST = lambda cat: "CASE " + " ".join(f"WHEN {m} = '{cat}' THEN {i}" for i, m in enumerate(_ONE)) + " ELSE 9 END"
_CATS = ("fuel", "shopping", "rent")
_VOTE = f"""{_SCORED}, b AS MATERIALIZED (SELECT *, list_max([{', '.join(f"{{'s': {_SUM(c)}, 'o': -({_FIRST(c)}), 'c': '{c}'}}" for c in _CATS)}]) AS top, (CASE WHEN rule <> ml AND llm IS NOT NULL THEN true ELSE false END) AS tie, {' + '.join(f'({m} IS NOT NULL)::int' for m in _ONE)} AS methods FROM v),
w AS MATERIALIZED (SELECT *, CASE WHEN methods = 0 THEN NULL WHEN tie THEN llm ELSE top.c END AS win FROM b),
a AS MATERIALIZED (SELECT *, {' + '.join(f'coalesce(({m} = win)::int, 0)' for m in _ONE)} AS agreement, {' + '.join(f'CASE WHEN {m} = win THEN {c} * {_W[m]} ELSE 0 END' for m, c in _ONE.items())} AS score, {' + '.join(f'CASE WHEN {m} = win THEN {_W[m]} ELSE 0 END' for m in _ONE)} AS weight FROM w),
r AS MATERIALIZED (SELECT *, CASE WHEN methods = 0 THEN 0.0 ELSE round(greatest(0.05, least(1.0, score / nullif(weight, 0) + CASE WHEN tie THEN 0.1 WHEN methods < 2 THEN 0 WHEN agreement = methods THEN 0.2 WHEN agreement >= 2 THEN 0.1 ELSE -0.15 END)), 6) END AS confidence FROM a)"""


@query("c10_vote", with_txn("SELECT txn_key, coalesce(win, 'Other') AS category, confidence, CASE WHEN methods = 0 THEN 'none' WHEN methods = agreement AND methods > 1 THEN 'ensemble_unanimous' WHEN methods > 1 THEN 'ensemble_' || concat_ws('+', CASE WHEN mcc IS NOT NULL THEN 'mcc' END, CASE WHEN rule IS NOT NULL THEN 'rule' END, CASE WHEN ml IS NOT NULL THEN 'ml' END, CASE WHEN llm IS NOT NULL THEN 'llm' END) ELSE CASE WHEN mcc IS NOT NULL THEN 'mcc' WHEN rule IS NOT NULL THEN 'rule' WHEN ml IS NOT NULL THEN 'ml' ELSE 'llm' END END AS method, agreement, methods, CASE WHEN methods = 0 THEN true ELSE confidence < CASE win WHEN 'rent' THEN 0.7 WHEN 'shopping' THEN 0.5 ELSE 0.6 END END AS requires_review FROM r", _VOTE))
def c10_vote(spark, sf):
    v = vote.vote(_scored(spark, sf), vote.SERVICE)
    return v.select("txn_key", "vote.category", "vote.confidence", "vote.method", "vote.agreement", "vote.methods", "vote.requires_review")


@query("c8_external_gate", with_txn("SELECT CASE WHEN rule IS NULL AND ml IS NULL THEN true WHEN rule IS NOT NULL AND ml IS NOT NULL THEN rule <> ml OR rc < 0.8 OR lc < 0.8 WHEN rule IS NULL THEN lc < 0.8 ELSE rc < 0.8 END AS wanted, count(*) AS n FROM v GROUP BY ALL", _SCORED))
def c8_external_gate(spark, sf):
    s = _scored(spark, sf)
    return s.groupBy(vote.wants_external(F.col("rule_category"), F.col("rule_conf"), F.col("ml_category"), F.col("ml_conf")).alias("wanted")).agg(F.count("*").alias("n"))


@query("c14_hybrid", with_txn("""SELECT txn_key, h.c AS category, h.f AS confidence, h.m AS method, h.f < 0.6 AS requires_review FROM (SELECT txn_key, CASE WHEN rule IS NOT NULL AND rc >= 0.85 THEN {'c': rule, 'f': round(rc, 6), 'm': 'rule'} WHEN ml IS NOT NULL AND lc >= 0.85 THEN {'c': ml, 'f': round(lc, 6), 'm': 'ml'} WHEN rule = ml THEN {'c': rule, 'f': round(least(1.0, (rc + lc) / 2 * 1.2), 6), 'm': 'hybrid'}
WHEN rule IS NOT NULL AND ml IS NOT NULL THEN CASE WHEN rc >= lc THEN {'c': rule, 'f': round(rc, 6), 'm': 'rule'} ELSE {'c': ml, 'f': round(lc, 6), 'm': 'ml'} END WHEN rule IS NOT NULL THEN {'c': rule, 'f': round(rc, 6), 'm': 'rule'} WHEN ml IS NOT NULL THEN {'c': ml, 'f': round(lc, 6), 'm': 'ml'} ELSE {'c': 'Other', 'f': 0.0, 'm': 'fallback'} END AS h FROM v)""", _SCORED))
def c14_hybrid(spark, sf):
    return route.hybrid(_scored(spark, sf)).select("txn_key", "hybrid.category", "hybrid.confidence", "hybrid.method", "hybrid.requires_review")


def _voted(spark, sf) -> DataFrame:
    v = vote.vote(_scored(spark, sf), vote.SERVICE)
    return v.select("txn_key", "label", "amount", "vote", F.col("vote.category").alias("category"), F.col("vote.category").alias("pred"), F.col("vote.confidence").alias("confidence"), F.col("vote.method").alias("method"), F.col("vote.requires_review").alias("requires_review"))


def _with_vote(select: str) -> str:
    return with_txn(select, _VOTE, f"""p AS (SELECT txn_key, label, amount, coalesce(win, 'Other') AS pred, confidence, agreement, methods, CASE WHEN methods = 0 THEN true ELSE confidence < CASE win WHEN 'rent' THEN 0.7 WHEN 'shopping' THEN 0.5 ELSE 0.6 END END AS review, methods = agreement AND methods > 1 AS unanimous FROM r)""")


# The merchant step in SQL: exact, substring and trigram matches. Sequence similarity has no SQL; it decides no row of these tables,
# and tests compare it with brute force.
_CLEAN_OF = lambda c: _CLEANED.replace("coalesce(name, '')", f"coalesce({c}, '')")
_CODE_OF_TEXT = "coalesce(" + ", ".join(f"(SELECT c.code FROM codes c WHERE c.code = regexp_extract(text, {q(p)}, 1))" for p in merchant_codes.IN_TEXT) + ")"
_REVIEW = "CASE win " + " ".join(f"WHEN '{c}' THEN {r}" for c, (_, r) in vote.THRESHOLDS.items()) + " ELSE 0.6 END"
ROUTE_SQL = f"""codes AS (SELECT * FROM (VALUES {_CODE_VALUES}) AS v(code, category, high)), a AS (SELECT * FROM (VALUES {_names_sql()}) AS v(row_pos, canonical, category, sub, alias, pos)),
d1 AS MATERIALIZED (SELECT *, rule_conf >= 0.95 AS ruled, {_CLEAN_OF('text')} AS k1, {_CLEAN_OF('merchant')} AS k2 FROM c4),
x AS MATERIALIZED (SELECT DISTINCT clean FROM (SELECT k1 AS clean FROM d1 WHERE NOT ruled UNION ALL SELECT k2 FROM d1 WHERE NOT ruled) WHERE clean <> ''),
x1 AS (SELECT x.clean, a.row_pos, 1.0 AS score FROM x JOIN a ON x.clean = a.alias),
x2 AS (SELECT x.clean, arg_min(a.row_pos, a.pos) AS row_pos, 0.85 AS score FROM x JOIN a ON length(a.alias) >= 4 AND NOT contains(a.alias, '*') AND NOT contains(a.alias, ' ') AND contains(x.clean, a.alias) WHERE x.clean NOT IN (SELECT clean FROM x1) GROUP BY 1),
g AS MATERIALIZED (SELECT clean, {_GRAMS('clean')} AS g FROM x WHERE clean NOT IN (SELECT clean FROM x1) AND clean NOT IN (SELECT clean FROM x2)), ag AS MATERIALIZED (SELECT row_pos, {_GRAMS('alias')} AS h FROM a),
x3 AS (SELECT clean, row_pos, max(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))) AS score FROM g JOIN ag ON len(h) >= 0.7 * len(g) AND len(g) >= 0.7 * len(h) GROUP BY ALL),
m AS MATERIALIZED (SELECT clean, max(score) AS score, arg_max(row_pos, {{'s': score, 'o': -row_pos}}) AS row_pos FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3 WHERE score >= 0.7) GROUP BY clean),
r AS (SELECT DISTINCT row_pos, canonical, category, sub FROM a),
d2 AS MATERIALIZED (SELECT d1.*, coalesce(m1.score, m2.score) AS m_score, coalesce(m1.row_pos, m2.row_pos) AS m_row, coalesce(mcc, {_CODE_OF_TEXT}) AS code FROM d1 LEFT JOIN m m1 ON NOT ruled AND k1 = m1.clean LEFT JOIN m m2 ON NOT ruled AND k2 = m2.clean AND m2.score >= 0.8),
d3 AS MATERIALIZED (SELECT d2.*, r.category AS m_category, r.sub AS m_sub, CASE WHEN d2.code IS NOT NULL THEN coalesce(c.category, 'other') END AS mcc_category, CASE WHEN d2.code IS NULL THEN NULL WHEN c.code IS NULL THEN 0.0 WHEN c.high THEN 0.95 ELSE 0.85 END AS mcc_conf FROM d2 LEFT JOIN r ON m_row = r.row_pos LEFT JOIN codes c ON d2.code = c.code),
d4 AS MATERIALIZED (SELECT *, CASE WHEN ruled THEN 'rule_deterministic' WHEN m_score >= 0.7 AND NOT (contains(lower(text), 'refund') OR contains(lower(text), 'return') OR contains(lower(text), 'reversal') OR contains(lower(text), 'chargeback')) THEN 'merchant_gazetteer' WHEN mcc_conf >= 0.9 THEN 'mcc_deterministic' END AS way,
CASE WHEN mcc_category IS NULL THEN rule_category WHEN mcc_category = rule_category THEN mcc_category WHEN round(mcc_conf * 0.2, 9) >= round(rule_conf * 0.2, 9) THEN mcc_category ELSE rule_category END AS win FROM d3),
d5 AS MATERIALIZED (SELECT *, CASE WHEN mcc_category IS NULL THEN rule_conf WHEN mcc_category = rule_category THEN (mcc_conf * 0.2 + rule_conf * 0.2) / 0.4 + 0.2 ELSE CASE WHEN win = mcc_category THEN mcc_conf ELSE rule_conf END - 0.15 END AS raw FROM d4),
d6 AS MATERIALIZED (SELECT *, round(greatest(0.05, least(1.0, raw)), 6) AS vconf FROM d5),
d7 AS MATERIALIZED (SELECT *, CASE way WHEN 'rule_deterministic' THEN rule_category WHEN 'merchant_gazetteer' THEN m_category WHEN 'mcc_deterministic' THEN mcc_category ELSE win END AS category,
CASE way WHEN 'rule_deterministic' THEN rule_conf WHEN 'merchant_gazetteer' THEN round(least(0.95, m_score + 0.1), 6) WHEN 'mcc_deterministic' THEN mcc_conf ELSE vconf END AS confidence,
coalesce(way, CASE WHEN mcc_category IS NULL THEN 'rule' WHEN mcc_category = rule_category THEN 'ensemble_unanimous' ELSE 'ensemble_mcc+rule' END) AS method, way IS NULL AND vconf < {_REVIEW} AS review FROM d6)"""


def _routed(spark, sf) -> DataFrame:
    return route.categorize(txn(spark, sf), TAXONOMY, gazetteer(spark), merchant_codes.code_table(spark))


@query("c12_route", with_txn("SELECT template, method, category, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, count_if(review) AS reviews FROM d7 GROUP BY ALL", NORMAL_SQL, RULES_SQL, ROUTE_SQL))
def c12_route(spark, sf):
    """The whole route over all transactions, all strategies of the merchant step included."""
    return _routed(spark, sf).groupBy("template", "method", "category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if("requires_review").alias("reviews"))


@query("z1_indexed_route", with_txn("SELECT template, method, category, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, count_if(review) AS reviews FROM d7 GROUP BY ALL", NORMAL_SQL, RULES_SQL, ROUTE_SQL))
def z1_indexed_route(spark, sf):
    """The route in one plan, as a stream runs it: merchants from a compiled index, nothing written on the way."""
    routed = route.categorize(txn(spark, sf), TAXONOMY, merchant_index.compile_index(gazetteer(spark)), merchant_codes.code_table(spark))
    return routed.groupBy("template", "method", "category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if("requires_review").alias("reviews"))


@query("n30_answers", with_txn("SELECT method, count(*) AS n, count_if(review) AS reviews, sum(CASE WHEN way IS NULL AND mcc_category <> rule_category THEN 1 ELSE 0 END) AS alternatives, count(DISTINCT category) AS categories FROM d7 GROUP BY method", NORMAL_SQL, RULES_SQL, ROUTE_SQL))
def n30_answers(spark, sf):
    """Routed rows as answers: every alternative carries the winner's method."""
    out = route.assembled(_routed(spark, sf))
    kept = F.filter("alternatives", lambda a: a["method"] == F.col("method"))
    return out.groupBy("method").agg(F.count("*").alias("n"), F.count_if("requires_review").alias("reviews"), F.sum(F.when(F.col("alternatives").isNull(), 0).otherwise(F.size(kept))).alias("alternatives"), F.countDistinct("category").alias("categories"))


@query("d11_merchant_rollup", with_txn("SELECT canonical AS merchant, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM d7 JOIN r ON m_row = r.row_pos WHERE way = 'merchant_gazetteer' GROUP BY ALL", NORMAL_SQL, RULES_SQL, ROUTE_SQL))
def d11_merchant_rollup(spark, sf):
    routed = _routed(spark, sf).select("merchant_resolved", "confidence", F.when(F.col("method") == "merchant_gazetteer", F.col("merchant_resolved")).alias("by"))
    return evaluate.merchant_rollup(routed, "by")


@query("g6_batch_stats", _with_vote("SELECT count(*) AS total, round(avg(confidence), 3) AS avg_confidence, count_if(review) AS review_count, round(100.0 * count_if(review) / count(*), 1) AS review_percent, count_if(unanimous) AS unanimous_count, round(100.0 * count_if(unanimous) / count(*), 1) AS unanimous_percent FROM p"))
def g6_batch_stats(spark, sf):
    return evaluate.batch_stats(_voted(spark, sf))


@query("g20_agreement", _with_vote("SELECT count_if(agreement >= 3) AS three, count_if(agreement = 2) AS two, count_if(agreement <= 1) AS one, count_if(confidence > 0.8) AS high, count_if(confidence > 0.5 AND confidence <= 0.8) AS medium, count_if(confidence <= 0.5) AS low, count_if(review) AS reviews FROM p"))
def g20_agreement(spark, sf):
    return evaluate.agreement_distribution(_voted(spark, sf))


# --- evaluation --------------------------------------------------------------------------------------
_REPORT = """k AS (SELECT label AS c FROM p UNION SELECT pred FROM p), g AS (SELECT c AS class, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE pred = c) AS predicted, (SELECT count(*) FROM p WHERE label = c AND pred = c) AS tp FROM k),
g2 AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS pr, coalesce(tp / nullif(support, 0), 0.0) AS re FROM g), rep AS (SELECT class, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1, support - tp AS incorrect FROM g2)"""


@query("g8_class_report", _with_vote(f", {_REPORT} SELECT * FROM rep"))
def g8_class_report(spark, sf):
    return evaluate.class_report(_voted(spark, sf))


@query("g9_summary", _with_vote(f", {_REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(1 - sum(incorrect) / sum(support), 6) AS accuracy, count_if(f1 = 1) AS perfect, round(avg(f1), 6) >= 0.9 AS passes FROM rep WHERE support > 0"))
def g9_summary(spark, sf):
    return evaluate.summary(evaluate.class_report(_voted(spark, sf)))


@query("g10_confusion", _with_vote("SELECT label AS \"true\", count_if(pred = 'Other') AS \"Other\", count_if(pred = 'fuel') AS fuel, count_if(pred = 'rent') AS rent, count_if(pred = 'shopping') AS shopping FROM p GROUP BY label"))
def g10_confusion(spark, sf):
    return evaluate.confusion_matrix(_voted(spark, sf), ["fuel", "rent", "shopping", "Other"])


@query("g11_confidence_bands", _with_vote("SELECT count(*) AS total, count_if(label = pred) AS correct, count_if(label = pred AND confidence > 0.8) AS correct_high, count_if(label = pred AND confidence > 0.5 AND confidence <= 0.8) AS correct_medium, count_if(label = pred AND confidence <= 0.5) AS correct_low, round(avg(confidence), 6) AS avg_confidence FROM p"))
def g11_confidence_bands(spark, sf):
    return evaluate.confidence_bands(_voted(spark, sf))


_RANGE = "CASE WHEN amount <= 100 THEN 'small' WHEN amount <= 1000 THEN 'medium' ELSE 'large' END"


@query("g12_accuracy_by_amount", _with_vote(f", s AS (SELECT {_RANGE} AS range, count(*) AS n, round(avg((label = pred)::int), 6) AS accuracy FROM p GROUP BY ALL) SELECT v.range AS range, coalesce(n, 0) AS n, accuracy FROM (VALUES ('small'), ('medium'), ('large')) v(range) LEFT JOIN s ON s.range = v.range"))
def g12_accuracy_by_amount(spark, sf):
    return evaluate.accuracy_by_amount(_voted(spark, sf))


@query("g13_disparity", _with_vote(f", s AS (SELECT {_RANGE} AS range, round(avg((label = pred)::int), 6) AS accuracy FROM p GROUP BY ALL) SELECT round(max(accuracy) - min(accuracy), 6) AS disparity, round(max(accuracy) - min(accuracy), 6) > 0.1 AS flagged FROM s"))
def g13_disparity(spark, sf):
    return evaluate.disparity(evaluate.accuracy_by_amount(_voted(spark, sf)))


@query("g14_accuracy_by_class", _with_vote('SELECT label AS class, count(*) AS n, round(avg((label = pred)::int), 6) AS accuracy FROM p GROUP BY ALL'))
def g14_accuracy_by_class(spark, sf):
    return evaluate.accuracy_by_class(_voted(spark, sf))


@query("t3_best_and_worst", _with_vote(f", {_REPORT} (SELECT class, f1, 'best' AS \"end\" FROM rep WHERE support > 0 ORDER BY f1 DESC, class LIMIT 5) UNION ALL (SELECT class, f1, 'worst' FROM rep WHERE support > 0 ORDER BY f1, class LIMIT 5)"))
def t3_best_and_worst(spark, sf):
    return evaluate.best_and_worst(evaluate.class_report(_voted(spark, sf)))


@query("d10_two_models", with_txn(", k AS (SELECT txn_key, coalesce(min(label) = min(rule), false) AS x, coalesce(min(label) = min(ml), false) AS y FROM v GROUP BY txn_key), o AS (SELECT count_if(x AND y) AS \"both\", count_if(x AND NOT y) AS only_a, count_if(NOT x AND y) AS only_b, count_if(NOT x AND NOT y) AS neither FROM k) SELECT *, coalesce(round((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / nullif(only_a + only_b, 0), 6), 0.0) AS statistic FROM o", _SCORED))
def d10_two_models(spark, sf):
    one = _scored(spark, sf).groupBy("txn_key").agg(F.min("label").alias("label"), F.min("rule_category").alias("rule"), F.min("ml_category").alias("ml"))
    model = lambda c: one.select("txn_key", "label", F.coalesce(c, F.lit("none")).alias("pred"))
    return evaluate.mcnemar(model("rule"), model("ml"), "txn_key")


_FIVE = "CASE WHEN amount <= 100 THEN '0-100' WHEN amount <= 500 THEN '100-500' WHEN amount <= 2000 THEN '500-2000' WHEN amount <= 10000 THEN '2000-10000' ELSE '10000+' END"


@query("d8_fairness", _with_vote(f"SELECT {_FIVE} AS range, count(*) AS n, round(avg((label = pred)::int), 6) AS accuracy, round(avg(confidence), 6) AS confidence, round(avg(review::int), 6) AS review_rate FROM p GROUP BY ALL"))
def d8_fairness(spark, sf):
    return evaluate.fairness(_voted(spark, sf))


@query("d8_chi_square", _with_vote(f", c AS (SELECT {_FIVE} AS range, count(*) AS n, count_if(label = pred) AS r FROM p GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(r) AS r, count(*) AS k FROM c) SELECT round(sum((c.r - c.n * t.r / t.n) * (c.r - c.n * t.r / t.n) / (c.n * t.r / t.n) + (c.r - c.n * t.r / t.n) * (c.r - c.n * t.r / t.n) / (c.n * (1 - t.r / t.n))), 6) AS statistic, max(t.k) - 1 AS freedom FROM c, t"))
def d8_chi_square(spark, sf):
    return evaluate.chi_square(_voted(spark, sf))


@query("g7_service_stats", _with_vote("SELECT count(*) AS total, round(avg(confidence), 6) AS accuracy, round(count_if(review) / count(*), 6) AS review_rate FROM p"))
def g7_service_stats(spark, sf):
    return evaluate.service_stats(_voted(spark, sf))


@query("g21_run_report", _with_vote("SELECT count(*) AS total, count_if(label = pred) AS correct, round(avg((label = pred)::int), 6) AS accuracy, round(avg(confidence), 6) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, round(avg(amount), 6) AS avg_latency, min(amount) AS min_latency, max(amount) AS max_latency FROM p"))
def g21_run_report(spark, sf):
    return evaluate.run_report(_voted(spark, sf).withColumn("latency_ms", F.col("amount")))


@query("g15_minorities", _with_vote(", c AS (SELECT label, count(*) AS n, round(avg((label = pred)::int), 6) AS acc FROM p GROUP BY label), o AS (SELECT round(sum(n * acc) / sum(n), 6) AS overall, round(avg(acc) FILTER (n < 9000), 6) AS minority, count_if(n < 9000) AS classes FROM c) SELECT *, coalesce(minority < overall - 0.15, false) AS flagged FROM o"))
def g15_minorities(spark, sf):
    return evaluate.minority_report(_voted(spark, sf), rows=9000)


@query("g16_distribution", with_txn("SELECT label AS value, count(*) AS n FROM txn GROUP BY label"))
def g16_distribution(spark, sf):
    return evaluate.distribution(txn(spark, sf), "label")


@query("g22_batch_counts", with_txn("SELECT count(*) AS total, count_if(NOT (rule IS NULL AND ml IS NULL)) AS successful, count_if(rule IS NULL AND ml IS NULL) AS failed FROM v", _SCORED))
def g22_batch_counts(spark, sf):
    failed = F.when(F.col("rule_category").isNull() & F.col("ml_category").isNull(), "no scorer answered")
    rows = _scored(spark, sf).select("txn_key", F.lit("").alias("text"), F.col("rule_category").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.col("rule_conf").alias("confidence"), F.lit("rule").alias("method"), failed.alias("error"))
    return route.batch_counts(route.batch_answers(rows))


@query("n31_error_rows", with_txn("SELECT status, category, method, confidence = 0 AS none, error_message, count(*) AS n FROM (SELECT CASE WHEN rule IS NULL THEN 'error' ELSE 'success' END AS status, coalesce(rule, 'Unknown') AS category, CASE WHEN rule IS NULL THEN 'error' ELSE 'rule' END AS method, CASE WHEN rule IS NULL THEN 0.0 ELSE rc END AS confidence, CASE WHEN rule IS NULL THEN 'no rule' END AS error_message FROM v) GROUP BY ALL", _SCORED))
def n31_error_rows(spark, sf):
    rows = _scored(spark, sf).select("txn_key", F.lit("").alias("text"), F.col("rule_category").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.col("rule_conf").alias("confidence"), F.lit("rule").alias("method"), F.when(F.col("rule_category").isNull(), "no rule").alias("error"))
    return route.batch_answers(rows).groupBy("status", "category", "method", (F.col("confidence") == 0).alias("none"), "error_message").agg(F.count("*").alias("n"))


# --- data sets ---------------------------------------------------------------------------------------
_PLACE = lambda seed=0: f"((((txn_key % {dataset.HASH_MOD}) + {dataset.HASH_MOD}) % {dataset.HASH_MOD} + {seed}) * {dataset.HASH_FACTOR}) % {dataset.HASH_MOD}"


def _keyed(spark, sf) -> DataFrame:
    return txn(spark, sf).groupBy("txn_key").agg(F.min("text").alias("text"), F.min("label").alias("label"), F.min("amount").alias("amount"), F.min("date").alias("date"))


_KEYED = "k AS (SELECT txn_key, min(text) AS text, min(label) AS label, min(amount) AS amount, min(date) AS date FROM txn GROUP BY txn_key)"
_with_keyed = lambda s, *ctes: with_txn(s, _KEYED, *ctes)


@query("w7_balance", _with_keyed(f", n AS (SELECT label, count(*) AS have FROM k GROUP BY label), o AS (SELECT k.*, have, row_number() OVER (PARTITION BY k.label ORDER BY {_PLACE()}, txn_key) AS i FROM k JOIN n ON k.label = n.label), r AS (SELECT *, greatest((200 - i) // have, 0) AS extra FROM o WHERE i <= 200) SELECT label, txn_key, unnest(range(0, extra + 1)) AS copy FROM r"))
def w7_balance(spark, sf):
    return dataset.balance(_keyed(spark, sf), 200).select("label", "txn_key", F.col("copy").cast("long").alias("copy"))


@query("w8_oversample_targets", with_txn("SELECT label, count(*) AS n, greatest(100, cast(floor(max(count(*)) OVER () * 0.8) as bigint)) AS target FROM txn GROUP BY label"))
def w8_oversample_targets(spark, sf):
    return dataset.oversample_target(txn(spark, sf))


@query("w11_split", _with_keyed(f"SELECT txn_key, CASE WHEN {_PLACE()} < {0.8 * dataset.HASH_MOD} THEN 'train' ELSE 'validation' END AS part FROM k"))
def w11_split(spark, sf):
    return dataset.split(_keyed(spark, sf)).select("txn_key", "part")


@query("d7_stratified_split", _with_keyed(f", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_PLACE()}, txn_key) AS i, count(*) OVER (PARTITION BY label) AS c FROM k) SELECT label, CASE WHEN i <= floor(c * 0.8) THEN 'train' ELSE 'validation' END AS part, count(*) AS n, sum(txn_key) AS keys FROM o GROUP BY ALL"))
def d7_stratified_split(spark, sf):
    return dataset.split(_keyed(spark, sf), by="label").groupBy("label", "part").agg(F.count("*").alias("n"), F.sum("txn_key").alias("keys"))


@query("w6_few_shot", _with_keyed(", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY txn_key) AS i FROM k) SELECT txn_key, label, text FROM o WHERE i <= 2 ORDER BY txn_key LIMIT 20"))
def w6_few_shot(spark, sf):
    return dataset.few_shot(_keyed(spark, sf), order="txn_key").select("txn_key", "label", "text")


@query("j24_class_weights", with_txn("SELECT label, n, CASE WHEN mx > 2 * mn THEN round(s / (k * n), 6) ELSE 1.0 END AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS s, count(*) OVER () AS k, max(count(*)) OVER () AS mx, min(count(*)) OVER () AS mn FROM txn GROUP BY label)"))
def j24_class_weights(spark, sf):
    return dataset.class_weights(txn(spark, sf))


_MAP_ROWS = [("atm_cash", "cash"), ("rent", "rent"), ("fuel", "transport"), ("income_salary", "income")]


@query("j13_map_labels", with_txn("SELECT coalesce(m.new, label) AS new_label, CASE WHEN m.new IS NULL THEN 'unmapped' WHEN m.new = label THEN 'unchanged' ELSE 'updated' END AS label_status, count(*) AS n FROM txn LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP_ROWS) + ") m(old, new) ON lower(label) = m.old GROUP BY ALL"))
def j13_map_labels(spark, sf):
    m = spark.createDataFrame(_MAP_ROWS, "old string, new string")
    return dataset.mapped_labels(txn(spark, sf).withColumn("category", F.lit(None).cast("string")), m).groupBy("new_label", "label_status").agg(F.count("*").alias("n"))


@query("j15_merge_corrections", _with_keyed(""", b AS (SELECT lower(trim(text)) AS key, text, label, txn_key AS pos, amount, date, 'sub' || cast(txn_key % 5 as varchar) AS subcategory, txn_key FROM k), c AS (SELECT CASE WHEN template = 1 THEN text || ' X' ELSE text END AS text, 'fixed' || cast(txn_key % 3 as varchar) AS label, txn_key AS pos, amount, date, CASE WHEN txn_key % 2 = 0 THEN 'new' || cast(txn_key % 7 as varchar) ELSE '' END AS subcategory FROM (SELECT txn_key, min(text) AS text, min(amount) AS amount, min(date) AS date, min(template) AS template FROM txn WHERE flag = 'R' GROUP BY txn_key)),
c2 AS (SELECT lower(trim(text)) AS key, arg_max(label, pos) AS label, arg_min(text, pos) AS first_text, arg_min(amount, pos) AS first_amount, arg_min(date, pos) AS first_date, nullif(arg_max(subcategory, pos), '') AS sub FROM c GROUP BY 1), f AS (SELECT key, min(pos) AS pos FROM b GROUP BY key)
SELECT b.text, coalesce(c2.label, b.label) AS label, b.amount, b.date, coalesce(c2.sub, b.subcategory) AS subcategory, b.txn_key, c2.label IS NOT NULL AS corrected FROM b LEFT JOIN f ON b.key = f.key AND b.pos = f.pos LEFT JOIN c2 ON f.key = c2.key UNION ALL SELECT first_text, label, first_amount, first_date, sub, NULL, true FROM c2 WHERE key NOT IN (SELECT key FROM f)"""))
def j15_merge_corrections(spark, sf):
    k = _keyed(spark, sf).withColumn("pos", F.col("txn_key")).withColumn("subcategory", F.concat(F.lit("sub"), (F.col("txn_key") % 5).cast("string")))
    r = txn(spark, sf).where("flag = 'R'").groupBy("txn_key").agg(*[F.min(c).alias(c) for c in ("text", "amount", "date", "template")])
    sub = F.when(F.col("txn_key") % 2 == 0, F.concat(F.lit("new"), (F.col("txn_key") % 7).cast("string"))).otherwise("")
    c = r.select(F.when(F.col("template") == 1, F.concat("text", F.lit(" X"))).otherwise(F.col("text")).alias("text"), F.concat(F.lit("fixed"), (F.col("txn_key") % 3).cast("string")).alias("label"), F.col("txn_key").alias("pos"), "amount", "date", sub.alias("subcategory"))
    return dataset.merge_corrections(k.select("text", "label", "pos", "amount", "date", "subcategory", "txn_key"), c)


@query("d1_contradictions", with_txn("SELECT key, sum(n) AS rows, count(*) AS labels, round(max(n) / sum(n), 6) AS top_share FROM (SELECT p_name AS key, p_type AS l, count(*) AS n FROM part GROUP BY ALL) GROUP BY key HAVING count(*) > 1 AND max(n) < 0.7 * sum(n)").replace("SELECT key", "SELECT key", 1))
def d1_contradictions(spark, sf):
    return dataset.contradictions(read(spark, sf, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("label")))


@query("d14_duplicates", with_txn("SELECT txn_key, count(*) OVER (PARTITION BY account, amount, date) > 1 AS is_duplicate FROM txn"))
def d14_duplicates(spark, sf):
    return dataset.duplicate_flags(txn(spark, sf), ["account", "amount", "date"]).select("txn_key", "is_duplicate")


@query("d6_validate", with_txn("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN length(text) > 500 THEN 'long_text' WHEN amount > 10000000 THEN 'huge_amount' WHEN label IS NULL THEN 'no_label' ELSE 'fine' END AS problem FROM txn) GROUP BY ALL"))
def d6_validate(spark, sf):
    return dataset.validate(txn(spark, sf)).select(F.explode(F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.array(F.lit("fine")))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("j19_natural_variants", with_txn("""SELECT label, variant, count(*) AS n FROM (SELECT label, text, unnest(list_distinct(CASE WHEN label = 'atm_cash' THEN ['took ' || label, 'took ' || i, 'got ' || label, 'got ' || i] ELSE [label, i] END)) AS variant FROM (SELECT *, upper(substr(label, 1, 1)) || lower(substr(label, 2)) AS i FROM txn)) WHERE lower(variant) <> lower(text) GROUP BY ALL"""))
def j19_natural_variants(spark, sf):
    t = spark.createDataFrame([("atm_cash", 0, "took {merchant}"), ("atm_cash", 1, "got {merchant}")], "category string, pos int, template string")
    return dataset.natural_variants(txn(spark, sf), t, merchant="label").groupBy("label", "variant").agg(F.count("*").alias("n"))


@query("a16_variants", with_txn("SELECT variant, count(*) AS n FROM (SELECT unnest(list_distinct([upper(p_name), lower(p_name), replace(p_name, '-', ' '), replace(p_name, '/', ' '), replace(p_name, ' ', '')])) AS variant FROM part) GROUP BY ALL"))
def a16_variants(spark, sf):
    from ledgermint.functions.text import variants

    return read(spark, sf, "part").select(F.explode(variants(F.col("p_name"))).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


# --- learning, review, exports -------------------------------------------------------------------------
_WORDS_OUT = r"regexp_replace(upper(text), '\b(UPI|IMPS|NEFT|RTGS|POS|CARD|ATM|PAYMENT|PURCHASE|BILL|INR|RS|DEBIT|CREDIT|TXN|TRANSACTION|TO|FROM|AT|ON|IN|VIA|BY)\b', '', 'g')"
_RUNS = rf"list_transform(string_split(array_to_string(list_transform(list_filter(string_split_regex({_WORDS_OUT}, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) >= 3 AND regexp_matches(w, '^[A-Z]') THEN w ELSE chr(10) END), ' '), chr(10)), lambda r: trim(r))"


@query("g18_learned_merchants", with_txn(f""", n AS (SELECT *, (SELECT arg_min(r, {{'l': -length(r), 'o': o}}) FROM (SELECT unnest({_RUNS}) AS r, unnest(range(len({_RUNS}))) AS o)) AS name FROM txn), g AS (SELECT name, label, count(*) AS n, min(txn_key) AS first FROM n WHERE name <> '' GROUP BY ALL),
b AS (SELECT name, sum(n) AS n, arg_max(label, {{'n': n, 'f': -first}}) AS label FROM g GROUP BY name HAVING sum(n) >= 20) SELECT row_number() OVER (ORDER BY name) AS merchant_id, name AS canonical_name, label AS category, '' AS subcategory, array_to_string(list_distinct([lower(name)]), ',') AS first_alias, cast(n as bigint) AS n FROM b"""))
def g18_learned_merchants(spark, sf):
    t = txn(spark, sf).withColumn("pos", F.col("txn_key")).withColumn("subcategory", F.lit(""))
    return learn.learned_merchants(t, 20).withColumn("first_alias", F.split("aliases", ",")[0]).drop("aliases")


@query("g17_correction_summary", with_txn("SELECT label, count(*) AS n, count_if(flag = 'R') AS incorrect FROM txn GROUP BY label ORDER BY n DESC, label LIMIT 10"))
def g17_correction_summary(spark, sf):
    return learn.correction_summary(txn(spark, sf).withColumn("was_incorrect", F.col("flag") == "R"))


@query("t2_review_queue", with_txn(""", q AS (SELECT DISTINCT txn_key, confidence, methods = agreement AND methods > 1 AS unanimous, methods, rule, ml, llm, CASE WHEN methods = 0 THEN true ELSE confidence < CASE win WHEN 'rent' THEN 0.7 WHEN 'shopping' THEN 0.5 ELSE 0.6 END END AS review FROM r), f AS (SELECT * FROM q WHERE review ORDER BY confidence, txn_key LIMIT 50),
u AS (SELECT txn_key, confidence, round(least(1.0, (1 - confidence) + (1 - CASE WHEN unanimous THEN 1.0 ELSE 0.0 END) * 0.3 + CASE WHEN methods = 0 OR unanimous THEN 0.0 WHEN llm IS NOT NULL THEN 0.1 WHEN rule IS NOT NULL AND ml IS NULL THEN 0.05 ELSE 0.0 END), 6) AS uncertainty FROM f) SELECT * FROM u WHERE uncertainty >= 0.3""", _VOTE))
def t2_review_queue(spark, sf):
    v = materialise(_voted(spark, sf).select("txn_key", "confidence", "method", "requires_review").distinct())  # else the filter on the vote is pushed into it
    return learn.review_queue(v).select("txn_key", "confidence", "uncertainty")


@query("e9_votes_long", with_txn("SELECT method, category, count(*) AS n, round(sum(percent), 2) AS percent FROM (SELECT 'mcc' AS method, coalesce(mcc, 'N/A') AS category, round(mc * 100, 2) AS percent FROM v UNION ALL SELECT 'rule', coalesce(rule, 'N/A'), round(rc * 100, 2) FROM v UNION ALL SELECT 'ml', coalesce(ml, 'N/A'), round(lc * 100, 2) FROM v UNION ALL SELECT 'llm', coalesce(llm, 'N/A'), round(xc * 100, 2) FROM v) GROUP BY ALL", _SCORED))
def e9_votes_long(spark, sf):
    return learn.votes_long(_scored(spark, sf)).groupBy("method", "category").agg(F.count("*").alias("n"), F.round(F.sum("percent"), 2).alias("percent"))


@query("d4_mask_personal", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b', '[CARD]', 'g'), '\b\d{4} ?\d{4} ?\d{4}\b', '[ID]', 'g'), '\b[A-Z]{5}\d{4}[A-Z]\b', '[TAXID]', 'g'), '\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}\b', '[PHONE]', 'g')) AS masked FROM documents")
def d4_mask_personal(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(learn.mask_personal(F.col("text"))).alias("masked"))


#: Expected values, written out: the accounts and codes of the fixture's categories.
_LEDGER_SQL = """CASE label WHEN 'food_dining' THEN 'Meals & Entertainment' WHEN 'groceries' THEN 'Groceries' WHEN 'transport' THEN 'Auto & Travel' WHEN 'fuel' THEN 'Auto & Travel' WHEN 'shopping' THEN 'Merchandise' WHEN 'bills' THEN 'Utilities' WHEN 'rent' THEN 'Rent'
WHEN 'health' THEN 'Medical' WHEN 'education' THEN 'Education' WHEN 'entertainment' THEN 'Meals & Entertainment' WHEN 'travel' THEN 'Auto & Travel' WHEN 'fees_charges' THEN 'Bank Charges' ELSE 'Other Expenses' END"""
_CODED_SQL = """CASE label WHEN 'food_dining' THEN '200' WHEN 'groceries' THEN '201' WHEN 'transport' THEN '202' WHEN 'fuel' THEN '202' WHEN 'shopping' THEN '203' WHEN 'bills' THEN '204' WHEN 'rent' THEN '205' WHEN 'health' THEN '206' WHEN 'education' THEN '207' WHEN 'entertainment' THEN '208' WHEN 'travel' THEN '202' WHEN 'fees_charges' THEN '209' ELSE '299' END"""


@query("k7_interchange", with_txn(f"""SELECT txn_key, 0 AS nth, 'TRNS' || chr(9) || date || chr(9) || {_LEDGER_SQL} || chr(9) || '-' || printf('%.2f', amount) || chr(9) || text AS line FROM txn UNION ALL SELECT txn_key, 1, 'SPL' || chr(9) || date || chr(9) || 'Bank Account' || chr(9) || printf('%.2f', amount) || chr(9) || text FROM txn UNION ALL SELECT txn_key, 2, 'ENDTRNS' FROM txn"""))
def k7_interchange(spark, sf):
    return export.interchange_lines(txn(spark, sf).withColumn("category", F.col("label")))


@query("k8_coded_csv", with_txn(f"""SELECT '' AS "*ContactName", 'TXN-' || cast(txn_key as varchar) AS "*InvoiceNumber", date AS "*InvoiceDate", date AS "*DueDate", '' AS "InventoryItemCode", text AS "Description", '1' AS "Quantity", printf('%.2f', amount) AS "UnitAmount", {_CODED_SQL} AS "AccountCode", 'GST' AS "*TaxType", true AS taxed, printf('%.2f', amount) AS "LineAmount" FROM txn"""))
def k8_coded_csv(spark, sf):
    """All columns; of the tax, whether it is the share of the amount to the cent, since engines round half cents differently."""
    rows = export.coded_csv(txn(spark, sf).withColumn("category", F.col("label")))
    return rows.withColumn("taxed", F.abs(F.col("TaxAmount").cast("double") - F.col("LineAmount").cast("double") * 0.18) < 0.0051).drop("TaxAmount")


@query("k6_ledger_csv", with_txn("SELECT category, subcategory, merchant, currency, requires_review, count(*) AS n, round(sum(amount), 2) AS amount, round(sum(confidence), 4) AS confidence FROM (SELECT label AS category, '' AS subcategory, '' AS merchant, currency, flag = 'R' AS requires_review, amount, 0.5 AS confidence FROM txn) GROUP BY ALL"))
def k6_ledger_csv(spark, sf):
    t = txn(spark, sf).select("date", "amount", "currency", F.col("label").alias("category"), F.lit(None).cast("string").alias("subcategory"), "text", F.lit(0.5).alias("confidence"), F.lit("rule").alias("method"), (F.col("flag") == "R").alias("requires_review"))
    return export.ledger_csv(t).groupBy("category", "subcategory", "merchant", "currency", "requires_review").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("k9_nested_json", with_txn("SELECT txn_key, abs(amount) AS amount, label AS name, date FROM txn"))
def k9_nested_json(spark, sf):
    """The ledger form, read again from its JSON."""
    made = export.nested_json(txn(spark, sf).withColumn("category", F.col("label")), "ledger")
    return made.select("txn_key", F.get_json_object("json", "$.Line[0].Amount").cast("double").alias("amount"), F.get_json_object("json", "$.Line[0].AccountBasedExpenseLineDetail.AccountRef.name").alias("name"), F.get_json_object("json", "$.TxnDate").alias("date"))


@query("k10_batch_result", with_txn("SELECT text, label AS category, '' AS subcategory, '50.0%' AS confidence, 'rule' AS method, CASE WHEN flag = 'R' THEN 'Yes' ELSE 'No' END AS review, '' AS merchant FROM txn"))
def k10_batch_result(spark, sf):
    none = F.lit(None).cast("string")
    t = txn(spark, sf).select("text", F.col("label").alias("category"), none.alias("subcategory"), F.lit(0.5).alias("confidence"), F.lit("rule").alias("method"), (F.col("flag") == "R").alias("requires_review"), none.alias("merchant_resolved"))
    return export.batch_result(t)


@query("k12_cache_rows", with_txn("SELECT sha256(concat_ws(chr(31), text, cast(cast(amount * 100 as bigint) as varchar), date, currency)) AS cache_key, count(*) AS n FROM txn WHERE flag <> 'R' GROUP BY ALL"))
def k12_cache_rows(spark, sf):
    """Accepted rows that a cache keeps, by key; amounts are cents here, which all engines print alike."""
    t = txn(spark, sf).select("text", F.round(F.col("amount") * 100).cast("long").alias("amount"), "date", "currency", F.col("label").alias("category"), F.lit("").alias("subcategory"), F.lit(0.9).alias("confidence"), F.lit("rule").alias("method"), (F.col("flag") == "R").alias("requires_review"))
    return export.cache_rows(t, F.current_timestamp()).groupBy("cache_key").agg(F.count("*").alias("n"))


@query("j25_cache_lookup", with_txn(", c AS (SELECT DISTINCT account, label FROM (SELECT account, min(label) AS label FROM txn WHERE flag = 'R' GROUP BY account)) SELECT txn_key, c.label AS cached_category FROM txn LEFT JOIN c ON txn.account = c.account"))
def j25_cache_lookup(spark, sf):
    from ledgermint.functions.text import cache_key

    t = txn(spark, sf)
    cache = t.where("flag = 'R'").groupBy("account").agg(F.min("label").alias("category")).select(cache_key(F.col("account")).alias("cache_key"), "category")
    return tenancy.with_cached(t, cache, ("account",)).select("txn_key", "cached_category")


_FEEDBACK = lambda t: t.select("text", F.col("label").alias("predicted_category"), F.when(F.col("flag") == "R", "fuel").otherwise(F.col("label")).alias("correct_category"), F.lit(None).cast("string").alias("predicted_subcategory"), F.lit(None).cast("string").alias("correct_subcategory"), F.col("date").alias("timestamp"), "amount", "date")


@query("e8_feedback_rows", with_txn("SELECT predicted, correct, predicted <> correct AS was_incorrect, count(*) AS n FROM (SELECT label AS predicted, CASE WHEN flag = 'R' THEN 'fuel' ELSE label END AS correct FROM txn) GROUP BY ALL"))
def e8_feedback_rows(spark, sf):
    rows = learn.correction_rows(_FEEDBACK(txn(spark, sf)))
    return rows.groupBy(F.col("predicted_category").alias("predicted"), F.col("correct_category").alias("correct"), "was_incorrect").agg(F.count("*").alias("n"))


@query("e8_confirmed_rows", with_txn("SELECT CASE WHEN flag = 'R' THEN 'fuel' ELSE label END AS category, date, count(*) AS n, cast(sum(cast(amount as decimal(15,2))) as varchar) AS amount FROM txn GROUP BY ALL"))
def e8_confirmed_rows(spark, sf):
    rows = learn.confirmed_rows(_FEEDBACK(txn(spark, sf))).where("confidence = 1 AND reviewed AND NOT requires_review")
    return rows.groupBy("category", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.sum("amount").cast("string").alias("amount"))


@query("d12_audit", with_txn("SELECT text, label AS predicted_category, 'fuel' AS correct_category, date AS timestamp FROM txn WHERE flag = 'R' AND label <> 'fuel' ORDER BY date DESC, text LIMIT 100"))
def d12_audit(spark, sf):
    return learn.audit(_FEEDBACK(txn(spark, sf))).select("text", "predicted_category", "correct_category", "timestamp")


@query("d5_retained", with_txn("SELECT date, count(*) AS n FROM txn WHERE cast(date as date) >= DATE '1998-06-01' - 90 GROUP BY ALL"))
def d5_retained(spark, sf):
    return learn.retained(txn(spark, sf), "date", F.lit("1998-06-01").cast("date")).groupBy("date").agg(F.count("*").alias("n"))


@query("d3_class_examples", _with_keyed(", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY txn_key) AS i, count(*) OVER (PARTITION BY label) AS c FROM k) SELECT txn_key, label FROM o WHERE i <= 5 AND c >= 3"))
def d3_class_examples(spark, sf):
    return dataset.class_examples(_keyed(spark, sf), order="txn_key").select("txn_key", "label")


@query("w8_oversample", _with_keyed(f""", n AS (SELECT label, count(*) AS have, greatest(100, cast(floor(max(count(*)) OVER () * 0.8) as bigint)) AS target FROM k GROUP BY label), o AS (SELECT k.*, have, target, row_number() OVER (PARTITION BY k.label ORDER BY {_PLACE()}, txn_key) AS i FROM k JOIN n ON k.label = n.label),
a AS (SELECT label, text, unnest(range(1, (target - i) // have + 1)) AS copy, list_distinct([upper(text), lower(text), replace(text, '-', ' '), replace(text, '/', ' '), replace(text, ' ', '')]) AS v, list_distinct([1]) AS z FROM o WHERE target > have)
SELECT label, text, 0 AS copy, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT label, CASE WHEN copy > 0 THEN NULL END AS text, cast(copy as int), count(*) FROM a GROUP BY ALL"""))
def w8_oversample(spark, sf):
    """Given rows and added ones; the order of a text's spellings differs between engines, so `a16_variants` compares these."""
    rows = dataset.oversample(_keyed(spark, sf))
    return rows.groupBy("label", F.when(F.col("copy") == 0, F.col("text")).alias("text"), "copy").agg(F.count("*").alias("n"))


@query("n26_augmentation_merchant", with_txn(r"""SELECT merchant, count(*) AS n FROM (SELECT coalesce(nullif(trim(regexp_replace(array_to_string(list_slice(list_filter(string_split_regex(rest, '\s+'), lambda w: w <> ''), 1, 2), ' '), '[^A-Za-z\s]', '', 'g')), ''), rest) AS merchant FROM (SELECT regexp_replace(text, '^(UPI-|IMPS-|NEFT-|RTGS-|POS PURCHASE |ONLINE ORDER |FOOD DELIVERY |DEBIT CARD )', '') AS rest FROM txn)) GROUP BY ALL"""))
def n26_augmentation_merchant(spark, sf):
    return txn(spark, sf).groupBy(dataset.augmentation_merchant(F.col("text")).alias("merchant")).agg(F.count("*").alias("n"))


@query("g19_augmentation", with_txn(f"""SELECT label, count(*) AS original, sum(CASE WHEN label IN ('rent', 'transfers_upi') OR {_PLACE()} >= {0.3 * dataset.HASH_MOD} OR length(m) < 3 THEN 0 ELSE (SELECT count(*) FROM (SELECT unnest(list_distinct([m, lower(m), i])) AS v) WHERE lower(v) <> lower(text)) END) AS added
FROM (SELECT *, array_to_string(list_transform(string_split(m, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS i FROM (SELECT *, coalesce(nullif(trim(regexp_replace(array_to_string(list_slice(list_filter(string_split_regex(rest, '\\s+'), lambda w: w <> ''), 1, 2), ' '), '[^A-Za-z\\s]', '', 'g')), ''), rest) AS m
FROM (SELECT *, regexp_replace(text, '^(UPI-|IMPS-|NEFT-|RTGS-|POS PURCHASE |ONLINE ORDER |FOOD DELIVERY |DEBIT CARD )', '') AS rest FROM txn))) GROUP BY label"""))
def g19_augmentation(spark, sf):
    t = spark.createDataFrame([], "category string, pos int, template string")
    return dataset.augmentation_counts(dataset.augmented(txn(spark, sf), t, none=("rent", "transfers_upi")))


@query("n22_normalize_batch", with_txn("SELECT txn_key, currency, cast(cast(amount as decimal(15,2)) as varchar) AS amount, date FROM txn"))
def n22_normalize_batch(spark, sf):
    """Records under other names: description and timestamp."""
    t = txn(spark, sf).select("txn_key", F.lit(None).cast("string").alias("text"), F.col("text").alias("description"), "amount", F.col("date").alias("timestamp"))
    n = normalize.normalize_batch(t).where("cleaned_text <> ''")
    return n.select("txn_key", "currency", F.col("norm_amount").cast("string").alias("amount"), F.col("norm_date").cast("string").alias("date"))


@query("j14_label_variants", with_txn("SELECT coalesce(m.new, name) AS new_label, m.new IS NOT NULL AS known, count(*) AS n FROM (SELECT CASE WHEN flag = 'R' THEN upper(label) WHEN flag = 'A' THEN replace(label, '_', ' & ') ELSE label || '!' END AS name FROM txn) t LEFT JOIN (VALUES " + ", ".join(f"({q(o)}, '{c.id}')" for c in TAXONOMY for o in dict.fromkeys([c.name.lower(), c.id, c.name.lower().replace(" & ", "_")])) + ") m(old, new) ON lower(name) = m.old GROUP BY ALL"))
def j14_label_variants(spark, sf):
    known = spark.createDataFrame([(c.id, c.name) for c in TAXONOMY], "id string, name string")
    name = F.when(F.col("flag") == "R", F.upper("label")).when(F.col("flag") == "A", F.replace("label", F.lit("_"), F.lit(" & "))).otherwise(F.concat("label", F.lit("!")))
    t = txn(spark, sf).select(name.alias("label"), F.lit(None).cast("string").alias("category"))
    return dataset.mapped_labels(t, dataset.label_variants(known)).groupBy("new_label", (F.col("label_status") != "unmapped").alias("known")).agg(F.count("*").alias("n"))


@query("j16_replace_weak", with_txn("SELECT label, count(*) AS n FROM (SELECT label FROM txn WHERE label NOT IN ('rent', 'fuel') UNION ALL SELECT 'fuel' FROM txn WHERE flag = 'R') GROUP BY ALL"))
def j16_replace_weak(spark, sf):
    t = txn(spark, sf).select("txn_key", "label", "flag")
    return dataset.replace_weak(t, t.where("flag = 'R'").withColumn("label", F.lit("fuel")), ["rent", "fuel"]).groupBy("label").agg(F.count("*").alias("n"))


@query("j20_foreign_labels", with_txn("SELECT m.l AS label, count(*) AS n FROM txn JOIN (VALUES ('fuel', 'Fuel'), ('rent', 'Home')) m(f, l) ON txn.label = m.f GROUP BY ALL"))
def j20_foreign_labels(spark, sf):
    card = txn(spark, sf).select(F.col("text").alias("Merchant Name"), F.col("label").alias("Category"), F.col("amount").cast("string").alias("Transaction Amount"))
    labels = spark.createDataFrame([("fuel", "Fuel"), ("rent", "Home")], "foreign string, label string")
    return readers.card_rows(card, labels).groupBy("label").agg(F.count("*").alias("n"))


@query("g30_feedback_rows", with_txn("SELECT label AS category, 'feedback' AS source, count(*) AS n FROM txn WHERE flag = 'R' GROUP BY label"))
def g30_feedback_rows(spark, sf):
    return learn.feedback_training_rows(txn(spark, sf).withColumn("was_incorrect", F.col("flag") == "R"), 50).groupBy("category", "source").agg(F.count("*").alias("n"))


@query("u2_base_and_feedback", with_txn("SELECT source, label, count(*) AS n FROM (SELECT 'base' AS source, label FROM txn UNION ALL SELECT 'feedback', label FROM txn WHERE flag = 'R') GROUP BY ALL"))
def u2_base_and_feedback(spark, sf):
    t = txn(spark, sf)
    more = learn.feedback_training_rows(t.withColumn("was_incorrect", F.col("flag") == "R"), 50)
    return dataset.union_sources(t.select("text", "label", "amount", F.lit("base").alias("source")), more).groupBy("source", "label").agg(F.count("*").alias("n"))


@query("g29_few_shots", _with_vote(", k AS (SELECT txn_key, min(pred) AS category, min(confidence) AS confidence, bool_or(review) AS review, min(label) AS label FROM p GROUP BY txn_key) (SELECT txn_key, category, confidence FROM k WHERE confidence >= 0.9 AND NOT review ORDER BY confidence DESC, txn_key LIMIT 25) UNION ALL (SELECT txn_key, label, 1.0 FROM k ORDER BY txn_key LIMIT 25)"))
def g29_few_shots(spark, sf):
    k = materialise(_voted(spark, sf).groupBy("txn_key").agg(F.min("pred").alias("category"), F.min("confidence").alias("confidence"), F.bool_or("requires_review").alias("requires_review"), F.min("label").alias("label")).withColumn("text", F.lit("")))
    return learn.few_shot_set(k, k).select("txn_key", "category", "confidence")


@query("j18_templates", "SELECT count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT 'bought ' || p_name AS text, p_type AS c FROM part UNION SELECT p_name || ' shop', p_type FROM part)")
def j18_templates(spark, sf):
    keywords = read(spark, sf, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("keyword")).distinct()
    templates = keywords.select("category").distinct().withColumn("template", F.explode(F.array(F.lit("bought {merchant}"), F.lit("{merchant} shop"))))
    return dataset.expand_templates(keywords, templates, 1_000_000).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("j6_search", with_txn(f"""SELECT clean, canonical AS merchant, score FROM (SELECT x.clean, a.canonical, 1.0 AS score FROM xs x JOIN a ON x.clean = a.alias UNION ALL SELECT clean, arg_min(canonical, pos), 0.85 FROM (SELECT x.clean, a.canonical, a.pos FROM xs x JOIN a ON length(a.alias) >= 4 AND NOT contains(a.alias, '*') AND NOT contains(a.alias, ' ') AND contains(x.clean, a.alias) WHERE x.clean NOT IN (SELECT alias FROM a)) GROUP BY clean)""", _NAMES.replace('SELECT text AS name FROM txn', f"SELECT p_name || ' ' || {_case('(p_partkey % 16)', [b[0] for b in BRANDS])} AS name FROM part")))
def j6_search(spark, sf):
    """Sure matches of a search; the similar ones are those of `j4_trigram_matches` and of the tests."""
    names = read(spark, sf, "part").selectExpr(f"p_name || ' ' || {_case('(p_partkey % 16)', [b[0] for b in BRANDS])} AS query")
    return resolve.search(names, gazetteer(spark)).where("match_type IN ('exact', 'substring')").select("clean", F.col("m_canonical_name").alias("merchant"), "score")


@query("j22_tenants", with_txn("SELECT CASE WHEN org IS NULL THEN NULL WHEN org < 3 THEN 'slug' || cast(org as varchar) ELSE 'org-' || cast(org as varchar) END AS org_slug, CASE WHEN org IS NULL THEN NULL WHEN org < 3 THEN 'admin' ELSE 'member' END AS role, count(*) AS n FROM (SELECT CASE WHEN account % 7 = 0 THEN NULL ELSE account % 7 END AS org FROM txn) GROUP BY ALL"))
def j22_tenants(spark, sf):
    orgs = spark.createDataFrame([(1, "slug1", "admin"), (2, "slug2", "admin")], "id long, slug string, role string")
    t = txn(spark, sf).withColumn("organization_id", F.when(F.col("account") % 7 != 0, F.col("account") % 7))
    return tenancy.with_tenant(t, orgs).groupBy("org_slug", "role").agg(F.count("*").alias("n"))


@query("c9_external_requests", with_txn("SELECT md5(lower(trim(text))) AS request_key, 'Choose one category of: " + ", ".join(c.id for c in TAXONOMY) + ".' || chr(10) || 'Transaction: ZOMATO -> food_dining' || chr(10) || 'Transaction: ' || min(text) || chr(10) || 'Answer as JSON: {\"category\": ..., \"confidence\": ..., \"reasoning\": ...}' AS prompt FROM txn GROUP BY 1"))
def c9_external_requests(spark, sf):
    return external.requests(txn(spark, sf), [("ZOMATO", "food_dining")], [c.id for c in TAXONOMY])


# --- sources -------------------------------------------------------------------------------------------
@query("s7_upload_rows", "SELECT conv_id AS name, turn, md5(trim(text)) AS text FROM conversations WHERE trim(replace(text, chr(10), ' ')) <> ''")
def s7_upload_rows(spark, sf):
    c = read(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("name"), F.to_json(F.array(F.struct(F.lit("x").alias("id"), F.col("text").alias("description")))).alias("content"))
    rows = readers.upload_rows(c)
    return rows.select(F.split("name", "/")[0].cast("long").alias("name"), F.split("name", "/")[1].cast("long").alias("turn"), F.md5("text").alias("text"))


_DAY = "substr(cast(l_shipdate as string), 9, 2) || '/' || substr(cast(l_shipdate as string), 6, 2) || '/' || substr(cast(l_shipdate as string), 1, 4)"
_STATEMENT = f"'STATEMENT OF ACCOUNT' || chr(10) || {_DAY} || '  PAYMENT ' || cast(l_partkey as string) || ' INR ' || cast(l_quantity as int) || CASE WHEN l_linenumber % 2 = 0 THEN '.50' ELSE '' END || chr(10) || 'short' || chr(10) || 'CARD FEE FOR ' || cast(l_suppkey as string) || ' ITEMS' || chr(10) || 'Closing Balance 12'"


@query("s8_statement_lines", "SELECT substr(cast(l_shipdate as varchar), 1, 10) AS date, 'PAYMENT ' || cast(l_partkey as varchar) || ' INR' AS text, cast(l_quantity as int) + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0.0 END AS amount, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT NULL, 'CARD FEE FOR ' || cast(l_suppkey as varchar) || ' ITEMS', NULL, count(*) FROM lineitem GROUP BY ALL")
def s8_statement_lines(spark, sf):
    docs = read(spark, sf, "lineitem").selectExpr("l_orderkey AS id", f"{_STATEMENT} AS content")
    rows = readers.statement_rows(docs, "id", "content")
    return rows.groupBy(F.col("date").cast("string").alias("date"), "text", "amount").agg(F.count("*").alias("n"))


# --- monitoring ----------------------------------------------------------------------------------------
@query("w1_runtime_stats", "SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS rolling_mean, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS running_count, round(avg(value) OVER (w ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_mean, round(avg((value > 0.5)::int) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running_review_rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def w1_runtime_stats(spark, sf):
    r = monitor.runtime_stats(read(spark, sf, "events"), ["event_type"], review=F.col("value") > 0.5, chunk_rows=1000)
    mean = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return r.select("event_id", mean("rolling_mean"), "running_count", mean("running_mean"), F.round("running_review_rate", 6).alias("running_review_rate"))


@query("w5_rate_limit", "WITH d AS (SELECT DISTINCT user_id, ts, epoch_us(ts) AS us FROM events) SELECT user_id, epoch_us(ts) AS us, count(*) OVER w AS used, count(*) OVER w < 3 AS allowed, greatest(3 - count(*) OVER w - 1, 0) AS remaining FROM d WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING)")
def w5_rate_limit(spark, sf):
    return monitor.rate_limit(read(spark, sf, "events"), limit=3, seconds=86400).select("user_id", monitor.micros(F.col("ts")).alias("us"), "used", "allowed", "remaining")


_BIN = lambda seconds: f"epoch(ts)::bigint // {seconds} * {seconds}"


@query("z4_rates", f"SELECT {_BIN(3600)} AS start, event_type, count(*) AS n, round(count(*) / 3600, 9) AS per_second FROM events GROUP BY ALL".replace("epoch(ts)::bigint", "floor(epoch(ts))::bigint"))
def z4_rates(spark, sf):
    return monitor.rates(read(spark, sf, "events"), "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n", "per_second")


@query("z4_sliding_rates", "SELECT (floor(epoch(ts))::bigint // 1800 - o) * 1800 AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY ALL")
def z4_sliding_rates(spark, sf):
    return monitor.rates(read(spark, sf, "events"), "1 hour", "30 minutes").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("z6_shares", "SELECT floor(epoch(ts))::bigint // 86400 * 86400 AS start, count(*) AS n, count_if(event_type = 'error') AS hits, round(count_if(event_type = 'error') / count(*), 9) AS share FROM events GROUP BY ALL")
def z6_shares(spark, sf):
    return monitor.shares(read(spark, sf, "events"), F.col("event_type") == "error", "1 day").select(F.unix_timestamp("start").alias("start"), "n", "hits", "share")


def _quantile_sql(p: float) -> str:
    b = monitor.LATENCY_BOUNDS
    cases = []
    for i, hi in enumerate(b):
        lo, before = (0.0, "0") if i == 0 else (b[i - 1], f"le_{i - 1}")
        cases.append(f"WHEN le_{i} >= {p} * le_inf THEN CASE WHEN le_{i} - {before} > 0 THEN {lo} + {hi - lo} * ({p} * le_inf - {before}) / (le_{i} - {before}) ELSE {lo} END")
    return f"round(CASE {' '.join(cases)} ELSE {b[-1]} END, 6)"


@query("z5_quantiles", "WITH h AS (SELECT floor(epoch(ts))::bigint // 86400 * 86400 AS start, " + ", ".join(f"count_if(value <= {b}) AS le_{i}" for i, b in enumerate(monitor.LATENCY_BOUNDS)) + f", count(*) AS le_inf FROM events GROUP BY 1) SELECT start, le_inf AS n, {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.95)} AS p95, {_quantile_sql(0.99)} AS p99 FROM h")
def z5_quantiles(spark, sf):
    return monitor.quantiles(read(spark, sf, "events"), "1 day").select(F.unix_timestamp("start").alias("start"), "n", "p50", "p95", "p99")


@query("z8_histogram", "SELECT floor(epoch(ts))::bigint // 86400 * 86400 AS start, b AS le, count_if(value <= b) AS n FROM events, (VALUES (0.5::double), (0.6::double), (0.7::double), (0.75::double), (0.8::double), (0.85::double), (0.9::double), (0.95::double), (1.0::double)) v(b) GROUP BY ALL")
def z8_histogram(spark, sf):
    return monitor.histogram(read(spark, sf, "events"), "1 day", "value", monitor.CONFIDENCE_BOUNDS).select(F.unix_timestamp("start").alias("start"), "le", "n")


@query("z9_top_errors", "SELECT * FROM (SELECT start, event_type, user_id, n, row_number() OVER (PARTITION BY start ORDER BY n DESC, event_type, user_id) AS rank FROM (SELECT floor(epoch(ts))::bigint // 86400 * 86400 AS start, event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 10")
def z9_top_errors(spark, sf):
    counts = monitor.rates(read(spark, sf, "events"), "1 day", by=("event_type", "user_id"))
    return monitor.top_per_window(counts, 10, ties=("event_type", "user_id")).select(F.unix_timestamp("start").alias("start"), "event_type", "user_id", "n", "rank")


@query("z10_last_value", "SELECT floor(epoch(ts))::bigint // 3600 * 3600 AS start, arg_max(value, {'t': ts, 'e': event_id}) AS last, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def z10_last_value(spark, sf):
    return monitor.last_value(read(spark, sf, "events"), "1 hour").select(F.unix_timestamp("start").alias("start"), "last", "mean")


@query("z11_alerts", "WITH m AS (SELECT floor(epoch(ts))::bigint // 3600 * 3600 AS start, count_if(event_type = 'error') / count(*) AS share FROM events GROUP BY 1), o AS (SELECT *, share > 0.15 AS on_, row_number() OVER (ORDER BY start) AS a, row_number() OVER (PARTITION BY share > 0.15 ORDER BY start) AS b FROM m) SELECT min(start) AS \"from\", max(start) AS \"to\", count(*) AS evaluations FROM o WHERE on_ GROUP BY a - b HAVING count(*) >= 2")
def z11_alerts(spark, sf):
    m = monitor.shares(read(spark, sf, "events"), F.col("event_type") == "error", "1 hour").withColumn("start", F.unix_timestamp("start"))
    return monitor.alerts(m, F.col("hits") / F.col("n") > 0.15, 2)


@query("w4_percent_change", """WITH d AS (SELECT event_type, floor(epoch(ts))::bigint // 86400 AS d, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY d) AS before FROM d), c AS (SELECT *, (n - before) / before * 100 AS x FROM b)
SELECT event_type, d, n, CASE WHEN x IS NULL THEN NULL ELSE CASE WHEN x > 0 THEN '+' ELSE '' END || CASE WHEN abs(x) >= 10 THEN printf('%.0f', round_even(x, 0)) ELSE printf('%.1f', round_even(x * 10, 0) / 10) END || '%' END AS change FROM c""")
def w4_percent_change(spark, sf):
    d = read(spark, sf, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 86400).alias("d")).agg(F.count("*").alias("n"))
    return monitor.percent_change(d, "n", "d", ["event_type"])


@query("z7_cache_rates", "WITH e AS (SELECT floor(epoch(ts))::bigint // 3600 * 3600 AS start, event_type <> 'error' AS hit FROM events) SELECT start, count(*) AS n, count_if(hit) AS hits, count_if(NOT hit) AS misses, round(count_if(hit) / count(*), 9) AS share, round(count_if(hit) / 3600, 9) AS hits_per_second, round(count_if(NOT hit) / 3600, 9) AS misses_per_second FROM e GROUP BY start")
def z7_cache_rates(spark, sf):
    return monitor.hit_rates(read(spark, sf, "events").withColumn("hit", F.col("event_type") != "error"), "1 hour").withColumn("start", F.unix_timestamp("start"))


@query("z2_ttl_cache", """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, ts, event_id, i, ts AS entered, false AS hit FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.ts, e.event_id, e.i, CASE WHEN epoch_us(e.ts) - epoch_us(r.entered) <= 86400000000 THEN r.entered ELSE e.ts END, epoch_us(e.ts) - epoch_us(r.entered) <= 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, hit FROM r""")
def z2_ttl_cache(spark, sf):
    return monitor.ttl_cache(read(spark, sf, "events"), "user_id", seconds=86400).select("user_id", "event_id", "hit")


# --- models --------------------------------------------------------------------------------------------
@query("m5_nearest_centroid", """WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label AS l, i, avg(x) AS m FROM e GROUP BY ALL), d AS (SELECT vec_id, l, sum((x - m) * (x - m)) AS g FROM e JOIN c ON e.i = c.i GROUP BY ALL)
SELECT d.vec_id, arg_min(l, {'g': round(g, 9), 'l': l}) AS pred, round(arg_min(g, {'g': round(g, 9), 'l': l}), 3) AS distance, any_value(v.label) AS label FROM d JOIN embeddings v ON d.vec_id = v.vec_id GROUP BY d.vec_id""")
def m5_nearest_centroid(spark, sf):
    e = read(spark, sf, "embeddings")
    return ml.nearest_label(e, ml.centroids(e)).join(e.select("vec_id", "label"), "vec_id").withColumn("distance", F.round("distance", 3))


def _embedded(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").withColumn("label", F.concat(F.lit("c"), F.col("label").cast("string")))
    return ml.vectors(e).select(F.col("vec_id").alias("txn_key"), "label", "vector")


@query("m7_train_and_score")
def m7_train_and_score(spark, sf):
    """A regression on four fifths of the embeddings; the metrics of the rest, which it has not seen."""
    return jobs.train(_embedded(spark, sf), kind="regression", vector="vector", weighted=False).metrics


@query("m6_training_rows")
def m6_training_rows(spark, sf):
    """Prepared training rows: normalised, with features, spoken forms of three tenths; tests look at the rows."""
    t = spark.createDataFrame([], "category string, pos int, template string")
    rows = jobs.prepared(txn(spark, sf).select("txn_key", "text", "label", "amount", "date"), t)
    return rows.groupBy("label", "augmented").agg(F.count("*").alias("n"), F.round(F.sum("f_amount_log"), 3).alias("amount_logs"))
