"""Monitoring of request events: windows over rows, windowed rates, quantiles from buckets, alerts; batch and stream.

The windowed aggregates take batch and streaming DataFrames alike. Order-dependent ones (rolling means
over the last rows, rate limits, caches) are defined per key, so that Spark can spread them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ledgermint.functions.lineage import materialise

#: Bounds of the histograms of latency and of database time, in seconds, and of confidence.
LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
CONFIDENCE_BOUNDS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
DATABASE_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
WATERMARK = "10 minutes"
#: The store that keeps lists, values and timers of keys, also behind an aggregation.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


#: Rows of a key that one task takes at once, and seconds of a key that are sorted at once.
CHUNK_ROWS, SORT_SECONDS = 100_000, 3600


def _running(rows: DataFrame, keys: list[str], part: str, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """`rows` with running sums of each key in order, from the sums of whole parts and a window over each part."""
    totals = rows.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(part)  # a row per key and part
    before = totals.select(*[F.col(k).alias(f"_b_{k}") for k in [*keys, part]], *[(F.sum(f"_t_{n}").over(w) - F.col(f"_t_{n}")).alias(f"_t_{n}") for n in sums])
    inner = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in [*keys, part]]
    joined = rows.withColumns({f"_r_{n}": F.sum(c).over(inner) for n, c in sums.items()}).join(before, reduce(lambda a, b: a & b, same))
    return joined.withColumns({n: F.col(f"_r_{n}") + F.col(f"_t_{n}") for n in sums}).drop(*[f"_{x}_{n}" for x in "rt" for n in sums], *[f"_b_{k}" for k in [*keys, part]])


def runtime_stats(events: DataFrame, by: list[str], value: str = "value", last: int = 500, order: tuple[str, ...] = ("ts", "event_id"), review: Column | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`events` with rolling mean of the last rows, running count and running mean, per key (an endpoint, a user); with `review`, the running rate of it.

    Rows are numbered from counts per hour and dealt into chunks, the last rows of a chunk standing
    before the next one too, so that a key with most of the rows is spread.
    """
    work = events.withColumn("_hour", F.floor(F.unix_timestamp(order[0]) / SORT_SECONDS))
    work = _running(work, by, "_hour", order, {"running_count": F.lit(1)})
    work = work.withColumn("_chunk", F.floor((F.col("running_count") - 1) / chunk_rows))
    sums = {"_sum": F.col(value).cast("double")} | ({"_reviews": F.when(review, 1).otherwise(0)} if review is not None else {})
    work = _running(work, by, "_chunk", ("running_count",), sums)
    ahead = F.pmod(F.col("running_count") - 1, F.lit(chunk_rows)) >= chunk_rows - (last - 1)
    places = F.when(ahead, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    spread = work.withColumn("_in", F.explode(places))
    rolling = Window.partitionBy(*by, "_in").orderBy("running_count").rowsBetween(-(last - 1), 0)
    out = spread.withColumn("rolling_mean", F.avg(value).over(rolling)).where("_in = _chunk").withColumn("running_mean", F.col("_sum") / F.col("running_count"))
    out = out.withColumn("running_review_rate", F.col("_reviews") / F.col("running_count")) if review is not None else out
    return out.drop("_hour", "_chunk", "_in", "_sum", "_reviews")


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 100, seconds: int = 60, slice_seconds: int | None = None) -> DataFrame:
    """(key, ts, used, allowed, remaining) of each distinct request time: allowed while fewer than `limit` lie in the window before it; rejected ones count too.

    A key's times are dealt into slices, and the last `seconds` of a slice are carried into the next one, so that
    a key with most of the requests is counted in many tasks. A null key is a key.
    """
    length = max(slice_seconds or SORT_SECONDS, seconds) * 1_000_000
    d = events.select(key, ts).distinct().withColumn("_us", micros(F.col(ts))).withColumn("_slice", F.floor(F.col("_us") / length))
    carried = F.pmod(F.col("_us"), F.lit(length)) >= length - seconds * 1_000_000
    dealt = d.withColumn("_in", F.explode(F.when(carried, F.array("_slice", F.col("_slice") + 1)).otherwise(F.array("_slice"))))
    w = Window.partitionBy(key, "_in").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    used = dealt.withColumn("used", F.count("*").over(w)).where("_in = _slice")
    return used.select(key, ts, "used", (F.col("used") < limit).alias("allowed"), F.greatest(F.lit(limit) - F.col("used") - 1, F.lit(0)).alias("remaining"))


def percent_change(snapshots: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """`snapshots` with the change to the one before in percent, as a signed text: 0 before gives 0 or +100."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    change = F.when(before.isNull(), None).when(before == 0, F.when(F.col(value) == 0, 0.0).otherwise(100.0)).otherwise((F.col(value) - before) / before * 100)
    sign = F.when(change > 0, "+").otherwise("")
    shown = F.when(F.abs(change) >= 10, F.format_string("%.0f", F.rint(change))).otherwise(F.format_string("%.1f", F.rint(change * 10) / 10))
    return snapshots.withColumn("change", F.when(change.isNotNull(), F.concat(sign, shown, F.lit("%"))))


def rates(events: DataFrame, length: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), ts: str = "ts", watermark: bool = False) -> DataFrame:
    """(start, end, keys, n, per_second) of each window; a stream wants `watermark`."""
    e = events.withWatermark(ts, WATERMARK) if watermark else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    span = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", F.round(F.col("n") / span, 9).alias("per_second"))


def shares(events: DataFrame, test: Column, length: str, by: tuple[str, ...] = (), ts: str = "ts", watermark: bool = False) -> DataFrame:
    """(start, keys, n, hits, share) of rows that meet a test: review, acceptance, cache hit or error rates."""
    e = events.withWatermark(ts, WATERMARK) if watermark else events
    out = e.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(test).alias("hits"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("share"))


def buckets(value: Column, bounds: tuple[float, ...]) -> list[Column]:
    """Cumulative counts up to each bound, then all."""
    return [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)] + [F.count("*").alias("le_inf")]


def bucket_quantile(q: float, bounds: tuple[float, ...]) -> Column:
    """The q quantile of cumulative counts le_0 .. le_inf, linear inside its bucket; the last bound beyond it."""
    rank, out = F.lit(q) * F.col("le_inf"), None
    for i, b in enumerate(bounds):
        low, before = (0.0, F.lit(0)) if i == 0 else (bounds[i - 1], F.col(f"le_{i - 1}"))
        here = F.col(f"le_{i}") - before
        value = F.when(here > 0, low + (b - low) * (rank - before) / here).otherwise(low)
        out = F.when(F.col(f"le_{i}") >= rank, value) if out is None else out.when(F.col(f"le_{i}") >= rank, value)
    return F.round(out.otherwise(bounds[-1]), 6)


def quantiles(events: DataFrame, length: str, value: str = "value", bounds: tuple[float, ...] = LATENCY_BOUNDS, ts: str = "ts", watermark: bool = False) -> DataFrame:
    """(start, n, p50, p95, p99) of each window from its histogram."""
    e = events.withWatermark(ts, WATERMARK) if watermark else events
    h = e.groupBy(F.window(ts, length).alias("w")).agg(*buckets(F.col(value), bounds))
    return h.select(F.col("w.start").alias("start"), F.col("le_inf").alias("n"), *[bucket_quantile(q, bounds).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


def histogram(events: DataFrame, length: str, value: str, bounds: tuple[float, ...], ts: str = "ts") -> DataFrame:
    h = events.groupBy(F.window(ts, length).alias("w")).agg(*buckets(F.col(value), bounds))
    return h.select(F.col("w.start").alias("start"), F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)])).alias("b")).select("start", "b.*")


@dataclass(frozen=True)
class AlertRule:
    """A measure of a window ("errors", "reviews", "p95", "agreement", "hits"), the bound beyond which it alerts, and for how many minutes."""

    measure: str
    bound: float
    minutes: int
    below: bool = False


#: The alerts of the service.
ALERT_RULES = (AlertRule("errors", 0.05, 5), AlertRule("reviews", 0.30, 10), AlertRule("p95", 2.0, 5), AlertRule("agreement", 0.6, 15, True), AlertRule("hits", 0.20, 10, True))


def rule_alerts(metrics: DataFrame, rules: tuple[AlertRule, ...] = ALERT_RULES, minutes: int = 1) -> DataFrame:
    """(measure, from, to, evaluations) of every rule; `metrics` has a row per window of `minutes`, with `start` and a column per measure."""
    found = []
    for r in rules:
        test = F.coalesce(F.col(r.measure) < r.bound if r.below else F.col(r.measure) > r.bound, F.lit(False))
        found.append(alerts(metrics, test, -(-r.minutes // minutes)).withColumn("measure", F.lit(r.measure)))
    return reduce(lambda a, b: a.unionByName(b), found)


def service_metrics(events: DataFrame, length: str = "1 minute", ts: str = "ts", watermark: bool = False) -> DataFrame:
    """(start, errors, reviews, p95, agreement, hits) of each window of requests (ts, error, review, seconds, agreement, hit); shares are of the rows where the measure is known."""
    e = events.withWatermark(ts, WATERMARK) if watermark else events
    h = e.groupBy(F.window(ts, length).alias("w")).agg(*buckets(F.col("seconds"), LATENCY_BOUNDS), *[F.avg(F.col(c).cast("double")).alias(n) for n, c in (("errors", "error"), ("reviews", "review"), ("agreement", "agreement"), ("hits", "hit"))])
    return h.select(F.col("w.start").alias("start"), "errors", "reviews", bucket_quantile(0.95, LATENCY_BOUNDS).alias("p95"), "agreement", "hits")


class AlertRuns(StatefulProcessor):
    """The run of evaluations of a rule that meet its test: state of one row a rule. A run leaves when it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names of the interface
        first, last, n = self.run.get() if self.run.exists() else (0, 0, 0)
        found = []
        for at, hold, on in pd.concat(list(rows)).sort_values("start")[["start", "hold", "on"]].itertuples(index=False):
            now = at.value // 1000
            if on:
                first, last, n = (first if n else now), now, n + 1
            else:
                if n >= hold:
                    found.append((key[0], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n))
                n = 0
        self.run.update((first, last, n))
        yield pd.DataFrame(found, columns=["measure", "from", "to", "evaluations"])

    def close(self) -> None:
        pass


def stream_rule_alerts(events: DataFrame, rules: tuple[AlertRule, ...] = ALERT_RULES, minutes: int = 1, ts: str = "ts") -> DataFrame:
    """(measure, from, to, evaluations): the alerts of `rule_alerts` on a stream of requests, each once its run has ended.

    Windows close with the watermark and go, as one row a rule, to state that holds the run of each rule: its
    first and last window and length. Windows without requests are no evaluations, as in `rule_alerts`.
    """
    metrics = service_metrics(events, f"{minutes} minutes", ts, watermark=True)
    tests = [F.struct(F.lit(r.measure).alias("measure"), F.lit(-(-r.minutes // minutes)).alias("hold"), F.coalesce(F.col(r.measure) < r.bound if r.below else F.col(r.measure) > r.bound, F.lit(False)).alias("on")) for r in rules]
    rows = metrics.select("start", F.inline(F.array(*tests)))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy("measure").transformWithStateInPandas(AlertRuns(), "measure string, `from` timestamp, `to` timestamp, evaluations long", "Append", "None")


def top_per_window(counts: DataFrame, k: int = 10, by: tuple[str, ...] = ("start",), ties: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The k largest groups of each window; ties by the named columns."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *ties)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def last_value(events: DataFrame, length: str, value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(start, last, mean) of each window."""
    g = events.groupBy(F.window(ts, length).alias("w")).agg(F.max_by(value, F.struct(ts, tie)).alias("last"), F.round(F.avg(value), 6).alias("mean"))
    return g.select(F.col("w.start").alias("start"), "last", "mean")


def alerts(metric: DataFrame, test: Column, hold: int, order: str = "start", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of at least `hold` evaluations in a row that meet a test: (keys, from, to, evaluations).

    `metric` has a row per window and key, so it is small against the events; runs are found by the
    difference of two row numbers.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    m = metric.withColumn("_on", test).withColumn("_a", F.row_number().over(w.orderBy(order)))
    inner = Window.partitionBy(*by, "_on").orderBy(order)
    on = m.withColumn("_island", F.col("_a") - F.row_number().over(inner)).where("_on")
    runs = on.groupBy(*by, "_island").agg(F.min(order).alias("from"), F.max(order).alias("to"), F.count("*").alias("evaluations"))
    return runs.where(F.col("evaluations") >= hold).drop("_island")


def _walk(times: np.ndarray, entered: int | None, ttl: int) -> tuple[np.ndarray, int]:
    """Whether each request of a key, in order, is a hit, and the time of the last entry. From each miss on, all within `ttl` are hits."""
    hits, i = np.zeros(len(times), bool), 0
    if entered is not None:
        i = int(np.searchsorted(times, entered + ttl, "right"))
        hits[:i] = True
    while i < len(times):
        entered = int(times[i])
        j = int(np.searchsorted(times, entered + ttl, "right"))
        hits[i + 1 : j] = True
        i = j
    return hits, entered


def _exits(times: np.ndarray, ttl: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """What a slice does with an entry of before it: (thresholds, lasts). A slice entered at e leaves with the last of the first threshold beyond e + ttl; with e itself beyond all.

    Only requests that may be the first miss of the slice are thresholds: those within `ttl` of its begin, and the
    next one. All of them step from miss to miss at once, and neighbours that end in the same miss are one.
    """
    after = np.searchsorted(times, times + ttl, "right")
    firsts = np.arange(min(len(times), int(np.searchsorted(times, begin + ttl, "right")) + 1))
    at = firsts.copy()
    while (moving := after[at] < len(times)).any():
        at[moving] = after[at[moving]]
    ends = np.append(np.flatnonzero(np.diff(at)), len(at) - 1)  # the last threshold of each run of equal exits
    return times[firsts[ends]], times[at[ends]]


#: Lengths of life of an entry that a slice of a key's requests lasts.
SLICE_LIVES = 24


def ttl_cache(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", seconds: int = 600, slice_seconds: int | None = None) -> DataFrame:
    """(key, ts, tie, hit) of each request: a hit while the last miss of its key is at most `seconds` old; hits do not refresh. A null key is a key.

    Entry times depend on one another, but a slice of time acts on the entry before it as a step function, which its
    requests alone give. Slices are read in parallel, their functions (a few numbers) are composed per key, and
    then every slice is walked from the entry it starts with: a key with most of the requests is many tasks' work.
    """
    ttl, length = seconds * 1_000_000, (slice_seconds or SLICE_LIVES * seconds) * 1_000_000
    source = events.select(key, ts, tie).withColumn("_us", micros(F.col(ts))).withColumn("_slice", F.floor(F.col("_us") / length))
    kind = dict(events.dtypes)[key]

    def function(group: pa.Table) -> pa.Table:
        times = np.sort(group["_us"].to_numpy())
        part = group["_slice"][0].as_py()
        thresholds, lasts = _exits(times, ttl, part * length)
        return pa.table({key: group[key].slice(0, 1), "_slice": pa.array([part], pa.int64()), "_at": pa.array([thresholds], pa.list_(pa.int64())), "_last": pa.array([lasts], pa.list_(pa.int64()))})

    def compose(group: pa.Table) -> pa.Table:
        group = group.sort_by("_slice")
        entered, before = None, []
        for at, last in zip(group["_at"], group["_last"], strict=True):
            before.append(entered)
            at, last = at.values.to_numpy(), last.values.to_numpy()
            i = 0 if entered is None else int(np.searchsorted(at, entered + ttl, "right"))
            entered = int(last[i]) if i < len(at) else entered
        return pa.table({key: group[key], "_slice": group["_slice"], "_entered": pa.array(before, pa.int64())})

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_us", "ascending"), (tie, "ascending")])
        hits, _ = _walk(group["_us"].to_numpy(), group["_entered"][0].as_py(), ttl)
        return group.select([key, ts, tie]).append_column("hit", pa.array(hits))

    functions = source.select(key, "_slice", "_us").groupBy(key, "_slice").applyInArrow(function, f"`{key}` {kind}, _slice bigint, _at array<bigint>, _last array<bigint>")
    entries = functions.groupBy(key).applyInArrow(compose, f"`{key}` {kind}, _slice bigint, _entered bigint").select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), "_entered")
    joined = source.join(entries, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s"))).drop("_k", "_s")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(key, ts, tie).schema)
    return joined.groupBy(key, "_slice").applyInArrow(walk, schema + ", hit boolean")


def hit_rates(answered: DataFrame, length: str, ts: str = "ts", watermark: bool = False) -> DataFrame:
    """(start, n, hits, misses, share, hits_per_second, misses_per_second) of cache answers (ts, hit) by window."""
    e = answered.withWatermark(ts, WATERMARK) if watermark else answered
    out = e.groupBy(F.window(ts, length).alias("w")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    span, misses = F.unix_timestamp("w.end") - F.unix_timestamp("w.start"), F.col("n") - F.col("hits")
    return out.select(F.col("w.start").alias("start"), "n", "hits", misses.alias("misses"), F.round(F.col("hits") / F.col("n"), 9).alias("share"), F.round(F.col("hits") / span, 9).alias("hits_per_second"), F.round(misses / span, 9).alias("misses_per_second"))


def stream_runtime_stats(events: DataFrame, sink, by: list[str], store: str, last: int = 500, value: str = "value", order: tuple[str, ...] = ("ts", "event_id")):
    """Rolling and running figures of a stream, batch by batch: the last rows and totals of each key are kept below `store`, one table per batch.

    `sink` takes each batch's rows with rolling_mean, running_count and running_mean, and its number. A
    batch that runs again reads the state of the batch before it, so it gives the same rows.
    """

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        cols = [*by, *order, value]
        fresh = rows.select(*cols).withColumn("_new", F.lit(True))
        try:
            old = spark.read.parquet(f"{store}/{number - 1}") if number else None
        except AnalysisException:
            old = None
        if old is None:
            old = fresh.limit(0).select(*cols, F.lit(0).cast("long").alias("_count"), F.lit(0.0).alias("_sum"))
        totals = old.groupBy(*by).agg(F.max("_count").alias("_count0"), F.max_by("_sum", "_count").alias("_sum0"))
        both = old.select(*cols, F.lit(False).alias("_new")).unionByName(fresh)
        w = Window.partitionBy(*by).orderBy("_new", *order)
        counted = both.join(totals, by, "left").withColumn("_count", F.coalesce("_count0", F.lit(0)) + F.sum(F.col("_new").cast("long")).over(w)).withColumn("_sum", F.coalesce("_sum0", F.lit(0.0)) + F.sum(F.when(F.col("_new"), F.col(value)).otherwise(0.0)).over(w))
        counted = materialise(counted.withColumn("rolling_mean", F.avg(value).over(w.rowsBetween(-(last - 1), 0))).drop("_count0", "_sum0"))
        newest = Window.partitionBy(*by).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
        kept = counted.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last - 1)
        kept.select(*cols, "_count", "_sum").write.mode("overwrite").parquet(f"{store}/{number}")
        sink(counted.where("_new").select(*cols, "rolling_mean", F.col("_count").alias("running_count"), (F.col("_sum") / F.col("_count")).alias("running_mean")), number)

    return events.writeStream.foreachBatch(step)


def _keyed_state(events: DataFrame, key: str, ts: str, processor: StatefulProcessor, extra: str) -> DataFrame:
    """`events` by key through a processor whose state has event-time timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = dict(events.dtypes)
    return events.select(key, ts).withWatermark(ts, WATERMARK).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kinds[key]}, `{ts}` timestamp, {extra}", "Append", "EventTime")


class _Limits(StatefulProcessor):
    """Request times of a key: a list, cleared by a timer once the watermark has passed their window."""

    def __init__(self, key: str, ts: str, limit: int, seconds: int):
        self.key, self.ts, self.limit, self.window = key, ts, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at long")

    def _keep(self, times: list[int], watermark_ms: int) -> None:
        kept = [t for t in times if t > watermark_ms * 1000 - self.window]
        if kept:
            self.times.put([(t,) for t in kept])
            self.handle.registerTimer((kept[-1] + self.window) // 1000 + 1)
        else:
            self.times.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times, out = sorted(t for (t,) in self.times.get()), []
        for at in pd.concat(list(rows))[self.ts].sort_values().drop_duplicates():
            now = int(at.value // 1000)
            place = bisect_left(times, now)
            if place < len(times) and times[place] == now:
                continue  # answered before
            used = place - bisect_right(times, now - self.window)
            times.insert(place, now)
            out.append((key[0], at, used, used < self.limit))
        self._keep(times, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=[self.key, self.ts, "used", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(sorted(t for (t,) in self.times.get()), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class _Entries(StatefulProcessor):
    """The time of a key's entry, cleared by a timer once the watermark has passed its end."""

    def __init__(self, key: str, ts: str, seconds: int):
        self.key, self.ts, self.ttl = key, ts, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entered = handle, handle.getValueState("entered", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.ts)
        times = np.array([at.value // 1000 for at in frame[self.ts]], np.int64)
        hits, entered = _walk(times, self.entered.get()[0] if self.entered.exists() else None, self.ttl)
        self.entered.update((entered,))
        self.handle.registerTimer(max((entered + self.ttl) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame({self.key: key[0], self.ts: frame[self.ts], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entered.exists() and self.entered.get()[0] + self.ttl < timerValues.getCurrentWatermarkInMs() * 1000:
            self.entered.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 100, seconds: int = 60) -> DataFrame:
    """(key, ts, used, allowed) of a stream, answered as requests arrive; equal to `rate_limit` where they arrive in order.

    A request that is late, but within the watermark, counts what lies in the window before it; a time that was
    answered is not answered again. Later ones are dropped.
    """
    return _keyed_state(events, key, ts, _Limits(key, ts, limit, seconds), "used long, allowed boolean")


def stream_ttl_cache(events: DataFrame, key: str, ts: str = "ts", seconds: int = 600) -> DataFrame:
    """(key, ts, hit) of a stream, answered as requests arrive; equal to `ttl_cache` where they arrive in order. A late request within the watermark is a hit while there is an entry."""
    return _keyed_state(events, key, ts, _Entries(key, ts, seconds), "hit boolean")


def stream_retrain_trigger(corrections: DataFrame, every: int = 50) -> DataFrame:
    """(at): a row at each `every`-th correction of a stream, of all labels together: partitions are counted first, one small number per batch and partition meets the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["one", "n"])

    def step(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(int(f["n"].sum()) for f in frames)
        state.update((now,))
        yield pd.DataFrame([(k * every,) for k in range(before // every + 1, now // every + 1)], columns=["at"])

    counts = corrections.select(F.lit(1).alias("x")).mapInArrow(count, "one int, n long")
    return counts.groupBy("one").applyInPandasWithState(step, "at long", "n bigint", "append", GroupStateTimeout.NoTimeout)
