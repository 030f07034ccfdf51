"""Structured Streaming forms of the operators.

Per-key states are expressed as stateful pandas processors on the RocksDB state
store; exact trailing windows run as the batch operators on every micro-batch
with a carry-over of the frame's length (``foreachBatch``)."""

from __future__ import annotations

import heapq
import logging
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowdetect.functions import expr as x
from flowdetect.operators import correlate, gates

log = logging.getLogger(__name__)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOPICS = ("conn", "dns", "ssl", "quic", "pktseq")


def kafka_source(spark: SparkSession, servers: str, topics: tuple[str, ...] = TOPICS, schema: str = "ts double, uid string") -> DataFrame:
    d = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "latest").load()
    return decoded(d, schema)


def decoded(records: DataFrame, schema: str) -> DataFrame:
    """Records of a topic (topic, value) as rows; values that are no JSON of the
    schema are skipped."""
    d = records.select("topic", F.from_json(F.col("value").cast("string"), schema).alias("v"))
    return d.where("v IS NOT NULL").select("topic", "v.*")


def routed(records: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Rows of each topic (topic, value), by the topic's own schema; a topic is
    the ``log_type`` of its rows. Topics without a schema are skipped."""
    return {t: decoded(records.where(F.col("topic") == t), schema).withColumnRenamed("topic", "log_type") for t, schema in schemas.items()}


def file_source(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    """New files of a directory; logs are rotated into it."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def kafka_rows(events: DataFrame, key: str = "src_ip") -> DataFrame:
    """key and value of what a Kafka sink publishes."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str):
    return kafka_rows(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def with_time(d: DataFrame, name: str = "event_time") -> DataFrame:
    return d.withColumn(name, F.timestamp_micros("ts_us"))


def enrich_stream(tls: DataFrame, conn: DataFrame, pktseq: DataFrame | None = None, seconds: int = 30) -> DataFrame:
    """Sessions left-joined with connections and packets that come within
    ``seconds`` either way; unmatched ones follow once the watermark passes."""
    near = f"interval {seconds} seconds"
    t = with_time(tls).withWatermark("event_time", near)
    c = with_time(conn, "ct").withWatermark("ct", near).select(F.col("uid").alias("cuid"), "ct", "orig_bytes", "resp_bytes", "duration")
    d = t.join(c, F.expr(f"uid = cuid AND ct BETWEEN event_time - {near} AND event_time + {near}"), "leftOuter").drop("ct", "cuid")
    if pktseq is not None:
        p = with_time(pktseq, "pt").withWatermark("pt", near).select(F.col("uid").alias("puid"), "pt", "sizes", "gaps")
        d = d.join(p, F.expr(f"uid = puid AND pt BETWEEN event_time - {near} AND event_time + {near}"), "leftOuter").drop("pt", "puid")
    return d.fillna({"orig_bytes": 0, "resp_bytes": 0, "duration": 0.0})


class Expiring(StatefulProcessor):
    """A key's state that says nothing of rows ``seconds`` or more after the
    key's latest. With ``timed`` it goes once the watermark is that far; rows
    behind the watermark are dropped before they get here."""

    def __init__(self, seconds: int | None, timed: bool):
        self.seconds, self.timed = seconds, timed and seconds is not None

    def remind(self, last: int) -> None:
        if self.timed:
            self.handle.registerTimer(-(-(last + self.seconds * 1_000_000) // 1000))

    def latest(self) -> int | None:
        """Time of the key's latest row, None where there is no state."""
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.latest()
        if last is not None and last + self.seconds * 1_000_000 <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.clear()
        return iter([])

    def close(self) -> None:
        pass


class Cooldown(Expiring):
    """Keeps a row iff it is ``seconds`` after the last kept one of its key;
    with None only the first row of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def latest(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None

    def clear(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows).sort_values(["ts_us", "event_id"])
        last = self.latest()
        keep = []
        for t in d["ts_us"]:
            ok = last is None or (self.seconds is not None and t - last >= self.seconds * 1_000_000)
            keep.append(ok)
            last = t if ok else last
        self.last.update((last,))
        self.remind(last)
        yield d[keep].drop(columns=_TIME, errors="ignore")


class Trailing(Expiring):
    """Rows of a key with the values of the last ``seconds`` (or ``rows``)."""

    def __init__(self, seconds: int | None, rows: int | None, value: str, timed: bool = False):
        super().__init__(seconds, timed)
        self.rows, self.value = rows, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, v long")

    def latest(self) -> int | None:
        return max(h[0] for h in self.held.get()) if self.held.exists() else None

    def clear(self) -> None:
        self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows).sort_values(["ts_us", "event_id"])
        held = sorted(tuple(h) for h in self.held.get()) if self.held.exists() else []
        count = Counter(v for _, v in held)
        out = []
        for t, v in zip(d["ts_us"].tolist(), d[self.value].tolist()):
            heapq.heappush(held, (int(t), int(v)))  # sorted, hence a heap: late rows find their place
            count[int(v)] += 1
            while (self.seconds is not None and held[0][0] < t - self.seconds * 1_000_000) or (self.rows is not None and len(held) > self.rows):
                gone = heapq.heappop(held)[1]
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
            out.append(self.row(held, count))
        self.held.put(held)
        self.remind(max(held)[0] if held else int(d["ts_us"].iloc[-1]))
        yield pd.DataFrame(out, columns=self.columns, dtype=object).assign(event_id=d["event_id"].to_numpy())[["event_id", *self.columns]]

    columns = ("n", "distinct")

    def row(self, held: list, count: Counter) -> tuple:
        return len(held), len(count)


class Beacon(Trailing):
    """Adds the mean and the population deviation of the gaps between the held
    rows, in seconds, and their ratio (none below two rows, infinite at mean 0).
    Held are the last ``rows``; a batch's rows in order of time are measured all
    at once, after late ones one by one."""

    columns = ("n", "distinct", "mean_interval", "std_interval", "cv")

    def row(self, held: list, count: Counter) -> tuple:
        gaps = np.diff(sorted(h[0] for h in held)) / 1e6
        if not len(gaps):
            return len(held), len(count), 0.0, 0.0, None
        mean, std = float(gaps.mean()), float(gaps.std())
        return len(held), len(count), mean, std, std / mean if mean else float("inf")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows)
        held = np.array(sorted(tuple(h) for h in self.held.get()) if self.held.exists() else [], np.int64).reshape(-1, 2)
        new = d[["ts_us", self.value]].to_numpy(np.int64)
        order = np.lexsort((d["event_id"].to_numpy(), new[:, 0]))
        new, k = new[order], len(held)
        if self.seconds is not None or (k and tuple(new[0]) < tuple(held[-1])):  # late
            yield from super().handleInputRows(key, iter([d]), timer)
            return
        both = np.concatenate([held, new])
        end = np.arange(k + 1, len(both) + 1)
        begin = np.maximum(end - self.rows, 0)
        out = {"n": end - begin, "distinct": _distinct(both[:, 1], begin, end), **_gaps(both[:, 0], begin, end)}
        self.held.put([tuple(h) for h in both[-self.rows :].tolist()])
        yield pd.DataFrame({"event_id": d["event_id"].to_numpy()[order], **out})


CALLS = 256  # buckets of channels


class Channels(StatefulProcessor):
    """The values of :class:`Beacon` for the channels (``channel``) of a bucket. A call
    costs more than a few rows and most channels have few in a batch, so all of a
    bucket's are measured at once; its state is a table of each one's last rows."""

    def __init__(self, rows: int):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows)[["channel", "ts_us", "event_id"]].assign(new=True)
        if self.held.exists():
            d = pd.concat([pa.ipc.open_stream(self.held.get()[0]).read_pandas().assign(new=False), d])
        code = pd.factorize(d["channel"])[0]
        order = np.lexsort((d["event_id"].to_numpy(), d["ts_us"].to_numpy(), code))
        d, code = d.iloc[order].reset_index(drop=True), code[order]
        t, e, new = d["ts_us"].to_numpy(np.int64), d["event_id"].to_numpy(np.int64), d["new"].to_numpy(bool)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        begin = np.maximum(np.repeat(first, np.diff(np.append(first, len(d)))), np.arange(len(d)) + 1 - self.rows)
        late = np.unique(code[1:][new[:-1] & ~new[1:] & (code[1:] == code[:-1])])
        at = np.flatnonzero(new & ~np.isin(code, late))
        if len(at):
            yield pd.DataFrame({"event_id": e[at], "n": at + 1 - begin[at], "distinct": _distinct(e, begin[at], at + 1), **_gaps(t, begin[at], at + 1)})
        for c in late:  # held rows that come after new ones
            here = code == c
            yield self.one_by_one(list(zip(t[here & ~new].tolist(), e[here & ~new].tolist())), list(zip(t[here & new].tolist(), e[here & new].tolist())))
        last = np.append(first[1:], len(d))[np.searchsorted(first, np.arange(len(d)), "right") - 1] - np.arange(len(d)) <= self.rows
        table = pa.Table.from_pandas(d.loc[last, ["channel", "ts_us", "event_id"]], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))

    def one_by_one(self, held: list, news: list) -> pd.DataFrame:
        out = []
        for t, e in news:
            heapq.heappush(held, (t, e))  # sorted, hence a heap
            if len(held) > self.rows:
                heapq.heappop(held)
            frame = sorted(held)
            v = _gaps(np.array([h[0] for h in frame]), np.array([0]), np.array([len(frame)]))
            out.append((e, len(frame), len({h[1] for h in frame}), *(x[0] for x in v.values())))
        return pd.DataFrame(out, columns=["event_id", *Beacon.columns])


def _distinct(v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many values v[begin:end] has, of frames that end at each of the last
    rows: those of its rows whose next equal one is not in it."""
    order = np.argsort(v, kind="stable")
    same = v[order][1:] == v[order][:-1]
    if not same.any():
        return end - begin
    after = np.full(len(v), len(v))
    after[order[:-1][same]] = order[1:][same]
    n = np.zeros(len(end), np.int64)
    for back in range(1, int((end - begin).max()) + 1):
        at = end - back
        n += (at >= begin) & (after[np.maximum(at, 0)] >= end)
    return n


def _gaps(t: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, deviation and their ratio of the gaps within t[begin:end], by number
    of gaps: frames of equal length are the rows of one matrix."""
    gaps, k = np.diff(t) / 1e6, end - begin - 1
    mean, std, cv = np.zeros(len(k)), np.zeros(len(k)), np.full(len(k), np.nan)
    for n in np.unique(k[k > 0]).tolist():
        here = k == n
        g = np.lib.stride_tricks.sliding_window_view(gaps, n)[begin[here]]
        m, s = g.mean(axis=1), g.std(axis=1)
        mean[here], std[here] = m, s
        cv[here] = np.divide(s, m, out=np.full(len(m), np.inf), where=m != 0)
    return {"mean_interval": mean, "std_interval": std, "cv": pd.Series(cv).astype(object).where(k > 0, None)}


_TIME = "_event_time"


def _keyed(d: DataFrame, keys: list[str], processor: StatefulProcessor, schema, delay: str | None = None) -> DataFrame:
    """With ``delay`` rows may come that much late, later ones are dropped, and
    states that have run out go; without it all rows count, states stay."""
    if delay is None:
        return d.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "none")
    return with_time(d, _TIME).withWatermark(_TIME, delay).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def cooldown(candidates: DataFrame, keys: list[str], seconds: int, delay: str | None = None) -> DataFrame:
    return _keyed(candidates, keys, Cooldown(seconds, delay is not None), candidates.schema, delay)


def once(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first candidate of each key that arrives; a key is never forgotten."""
    return _keyed(candidates, keys, Cooldown(None, False), candidates.schema)


def scan_state(flows: DataFrame, seconds: int = 60, delay: str | None = None) -> DataFrame:
    """event_id, n and distinct ports of the source's last seconds."""
    return _keyed(flows, ["src_ip"], Trailing(seconds, None, "dst_port", delay is not None), "event_id long, n long, distinct long", delay)


def beacon_state(flows: DataFrame, rows: int = 20) -> DataFrame:
    """event_id, n, distinct, mean_interval, std_interval and cv of the last rows
    of source, destination and port."""
    schema = "event_id long, n long, distinct long, mean_interval double, std_interval double, cv double"
    d = flows.select(F.to_json(F.struct("src_ip", "dst_ip", "dst_port")).alias("channel"), "ts_us", "event_id").withColumn("bucket", F.expr(f"pmod(xxhash64(channel), {CALLS})"))
    return _keyed(d, ["bucket"], Channels(rows), schema)


class Baseline(StatefulProcessor):
    """Running mean gap of a class of alerts: one number of state for each
    class, so gaps of any length count."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "t long, m double, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows).sort_values(["ts_us", "seq"])
        last, m, n = self.held.get() if self.held.exists() else (None, None, 0)
        gaps, counts = [], []
        for t in d["ts_us"].tolist():
            if last is not None and t > last:
                gap = (t - last) / 1e6
                m, n = gap if m is None else self.alpha * gap + (1 - self.alpha) * m, n + 1
            last = t if last is None else max(last, t)
            gaps.append(m)
            counts.append(n)
        self.held.update((last, m, n))
        yield pd.DataFrame({"seq": d["seq"], "class_gap": pd.array(gaps, dtype="Float64").astype(object), "class_n": counts})

    def close(self) -> None:
        pass


class Correlate(Expiring):
    """A source's alerts of the last 900 s and the last firing of each pattern;
    an alert fires the first pattern that it completes and that is news. A
    firing counts for 900 s and a moment, hence 901."""

    def __init__(self, timed: bool = False):
        super().__init__(901, timed)

    def latest(self) -> int | None:
        return max(h[0] for h in self.held.get()) if self.held.exists() else None

    def clear(self) -> None:
        self.held.clear()
        self.fired.clear()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, id string, kind string")
        self.fired = handle.getMapState("fired", "pattern string", "t long, ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        d = pd.concat(rows).sort_values(["ts_us", "seq"])
        held = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        fired = {k[0]: (v[0], frozenset(v[1])) for k, v in self.fired.iterator()}
        times, out = d["ts_us"].tolist(), []
        news_of = list(zip(times, d["id"].tolist(), d["threat_class"].tolist()))
        first = next((i for i, h in enumerate(held) if h[0] == times[0]), len(held))
        late = held[first:]  # of the first new instant; they stand in its frames like its own rows
        spans, to = [deque() for _ in correlate.PATTERNS], 0

        def enter(these: list) -> None:
            for span, pattern in zip(spans, correlate.PATTERNS):
                span.extend(h for h in these if h[2] in pattern[1])

        enter(held[:first])
        for i, (t, _, _) in enumerate(news_of):
            if i == to:  # rows of equal time are in each other's frames
                while to < len(news_of) and news_of[to][0] == t:
                    to += 1
                enter((late if i == 0 else []) + news_of[i:to])
            tries = []
            for span, (name, classes, seconds, confidence, _) in zip(spans, correlate.PATTERNS):
                since = t - seconds * 1_000_000
                while span and span[0][0] <= since:  # nor does a later row reach it
                    span.popleft()
                inside = [h for h in span if h[0] > since]
                if {h[2] for h in inside} == set(classes):
                    tries.append((name, confidence, [h[1] for h in inside]))
            for k in gates.news([t] * len(tries), [i] * len(tries), [x[0] for x in tries], [x[2] for x in tries], 900, fired):
                out.append((int(d["seq"].iloc[i]), key[0], tries[k][0], tries[k][1]))
        last = times[-1]
        self.held.put([h for h in held + news_of if h[0] > last - 900_000_000])
        for k, (t, ids) in fired.items():
            self.fired.updateValue((k,), (int(t), sorted(ids)))
        self.remind(last)
        yield pd.DataFrame(out, columns=["seq", "src_ip", "pattern", "confidence"])


def rate_baseline(alerts: DataFrame, alpha: float = 0.2) -> DataFrame:
    """seq, class_gap, class_n after every alert."""
    return _keyed(correlate.usable(alerts), ["threat_class"], Baseline(alpha), "seq long, class_gap double, class_n int")


def correlated(alerts: DataFrame, delay: str | None = None) -> DataFrame:
    """Pattern incidents: seq, src_ip, pattern, confidence."""
    d = correlate.usable(alerts).select("seq", "ts_us", "src_ip", "threat_class", F.expr(correlate.identity()).alias("id"))
    return _keyed(d, ["src_ip"], Correlate(delay is not None), "seq long, src_ip string, pattern string, confidence double", delay)


def flood_state(flows: DataFrame) -> DataFrame:
    """The seven flood features of sliding 10 s windows every second: a grid in
    place of the frame at every event; for that run the batch operator in
    ``exact``."""
    d = with_time(flows).withWatermark("event_time", "30 seconds")
    d = d.groupBy(F.window("event_time", "10 seconds", "1 second")).agg(F.collect_list("dst_port").alias("ports"), F.collect_list("src_ip").alias("ips"), F.collect_list("ts_us").alias("times"))
    d = d.withColumn("i", F.expr(x.interval_stats("times")))
    return d.selectExpr(
        "window", "cast(size(times) AS bigint) AS packet_rate", "size(array_distinct(ports)) AS unique_dst_ports", f"round({x.entropy('ports')}, 4) AS dst_port_entropy",
        "round(i.mean, 4) AS mean_iat", "round(i.std, 4) AS std_iat", "size(array_distinct(ips)) AS unique_src_ips", f"round({x.entropy('ips')}, 4) AS src_ip_entropy",
    )


def throughput(flows: DataFrame) -> DataFrame:
    """Rows a second over the last 10 s, every second."""
    d = with_time(flows).withWatermark("event_time", "30 seconds")
    return d.groupBy(F.window("event_time", "10 seconds", "1 second")).agg((F.count("*") / 10.0).alias("rate"))


def running_stats(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_class").count()


def alert_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def exact(source: DataFrame, operator: Callable[[DataFrame], DataFrame], seconds: int, sink: str, carry: str, checkpoint: str):
    """Runs a batch operator with a trailing frame over every micro-batch and
    the ``seconds`` before it; results of new rows only, told by a mark, as the
    operator keeps the columns of its rows. Results and carried rows stand under
    the batch's id, so a repeated batch overwrites itself; each batch carries on
    what may still be in a frame, and older folders go."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min("ts_us")).first()[0]
        if first is None:  # Spark gives no empty batch to this sink without a watermark
            return
        since = first - seconds * 1_000_000
        held = spark.read.schema(batch.schema).parquet(f"{carry}/batch={batch_id - 1}") if batch_id else batch.limit(0)
        old = held.where(F.col("ts_us") >= since).join(batch.select("event_id"), "event_id", "left_anti")
        out = operator(old.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))).where("_new").drop("_new")
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unionByName(old).write.mode("overwrite").parquet(f"{carry}/batch={batch_id}")
        _forget(spark, carry, batch_id - 1)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correlate_stream(source: DataFrame, sink: str, state: str, checkpoint: str, trigger: dict | None = None, baseline: bool = True):
    """Incidents of both correlation layers and, if ``baseline``, the running mean
    gaps of each alert's class and of all, of a stream of alerts that come in
    order of time.

    Two states are handed from batch to batch: the baseline (a row for each class
    and one for the tempo of all alerts) and, of the last 900 s, the alerts that
    windows still reach with the last firings. A batch runs the batch operators
    from there, so its work is spread like theirs. Results stand under the batch's
    id in ``sink``/incidents and ``sink``/baseline, states in ``state``; a repeated
    batch overwrites itself, and states before the last go."""
    tempo = "key string, last_us long, m double, n int"
    fired = "src_ip string, pattern string, ts_us long, ids array<string>"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            last = batch.agg(F.max("ts_us")).first()[0]
            if last is None:
                return
            before = f"{state}/batch={batch_id - 1}"
            old = lambda name, schema: spark.read.schema(schema).parquet(f"{before}/{name}") if batch_id else spark.createDataFrame([], schema)
            start, held, news = old("tempo", tempo), old("held", batch.schema), old("fired", fired)
            incidents = correlate.correlate(batch, start, held, news).persist()
            try:
                incidents.write.mode("overwrite").parquet(f"{sink}/incidents/batch={batch_id}")
                if baseline:
                    correlate.rate_baseline(batch, start=start).write.mode("overwrite").parquet(f"{sink}/baseline/batch={batch_id}")
                now = f"{state}/batch={batch_id}"
                recent = F.col("ts_us") > last - 901_000_000
                correlate.tempo(batch, start=start).write.mode("overwrite").parquet(f"{now}/tempo")
                held.unionByName(batch).where(recent).write.mode("overwrite").parquet(f"{now}/held")
                correlate.last_fired(incidents, news).where(recent).write.mode("overwrite").parquet(f"{now}/fired")
            finally:
                incidents.unpersist()
            _forget(spark, state, batch_id - 1)
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _forget(spark: SparkSession, path: str, first: int) -> None:
    """Deletes the folders of batches before ``first``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < first:
            files.delete(folder.getPath(), True)


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, export: Callable[[DataFrame, str], None] | None = None, trigger: dict | None = None):
    """Canonical Parquet first, then a best-effort export: one that fails is
    logged and the stream goes on. Each batch has a folder of its own, so a
    repeated batch overwrites itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
            if export is not None:
                try:
                    export(batch, f"{path}/export/batch={batch_id}")
                except Exception:
                    log.warning("export of batch %s failed", batch_id, exc_info=True)
        finally:
            batch.unpersist()

    return alerts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()
