"""Keyed state: price, stock, page and once-per-hour alerts.

Each processor keeps a few values per key. The state lives in RocksDB and comes back from
the checkpoint after a failure. Unless stated, a key keeps its last values for good.
Rows of one key are taken in event-time order within a batch; :func:`late_price_alerts`
keeps that order across batches. The rules repeat the batch
operators of :mod:`hostloom.operators.change`; the tests compare both on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class PriceWatch(StatefulProcessor):
    """Price drops and restocks of one item, against the observation before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price_eur double, available boolean", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["observed_at", "observation_id", "price_eur", "available"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        before = pd.Series([known[0] if known else None, *seen["price_eur"].tolist()[:-1]], index=seen.index, dtype="float64")
        stocked = [known[1] if known else None, *seen["available"].tolist()[:-1]]
        sold_out = pd.Series([s is not None and not s for s in stocked], index=seen.index)
        drop = (seen["price_eur"] < before - 0.01) & seen["available"]
        restock = sold_out & seen["available"]
        self.last.update((float(seen["price_eur"].iloc[-1]), bool(seen["available"].iloc[-1])))
        out = []
        for kind, mask in (("price_drop", drop), ("back_in_stock", restock)):
            hit = seen[mask]
            if len(hit):
                out.append(
                    pd.DataFrame(
                        {"url": key[0], "kind": kind, "observation_id": hit["observation_id"], "previous_price_eur": before[mask], "price_eur": hit["price_eur"]}
                    )
                )
        if out:
            yield pd.concat(out)

    def close(self) -> None:
        pass


def price_alerts(observations: DataFrame) -> DataFrame:
    """Stream of price drops and restocks from a stream of observations."""
    return observations.groupBy("url").transformWithStateInPandas(
        statefulProcessor=PriceWatch(),
        outputStructType="url string, kind string, observation_id bigint, previous_price_eur double, price_eur double",
        outputMode="Update",
        timeMode="None",
    )


class PatientPriceWatch(StatefulProcessor):
    """:class:`PriceWatch` for rows that come late: an observation waits until the watermark has passed it.

    Waiting rows lie in a list; a timer a millisecond behind each calls for all rows up to it,
    which are then judged in time order. So an older price that comes after a newer one
    neither overwrites it nor raises a false alarm. State: the rows within the watermark's
    delay, and one price per item, forgotten ``lifetime_ms`` after its observation.
    """

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price_eur double, available boolean, at_ms bigint")
        self.waiting = handle.getListState("waiting", "at_us bigint, observation_id bigint, price_eur double, available boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["observed_at"].astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(at, part["observation_id"].tolist(), part["price_eur"].tolist(), part["available"].tolist(), strict=True)))
            for ms in {t // 1000 + 1 for t in at}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(r for r in waiting if r[0] < now * 1000)
        state = self.last.get() if self.last.exists() else None
        out = []
        for at, number, price, available in due:
            if state is not None and available:
                if price < state[0] - 0.01:
                    out.append((key[0], "price_drop", number, state[0], price))
                if not state[1]:
                    out.append((key[0], "back_in_stock", number, state[0], price))
            state = (price, bool(available), at // 1000)
        if due:
            left = [r for r in waiting if r[0] >= now * 1000]
            self.waiting.put(left) if left else self.waiting.clear()
            self.last.update(state)
            self.handle.registerTimer(state[2] + self.lifetime_ms)
        elif state is not None and state[2] + self.lifetime_ms <= now:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["url", "kind", "observation_id", "previous_price_eur", "price_eur"])

    def close(self) -> None:
        pass


def late_price_alerts(observations: DataFrame, delay: str = "1 day", lifetime_days: int = 400) -> DataFrame:
    """Price drops and restocks from observations that may come up to ``delay`` late, each told when the watermark has passed it.

    The result is that of the batch rules over the rows the watermark has passed, in whatever
    order they came. Rows later than ``delay`` are left out. An item that is not seen for
    ``lifetime_days`` starts anew.
    """
    return (
        observations.withWatermark("observed_at", delay)
        .groupBy("url")
        .transformWithStateInPandas(
            statefulProcessor=PatientPriceWatch(lifetime_days * 86_400_000),
            outputStructType="url string, kind string, observation_id bigint, previous_price_eur double, price_eur double",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class PageWatch(StatefulProcessor):
    """Change, appearance or disappearance on one watched page."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "text_hash string, seen boolean, alerted boolean", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reads = pd.concat(list(rows)).sort_values("checked_at", kind="stable")
        state = self.last.get() if self.last.exists() else None
        alerts = []
        for read in reads.itertuples(index=False):
            happened = state is not None and {
                "change": state[0] != read.text_hash,
                "appears": bool(read.seen) and not state[1],
                "disappears": not read.seen and bool(state[1]),
            }[read.watch_for]
            alerted = bool(state[2]) if state is not None else False
            if happened and (read.watch_for == "change" or not alerted):
                alerts.append((key[0], read.watch_for, read.checked_at))
            state = (read.text_hash, bool(read.seen), alerted or bool(happened))
        self.last.update(state)
        if alerts:
            yield pd.DataFrame(alerts, columns=["id", "watch_for", "checked_at"])

    def close(self) -> None:
        pass


def page_alerts(reads: DataFrame) -> DataFrame:
    """Stream of page alerts from reads (id, watch_for, text_hash, seen, checked_at).

    Hash and phrase test are Spark columns of the reads, see ``change.check_pages``.
    """
    return reads.groupBy("id").transformWithStateInPandas(
        statefulProcessor=PageWatch(), outputStructType="id bigint, watch_for string, checked_at timestamp", outputMode="Update", timeMode="None"
    )


class HourlyAlert(StatefulProcessor):
    """First seen occurrence of a problem in each clock hour, told at once.

    The hours told are kept for ``KEPT_HOURS`` behind the newest, so an earlier hour that
    comes after a later one is told as well; what comes later than that is left out.
    """

    KEPT_HOURS = 48

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "hour timestamp", "first_at timestamp", ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first: dict[pd.Timestamp, pd.Timestamp] = {}
        for part in rows:  # one row an hour stays of each part, however many a hot key has
            for hour, at in part["at"].groupby(part["at"].dt.floor("h")).min().items():
                first[hour] = min(at, first.get(hour, at))
        known = [pd.Timestamp(k[0]) for k, _ in self.told.iterator()]
        kept = pd.Timedelta(hours=self.KEPT_HOURS)
        new = sorted((hour, at) for hour, at in first.items() if hour not in known and (not known or hour >= max(known) - kept))
        oldest = max([*known, *first]) - kept
        for hour in known:
            if hour < oldest:
                self.told.removeKey((hour.to_pydatetime(),))
        for hour, at in new:
            if hour >= oldest:
                self.told.updateValue((hour.to_pydatetime(),), (at.to_pydatetime(),))
        if new:
            yield pd.DataFrame({"key": key[0], "hour": [h for h, _ in new], "first_at": [a for _, a in new]})

    def close(self) -> None:
        pass


def immediate_alerts(problems: DataFrame) -> DataFrame:
    """Stream of (key, at) problems to one alert per key and clock hour."""
    return problems.groupBy("key").transformWithStateInPandas(
        statefulProcessor=HourlyAlert(), outputStructType="key string, hour timestamp, first_at timestamp", outputMode="Update", timeMode="None"
    )
