"""Incremental and streaming forms (STM1 to STM4).  Each equals its batch form on the same rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.functions.scalars import tracker_band
from rangeflow.functions.text import record_key
from rangeflow.operators.joins import rank_at
from rangeflow.operators.windows import retraction_state


def new_finds(occurrences: DataFrame, since: str, done: DataFrame) -> DataFrame:
    """STM1: rows first validated on or after a day that the ledger does not hold."""
    rows = occurrences.withColumn("record", record_key("source", "observation_id")).where(F.col("first_green_on").cast("date") >= F.lit(since).cast("date"))
    return rows.join(done.select("record").distinct(), "record", "left_anti")


def score_finds(finds: DataFrame, ranked: DataFrame, trained: DataFrame, nearest_km: str = "km") -> DataFrame:
    """STM1: finds with rank and place on their taxon's map and a status; a record that the map was trained on is a leak, not a find.

    finds: record, taxon, cell (and a distance); ranked: taxon, cell, rank, inside; trained: taxon, record.
    """
    leak = trained.select("taxon", "record").distinct().withColumn("_leak", F.lit(True))
    mapped = ranked.select("taxon").distinct().withColumn("_map", F.lit(True))
    out = rank_at(finds, ranked, ["taxon", "cell"]).join(leak, ["taxon", "record"], "left").join(mapped, "taxon", "left")
    status = F.when(F.col("_leak"), "trained on").when(F.col("_map").isNull(), "no map").when(F.col("rank").isNull(), F.col("place")).otherwise("ranked")
    out = out.withColumn("status", status).drop("_leak", "_map")
    return out.withColumn("band", tracker_band(nearest_km)) if nearest_km in out.columns else out


def watch_finds(spark: SparkSession, folder: str, schema: T.StructType, delay: str = "7 days", at: str = "updated_at") -> DataFrame:
    """STM1: a landing folder as a stream of records, each once within the watermark."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("_at", F.col(at).cast("timestamp"))
    return rows.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["record"])


def stream_scores(finds: DataFrame, ranked: DataFrame, trained: DataFrame, ledger: str, checkpoint: str):
    """STM1: scores a stream of finds against static maps and appends them to the ledger, each micro-batch once (by its number)."""

    def append(batch: DataFrame, number: int) -> None:
        score_finds(batch, ranked, trained).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{ledger}/batch_id={number}")

    return finds.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retract(ledger: DataFrame, occurrences: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """STM2: (the ledger with its rows' state, records to score again because they moved or came back)."""
    state = retraction_state(ledger, occurrences, today)
    back = state.where("reason is null").join(ledger.where("retracted_on is not null").select("record"), "record", "left_semi")
    again = state.where("reason = 'moved'").select("record").unionByName(back.select("record"))
    return state, again


_KNOWN = ["record", "taxon", "cell", "since", "reason", "due"]
_NO_EVENTS = pd.DataFrame({"record": [], "kind": [], "taxon": [], "cell": [], "retracted_on": [], "at": pd.to_datetime([])})
#: A timer that is not set.
_NEVER = np.iinfo(np.int64).max


def _told(known: pd.DataFrame, events: pd.DataFrame, watermark_ms: int, grace_days: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(the listed records of a part after a batch of its events, those of them whose state is told).

    Events of a record go in the order of time; each round takes every record's next one, so all records go at once.
    """
    events = events.sort_values(["record", "at", "kind"], ignore_index=True)
    turn = events.groupby("record", sort=False, dropna=False).cumcount().to_numpy()
    fresh = pd.Index(events.loc[events["kind"] == "listed", "record"].unique()).difference(known["record"], sort=False)
    known = pd.concat([known, pd.DataFrame({c: fresh if c == "record" else None for c in _KNOWN}, columns=_KNOWN)], ignore_index=True) if len(fresh) else known
    taxon, cell, since, reason = (known[c].to_numpy(dtype=object, na_value=None).copy() for c in _KNOWN[1:5])
    due = known["due"].to_numpy(dtype=object, na_value=_NEVER).astype(np.int64)
    listed, told = np.arange(len(known)) < len(known) - len(fresh), np.zeros(len(known), dtype=bool)
    row = pd.Index(known["record"].infer_objects()).get_indexer(events["record"])
    ours = [events[c].to_numpy(dtype=object, na_value=None) for c in ("taxon", "cell", "retracted_on")]
    is_listed, at = (events["kind"] == "listed").to_numpy(), events["at"]
    day = at.dt.date.to_numpy()
    gone = (due < watermark_ms) & listed
    gone[row[row >= 0]] = False  # records with events are not timed out
    for k in range(turn.max(initial=-1) + 1):
        new = np.flatnonzero((turn == k) & (row >= 0) & is_listed)
        to = row[new]
        taxon[to], cell[to], since[to], listed[to], told[to] = ours[0][new], ours[1][new], ours[2][new], True, True
        seen = np.flatnonzero((turn == k) & (row >= 0) & ~is_listed)
        seen = seen[listed[row[seen]]]
        to = row[seen]
        renamed, moved = ours[0][seen] != taxon[to], ours[1][seen] != cell[to]
        reason[to] = np.where(renamed, "renamed", np.where(moved, "moved", None))
        first = np.where(pd.isna(since[to]), day[seen], since[to])
        since[to], told[to] = np.where(renamed | moved, first, None), True
    last = np.flatnonzero((row >= 0) & ~events["record"].duplicated(keep="last").to_numpy())
    ends = (at.to_numpy().astype("datetime64[ms]").astype(np.int64) + int(grace_days * 86_400_000))[last]
    due[row[last]] = np.maximum(ends, watermark_ms + 1)
    due[gone] = _NEVER
    newly = gone & (reason != "gone")
    since[newly] = np.where(pd.isna(since[newly]), datetime.fromtimestamp(watermark_ms / 1000, timezone.utc).date(), since[newly])
    reason[newly], told[newly] = "gone", True
    known = pd.DataFrame({"record": known["record"], "taxon": taxon, "cell": cell, "since": since, "reason": reason, "due": due}, columns=_KNOWN)
    return known, known[told]


def watch_retractions(events: DataFrame, grace_days: float = 1.0, delay: str = "0 seconds", parts: int = 4096) -> DataFrame:
    """STM2: the ledger's state as a stream: a row (record, reason, retracted_on) whenever a listed record's state is told or changes.

    events, a stream: record, kind, taxon, cell, retracted_on, at.  ``listed`` rows are ledger rows as they stood; ``seen`` rows are records of a pull.  A
    record that no pull shows within ``grace_days`` (event time) is gone, by a timer; one with another taxon is renamed, on another
    cell moved; one seen as it was listed is restored.  The first day of a retraction is kept while it lasts.

    Records are dealt to ``parts`` by a hash, and a part's records go through a batch at once; its state is their rows, its timer the
    first of theirs.  The number of parts stays the same for a checkpoint's life.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else pd.DataFrame(columns=_KNOWN)
        new = [] if state.hasTimedOut else list(batches)
        now = state.getCurrentWatermarkMs()
        known, told = _told(known, pd.concat(new, ignore_index=True) if new else _NO_EVENTS, now, grace_days)
        if len(known):
            state.update((pickle.dumps(known),))
            due = int(known["due"].min())
            if due != _NEVER:
                state.setTimeoutTimestamp(max(due, now + 1))
        if len(told):
            yield told[["record", "reason", "since"]].rename(columns={"since": "retracted_on"})

    rows = events.withWatermark("at", delay).withColumn("_part", F.pmod(F.xxhash64("record"), F.lit(parts)))
    out = f"record {dict(events.dtypes)['record']}, reason string, retracted_on date"
    return rows.groupBy("_part").applyInPandasWithState(step, out, "known binary", "update", "EventTimeTimeout")


def upsert(ledger: DataFrame, changed: DataFrame, key: str = "record") -> DataFrame:
    """STM2: rows replaced by key, others kept (the body of a foreachBatch sink)."""
    return ledger.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def changes_after(log: DataFrame, cursor: int, id_col: str = "id") -> DataFrame:
    """STM3: the log past a cursor."""
    return log.where(F.col(id_col) > cursor)


def watch_log(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """STM3: the same log as a stream; checkpointed offsets replace the cursor."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, at: str, by: str, every: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts by window and key, for a stream or a batch; late rows within the delay are counted."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("_at", delay) if rows.isStreaming else rows
    return rows.groupBy(F.window("_at", every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


def resumable(wanted: DataFrame, saved: DataFrame, settings: str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """STM4: (saved rows that still stand: same settings and not failed, what is left to do)."""
    keys = keys or ["taxon"]
    good = saved.where((F.col("settings") == settings) & (F.col("status") != "failed"))
    return good, wanted.join(good.select(*keys).distinct(), keys, "left_anti")


def remember_failures(known: DataFrame, rows: DataFrame) -> DataFrame:
    """STM4: failures by (taxon, algorithm, fingerprint, settings), old and new, each once."""
    key = ["taxon", "algorithm", "fingerprint", "settings"]
    return known.select(*key).unionByName(rows.where("status = 'failed'").select(*key)).distinct()
