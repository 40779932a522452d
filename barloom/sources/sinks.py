"""Sinks of results and signals."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, form: str = "csv") -> None:
    """The run table under a folder, named by the time of writing where path ends in a slash."""
    if path.endswith("/"):
        path = f"{path}results_{datetime.now(UTC):%Y%m%d_%H%M%S}"
    df.write.option("header", True).format(form).save(path)


def channel():
    return F.concat_ws("-", "identifier", "tokenPair", "interval")


def write_signals(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, **options: str):
    """Signals keyed by their channel, as JSON lines; another format and its options may be given (kafka).

    every: the interval of a polling trigger ("10 seconds"); without it what is there is worked off once.
    """
    form = options.pop("format", "json")
    rows = stream.select(channel().alias("key"), F.to_json(F.struct("identifier", "tokenPair", "interval", "timestamp", "action", "certainty")).alias("value"))
    return rows.writeStream.format(form).options(path=path, checkpointLocation=checkpoint, **options).trigger(**trigger(every)).start()


def trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def latest_signal(df: DataFrame) -> DataFrame:
    """The newest action of each pair."""
    return df.groupBy("tokenPair").agg(F.max_by("action", "timestamp").alias("action"), F.max("timestamp").alias("timestamp"))


def metrics_to_rows(df: DataFrame, values: str = "values") -> DataFrame:
    """label, value, timestamp and step, one row for each value of an array."""
    return df.select("label", F.posexplode(values).alias("step", "value"), "timestamp")
