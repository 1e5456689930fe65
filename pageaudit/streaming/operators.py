"""Streaming forms of the stateful behaviours.

All of them are built-in event-time aggregates and joins: state is bounded by
the watermark, partial aggregation happens before the shuffle, and the same
functions run on batch tables. No Python state is kept.

A stream that comes to an end says so by an end marker (``with_end``): a row without keys, later than all
others, that moves the watermark past the last event. Everything still open is then emitted, so a stream that has
ended gives what the same function gives on the whole table.
"""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import contains_any
from pageaudit.operators.element_rules import detect_all, may_raise, with_page_text
from pageaudit.operators.journey import fold_transitions
from pageaudit.operators.structure import RULE_PARTS, parse_pages


def _marked(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


END = datetime.datetime(9999, 1, 1)


def write_end_marker(spark, folder: str, ts: str = "ts") -> str:
    """Writes the marker that ends a stream: one row with nothing but its time. Rows that come after it are late."""
    spark.createDataFrame([(END,)], f"{ts} timestamp").write.mode("overwrite").parquet(folder)
    return folder


def with_end(events: DataFrame, folder: str, ts: str = "ts", **keys) -> DataFrame:
    """``events`` and the marker found in ``folder``; while there is none the stream goes on.

    Both have one watermark, that of the union, so the marker must not be written before the last event. Its own group stays open
    for ever. ``keys``: values of the marker's columns, which no event has; the key of a join must be given, because rows with
    a null key are dropped before the watermark sees them.
    """
    marker = events.sparkSession.readStream.schema(f"{ts} timestamp").parquet(folder)
    marker = marker.withColumns({k: F.lit(v).cast(events.schema[k].dataType) for k, v in keys.items()}) if keys else marker
    return events.unionByName(marker, allowMissingColumns=True)


def burst_inspections(mutations: DataFrame, watermark="10 minutes") -> DataFrame:
    """One inspection per burst of page changes that ends with a quiet gap and touched something meaningful.

    Needs session_id, ts, tag, class_name.
    """
    meaningful = (F.lower("tag") == "dialog") | contains_any(F.lower("class_name"), X.MEANINGFUL_CLASSES)
    return (
        _marked(mutations, "ts", watermark)
        .groupBy("session_id", F.session_window("ts", X.DEBOUNCE))
        .agg(F.count("*").alias("n_mutations"), F.bool_or(meaningful).alias("meaningful"))
        .where("meaningful")
        .select("session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("due"), "n_mutations")
    )


def track_prices(snapshots: DataFrame, gap="30 minutes", watermark="10 minutes") -> DataFrame:
    """Price rise above 20 between the first and the latest snapshot of a visit.

    A visit ends after ``gap`` without a snapshot. Needs session_id, ts, seq, highest_price.
    """
    at = F.struct("ts", "seq")
    g = (
        _marked(snapshots, "ts", watermark)
        .groupBy("session_id", F.session_window("ts", gap).alias("visit"))
        .agg(F.count("*").alias("n"), F.min_by("highest_price", at).alias("first_price"), F.max_by("highest_price", at).alias("latest_price"))
    )
    d = F.col("latest_price") - F.col("first_price")
    return g.where((F.col("n") >= 2) & (F.col("first_price") > 0) & (F.col("latest_price") > 0) & (d > 20)).select(
        "session_id", F.col("visit.start").alias("started"), F.col("visit.end").alias("ended"), "first_price", "latest_price",
        d.alias("delta"), F.least(F.lit(0.95), 0.75 + d / 1000).alias("confidence"),
        F.when(d > 150, "high").otherwise("medium").alias("severity"),
    )


def track_journeys(transitions: DataFrame, gap="60 days", watermark="10 minutes") -> DataFrame:
    """Purchase state machine per scan. A scan's state is kept until ``gap`` without a transition (or the end marker).

    Needs the columns of the batch fold and ts.
    """
    return fold_transitions(
        _marked(transitions, "ts", watermark), F.session_window("ts", gap).alias("visit")
    )


def first_captures(responses: DataFrame, keep="60 days") -> DataFrame:
    """Responses with every address once per session; a session's addresses are remembered for ``keep`` of event time."""
    if responses.isStreaming:
        return responses.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["session_id", "url"])
    return responses.dropDuplicates(["session_id", "url"])


def capped_sessions(captures: DataFrame, span: str | None = None, limit: int | None = None) -> DataFrame:
    """Number of captures per session (and ``span`` of time), the number kept and whether the cap was reached; without ``limit`` all are kept."""
    n, keys = F.count("*"), ["session_id"] + ([F.window("ts", span)] if span else [])
    counted = captures.groupBy(*keys).agg(n.alias("n"))
    kept = F.col("n") if limit is None else F.least(F.col("n"), F.lit(limit))
    full = F.lit(False) if limit is None else F.col("n") >= limit
    return counted.select("session_id", *([F.col("window.start").alias("from_ts")] if span else []), kept.alias("kept"), full.alias("full"))


def tab_results(events: DataFrame, gap="60 days", watermark="10 minutes") -> DataFrame:
    """Latest result of a tab, cleared by a later navigation; a tab is forgotten after ``gap`` without an event. Needs tab_id, ts, seq, kind, result."""
    at = F.struct("ts", "seq")
    is_result, is_nav = F.col("kind") == "result", F.col("kind") == "navigate"
    g = _marked(events, "ts", watermark).groupBy("tab_id", F.session_window("ts", gap).alias("visit")).agg(
        F.max(F.when(is_result, at)).alias("result_at"), F.max(F.when(is_nav, at)).alias("nav_at"),
        F.max_by(F.when(is_result, F.col("result")), F.when(is_result, at)).alias("result"),
    )
    holds = F.col("result_at").isNotNull() & (F.col("nav_at").isNull() | (F.col("result_at") > F.col("nav_at")))
    return g.select(
        "tab_id", F.col("visit.start").alias("started"), F.when(holds, "done").otherwise("idle").alias("status"),
        F.when(holds, F.col("result")).alias("result"),
    )


def windowed_findings(findings: DataFrame, length="1 hour", slide="15 minutes", watermark="1 hour") -> DataFrame:
    """Findings per host and pattern in sliding windows; later rows than the watermark are dropped. Needs ts."""
    return (
        _marked(findings, "ts", watermark)
        .groupBy(F.window("ts", length, slide), "host", "pattern")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "host", "pattern", "n")
    )


def with_second_level(first: DataFrame, second: DataFrame, watermark="10 minutes") -> DataFrame:
    """First-level results with their second-level result, if that came within six seconds.

    ``first``: page_id, ts, local_count. ``second``: page_id, ts, deep_count.
    """
    a = _marked(first, "ts", watermark).alias("a")
    b = _marked(second.withColumnRenamed("ts", "done_at").withColumnRenamed("page_id", "done_id"), "done_at", watermark).alias("b")
    inside = F.expr(f"done_id = page_id AND done_at >= ts AND done_at <= ts + interval {X.SECOND_LEVEL_TIMEOUT}")
    j = a.join(b, inside, "left")
    return j.select(
        "page_id", "ts", F.when(F.col("done_id").isNotNull(), "second").otherwise("first").alias("level"),
        F.coalesce("deep_count", "local_count").alias("n_findings"),
    )


def tiered_audit(pages: DataFrame, out: str):
    """foreachBatch body of the tiered detection.

    Pages are parsed, a cheap test of the parsed text picks those worth the
    rules, and the rules run on those only. The test asks for less than the
    rules do, so no finding is lost. An epoch overwrites its own folder, so a
    repeated batch does no harm.
    """
    def body(batch: DataFrame, epoch: int):
        deep = with_page_text(parse_pages(batch, RULE_PARTS)).where(may_raise())
        detect_all(deep).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return body


def run_to_end(stream: DataFrame, folder: str, mode="append") -> str:
    """Runs a stream over what is available now into parquet; returns the output folder."""
    out = f"{folder}/out"
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out
