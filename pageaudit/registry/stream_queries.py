"""Streaming queries: each runs its stream over the stored events to the end and reads what it wrote.

Every stream ends with a marker, so all results come out: the checking SQL reads the
whole tables without a cut.
"""

from pyspark.sql import functions as F

from pageaudit.operators import element_rules as ER
from pageaudit.registry.base import query, scratch
from pageaudit.registry.journey_queries import fold_sql
from pageaudit.registry.page_queries import PAGE_FINDINGS
from pageaudit.registry.views import EV_K, VIEWS
from pageaudit.sources.tables import table
from pageaudit.streaming import operators as W
from pageaudit import fixed as X


def stream(spark, sf, name):
    """A stored table as a stream; the file name is a pattern because a stream reads a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def stream_view(spark, sf, view_name, base):
    s = stream(spark, sf, base)
    if view_name == "v_html":  # as in ``view``: a few bytes per order become a page, and a file may be one task
        s = s.select("o_orderkey", "o_totalprice").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    out = spark.sql(VIEWS[view_name], **{base: s})
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def finish(spark, sdf, kind):
    folder = scratch(spark, kind)
    schema = sdf.schema
    return spark.read.schema(schema).parquet(W.run_to_end(sdf, folder))


def ended(spark, df, **keys):
    return W.with_end(df, W.write_end_marker(spark, scratch(spark, "end")), **keys)


def sessions_sql(key, gap_us, extra, source):
    """Session windows: a row opens a new session when the gap to the row before is reached."""
    return f"""o AS (SELECT *, epoch_us(ts) AS us FROM {source}),
     st AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {key} ORDER BY us) < {gap_us} THEN 0 ELSE 1 END AS opens FROM o),
     se AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM st){extra}"""


_MEANS = "(lower(tag) = 'dialog' OR " + " OR ".join(f"contains(lower(class_name), '{c}')" for c in X.MEANINGFUL_CLASSES) + ")"


@query("w1_debounce", f"""WITH {sessions_sql('session_id', 750000, '', 'v_mutations')}
  SELECT session_id, min(us)::BIGINT AS started_us, count(*)::BIGINT AS n_mutations FROM se GROUP BY session_id, sid HAVING bool_or({_MEANS})""")
def _(spark, sf):
    b = finish(spark, W.burst_inspections(ended(spark, stream_view(spark, sf, "v_mutations", "events"))), "w1")
    return b.select("session_id", F.unix_micros("started").alias("started_us"), "n_mutations")


def snaps(df):
    return df.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.col("event_id").alias("seq"), F.col("value").alias("highest_price"))


_GAP, _LONG = 6 * 3600, 60 * 86400
_EV = "ev AS (SELECT user_id::VARCHAR AS session_id, ts, event_id AS seq, value FROM events)"


@query("w3_price_tracker", f"""WITH {_EV}, {sessions_sql('session_id', _GAP * 1000000, '', 'ev')},
  g AS (SELECT session_id, sid, count(*) AS n, arg_min(value, us) AS a, arg_max(value, us) AS b, min(us) AS started FROM se GROUP BY session_id, sid)
  SELECT session_id, started::BIGINT AS started_us, a AS first_price, b AS latest_price, round(least(0.95, 0.75 + (b - a) / 1000), 6) AS confidence,
   CASE WHEN b - a > 150 THEN 'high' ELSE 'medium' END AS severity FROM g WHERE n >= 2 AND a > 0 AND b > 0 AND b - a > 20""")
def _(spark, sf):
    t = finish(spark, W.track_prices(ended(spark, snaps(stream(spark, sf, "events"))), f"{_GAP} seconds"), "w3")
    return t.select("session_id", F.unix_micros("started").alias("started_us"), "first_price", "latest_price", F.round("confidence", 6).alias("confidence"), "severity")


@query("w3_twin", f"""WITH {_EV}, o AS (SELECT *, epoch_us(ts) AS us FROM ev),
  st AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY session_id ORDER BY us) < {_GAP * 1000000} THEN 0 ELSE 1 END AS opens FROM o),
  se AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM st),
  g AS (SELECT session_id, count(*) AS n, arg_min(value, us) AS a, arg_max(value, us) AS b, min(us) AS started FROM se GROUP BY session_id, sid)
  SELECT session_id, started::BIGINT AS started_us, a AS first_price, b AS latest_price FROM g WHERE n >= 2 AND a > 0 AND b - a > 20""")
def _(spark, sf):
    """The same function on the stored table."""
    t = W.track_prices(snaps(table(spark, sf, "events")), f"{_GAP} seconds")
    return t.select("session_id", F.unix_micros("started").alias("started_us"), "first_price", "latest_price")


@query("w4_journey_machine", f"""WITH {sessions_sql('scan_id', _LONG * 1000000, '', 'v_transitions')},
  f AS ({fold_sql('scan_id, sid', 'se')}) SELECT * EXCLUDE (sid) FROM f""")
def _(spark, sf):
    """State lasts the whole scan, however long its pauses are: the same rows as the batch fold gives."""
    j = W.track_journeys(ended(spark, stream_view(spark, sf, "v_transitions", "events")))
    return finish(spark, j, "w4").drop("visit")


@query("w5_first_captures", "SELECT DISTINCT session_id, url FROM (SELECT user_id::VARCHAR AS session_id, event_type || (event_id % 3) AS url FROM events) x")
def _(spark, sf):
    """Real event times; repeats come up to a month late."""
    ev = stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.concat("event_type", F.col("event_id") % 3).alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    return finish(spark, W.first_captures(ev), "w5").select("session_id", "url")


@query("w5_capped_sessions", """WITH c AS (SELECT DISTINCT session_id, url FROM v_responses) SELECT session_id, count(*)::BIGINT AS kept, FALSE AS "full", least(count(*), 40)::BIGINT AS kept_of_40, count(*) >= 40 AS full_at_40 FROM c GROUP BY session_id""")
def _(spark, sf):
    """All captures, next to what a cap of 40 would keep."""
    from pageaudit.registry.views import view
    first = W.first_captures(view(spark, sf, "v_responses"))
    capped = W.capped_sessions(first, limit=X.NETWORK_CAPTURES).select("session_id", F.col("kept").alias("kept_of_40"), F.col("full").alias("full_at_40"))
    return W.capped_sessions(first).join(capped, "session_id")


_KIND = f"CASE WHEN event_type IN ('view', 'click') THEN 'result' WHEN event_type = 'signup' THEN 'navigate' ELSE 'other' END"


@query("w6_tab_results", f"""WITH tb AS (SELECT user_id AS tab_id, ts, event_id AS seq, {_KIND} AS kind, event_type || event_id AS result FROM events), {sessions_sql('tab_id', _LONG * 1000000, '', 'tb')},
  g AS (SELECT tab_id, sid, min(us) AS started, max(us) FILTER (WHERE kind = 'result') AS ra, max(us) FILTER (WHERE kind = 'navigate') AS na, arg_max(result, us) FILTER (WHERE kind = 'result') AS res
    FROM se GROUP BY tab_id, sid)
  SELECT tab_id, started::BIGINT AS started_us, CASE WHEN ra IS NOT NULL AND (na IS NULL OR ra > na) THEN 'done' ELSE 'idle' END AS status,
    CASE WHEN ra IS NOT NULL AND (na IS NULL OR ra > na) THEN res END AS result FROM g""")
def _(spark, sf):
    ev = stream(spark, sf, "events").select(
        F.col("user_id").alias("tab_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click"), "result").when(F.col("event_type") == "signup", "navigate").otherwise("other").alias("kind"),
        F.concat("event_type", "event_id").alias("result"))
    t = finish(spark, W.tab_results(ended(spark, ev)), "w6")
    return t.select("tab_id", F.unix_micros("started").alias("started_us"), "status", "result")


@query("w7_windowed_findings", """WITH f AS (SELECT epoch_us(ts) AS us, 'h' || (user_id % 7) AS host, event_type AS pattern FROM events),
  w AS (SELECT host, pattern, (us // 900000000 - k) * 900000000 AS ws FROM f, (SELECT unnest([0, 1, 2, 3]) AS k) x)
  SELECT (ws // 1000000)::BIGINT AS window_start_s, host, pattern, count(*)::BIGINT AS n FROM w GROUP BY ws, host, pattern""")
def _(spark, sf):
    f = stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), F.col("user_id") % 7).alias("host"), F.col("event_type").alias("pattern"))
    t = finish(spark, W.windowed_findings(ended(spark, f)), "w7")
    return t.select(F.unix_seconds("window_start").alias("window_start_s"), "host", "pattern", "n")


@query("w8_second_level_batch", f"""WITH e AS (SELECT event_id, {EV_K} AS k FROM events) SELECT event_id AS page_id, CASE WHEN k % 3 > 0 AND k % 12 <= 6 THEN 'second' ELSE 'first' END AS level,
  (CASE WHEN k % 3 > 0 AND k % 12 <= 6 THEN k ELSE 1 END)::BIGINT AS n_findings FROM e""")
def _(spark, sf):
    first, second = levels(table(spark, sf, "events"))
    return W.with_second_level(first, second).select("page_id", "level", "n_findings")


@query("w8_second_level", f"""WITH e AS (SELECT event_id, {EV_K} AS k FROM events) SELECT event_id AS page_id, CASE WHEN k % 3 > 0 AND k % 12 <= 6 THEN 'second' ELSE 'first' END AS level,
  (CASE WHEN k % 3 > 0 AND k % 12 <= 6 THEN k ELSE 1 END)::BIGINT AS n_findings FROM e""")
def _(spark, sf):
    first, second = levels(stream(spark, sf, "events"))
    return finish(spark, W.with_second_level(ended(spark, first, page_id=-1), ended(spark, second, page_id=-2)), "w8").select("page_id", "level", "n_findings")


def levels(ev):
    k = F.expr(EV_K)
    first = ev.select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("bigint").alias("local_count"))
    second = ev.where(k % 3 > 0).select(
        F.col("event_id").alias("page_id"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (k % 12) * 1_000_000).alias("ts"),
        k.cast("bigint").alias("deep_count"))
    return first, second


@query("w2_tiered_stream", f"WITH {PAGE_FINDINGS} SELECT rule_id, count(*)::BIGINT AS n FROM pf GROUP BY rule_id")
def _(spark, sf):
    """Stream of pages through the cheap test, the parser and all rules, one folder per epoch."""
    pages = stream_view(spark, sf, "v_html", "orders").drop("p", "n").withColumn("visible_text", F.lit(None).cast("string"))
    folder = scratch(spark, "w2")
    q = (pages.writeStream.foreachBatch(W.tiered_audit(pages, f"{folder}/out")).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("s6_partitioned_report", f"""WITH {PAGE_FINDINGS} SELECT stage, count(DISTINCT n)::BIGINT AS n_pages, count(*)::BIGINT AS n_findings FROM pf GROUP BY stage""")
def _(spark, sf):
    """Findings written partitioned by stage and read back."""
    from pageaudit.registry.page_queries import shop
    from pageaudit.sources.sinks import write_scan_report
    path = scratch(spark, "report")
    write_scan_report(ER.detect_all(shop(spark, sf)).select("page_id", "rule_id", "stage"), path, "stage")
    return spark.read.parquet(path).groupBy("stage").agg(F.countDistinct("page_id").alias("n_pages"), F.count("*").alias("n_findings"))
