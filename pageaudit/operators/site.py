"""Site audits: which pages of a host are visited, and the report over them."""

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageaudit import fixed as X
from pageaudit.functions.text import host_of
from pageaudit.functions.windows import top_k
from pageaudit.session import written


def reachable_pages(starts: DataFrame, links: DataFrame, max_pages: int = None) -> DataFrame:
    """Pages a breadth-first walk visits per host: host, url, depth and rank.

    All hosts advance together, one level per round, until nothing new is found. The links are written
    once, by source; each level is written once and only read afterwards. With ``max_pages`` at most as many
    pages per host are visited, ranked in the order of the walk; without it the rank is null. ``starts``: host, url.
    ``links``: src_url, seq, dst_url with the same host on both ends.
    """
    edges = written(links.where("src_url <> dst_url").select("src_url", "seq", "dst_url").repartition("src_url"), "edges")
    frontier = visited = written(starts.select("host", "url", F.lit(0).alias("depth"), F.lit(1 if max_pages else None).cast("int").alias("rank")), "level")
    for depth in count(1):
        found = (
            frontier.join(edges, frontier.url == edges.src_url)
            .select("host", F.col("dst_url").alias("url"), F.struct("rank", "seq").alias("place"))
            .groupBy("host", "url").agg(F.min("place").alias("place"))
            .join(visited.select("host", "url"), ["host", "url"], "left_anti")
        )
        rank = F.lit(None).cast("int")
        if max_pages:
            room = visited.groupBy("host").agg(F.count("*").alias("used"))
            found = top_k(found, ["host"], ["place", "url"], max_pages, "n").join(room, "host").where(F.col("used") + F.col("n") <= max_pages)
            rank = (F.col("used") + F.col("n")).cast("int")
        frontier = written(found.select("host", "url", F.lit(depth).alias("depth"), rank.alias("rank")), "level")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)


def may_be_among(pages: DataFrame, wanted: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of ``pages`` whose url may be one of ``wanted``: all that are, and few others while ``wanted`` has far fewer rows than ``bits``.

    A membership test by a bitmap of fixed size, so that wide rows are left out where they are read. The bitmap comes in pieces
    of 4 KB, at most ``bits`` / 32768 of them (8 MB by default) however many rows ``wanted`` has; that is what is broadcast. Null urls may pass.
    """
    place = F.pmod(F.xxhash64("url"), F.lit(bits)) + 1
    pieces = (
        wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bitmap"))
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tested = pages.withColumn("_piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "_piece")
    return tested.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*pages.columns)


def site_report(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings by severity, patterns and pages in need of attention per host; no severity is ever critical."""
    total = pages.withColumn("host", host_of(F.col("url"))).groupBy("host").agg(F.count("*").alias("pages_analyzed"))
    sev = F.lower("severity")
    per_page = findings.withColumn("host", host_of(F.col("url"))).groupBy("host", "url").agg(
        F.count("*").alias("n"), F.count_if(sev == "high").alias("high"),
        F.count_if(sev.isin("medium", "elevated")).alias("medium"), F.count_if(sev == "low").alias("low"),
        F.collect_set("pattern").alias("patterns"),
    )
    sums = per_page.groupBy("host").agg(
        F.sum("n").alias("total_findings"), F.sum("high").alias("high"), F.sum("medium").alias("medium"),
        F.sum("low").alias("low"), F.count("*").alias("pages_requiring_attention"),
        # at most 13 patterns: one flag per pattern instead of a growing list
        *[F.bool_or(F.array_contains("patterns", p[0])).alias(f"_p{i}") for i, p in enumerate(X.PATTERNS)],
    )
    names = F.array(*[F.when(F.col(f"_p{i}"), F.lit(p[0])) for i, p in enumerate(X.PATTERNS)])
    out = total.join(sums, "host", "left").withColumn("patterns", F.array_join(F.array_sort(F.array_compact(names)), ","))
    return out.select(
        "host", "pages_analyzed", F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        F.lit(0).cast("bigint").alias("critical"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high", "medium", "low", "pages_requiring_attention")],
        F.coalesce("patterns", F.lit("")).alias("patterns"),
    )


def advice() -> list:
    """General remedies that go with every site report."""
    return [
        "Look at the high-severity findings first and untick extras that are selected in advance.",
        "Show every mandatory charge on the product page.",
        "Check the listed pages by hand.",
    ]
