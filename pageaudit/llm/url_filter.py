"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the path of the address starts with
the rule's. The longest rule (host and path together, then the longer host) wins.

Keys are (reversed host, path): ``www.example.org/en`` is looked up as ``org.example.www`` and
``org.example`` (as many host suffixes as the deepest rule has labels), each with its path. Under
one reversed host a path prefix is an interval of the sort order, and such intervals nest. Rules
and keys are range-partitioned together and swept in order: at each rule the state becomes the
rule's stack, that is the rule and the shorter rules it is nested in; a key pops the rules that
closed before it and takes the first that is still open. A partition starts with the last stack of the
partitions before it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageaudit.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows swept by one task, about; sets the number of range partitions, not what is swept.
ROWS_PER_TASK = 500_000
NOT_FOUND = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_keys(host: Column, depth: int) -> Column:
    """The last 1 to ``depth`` labels of a host, each in reversed order, joined by dots."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, F.lit(1), n), ".")
    )


def rules_with_stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the stack it opens: itself and the rules of its host whose path is a shorter prefix, longest first.

    Enclosing rules are found by an equality join of the proper prefixes of the path, so no
    host's rules are brought together. Of rules with the same host and path one stays; a block goes before an allow.
    """
    key = F.array_join(F.reverse(F.split(F.translate("host", UPPER, LOWER), r"\.", -1)), ".")
    clean = (
        rules.where("host IS NOT NULL AND host <> ''")
        .select(key.alias("rkey"), F.coalesce("path", F.lit("")).alias("rpath"), F.translate("host", UPPER, LOWER).alias("rhost"), "verdict")
        .groupBy("rkey", "rpath", "rhost").agg(F.max("verdict").alias("verdict"))
    )
    entry = F.struct(F.length("rpath").alias("n"), "rkey", "rpath", F.concat("rhost", "rpath").alias("rule"), "verdict")
    up = clean.select(
        "rkey", F.col("rpath").alias("inner"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length("rpath")), lambda n: F.substring(F.col("rpath"), F.lit(1), n))).alias("rpath"),
    )
    return (
        up.join(clean, ["rkey", "rpath"])
        .groupBy("rkey", F.col("inner").alias("rpath")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    )


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = NOT_FOUND) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits) and verdict (``default`` if none fits).

    ``rules``: host, path (null: empty) and verdict (``allow`` or ``block``); rules without a host are left
    out. Other columns of either table are not read. Repeated rows are judged once and returned as often as
    they came; ids may be null or repeated. An empty table gives an empty result; without rules all rows get ``default``.
    """
    pages = (
        urls.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
        .groupBy("id", "host", "path").agg(F.count("*").alias("n"))
    )
    stacks = written(rules_with_stacks(rules), "url-rules")
    depth = stacks.agg(F.max(F.size(F.split("rkey", r"\.", -1)))).first()[0] or 1
    lookups = pages.select("id", "host", "path", "n", F.explode(suffix_keys(F.col("host"), depth)).alias("key"))
    nothing = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = lookups.select("key", F.col("path").alias("at"), F.lit(1).alias("kind"), "id", "host", "path", "n", nothing.alias("stack"))
    opened = stacks.select(
        F.col("rkey").alias("key"), F.col("rpath").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["id"].dataType).alias("id"),
        F.lit("").alias("host"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n"), "stack",
    )
    parts = max(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lookups.count() // ROWS_PER_TASK))
    order = ["key", "at", "kind", "id", "host"]
    swept = written(
        events.unionByName(opened).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "url-events"
    )
    # what each partition inherits: the last stack opened in any partition before it (one row per partition)
    last = swept.where("kind = 0").groupBy("part").agg(F.max_by("stack", F.struct("key", "at")).alias("stack"))
    carried = (
        swept.groupBy("part").agg(F.lit(0).alias("x")).join(last, "part", "left")
        .select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    in_order = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(in_order)).join(carried, "part")
    still_open = F.filter(
        F.coalesce("stack", "carried"), lambda r: (r["rkey"] == F.col("key")) & F.startswith(F.col("path"), r["rpath"])
    )
    top = F.element_at(still_open, 1)
    best = (
        state.where("kind = 1")
        .select("id", "host", "path", "n", F.when(F.size(still_open) > 0, F.struct(F.length(top["rule"]).alias("size"), F.length("key").alias("deep"), top["rule"].alias("rule"), top["verdict"].alias("verdict"))).alias("hit"))
        .groupBy("id", "host", "path").agg(F.max("n").alias("n"), F.max("hit").alias("hit"))
    )
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    ).drop("copy")
