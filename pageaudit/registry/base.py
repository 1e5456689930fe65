"""Registry of runnable queries and their checking SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageaudit.registry.views import with_views
from pageaudit.session import scratch_path as scratch  # noqa: F401

QUERIES, ORACLE = {}, {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and decimals as DOUBLE, so that both engines show the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str = None):
    """Registers fn(spark, folder) -> DataFrame with its checking SQL."""
    def register(fn):
        def run(spark, folder):
            return plain(fn(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


def rx(pattern: str) -> str:
    """Pattern as an SQL string, matched case-insensitively by the checking engine."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    """SQL: ``col`` contains one of the words."""
    return "(" + " OR ".join("contains({}, '{}')".format(col, w.replace("'", "''")) for w in words) + ")"
