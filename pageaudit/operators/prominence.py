"""Visual prominence from stored geometry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.299 + g * 0.587 + b * 0.114) / 255


def prominence(width, height, top, font_px, opacity, fg, bg, vw=1280.0, vh=720.0) -> Column:
    """Weighted share of area, font size, position, visibility and contrast, each at most one."""
    one = F.lit(1.0)
    area = F.least(width * height / F.lit(vw * vh), one)
    font = F.least(font_px / 48, one)
    place = F.when(top < vh / 2, 1.0).otherwise(0.5)
    shown = F.when(opacity > 0.3, 1.0).otherwise(0.0)
    contrast = F.least(F.abs(luminance(*fg) - luminance(*bg)) * 2, one)
    return area * 0.25 + font * 0.20 + place * 0.20 + shown * 0.20 + contrast * 0.15


def prominence_ratio(accept: Column, decline: Column) -> Column:
    return F.when(decline > 0, accept / decline).otherwise(99.0)


def asymmetry(scored: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Pages whose first accept element outweighs the first decline element.

    Needs page_id, pos, role, prominence. Grouped minima, no self-join.
    """
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("prominence")), F.when(F.col("role") == role, F.col("pos")))
    g = scored.groupBy("page_id").agg(first("accept").alias("accept"), first("decline").alias("decline")).where(
        "accept is not null and decline is not null"
    )
    r = F.col("ratio")
    return g.withColumn("ratio", prominence_ratio(F.col("accept"), F.col("decline"))).where(r >= threshold).select(
        "page_id", "accept", "decline", "ratio", F.least(F.lit(0.95), 0.70 + (r - 3.5) * 0.04).alias("confidence"),
        F.when(r >= 6, "high").otherwise("medium").alias("severity"),
    )
