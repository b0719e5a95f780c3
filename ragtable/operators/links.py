"""Link table (S-09): derive info URL, html URL and id; one row per info URL.

Duplicates can carry different links, so the first by input position wins.
That is a ``min_by`` aggregate, not a window: the aggregate combines on the
map side, so a URL repeated in a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import celex_id, html_page_url, info_page_url


def build_link_table(links: DataFrame, link_col: str = "link", position_col: str = "position") -> DataFrame:
    l = links.select(
        F.col(position_col).alias("_pos"), F.col(link_col).alias("link"),
        info_page_url(F.col(link_col)).alias("info_page_url"),
        html_page_url(F.col(link_col)).alias("html_page_url"),
    )
    first = F.min_by(F.struct("link", "html_page_url"), F.col("_pos"))
    return (
        l.groupBy("info_page_url")
        .agg(first.alias("_f"), F.min("_pos").alias("first_position"))
        .select(
            "info_page_url", F.col("_f.link").alias("link"), F.col("_f.html_page_url").alias("html_page_url"),
            celex_id(F.col("info_page_url")).alias("celex_id"), "first_position",
        )
    )
