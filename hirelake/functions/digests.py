"""Digests of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, fingerprint): a digest that the order of rows doesn't change.

    Rows' SHA-256 digests are cut into four numbers of 60 bits that are summed, so repeated rows count and the state is
    five numbers whatever the table's size.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = rows.select(digest.alias("h")).agg(F.count("*").alias("n_rows"), *[part(k).alias(f"s{k}") for k in range(4)])
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", *[F.coalesce(f"s{k}", F.lit(0)) for k in range(4)]), 256).alias("fingerprint"))
