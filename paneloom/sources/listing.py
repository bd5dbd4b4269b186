"""Newest live record of a name in a JSON listing."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Layout of a listing and its time format.
LISTING = (
    "total_count long, artifacts array<struct<name: string, expired: boolean, created_at: string, "
    "archive_download_url: string>>"
)
CREATED_AT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PAGE_SIZE = 100


def listing_records(listings: DataFrame, column: str = "json") -> DataFrame:
    """One row per record of the JSON documents in ``column``."""
    parsed = listings.select(F.from_json(column, LISTING).alias("l"))
    records = parsed.select("l.total_count", F.inline("l.artifacts"))
    return records.withColumn("created", F.to_timestamp_ntz("created_at", F.lit(CREATED_AT)))


def latest_records(records: DataFrame, name: str = "name") -> DataFrame:
    """``name, created, url`` of the newest record that is not expired, for every name."""
    return (
        records.where(~F.col("expired"))
        .groupBy(name)
        .agg(
            F.max("created").alias("created"),
            F.max_by("archive_download_url", F.struct("created", "archive_download_url")).alias("url"),
        )
    )


def latest_record(listings: DataFrame, name: str, column: str = "json"):
    """(created, url) of the newest live record of ``name``; an error when there is none."""
    records = listing_records(listings, column)
    known = records.agg(F.max("total_count")).first()[0]
    if known is not None and known > PAGE_SIZE:
        log.warning("the listing holds %d records, only the first %d are given", known, PAGE_SIZE)
    found = latest_records(records.where(F.col("name") == name)).first()
    if found is None:
        raise LookupError(f"no record named {name}")
    return found.created, found.url
