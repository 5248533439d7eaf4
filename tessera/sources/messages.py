"""What leaves the engine: rendered metadata, message blocks, report rows, and the boundary to whoever sends them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import text, time


def paper_text(title: Column, authors: Column, published: Column, updated: Column, categories: Column, summary: Column, comment: Column) -> Column:
    """A paper's metadata as text: a section for each part that there is."""
    some = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    listed = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", ")
    parts = F.array(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled arXiv paper")), some("Authors: ", listed(authors)), some("Published: ", published), some("Updated: ", updated), some("Categories: ", listed(categories)), some("Abstract\n\n", summary), some("Comment\n\n", comment))
    return F.concat(F.trim(F.array_join(F.array_compact(parts), "\n\n")), F.lit("\n"))


def blocks(items: DataFrame, limit: int = 2700) -> DataFrame:
    """(day, place, part, block): messages of a day's items in order, escaped, cut at ``limit`` characters. items: day, place, headline, body."""
    said = F.concat(F.lit("*"), text.message_escape(F.col("headline")), F.lit("* "), text.message_escape(text.collapse(F.col("body"))))
    return items.select("day", "place", F.posexplode(text.chunk_words(limit)(said)).alias("part", "block"))


def report_rows(items: DataFrame) -> DataFrame:
    """(day, shown_day, place, headline, what_changed): what a printed report has, one row per entry; pages are laid out elsewhere."""
    return items.select("day", time.display_day(F.col("day")).alias("shown_day"), "place", text.collapse(F.col("headline")).alias("headline"), text.collapse(F.col("body")).alias("what_changed"))


def deliver(rows: DataFrame, sent: DataFrame, key: str, send: Callable[[Iterator[Row]], None]) -> DataFrame:
    """The keys of rows that this call sent: those not in sent (key). ``send`` gets rows partition by partition and may be called twice for one that is retried."""
    fresh = rows.join(sent.select(key).distinct(), key, "left_anti")
    fresh.foreachPartition(send)
    return fresh.select(key).distinct()
