"""Speakers of conference pages in three layouts, and nested JSON as rows.

A layout is a pair of a way to the payload and a shape of its entries; entries become columns, and all
cleaning is done by expressions on them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators.upserts import pick

#: The script element that holds a page's data.
EMBEDDED = r'(?is)<script\b[^>]*\bid\s*=\s*["\']?__NEXT_DATA__["\']?[^>]*>(.*?)</script>'


@F.pandas_udf(T.ArrayType(T.StringType()))
def objects(body: pd.Series) -> pd.Series:
    """Every object in a JSON text, outer before inner, as JSON; no recursion, so any depth will do."""

    def one(s):
        try:
            todo = [json.loads(s)]
        except (TypeError, ValueError, RecursionError):
            return []
        out = []
        while todo:
            v = todo.pop()
            if isinstance(v, dict):
                out.append(json.dumps(v, ensure_ascii=False, sort_keys=True))
                v = list(v.values())
            if isinstance(v, list):
                todo.extend(reversed(v))
        return out

    return body.map(one)


def embedded(body: Column) -> Column:
    """The data that a page carries in its script element, null without one."""
    return F.nullif(F.regexp_extract(body, EMBEDDED, 1), F.lit(""))


def _clean(x: Column) -> Column:
    return F.nullif(text.collapse(x), F.lit(""))


def _get(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def _entries(pages: DataFrame, payload: Column, path: str) -> DataFrame:
    items = F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")
    return pages.select("source_id", F.posexplode(items).alias("pos", "v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def handle_in(x: Column) -> Column:
    """The handle of the first profile address in a text, or of a text that is one handle."""
    found = F.regexp_extract(x, r"(?i)(?:^|[^A-Za-z0-9.])((?:https?://)?(?:www\.)?(?:x|twitter)\.com/@?[A-Za-z0-9_]{1,15})(?![A-Za-z0-9_])", 1)
    return text.profile_handle(F.when(found != "", found).otherwise(x))


def speakers(pages: DataFrame) -> DataFrame:
    """(source_id, name, handle, role, company, bio, website): the speakers of pages (source_id, layout, body), each name once per page, the last entry counts.

    Layouts: list (a JSON object with speakers), presenters (data in the page, entries with
    attributes), tagline (data in the page; every object with name, tagline and about, whose tagline
    ends in the company). Entries without a name are left out; pages of another layout give none.
    """
    by = lambda layout: pages.where(F.col("layout") == layout)
    a = _entries(by("list"), F.col("body"), "$.speakers")
    v = F.col("v")
    plain = a.select("source_id", "pos", _get(v, "$.name").alias("name"), _get(v, "$.twitter").alias("social"), _get(v, "$.role").alias("role"), _get(v, "$.company.name", "$.company").alias("company"), _get(v, "$.bio").alias("bio"), _get(v, "$.website").alias("website"))
    b = _entries(by("presenters"), embedded(F.col("body")), "$.props.pageProps.presenters")
    at = lambda name: _get(v, f"$.attributes.{name}", f"$.{name}")
    social = F.concat_ws("\n", at("socialLinks"), at("about"))
    shown = b.select("source_id", "pos", at("name").alias("name"), social.alias("social"), at("tagline").alias("role"), at("company.data.attributes.name").alias("company"), at("about").alias("bio"), text.markdown_link(social, "Website").alias("website"))
    nested = by("tagline").withColumn("data", F.try_variant_get(F.try_parse_json(embedded(F.col("body"))), "$.props.pageProps", "variant"))
    each = nested.select("source_id", F.posexplode(objects(F.to_json("data"))).alias("pos", "j")).withColumn("v", F.try_parse_json("j"))
    each = each.where("get_json_object(j, '$.name') is not null and j like '%\"tagline\"%' and j like '%\"about\"%'")
    split = text.role_company(_get(v, "$.tagline"))
    old = each.select("source_id", "pos", _get(v, "$.name").alias("name"), _get(v, "$.about").alias("social"), split.role.alias("role"), split.company.alias("company"), _get(v, "$.about").alias("bio"), text.markdown_link(_get(v, "$.about"), "Website").alias("website"))
    rows = plain.unionByName(shown).unionByName(old)
    rows = rows.select("source_id", "pos", _clean(F.col("name")).alias("name"), handle_in(F.col("social")).alias("handle"), *[_clean(F.col(c)).alias(c) for c in ("role", "company", "bio", "website")]).where("name is not null")
    return pick(rows.withColumn("_n", F.lower("name")), ["source_id", "_n"], [F.desc("pos")]).drop("_n", "pos")


def audit(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row of counts: records, distinct names, handles and companies; handles that accounts (handle, rejected) know, active or rejected."""
    r = records.select(F.lower("name").alias("n"), F.lower("handle").alias("h"), text.organisation_key(F.col("company")).alias("c"))
    known = accounts.select(F.lower("handle").alias("h"), "rejected").groupBy("h").agg(F.bool_or("rejected").alias("rejected"))
    j = r.join(known, "h", "left")
    when = lambda c: F.count_distinct(F.when(c, F.col("h")))
    return j.agg(
        F.count("*").alias("records"),
        F.count_distinct("n").alias("unique_names"),
        F.count_distinct("h").alias("unique_handles"),
        F.count_distinct(F.nullif("c", F.lit(""))).alias("unique_companies"),
        when(F.col("rejected").isNotNull()).alias("known_handles"),
        when(F.col("rejected").isNull()).alias("new_handles"),
        when(~F.col("rejected")).alias("matched_active"),
        when(F.col("rejected")).alias("matched_rejected"),
    )


def audit_by_source(records: DataFrame) -> DataFrame:
    """(source_id, records, with_handle, companies)."""
    return records.groupBy("source_id").agg(F.count("*").alias("records"), F.count("handle").alias("with_handle"), F.count_distinct(F.nullif(text.organisation_key(F.col("company")), F.lit(""))).alias("companies"))
