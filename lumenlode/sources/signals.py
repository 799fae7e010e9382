"""Answers of outside sources (landed JSON and XML) as features, and the cache of answers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A grouping page of the works source holds so many groups at most.
GROUP_PAGE = 200

_GROUPS = "struct<group_by:array<struct<key:string,key_display_name:string,count:bigint>>,meta:struct<count:bigint,groups_count:bigint>>"


def _by_year(pairs: Column, years: list[int]) -> Column:
    """A map of all ``years`` to counts, 0 where ``pairs`` (array of struct key, n) has none."""
    own = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["key"].isin([str(y) for y in years])), lambda p: F.struct(p["key"], p["n"])))
    return F.map_from_arrays(F.array(*[F.lit(str(y)) for y in years]), F.array(*[F.coalesce(F.try_element_at(own, F.lit(str(y))), F.lit(0)).cast("long") for y in years]))


def year_groups(body: Column, years: list[int]) -> Column:
    """by_year (all years), total, all_time, recent_two and recent_two_year_share (null for an empty window) of works grouped by year."""
    p = F.from_json(body, _GROUPS)
    pairs = F.transform(F.coalesce(p["group_by"], F.array().cast("array<struct<key:string,key_display_name:string,count:bigint>>")), lambda r: F.struct(r["key"].alias("key"), F.coalesce(r["count"], F.lit(0)).alias("n")))
    by = _by_year(pairs, years)
    total = F.aggregate(F.map_values(by), F.lit(0).cast("long"), lambda a, x: a + x)
    recent = sum((F.element_at(by, F.lit(str(y))) for y in sorted(years)[-2:]), F.lit(0).cast("long"))
    return F.struct(
        by.alias("by_year"), total.alias("total"), F.coalesce(p["meta"]["count"], F.lit(0)).alias("all_time"),
        recent.alias("recent_two"), F.when(total > 0, recent / total).alias("recent_two_year_share"),
    )


def group_count(body: Column) -> Column:
    """How many groups are not empty, and whether the page's end cut them."""
    p = F.from_json(body, _GROUPS)
    full = F.size(F.filter(F.coalesce(p["group_by"], F.array().cast("array<struct<key:string,key_display_name:string,count:bigint>>")), lambda r: r["count"] > 0)).cast("long")
    n = F.greatest(full, F.coalesce(p["meta"]["groups_count"], full))
    return F.struct(n.alias("groups"), (n >= GROUP_PAGE).alias("truncated"))


def concentration(body: Column, works: Column) -> Column:
    """The largest group (the first of equals) and its share of all works; null without works or groups."""
    rows = F.from_json(body, _GROUPS)["group_by"]
    most = F.array_max(F.transform(rows, lambda r: F.coalesce(r["count"], F.lit(0))))
    top = F.get(F.filter(rows, lambda r: F.coalesce(r["count"], F.lit(0)) == most), F.lit(0))
    known = (F.size(F.coalesce(rows, F.array().cast("array<struct<key:string,key_display_name:string,count:bigint>>"))) > 0) & (works > 0)
    return F.struct(F.when(known, top["key_display_name"]).alias("top"), F.when(known, most / works).alias("share"))


def hits_by_year(body: Column, years: list[int]) -> Column:
    """Hits by the UTC year of their epoch seconds."""
    hits = F.from_json(body, "struct<hits:array<struct<created_at_i:bigint>>>")["hits"]
    epoch = F.lit("1970-01-01").cast("date")
    keys = F.transform(F.filter(hits, lambda h: h["created_at_i"].isNotNull()), lambda h: F.year(F.date_add(epoch, F.floor(h["created_at_i"] / 86400).cast("int"))).cast("string"))
    return _counted(keys, years)


def _counted(keys: Column, years: list[int]) -> Column:
    n = lambda y: F.size(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k == str(y))).cast("long")
    return F.map_from_arrays(F.array(*[F.lit(str(y)) for y in years]), F.array(*[n(y) for y in years]))


def repositories(body: Column, years: list[int]) -> Column:
    """Stars of a page of repositories, and repositories by year of creation."""
    items = F.from_json(body, "struct<items:array<struct<stargazers_count:bigint,created_at:string>>>")["items"]
    items = F.coalesce(items, F.array().cast("array<struct<stargazers_count:bigint,created_at:string>>"))
    stars = F.aggregate(items, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["stargazers_count"], F.lit(0)))
    return F.struct(stars.alias("stars"), _counted(F.transform(items, lambda r: F.substring(r["created_at"], 1, 4)), years).alias("by_year"))


def article(body: Column, today: Column) -> Column:
    """Whether a wiki has the article, its size in bytes and its age in days."""
    page = F.get(F.from_json(body, "struct<query:struct<pages:array<struct<title:string,missing:boolean,invalid:boolean,length:bigint,revisions:array<struct<timestamp:string>>>>>>")["query"]["pages"], F.lit(0))
    there = page.isNotNull() & ~F.coalesce(page["missing"], F.lit(False)) & ~F.coalesce(page["invalid"], F.lit(False))
    created = F.try_to_date(F.substring(F.get(page["revisions"], F.lit(0))["timestamp"], 1, 10))
    return F.struct(
        there.alias("exists"), page["title"].alias("title"), F.when(there, F.coalesce(page["length"], F.lit(0))).alias("size_bytes"),
        F.when(there, F.datediff(today, created)).alias("age_days"),
    )


def pageview_window(today: Column) -> Column:
    """First and last day of the twelve full months before this one."""
    end = F.date_sub(F.trunc(today, "month"), 1)
    return F.struct(F.add_months(F.trunc(today, "month"), -12).alias("first"), end.alias("last"))


def pageviews(body: Column) -> Column:
    items = F.coalesce(F.from_json(body, "struct<items:array<struct<views:bigint>>>")["items"], F.array().cast("array<struct<views:bigint>>"))
    return F.struct(F.aggregate(items, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["views"], F.lit(0))).alias("views"), F.size(items).cast("long").alias("months"))


def total_results(xml: Column) -> Column:
    """The count that an Atom feed gives; an error if there is none, as 0 would be a claim."""
    n = F.regexp_extract(xml, r"<(?:[A-Za-z]+:)?totalResults[^>]*>\s*([0-9]+)\s*</", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.raise_error(F.lit("the feed has no totalResults")))


def features(answers: DataFrame) -> DataFrame:
    """Features by term of answers that came (term, source, ok, data: map<string,double>, series: map<string,map<string,bigint>>).

    Numbers keep their names behind the source's; of a yearly series the last year's value is taken. What no
    source answered is not there, rather than 0.
    """
    good = answers.where("ok")
    direct = good.select("term", "source", F.explode("data").alias("k", "v")).where("v is not null").select("term", F.concat_ws(".", "source", "k").alias("feature"), F.col("v").alias("value"))
    digits = F.filter(F.map_keys("s"), lambda y: y.rlike("^[0-9]+$"))
    last = good.select("term", "source", F.explode("series").alias("k", "s")).where(F.size(digits) > 0)
    value = F.element_at("s", F.element_at(F.array_sort(digits), -1)).cast("double")
    return direct.union(last.select("term", F.concat(F.col("source"), F.lit("."), F.regexp_replace("k", "_by_year$", "_last_year")).alias("feature"), value.alias("value")))


def missing(terms: DataFrame, cache: DataFrame, source: str, version: int) -> DataFrame:
    """Terms that a source has not been asked about in this version of its parser."""
    known = cache.where((F.col("source") == source) & (F.col("version") == version)).select("term").distinct()
    return terms.select("term").distinct().join(known, "term", "left_anti")


def remember(answers: DataFrame, path: str) -> None:
    """Append answers (term, source, version, fetched, body) to the cache, a JSON line each."""
    answers.write.mode("append").json(path)


def recalled(spark, path: str) -> DataFrame:
    """The newest answer of each term, source and version."""
    rows = spark.read.schema("term string, source string, version int, fetched timestamp, body string").json(path)
    return rows.groupBy("term", "source", "version").agg(F.max_by("body", "fetched").alias("body"), F.max("fetched").alias("fetched"))


def message_id(*parts: Column) -> Column:
    """A name-based UUID (version 5, URL namespace) of the parts: the same message has the same id."""
    space = uuid.NAMESPACE_URL.hex.upper()
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.concat_ws("|", *parts).cast("binary")))
    byte = lambda i, n: F.substring(h, 1 + 2 * i, 2 * n)
    high = F.lower(F.hex(F.conv(byte(8, 1), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(byte(0, 4), F.lit("-"), byte(4, 2), F.lit("-5"), F.substring(byte(6, 2), 2, 3), F.lit("-"), high, byte(9, 1), F.lit("-"), byte(10, 6))


def embedding(name: str | None = None):
    """A function of texts to vectors by the provider that EMBEDDING_PROVIDER names (onnx, http), or None: vectors then come as a column or from TF-IDF.

    Models are not part of this package; a provider is a module with ``embed(texts) -> list of lists``.
    """
    import importlib

    name = name or os.environ.get("EMBEDDING_PROVIDER")
    if not name:
        return None
    return importlib.import_module(name).embed
