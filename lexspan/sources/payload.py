"""The strings of JSON payloads in the order in which they stand, walked level by level in the JVM.

A value is parsed one level at a time. Its members come twice: as text, which keeps the order of members
below it, and as variants, which tell a string from an object that is written alike. Objects and arrays go
to the next level with their place; strings are done. A payload takes as many passes as it is deep, over
what is left of it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan import stored

#: Members that aren't text, in any case.
NOT_TEXT_KEYS = ("url", "album_url")


def _members(raw: Column) -> Column:
    """key, raw text and variant of each member of an object or array, in order; keys of arrays are null."""
    keyed, listed = F.from_json(raw, "map<string,string>"), F.from_json(raw, "array<string>")
    kind = "array<struct<key:string,raw:string,v:variant>>"
    of_object = F.zip_with(
        F.map_entries(keyed), F.map_entries(F.from_json(raw, "map<string,variant>")),
        lambda x, y: F.struct(x["key"].alias("key"), x["value"].alias("raw"), y["value"].alias("v")))
    of_array = F.zip_with(
        listed, F.from_json(raw, "array<variant>"), lambda x, v: F.struct(F.lit(None).cast("string").alias("key"), x.alias("raw"), v.alias("v")))
    return F.when(F.ltrim(raw).startswith("{"), of_object.cast(kind)).otherwise(of_array.cast(kind))


def json_strings(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, text: each string of a JSON payload, members called NOT_TEXT_KEYS left out with all below them.

    `place` is the path of positions to a string, which orders them as they stand. Null payloads have none;
    broken ones fail the query. A payload is one value, so its level is one row's work.
    """
    # A payload is walked as the only member of an array, so that a lone string is one too.
    checked = F.when(F.try_parse_json(text).isNotNull(), F.concat(F.lit("["), text, F.lit("]"))).otherwise(
        F.raise_error(F.concat(F.lit("no JSON: "), F.left(text, F.lit(80)))).cast("string"))
    level = payloads.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("place"), checked.alias("_raw"))
    found = None
    while True:
        members = level.select("_key", F.col("place").alias("_above"), F.posexplode(_members(F.col("_raw"))).alias("_at", "_m"))
        kind = F.schema_of_variant("_m.v")
        members = members.select("_key", F.concat("_above", F.array("_at")).alias("place"), "_m.key", "_m.raw", kind.alias("_kind"))
        members = members.where(F.coalesce(~F.lower("key").isin(*NOT_TEXT_KEYS), F.lit(True)))
        members = stored.written(members.where("_kind = 'STRING' or _kind like 'OBJECT%' or _kind like 'ARRAY%'"))
        strings = members.where("_kind = 'STRING'").select("_key", "place", F.col("raw").alias("_text"))
        found = strings if found is None else found.union(strings)
        level = members.where("_kind <> 'STRING'").select("_key", "place", F.col("raw").alias("_raw"))
        if level.isEmpty():
            return found.select(F.col("_key").alias(key), "place", F.col("_text").alias(text))


def joined_strings(strings: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: the strings of each payload, one to a line, in their order."""
    parts = F.sort_array(F.collect_list(F.struct("place", text)))
    return strings.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias(text))
