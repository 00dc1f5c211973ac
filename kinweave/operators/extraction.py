"""Features of contents by medium, and the rule that proposes seeds where no model does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.documents import decoded, json_features, merged_maps, text_features
from kinweave.functions.media import exif_ids
from kinweave.functions.names import resolve_namespace

_IDS = "array<struct<id_type:string,id_value:string,id_namespace:string>>"


def extracted(contents: DataFrame, content: str = "content", medium: str = "medium", tags: str | None = None) -> DataFrame:
    """Adds extracted_text, char_count, truncated, hash_value, key_count, ids, size_bytes and note.

    Texts are decoded and cut to an excerpt, JSON is flattened and searched for identifiers (broken
    JSON has no features), images give the identifiers of their EXIF ``tags`` (a map column) if
    they have any, videos and sounds a note, and all of them their size.  NULL contents have size 0.
    Python sees the texts of JSON rows only, NULL in the place of all others.
    """
    text, kind = decoded(content), F.col(medium)
    rows = contents.withColumn("_t", F.when(kind == "text", text_features(text))).withColumn("_j", json_features(F.when(kind == "json", text)))
    image_ids = exif_ids(tags) if tags else F.array().cast(_IDS)
    ids = F.when(kind == "json", F.coalesce("_j.ids", F.array().cast(_IDS))).when(kind == "image", image_ids.cast(_IDS)).otherwise(F.array().cast(_IDS))
    return rows.select(
        *contents.columns, F.coalesce("_t.extracted_text", "_j.flat_text").alias("extracted_text"), "_t.char_count", "_t.truncated", F.col("_j.schema_hash").alias("hash_value"), "_j.key_count", ids.alias("ids"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size_bytes"), F.when(kind.isin("video", "audio"), F.concat(kind, F.lit(" is kept without features"))).alias("note"),
    )


def namespaced(ids: Column, context: Column) -> Column:
    """An array of identifiers with their namespaces resolved, as seeds carry them."""
    return F.transform(ids, lambda i: F.struct(i["id_type"].alias("id_type"), i["id_value"].alias("id_value"), resolve_namespace(i["id_type"], i["id_namespace"], context)["namespace"].alias("id_namespace")))


def merged_facets(extra: Column, facets: Column, keys: tuple[str, ...] = ("gps_latitude", "gps_longitude", "datetime")) -> Column:
    """Facets (a map), with those of the listed extracted values that they lack. NULL maps are empty."""
    return merged_maps(F.map_filter(extra, lambda k, v: k.isin(*keys) & v.isNotNull()), facets)


def proposed(observations: DataFrame, context: Column) -> DataFrame:
    """observation_id, observation_kind, seed_index, entity_nature, suggested_name, id_type, id_value, id_namespace, confidence.

    The rule in the place of a model: the kind is the medium and the first part of the source;
    each extracted identifier is the seed of an individual, and an image has one more seed for
    what it shows.
    """
    kind = F.concat_ws("_", "medium", F.lower(F.regexp_extract("source_id", r"([A-Za-z]+)", 1)))
    seeds = F.transform(namespaced(F.col("ids"), context), lambda i: F.struct(F.lit("individual").alias("entity_nature"), F.concat_ws(":", i["id_type"], i["id_value"]).alias("suggested_name"), i.alias("id"), F.lit(1.0).alias("confidence")))
    shown = F.struct(F.lit("individual").alias("entity_nature"), F.lit("photo_subject").alias("suggested_name"), F.lit(None).cast("struct<id_type:string,id_value:string,id_namespace:string>").alias("id"), F.lit(0.6).alias("confidence"))
    every = F.when(F.col("medium") == "image", F.concat(seeds, F.array(shown))).otherwise(seeds)
    return observations.select("observation_id", kind.alias("observation_kind"), F.posexplode(every).alias("seed_index", "s")).select("observation_id", "observation_kind", "seed_index", "s.entity_nature", "s.suggested_name", "s.id.*", "s.confidence")
