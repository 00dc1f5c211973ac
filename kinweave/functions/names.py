"""Identifier, name and namespace expressions; all of them stay in the JVM but for NFKC."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespaces that an identifier may have.
NAMESPACE_PATTERNS = (r"source:[a-z0-9_-]+", r"global:[a-z0-9_-]+", r"geo:wgs84", r"user:[a-z0-9_-]+")
#: The namespaces of identifier types that have only one.
MAPPED_NAMESPACES = {"gps": "geo:wgs84", "upc": "global:upc", "ean": "global:ean", "gtin": "global:gtin", "isbn": "global:isbn", "asin": "global:asin", "iucn_species_id": "global:iucn"}
#: Endings of slot names whose text had better refer to an entity.
ENTITY_NOUNS = ("species", "category", "brand", "manufacturer", "location", "country", "region", "city", "owner", "author", "creator", "seller", "buyer", "parent", "child", "type")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def derived_id(kind: str, *key: Column | str) -> Column:
    """A 32-digit id that follows from its key, so that a retried task makes the same one."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *(F.coalesce(_column(k).cast("string"), F.lit("")) for k in key)), 256), 1, 32)


def normalize_lexical(c: Column | str) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_column(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_type_name(c: Column | str) -> Column:
    """normalize_lexical after NFKC. NULL stays NULL."""
    return normalize_lexical(nfkc(_column(c)))


def parse_ref_name(c: Column | str) -> Column:
    """namespace, name, raw of ``ref:<name>`` or ``ref:<namespace>:<name>``, both normalised; NULL for other texts."""
    c = _column(c)
    rest = F.substring(c, 5, 1 << 30)
    spaced = F.instr(rest, ":") > 0
    space = F.when(spaced, normalize_lexical(F.substring_index(rest, ":", 1))).otherwise(F.lit("ref"))
    name = normalize_lexical(F.when(spaced, F.regexp_replace(rest, "^[^:]*:", "")).otherwise(rest))
    return F.when(c.startswith("ref:") & (name != "") & (space != ""), F.struct(space.alias("namespace"), name.alias("name"), c.alias("raw")))


def valid_namespace(c: Column | str) -> Column:
    return F.coalesce(_column(c).rlike("^(" + "|".join(NAMESPACE_PATTERNS) + ")$"), F.lit(False))


def resolve_namespace(id_type: Column | str, proposed: Column | str, context: Column | str) -> Column:
    """namespace, reason: the type's own namespace, else a valid proposed one, else the context's.

    reason: NULL if nothing valid was overridden by another, else id_type_mapped, invalid_pattern or empty_namespace.
    """
    id_type, proposed = _column(id_type), _column(proposed)
    mapped = reduce(lambda rest, x: F.when(id_type == x[0], F.lit(x[1])).otherwise(rest), MAPPED_NAMESPACES.items(), F.lit(None).cast("string"))
    given = F.coalesce(proposed, F.lit("")) != ""
    space = F.when(mapped.isNotNull(), mapped).when(valid_namespace(proposed), proposed).otherwise(_column(context))
    reason = F.when(mapped.isNotNull(), F.when(given & (proposed != mapped), "id_type_mapped")).when(valid_namespace(proposed), F.lit(None).cast("string")).when(given, "invalid_pattern").otherwise("empty_namespace")
    return F.struct(space.alias("namespace"), reason.alias("reason"))


def name_match(a: Column | str, b: Column | str) -> Column:
    """1 for equal names without case and outer space, 0.7 if one holds the other, else 0; NULL if one is empty."""
    a, b = F.lower(F.trim(_column(a))), F.lower(F.trim(_column(b)))
    usable = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(usable, F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.7).otherwise(0.0))


def looks_like_entity_slot(c: Column | str) -> Column:
    return F.lower(_column(c)).rlike("(" + "|".join(ENTITY_NOUNS) + ")$")


def short_id(c: Column | str) -> Column:
    return F.concat(F.substring(_column(c), 1, 8), F.lit("..."))


def source_basename(c: Column | str) -> Column:
    return F.substring_index(_column(c), "/", -1)


def participant_role(name: Column | str) -> Column:
    """subject for what a photo shows, else NULL."""
    return F.when(F.lower(_column(name)).contains("subject"), "subject")
