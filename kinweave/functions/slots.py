"""Slot values: primitives with a type, references, or lists of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import looks_like_entity_slot

#: Known primitive types; those that should have a unit; the most warnings kept of a subject.
SLOT_TYPES = ("boolean", "currency", "date", "datetime", "duration", "email", "integer", "number", "percentage", "string", "url")
NEEDS_UNIT, MOST_WARNINGS = ("number", "integer", "currency"), 20


def _json_kind(v: Column) -> Column:
    """null, boolean, integer, number, string, object or array of a VARIANT."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer").when(s.rlike(r"^(DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "STRING", "string").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").otherwise("unknown")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return F.to_json(v)


def normalize_slot(name: Column, v: Column) -> Column:
    """kind, value, type, unit, ref_entity_id, ref_type, code: a VARIANT slot value in normal form and its warning.

    kind: null, primitive, reference, passed (kept as it is); lists are exploded before (see normalize_slots).
    Bare primitives get their type; a wrapper without type gets the type of its value.
    """
    kind, ref, rtype = _json_kind(v), _field(v, "ref_entity_id"), _field(v, "ref_type")
    inner, given, unit = _field(v, "value"), _field(v, "type"), _field(v, "unit")
    inner_kind, primitive = _json_kind(inner), ("boolean", "integer", "number", "string")
    string = lambda x: x.try_cast("string")
    filled = lambda x: (_json_kind(x) == "string") & (string(x) != "")
    is_ref = (kind == "object") & (_json_kind(ref) == "string") & filled(rtype)
    is_wrapper = (kind == "object") & ~is_ref & inner_kind.isin(*primitive) & filled(given)
    bare = kind.isin(*primitive)
    broken_ref = (kind == "object") & ~is_ref & ~is_wrapper & (ref.isNotNull() | rtype.isNotNull())
    broken = (kind == "object") & ~is_ref & ~is_wrapper & ~broken_ref & inner.isNotNull()
    code = (
        F.when(is_ref, F.lit(None).cast("string"))
        .when(is_wrapper, F.when(string(given).isin(*NEEDS_UNIT) & unit.isNull(), "missing_unit"))
        .when(bare & kind.isin("integer", "number"), "bare_numeric")
        .when(bare & (kind == "string") & looks_like_entity_slot(name), "entity_reference_candidate")
        .when(broken_ref, "malformed_reference")
        .when(broken, "malformed_primitive")
        .when(kind == "object", "unrecognized_structure")
    )
    shape = F.when(kind == "null", "null").when(is_ref, "reference").when(is_wrapper | bare | (broken & inner_kind.isin(*primitive)), "primitive").otherwise("passed")
    value = F.when(bare, string(v)).when(shape == "primitive", string(inner)).when(shape == "passed", _text(v))
    type_ = F.when(bare, kind).when(is_wrapper, string(given)).when(shape == "primitive", inner_kind)
    return F.struct(shape.alias("kind"), value.alias("value"), type_.alias("type"), string(unit).alias("unit"), F.when(is_ref, string(ref)).alias("ref_entity_id"), F.when(is_ref, string(rtype)).alias("ref_type"), code.alias("code"))


def normalize_slots(df: DataFrame, key: str, slots: str) -> DataFrame:
    """key, slot_name and the fields of normalize_slot, for each value of a column of JSON objects.

    Items of lists are named ``name[i]``.  Texts that aren't JSON objects have no slots.
    """
    parsed = df.select(F.col(key).alias(key), F.try_parse_json(F.col(slots)).alias("_v"))
    each = parsed.select(key, F.explode(F.from_json(F.to_json("_v"), "map<string,variant>")).alias("slot_name", "v"))
    listed = F.when(_json_kind(F.col("v")) == "array", F.col("v").try_cast("array<variant>"))
    flat = each.withColumn("items", listed).select(key, "slot_name", F.when(F.col("items").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("v").alias("v")))).otherwise(F.transform("items", lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("v")))).alias("x"))
    one = flat.select(key, "slot_name", F.explode("x").alias("x")).select(key, F.when(F.col("x.i").isNull(), F.col("slot_name")).otherwise(F.concat("slot_name", F.lit("["), F.col("x.i").cast("string"), F.lit("]"))).alias("slot_name"), F.col("x.v").alias("v"))
    return one.select(key, "slot_name", normalize_slot(F.col("slot_name"), F.col("v")).alias("s")).select(key, "slot_name", "s.*")


def warning_evidence(normal: DataFrame, key: str, most: int = MOST_WARNINGS) -> DataFrame:
    """The different (slot_name, code) warnings of each subject, at most ``most``: a report, ordered by name."""
    order = Window.partitionBy(key).orderBy("slot_name", "code")
    return normal.where("code is not null").select(key, "slot_name", "code").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def warning_messages(normal: DataFrame, key: str, most: int = MOST_WARNINGS) -> DataFrame:
    """The rows behind the warnings of warning_evidence, each with what validation says of it.

    The message comes from the same row, so that no row meets another by a join, whose size the planner can't tell from a table of short JSON.
    """
    order = Window.partitionBy(key).orderBy("slot_name", "code")
    said = normal.where("code is not null").select(key, "slot_name", "code", validation_message(F.struct("kind", "type", "code")).alias("message"))
    return said.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= most).drop("n")


def index_value(s: Column) -> Column:
    """What a stored slot struct is searched by: the referenced id, else its text, else its number."""
    return F.coalesce(s["ref_entity_id"], s["value_str"], s["value_num"].cast("string"))


def values_match(a: Column, b: Column) -> Column:
    """Whether two stored slot structs say the same: one id, or equal values."""
    return F.coalesce((a["ref_entity_id"] == b["ref_entity_id"]) & (a["ref_entity_id"] != ""), F.lit(False)) | F.coalesce((a["value_str"] == b["value_str"]) | (a["value_num"] == b["value_num"]), F.lit(False))


def validation_message(s: Column, strict: bool = False) -> Column:
    """Messages for a normal slot (see normalize_slot): none, one error or one warning."""
    mark = "" if strict else "[warning] "
    return (
        F.when(s["code"] == "malformed_reference", F.lit(mark + "invalid reference"))
        .when(s["code"] == "malformed_primitive", F.lit(mark + "invalid primitive wrapper"))
        .when(s["code"].isin("bare_numeric", "entity_reference_candidate"), F.lit("[warning] bare primitive not wrapped"))
        .when((s["kind"] == "primitive") & ~s["type"].isin(*SLOT_TYPES), F.concat(F.lit("[warning] unknown type "), s["type"]))
        .when(s["code"] == "unrecognized_structure", F.lit("[warning] neither reference nor wrapper"))
    )
