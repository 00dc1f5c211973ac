import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import documents, media, names, slots, spacetime, vectors
from kinweave.plans import details


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["Wildlife Photo", "WILDLIFE_PHOTO", "Wildlife--Photo", "  wildlife photo ", "ｗｉｌｄｌｉｆｅ ｐｈｏｔｏ"])
def test_type_names(spark, text):
    assert one(spark, names.normalize_type_name(F.lit(text))) == "wildlife_photo"


def test_type_name_ligature_empty_null(made, got):
    df = made([("ﬁle_type",), ("--",), (None,)], "s string").select(names.normalize_type_name("s").alias("n"))
    assert got(df) == [("",), ("file_type",), (None,)]


@pytest.mark.parametrize("raw, want", [("ref:Leopard Species", ("ref", "leopard_species")), ("ref:wildlife:African Leopard", ("wildlife", "african_leopard")), ("ref:a:b:c", ("a", "b_c")), ("leopard", None), ("ref:", None), ("ref:x:", None)])
def test_ref_names(spark, raw, want):
    r = one(spark, names.parse_ref_name(F.lit(raw)))
    assert (r and (r["namespace"], r["name"])) == want


@pytest.mark.parametrize(
    "kind, proposed, want",
    [("gps", "source:x", ("geo:wgs84", "id_type_mapped")), ("gps", None, ("geo:wgs84", None)), ("upc", "global:upc", ("global:upc", None)), ("sku", "catalog_sku", ("source:c", "invalid_pattern")), ("sku", "", ("source:c", "empty_namespace")), ("sku", None, ("source:c", "empty_namespace")), ("sku", "user:ann-1", ("user:ann-1", None)), ("sku", "source:Upper", ("source:c", "invalid_pattern"))],
)
def test_namespaces(spark, kind, proposed, want):
    r = one(spark, names.resolve_namespace(F.lit(kind), F.lit(proposed).cast("string"), F.lit("source:c")))
    assert (r["namespace"], r["reason"]) == want


def test_name_match(spark):
    values = [one(spark, names.name_match(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("Ann", " ann "), ("Ann Lee", "ann"), ("x", "y"), ("", "x"), (None, "x"))]
    assert values == [1.0, 0.7, 0.0, None, None]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 0.5), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([None, 1.0], [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select(vectors.cosine_similarity("a", "b").alias("x"), "want")
    assert all(abs(r["x"] - r["want"]) < 1e-12 for r in df.collect())
    assert one(spark, vectors.cosine_similarity(F.lit(None).cast("array<double>"), F.array(F.lit(1.0)))) is None


def test_weighted_average(spark):
    a, b = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0))
    assert one(spark, vectors.weighted_average(a, F.lit(1), b, F.lit(1.0))) == [2.0, 4.0]
    assert one(spark, vectors.weighted_average(F.lit(None).cast("array<double>"), F.lit(1), b, F.lit(1.0))) == [3.0, 5.0]


def test_space_and_time(spark):
    assert one(spark, spacetime.dms_to_degrees(F.lit(40), F.lit(26), F.lit(46), F.lit("N"))) == 40.446111
    assert one(spark, spacetime.dms_to_degrees(F.lit(33), F.lit(51), F.lit(54), F.lit("S"))) == -33.865
    assert abs(one(spark, spacetime.haversine_km(F.lit(0), F.lit(0), F.lit(0), F.lit(1))) - 111.19) < 0.01
    assert one(spark, spacetime.exif_time(F.lit("2024:01:02 03:04:05"))) == "2024-01-02T03:04:05Z"
    two = one(spark, spacetime.time_decay(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:00:00").cast("timestamp")))
    assert abs(two - 0.716531) < 1e-6
    assert str(one(spark, spacetime.observation_time(F.lit(""), F.lit("2024-01-02T03:04:05Z")))).startswith("2024-01-02 03:04:05")
    assert one(spark, F.unix_seconds(spacetime.observation_time(F.lit("86400")))) == 86400
    assert one(spark, spacetime.observation_time(F.lit("no date"))) is None


MEDIA = [
    (b"\xff\xd8\xff\xe0", "image"), (b"\x89PNG\r\n\x1a\n", "image"), (b"GIF89a", "image"), (b"RIFF0000WEBPVP8 ", "image"), (b"BM0000", "image"), (b"II*\x00", "image"), (b"MM\x00*", "image"),
    (b"\x00\x00\x00\x18ftypisom", "video"), (b"\x00\x00\x00\x18ftypqt  ", "video"), (b"\x00\x00\x00\x18ftypheic", "image"), (b"\x00\x00\x00\x18ftypcrx ", "image"), (b"\x00\x00\x00\x18ftypM4A ", "audio"), (b"\x00\x00\x00\x18ftyp????", "video"),
    (b"\x1aE\xdf\xa3", "video"), (b"RIFF0000WAVEfmt ", "audio"), (b"RIFF0000AVI LIST", "video"), (b"ID3\x03", "audio"), (b"\xff\xfb\x90", "audio"), (b"fLaC", "audio"), (b"OggS", "audio"),
    (b'{"a": 1}', "json"), (b"[1, 2]", "json"), (b'{"a": ', "text"), (b'{"a": 1}\n{"a": 2}', "text"), (b"plain words", "text"), ("caf\xe9".encode("latin-1"), "text"), (b"", "binary"), (bytes(range(0, 32)) * 3, "binary"),
]


def test_media(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(MEDIA)], "i int, b binary").select("i", media.probe_medium("b", F.lit("x")).alias("m"))
    assert {r["i"]: r["m"] for r in df.collect()} == {i: m for i, (_, m) in enumerate(MEDIA)}


def test_medium_by_name(spark):
    for path, want in (("/a/b.CR3", "image"), ("c.jsonl", "json"), ("/x.y/noext", None), (".bashrc", None), ("a.b.mp3", "audio"), ("x.zip", None)):
        assert one(spark, media.medium_by_extension(F.lit(path))) == want
    assert one(spark, media.probe_medium(F.lit(bytearray(range(32))), F.lit("a.flac"))) == "audio"
    long_json = bytearray(json.dumps({"a": "x" * 100}).encode())
    assert one(spark, media.probe_medium(F.lit(long_json), F.lit("q"))) == "json"
    assert one(spark, media.probe_header(F.lit(long_json), F.lit("q"))) == "text"


def test_exif_ids(spark):
    tags = F.create_map(F.lit("bodyserialnumber"), F.lit(" 12 "), F.lit("lensserialnumber"), F.lit("0"), F.lit("imageuniqueid"), F.lit(""))
    assert [tuple(x) for x in one(spark, media.exif_ids(tags))] == [("camera_serial_number", "12", "source:exif")]


def test_json_features(spark):
    texts = ['{"b": 1, "a": {"sku": " X ", "ref": 2.5, "id": {"sku": "no"}}}', "[]", "not json", None, "null", '[{"id": 1}, {"id": 2}, {"id": 1}]', '{"code": true}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", documents.json_features("t").alias("f")).orderBy("i").collect()
    f = [r["f"] for r in rows]
    assert [x["valid"] for x in f] == [True, True, False, False, True, True, True]
    assert [tuple(i) for i in f[0]["ids"]] == [("sku", "X", "json")]
    assert (f[5]["key_count"], f[5]["is_array"], [i["id_value"] for i in f[5]["ids"]]) == (1, True, ["1", "2"])
    assert f[6]["ids"] == [] and f[0]["flat_text"].split("\n")[0] == "b: 1"
    same = {documents.schema_hash(json.loads(t)) for t in ('{"a": 1, "b": "x"}', '{"b": "y", "a": 2}')}
    assert len(same) == 1 and documents.schema_hash({"a": 1, "b": "x", "c": 0}) not in same
    assert documents.schema_hash({"k": 1}) == hashlib.sha256(b'{"properties":{"k":{"type":"integer"}},"type":"object"}').hexdigest()[:16]


def test_flatten_bounds():
    assert documents.flatten({"a": list(range(12))}).split("\n")[-1] == "a: ... (12 items)"
    assert documents.flatten({"a": "x" * 300}) == "a: " + "x" * 200 + "..."
    assert len(documents.flatten({str(i): i for i in range(500)}).split("\n")) == 200
    assert documents.flatten({"a": None, "b": True}) == "a: null\nb: True"


def test_text(spark):
    f = one(spark, documents.text_features(F.lit("x" * 8001)))
    assert (len(f["extracted_text"]), f["char_count"], f["truncated"]) == (8000, 8001, True)
    assert one(spark, documents.decoded(F.lit(bytearray("caf\xe9".encode("latin-1"))))) == "caf\xe9"
    assert one(spark, documents.decoded(F.lit(bytearray("café €".encode())))) == "café €"


def test_extension_points(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    assert sorted(r["embedding"] for r in documents.embed_with(df, "t", lambda s: s.map(lambda x: [float(len(x))])).collect()) == [[1.0], [2.0]]
    lengths = lambda s: pd.DataFrame({"n": s.str.len().astype("int32")})
    lengths.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    out = documents.extract_with(df, "t", lengths, "n int")
    assert sorted(r["extracted"]["n"] for r in out.collect()) == [1, 2]


SLOTS = [
    ('{"title": "x"}', ("title", "primitive", "x", "string", None)), ('{"species": "x"}', ("species", "primitive", "x", "string", "entity_reference_candidate")), ('{"n": 3}', ("n", "primitive", "3", "integer", "bare_numeric")), ('{"n": 3.5}', ("n", "primitive", "3.5", "number", "bare_numeric")), ('{"b": true}', ("b", "primitive", "true", "boolean", None)),
    ('{"w": {"value": 3, "type": "number"}}', ("w", "primitive", "3", "number", "missing_unit")), ('{"w": {"value": 3, "type": "number", "unit": "kg"}}', ("w", "primitive", "3", "number", None)), ('{"w": {"value": "a"}}', ("w", "primitive", "a", "string", "malformed_primitive")),
    ('{"r": {"ref_entity_id": "e", "ref_type": "t"}}', ("r", "reference", None, None, None)), ('{"r": {"ref_entity_id": "e"}}', ("r", "passed", '{"ref_entity_id":"e"}', None, "malformed_reference")), ('{"d": {"z": 1}}', ("d", "passed", '{"z":1}', None, "unrecognized_structure")), ('{"z": null}', ("z", "null", None, None, None)),
]


def test_slots(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SLOTS)], "k int, s string")
    rows = {r["k"]: tuple(r)[1:] for r in slots.normalize_slots(df, "k", "s").select("k", "slot_name", "kind", "value", "type", "code").collect()}
    assert rows == {i: w for i, (_, w) in enumerate(SLOTS)}


def test_slot_lists_and_bad_texts(spark, got):
    df = spark.createDataFrame([(1, '{"a": [1, "x", null]}'), (2, "no json"), (3, None), (4, "{}"), (5, "[1]")], "k int, s string")
    assert got(slots.normalize_slots(df, "k", "s").select("k", "slot_name", "kind", "code")) == [(1, "a[0]", "primitive", "bare_numeric"), (1, "a[1]", "primitive", None), (1, "a[2]", "null", None)]


def test_warning_cap(spark):
    df = spark.createDataFrame([(1, json.dumps({f"n{i:02}": i for i in range(30)}))] * 2, "k int, s string")
    assert slots.warning_evidence(slots.normalize_slots(df, "k", "s"), "k").count() == 20


def test_warning_messages(spark, got, small):
    """Each warning has the message of its own row, and none is looked up by a join, which would be broadcast."""
    df = spark.createDataFrame([(1, '{"w": 3}'), (1, '{"w": {"value": 3, "type": "number"}}'), (2, json.dumps({f"n{i:02}": i for i in range(30)})), (2, '{"n00": 0, "n29": 1}')], "k int, s string")
    rows = got(slots.warning_messages(slots.normalize_slots(df, "k", "s"), "k"))
    bare = "[warning] bare primitive not wrapped"
    assert rows == sorted([(1, "w", "bare_numeric", bare), (1, "w", "missing_unit", None), (2, "n00", "bare_numeric", bare), *((2, f"n{i:02}", "bare_numeric", bare) for i in range(20))], key=repr)
    assert "Join" not in details.slot_warnings(spark, small)._jdf.queryExecution().optimizedPlan().toString()


RICH = {
    "b": [{"x": [1, 2, {"deep": None}], "SKU": " s-1 "}, 7], "a": {"": 0, "k.d": True, "n": -2.5}, "code": "", "ref": {"id": 1}, "uuid": False, "items": [{"item_id": i} for i in range(12)], "e": [], "o": {}, "u": "ü\n€",
}


def test_rich_json():
    lines = documents.flatten(RICH).split("\n")
    assert lines[:3] == ["b[0].x[0]: 1", "b[0].x[1]: 2", "b[0].x[2].deep: null"] and "a.k.d: True" in lines and "items: ... (12 items)" in lines and lines[-2:] == ["u: ü", "€"]
    assert documents.scan_ids(RICH) == [("sku", "s-1", "json")] + [("item_id", str(i), "json") for i in range(12)]
    schema = documents.infer_schema(RICH)["properties"]
    assert schema["b"]["items"]["properties"]["x"] == {"type": "array", "items": {"type": "integer"}} and schema["e"] == {"type": "array", "items": {"type": "any"}}
    assert schema["a"]["properties"] == {"": {"type": "integer"}, "k.d": {"type": "boolean"}, "n": {"type": "number"}} and schema["o"] == {"type": "object", "properties": {}}


def test_json_bounds():
    deep = {"id": 1}
    for _ in range(10):
        deep = {"n": deep}
    assert documents.scan_ids(deep) == [] and documents.scan_ids(deep, levels=None) == [("id", "1", "json")]
    long = [{"id": i} for i in range(150)]
    assert len(documents.scan_ids(long)) == 100 and len(documents.scan_ids(long, items=None)) == 150
    assert documents.infer_schema([[[[[[1]]]]]]) == {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "array", "items": {"type": "any"}}}}}}
    assert documents.flatten("x") == ": x" and documents.flatten([]) == "" and documents.infer_schema(None) == {"type": "null"}
    # A list that began before the last line is noted after it; one that begins later isn't.
    many = documents.flatten({"l": [{str(i): i for i in range(30)}] * 12, "m": list(range(20))}).split("\n")
    assert len(many) == 201 and many[-1] == "l: ... (12 items)"


def test_default_embedder(spark):
    df = spark.createDataFrame([("a b",), ("B a",), (None,), ("...",)], "t string")
    v = [r["embedding"] for r in documents.embed_with(df, "t", batch=1).collect()]
    assert v[0] == v[1] and v[2] is None and v[3] is None and abs(sum(x * x for x in v[0]) - 1) < 1e-6


def test_probe_parses_no_other_media(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xd8\xff{"), "a"), (bytearray(b"[1"), "b"), (bytearray("\u00a0 [1]".encode()), "c"), (bytearray(b"\xe9" * 5), "d"), (None, "e.txt")], "b binary, p string")
    assert [r["m"] for r in df.select(media.probe_medium("b", "p").alias("m")).collect()] == ["image", "text", "json", "text", "binary"]


def test_merged_features_and_slot_checks(spark):
    r = spark.sql("""select struct('h' hash_value, 'old' extracted_text, array('1') ids, map('a', '1', 'b', '2') extra) base, struct(cast(null as string) hash_value, 'new' extracted_text, array('1', '2') ids, map('b', '3') extra) other""")
    m = r.select(documents.merge_features(F.col("base"), F.col("other")).alias("m")).first()["m"]
    assert (m["hash_value"], m["extracted_text"], m["ids"], m["extra"]) == ("h", "new", ["1", "2"], {"a": "1", "b": "3"})
    s = lambda ref, text, num: F.struct(F.lit(ref).cast("string").alias("ref_entity_id"), F.lit(text).cast("string").alias("value_str"), F.lit(num).cast("double").alias("value_num"))
    same = [one(spark, slots.values_match(s(*a), s(*b))) for a, b in ((("e", None, None), ("e", "x", None)), ((None, "x", None), (None, "x", 1)), ((None, None, 2), (None, None, 2)), (("e", None, None), ("f", None, None)), ((None, None, None), (None, None, None)))]
    assert same == [True, True, True, False, False]
    say = lambda code, kind, type_, strict=False: one(spark, slots.validation_message(F.struct(F.lit(code).cast("string").alias("code"), F.lit(kind).alias("kind"), F.lit(type_).cast("string").alias("type")), strict))
    assert say("malformed_reference", "passed", None) == "[warning] invalid reference" and say("malformed_reference", "passed", None, True) == "invalid reference"
    assert say(None, "primitive", "blob") == "[warning] unknown type blob" and say(None, "primitive", "url") is None and say("unrecognized_structure", "passed", None).startswith("[warning] neither")
    assert one(spark, spacetime.observation_date(F.lit("2024-03-04 23:59:59").cast("timestamp"))) == "2024-03-04"


@pytest.mark.parametrize("policy", ["EXCEPTION", "LAST_WIN"])
def test_merged_maps(spark, policy):
    key = "spark.sql.mapKeyDedupPolicy"
    before = spark.conf.get(key)
    spark.conf.set(key, policy)
    try:
        pairs = spark.sql("select * from values (map('a', '1', 'b', '2'), map('b', '3', 'c', '4')), (map('a', '1'), map('a', null)), (map('a', null), map()), (null, map('a', '1')), (map('a', '1'), null), (null, null) as t(base, other)")
        got = [r["m"] for r in pairs.select(documents.merged_maps(F.col("base"), F.col("other")).alias("m")).collect()]
    finally:
        spark.conf.set(key, before)
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"a": None}, {"a": None}, {"a": "1"}, {"a": "1"}, {}]
