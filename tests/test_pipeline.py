import json

import pytest
from pyspark.sql import functions as F

from kinweave import cli
from kinweave.operators import extraction, resolver, types
from kinweave.storage import Scratch

IDS = "array<struct<id_type:string,id_value:string,id_namespace:string>>"


def test_extraction_by_medium(made):
    rows = [("t", "text", b"caf\xe9 noir"), ("j", "json", b'{"sku": "1", "n": 2}'), ("x", "json", b"{broken"), ("v", "video", b"\x00"), ("i", "image", b"\xff\xd8\xff"), ("n", "text", None), ("e", "text", b"")]
    df = made([(k, m, None if c is None else bytearray(c), {"bodyserialnumber": "9"}) for k, m, c in rows], "k string, medium string, content binary, tags map<string,string>")
    out = {r["k"]: r for r in extraction.extracted(df, tags="tags").collect()}
    assert out["t"]["extracted_text"] == "caf\xe9 noir" and out["j"]["extracted_text"] == "sku: 1\nn: 2" and out["j"]["ids"][0]["id_value"] == "1"
    assert out["x"]["extracted_text"] is None and out["x"]["ids"] == [] and out["v"]["note"].startswith("video") and out["i"]["ids"][0]["id_type"] == "camera_serial_number"
    assert out["n"]["size_bytes"] == 0 and out["e"]["char_count"] == 0


def test_proposed_seeds(made, got):
    df = made([("o1", "image", "/Data/x", [("upc", "5", "bad"), ("sku", "6", None)]), ("o2", "text", "12", [])], f"observation_id string, medium string, source_id string, ids {IDS}")
    rows = got(extraction.proposed(df, F.lit("source:c")).select("observation_id", "observation_kind", "suggested_name", "id_namespace", "confidence"))
    assert rows == [("o1", "image_data", "photo_subject", None, 0.6), ("o1", "image_data", "sku:6", "source:c", 1.0), ("o1", "image_data", "upc:5", "global:upc", 1.0)]


def test_merged_facets(spark):
    m = lambda **kw: F.create_map(*(F.lit(x) for kv in kw.items() for x in kv))
    assert spark.range(1).select(extraction.merged_facets(m(datetime="d", gps_latitude="1", other="x"), m(datetime="mine"))).first()[0] == {"datetime": "mine", "gps_latitude": "1"}


def test_merged_facets_of_missing_maps(spark):
    pairs = spark.sql("select * from values (null, map('datetime', 'mine')), (map('datetime', 'd', 'other', 'x'), null), (map('datetime', 'd'), map('datetime', null)), (null, null) as t(extra, facets)")
    assert [r["m"] for r in pairs.select(extraction.merged_facets(F.col("extra"), F.col("facets")).alias("m")).collect()] == [{"datetime": "mine"}, {"datetime": "d"}, {"datetime": None}, {}]


ENTITY = f"entity_id string, entity_nature string, name string, canonical_entity_id string, status string, slots map<string,{resolver.SLOT}>, prototype_image_embedding array<double>, prototype_text_embedding array<double>, prototype_count int"
OBSERVATION = "observation_id string, medium string, facets map<string,string>, seq long"
SIGNATURE = "signature_id string, observation_id string, image_embedding array<double>, text_embedding array<double>, clip_text_embedding array<double>"
SEEDS = "observation_id string, seed_index int, entity_nature string, entity_type string, suggested_name string, slots array<struct<name:string,value:string,is_reference:boolean,ref_nature:string>>, confidence double"
IDROWS = "observation_id string, seed_index int, id_type string, id_value string, id_namespace string, strength string"
KEYS = "id_type string, id_value string, id_namespace string, entity_id string"


def stored(**kw):
    return tuple(kw.get(k) for k in ("kind", "value_str", "value_num", "unit", "ref_entity_id", "ref_type", "ref_name", "ref_nature", "items"))


def entity(i, nature, image=None, text=None, name=None, merged=None, slots=None, count=1):
    return (i, nature, name, merged, "proto", slots, image, text, count)


def seed(o, nature, i=0, kind=None, name=None, slots=(), confidence=0.7):
    return (o, i, nature, kind, name, list(slots), confidence)


@pytest.fixture
def resolved(spark, made):
    def run(observations, signatures, seeds, ids, entities, bindings=(), chains=(), **more):
        t = lambda rows, schema: made(list(rows), schema)
        return resolver.resolve(t(observations, OBSERVATION), t(signatures, SIGNATURE), t(seeds, SEEDS), t(ids, IDROWS), t(entities, ENTITY), t(bindings, KEYS), t(chains, "id string, root string"), Scratch(spark, "t"), **more)

    return run


def test_resolve(resolved):
    entities = [entity("red", "individual", [1.0, 0.0, 0.0]), entity("blue", "individual", [0.0, 0.0, 1.0]), entity("old", "individual", [1.0, 0.0, 0.0], merged="red"), entity("topic", "class", None, [1.0, 0.0], "x")]
    images = {"o1": [0.99, 0.05, 0.0], "o2": [0.0, 1.0, 0.0], "o6": [1.0, 0.0, 0.0]}
    texts = {"o3": [0.6, 0.8], "o4": [1.0], "o7": [-1.0, 0.0]}
    names = [f"o{i}" for i in range(1, 8)]
    natures = {"o3": "class", "o4": "event", "o7": "class"}
    out = resolved(
        [(o, "text", None, i) for i, o in enumerate(names)], [(f"s{o}", o, images.get(o), texts.get(o), None) for o in names], [seed(o, natures.get(o, "individual")) for o in names],
        [("o6", 0, "sku", "1", "source:c", "strong"), ("o6", None, "sku", "2", "source:c", "weak")], entities, [("sku", "1", "source:c", "old")], [("old", "red")],
    )
    decisions = {r["observation_id"]: (r["decision"], r["entity_id"]) for r in out["decisions"].collect()}
    assert decisions["o1"] == ("link", "red") and decisions["o2"][0] == "new" and decisions["o3"] == ("candidate", "topic") and decisions["o7"][0] == "new" and "o4" not in decisions
    links = {(r["observation_id"], r["entity_id"]): r for r in out["links"].collect()}
    assert links["o6", "red"]["status"] == "hard" and len([k for k in links if k[0] == "o6"]) == 2 and len([k for k in links if k[0] == "o3"]) == 2
    flags = {o: r["flags"] for (o, _), r in links.items()}
    assert flags["o4"] == ["no_candidates_found"] and flags["o5"] == ["no_embedding_available"]
    assert [(r["id_value"], r["confidence"]) for r in out["bindings"].collect()] == [("2", 0.8)] and out["audit"].count() == len(links)
    made_ = {r["entity_id"]: r for r in out["entities"].collect()}
    assert len(made_) == 6 and {r["entity_nature"] for r in made_.values()} == {"individual", "class", "event"}
    assert {r["observation_id"]: r["flags"] for r in out["flags"].collect()} == {"o6": ["obs_det_ids_resolved:1"]}


def test_what_new_entities_hold(resolved):
    facets = {"gps_latitude": "1.5", "gps_longitude": "2", "datetime": "2024-01-02T03:04:05Z"}
    seeds = [seed("i", "individual", 0, "photo_subject"), seed("i", "individual", 1, None, "camera", [("datetime", "mine", False, None)]), seed("i", "class", 2, None, "lion", [("habitat", "ref:class:Plain", True, None), ("bad", "Plain", True, None), ("n", "2", False, None)]), seed("t", "group", 0)]
    out = resolved([("i", "image", facets, 1), ("t", "text", {}, 2)], [("s1", "i", None, [0.0, 1.0], None), ("s2", "i", [1.0, 0.0], [9.0, 9.0], None), ("s3", "t", None, None, [1.0, 1.0])], seeds, [], [])
    by = {(r["entity_nature"], r["name"]): r for r in out["entities"].collect()}
    subject, camera, lion, group = by["individual", None], by["individual", "camera"], by["class", "lion"], by["group", None]
    assert (subject["prototype_image_embedding"], subject["prototype_text_embedding"], subject["prototype_count"]) == ([1.0, 0.0], None, 1)
    assert (subject["slots"]["latitude"]["value_num"], subject["slots"]["datetime"]["value_str"][:19]) == (1.5, "2024-01-02T03:04:05")
    assert camera["prototype_image_embedding"] is None and camera["slots"]["datetime"]["value_str"] == "mine" and camera["prototype_count"] == 0
    assert lion["prototype_text_embedding"] == [0.0, 1.0] and lion["prototype_image_embedding"] is None and "latitude" not in lion["slots"] and lion["slots"]["n"]["value_num"] == 2.0
    plain = by["class", "plain"]
    assert lion["slots"]["habitat"]["ref_entity_id"] == plain["entity_id"] and abs(plain["confidence"] - 0.7) < 1e-9 and group["prototype_count"] == 0
    assert {r["slot_name"]: r["outcome"] for r in out["references"].collect()} == {"habitat": "created", "bad": "invalid_name"}
    assert {r["observation_id"]: r["flags"] for r in out["flags"].collect()} == {"i": ["slot_refs_unresolved:1"]}


def test_seed_identifiers(resolved):
    """An unknown key makes an entity of its seed; known ones carry facets, which may contradict each other."""
    seeds = [seed("o", "class", 0, None, "lion", [("colour", "red", False, None)]), seed("o", "class", 1, None, "cat", [("colour", "blue", False, None)]), seed("p", "group", 0, None, "herd", [("size", "3", False, None)])]
    ids = [("o", 0, "sku", "k", "n", "strong"), ("o", 1, "sku", "k", "n", "strong"), ("p", 0, "sku", "new", "n", "weak"), ("q", None, "sku", "new2", "n", "strong")]
    out = resolved([(o, "text", None, i) for i, o in enumerate("opq")], [("s", "o", None, [1.0], None)], seeds, ids, [entity("e", "class", None, [1.0], "e")], [("sku", "k", "n", "e")])
    links = {(r["observation_id"], r["entity_id"]): r for r in out["links"].collect()}
    assert links["o", "e"]["posterior"] == 0.5 and "multi_seed_facet_conflict" in links["o", "e"]["flags"] and len(links) == 3
    made_ = {r["name"]: r for r in out["entities"].collect()}
    assert made_["herd"]["entity_nature"] == "group" and made_["herd"]["slots"]["size"]["value_num"] == 3.0 and made_["sku:new2"]["entity_nature"] == "individual"


def test_prototypes_of_a_batch(resolved):
    """Hard links and sure soft ones move prototypes, in order and by one count; named entities without a place keep their image."""
    place = {"latitude": stored(kind="number", value_num=1.0)}
    entities = [entity("e", "individual", [1.0, 0.0], None, "named", slots=place, count=2), entity("n", "individual", [0.0, 1.0], [1.0, 1.0], "named", count=1), entity("keep", "individual", [5.0, 5.0], None)]
    ids = [("a", None, "k", "1", "n", "strong"), ("b", None, "k", "1", "n", "strong"), ("c", None, "k", "2", "n", "strong")]
    out = resolved([("b", "image", None, 2), ("a", "image", None, 1), ("c", "image", None, 3)], [("s1", "a", [0.0, 1.0], None, None), ("s2", "b", [4.0, 4.0], [2.0, 0.0], None), ("s3", "c", [8.0, 8.0], [3.0, 1.0], None)], [], ids, entities, [("k", "1", "n", "e"), ("k", "2", "n", "n")])
    new = {r["entity_id"]: r for r in out["prototypes"].collect()}
    close = lambda got, want: all(abs(x - y) < 1e-9 for x, y in zip(got, want))
    first = [2 / 3, 1 / 3]
    assert close(new["e"]["prototype_image_embedding"], [(x * 3 + 4) / 4 for x in first]) and close(new["e"]["prototype_text_embedding"], [2.0, 0.0]) and new["e"]["prototype_count"] == 4
    assert close(new["n"]["prototype_image_embedding"], [0.0, 1.0]) and close(new["n"]["prototype_text_embedding"], [2.0, 1.0]) and set(new) == {"e", "n"}


def test_events_and_participants(resolved):
    slots = {"event_date": stored(kind="date", value_str="2024-01-02"), "latitude": stored(kind="number", value_num=1.0), "longitude": stored(kind="number", value_num=2.0)}
    facets = {"latitude": "1.0", "longitude": "2.0", "datetime": "2024-01-02T10:00:00Z"}
    out = resolved([("i", "image", facets, 1), ("t", "text", facets, 2)], [("s", "i", [1.0, 0.0], None, None)], [seed("i", "individual", 0, "photo_subject")], [], [entity("ev", "event", name="trip", slots=slots)])
    links = {(r["observation_id"], r["role"]): r for r in out["links"].collect()}
    assert links["i", "context"]["entity_id"] == "ev" and links["i", "context"]["status"] == "soft" and abs(links["i", "context"]["posterior"] - 0.7) < 1e-9 and len(links) == 2
    assert [(r["event_id"], r["participant_id"]) for r in out["participants"].collect()] == [("ev", links["i", "subject"]["entity_id"])]
    assert out["flags"].first()["flags"] == ["event_aligned:1"]


def test_signals_and_flags(resolved):
    """Far away and at another time an alike image is uncertain, and the flags say why; facets count against wrapped slots unless unwrapped."""
    slots = {"latitude": stored(kind="number", value_num=10.0), "longitude": stored(kind="number", value_num=10.0), "datetime": stored(kind="datetime", value_str="2020-01-01T00:00:00Z")}
    world = [entity("near", "individual", [1.0, 0.0], slots=slots), entity("c", "class", None, [1.0, 0.0], "Lion", slots={"colour": stored(kind="string", value_str="tan")})]
    facets = {"latitude": "10.2", "longitude": "10", "datetime": "2024-01-01T00:00:00Z"}
    run = lambda **kw: resolved([("i", "image", facets, 1), ("t", "text", {"colour": "tan"}, 2)], [("s", "i", [1.0, 0.02], None, None), ("u", "t", None, [1.0, 0.0], None)], [seed("i", "individual"), seed("t", "class", 0, None, "lion")], [], world, **kw)["decisions"].collect()
    strict = {r["observation_id"]: r for r in run()}
    assert strict["i"]["decision"] == "candidate" and strict["i"]["flags"] == ["uncertain_match", "high_visual_similarity", "context_mismatch_gps", "context_mismatch_time"]
    assert abs(strict["t"]["score"] - 0.4 / 0.7) < 1e-9 and strict["t"]["decision"] == "new"
    assert abs({r["observation_id"]: r for r in run(unwrapped=True, names=True)}["t"]["score"] - 1.0) < 1e-9


def test_query_vector_and_empty_batch(spark, resolved):
    rows = spark.sql("select 'individual' n, cast(null as array<double>) image_embedding, array(1D) clip_text_embedding, array(2D) text_embedding union all select 'class', array(3D), array(1D), array(2D)")
    assert [r[0] for r in rows.select(resolver.query_vector(F.col("n"))).collect()] == [[1.0], [2.0]]
    assert {k: df.count() for k, df in resolved([], [], [], [], []).items()} == dict.fromkeys(("links", "entities", "bindings", "prototypes", "participants", "audit", "references", "decisions", "flags"), 0)


def test_suggested_merges(made, got):
    df = made([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "id string, v array<double>")
    assert got(resolver.suggest_merges(df, "id", "v").select("first_id", "second_id")) == [("a", "b")]


def test_candidates_merged_and_alias_removed(made):
    c = made([("a", 5, "proposed", None), ("b", 3, "proposed", None), ("c", 1, "proposed", None)], "candidate_id string, evidence_count int, status string, merged_into_candidate_id string")
    r = {x["candidate_id"]: x for x in types.candidates_merged(c, made([("b", "a"), ("a", "a"), ("c", "b"), ("q", "a")], "source_id string, target_id string")).collect()}
    assert r["a"]["evidence_count"] == 8 and r["b"]["status"] == "merged" and r["c"]["status"] == "proposed"
    t = made([("t", ["A", "b"]), ("u", None)], "type_id string, aliases array<string>")
    assert {x["type_id"]: x["aliases"] for x in types.alias_removed(t, made([("t", " a")], "type_id string, alias string")).collect()} == {"t": ["b"], "u": None}


def test_cli(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.json").write_text(json.dumps({"sku": "1"}))
    (files / "b.json").write_text(json.dumps({"sku": "1"}))
    world = str(tmp_path / "world")
    run = lambda *a: cli.run(spark, cli.parser().parse_args([world, *a]))
    assert run("init-world")["written"].count() == 13
    first = run("ingest", str(files))
    assert first["blobs"].count() == 1 and first["observations"].count() == 2 and first["links"].count() == 2
    assert run("ingest", str(files))["observations"].count() == 0
    assert all(df.count() in (0, 1) for df in run("stats").values())
    for command in (("show-world",), ("show-links",), ("show-links", "--multi"), ("search", "x"), ("type-history", "x"), ("review-candidates",), ("review-types", "--status", "stable")):
        assert all(df.count() == 0 for df in run(*command).values())
    assert list(run("show-entity", "ab")) == ["not_found"]


def test_type_commands(spark, made, tmp_path):
    folder = str(tmp_path)
    cli.world.init_world(spark, folder)
    row = lambda i, name, n: (i, name, [], None, None, "stable", None, n, "x", None)
    cli.world.replace(spark, folder, "types", made([row("a", "cat", 3), row("b", "puss", 2), row("c", "dog", 1)], cli.world.SCHEMAS["types"]))
    observed = made([("o1", "b"), ("o2", "c")], "observation_id string, stable_type_id string")
    cli.world.replace(spark, folder, "observations", spark.read.parquet(f"{folder}/observations.parquet").unionByName(observed, allowMissingColumns=True))
    run = lambda *words: {k: df.collect() for k, df in cli.run(spark, cli.parser().parse_args([folder, *words])).items()}
    now = lambda: {r["type_id"]: r for r in spark.read.parquet(f"{folder}/types.parquet").collect()}
    assert len(run("type-merge", "puss", "cat", "--dry-run")["types"]) == 2 and now()["b"]["status"] == "stable"
    assert len(run("type-merge", "puss", "cat")["types"]) == 2 and (now()["b"]["merged_into_type_id"], now()["a"]["aliases"], now()["a"]["evidence_count"]) == ("a", ["puss"], 5)
    assert run("type-alias", "cat", "Kitty")["types"][0]["aliases"] == ["puss", "Kitty"] and run("type-alias", "cat", "kitty")["types"] == []
    run("type-alias", "cat", "PUSS", "--remove")
    assert now()["a"]["aliases"] == ["Kitty"] and "not_found" in run("type-alias", "cow", "x")
    run("type-split", "cat", "lion", "tiger")
    run("type-deprecate", "dog", "--replacement", "lion")
    status = {r["canonical_name"]: r["status"] for r in now().values()}
    assert status == {"cat": "deprecated", "puss": "merged_into", "dog": "deprecated", "lion": "provisional", "tiger": "provisional"}
    lion = next(i for i, r in now().items() if r["canonical_name"] == "lion")
    assert {r["observation_id"]: r["stable_type_id"] for r in spark.read.parquet(f"{folder}/observations.parquet").collect()} == {"o1": "a", "o2": lion}
    assert [r["kind"] for r in run("type-history", "a")["type_evolution"]] == ["split", "alias", "alias", "merge"]
