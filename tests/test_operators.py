import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import candidates, canonical, events, identifiers, ingest, prototypes, reconcile, scoring, slotrefs, types, world
from kinweave.operators.hierarchy import descendants, unfold
from kinweave.operators.orphans import orphan_report, orphans
from kinweave.storage import Scratch
from kinweave.streaming import pipeline

IDS = "observation_id string, id_type string, id_value string, id_namespace string, strength string"
BINDINGS = "id_type string, id_value string, id_namespace string, entity_id string"
SLOT = "struct<kind:string,value_str:string,value_num:double,unit:string,ref_entity_id:string,ref_type:string,ref_name:string,ref_nature:string,items:array<string>>"


def test_blobs(made, got):
    docs = made([(2, "a", "s2"), (1, "a", "s1"), (3, "", "s3"), (4, None, "s4")], "ingest_seq long, content string, source_id string")
    assert got(ingest.blobs_of(docs).select("storage_path", "size_bytes", "copies")) == [("s1", 1, 2), ("s3", 0, 1)]
    known = made([], "blob_id string, source_id string")
    rows = made([(1, "b", "s"), (2, "b", "s"), (3, "b", "t")], "ingest_seq long, blob_id string, source_id string")
    assert got(ingest.new_observations(rows, known).select("ingest_seq")) == [(1,), (3,)]
    assert got(ingest.new_observations(rows, made([("b", "s")], "blob_id string, source_id string")).select("ingest_seq")) == [(3,)]
    unnamed = made([(1, "b", None), (2, "b", None), (3, None, "s"), (4, "c", None)], "ingest_seq long, blob_id string, source_id string")
    assert got(ingest.new_observations(unnamed, known).select("ingest_seq")) == [(1,), (3,), (4,)]
    assert got(ingest.new_observations(unnamed, made([("b", None)], "blob_id string, source_id string")).select("ingest_seq")) == [(3,), (4,)]


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.TXT", "b.exe", "d/c.json"):
        (tmp_path / name).write_text("x")
    base = lambda df: sorted(r["source_id"].rsplit("/", 1)[1] for r in df.collect())
    assert base(ingest.scan_files(spark, str(tmp_path))) == ["a.TXT"]
    assert base(ingest.scan_files(spark, str(tmp_path), recursive=True)) == ["a.TXT", "c.json"]
    assert base(ingest.scan_files(spark, str(tmp_path / "b.exe"), single=True)) == ["b.exe"]


def test_ids_make_one_entity(made, got):
    ids = made([("o1", "sku", "T1", "source:a", "strong"), ("o2", "sku", "T1", "source:a", "weak"), ("o3", "sku", "T2", "source:a", "weak"), ("o4", "sku", "K", "source:a", "strong")], IDS)
    links, new = identifiers.resolve_ids(ids, made([("sku", "K", "source:a", "known")], BINDINGS))
    by = {r["observation_id"]: r["entity_id"] for r in links.collect()}
    assert by["o1"] == by["o2"] != by["o3"] and by["o4"] == "known"
    assert got(new.select("id_value", "confidence")) == [("T1", 1.0), ("T2", 0.8)]


def test_overrides_counted_before_merging(made, got):
    ids = made([("o", "sku", "1", "bad ns", "odd"), ("o", "sku", "1", "worse ns", None), ("o", "sku", "1", "user:x", "weak")], IDS)
    assert identifiers.overrides(identifiers.normalized(ids, F.lit("source:c"))).count() == 2
    union = identifiers.union_ids(ids, ids.limit(0), "observation_id", F.lit("source:c"))
    assert got(union.select("id_namespace", "strength")) == [("source:c", "strong"), ("user:x", "weak")]


def test_conflicts(made, got):
    rows = made([("a", "1", "n", "x"), ("a", "1", "n", "y"), ("a", "2", "n", "x"), ("a", "2", "n", "x"), ("a", "3", "n", None)], BINDINGS)
    assert got(identifiers.conflicts(rows).select("id_value", "first_entity", "last_entity")) == [("1", "x", "y")]


def test_fallback_and_gps(made, got, spark):
    obs, seeds = made([("o1",), ("o2",)], "observation_id string"), made([("o2",)], "observation_id string")
    ids = made([("o1", "a", "2", "n", "strong"), ("o1", "a", "1", "n", "strong"), ("o2", "a", "1", "n", "strong")], IDS)
    assert got(identifiers.fallback_seeds(obs, seeds, ids).select("observation_id", "seed_index", "suggested_name")) == [("o1", 0, "a:1"), ("o1", 1, "a:2")]
    assert spark.range(1).select(F.size(identifiers.strip_gps(F.array(F.struct(F.lit("GPS").alias("id_type")), F.struct(F.lit("sku").alias("id_type")))))).first()[0] == 1


def test_nearest(made, got):
    v = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", None), ("g", [1.0, 0.0])]
    pool = made(v, "entity_id string, vector array<double>")
    q = made([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, vector array<double>")
    assert got(candidates.nearest(q, pool, 3, cell=2).select("query_id", "entity_id", "rank")) == [("q", "a", 1), ("q", "b", 3), ("q", "g", 2)]
    assert candidates.nearest(q.limit(0), pool, 3).count() == 0 and candidates.nearest(q, pool.limit(0), 3).count() == 0


def test_nearest_is_exact(spark, got, monkeypatch):
    """Many small cells, parts and turns, groups, copies and two lengths of vectors against brute force."""
    monkeypatch.setattr(candidates, "BLOCK", 16)
    monkeypatch.setattr(candidates, "QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([centres[rng.integers(0, 6, 240)] + 0.2 * rng.normal(size=(240, 8)), np.repeat(centres[:1], 40, axis=0)])
    rows = [(f"e{i:03}", "xy"[i % 2], v[i][: 8 - 3 * (i % 7 == 0)].tolist()) for i in range(len(v))]
    pool = spark.createDataFrame(rows, "entity_id string, g string, vector array<double>")
    queries = spark.createDataFrame(rows[::3], "query_id string, g string, vector array<double>")
    want = set()
    for q, g, a in rows[::3]:
        near = sorted((-round(float(np.dot(np.array(a) / np.linalg.norm(a), np.array(b) / np.linalg.norm(b))), 12), e) for e, h, b in rows if h == g and len(a) == len(b))
        want |= {(q, e, r) for r, (_, e) in enumerate(near[:7], 1)}
    found = candidates.nearest(queries, pool, 7, group="g", cell=10)
    assert {tuple(r) for r in found.select("query_id", "entity_id", "rank").collect()} == want


def test_nearest_without_shuffles_of_partners(spark, got):
    """Partners leave the task that found them with what query and entity carry; several spans give the same rows."""
    rng = np.random.default_rng(5)
    rows = [(f"e{i:03}", rng.normal(size=8).tolist(), i % 3 or None) for i in range(300)]
    pool = spark.createDataFrame(rows, "entity_id string, vector array<float>, fact int")
    queries = spark.createDataFrame([(f"q{i}", v, f"a{i}") for i, (_, v, _) in enumerate(rows[:40])], "query_id string, vector array<float>, told string")
    found = candidates.nearest(queries, pool, 9, asked=("told",), facts=("fact",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan.split("MapInArrow")[0]
    assert found.count() == 360 and found.where("cast(substr(entity_id, 2) as int) % 3 <> coalesce(fact, 0) or substr(told, 2) <> substr(query_id, 2)").count() == 0
    assert got(found) == got(candidates.nearest(queries, pool, 9, asked=("told",), facts=("fact",), span=1 << 11, cell=32))
    ordered = scoring.with_margin_in_order(found.withColumn("score", F.abs("cosine") % 0.1), "query_id")
    best = scoring.with_margin(found.withColumn("score", F.abs("cosine") % 0.1), "query_id")
    assert got(ordered.select("query_id", "entity_id", "score", "second", "margin", "pool_size")) == got(best.select("query_id", "entity_id", "score", "second", "margin", "pool_size"))


def test_aligned_by_date(made, got):
    """The pairs of align for observations with a date, without an exchange or an aggregation after the join of dates."""
    o = made([("o1", "2024-01-01", 1.0, 2.0, None, []), ("o2", "2024-01-02", None, None, None, [])], "observation_id string, o_date string, o_lat double, o_lon double, o_place string, o_species array<string>")
    e = made([("e1", "2024-01-01", 1.0, 2.0, None, []), ("e2", "2024-01-01", None, None, None, []), ("e3", None, 1.0, 2.0, None, [])], "entity_id string, e_date string, e_lat double, e_lon double, e_place string, e_species array<string>")
    links = events.links_of_pairs(events.aligned_by_date(o, e))
    assert got(links) == got(events.align(o, e)) and links.count() == 2 and "Aggregate" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_live_pool(made, got):
    e = made([("a", "class", None, "proto", [1.0]), ("b", "class", "a", "proto", [1.0]), ("c", "class", " ", "deprecated", [1.0]), ("d", "event", "", None, [1.0]), ("e", "class", None, "proto", None)], "entity_id string, entity_nature string, canonical_entity_id string, status string, v array<double>")
    assert got(candidates.live_pool(e, "v").select("entity_id")) == [("a",), ("d",)]
    assert got(candidates.live_pool(e, "v", "event").select("entity_id")) == [("d",)]
    assert got(candidates.excluding(candidates.live_pool(e, "v"), made([("a",)], "entity_id string")).select("entity_id")) == [("d",)]


@pytest.mark.parametrize("image, location, time, want", [(1.0, None, None, (1.0, 0.35**0.5, ["single_signal", "low_evidence"])), (1.0, 0.0, None, (0.7, 0.5**0.5, ["sparse_signals"])), (1.0, 1.0, 1.0, (1.0, 0.6**0.5, [])), (None, None, None, (0.0, 0.0, ["no_signals_available"]))])
def test_score(spark, image, location, time, want):
    lit = lambda x: F.lit(x).cast("double")
    r = spark.range(1).select(scoring.combined_score("individual", {"image": lit(image), "location": lit(location), "timestamp": lit(time)}).alias("s")).first()["s"]
    assert (round(r["score"], 9), round(r["coverage"], 9), r["flags"]) == (round(want[0], 9), round(want[1], 9), want[2])


def test_score_of_three_light_signals(spark):
    r = spark.range(1).select(scoring.combined_score("event", {"duration": F.lit(1.0), "det_id": F.lit(1.0), "location": F.lit(1.0)}).alias("s")).first()["s"]
    assert abs(r["score"] - (0.7 + 0.3 * 0.4**0.5)) < 1e-12


def test_weights_sum_to_one():
    assert all(abs(sum(w.values()) - 1) < 1e-12 for w in scoring.WEIGHTS.values())


def test_facet_agreement(spark):
    m = lambda **kw: F.create_map(*(F.lit(x) for kv in kw.items() for x in kv)) if kw else F.create_map().cast("map<string,string>")
    agree = lambda a, b: spark.range(1).select(scoring.facet_agreement(a, b, lambda x, y: x == y)).first()[0]
    assert [agree(m(a="1", b="2"), m(a="1", b="3")), agree(m(a="1"), m(c="1")), agree(m(), m(c="1"))] == [0.5, 0.0, None]


SCORED = "seed string, entity_id string, score double, rank int, nature string, image double, sparse boolean"
DECISIONS = [
    ([0.85], None, "link", []), ([0.849], None, "candidate", ["uncertain_match"]), ([0.60], None, "candidate", ["uncertain_match"]), ([0.599], None, "new", ["no_match_found"]),
    ([0.90, 0.86], None, "link", ["margin_review"]), ([0.90, 0.79], None, "link", []), ([0.94], 0.9, "candidate", ["uncertain_match", "high_visual_similarity"]), ([0.96], 0.9, "link", ["single_candidate"]), ([0.90, 0.5], 0.74, "candidate", ["uncertain_match"]),
]


def test_decisions(made):
    rows = [(str(i), f"e{j}", s, 0, "individual", image, False) for i, (scores, image, _, _) in enumerate(DECISIONS) for j, s in enumerate(scores)]
    out = scoring.decide(scoring.with_margin(made(rows, SCORED), "seed"))
    assert {int(r["seed"]): (r["decision"], r["flags"]) for r in out.collect()} == {i: (d, f) for i, (_, _, d, f) in enumerate(DECISIONS)}
    links = scoring.links_of(out, F.concat(F.lit("p"), F.col("seed")), "seed")
    assert links.where("seed = '1'").count() == 2 and abs(links.where("seed = '1' and entity_id = 'p1'").first()["posterior"] - 0.151) < 1e-9


def test_ties_go_to_the_nearer(made):
    best = scoring.with_margin(made([("s", "b", 0.9, 1, "class", None, False), ("s", "a", 0.9, 2, "class", None, False)], SCORED), "seed").first()
    assert (best["entity_id"], best["margin"], best["pool_size"]) == ("b", 0.0, 2)


def test_unmatched_seeds(made, got):
    seeds, none = made([("s1",), ("s2",)], "seed string"), made([("s1",)], "seed string")
    assert got(scoring.unmatched(seeds, none, F.lit("p"), "no_candidates_found", "seed").select("seed", "posterior")) == [("s2", 0.8)]


LINKS = "observation_id string, entity_id string, seed_index int, posterior double, status string, role string, flags array<string>"


def test_reconcile(made):
    rows = [("o", "e", 0, 0.9, "soft", "subject", []), ("o", "e", 1, 0.8, "soft", "context", []), ("o", "f", 0, 1.0, "hard", "subject", ["x"]), ("o", "g", 0, 1.0, "hard", "subject", []), ("o", "g", 1, 1.0, "hard", "subject", [])]
    facets = made([("o", "g", 0, "colour", "red"), ("o", "g", 1, "colour", "blue"), ("o", "f", 0, "colour", "red")], "observation_id string, entity_id string, seed_index int, facet string, value string")
    r = {(x["entity_id"], x["seed_index"]): x for x in reconcile.reconcile(made(rows, LINKS), facets).collect()}
    assert (r["e", 0]["posterior"], r["e", 0]["flags"], r["e", 0]["conflicts"]) == (0.45, ["multi_seed_role_conflict"], 2)
    assert (r["e", 1]["posterior"], r["e", 1]["flags"]) == (0.2, ["multi_seed_role_conflict", "duplicate_entity_link"])
    assert (r["f", 0]["posterior"], r["f", 0]["flags"], r["f", 0]["conflicts"]) == (1.0, ["x"], 0)
    assert (r["g", 0]["posterior"], r["g", 1]["posterior"], r["g", 1]["flags"]) == (0.5, 0.25, ["multi_seed_facet_conflict", "duplicate_entity_link"])


def test_dedup_and_canonical(made, got):
    links = made([("o", "a", 1, 0.5, "soft", "subject", []), ("o", "a", 0, 0.5, "soft", "subject", []), ("o", "b", 0, 0.7, "soft", "subject", [])], LINKS)
    assert got(reconcile.deduplicated(links).select("entity_id", "seed_index")) == [("a", 0), ("b", 0)]
    moved = reconcile.canonicalised(links, made([("a", "b"), ("b", "b")], "id string, root string"))
    assert got(moved.select("entity_id", "posterior")) == [("b", 0.7)]
    assert reconcile.above(links, 0.7).count() == 1


def test_prototypes_follow_the_fold(made):
    rows, want = [], {}
    for e, current, count in (("new", None, 0), ("old", [1.0, 2.0], 3), ("zero", [5.0, 5.0], 0)):
        p, c = current, count if current else 0
        for seq, (v, w) in enumerate((([2.0, 0.0], 1.0), ([4.0, 4.0], 0.5), ([0.0, 1.0], 0.3))):
            rows.append((e, current, count, seq, v, w))
            p = v if p is None or c == 0 else [(a * c + b * w) / (c + w) for a, b in zip(p, v)]
            c += 1
        want[e] = (p, count + 3)
    df = made(rows, "entity_id string, current array<double>, prototype_count int, seq int, vector array<double>, weight double")
    for r in prototypes.updated(df).collect():
        p, c = want[r["entity_id"]]
        assert r["prototype_count"] == c and all(abs(a - b) < 1e-9 for a, b in zip(r["prototype"], p)), r


def test_prototype_rules(made, got, spark):
    links = made([("o", "a", 0, 1.0, "hard", "subject", []), ("o", "b", 0, 0.9, "soft", "subject", []), ("o", "c", 0, 0.8, "soft", "subject", []), ("o", "d", 0, 0.9, "candidate", "subject", [])], LINKS)
    assert got(prototypes.eligible(links).select("entity_id", "weight")) == [("a", 1.0), ("b", 0.5)]
    takes = lambda s, n: spark.range(1).select(prototypes.takes_image(s, F.lit(n).cast("string"))).first()[0]
    place = F.create_map(F.lit("latitude"), F.lit("1"))
    assert [takes(place, "x"), takes(F.lit(None).cast("map<string,string>"), "x"), takes(F.lit(None).cast("map<string,string>"), None)] == [True, False, True]


def test_coherence_closed_form(made):
    r = prototypes.coherence(made([("g", [1.0, 0.0]), ("g", [0.0, 2.0]), ("g", [3.0, 0.0]), ("s", [1.0, 1.0])], "k string, vector array<double>"), "k")
    by = {x["k"]: x["coherence"] for x in r.collect()}
    assert abs(by["g"] - 1 / 3) < 1e-12 and by["s"] is None


def test_chains(spark, made, got):
    rows = made([("a", "b"), ("b", "c"), ("c", None), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("w", " ")], "id string, to string")
    chains = canonical.canonical(rows, "id", "to", Scratch(spark, "t"))
    assert got(chains) == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0), ("d", "d", 0), ("w", "w", 0), ("x", None, -1), ("y", None, -1), ("z", None, -1)]
    packed = canonical.compressed(rows, chains, "id", "to")
    assert dict(got(packed))["a"] == "c" and dict(got(packed))["x"] == "y"
    again = canonical.canonical(packed, "id", "to", Scratch(spark, "t"))
    assert got(canonical.compressed(packed, again, "id", "to")) == got(packed)


def test_hierarchy(spark, made, got):
    deep = [("t", f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(150)]
    wide = [("t", f"k{i}", "n000") for i in range(200)]
    loop = [("t", "l1", "l2"), ("t", "l2", "l1"), ("t", "l3", "l1"), ("u", "n000", None), ("t", None, "x"), ("t", "self", "self")]
    links = made(deep + wide + loop, "tree string, id string, parent string")
    nodes = unfold(links.union(links.where("id = 'n100'")), Scratch(spark, "t"), paths=True)
    by = {(r["tree"], r["id"]): r for r in nodes.collect()}
    assert len(by) == 150 + 200 + 5
    assert (by["t", "n149"]["root"], by["t", "n149"]["depth"], by["t", "n149"]["path"]) == ("n000", 149, [f"n{i:03}" for i in range(150)])
    assert by["t", "n000"]["subtree_size"] == 350 and by["t", "n100"]["subtree_size"] == 50
    pre = sorted(r["preorder"] for (t, _), r in by.items() if t == "t" and r["root"])
    assert pre == list(range(350))
    for (t, i), r in by.items():
        if r["parent"] and r["root"]:
            p = by[t, r["parent"]]
            assert p["preorder"] < r["preorder"] < p["preorder"] + p["subtree_size"]
    assert {i for (t, i), r in by.items() if r["depth"] == -1} == {"l1", "l2", "l3", "self"}
    below = descendants(nodes, made([("t", "n147"), ("t", "k1"), ("t", "l1")], "tree string, id string"))
    assert got(below.select("id", "descendant", "distance")) == [("n147", "n148", 1), ("n147", "n149", 2)]
    assert unfold(links.limit(0), Scratch(spark, "t")).count() == 0


T = dt.datetime
ENTITY = f"ingest_seq long, entity_id string, slots map<string,{SLOT}>, deleted_at timestamp, created_at timestamp, ingested_at timestamp, tbl string, target_id string"
IDROW = "ingest_seq long, id string, entity_id string, created_at timestamp, ingested_at timestamp, slot_name string"


def slot(**kw):
    return tuple(kw.get(k) for k in ("kind", "value_str", "value_num", "unit", "ref_entity_id", "ref_type", "ref_name", "ref_nature", "items"))


def test_orphans(made, got):
    day = T(2024, 1, 1)
    e = made([
        (1, "aa-01", {"owner": slot(kind="reference", ref_entity_id=" BB02 "), "m": slot(kind="reference_list", items=["cc03", None, "zz", "zz"]), "n": slot(kind="number", ref_entity_id="qq"), "s": slot(kind="reference", ref_name="ref:x")}, None, day, day, "clash", "clash"),
        (2, "bb02", None, None, day, day, None, None),
        (3, "bb02", None, day, None, day, None, None),
        (4, "cc03", None, None, day, T(2024, 3, 1), None, None),
        (5, "dd04", {"o": slot(kind="reference", ref_entity_id="cc03")}, None, None, T(2024, 2, 20), None, None),
        (6, None, {"o": slot(kind="reference", ref_entity_id="none")}, None, None, day, None, None),
        (7, "ee", {"o": slot(kind="reference", ref_entity_id="cc03")}, None, None, None, None, None),
    ], ENTITY)
    ids = made([(1, "i1", "AA01", day, day, "x"), (2, "i2", "nope", T(2024, 5, 6), day, "x"), (3, "i2", "nope2", T(2024, 5, 6), day, "x"), (4, "i3", None, day, day, "x"), (5, "i4", "  ", day, day, "x")], IDROW)
    found = orphans(e, ids)
    assert got(found) == [
        ("entities", "aa-01", "m", "cc03", "2024-01", "late"), ("entities", "aa-01", "m", "zz", "2024-01", "missing"), ("entities", "aa-01", "owner", "bb02", "2024-01", "deleted"), ("entity_deterministic_ids", "i2", "", "nope2", "2024-05", "missing"),
    ]
    assert orphan_report(found).count() == 4
    assert orphans(e.limit(0), ids.limit(0)).count() == 0 and orphans(e.limit(0), ids).count() == 2


def test_hot_parent(spark, got):
    rows = spark.range(3000).select(F.col("id").alias("ingest_seq"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("entity_id"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("ingested_at"))
    none = spark.createDataFrame([], ENTITY)
    assert orphans(none, rows).count() == 3000 and orphans(none, rows).where("target_id = 'hot' and ref_month = ''").count() == 1000


def test_event_alignment(made, got):
    o = made([("o1", "2024-01-01", 0.0, 0.0, None, ["lion"]), ("o2", None, 0.0, 0.05, None, []), ("o3", None, None, None, "near the Big Dam", ["LION", "zebra"]), ("o4", None, 0.0, 179.99, None, []), ("o5", "2024-02-02", 0.0, 0.0, None, [])], "observation_id string, o_date string, o_lat double, o_lon double, o_place string, o_species array<string>")
    e = made([("e1", "2024-01-01", 0.0, 0.0, "big dam", ["lion"]), ("e2", None, 0.0, -179.99, None, []), ("e3", None, None, None, None, [])], "entity_id string, e_date string, e_lat double, e_lon double, e_place string, e_species array<string>")
    out = {(r["observation_id"], r["entity_id"]): r for r in events.align(o, e).collect()}
    assert out["o1", "e1"]["flags"] == ["event_aligned", "date_match", "gps_proximity(0.0km)", "species_overlap"]
    assert set(out) == {("o1", "e1"), ("o3", "e1")} and out["o1", "e1"]["status"] == "soft" and abs(out["o1", "e1"]["posterior"] - 1.0) < 1e-9
    assert abs(out["o3", "e1"]["posterior"] - 0.35) < 1e-9 and out["o3", "e1"]["status"] == "candidate"
    same = events.align(o.where("observation_id = 'o4'"), e.withColumn("e_lon", F.when(F.col("entity_id") == "e2", 179.99).otherwise(F.col("e_lon"))))
    assert got(same.select("observation_id", "entity_id", "status")) == [("o4", "e2", "candidate")]


def test_participants(made, got):
    links = made([("o", "ev", 0, 0.9, "soft", "context", []), ("o", "p", 0, 0.8, "soft", "subject", []), ("o", "q", 0, 0.8, "candidate", "subject", []), ("o2", "p", 0, 0.8, "soft", "subject", [])], LINKS)
    e = made([("ev", "event", "e"), ("p", "individual", "photo_subject 1"), ("q", "individual", None)], "entity_id string, entity_nature string, name string")
    assert got(events.participants(links, e)) == [("ev", "p", "o", "subject", 0.8)]


def test_enriched_slots(spark):
    m = lambda **kw: F.create_map(*(F.lit(x) for kv in kw.items() for x in kv))
    r = spark.range(1).select(events.enriched_slots(m(location_name="here"), m(date="2024-01-01", lat="1.5", lon="2", species_1="lion", species_x_presence="yes", location="there"))).first()[0]
    assert r == {"event_date": "2024-01-01", "latitude": "1.5", "longitude": "2.0", "species": "lion", "location_name": "here"}


def test_slot_refs(made, got):
    e = made([("e", {"a": slot(kind="reference", ref_name="ref:species:Lion"), "b": slot(kind="reference", ref_name="ref:plain"), "c": slot(kind="reference", ref_name="bad"), "d": slot(kind="reference", ref_name="ref:class:Zebra", ref_nature="group"), "x": slot(kind="reference", ref_entity_id="e9", ref_name="ref:y")})], f"entity_id string, slots map<string,{SLOT}>")
    ids = made([("ref", "zebra", "class", "z"), ("ref", "plain", "ref", "old")], BINDINGS)
    natures = made([("z", "class"), ("end", "class")], "entity_id string, entity_nature string")
    r = slotrefs.resolve(slotrefs.symbolic(e), ids, natures, made([("old", "end")], "id string, root string"))
    assert {x["slot_name"]: (x["outcome"], x["target_id"]) for x in r.collect() if x["slot_name"] != "a"} == {"b": ("resolved", "end"), "c": ("invalid_name", None), "d": ("nature_conflict", None)}
    assert got(slotrefs.created(r).select("entity_nature", "name")) == [("class", "lion")]


TYPE = "type_id string, canonical_name string, aliases array<string>, parent_type_id string, status string, merged_into_type_id string, evidence_count int, created_via string"


def test_type_merge(made):
    t = made([("a", "cat", ["Feline", "kitty"], None, "stable", None, 10, "x"), ("b", "Puss", ["FELINE", "moggy"], None, "stable", None, 5, "x"), ("c", "old", None, None, "deprecated", None, 1, "x")], TYPE)
    pairs = made([("b", "a"), ("a", "a"), ("c", "a"), ("nope", "a")], "source_type_id string, target_type_id string")
    r = {x["type_id"]: x for x in types.merge(t, pairs).collect()}
    assert (r["a"]["evidence_count"], r["a"]["aliases"]) == (15, ["Feline", "kitty", "Puss", "moggy"])
    assert (r["b"]["status"], r["b"]["merged_into_type_id"]) == ("merged_into", "a") and r["c"]["status"] == "deprecated"


def test_type_split_and_alias(made, got):
    t = made([("a", "cat", ["kitty"], "root", "stable", None, 10, "via"), ("b", "dog", [], None, "deprecated", None, 1, "via")], TYPE)
    spec = lambda *names, of="a": made([(of, n) for n in names], "source_type_id string, name string")
    assert got(types.split(t, spec("lion", "tiger"), True).select("canonical_name", "parent_type_id")) == [("lion", "a"), ("tiger", "a")]
    assert got(types.split(t, spec("lion"), False).select("canonical_name", "parent_type_id")) == [("lion", "root")]
    assert [types.split(t, x, False).count() for x in (spec("lion", "dog"), spec("lion", " "), spec("lion", "lion"), spec("lion", of="b"), spec("lion", of="q"))] == [0] * 5
    assert dict(got(types.after_split(t, spec("lion"), False).select("canonical_name", "status"))) == {"cat": "deprecated", "dog": "deprecated", "lion": "provisional"}
    assert dict(got(types.after_split(t, spec("lion"), True).select("canonical_name", "status")))["cat"] == "stable"
    adds = made([("a", "KITTY "), ("a", "Dog"), ("a", "puma"), ("b", "x"), ("q", "x")], "type_id string, alias string")
    assert got(types.alias_added(t, adds).select("alias", "outcome")) == [("Dog", "conflict"), ("KITTY ", "exists"), ("puma", "added"), ("x", "inactive"), ("x", "not_found")]
    assert got(types.find_by_name(t, made([(" Kitty",), ("CAT",), ("dog",), (None,)], "name string"))) == [(" Kitty", "a", "alias"), ("CAT", "a", "name")]


def test_deprecated(made, got):
    t = made([("a", "cat", None, None, "stable", None, 10, "x"), ("b", "dog", None, None, "stable", None, 5, "x"), ("c", "old", None, None, "deprecated", None, 1, "x"), ("d", "cow", None, None, None, None, 2, "x")], TYPE)
    run = lambda *specs: {r["type_id"]: (r["status"], r["evidence_count"], r["moves_to"]) for r in types.deprecated(t, made(list(specs), "type_id string, replacement_type_id string")).collect()}
    assert run(("b", "a")) == {"a": ("stable", 15, None), "b": ("deprecated", 5, "a"), "c": ("deprecated", 1, None), "d": (None, 2, None)}
    assert run(("d", None))["d"] == ("deprecated", 2, None)
    assert run(("a", "c"), ("b", "b"), ("c", "a"), ("x", "a"), ("d", "no")) == {"a": ("stable", 10, None), "b": ("stable", 5, None), "c": ("deprecated", 1, None), "d": (None, 2, None)}


def test_redistributed_recorded_backfilled(made, got):
    t = made([("a", "cat", None, None, "deprecated", None, 10, "x"), ("n", "lion", None, "a", "provisional", None, 0, "x")], TYPE)
    obs = made([("o1", "a", "c1"), ("o2", "a", None), ("o3", "z", "c1"), ("o4", None, "c1"), ("o5", None, None)], "observation_id string, stable_type_id string, candidate_type_id string")
    rows, after = types.redistributed(obs, t, made([("o1", "n"), ("o3", "n"), ("o2", "a"), ("o9", "n")], "observation_id string, type_id string"), "a")
    assert [r[1] for r in got(rows.select("observation_id", "stable_type_id"))] == ["n", "a", "z", None, None] and dict(got(after.select("type_id", "evidence_count"))) == {"a": 10, "n": 1}
    assert [r[1] for r in got(types.backfilled(obs, made([("c1", "n")], "candidate_id string, type_id string")).select("observation_id", "stable_type_id"))] == ["a", "a", "z", "n", None]
    known = made([("k1", "Cat", "cat", "proposed", 2), ("k2", "cat!", "cat", "promoted", 3), ("k3", "Dog", "dog", "rejected", 9)], "candidate_id string, proposed_name string, normalized_name string, status string, evidence_count int")
    out = types.recorded(known, made([("CAT", 1), ("cat ", 2), ("dog", 3), ("Dog", 4), ("--", 5), (None, 6)], "n string, o int"), "n", "o")
    assert sorted((r["normalized_name"], r["proposed_name"], r["evidence_count"]) for r in out.collect()) == [("cat", "Cat", 2), ("cat", "cat!", 5), ("dog", "Dog", 9), ("dog", "dog", 2)]
    assert [(r["name"], r["is_new"]) for r in types.types_named(t, made([("lion",), ("lion",), ("puma",), (" ",), (None,)], "name string")).orderBy("name").collect()] == [("lion", False), ("puma", True)]


def test_repointed(made, got):
    rows = made([("o1", "a"), ("o2", None), ("o3", "c")], "o string, t string")
    assert got(types.repointed(rows, "t", made([("a", "b")], "old string, new string")).select("o", "t")) == [("o1", "b"), ("o2", None), ("o3", "c")]


def test_id_starts_of_many_lengths(made, got):
    ids = ["a" * 100 + "b", "a" * 40]
    starts = [("a" * n,) for n in range(1, 101)] + [("a" * 300,), ("b",)]
    out = {r[0]: r[2] for r in got(world.by_id_start(made([(i,) for i in ids], "id string"), "id", made(starts, "start string")))}
    assert out == {s: "not_found" if s in ("b", "a" * 300) else "ambiguous" if len(s) <= 40 else "found" for (s,) in starts}


def test_world(spark, made, got, tmp_path):
    assert len(world.init_world(spark, str(tmp_path))) == 13 and world.init_world(spark, str(tmp_path)) == []
    assert spark.read.parquet(f"{tmp_path}/entities.parquet").count() == 0
    assert len(world.init_world(spark, str(tmp_path), reset=True)) == 13
    e = made([("abc1",), ("abc2",), ("abd",)], "entity_id string")
    starts = made([("abc",), ("abd",), ("x",), ("",)], "start string")
    assert got(world.by_id_start(e, "entity_id", starts)) == [("abc", "abc1", "ambiguous"), ("abd", "abd", "found"), ("x", None, "not_found")]
    links = made([("o1", "a", 0, 1.0, "hard", "subject", []), ("o2", "a", 0, 0.5, "soft", "subject", [])], LINKS)
    assert got(world.link_matrix(links, ["o1", "o2"])) == [("a", "subject/hard 1.00", "subject/soft 0.50")]
    changes = made([("1", "a", "b", T(2024, 1, 1)), ("2", "c", "a", T(2024, 1, 2)), ("3", "c", "b", T(2024, 1, 3))], "evolution_id string, source_type_id string, target_type_id string, created_at timestamp")
    assert [r["evolution_id"] for r in world.history(changes, "a").collect()] == ["2", "1"]
    shown = world.show("entity", "a", {"entities": made([("a",)], "entity_id string"), "links": links})
    assert shown["entities"].count() == 1 and shown["links"].count() == 2
    dashed = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    shown = world.show("entity", dashed, {"entities": made([(dashed,)], "entity_id string"), "entity_evolutions": made([(dashed,), ("x' or '1' = '1",)], "entity_id string")})
    assert shown["entity_evolutions"].count() == 1


def test_stream_equals_batch(spark, made, got, tmp_path):
    rows = [(f"f{i}", '{"sku": "S%d", "code": "c"}' % (i % 3), i) for i in range(6)] + [("f0", '{"sku": "S0", "code": "c"}', 9), ("bad", "no json", 10), ("null", None, 11)]
    schema = "source_id string, content string, ingest_seq long"
    for part, own in enumerate((rows[:4], rows[4:])):
        made(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pipeline.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check"))
    once = pipeline.ingest_batch(made(rows, schema), {t: pipeline.state(spark, str(tmp_path / "none"), t) for t in pipeline.TABLES})
    for t, key in (("blobs", "blob_id"), ("observations", "observation_id"), ("bindings", "entity_id")):
        assert got(pipeline.state(spark, str(tmp_path / "state"), t).select(key)) == got(once[t].select(key)), t
    pairs = ("observation_id", "entity_id")
    assert got(pipeline.state(spark, str(tmp_path / "state"), "links").select(*pairs)) == got(once["links"].select(*pairs))


def test_sessions(made, got):
    at = lambda m: T(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = made([(1, at(0)), (1, at(29)), (1, at(59)), (1, at(90)), (2, at(0)), (None, at(0)), (2, None)], "user_id long, ts timestamp")
    assert got(pipeline.event_sessions(rows).select("user_id", "events")) == [(1, 1), (1, 3), (2, 1)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sessions_of_a_stream(spark, made, got, tmp_path, kind):
    at = lambda m: T(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = f"user_id long, ts {kind}"
    for minutes in ((0, 10, 59), (20, 600), (1200,)):  # the last one only moves the watermark
        made([(1, at(m)) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = pipeline.event_sessions(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName(f"sessions_{kind}").start()
    query.awaitTermination()
    assert got(spark.table(f"sessions_{kind}").select("user_id", "events")) == [(1, 1), (1, 1), (1, 3)]
