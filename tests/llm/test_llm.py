import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import canonical, groups, neighbours, packing, plans, ranking, seen, subjects, tokens
from kinweave.llm.vptree import VPTree, shard_search
from kinweave.storage import Scratch

# 1. Seen keys

BLOB = "ingest_seq long, sha256 string, tbl string, key string"


def seen_by_batches(spark, tmp_path, batches, schema, key, order="ingest_seq"):
    scratch = Scratch(spark, "t")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        firsts = seen.first_sightings(seen.keyed(stream, "t", key(), order), scratch)
    rows = seen.keyed(spark.read.schema(schema).parquet(str(tmp_path / "in")), "t", key(), order)
    return rows, firsts


def test_seen_blobs(spark, tmp_path, got):
    d = "ab" * 32
    rows = [(5, d, "x", "y"), (1, f" SHA256:{d.upper()}\n", None, None), (2, f"sha256:{d}", None, None), (3, " ", None, None), (4, None, None, None), (6, "cd", None, None), (7, "sha256:", None, None)]
    keyed, firsts = seen_by_batches(spark, tmp_path, [rows], BLOB, seen.blob_key)
    assert got(seen.repeats(keyed, firsts)) == [("t", 2), ("t", 5)]
    r = seen.rates(keyed, firsts).first()
    assert (r["keyed_rows"], r["first_rows"], r["repeat_rows"]) == (4, 2, 2) and r["wrong_rate"] < 1e-30


def test_seen_across_batches_in_any_order(spark, tmp_path, got):
    """A later batch brings an earlier sighting; the checkpoint keeps the keys between runs."""
    batches = [[(5, "aa", None, None), (6, "bb", None, None)], [(7, "aa", None, None), (3, "aa", None, None)], [(8, "bb", None, None), (9, "cc", None, None)]]
    keyed, firsts = seen_by_batches(spark, tmp_path, batches, BLOB, seen.blob_key)
    assert got(seen.repeats(keyed, firsts)) == [("t", 5), ("t", 7), ("t", 8)]


def test_seen_identifiers_and_hot_key(spark, tmp_path, got):
    schema = "ingest_seq long, id_type string, id_value string, id_namespace string"
    rows = [(1, "SKU", " a ", None), (2, "sku ", "a", " "), (3, "sku", "A", ""), (4, "sku", "a", "N"), (5, None, "a", "n"), (6, "sku", "", "n"), (7, "a|1:b", "c", "n"), (8, "a", "b|1:c", "n")] + [(100 + i, "hot", "k", "n") for i in range(300)]
    keyed, firsts = seen_by_batches(spark, tmp_path, [rows], schema, seen.identifier_key)
    assert [r for r in got(seen.repeats(keyed, firsts)) if r[1] < 100] == [("t", 2)]
    assert seen.repeats(keyed, firsts).count() == 1 + 299


def test_seen_empty(spark, tmp_path):
    keyed, firsts = seen_by_batches(spark, tmp_path, [[]], BLOB, seen.blob_key)
    assert seen.repeats(keyed, firsts).count() == 0


# 2. Nearest vectors


def brute(ids, v, k, least):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = set()
    for i in range(len(ids)):
        cos = np.round(u @ u[i], 7)
        order = sorted((j for j in range(len(ids)) if j != i and cos[j] >= least), key=lambda j: (-cos[j], ids[j]))
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order[:k]}
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(150, 64))
    v = np.concatenate([centres + rng.normal(size=centres.shape) * s for s in (0, 0.1, 0.2, 0.25)] + [rng.normal(size=(900, 64)), np.repeat(centres[:1], 40, axis=0) * rng.choice([0.5, 1, 2, 4], size=(40, 1))])
    return [f"{i:05}" for i in rng.permutation(len(v))], v.astype(np.float32)


def nearest(spark, ids, v, **options):
    rows = [("f", i, c) for i, c in zip(ids, neighbours.encode(v.astype(float)))]
    vectors = spark.createDataFrame(rows, "field string, id string, code binary").withColumn("id", neighbours.packed(F.col("id")))
    return neighbours.all_nearest(vectors, Scratch(spark, "t"), **options)


def test_factor_one_is_exact(spark, cloud, got):
    ids, v = cloud
    found = neighbours.similar_pairs(nearest(spark, ids, v, factor=1.0, shard_factor=1.0, trees=1, shard=400, leaf=64))
    assert {tuple(r)[1:] for r in found.collect()} == brute(ids, v, 5, 0.92)


def test_relaxed_recall(spark, cloud):
    ids, v = cloud
    want = brute(ids, v, 5, 0.92)
    found = {tuple(r)[1:] for r in neighbours.similar_pairs(nearest(spark, ids, v, shard=400, leaf=64)).collect()}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


def test_several_shards_lose_next_to_nothing(spark, cloud):
    ids, v = cloud
    want = brute(ids, v, 5, 0.92)
    found = {tuple(r)[1:] for r in neighbours.similar_pairs(nearest(spark, ids, v, shard=200, leaf=64)).collect()}
    assert len(found & want) >= 0.99 * len(want) and len(found - want) <= 0.01 * len(want)


def test_shards_are_made_for_visitors_too(spark):
    """The number of a shard stays below MOST_SHARDS, so shards of different trees and fields never mix."""
    codes = neighbours.encode(np.random.default_rng(3).normal(size=(3000, 64)))
    points = spark.createDataFrame([("f", c) for c in codes], "field string, code binary")
    for shard, leaves in ((3000, 1), (2999, 16), (375, 64), (2, neighbours.MOST_SHARDS)):
        assert {t.leaves for t in neighbours._routers(points, {"f": 3000}, 2, shard, 2900)["f"]} == {leaves}


def test_shards_are_dealt_again(spark, cloud):
    """More shards than one tree tells apart: exact at factor one, hardly a loss else, and no pair across fields."""
    ids, v = cloud
    codes = neighbours.encode(v.astype(float))
    rows = [(f, i, c) for f in ("f", "g") for i, c in zip(ids, codes)] + [("h", i, c) for i, c in zip(ids[:150], codes)]
    vectors = spark.createDataFrame(rows, "field string, id string, code binary").withColumn("id", neighbours.packed(F.col("id")))
    run = lambda **o: {tuple(r) for r in neighbours.similar_pairs(neighbours.all_nearest(vectors, Scratch(spark, "t"), shard=200, most=4, leaf=64, **o)).collect()}
    want = {(f, *p) for f in ("f", "g") for p in brute(ids, v, 5, 0.92)} | {("h", *p) for p in brute(ids[:150], v[:150], 5, 0.92)}
    assert run(factor=1.0, shard_factor=1.0) == want
    found = run()
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)


def test_shard_search_exact(cloud):
    _, v = cloud
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b, c = shard_search(u, np.ones(len(u), bool), 5, 0.9, 1.0, 32)
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    worst = {}
    for i, x in zip(a, c):
        worst[i] = min(worst.get(i, 2), x)
    for i in range(len(u)):
        best = np.sort(cos[i])[::-1][:5]
        best = best[best >= 0.9]
        assert (len(best) == 0) == (i not in worst) and (len(best) == 0 or abs(worst[i] - best[-1]) < 1e-5)


def test_tree_of_copies():
    same = np.repeat(np.eye(4, dtype=np.float32)[:1], 100, axis=0)
    row, leaf, home = VPTree.build(same, 8).route(same)
    assert len(row) == 100 and home.all()


def test_unusable_vectors(spark, got):
    good = [1.0] + [0.0] * 63
    rows = [(1, "a", good), (2, "b", [2.0 * x for x in good]), (3, "c", good[:63]), (4, "d", [None] + good[1:]), (5, "e", [float("nan")] + good[1:]), (6, "f", [0.0] * 64), (7, "g", None), (8, "h", [float("inf")] + good[1:]), (1, "i", good), (2, "i", None), (3, "j", []), (9, None, good)]
    df = spark.createDataFrame(rows, "ingest_seq long, x string, v array<float>")
    now = neighbours.current_directions(df, "x", {"v": "v"})
    assert got(now.select(neighbours.unpacked(F.col("id")).alias("id"))) == [("a",), ("b",)]
    assert got(neighbours.similar_pairs(neighbours.all_nearest(now, Scratch(spark, "t")))) == [("v", "a", "b")]
    assert neighbours.all_nearest(now.limit(0), Scratch(spark, "t")).count() == 0


def test_packed_ids(spark, got):
    ids = ["", "é", "0" * 32, "0f" * 16, "0F" * 16, "g" * 32, "a", "\x01b"]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select("i", neighbours.packed(F.col("i")).alias("p"))
    assert all(r["i"] == r["u"] for r in df.withColumn("u", neighbours.unpacked(F.col("p"))).collect()) and df.select("p").distinct().count() == len(ids)


def test_many_copies_stay_linear(spark):
    v = np.repeat(np.random.default_rng(1).normal(size=(1, 64)), 500, axis=0)
    ids = [f"{i:04}" for i in range(500)]
    pairs = {tuple(r)[1:] for r in neighbours.similar_pairs(nearest(spark, ids, v)).collect()}
    assert pairs == brute(ids, v, 5, 0.92) and len(pairs) < 5 * 500


# 3. Names

CATALOG = [("t1", "leopard_measurement", ["leopard reading", "tc552w"]), ("t2", "furniture_record", None), ("t3", "furniture_recording", []), ("t4", "photo_of_the_day", ["", None]), ("t5", None, ["Theatre Bill"])]
NAMES = {
    "Leopard Measurement": "t1", "leopardMeasurement": "t1", "ｌｅｏｐａｒｄ ｒｅａｄｉｎｇｓ": "t1", "leo​pard_measurment": "t1", "tc552w": "t1", "TC552W ": "t1", "tc552x": "", "measurement, leopard": "t1", "the leopard measurement (draft)": "t1", "lepoard_measuremnet": "t1", "léopard measurement": "t1",
    "furniturerecord": "t2", "recordfurniture": "t2", "furniturerecording": "t3", "furniture": "", "record": "", "leopard password": "", "n/a": "", "  ": "", "": "", "???": "", "theatre-bill": "t5", "day photo": "t4", "x" * 5000: "",
}


def test_names(spark):
    names = list(NAMES) + [None]
    rows = [(i, f"c{i}", n, "clash") for i, n in enumerate(names)] + [(-1, "c0", "furniture_record", "old version")]
    df = spark.createDataFrame(rows, "ingest_seq long, candidate_id string, proposed_name string, type_id string")
    catalog = spark.createDataFrame(CATALOG, "type_id string, canonical_name string, aliases array<string>")
    mapped = canonical.map_names(df.select(F.col("proposed_name").alias("name")), catalog, Scratch(spark, "t"))
    out = {r["candidate_id"]: r["type_id"] for r in canonical.assign(df, mapped).collect()}
    assert out == {f"c{i}": NAMES.get(n, "") for i, n in enumerate(names)}
    none = canonical.map_names(df.select(F.col("proposed_name").alias("name")), catalog.limit(0), Scratch(spark, "t"))
    assert none.count() == 0 and canonical.assign(df.limit(0), none).count() == 0


SWAPPED = {"pyaroll ibll": "p1", "safrai hpoto": "p2", "loepard ercord": "p3", "oevrhead hpoto": "p4", "a note on the leopard record that was found by the river": "p3", "mat": "", "bat": "", "my cat": "p5", "mycat": "p5", "cat": "p6"}


def test_names_with_an_error_in_each_word(spark):
    """However little alike a name and its entry are as a whole; short words alone allow no error."""
    catalog = spark.createDataFrame([("p1", "payroll bill", None), ("p2", "safari photo", None), ("p3", "leopard record", None), ("p4", "overhead photo", None), ("p5", "my cat", None), ("p6", "cat", None)], "type_id string, canonical_name string, aliases array<string>")
    mapped = canonical.map_names(spark.createDataFrame([(n,) for n in SWAPPED], "name string"), catalog, Scratch(spark, "t"))
    assert {r["name"]: r["type_id"] for r in mapped.collect()} == {n: t for n, t in SWAPPED.items() if t}


def test_every_form_that_cost_accepts_is_met(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdies") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["the", "of", "a1", "tc5w", "ladies"]
    forms = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))) for _ in range(150)})
    names = set()
    for _ in range(400):
        words = [w for f in rng.sample(forms, rng.randint(1, 2)) for w in f.split(" ")]
        rng.shuffle(words)
        for i, w in enumerate(words):
            at, kind = rng.randrange(len(w)), rng.random()
            words[i] = w[:at] + w[at + 1 :] if kind < 0.2 and len(w) > 1 else w[:at] + "x" + w[at:] if kind < 0.4 else w[:at] + w[at + 1 : at + 2] + w[at] + w[at + 2 :] if kind < 0.6 else w + "s" if kind < 0.7 else w
        names.add("".join(words) if rng.random() < 0.4 else " ".join(words))
    want = {(n, f) for n in names for f in forms if canonical.cost(n.split(" "), f.split(" ")) is not None}
    catalog = canonical.forms_of(spark.createDataFrame([(f"t{i}", f, None) for i, f in enumerate(forms)], "type_id string, canonical_name string, aliases array<string>"))
    met = canonical.candidate_pairs(spark.createDataFrame([(n,) for n in names], "words string"), catalog, Scratch(spark, "t"))
    assert len(want) > 300 and want <= {tuple(r) for r in met.collect()}


@given(st.text("abc", min_size=1, max_size=9), st.integers(1, 3), st.randoms(use_true_random=False))
def test_one_piece_is_whole(word, errors, rng):
    text = word
    for _ in range(errors):
        at, kind = rng.randint(0, len(text)), rng.randrange(4)
        text = text[:at] + text[at + 1 :] if kind == 0 else text[:at] + "x" + text[at:] if kind == 1 else text[:at] + "x" + text[at + 1 :] if kind == 2 else text
    for _ in range(errors):
        at = rng.randint(0, len(word))
        swapped = word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]
        for t in (text, swapped):
            assert any(t.startswith(p, i) for a, p in canonical.pieces(word, errors) for i in range(max(0, a - errors), a + errors + 1)) or canonical.edits(word, t, errors) > errors


def test_forms_of_many_words():
    form = "annual report about protected wetland birds observed near rivers".split()
    swapped = [w[1] + w[0] + w[2:] for w in reversed(form)]
    assert canonical.cost(swapped, form) == len(form) and canonical.cost(form[1:], form) is None
    assert canonical.cost(["".join(form[3:] + form[:3])], form) == 0.25
    assert canonical.cost(["".join(swapped)], form) == 9.25 and canonical.cost(["".join(form[1:])], form) is None
    assert canonical.cost(["reports", "reportx"], ["report", "reports"]) == 1.0


def test_set_join_is_exact(spark):
    rng = random.Random(3)
    sets = [sorted({rng.choice("abcdefghij") + rng.choice("ab") for _ in range(rng.randint(1, n))}) for n in [12] * 80 + [3] * 60]
    left = spark.createDataFrame([(i, s) for i, s in enumerate(sets[:80])], "l long, tokens array<string>")
    right = spark.createDataFrame([(i, s) for i, s in enumerate(sets[80:])], "r long, tokens array<string>")
    want = {(i, j) for i, a in enumerate(sets[:80]) for j, b in enumerate(sets[80:]) if set(b) <= set(a)}
    assert len(want) > 50 and {(r["l"], r["r"]) for r in canonical.covered_sets(left, right).collect()} == want


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edits_are_symmetric(a, b):
    assert canonical.edits(a, b, 2) == canonical.edits(b, a, 2) and (canonical.edits(a, b, 2) == 0) == (a == b)


# 5. Groups


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
        parent[find(a)] = find(b)
    out = {}
    for n in parent:
        out.setdefault(find(n), set()).add(n)
    return list(out.values())


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loop"])
def test_groups(spark, shape):
    rng = random.Random(1)
    edges = {"chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)], "star": [("hub", f"n{i:03}") for i in range(600)], "random": [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(150)], "loop": [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "b"), ("b", "a")]}[shape]
    nodes = sorted({x for e in edges for x in e} | {"lonely"})
    df = spark.createDataFrame([("t", a, b) for a, b in edges] + [("t", "a", None), ("u", "hub", "other")], "tbl string, a string, b string")
    listed = spark.createDataFrame([("t", n) for n in nodes if n != "n007"] + [("u", "hub")], "tbl string, id string")
    want = {n: min(g - {"n007"}) for g in components(edges, nodes) if len(g - {"n007"}) > 1 for n in g - {"n007"}}
    out = groups.group_ids(df, listed, Scratch(spark, "t")).collect()
    assert {r["id"]: r["group_id"] for r in out} == want and all(r["tbl"] == "t" for r in out)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([("t", "a", None)], "tbl string, a string, b string")
    assert groups.group_ids(df, spark.createDataFrame([("t", "a")], "tbl string, id string"), Scratch(spark, "t")).count() == 0


# 6. Ranking

RESULT = "result_id string, observation_id string, entity_id string, score double, image_similarity double, text_similarity double, signals array<struct<signal_name:string,score:double,weight:double,available:boolean>>, created_at timestamp, item string"


def result(i, o, e, image, text, *signals):
    return (f"r{i}", o, e, 1e9 if e == "b" else 0.0, image, text, [(n, s, 1.0, a) for n, s, a in signals], dt.datetime(2024, 1, 1), "clash")


def test_ranking(spark, got):
    rng = random.Random(2)
    noise = [result(100 + i, f"z{i % 40}", f"e{i}", rng.uniform(0.5, 0.7), rng.uniform(0, 100), ("big", rng.expovariate(0.001), True)) for i in range(400)]
    rows = noise + [
        result(1, "o1", "a", 0.69, 95.0, ("big", 10.0, True)), result(2, "o1", "b", 0.52, 5.0, ("big", 1e7, True)), result(2, "o1", "b", 0.52, 5.0, ("big", 1e7, True)),
        result(3, "o2", "b", 0.6, None, ("big", 1e12, False), ("x", None, True)), result(4, "o2", "a", 0.61, float("nan")), result(5, "o3", "z", 0.6, 50.0), result(6, "o3", "y", 0.6, 50.0), result(7, None, "y", 0.6, 50.0), result(8, "o4", "only", None, None),
    ]
    df = spark.createDataFrame(rows, RESULT)
    best = {r["group_id"]: r["member"] for r in ranking.first_of_each(ranking.closeness(ranking.long_scores(df), Scratch(spark, "t"))).collect()}
    assert (best["o1"], best["o2"], best["o3"]) == ("a", "a", "y") and "o4" not in best
    scaled = df.withColumn("image_similarity", F.col("image_similarity") * 1000 - 7).withColumn("text_similarity", F.col("text_similarity") / 9)
    again = {r["group_id"]: r["member"] for r in ranking.first_of_each(ranking.closeness(ranking.long_scores(scaled), Scratch(spark, "t"))).collect()}
    assert again == best
    assert ranking.first_of_each(ranking.closeness(ranking.long_scores(df.limit(0)), Scratch(spark, "t"))).count() == 0
    only = ranking.closeness(ranking.long_scores(df), Scratch(spark, "t"), {"image_similarity": 0.0, "signal big": 0.0})
    assert {r["group_id"] for r in only.collect()} & {"o1", "o2", "o3"} == {"o1", "o3"}  # by text alone
    flat = spark.createDataFrame([("i1", "g", "a", "c", 5.0), ("i2", "g", "b", "c", 5.0), ("i3", "g", "z", "n", 0.0)], "item string, group_id string, member string, criterion string, score double")
    assert got(ranking.closeness(flat, Scratch(spark, "t"))) == [("g", "a", 0.5), ("g", "b", 0.5), ("g", "z", 0.5)]
    assert ranking.full_ranking(ranking.closeness(ranking.long_scores(df), Scratch(spark, "t"))).where("place = 1").count() == len(best)


# 8. Tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(*tokens.read_vocabulary())


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_any_text(encoder, reference_tokenizer, text):
    ids = encoder.encode(text)
    assert ids == reference_tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.Decoder(encoder.ids).decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "ing", "=", "-", "é", "的", "x" * 30, "er"]), min_size=1, max_size=80))
def test_long_pieces(encoder, reference_tokenizer, parts):
    text = "".join(parts)
    assert encoder.encode(text) == reference_tokenizer.encode(text, add_special_tokens=False).ids


def test_stream_in_chunks(encoder):
    data = "".join(random.Random(5).choices("abcdeinorst", k=5000)).encode()
    whole = list(encoder.stream([data]))
    assert list(encoder.stream([data[i : i + 7] for i in range(0, len(data), 7)])) == whole


def test_tokens_leave_before_the_end(encoder):
    went = []

    def chunks():
        for _ in range(40):
            yield b"abracadabra" * 100
            went.append(len(out))

    out = []
    for i in encoder.stream(chunks()):
        out.append(i)
    assert went[-1] > 0.9 * len(out)


def test_decoder_holds_unfinished_characters(encoder):
    ids = encoder.encode("🐆")
    assert len(ids) > 1 and "".join(tokens.Decoder(encoder.ids).stream(ids)) == "🐆"
    assert tokens.Decoder(encoder.ids).decode(ids[:1]) == "�"


def test_encoded_table(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b", 9), (2, "", 9), (3, None, 9), (4, "x " * 50000, 9), (None, "a", 9)], "doc_id long, text string, ids int")
    rows = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert rows[2] == rows[3] == [] and 50256 not in rows[1] and len(rows[4]) > 40000 and rows[None] == [64]
    assert {r["doc_id"]: r["n"] for r in tokens.token_counts(df).collect()} == {k: len(v) for k, v in rows.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


# 9. Packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_holds_everything(histogram):
    held: dict[int, int] = {}
    for used, times in packing.plan(histogram, 40):
        assert sum(n * m for n, m in used.items()) <= 40 and times > 0
        for n, m in used.items():
            held[n] = held.get(n, 0) + m * times
    assert held == histogram


@given(st.dictionaries(st.integers(1, 15), st.integers(1, 3), max_size=5), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_fullest_is_best(counts, room):
    used = packing.fullest(counts, room)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * m for n, m in used.items()) == max(s for s in sums if s <= room) and all(m <= counts[n] for n, m in used.items())


def test_packed(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 5, 5, 5, rng.randint(1, 250)])) for i in range(1500)] + [(1, 7), (9999, None)]
    df = spark.createDataFrame(sizes, "id long, n long")
    out = packing.packed(df, Scratch(spark, "t"), 100).collect()
    windows: dict[int, int] = {}
    for r in out:
        if r["length"]:
            windows[r["window_id"]] = windows.get(r["window_id"], 0) + r["length"]
        else:
            assert r["window_id"] is None
    total = sum(n or 0 for _, n in sizes)
    assert sum(windows.values()) == total and max(windows.values()) <= 100 and len(windows) <= 1.02 * -(-total // 100)
    assert sorted(windows) == list(range(len(windows)))
    whole = [r for r in out if r["start"] > 0]
    assert all(r["start"] % 100 == 0 for r in whole) and len([r for r in out]) == sum(max(1, -(-(n or 0) // 100)) for _, n in sizes)
    assert packing.packed(df.limit(0), Scratch(spark, "t")).count() == 0


# 10. Subjects

WORDS = {"cats": "whisker purr meow paw kitten".split(), "ships": "anchor sail harbour keel deck".split(), "food": "pepper bread stew oven plate".split()}
FILLER = "nothing further to add here today".split()


def sentence(rng, subject=None):
    words = rng.sample(WORDS[subject], 2) + rng.sample(FILLER, 3) if subject else rng.sample(FILLER, 4)
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    docs, labels, truth = [], [], {}
    for i in range(400):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        text = [sentence(rng, s) for s in own for _ in range(5)] + [sentence(rng) for _ in range(2)]
        rng.shuffle(text)
        docs.append((i, " ".join(text), "s", rng.choice(["EN-gb", "en", None, " "]), "x"))
        truth[i] = set(own)
        if i % 2 and own:
            labels += [(i, rng.choice([" ", ""]) + s.upper()) for s in own]
    docs += [(1000, None, None, None, "x"), (1001, "", "s", "de", "x"), (1002, " \n", "s", "de", "x"), (1003, "\x00\x01 12345 ::::", "s", "de", "x"), (1004, sentence(rng, "cats") + " " + " ".join(sentence(rng, "ships") for _ in range(20)), "s", "de", "x"), (1005, (sentence(rng, "food") + "\n") * 20000, "s", "de", "x"), (1006, docs[1][1], "s", "de", "x")]
    truth |= {1000: set(), 1001: set(), 1002: set(), 1003: set(), 1004: {"ships"}, 1005: {"food"}, 1006: truth[1]}
    return docs, labels + [(3, "unknown"), (None, "cats"), (3, None)], truth


def test_subjects(spark, corpus):
    docs, labels, truth = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, subject string")
    named = spark.createDataFrame([("Cats", ""), ("ships", ""), ("food ", None), (None, None)], "subject string, description string")
    marks = spark.createDataFrame(labels, "doc_id long, subject string")
    terms = subjects.learn(d, marks, named)
    found: dict[int, set] = {i: set() for i in truth}
    for r in subjects.assign(d, terms).collect():
        found[r["doc_id"]].add(r["subject"])
    wrong = [i for i in truth if found[i] != truth[i]]
    assert len(wrong) <= 0.03 * len(truth) and not set(wrong) & set(range(1000, 1007)), wrong
    mix = subjects.composition(d, subjects.assign(d, terms)).collect()
    assert {r["lang"] for r in mix} == {"en", "unknown", "de"} and all(0 < r["share"] <= 1 for r in mix)
    none = subjects.learn(d, marks.limit(0), named)
    assert none.weights == {} and subjects.assign(d, none).count() == 0 and subjects.assign(d.limit(0), terms).count() == 0


def test_all_subjects_count(spark):
    d = spark.createDataFrame([(i, f"word{i} ship.") for i in range(8)], "doc_id long, text string")
    named = spark.range(1200).selectExpr("concat('s', id) AS subject")
    marks = spark.createDataFrame([(i, "s7") for i in range(8)], "doc_id long, subject string")
    assert subjects.learn(d, marks, named).subjects == sorted(f"s{i}" for i in range(1200))


def test_stored_terms(spark, tmp_path):
    """Terms are tables that people can read and change; words and phrases."""
    labelled = [(f"the court heard case {i}. a supreme court ruling. shown on the court of tennis", {0}) for i in range(20)] + [(f"the tennis match {i}. a tennis court in the sun", {1}) for i in range(20)]
    terms = subjects.fit(["law", "sport"], labelled)
    assert "supreme court" in terms.weights and "court 1" not in terms.weights and len(terms.shares) == 2
    terms.shares = [0.3, 0.1]
    terms.store(spark, str(tmp_path))
    again = subjects.Terms.stored(spark, str(tmp_path))
    assert (again.subjects, again.weights, again.shares) == (terms.subjects, terms.weights, terms.shares)
    own = subjects.Terms(["law", "sport"], {"high court": (0, 2.0), "tennis": (1, 2.0)}, [0.3, 0.1])
    assert own.assigned("The High Court sat all the long day.\nTennis!") == [0, 1] and own.assigned("A high  courtyard.") == []
    assert subjects.terms_of("a high court, now") == {"high", "court", "now", "high court"}


def test_terms_are_words():
    terms = subjects.Terms(["a"], {"cat": (0, 2.0)})
    assert [terms.assigned(t) for t in ("A cat.", "concatenate", "CAT", "cat2 cats", "")] == [[0], [], [0], [0], []]


# Queries


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_queries(spark, small, name):
    from compare import rows, views

    df = plans.QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    assert got
    if name in plans.ORACLES:
        out = views(small).execute(plans.ORACLES[name])
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns) and got == rows(columns, out.fetchall())


def test_nothing_else_imports_the_subpackage():
    import pathlib

    import kinweave

    root = pathlib.Path(kinweave.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "kinweave.llm" in p.read_text()]


def test_texts_without_marks_are_cut():
    text = "whisker purr meow " * 20 + "anchor sail keel " * 20
    spans = subjects.sentences(text)
    assert max(b - a for a, b in spans) <= subjects.LONGEST and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert subjects.sentences("x" * 5000) == [(0, 5000)] and subjects.sentences("") == []
    terms = subjects.Terms(["cats", "ships"], {w: (0, 2.0) for w in WORDS["cats"]} | {w: (1, 2.0) for w in WORDS["ships"]})
    assert terms.assigned(text) == [0, 1]
