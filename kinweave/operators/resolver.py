"""Observations resolved to entities: identifiers first, then similarity, events, reconciliation, prototypes and slot references.

All observations of a batch meet the world as it was when the batch began.  Entities made for
identifiers are the same whatever the order, as their ids follow from the keys; entities made for
want of a similar one belong to their observation until a later batch meets them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.names import derived_id, name_match
from kinweave.functions.spacetime import haversine_km, location_decay, observation_date, observation_time, time_decay
from kinweave.operators import events, prototypes, slotrefs
from kinweave.operators.candidates import TOP_K, live_pool, nearest
from kinweave.operators.identifiers import KEY, lookup
from kinweave.operators.reconcile import audit, canonicalised, deduplicated, reconcile
from kinweave.operators.scoring import Thresholds, combined_score, decide, facet_agreement, links_of, unmatched, with_margin_in_order
from kinweave.storage import Scratch

#: The prototype that a seed of each nature is compared with; the name of the seed that the engine makes for what an image shows.
PROTOTYPES = {"individual": "prototype_image_embedding", "class": "prototype_text_embedding", "group": "prototype_text_embedding", "event": "prototype_text_embedding"}
SUBJECT = "photo_subject"
#: Places of the observation itself and of aligned events among an observation's seeds.
WHOLE, ALIGNED = -1, 1 << 20
SLOT = "struct<kind:string,value_str:string,value_num:double,unit:string,ref_entity_id:string,ref_type:string,ref_name:string,ref_nature:string,items:array<string>>"
_LINK = ("observation_id", "seed_index", "entity_id", "posterior", "status", "role", "flags")
_SEED = ("observation_id", "seed_index")


def slot(kind: str, **fields: Column) -> Column:
    """A stored slot struct; fields that aren't given are NULL."""
    types = [f.split(":") for f in SLOT.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*((F.lit(kind) if name == "kind" else fields.get(name, F.lit(None)).cast(type_)).alias(name) for name, type_ in types))


def seed_slots(slots: Column) -> Column:
    """A seed's slots (an array of name, value, is_reference, ref_nature) as a map of stored structs; the last of a name counts."""
    stored = lambda s: F.when(s["is_reference"], slot("reference", ref_name=s["value"], ref_nature=s["ref_nature"])).otherwise(slot("string", value_str=s["value"], value_num=s["value"].try_cast("double")))
    named = F.filter(F.coalesce(slots, F.array()), lambda s: s["name"].isNotNull())
    return F.map_from_entries(F.transform(named, lambda s: F.struct(s["name"].alias("key"), stored(s).alias("value"))))


def _text(slots: Column, *keys: str) -> Column:
    """The first filled value of some slots, as text."""
    one = lambda k: F.coalesce(F.when(F.trim(slots[k]["value_str"]) != "", slots[k]["value_str"]), slots[k]["value_num"].cast("string"))
    return F.coalesce(*map(one, keys))


def observation_facts(observations: DataFrame) -> DataFrame:
    """observation_id, medium, facets, lat, lon, at, o_date, o_place, o_species, out of the facets (a map of texts)."""
    f = F.col("facets")
    pick = lambda *keys: F.coalesce(*(F.when(F.trim(f[k]) != "", f[k]) for k in keys))
    lat, lon = pick("latitude", "gps_latitude").try_cast("double"), pick("longitude", "gps_longitude").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    at = observation_time(f["timestamp"], f["datetime"], f["capture_time"])
    species = F.map_values(F.map_filter(F.coalesce(f, F.create_map().cast("map<string,string>")), lambda k, v: k.startswith("species_") & ~k.endswith("_presence") & (v != "")))
    return observations.select("observation_id", "medium", "facets", F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"), at.alias("at"), observation_date(at).alias("o_date"), pick("location_name", "location").alias("o_place"), species.alias("o_species"))


def observation_vectors(signatures: DataFrame) -> DataFrame:
    """observation_id and its image_embedding, text_embedding, clip_text_embedding: of several signatures the first that has one."""
    names = ("image_embedding", "text_embedding", "clip_text_embedding")
    given = [c for c in names if c in signatures.columns]
    firsts = signatures.groupBy("observation_id").agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("signature_id"))).alias(c) for c in given))
    return firsts.select("observation_id", *(F.col(c) if c in given else F.lit(None).cast("array<float>").alias(c) for c in names))


def entity_facts(entities: DataFrame) -> DataFrame:
    """Adds e_lat, e_lon, e_at, e_date, e_place, e_species, out of the slots."""
    s = F.col("slots")
    return entities.withColumns({
        "e_lat": _text(s, "latitude", "gps_latitude").try_cast("double"), "e_lon": _text(s, "longitude", "gps_longitude").try_cast("double"), "e_at": observation_time(_text(s, "timestamp"), _text(s, "datetime"), _text(s, "last_seen")),
        "e_date": _text(s, "event_date"), "e_place": _text(s, "location_name"), "e_species": F.coalesce(s["species"]["items"], F.split(s["species"]["value_str"], ","), F.array().cast("array<string>")),
    })


def query_vector(nature: Column) -> Column:
    """A seed's vector: the image's, or the text's in the image space, for individuals; else the text's."""
    return F.when(nature == "individual", F.coalesce("image_embedding", "clip_text_embedding")).otherwise(F.col("text_embedding"))


def _rescaled(cosine: Column) -> Column:
    return (cosine + 1) / 2


def _signals(nature: str, names: bool, unwrapped: bool) -> dict[str, Column]:
    place = F.when(F.col("lat").isNotNull() & F.col("e_lat").isNotNull() & F.col("e_lon").isNotNull(), location_decay(haversine_km("lat", "lon", "e_lat", "e_lon")))
    time = F.when(F.col("at").isNotNull() & F.col("e_at").isNotNull(), time_decay("at", "e_at"))
    # A bare facet never equals a wrapped slot; ``unwrapped`` compares it with what the slot holds.
    same = lambda facet, s: F.coalesce(s["ref_entity_id"], s["value_str"], s["value_num"].cast("string")) == facet
    facet = facet_agreement(F.col("facets"), F.col("slots"), same) if unwrapped else F.when(F.col("has_facets") & F.col("has_slots"), 0.0)
    called = {"name": name_match("suggested_name", "name")} if names else {}
    return {
        "individual": {"image": F.col("similarity"), "location": place, "timestamp": time},
        "class": {"text": F.col("similarity"), "facet": facet, **called},
        "group": {"location": place},
        "event": {"timestamp": time, "location": place},
    }[nature]


def similarity_links(seeds: DataFrame, entities: DataFrame, scratch: Scratch, thresholds: Thresholds = Thresholds(), k: int = TOP_K, dim: int | None = None, names: bool = False, unwrapped: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links of seeds by similarity, and the decision on each seed that had candidates.

    ``seeds``: observation_id, seed_index, entity_nature, vector, lat, lon, at, facets, suggested_name.
    ``entities``: as stored, with entity_facts.  Seeds of all natures are searched and scored
    together.  Vectors of another length than ``dim`` match none.  ``names`` lets suggested names
    count, ``unwrapped`` compares facets with the values of slots.
    """
    proto = derived_id("entity", F.lit("proto"), *_SEED)
    # Maps go to the pairs of classes only, and only where their values count.
    maps = lambda c: F.when((F.col("entity_nature") == "class") & F.lit(unwrapped), F.col(c))
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    called = lambda c: F.when(F.lit(names), F.col(c))
    own = seeds.select(F.concat_ws("|", *_SEED).alias("query_id"), *_SEED, "entity_nature", "vector", "lat", "lon", "at", maps("facets").alias("facets"), filled("facets").alias("has_facets"), called("suggested_name").alias("suggested_name"))
    world = entities.withColumn("has_slots", filled("slots")).withColumn("slots", maps("slots")).withColumn("name", called("name"))
    facts = ("e_lat", "e_lon", "e_at", "slots", "has_slots", "name")
    pools = [live_pool(world, prototype, nature, *facts) for nature, prototype in PROTOTYPES.items()]
    asked = (*_SEED, "entity_nature", "lat", "lon", "at", "facets", "has_facets", "suggested_name")
    scored = nearest(own, reduce(DataFrame.unionByName, pools), k, dim, "entity_nature", scratch, asked=asked, facts=facts).withColumn("similarity", _rescaled(F.col("cosine")))
    score = reduce(lambda rest, n: F.when(F.col("entity_nature") == n, combined_score(n, _signals(n, names, unwrapped))).otherwise(rest), PROTOTYPES, F.lit(None))
    individual = F.col("entity_nature") == "individual"
    signals = _signals("individual", names, unwrapped)
    has = lambda *flags: F.exists("_s.flags", lambda f: f.isin(*flags))
    located, timed = F.col("entity_nature") != "class", F.col("entity_nature").isin("individual", "event")
    rows = scored.withColumn("_s", score).select(
        "query_id", *_SEED, "entity_id", "rank", F.col("entity_nature").alias("nature"), "_s.score", "_s.coverage", has("sparse_signals", "single_signal").alias("sparse"), has("low_evidence").alias("low_evidence"),
        F.when(individual, F.col("similarity")).alias("image"), F.when(located, signals["location"]).alias("location"), F.when(timed, signals["timestamp"]).alias("timestamp"),
    )
    best = scratch.save(decide(with_margin_in_order(rows, "query_id"), thresholds).drop("query_id"), "decided")
    scratch.drop("queries", "pool")
    scratch.collect()
    decided = best.select(*_SEED, "entity_id", "nature", "score", "coverage", "margin", "pool_size", "decision", "flags")
    without = seeds.where("vector is null")
    none = [unmatched(without.select(*_SEED), without.select(*_SEED).limit(0), proto, "no_embedding_available", *_SEED), unmatched(seeds.where("vector is not null").select(*_SEED), decided, proto, "no_candidates_found", *_SEED)]
    return reduce(DataFrame.unionByName, none, links_of(best, proto, *_SEED)), decided


def identifier_links(ids: DataFrame, seeds: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by identifier, the entities to make for unknown ones (with their key), and the facets of seeds that met a known one.

    ``ids``: observation_id, seed_index (NULL for the observation itself), the resolved key,
    strength.  An entity is made once for a key: for an observation as an individual named by the
    key, else by the first seed that brings it, with the seed's nature, name and slots.
    """
    own = seeds.select(*_SEED, "entity_nature", "suggested_name", seed_slots(F.col("slots")).alias("slots"))
    rows = ids.withColumn("seed_index", F.coalesce("seed_index", F.lit(WHOLE))).join(own, list(_SEED), "left")
    found, whole, made = lookup(rows, bindings), F.col("seed_index") == WHOLE, derived_id("entity", *KEY)
    missing = F.col("entity_id").isNull()
    flags = F.when(whole, F.array_compact(F.array(F.lit("from_observation_det_id"), F.when(missing, "entity_created")))).otherwise(F.array().cast("array<string>"))
    links = found.select(*_SEED, F.coalesce("entity_id", made).alias("entity_id"), F.lit(1.0).alias("posterior"), F.lit("hard").alias("status"), F.lit("subject").alias("role"), flags.alias("flags"))
    what = F.struct(F.when(whole, "individual").otherwise(F.col("entity_nature")).alias("entity_nature"), F.when(whole, F.concat_ws(":", "id_type", "id_value")).otherwise(F.col("suggested_name")).alias("name"), "slots")
    first = F.struct((~whole).alias("late"), F.col("observation_id"), F.col("seed_index"))
    strong = F.max((F.col("strength") == "strong").cast("int")) if "strength" in ids.columns else F.max(F.lit(1))
    new = found.where(missing).groupBy(*KEY).agg(F.min_by(what, first).alias("w"), strong.alias("s")).select(*KEY, made.alias("entity_id"), "w.*", F.when(F.col("s") == 1, 1.0).otherwise(0.8).alias("binding_confidence"))
    facets = found.where(~missing & ~whole).select(*_SEED, "entity_id", F.explode("slots").alias("facet", "v")).select(*_SEED, "entity_id", "facet", F.coalesce("v.ref_name", "v.value_str", F.lit("")).alias("value"))
    return links, new, facets


def proto_entities(made: DataFrame, seeds: DataFrame) -> DataFrame:
    """The entities made for seeds without a similar one (observation_id, seed_index, entity_id), with what their observation gives them.

    Individuals get its place and time unless their slots have them.  Only the seed of what an
    image shows gets the image as its prototype, and only other natures than individuals the text.
    """
    rows = made.join(seeds, list(_SEED)).withColumn("_slots", seed_slots(F.col("slots")))
    one, has = F.col("entity_nature") == "individual", lambda k: F.array_contains(F.map_keys("_slots"), k)
    placed, timed = one & F.col("lat").isNotNull() & ~has("latitude"), one & F.col("at").isNotNull() & ~has("datetime")
    number = lambda c: slot("number", value_num=F.col(c))
    added = F.array(F.when(placed, F.struct(F.lit("latitude").alias("key"), number("lat").alias("value"))), F.when(placed, F.struct(F.lit("longitude").alias("key"), number("lon").alias("value"))), F.when(timed, F.struct(F.lit("datetime").alias("key"), slot("datetime", value_str=F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("value"))))
    slots = F.map_concat("_slots", F.map_from_entries(F.filter(added, lambda e: e.isNotNull())))
    image = F.when(one & (F.col("entity_type") == SUBJECT), F.col("image_embedding"))
    text = F.when(~one, F.col("text_embedding"))
    return rows.select("entity_id", "entity_nature", F.col("suggested_name").alias("name"), slots.alias("slots"), F.lit("proto").alias("status"), F.col("confidence").cast("double").alias("confidence"), image.alias("prototype_image_embedding"), text.alias("prototype_text_embedding"), F.coalesce(image, text).isNotNull().cast("int").alias("prototype_count"))


def prototype_updates(links: DataFrame, vectors: DataFrame, entities: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """entity_id, prototype_image_embedding, prototype_text_embedding, prototype_count of the entities that ``links`` change.

    Hard links and soft ones of ``least`` or more count, in the ``order`` of their observations
    (observation_id, seq); the image only where prototypes.takes_image.  Both vectors go by one count
    of the updates so far; what an entity lacks is set by the first vector.
    """
    sure = prototypes.eligible(links, least).select("observation_id", "entity_id", "weight")
    # Whether there are vectors is told apart from the vectors, so that counting the updates needs none of them.
    known = entities.select("entity_id", prototypes.takes_image(F.col("slots"), F.col("name")).alias("takes"), "prototype_image_embedding", "prototype_text_embedding", F.coalesce("prototype_count", F.lit(0)).alias("stored"))
    given = vectors.withColumn("pictured", F.col("image_embedding").isNotNull()).withColumn("worded", F.col("text_embedding").isNotNull())
    rows = sure.join(given, "observation_id").join(order, "observation_id").join(known, "entity_id").where("(takes and pictured) or worded")
    rows = rows.withColumn("image", F.when(F.col("takes"), F.col("image_embedding"))).withColumn("text", F.col("text_embedding"))
    before = F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "observation_id"))
    narrow = rows.select("entity_id", "observation_id", "seq", "stored").withColumn("nth", before).withColumn("before", F.col("stored") + F.col("nth") - 1).drop("seq", "stored")
    rows = rows.join(narrow, ["entity_id", "observation_id"])
    fold = lambda vector, current: prototypes.updated(rows.where(F.col(vector).isNotNull()).select("entity_id", F.col(current).alias("current"), F.col("stored").alias("prototype_count"), F.col("nth").alias("seq"), "before", F.col(vector).alias("vector"), "weight")).groupBy("entity_id").agg(F.first("prototype").alias(vector))  # noqa: E731  # one row each, which the planner sees from the grouping
    counts = rows.groupBy("entity_id").agg((F.max("stored") + F.count(F.lit(1))).cast("int").alias("prototype_count"))
    out = counts.join(fold("image", "prototype_image_embedding"), "entity_id", "left").join(fold("text", "prototype_text_embedding"), "entity_id", "left").join(known.drop("takes", "stored"), "entity_id")
    return out.select("entity_id", *(F.coalesce(F.col(v), F.col(c).cast("array<double>")).alias(c) for v, c in (("image", "prototype_image_embedding"), ("text", "prototype_text_embedding"))), "prototype_count")


def with_references(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entities whose symbolic slots hold the ids that slotrefs.resolve found for them."""
    targets = resolved.where("target_id is not null").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("slot_name", "target_id"))).alias("_t"))
    filled = F.transform_values("slots", lambda k, s: F.when(F.col("_t")[k].isNotNull(), s.withField("ref_entity_id", F.col("_t")[k])).otherwise(s))
    return entities.join(targets, "entity_id", "left").withColumn("slots", F.when(F.col("_t").isNull(), F.col("slots")).otherwise(filled)).drop("_t")


def _alignments(images: DataFrame, live: DataFrame, mine: DataFrame, canonical: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of observations to events that no other link of the observation can meet, and those that one may.

    Alignments are as many as observations and events share dates, so the former aren't stored or
    shuffled: they are made where they are read.  A link ``mine`` meets an event by its entity or by
    what that was merged into.
    """
    root = canonical.select(F.col("id").alias("entity_id"), "root")
    moved = scratch.save(live.select("entity_id").join(root, "entity_id").where(F.col("root") != F.col("entity_id")), "moved")  # none of a world whose chains are whole
    shared = moved.select("entity_id").unionByName(moved.select(F.col("root").alias("entity_id"))).distinct().withColumn("shared", F.lit(True))
    named = scratch.save(live.join(shared, "entity_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False))), "events")
    own = mine.select("observation_id", "entity_id")
    own = own.unionByName(own.join(root, "entity_id").select("observation_id", F.col("root").alias("entity_id"))).join(named.select("entity_id"), "entity_id", "left_semi")
    met = own.groupBy("observation_id").agg(F.collect_set("entity_id").alias("met"))
    seen = scratch.save(images.join(met, "observation_id", "left"), "seen")
    pairs = events.aligned_by_date(seen, named)
    meets = F.col("shared") | F.coalesce(F.array_contains("met", F.col("entity_id")), F.lit(False))
    links = lambda df: events.links_of_pairs(df).withColumn("seed_index", F.lit(ALIGNED))
    undated = events.align(images.where("o_date is null"), live).withColumn("seed_index", F.lit(ALIGNED))
    return links(pairs.where(~meets)), scratch.save(links(pairs.where(meets)).unionByName(undated), "meeting")


def resolve(observations: DataFrame, signatures: DataFrame, seeds: DataFrame, ids: DataFrame, entities: DataFrame, bindings: DataFrame, canonical: DataFrame, scratch: Scratch, thresholds: Thresholds = Thresholds(), k: int = TOP_K, dim: int | None = None, names: bool = False, unwrapped: bool = False) -> dict[str, DataFrame]:
    """links, entities, bindings, prototypes, participants, audit, references, decisions, flags: what a batch adds to the world.

    ``observations``: observation_id, medium, facets, seq (the order of arrival).  ``signatures``:
    signature_id, observation_id and vectors.  ``seeds``: observation_id, seed_index,
    entity_nature, entity_type, suggested_name, slots, confidence.  ``ids``: see identifier_links; a seed
    with an identifier is not compared.  ``entities``, ``bindings``: the world; ``canonical``: id,
    root (see canonical.canonical).
    """
    facts, vectors = scratch.save(observation_facts(observations), "facts"), scratch.save(observation_vectors(signatures), "vectors")
    world = scratch.save(entity_facts(entities), "world")
    full = seeds.join(facts.select("observation_id", "facets", "lat", "lon", "at"), "observation_id").join(vectors, "observation_id", "left").withColumn("vector", query_vector(F.col("entity_nature")))
    full = scratch.save(full, "seeds")
    by_id, new, facets = identifier_links(ids, seeds, bindings)
    free = full.join(ids.where("seed_index is not null").select(*_SEED).distinct(), list(_SEED), "left_anti")
    similar, decided = similarity_links(free, world, scratch, thresholds, k, dim, names, unwrapped)
    live = world.where(F.coalesce(F.trim("canonical_entity_id"), F.lit("")).eqNullSafe("") & (F.coalesce("status", F.lit("")) != "deprecated") & (F.col("entity_nature") == "event"))
    images = facts.where("medium = 'image'").select("observation_id", "o_date", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "o_place", "o_species")
    mine = scratch.save(reduce(DataFrame.unionByName, [x.select(*_LINK) for x in (by_id, similar)]), "mine")
    alone, meeting = _alignments(images, live.select("entity_id", "e_date", "e_lat", "e_lon", "e_place", "e_species"), mine, canonical, scratch)
    aligned = alone.unionByName(meeting)
    pending = mine.unionByName(meeting.select(*_LINK))
    judged = scratch.save(reconcile(pending, facets), "judged")
    scratch.collect()
    final = scratch.save(canonicalised(deduplicated(judged).drop("conflicts"), canonical), "links").unionByName(alone.select(*_LINK))

    proto = mine.where(F.col("entity_id") == derived_id("entity", F.lit("proto"), *_SEED)).select(*_SEED, "entity_id")
    none = F.lit(None).cast("array<float>")
    keyed = new.select("entity_id", "entity_nature", "name", "slots", F.lit("proto").alias("status"), F.lit(1.0).alias("confidence"), none.alias("prototype_image_embedding"), none.alias("prototype_text_embedding"), F.lit(0).alias("prototype_count"))
    made = scratch.save(proto_entities(proto, full).unionByName(keyed), "made")
    scratch.drop("seeds")
    scratch.collect()
    natures = world.select("entity_id", "entity_nature", "name").unionByName(made.select("entity_id", "entity_nature", "name"))
    references = scratch.save(slotrefs.resolve(slotrefs.symbolic(made), bindings, natures, canonical), "references")
    referred = slotrefs.created(references)
    state = world.select("entity_id", "slots", "name", "prototype_image_embedding", "prototype_text_embedding", "prototype_count").unionByName(made.select("entity_id", "slots", "name", "prototype_image_embedding", "prototype_text_embedding", "prototype_count"))
    named = references.where("outcome = 'created'").select(F.lit("ref").alias("id_type"), F.col("ref_value").alias("id_value"), F.col("namespace").alias("id_namespace"), F.col("target_id").alias("entity_id"), F.lit(slotrefs.MADE_CONFIDENCE).alias("confidence")).distinct()
    sure = scratch.save(prototypes.eligible(final, thresholds.link).select("observation_id", "entity_id", "posterior", "status"), "sure")  # once, as it is read several times
    counted = lambda df, flag: df.groupBy("observation_id").agg(F.concat(F.lit(f"{flag}:"), F.count(F.lit(1)).cast("string")).alias("flag"))
    clashes = judged.where("conflicts > 0").select("observation_id", "entity_id", F.explode(F.sequence(F.lit(1), "conflicts"))).distinct()
    owners = proto.select("observation_id", "entity_id")
    flags = [counted(by_id.where(F.col("seed_index") == WHOLE), "obs_det_ids_resolved"), counted(aligned, "event_aligned"), counted(clashes, "multi_seed_conflicts"), counted(references.where("target_id is null").join(owners, "entity_id"), "slot_refs_unresolved")]
    return {
        "links": final,
        "entities": with_references(made, references).unionByName(referred.select(F.col("target_id").alias("entity_id"), "entity_nature", "name", F.lit(None).cast(f"map<string,{SLOT}>").alias("slots"), F.lit("proto").alias("status"), "confidence", none.alias("prototype_image_embedding"), none.alias("prototype_text_embedding"), F.lit(0).alias("prototype_count"))),
        "bindings": new.select(*KEY, "entity_id", F.col("binding_confidence").alias("confidence")).unionByName(named),
        "prototypes": prototype_updates(sure, vectors, state, observations.select("observation_id", "seq"), thresholds.link),
        "participants": events.participants(final, natures),
        "audit": audit(final, thresholds.link),
        "references": references,
        "decisions": decided,
        "flags": reduce(DataFrame.unionByName, flags).groupBy("observation_id").agg(F.sort_array(F.collect_list("flag")).alias("flags")),
    }


def suggest_merges(records: DataFrame, key: str, vector: str, least: float = 0.9, limit: int = 10) -> DataFrame:
    """first_id, second_id, similarity: the most similar pairs of records, rescaled cosine of ``least`` or more; at most ``limit`` partners of each."""
    rows = records.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("entity_id"), F.col(vector).alias("vector"))
    found = nearest(rows.withColumnRenamed("entity_id", "query_id"), rows, limit + 1).where("query_id <> entity_id").withColumn("similarity", _rescaled(F.col("cosine"))).where(F.col("similarity") >= least)
    return found.groupBy(F.least("query_id", "entity_id").alias("first_id"), F.greatest("query_id", "entity_id").alias("second_id")).agg(F.max("similarity").alias("similarity"))
