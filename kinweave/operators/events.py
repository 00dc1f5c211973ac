"""Events: alignment of observations by date, place and species, and who took part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.names import participant_role
from kinweave.functions.spacetime import haversine_km

#: Points of an equal date, of nearness and its reach in km, of a named place, of shared species; least scores.
DATE_POINTS, PLACE_POINTS, PLACE_KM, NAME_POINTS, SPECIES_POINTS, SOFT, CANDIDATE = 0.4, 0.3, 20.0, 0.2, 0.3, 0.5, 0.3


def alignment_score() -> Column:
    """score and flags of a pair: o_* are the observation's and e_* the event's date, lat, lon, place and species."""
    km = haversine_km("o_lat", "o_lon", "e_lat", "e_lon")
    gps = F.col("o_lat").isNotNull() & F.col("o_lon").isNotNull()
    date = F.when(F.col("o_date") == F.col("e_date"), DATE_POINTS)
    place = F.when(gps & (km < PLACE_KM), PLACE_POINTS * (1 - km / PLACE_KM))
    named = F.when(~gps & (F.trim("e_place") != "") & F.lower("o_place").contains(F.lower("e_place")), NAME_POINTS)
    plain = lambda c: F.array_distinct(F.transform(c, lambda s: F.lower(s)))
    shared = F.size(F.array_intersect(plain("o_species"), plain("e_species")))
    species = F.when(shared > 0, SPECIES_POINTS * shared / F.greatest(F.size(plain("o_species")), F.size(plain("e_species"))))
    score = sum((F.coalesce(x, F.lit(0.0)) for x in (date, place, named, species)), F.lit(0.0))
    flags = F.array_compact(F.array(F.lit("event_aligned"), F.when(date.isNotNull(), "date_match"), F.when(place.isNotNull(), F.format_string("gps_proximity(%.1fkm)", km)), F.when(named.isNotNull(), "location_name_match"), F.when(species.isNotNull(), "species_overlap")))
    return F.struct(score.alias("score"), flags.alias("flags"))


def align(observations: DataFrame, events: DataFrame, cell_degrees: float = 0.25) -> DataFrame:
    """observation_id, entity_id, posterior, status, role, flags of observations aligned to events.

    A dated observation meets the events of its date.  One without a date can't reach the least
    score but by place or species, so it meets the events in its own and the neighbouring cells
    of the map, and those that share a species.  All three are equi-joins.
    """
    dated = observations.where("o_date is not null").join(events.where("e_date is not null"), F.col("o_date") == F.col("e_date"))
    rest = observations.where("o_date is null")
    cell = lambda c: F.floor(F.col(c) / cell_degrees)
    # 20 km are 0.18 degrees of latitude; of longitude they are more towards the poles, so the cells widen there.
    column = lambda lon: F.floor(F.col(lon) * F.greatest(F.lit(0.05), F.cos(F.radians(F.abs((F.col("_band") + 0.5) * cell_degrees)))) / cell_degrees)
    around = lambda c, n: F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda i: c + i))
    # Near the date line an observation is also placed on its other side.
    sides = F.explode(F.filter(F.array(F.col("o_lon"), F.col("o_lon") - 360, F.col("o_lon") + 360), lambda x: F.abs(x) <= 200))
    near_o = rest.where("o_lat is not null and o_lon is not null").withColumn("_lon", sides).withColumn("_band", around(cell("o_lat"), 1)).withColumn("_x", around(column("_lon"), 2)).drop("_lon")
    near_e = events.where("e_lat is not null and e_lon is not null").withColumn("_band", cell("e_lat")).withColumn("_x", column("e_lon"))
    placed = near_o.join(near_e, ["_band", "_x"]).drop("_band", "_x")
    kinds = rest.withColumn("_s", F.explode(F.array_distinct(F.transform("o_species", lambda s: F.lower(s))))).join(events.withColumn("_s", F.explode(F.array_distinct(F.transform("e_species", lambda s: F.lower(s))))), "_s").drop("_s")
    pairs = dated.unionByName(placed).unionByName(kinds)
    return links_of_pairs(pairs.withColumn("_a", alignment_score()).groupBy("observation_id", "entity_id").agg(F.max("_a").alias("a")))


def aligned_by_date(observations: DataFrame, events: DataFrame) -> DataFrame:
    """As align, for the observations with a date, and the columns of the pairs: ids are unique on both sides, so each pair arises once and no shuffle has to move it."""
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by rows, not by bytes: the pairs of few bytes are many
    spread = lambda df, date: df.where(F.col(date).isNotNull()).repartition(parts, date)
    pairs = spread(observations, "o_date").join(spread(events, "e_date"), F.col("o_date") == F.col("e_date"))
    return pairs.withColumn("a", alignment_score())


def links_of_pairs(scored: DataFrame) -> DataFrame:
    """The links of pairs and their scores (observation_id, entity_id, a) of the least score or more."""
    return scored.where(F.col("a.score") >= CANDIDATE).select("observation_id", "entity_id", F.col("a.score").alias("posterior"), F.when(F.col("a.score") >= SOFT, "soft").otherwise("candidate").alias("status"), F.lit("context").alias("role"), F.col("a.flags").alias("flags"))


def participants(links: DataFrame, natures: DataFrame) -> DataFrame:
    """event_id, participant_id, observation_id, role, confidence: individuals seen where an event is the context.

    Candidate links don't count.  Pairs meet by observation; confidence is the smaller posterior.
    """
    sure = links.where("status <> 'candidate'").join(natures.select("entity_id", "entity_nature", "name"), "entity_id")
    events = sure.where("entity_nature = 'event' and role = 'context'").select("observation_id", F.col("entity_id").alias("event_id"), F.col("posterior").alias("p"))
    people = sure.where("entity_nature = 'individual' and role = 'subject'").select("observation_id", F.col("entity_id").alias("participant_id"), F.col("posterior").alias("q"), participant_role("name").alias("role"))
    return events.join(people, "observation_id").groupBy("event_id", "participant_id", "observation_id").agg(F.max("role").alias("role"), F.max(F.least("p", "q")).alias("confidence"))


def enriched_slots(slots: Column, facets: Column) -> Column:
    """Adds to an event's slots (map of texts) what its text observation's facets say of date, time, place and species."""
    has = lambda k: F.array_contains(F.map_keys(slots), k)
    pick = lambda *keys: F.coalesce(*(F.when(facets[k] != "", facets[k]) for k in keys))
    lat, lon = pick("latitude", "lat").try_cast("double"), pick("longitude", "lon").try_cast("double")
    both = lat.isNotNull() & lon.isNotNull() & ~has("latitude")
    species = F.map_values(F.map_filter(facets, lambda k, v: k.startswith("species_") & ~k.endswith("_presence")))
    new = {
        "event_date": F.when(~has("event_date"), pick("date", "datetime")),
        "time_window": F.when(~has("time_window"), pick("time_window")),
        "latitude": F.when(both, lat.cast("string")),
        "longitude": F.when(both, lon.cast("string")),
        "location_name": F.when(~has("location_name"), pick("location_name", "location")),
        "species": F.when(~has("species") & (F.size(species) > 0), F.array_join(species, ",")),
    }
    added = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in new.items())), lambda e: e["value"].isNotNull()))
    return F.map_concat(added, slots)
