"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import canonical, groups, neighbours, packing, ranking, seen, subjects, tokens
from kinweave.sources.tables import current_rows, table
from kinweave.storage import Scratch

SEEN = {"blobs": seen.blob_key, "entity_deterministic_ids": seen.identifier_key}


def _seen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The keyed rows and the first sightings of both tables."""
    tables = {t: table(spark, folder, t) for t in SEEN}
    keyed = [seen.keyed(df, t, SEEN[t]()) for t, df in tables.items()]
    # A pattern, as the source of a stream must be a folder or a pattern, and a table may be one file.
    streams = [seen.keyed(spark.readStream.schema(df.schema).parquet(f"{folder}/{t}.parque[t]"), t, SEEN[t]()) for t, df in tables.items()]
    firsts = seen.first_sightings(streams[0].unionByName(streams[1]), Scratch(spark, "seen"))
    return keyed[0].unionByName(keyed[1]), firsts


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, firsts = _seen(spark, folder)
    return seen.repeats(rows, firsts).select("tbl", F.col("seq").alias("ingest_seq"))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return seen.rates(*_seen(spark, folder))


#: Each vector column under a short name, as the name goes through every shuffle.
VECTORS = {"entities": ("entity_id", {"prototype_image_embedding": "a", "prototype_text_embedding": "b"}), "signatures": ("signature_id", {"image_embedding": "c", "text_embedding": "d"})}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [neighbours.current_directions(table(spark, folder, name), key, columns) for name, (key, columns) in VECTORS.items()]
    nearest = neighbours.all_nearest(parts[0].unionByName(parts[1]), Scratch(spark, "nearest"))
    full = F.create_map(*(F.lit(x) for name, (_, columns) in VECTORS.items() for c, short in columns.items() for x in (short, f"{name}.{c}")))
    return neighbours.similar_pairs(nearest).select(full[F.col("field")].alias("vector_field"), "id_a", "id_b")


def p2_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The same with both factors at one, which is exact search, through several shards a field."""
    parts = [neighbours.current_directions(table(spark, folder, name), key, columns) for name, (key, columns) in VECTORS.items()]
    nearest = neighbours.all_nearest(parts[0].unionByName(parts[1]), Scratch(spark, "nearest"), factor=1.0, shard_factor=1.0, shard=2_000)
    full = F.create_map(*(F.lit(x) for name, (_, columns) in VECTORS.items() for c, short in columns.items() for x in (short, f"{name}.{c}")))
    return neighbours.similar_pairs(nearest).select(full[F.col("field")].alias("vector_field"), "id_a", "id_b")


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    candidates = table(spark, folder, "type_candidates")
    mapped = canonical.map_names(candidates.select(F.col("proposed_name").alias("name")), table(spark, folder, "type_catalog"), Scratch(spark, "canonical"))
    return canonical.assign(candidates, mapped)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder)


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the candidates whose names are written like an entry but for letter case and what stands between words."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    entries = table(spark, folder, "type_catalog").where("type_id is not null").select(F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    names = current_rows(table(spark, folder, "type_candidates"), "candidate_id", "proposed_name").where(F.col("proposed_name").rlike("^[ -~]*$") & ~F.col("proposed_name").rlike("[a-z][A-Z]"))
    written = names.select("candidate_id", plain("proposed_name").alias("k")).where("k <> ''").join(entries.select(plain("form").alias("k")).distinct(), "k", "left_semi")
    return _mapped(spark, folder).join(written, "candidate_id", "left_semi")


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    rows = _mapped(spark, folder).where("type_id = ''").select("candidate_id")
    names = current_rows(table(spark, folder, "type_candidates"), "candidate_id", "proposed_name")
    return names.join(rows, "candidate_id", "left_semi").groupBy("proposed_name").agg(F.count(F.lit(1)).alias("candidates"))


POINTERS = {"entities": ("entity_id", "canonical_entity_id"), "type_candidates": ("candidate_id", "merged_into_candidate_id")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    both = [groups.pointers(table(spark, folder, t), t, *columns) for t, columns in POINTERS.items()]
    found = groups.group_ids(both[0][0].unionByName(both[1][0]), both[0][1].unionByName(both[1][1]), Scratch(spark, "groups"))
    return found.select("tbl", F.col("id").alias("record_id"), "group_id")


def _closeness(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.closeness(ranking.long_scores(table(spark, folder, "similarity_results")), Scratch(spark, "ranking"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.first_of_each(_closeness(spark, folder)).select(F.col("group_id").alias("observation_id"), F.col("member").alias("entity_id"))


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.full_ranking(_closeness(spark, folder)).select(F.col("group_id").alias("observation_id"), F.col("member").alias("entity_id"), F.round("closeness", 6).alias("closeness"), "place")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text back from its ids."""
    back = tokens.decoded(tokens.encoded(table(spark, folder, "documents")))
    return back.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("characters"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, folder, "documents"))
    return packing.packed(sizes.withColumnRenamed("doc_id", "id"), Scratch(spark, "packing"))


def p9_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select("window_id", F.col("id").alias("doc_id"), "start", "length")


def p9_usage(spark: SparkSession, folder: str) -> DataFrame:
    return packing.usage(_packed(spark, folder))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document is whole in the windows, uncut unless it is longer than one, and its windows aren't overfull."""
    placed = Scratch(spark, "packing").save(_packed(spark, folder), "placed")
    full = placed.where("window_id is not null").groupBy("window_id").agg((F.sum("length") <= packing.CAPACITY).alias("fits"))
    own = placed.join(full, "window_id", "left").groupBy("id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"), F.count_distinct("start").alias("starts"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"))
    sizes = tokens.token_counts(table(spark, folder, "documents"))
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))
    whole = (F.col("tokens") == F.col("n")) & (F.col("end") == F.col("n")) & (F.col("pieces") == cuts) & (F.col("starts") == cuts)
    return sizes.join(own, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("is_whole"), F.coalesce("fits", F.lit(False)).alias("is_fitting"))


def _subjects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    scratch = Scratch(spark, "subjects")
    subjects.learn(documents, table(spark, folder, "doc_labels"), table(spark, folder, "subjects")).store(spark, scratch.root)
    return documents, subjects.assign(documents, subjects.Terms.stored(spark, scratch.root))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder)[1]


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    documents, found = _subjects(spark, folder)
    return subjects.composition(documents, Scratch(spark, "subjects").save(found, "found"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_exact, p3_found, p3_exact, p3_unmatched, p5_found, p6_found, p6_ranking, p8_ids, p8_texts, p9_windows, p9_usage, p9_kept, p10_found, p10_composition)}

_W = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_SEEN = f"""
WITH k AS (
  SELECT 'blobs' AS tbl, ingest_seq, {_W.format(c="regexp_replace(lower(" + _W.format(c="sha256") + "), '^sha256:', '')")} AS key FROM blobs
  UNION ALL SELECT 'entity_deterministic_ids', ingest_seq, CASE WHEN {_W.format(c="id_value")} <> '' THEN
    coalesce(lower({_W.format(c="id_type")}), '') || chr(1) || coalesce(lower({_W.format(c="id_namespace")}), '') || chr(1) || {_W.format(c="id_value")} END FROM entity_deterministic_ids),
f AS (SELECT *, min(ingest_seq) OVER (PARTITION BY tbl, key) AS first_seq FROM k WHERE key IS NOT NULL AND key <> '')
"""

_CLOSENESS = """
WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY created_at) AS rn FROM similarity_results WHERE result_id IS NOT NULL) WHERE rn = 1),
s AS (SELECT result_id, observation_id, entity_id, 'image_similarity' AS criterion, image_similarity AS score FROM once UNION ALL SELECT result_id, observation_id, entity_id, 'text_similarity', text_similarity FROM once
  UNION ALL SELECT result_id, observation_id, entity_id, 'signal ' || x.signal_name, x.score FROM (SELECT result_id, observation_id, entity_id, unnest(signals) AS x FROM once) WHERE x.available),
v AS (SELECT * FROM s WHERE score IS NOT NULL AND NOT isnan(score) AND observation_id IS NOT NULL AND entity_id IS NOT NULL),
q0 AS (SELECT criterion, quantile_disc(score, 0.01) AS lo, quantile_disc(score, 0.99) AS hi, min(score) AS least, max(score) AS most FROM v GROUP BY criterion),
q AS (SELECT criterion, CASE WHEN lo >= hi THEN least ELSE lo END AS lo, CASE WHEN lo >= hi THEN most ELSE hi END AS hi FROM q0),
n AS (SELECT v.criterion, lo, hi, sqrt(sum(pow(least(greatest(score, lo), hi), 2))) AS norm FROM v JOIN q ON q.criterion = v.criterion GROUP BY ALL),
y AS (SELECT result_id, observation_id, entity_id, hi > lo AS spread, least(greatest(score, lo), hi) / norm AS x, lo / norm AS worst, hi / norm AS best FROM v JOIN n ON n.criterion = v.criterion),
u AS (SELECT result_id, observation_id, entity_id, CASE WHEN spread THEN (x - worst) * (1 / (best - worst)) ELSE 0.5 END AS up, CASE WHEN spread THEN (best - x) * (1 / (best - worst)) ELSE 0.5 END AS down FROM y),
c AS (SELECT observation_id, entity_id, sqrt(avg(up * up)) / (sqrt(avg(up * up)) + sqrt(avg(down * down))) AS closeness FROM u GROUP BY result_id, observation_id, entity_id),
b AS (SELECT observation_id, entity_id, max(closeness) AS closeness FROM c GROUP BY ALL)
"""

_PLAIN = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"

_USABLE = "len({v}) = 64 AND list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0))"
_FIELDS = " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS f, {k} AS id, {c}::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ingest_seq DESC) AS rn FROM {t} WHERE {k} IS NOT NULL) WHERE rn = 1 AND {c} IS NOT NULL AND {_USABLE.format(v=c)}" for t, (k, columns) in VECTORS.items() for c in columns
)

ORACLES = {
    "p2_exact": f"""
WITH d AS ({_FIELDS}), p AS (SELECT a.f, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM d a JOIN d b ON b.f = a.f AND b.id <> a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY f, a ORDER BY round(c, 7) DESC, b) AS rk FROM p WHERE c >= 0.92)
SELECT DISTINCT f AS vector_field, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rk <= 5""",
    "p3_exact": f"""
WITH c AS (SELECT * FROM (SELECT candidate_id, proposed_name, row_number() OVER (PARTITION BY candidate_id ORDER BY ingest_seq DESC) AS rn FROM type_candidates WHERE candidate_id IS NOT NULL)
  WHERE rn = 1 AND regexp_matches(proposed_name, '^[ -~]*$') AND NOT regexp_matches(proposed_name, '[a-z][A-Z]')),
f AS (SELECT {_PLAIN.format(c="form")} AS k, min(type_id) AS type_id FROM (SELECT type_id, canonical_name AS form FROM type_catalog UNION ALL SELECT type_id, unnest(aliases) FROM type_catalog) WHERE type_id IS NOT NULL GROUP BY 1)
SELECT c.candidate_id, f.type_id FROM c JOIN f ON f.k = {_PLAIN.format(c="c.proposed_name")} AND f.k <> ''""",
    "p8_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, length(coalesce(text, ''))::INTEGER AS characters FROM documents",
    "p9_kept": "SELECT doc_id, TRUE AS is_whole, TRUE AS is_fitting FROM documents",
    "p1_found": _SEEN + "SELECT tbl, ingest_seq FROM f WHERE ingest_seq > first_seq",
    "p1_rates": _SEEN + "SELECT tbl, count(*) AS keyed_rows, count(DISTINCT key) AS first_rows, count(*) - count(DISTINCT key) AS repeat_rows, least(1, pow(count(DISTINCT key), 2) / pow(2, 129))::DOUBLE AS wrong_rate FROM f GROUP BY tbl",
    "p6_found": _CLOSENESS + "SELECT observation_id, arg_min(entity_id, (-round(closeness, 12), entity_id)) AS entity_id FROM b GROUP BY observation_id",
    "p6_ranking": _CLOSENESS + "SELECT observation_id, entity_id, round(closeness, 6) AS closeness, row_number() OVER (PARTITION BY observation_id ORDER BY round(closeness, 12) DESC, entity_id)::INTEGER AS place FROM b",
    "p5_found": """
WITH RECURSIVE r AS (SELECT 'entities' AS tbl, entity_id AS id, trim(canonical_entity_id) AS p FROM entities UNION SELECT 'type_candidates', candidate_id, trim(merged_into_candidate_id) FROM type_candidates),
l AS (SELECT tbl, id, p FROM r WHERE p <> '' UNION SELECT tbl, p, id FROM r WHERE p <> ''),
w AS (SELECT DISTINCT tbl, id, id AS other FROM l UNION SELECT w.tbl, w.id, l.p FROM w JOIN l ON l.tbl = w.tbl AND l.id = w.other),
g AS (SELECT w.tbl, w.id, min(w.other) AS group_id, count(*) AS n FROM w JOIN (SELECT DISTINCT tbl, id FROM r) s ON s.tbl = w.tbl AND s.id = w.other GROUP BY ALL)
SELECT g.tbl, g.id AS record_id, g.group_id FROM g JOIN (SELECT DISTINCT tbl, id FROM r) s ON s.tbl = g.tbl AND s.id = g.id WHERE g.n > 1""",
}
