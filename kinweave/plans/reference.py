"""Queries of the engine's own operators, over whole tables, and the SQL that gives the same rows.

Doubles are rounded on both sides; ids follow from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import documents as doc
from kinweave.functions import media, names, slots, spacetime
from kinweave.operators import candidates, canonical, events, identifiers, ingest, prototypes, reconcile, resolver, scoring, slotrefs, types, world
from kinweave.sources.tables import current_rows, table
from kinweave.storage import Scratch
from kinweave.streaming import pipeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def _r12(c, name: str | None = None):
    """For products of six-digit numbers, which six decimals would cut at a tie."""
    return F.round(c, 12).alias(name or c)


def _current_sql(t: str, key: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingest_seq DESC) AS rn FROM {t} WHERE {key} IS NOT NULL) WHERE rn = 1)"


# Contents


@query("""SELECT substr(sha256('blob|' || s), 1, 32) AS blob_id, s AS sha256, size_bytes, storage_path, copies FROM (
  SELECT sha256(text) AS s, strlen(text)::BIGINT AS size_bytes, source AS storage_path, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE text IS NOT NULL) WHERE rn = 1""")
def blob_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.blobs_of(table(spark, folder, "documents"), "text", "source", "doc_id")


@query("""SELECT doc_id, source AS source_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1""")
def duplicate_skip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.col("source").alias("source_id"), names.derived_id("blob", ingest.content_hash("text")).alias("blob_id"))
    return ingest.new_observations(docs, docs.limit(0), "doc_id").select("doc_id", "source_id")


@query("""SELECT sha256(t.text) AS sha256 FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) t WHERE sha256(t.text) NOT IN (SELECT lower(trim(sha256)) FROM blobs WHERE sha256 IS NOT NULL)""")
def new_contents(spark: SparkSession, folder: str) -> DataFrame:
    mine = ingest.blobs_of(table(spark, folder, "documents"), "text", "source", "doc_id")
    known = table(spark, folder, "blobs").select(F.lower(F.trim("sha256")).alias("sha256")).where("sha256 is not null")
    return ingest.new_blobs(mine, known).select("sha256")


_EXTENSION = " ".join(f"WHEN e IN ({', '.join(repr(e) for e in all_)}) THEN '{medium}'" for medium, all_ in media.EXTENSIONS.items())


@query(f"""SELECT observation_id, ingest_seq, CASE {_EXTENSION} END AS medium FROM (
  SELECT observation_id, ingest_seq, lower(regexp_extract(regexp_extract(source_id, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS e FROM observations)""")
def medium_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observations").select("observation_id", "ingest_seq", media.medium_by_extension("source_id").alias("medium"))


@query()
def medium_probe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", media.probe_medium(F.encode("text", "UTF-8"), "source").alias("medium"), media.probe_header(F.encode("text", "UTF-8"), "source").alias("header_medium"))


_AFFORDANCES = ", ".join(f"('{m}', '{a}')" for m, all_ in media.AFFORDANCES.items() for a in all_)


@query(f"SELECT o.medium, a.affordance, count(*) AS n FROM observations o JOIN (VALUES {_AFFORDANCES}) a(medium, affordance) ON a.medium = o.medium GROUP BY ALL")
def affordances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observations").select("medium", F.explode(media.affordances("medium")).alias("affordance")).groupBy("medium", "affordance").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(left(text, 8000)) AS excerpt_hash, length(text)::INTEGER AS char_count, length(text) > 8000 AS truncated FROM documents")
def text_extract(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "documents").select("doc_id", doc.text_features("text").alias("f"))
    return f.select("doc_id", F.sha2("f.extracted_text", 256).alias("excerpt_hash"), "f.char_count", "f.truncated")


@query("""SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS flat_text, left(sha256('{"properties":{"k":{"type":"integer"}},"type":"object"}'), 16) AS schema_hash, 1 AS key_count, FALSE AS is_array FROM events WHERE json_valid(props)""")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", doc.json_features("props").alias("f")).where("f.valid")
    return rows.select("event_id", "f.flat_text", "f.schema_hash", "f.key_count", "f.is_array")


@query("""SELECT o_orderkey AS source_key, t AS id_type, v AS id_value, 'json' AS id_namespace FROM (
  SELECT o_orderkey, 'order_id' AS t, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT o_orderkey, 'ref', 'C-' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'code', trim(o_orderpriority) FROM orders) WHERE v <> ''""")
def json_det_ids(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    nested = F.struct(F.struct(F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("Ref"), F.col("o_totalprice").alias("id")).alias("customer"), F.array(F.struct(F.col("o_orderpriority").alias("code"))).alias("lines"), F.col("o_orderkey").alias("order_id"))
    rows = o.select(F.col("o_orderkey").alias("source_key"), doc.json_features(F.to_json(nested)).alias("f"))
    return rows.select("source_key", F.explode("f.ids").alias("i")).select("source_key", "i.*")


# Identifiers

_MAP = " ".join(f"WHEN id_type = '{t}' THEN '{n}'" for t, n in names.MAPPED_NAMESPACES.items())
_VALID = "coalesce(regexp_full_match(id_namespace, '" + "|".join(names.NAMESPACE_PATTERNS) + "'), FALSE)"
_NAMESPACE = f"""SELECT *, CASE WHEN m IS NOT NULL THEN m WHEN {_VALID} THEN id_namespace ELSE 'source:context' END AS ns,
  CASE WHEN m IS NOT NULL THEN CASE WHEN coalesce(id_namespace, '') <> '' AND id_namespace <> m THEN 'id_type_mapped' END WHEN {_VALID} THEN NULL WHEN coalesce(id_namespace, '') <> '' THEN 'invalid_pattern' ELSE 'empty_namespace' END AS why
  FROM (SELECT *, CASE {_MAP} END AS m FROM entity_deterministic_ids)"""


@query(f"SELECT ingest_seq, id, ns AS id_namespace, id_namespace AS original_namespace, why AS reason FROM ({_NAMESPACE})")
def namespace_resolution(spark: SparkSession, folder: str) -> DataFrame:
    rows = identifiers.normalized(table(spark, folder, "entity_deterministic_ids"), F.lit("source:context"))
    return rows.select("ingest_seq", "id", "id_namespace", "original_namespace", "reason")


@query(f"SELECT why AS reason, ns AS id_namespace, count(*) AS n FROM ({_NAMESPACE}) WHERE why IS NOT NULL GROUP BY ALL")
def namespace_overrides(spark: SparkSession, folder: str) -> DataFrame:
    rows = identifiers.overrides(identifiers.normalized(table(spark, folder, "entity_deterministic_ids"), F.lit("source:context")))
    return rows.groupBy("reason", "id_namespace").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT entity_id, id_type, id_value, ns AS id_namespace, CASE WHEN max(confidence) = 1 THEN 'extracted' ELSE 'proposed' END AS origin FROM ({_NAMESPACE}) WHERE confidence IS NOT NULL GROUP BY entity_id, id_type, id_value, ns")
def det_id_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entity_deterministic_ids").select("entity_id", *identifiers.KEY, "confidence")
    sure, other = rows.where("confidence = 1").drop("confidence"), rows.where("confidence <> 1").drop("confidence")
    return identifiers.union_ids(sure, other, "entity_id", F.lit("source:context")).select("entity_id", *identifiers.KEY, "origin")


def _line_ids(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("observation_id"), F.array(F.struct(F.lit("order_id").alias("id_type"), F.col("l_orderkey").cast("string").alias("id_value")), F.struct(F.lit("product_id").alias("id_type"), F.col("l_partkey").cast("string").alias("id_value"))).alias("ids"))
    return line.select("observation_id", F.explode("ids").alias("i")).select("observation_id", "i.*", F.lit("source:lineitem").alias("id_namespace"))


def _line_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    none = spark.createDataFrame([], "id_type string, id_value string, id_namespace string, entity_id string")
    return identifiers.resolve_ids(_line_ids(spark, folder), none)


_LINE = """WITH i AS (SELECT l_orderkey || '-' || l_linenumber AS o, 'order_id' AS t, l_orderkey::VARCHAR AS v FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'product_id', l_partkey::VARCHAR FROM lineitem),
k AS (SELECT o, t, v, substr(sha256('entity|' || t || '|' || v || '|source:lineitem'), 1, 32) AS entity_id FROM i) """


@query(_LINE + "SELECT entity_id, count(DISTINCT o) AS observations, count(*)::BIGINT AS hard_links FROM k GROUP BY entity_id HAVING count(DISTINCT o) >= 2")
def entities_in_use(spark: SparkSession, folder: str) -> DataFrame:
    return world.links_per_entity(_line_links(spark, folder)[0], 2)


@query(_LINE + "SELECT DISTINCT t AS id_type, v AS id_value, entity_id, t || ':' || v AS name, 1.0::DOUBLE AS confidence FROM k")
def det_id_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _line_links(spark, folder)[1].select("id_type", "id_value", "entity_id", "name", "confidence")


_DID = _current_sql("entity_deterministic_ids", "id")


@query(f"SELECT id_type, id_value, id_namespace, min(entity_id) AS first_entity, max(entity_id) AS last_entity, count(*) AS bindings FROM {_DID} WHERE entity_id IS NOT NULL GROUP BY ALL HAVING min(entity_id) <> max(entity_id)")
def det_id_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return identifiers.conflicts(current_rows(table(spark, folder, "entity_deterministic_ids"), "id", "entity_id", *identifiers.KEY))


@query("""SELECT i.id, b.entity_id AS bound_entity FROM entity_deterministic_ids i LEFT JOIN (SELECT id_type, id_value, id_namespace, min(entity_id) AS entity_id FROM entity_deterministic_ids GROUP BY ALL) b
  ON b.id_type = i.id_type AND b.id_value = i.id_value AND b.id_namespace = i.id_namespace""")
def det_id_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entity_deterministic_ids")
    return identifiers.lookup(rows.select("id", *identifiers.KEY), rows).select("id", F.col("entity_id").alias("bound_entity"))


# Candidates, scores, decisions


@query("""SELECT q.vec_id::VARCHAR AS query_id, e.vec_id::VARCHAR AS entity_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM
  embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, e.vec_id::VARCHAR) <= 20""")
def knn_candidates(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    found = candidates.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector")), 20)
    return found.select("query_id", "entity_id", _r("cosine"))


_ENT = _current_sql("entities", "entity_id")


@query(f"SELECT coalesce(entity_nature, '') AS entity_nature, count(*) AS n FROM {_ENT} WHERE prototype_text_embedding IS NOT NULL AND coalesce(trim(canonical_entity_id), '') = '' AND coalesce(status, '') <> 'deprecated' GROUP BY 1")
def candidate_pool(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "canonical_entity_id", "status", "prototype_text_embedding")
    return candidates.live_pool(e, "prototype_text_embedding").groupBy(F.coalesce("entity_nature", F.lit("")).alias("entity_nature")).agg(F.count(F.lit(1)).alias("n"))


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """The signals of each candidate, one row for each result; image similarity is taken as it is, text as a percentage."""
    r = table(spark, folder, "similarity_results").select("result_id", "observation_id", "entity_id", "image_similarity", "text_similarity", "signals").dropDuplicates(["result_id"])
    signal = lambda n: F.get(F.transform(F.filter(F.coalesce("signals", F.array()), lambda s: (s["signal_name"] == n) & s["available"]), lambda s: s["score"]), F.lit(0)).alias(n)
    return r.select("result_id", "observation_id", "entity_id", F.col("image_similarity").alias("image"), (F.col("text_similarity") / 100).alias("text"), signal("location"), signal("timestamp"))


_SIGNALS = """s AS (SELECT result_id, observation_id, entity_id, image_similarity AS image, text_similarity / 100 AS text,
  list_filter(signals, lambda x: x.signal_name = 'location' AND x.available)[1].score AS location, list_filter(signals, lambda x: x.signal_name = 'timestamp' AND x.available)[1].score AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY created_at) AS rn FROM similarity_results) WHERE rn = 1)"""
_SCORE = """w AS (SELECT *, (image IS NOT NULL)::INT + (location IS NOT NULL)::INT + (ts IS NOT NULL)::INT AS n,
  CASE WHEN image IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN location IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN ts IS NULL THEN 0 ELSE 0.10::DOUBLE END AS weight FROM s),
m AS (SELECT *, (coalesce(image, 0) * 0.35::DOUBLE + coalesce(location, 0) * 0.15::DOUBLE + coalesce(ts, 0) * 0.10::DOUBLE) / weight AS mean FROM w),
scored AS (SELECT *, round(CASE WHEN n = 0 THEN 0 WHEN n >= 3 AND weight < 0.5 THEN mean * (0.7 + 0.3 * sqrt(weight)) ELSE mean END, 12) AS score, round(sqrt(weight), 12) AS coverage,
  CASE n WHEN 0 THEN 'no_signals_available' WHEN 1 THEN 'single_signal,low_evidence' WHEN 2 THEN 'sparse_signals' ELSE '' END AS flags FROM m)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    s = _signals(spark, folder)
    score = scoring.combined_score("individual", {"image": F.col("image"), "location": F.col("location"), "timestamp": F.col("timestamp")})
    return s.withColumn("_s", score).select("result_id", "observation_id", "entity_id", "image", _r12("_s.score", "score"), _r12("_s.coverage", "coverage"), F.col("_s.flags").alias("score_flags"))


@query(f"WITH {_SIGNALS}, {_SCORE} SELECT result_id, score, coverage, flags FROM scored")
def individual_score(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("result_id", "score", "coverage", F.array_join("score_flags", ",").alias("flags"))


@query(f"""WITH {_SIGNALS}, c AS (SELECT s.*, e.name, t.canonical_name, CASE WHEN trim(coalesce(e.name, '')) = '' OR trim(coalesce(t.canonical_name, '')) = '' THEN NULL WHEN lower(trim(e.name)) = lower(trim(t.canonical_name)) THEN 1
   WHEN contains(lower(trim(e.name)), lower(trim(t.canonical_name))) OR contains(lower(trim(t.canonical_name)), lower(trim(e.name))) THEN 0.7 ELSE 0 END::DOUBLE AS nm
  FROM s LEFT JOIN {_ENT} e ON e.entity_id = s.entity_id LEFT JOIN {_current_sql("types", "type_id")} t ON t.type_id = e.type_id),
 w AS (SELECT *, CASE WHEN text IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN nm IS NULL THEN 0 ELSE 0.2::DOUBLE END AS weight FROM c)
 SELECT result_id, CASE WHEN weight = 0 THEN 0 ELSE round((coalesce(text, 0) * 0.4::DOUBLE + coalesce(nm, 0) * 0.2::DOUBLE) / weight, 12) END AS score FROM w""")
def class_score(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "name", "type_id")
    t = current_rows(table(spark, folder, "types"), "type_id", "canonical_name")
    rows = _signals(spark, folder).join(e, "entity_id", "left").join(t, "type_id", "left")
    score = scoring.combined_score("class", {"text": F.col("text"), "name": names.name_match("name", "canonical_name")})
    return rows.withColumn("_s", score).select("result_id", _r12("_s.score", "score"))


_DECIDE = """best AS (SELECT *, coalesce(lead(score) OVER o, 0) AS second, count(*) OVER (PARTITION BY observation_id) AS pool_size, row_number() OVER o AS rn FROM scored WINDOW o AS (PARTITION BY observation_id ORDER BY score DESC, entity_id)),
d AS (SELECT *, score - second AS margin, image IS NULL OR (image >= 0.75 AND NOT (pool_size = 1 AND score < 0.95)) AS guard FROM best WHERE rn = 1),
decided AS (SELECT *, CASE WHEN score >= 0.85 AND guard THEN 'link' WHEN score >= 0.6 THEN 'candidate' ELSE 'new' END AS decision FROM d)"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).select("observation_id", "entity_id", "score", "image", F.size("score_flags").alias("_f"), F.lit("individual").alias("nature"), F.lit(0).alias("rank"), F.exists("score_flags", lambda f: f.isin("sparse_signals", "single_signal")).alias("sparse"))
    return scoring.decide(scoring.with_margin(rows, "observation_id"))


@query(f"WITH {_SIGNALS}, {_SCORE}, {_DECIDE} SELECT observation_id, entity_id, decision, CASE WHEN decision = 'new' THEN 0.8 ELSE score END::DOUBLE AS posterior, round(margin, 12) AS margin, pool_size FROM decided")
def link_decision(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select("observation_id", "entity_id", "decision", "posterior", _r12("margin"), "pool_size")


@query(f"""WITH {_SIGNALS}, {_SCORE}, {_DECIDE}, p AS (SELECT *, substr(sha256('entity|proto|' || observation_id), 1, 32) AS proto FROM decided)
 SELECT observation_id, CASE WHEN decision = 'new' THEN proto ELSE entity_id END AS entity_id, CASE decision WHEN 'candidate' THEN 'candidate' ELSE 'soft' END AS status, round(CASE WHEN decision = 'new' THEN 0.8 ELSE score END, 12)::DOUBLE AS posterior FROM p
 UNION ALL SELECT observation_id, proto, 'candidate', round(1 - score, 12) FROM p WHERE decision = 'candidate'""")
def decision_links(spark: SparkSession, folder: str) -> DataFrame:
    links = scoring.links_of(_decided(spark, folder), names.derived_id("entity", F.lit("proto"), "observation_id"), "observation_id")
    return links.select("observation_id", "entity_id", "status", _r12("posterior"))


def _seed_links(spark: SparkSession, folder: str) -> DataFrame:
    """Two links of each result: by image as subject, by text as the context of an event and else as subject."""
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature")
    rows = _signals(spark, folder).join(e, "entity_id", "left")
    each = F.array(F.struct(F.lit(0).alias("seed_index"), F.col("image").alias("posterior"), F.lit("subject").alias("role")), F.struct(F.lit(1).alias("seed_index"), F.col("text").alias("posterior"), F.when(F.col("entity_nature") == "event", "context").otherwise("subject").alias("role")))
    return rows.select("observation_id", "entity_id", F.explode(each).alias("l")).select("observation_id", "entity_id", "l.*", F.lit("soft").alias("status"), F.array().cast("array<string>").alias("flags")).where("posterior is not null")


_SEEDS = f"""WITH {_SIGNALS}, l AS (SELECT s.observation_id, s.entity_id, 0 AS seed_index, image AS posterior, 'subject' AS role FROM s WHERE image IS NOT NULL
  UNION ALL SELECT s.observation_id, s.entity_id, 1, text, CASE WHEN e.entity_nature = 'event' THEN 'context' ELSE 'subject' END FROM s LEFT JOIN {_ENT} e ON e.entity_id = s.entity_id WHERE text IS NOT NULL),
a AS (SELECT *, count(*) OVER g > 1 AS several, max((role = 'subject')::INT) OVER g + max((role = 'context')::INT) OVER g = 2 AS both_roles FROM l WINDOW g AS (PARTITION BY observation_id, entity_id)),
b AS (SELECT *, posterior * CASE WHEN several AND both_roles THEN 0.5 ELSE 1 END AS p FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY p DESC, seed_index) AS rn FROM b),
x AS (SELECT observation_id, entity_id, seed_index, role, p * CASE WHEN several AND rn > 1 THEN 0.5 ELSE 1 END AS posterior, (several AND both_roles)::INT + several::INT AS conflicts,
  concat_ws(',', CASE WHEN several AND both_roles THEN 'multi_seed_role_conflict' END, CASE WHEN several AND rn > 1 THEN 'duplicate_entity_link' END) AS flags FROM r)"""


@query(_SEEDS + " SELECT observation_id, entity_id, seed_index, role, round(posterior, 12) AS posterior, conflicts, flags FROM x")
def reconcile_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = reconcile.reconcile(_seed_links(spark, folder))
    return rows.select("observation_id", "entity_id", "seed_index", "role", _r12("posterior"), "conflicts", F.array_join("flags", ",").alias("flags"))


@query(_SEEDS + " SELECT observation_id, entity_id, seed_index, round(posterior, 12) AS posterior FROM x QUALIFY row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY posterior DESC, seed_index) = 1")
def dedup_links(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.deduplicated(reconcile.reconcile(_seed_links(spark, folder))).select("observation_id", "entity_id", "seed_index", _r12("posterior"))


@query(_SEEDS + """ SELECT substr(sha256('evolution|' || observation_id || '|' || entity_id), 1, 32) AS evolution_id, entity_id, observation_id, 'link' AS kind, round(posterior, 12) AS score, 0.85::DOUBLE AS threshold, 'resolver-v1.0' AS version
 FROM x QUALIFY row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY posterior DESC, seed_index) = 1""")
def evolution_audit(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.audit(reconcile.deduplicated(reconcile.reconcile(_seed_links(spark, folder)))).withColumn("score", F.round("score", 12))


_ROOTS = """WITH RECURSIVE c AS {cur}, n AS (SELECT {k} AS id, CASE WHEN trim({p}) IN (SELECT {k} FROM c) THEN trim({p}) END AS parent FROM c),
w AS (SELECT id, id AS root, 0 AS steps FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.root, w.steps + 1 FROM w JOIN n ON n.parent = w.id),
chains AS (SELECT n.id, w.root, coalesce(w.steps, -1)::INTEGER AS steps FROM n LEFT JOIN w ON w.id = n.id) """
_ENTITY_ROOTS = _ROOTS.format(cur=_ENT, k="entity_id", p="canonical_entity_id")


def _chains(spark: SparkSession, folder: str, t: str, key: str, pointer: str) -> tuple[DataFrame, DataFrame]:
    rows = current_rows(table(spark, folder, t), key, pointer)
    return rows, canonical.canonical(rows, key, pointer, Scratch(spark, "chains"))


@query(_ENTITY_ROOTS + "SELECT id, root, steps FROM chains")
def canonical_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _chains(spark, folder, "entities", "entity_id", "canonical_entity_id")[1]


@query(_ENTITY_ROOTS + "SELECT c.entity_id, CASE WHEN h.steps > 1 THEN h.root ELSE c.canonical_entity_id END AS canonical_entity_id FROM c JOIN chains h ON h.id = c.entity_id")
def path_compression(spark: SparkSession, folder: str) -> DataFrame:
    rows, chains = _chains(spark, folder, "entities", "entity_id", "canonical_entity_id")
    return canonical.compressed(rows, chains, "entity_id", "canonical_entity_id").select("entity_id", "canonical_entity_id")


@query(_ROOTS.format(cur=_current_sql("type_candidates", "candidate_id"), k="candidate_id", p="merged_into_candidate_id") + "SELECT id, root, steps FROM chains")
def candidate_chains(spark: SparkSession, folder: str) -> DataFrame:
    return _chains(spark, folder, "type_candidates", "candidate_id", "merged_into_candidate_id")[1]


@query(_ROOTS.format(cur=f"(SELECT *, CASE WHEN status = 'merged_into' THEN merged_into_type_id END AS p FROM {_current_sql('types', 'type_id')})", k="type_id", p="p") + "SELECT id, root, steps FROM chains")
def type_resolve(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "types"), "type_id", F.when(F.col("status") == "merged_into", F.col("merged_into_type_id")).alias("p"))
    return canonical.canonical(rows, "type_id", "p", Scratch(spark, "chains"))


@query(_SEEDS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _ENTITY_ROOTS.replace("WITH RECURSIVE ", "").replace("w AS", "w2 AS").replace("FROM w ", "FROM w2 ").replace("JOIN w ", "JOIN w2 ").replace("w.", "w2.") + """,
 y AS (SELECT x.*, coalesce(h.root, x.entity_id) AS e FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY posterior DESC, seed_index) = 1) x LEFT JOIN chains h ON h.id = x.entity_id)
 SELECT observation_id, e AS entity_id, round(max(posterior), 12) AS posterior FROM y GROUP BY ALL""")
def canonical_links(spark: SparkSession, folder: str) -> DataFrame:
    links = reconcile.deduplicated(reconcile.reconcile(_seed_links(spark, folder)))
    return reconcile.canonicalised(links, _chains(spark, folder, "entities", "entity_id", "canonical_entity_id")[1]).select("observation_id", "entity_id", _r12("posterior"))


_USABLE = "len({v}) = 64 AND list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0))"


@query(f"""WITH s AS (SELECT signature_id, image_embedding::DOUBLE[] AS v FROM {_current_sql("signatures", "signature_id")} WHERE image_embedding IS NOT NULL AND {_USABLE.format(v="image_embedding")}),
e AS (SELECT entity_id, prototype_image_embedding::DOUBLE[] AS v FROM {_ENT} WHERE entity_nature = 'individual' AND coalesce(trim(canonical_entity_id), '') = '' AND coalesce(status, '') <> 'deprecated' AND prototype_image_embedding IS NOT NULL AND {_USABLE.format(v="prototype_image_embedding")}),
p AS (SELECT s.signature_id, e.entity_id, (round(list_cosine_similarity(s.v, e.v), 12) + 1) / 2 AS sim, count(*) OVER (PARTITION BY s.signature_id) AS n FROM s, e),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY sim DESC, entity_id) = 1)
SELECT signature_id, entity_id, round(sim, 6) AS score, CASE WHEN sim >= 0.85 AND NOT (n = 1 AND sim < 0.95) THEN 'link' WHEN sim >= 0.6 THEN 'candidate' ELSE 'new' END AS decision FROM b""")
def resolve_images(spark: SparkSession, folder: str) -> DataFrame:
    """The whole similarity path: pool, exact nearest prototypes, score, margin, decision, for every image signature."""
    s = current_rows(table(spark, folder, "signatures"), "signature_id", "image_embedding")
    none = F.lit(None)
    seeds = s.select(F.col("signature_id").alias("observation_id"), F.lit(0).alias("seed_index"), F.lit("individual").alias("entity_nature"), F.col("image_embedding").alias("vector"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), none.cast("timestamp").alias("at"), none.cast("map<string,string>").alias("facets"), none.cast("string").alias("suggested_name"))
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "name", "slots", "canonical_entity_id", "status", "prototype_image_embedding", "prototype_text_embedding")
    _, decided = resolver.similarity_links(seeds, resolver.entity_facts(e), Scratch(spark, "resolve"), dim=64)
    return decided.select(F.col("observation_id").alias("signature_id"), "entity_id", _r("score"), "decision")


def _batch(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every observation as one batch: images seed what they show, texts a class; places follow from the order of arrival; contents are identifiers, the first half of which is bound."""
    o = current_rows(table(spark, folder, "observations"), "observation_id", "ingest_seq", "medium", "blob_id", "created_at")
    text = lambda c: c.cast("string")
    facets = F.map_filter(F.create_map(F.lit("latitude"), text((F.col("ingest_seq") % 500) / 100), F.lit("longitude"), text((F.col("ingest_seq") % 497) / 100 + 35), F.lit("datetime"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), lambda k, v: v.isNotNull())
    observations = o.select("observation_id", "medium", F.col("ingest_seq").alias("seq"), facets.alias("facets"), "blob_id")
    slots = F.array().cast("array<struct<name:string,value:string,is_reference:boolean,ref_nature:string>>")
    seeds = observations.where("medium in ('image', 'text')").select("observation_id", F.lit(0).alias("seed_index"), F.when(F.col("medium") == "image", "individual").otherwise("class").alias("entity_nature"), F.when(F.col("medium") == "image", resolver.SUBJECT).alias("entity_type"), F.lit(None).cast("string").alias("suggested_name"), slots.alias("slots"), F.lit(0.6).alias("confidence"))
    ids = observations.where("blob_id is not null").select("observation_id", F.lit(None).cast("int").alias("seed_index"), F.lit("blob").alias("id_type"), F.col("blob_id").alias("id_value"), F.lit("source:test").alias("id_namespace"))
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "name", "slots", "canonical_entity_id", "status", "prototype_image_embedding", "prototype_text_embedding", "prototype_count")
    start = lambda c: F.substring(c, 1, 2)
    firsts = e.groupBy(start("entity_id").alias("h")).agg(F.min("entity_id").alias("entity_id"))
    bindings = ids.select("id_type", "id_value", "id_namespace").distinct().where(start("id_value") < "80").withColumn("h", start("id_value")).join(firsts, "h").drop("h")
    s = current_rows(table(spark, folder, "signatures"), "signature_id", "observation_id", "image_embedding", "text_embedding")
    scratch = Scratch(spark, "batch")
    chains = canonical.canonical(e.select("entity_id", "canonical_entity_id"), "entity_id", "canonical_entity_id", scratch)
    return resolver.resolve(observations, s, seeds, ids, e, bindings, chains, scratch, dim=64)


_GOOD = lambda v: f"{v} IS NOT NULL AND " + _USABLE.format(v=v)
_POOL = lambda nature, v: f"SELECT entity_id, '{nature}' AS nature, {v}::DOUBLE[] AS v, coalesce(cardinality(slots), 0) > 0 AS has_slots, slots['latitude'].value_num AS lat, slots['longitude'].value_num AS lon FROM c WHERE entity_nature = '{nature}' AND coalesce(trim(canonical_entity_id), '') = '' AND coalesce(status, '') <> 'deprecated' AND {_GOOD(v)}"
_KM = "2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))))"
_BATCH = _ENTITY_ROOTS.replace(" WHERE parent IS NULL UNION ALL SELECT n.id, w.root", " WHERE parent IS NULL UNION ALL SELECT n.id, w.root").rstrip() + f""",
o AS (SELECT observation_id, medium, blob_id, strftime(created_at, '%Y-%m-%d') AS d, (ingest_seq % 500) / 100.0::DOUBLE AS lat, (ingest_seq % 497) / 100.0::DOUBLE + 35 AS lon FROM {_current_sql("observations", "observation_id")}),
sg AS (SELECT observation_id, arg_min(image_embedding, signature_id) FILTER (image_embedding IS NOT NULL) AS iv, arg_min(text_embedding, signature_id) FILTER (text_embedding IS NOT NULL) AS tv FROM {_current_sql("signatures", "signature_id")} GROUP BY 1),
seed AS (SELECT o.observation_id, o.lat, o.lon, CASE medium WHEN 'image' THEN 'individual' ELSE 'class' END AS nature, CASE medium WHEN 'image' THEN iv ELSE tv END AS v FROM o LEFT JOIN sg ON sg.observation_id = o.observation_id WHERE medium IN ('image', 'text')),
pool AS ({_POOL("individual", "prototype_image_embedding")} UNION ALL {_POOL("class", "prototype_text_embedding")}),
p AS (SELECT s.observation_id, s.nature, e.entity_id, e.has_slots, round(list_cosine_similarity(s.v::DOUBLE[], e.v), 12) AS cos, CASE WHEN e.lat IS NOT NULL AND e.lon IS NOT NULL THEN exp(-({_KM.format(a="s", b="e")}) / 10) END AS place
  FROM (SELECT * FROM seed WHERE {_GOOD("v")}) s JOIN pool e ON e.nature = s.nature QUALIFY row_number() OVER (PARTITION BY s.observation_id ORDER BY cos DESC, e.entity_id) <= 200),
sc AS (SELECT *, (cos + 1) / 2 AS sim, row_number() OVER (PARTITION BY observation_id ORDER BY cos DESC, entity_id) AS rk FROM p),
sd AS (SELECT *, CASE nature WHEN 'individual' THEN CASE WHEN place IS NULL THEN sim ELSE (sim * 0.35::DOUBLE + place * 0.15::DOUBLE) / 0.5 END ELSE CASE WHEN has_slots THEN sim * 0.4::DOUBLE / 0.7::DOUBLE ELSE sim END END AS score, count(*) OVER (PARTITION BY observation_id) AS n FROM sc),
best AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY score DESC, rk, entity_id) = 1),
dec AS (SELECT s.observation_id, substr(sha256('entity|proto|' || s.observation_id || '|0'), 1, 32) AS proto, b.entity_id, b.score, CASE WHEN b.score >= 0.85 AND (b.nature <> 'individual' OR (b.sim >= 0.75 AND NOT (b.n = 1 AND b.score < 0.95))) THEN 'link' WHEN b.score >= 0.6 THEN 'candidate' ELSE 'new' END AS decision FROM seed s LEFT JOIN best b ON b.observation_id = s.observation_id),
bind AS (SELECT left(entity_id, 2) AS h, min(entity_id) AS entity_id FROM c GROUP BY 1),
ev AS (SELECT entity_id, slots['event_date'].value_str AS d, slots['latitude'].value_num AS lat, slots['longitude'].value_num AS lon FROM c WHERE entity_nature = 'event' AND coalesce(trim(canonical_entity_id), '') = '' AND coalesce(status, '') <> 'deprecated'),
al AS (SELECT o.observation_id, e.entity_id, CASE WHEN o.d = e.d THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {_KM.format(a="o", b="e")} < 20 THEN 0.3::DOUBLE * (1 - {_KM.format(a="o", b="e")} / 20) ELSE 0 END AS s FROM o JOIN ev e ON o.d IS NULL OR o.d = e.d WHERE o.medium = 'image'),
l AS (SELECT o.observation_id, coalesce(b.entity_id, substr(sha256('entity|blob|' || blob_id || '|source:test'), 1, 32)) AS entity_id, -1 AS seed_index, 1.0::DOUBLE AS posterior, 'hard' AS status, 'subject' AS role FROM o LEFT JOIN bind b ON b.h = left(blob_id, 2) AND b.h < '80' WHERE blob_id IS NOT NULL
  UNION ALL SELECT observation_id, CASE WHEN decision = 'new' THEN proto ELSE entity_id END, 0, CASE WHEN decision = 'new' THEN 0.8 ELSE score END, CASE decision WHEN 'candidate' THEN 'candidate' ELSE 'soft' END, 'subject' FROM dec
  UNION ALL SELECT observation_id, proto, 0, 1 - score, 'candidate', 'subject' FROM dec WHERE decision = 'candidate'
  UNION ALL SELECT observation_id, entity_id, 1048576, s, CASE WHEN s >= 0.5 THEN 'soft' ELSE 'candidate' END, 'context' FROM al WHERE s >= 0.3),
a AS (SELECT *, count(*) OVER g > 1 AS several, max((role = 'subject')::INT) OVER g + max((role = 'context')::INT) OVER g = 2 AS both_roles FROM l WINDOW g AS (PARTITION BY observation_id, entity_id)),
f AS (SELECT *, posterior * CASE WHEN several AND both_roles THEN 0.5 ELSE 1 END AS q FROM a),
once AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY q DESC, seed_index) = 1),
moved AS (SELECT observation_id, coalesce(h.root, once.entity_id) AS entity_id, q, status, role, seed_index FROM once LEFT JOIN chains h ON h.id = once.entity_id),
final AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY observation_id, entity_id ORDER BY q DESC, seed_index) = 1)
"""


@query(_BATCH + "SELECT observation_id, entity_id, round(q, 6) AS posterior, status, role FROM final")
def resolve_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The composed resolver over all observations: identifiers, similarity, events, reconciliation, merge chains."""
    return _batch(spark, folder)["links"].select("observation_id", "entity_id", _r("posterior"), "status", "role")


@query(_BATCH + ", u AS (SELECT final.entity_id, count(*) AS n FROM final JOIN c ON c.entity_id = final.entity_id JOIN sg ON sg.observation_id = final.observation_id WHERE (final.status = 'hard' OR (final.status = 'soft' AND q >= 0.85))"
    " AND (tv IS NOT NULL OR (iv IS NOT NULL AND (coalesce(c.name, '') = '' OR list_has_any(map_keys(c.slots), ['latitude', 'gps_latitude'])))) GROUP BY 1)"
    " SELECT u.entity_id, (coalesce(c.prototype_count, 0) + n)::INTEGER AS prototype_count FROM u JOIN c ON c.entity_id = u.entity_id")
def resolve_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of the world whose prototypes the batch changes, and how many updates they have had then."""
    known = current_rows(table(spark, folder, "entities"), "entity_id")
    return _batch(spark, folder)["prototypes"].join(known, "entity_id", "left_semi").select("entity_id", "prototype_count")


# Prototypes


def _updates(spark: SparkSession, folder: str, weight: float, current: bool) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("entity_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), F.lit(weight).alias("weight"))
    stored = e.groupBy("entity_id").agg(F.min_by("vector", "seq").alias("current")).withColumn("prototype_count", F.lit(3)) if current else e.select("entity_id").distinct().select("entity_id", F.lit(None).cast("array<float>").alias("current"), F.lit(0).alias("prototype_count"))
    return e.join(stored, "entity_id")


@query("SELECT label::VARCHAR AS entity_id, i - 1 AS i, round(avg(x), 6) AS x, count(*) AS prototype_count FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL")
def prototype_update(spark: SparkSession, folder: str) -> DataFrame:
    new = prototypes.updated(_updates(spark, folder, 1.0, False))
    return new.select("entity_id", F.posexplode("prototype").alias("i", "x"), F.col("prototype_count").cast("long").alias("prototype_count")).withColumn("i", F.col("i").cast("long")).withColumn("x", F.round("x", 6))


@query("""WITH RECURSIVE v AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
f AS (SELECT label, 0::BIGINT AS rn, e AS p FROM v WHERE rn = 1 UNION ALL
  SELECT f.label, v.rn, list_transform(list_zip(f.p, v.e), lambda z: (z[1] * (2 + v.rn) + z[2] * 0.5::DOUBLE) / (2.5::DOUBLE + v.rn)) FROM f JOIN v ON v.label = f.label AND v.rn = f.rn + 1)
SELECT label::VARCHAR AS entity_id, unnest(range(64)) AS i, round(unnest(p), 6) AS x, 3 + rn AS prototype_count FROM f QUALIFY rn = max(rn) OVER (PARTITION BY label)""")
def prototype_update_soft(spark: SparkSession, folder: str) -> DataFrame:
    new = prototypes.updated(_updates(spark, folder, 0.5, True))
    return new.select("entity_id", F.posexplode("prototype").alias("i", "x"), F.col("prototype_count").cast("long").alias("prototype_count")).withColumn("i", F.col("i").cast("long")).withColumn("x", F.round("x", 6))


_UNIT = "u AS (SELECT label, vec_id, i, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings))"


@query(f"WITH {_UNIT}, s AS (SELECT label, i, sum(x / n) AS s, count(*) AS members FROM u GROUP BY ALL) SELECT label, max(members) AS members, round((sum(s * s) - max(members)) / (max(members) * (max(members) - 1)), 6) AS coherence FROM s GROUP BY label")
def group_coherence(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vector"))
    return prototypes.coherence(e, "label").select("label", "members", _r("coherence"))


_CENTRE = """WITH c AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
d AS (SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.centre) AS cosine FROM embeddings e JOIN c ON c.label = e.label) """


@query(_CENTRE + "SELECT label, round(avg(1 - cosine), 6) AS spread FROM d GROUP BY label")
def prototype_spread(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vector"))
    return prototypes.spread(e, prototypes.centroid(e, "label"), "label").select("label", _r("spread"))


@query(_CENTRE + "SELECT label, vec_id, round(cosine, 6) AS cosine FROM d QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 5")
def prototype_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector"))
    return prototypes.exemplars(e, prototypes.centroid(e, "label"), "label", "vec_id").select("label", "vec_id", _r("cosine"))


# Slots


@query("""SELECT p_partkey AS part, s AS slot_name, k AS kind, v AS value, t AS type, c AS code FROM (
 SELECT p_partkey, 'brand' AS s, 'primitive' AS k, p_brand AS v, 'string' AS t, 'entity_reference_candidate' AS c FROM part UNION ALL
 SELECT p_partkey, 'size', 'primitive', p_size::VARCHAR, 'integer', 'bare_numeric' FROM part UNION ALL
 SELECT p_partkey, 'title', 'primitive', p_name, 'string', NULL FROM part UNION ALL
 SELECT p_partkey, 'weight', 'primitive', p_size::VARCHAR, 'number', NULL FROM part UNION ALL
 SELECT p_partkey, 'height', 'primitive', p_size::VARCHAR, 'number', 'missing_unit' FROM part UNION ALL
 SELECT p_partkey, 'maker', 'reference', NULL, NULL, NULL FROM part UNION ALL
 SELECT p_partkey, 'bad', 'primitive', p_type, 'string', 'malformed_primitive' FROM part UNION ALL
 SELECT p_partkey, 'tags[0]', 'primitive', p_type, 'string', NULL FROM part UNION ALL
 SELECT p_partkey, 'tags[1]', 'primitive', p_size::VARCHAR, 'integer', 'bare_numeric' FROM part)""")
def slot_normalize(spark: SparkSession, folder: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    raw = F.struct(
        F.col("p_brand").alias("brand"), size.alias("size"), F.col("p_name").alias("title"),
        F.struct(size.alias("value"), F.lit("number").alias("type"), F.lit("kg").alias("unit")).alias("weight"), F.struct(size.alias("value"), F.lit("number").alias("type")).alias("height"),
        F.struct(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("ref_entity_id"), F.lit("maker").alias("ref_type")).alias("maker"), F.struct(kind.alias("value")).alias("bad"),
    )
    text = F.concat(F.regexp_replace(F.to_json(raw), r"\}$", ""), F.lit(',"tags":['), F.to_json(F.struct(kind.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(kind.alias("x")))) - 6), F.lit(","), size.cast("string"), F.lit("]}"))
    rows = slots.normalize_slots(table(spark, folder, "part").select(F.col("p_partkey").alias("part"), text.alias("slots")), "part", "slots")
    return rows.select("part", "slot_name", "kind", "value", "type", "code")


@query("""SELECT entity_id, slot_name, v.kind AS kind, coalesce(v.ref_entity_id, v.value_str, CASE WHEN v.value_num IS NULL THEN NULL ELSE 'number' END) AS value FROM (
  SELECT entity_id, unnest(map_keys(slots)) AS slot_name, unnest(map_values(slots)) AS v FROM """ + _ENT + ")")
def slot_values(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "slots").select("entity_id", F.explode("slots").alias("slot_name", "s"))
    number = F.col("s.ref_entity_id").isNull() & F.col("s.value_str").isNull() & F.col("s.value_num").isNotNull()
    return e.select("entity_id", "slot_name", F.col("s.kind").alias("kind"), F.when(number, "number").otherwise(slots.index_value(F.col("s"))).alias("value"))


_LEX = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_REFS = f"""r AS (SELECT entity_id, slot_name, v.ref_nature AS given, v.ref_name AS raw, substr(v.ref_name, 5) AS rest FROM (SELECT entity_id, unnest(map_keys(slots)) AS slot_name, unnest(map_values(slots)) AS v FROM {_ENT})
  WHERE v.kind = 'reference' AND v.ref_name IS NOT NULL AND coalesce(trim(v.ref_entity_id), '') = ''),
q AS (SELECT *, CASE WHEN contains(rest, ':') THEN {_LEX.format(c="split_part(rest, ':', 1)")} ELSE 'ref' END AS ns0, {_LEX.format(c="CASE WHEN contains(rest, ':') THEN regexp_replace(rest, '^[^:]*:', '') ELSE rest END")} AS name0 FROM r),
p AS (SELECT *, CASE WHEN starts_with(raw, 'ref:') AND ns0 <> '' AND name0 <> '' THEN ns0 END AS ns, CASE WHEN starts_with(raw, 'ref:') AND ns0 <> '' AND name0 <> '' THEN name0 END AS name FROM q),
z AS (SELECT *, CASE WHEN lower(given) IN ('individual','class','group','event') THEN lower(given) WHEN ns IN ('individual','class','group','event') THEN ns WHEN ns IN ('species','category') THEN 'class' END AS nature FROM p)"""


@query(f"WITH {_REFS} SELECT entity_id, slot_name, ns AS namespace, name AS ref_value, nature FROM z")
def slot_ref_parse(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "slots")
    return slotrefs.symbolic(e).select("entity_id", "slot_name", "namespace", "ref_value", "nature")


@query(f"""WITH {_REFS}, b AS (SELECT id_value, id_namespace, min(entity_id) AS e FROM {_DID} WHERE id_type = 'ref' GROUP BY ALL)
 SELECT z.entity_id, slot_name, CASE WHEN z.name IS NULL THEN 'invalid_name' WHEN b.e IS NOT NULL AND nature IS NOT NULL AND n.entity_nature IS NOT NULL AND n.entity_nature <> nature THEN 'nature_conflict' WHEN b.e IS NOT NULL THEN 'resolved' WHEN nature IS NULL THEN 'missing_nature' ELSE 'created' END AS outcome,
 CASE WHEN z.name IS NULL THEN NULL WHEN b.e IS NOT NULL THEN CASE WHEN nature IS NULL OR n.entity_nature IS NULL OR n.entity_nature = nature THEN b.e END WHEN nature IS NOT NULL THEN substr(sha256('entity|ref|' || z.name || '|' || ns), 1, 32) END AS target_id
 FROM z LEFT JOIN b ON b.id_value = z.name AND b.id_namespace = z.ns LEFT JOIN {_ENT} n ON n.entity_id = b.e""")
def slot_ref_resolve(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "slots", "entity_nature")
    ids = current_rows(table(spark, folder, "entity_deterministic_ids"), "id", "entity_id", *identifiers.KEY)
    return slotrefs.resolve(slotrefs.symbolic(e), ids, e).select("entity_id", "slot_name", "outcome", "target_id")


# Events


def _placed(spark: SparkSession, folder: str, prefix: str, nature: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "slots", "created_at").where(F.col("entity_nature") == nature)
    s = F.col("slots")
    date = s["event_date"]["value_str"] if prefix == "e" else F.when(s["event_date"].isNull(), F.date_format("created_at", "yyyy-MM-dd"))
    return e.select(F.col("entity_id").alias("entity_id" if prefix == "e" else "observation_id"), date.alias(f"{prefix}_date"), s["latitude"]["value_num"].alias(f"{prefix}_lat"), s["longitude"]["value_num"].alias(f"{prefix}_lon"), s["location_name"]["value_str"].alias(f"{prefix}_place"), F.coalesce(s["species"]["items"], F.array().cast("array<string>")).alias(f"{prefix}_species"))


_ALIGN = f"""WITH o AS (SELECT entity_id AS observation_id, CASE WHEN slots['event_date'] IS NULL THEN strftime(created_at, '%Y-%m-%d') END AS d, slots['latitude'].value_num AS lat, slots['longitude'].value_num AS lon FROM {_ENT} WHERE entity_nature = 'individual'),
e AS (SELECT entity_id, slots['event_date'].value_str AS d, slots['latitude'].value_num AS lat, slots['longitude'].value_num AS lon FROM {_ENT} WHERE entity_nature = 'event'),
p AS (SELECT o.observation_id, e.entity_id, o.d AS od, e.d AS ed, 2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians(e.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(e.lat)) * pow(sin((radians(e.lon) - radians(o.lon)) / 2), 2)))) AS km FROM o, e WHERE o.d IS NULL OR o.d = e.d),
q AS (SELECT observation_id, entity_id, CASE WHEN od = ed THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN km < 20 THEN 0.3::DOUBLE * (1 - km / 20) ELSE 0 END AS s FROM p)
SELECT observation_id, entity_id, round(s, 6) AS posterior, CASE WHEN s >= 0.5 THEN 'soft' ELSE 'candidate' END AS status FROM q WHERE s >= 0.3"""


@query(_ALIGN)
def event_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = events.align(_placed(spark, folder, "o", "individual"), _placed(spark, folder, "e", "event"))
    return found.select("observation_id", "entity_id", _r("posterior"), "status")


@query(_SEEDS + f""", n AS (SELECT x.*, e.entity_nature, e.name FROM x JOIN {_ENT} e ON e.entity_id = x.entity_id)
 SELECT a.entity_id AS event_id, b.entity_id AS participant_id, a.observation_id, max(CASE WHEN contains(lower(b.name), 'subject') THEN 'subject' END) AS role, round(max(least(a.posterior, b.posterior)), 12) AS confidence
 FROM n a JOIN n b ON b.observation_id = a.observation_id AND a.entity_nature = 'event' AND a.role = 'context' AND b.entity_nature = 'individual' AND b.role = 'subject' GROUP BY a.entity_id, b.entity_id, a.observation_id""")
def event_participants(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "name")
    return events.participants(reconcile.reconcile(_seed_links(spark, folder)), e).withColumn("confidence", F.round("confidence", 12))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM g GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.event_sessions(table(spark, folder, "events"))


@query(f"""SELECT entity_id, round(exp(-abs(epoch(created_at) - epoch(TIMESTAMP '2024-06-01')) / 21600), 6) AS time_score, round(exp(-(2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(-2)) / 2), 2) + cos(radians(-2)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(35)) / 2), 2))))) / 10), 6) AS place_score
 FROM (SELECT entity_id, created_at, slots['latitude'].value_num AS lat, slots['longitude'].value_num AS lon FROM {_ENT})""")
def decay_scores(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "created_at", "slots")
    km = spacetime.haversine_km(F.lit(-2.0), F.lit(35.0), F.col("slots")["latitude"]["value_num"], F.col("slots")["longitude"]["value_num"])
    return e.select("entity_id", F.round(spacetime.time_decay("created_at", F.lit("2024-06-01").cast("timestamp")), 6).alias("time_score"), F.round(spacetime.location_decay(km), 6).alias("place_score"))


# Types


@query("""SELECT substr(sha256('candidate|' || n), 1, 32) AS candidate_id, n AS normalized_name, arg_min(p_type, p_partkey) AS proposed_name, count(*) AS evidence_count FROM (SELECT *, """ + _LEX.format(c="p_type") + """ AS n FROM part) WHERE n <> '' GROUP BY n""")
def type_candidates_of(spark: SparkSession, folder: str) -> DataFrame:
    return types.candidates_of(table(spark, folder, "part"), "p_type", "p_partkey").select("candidate_id", "normalized_name", "proposed_name", "evidence_count")


@query()
def type_candidate_names(spark: SparkSession, folder: str) -> DataFrame:
    return types.candidates_of(table(spark, folder, "type_candidates"), "proposed_name", "ingest_seq")


_CAND = _current_sql("type_candidates", "candidate_id")


@query(f"SELECT normalized_name, arg_min(candidate_id, (-evidence_count, candidate_id)) AS candidate_id, max(evidence_count) AS evidence_count FROM {_CAND} WHERE status IN ('proposed', 'promoted') AND normalized_name IS NOT NULL GROUP BY 1")
def candidate_by_name(spark: SparkSession, folder: str) -> DataFrame:
    c = current_rows(table(spark, folder, "type_candidates"), "candidate_id", "normalized_name", "status", "evidence_count")
    return types.best_candidates(c, c)


@query(f"""WITH c AS (SELECT candidate_id, evidence_count, left(normalized_name, 5) AS prefix FROM {_CAND} WHERE status = 'proposed' AND normalized_name <> '')
 SELECT a.candidate_id, b.candidate_id AS other_id FROM c a JOIN c b ON b.prefix = a.prefix AND b.candidate_id <> a.candidate_id QUALIFY row_number() OVER (PARTITION BY a.candidate_id ORDER BY b.evidence_count DESC, b.candidate_id) <= 10""")
def similar_candidates(spark: SparkSession, folder: str) -> DataFrame:
    c = current_rows(table(spark, folder, "type_candidates"), "candidate_id", "normalized_name", "status", "evidence_count")
    return types.similar_prefix(c).select("candidate_id", "other_id")


@query(f"""WITH n AS (SELECT DISTINCT proposed_name AS name FROM type_candidates WHERE proposed_name IS NOT NULL),
c AS (SELECT type_id, lower(trim(canonical_name)) AS k, 0 AS via FROM type_catalog WHERE status NOT IN ('deprecated', 'merged_into') UNION ALL SELECT type_id, lower(trim(a)), 1 FROM (SELECT type_id, status, unnest(aliases) AS a FROM type_catalog) WHERE status NOT IN ('deprecated', 'merged_into'))
SELECT name, arg_min(type_id, (via, type_id)) AS type_id, CASE min(via) WHEN 0 THEN 'name' ELSE 'alias' END AS via FROM n JOIN c ON c.k = lower(trim(n.name)) AND c.k <> '' GROUP BY name""")
def alias_lookup(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "type_candidates").select(F.col("proposed_name").alias("name")).where("name is not null")
    return types.find_by_name(table(spark, folder, "type_catalog"), wanted)


_TYPE = _current_sql("types", "type_id")
_PAIRS = f"""t AS {_TYPE}, ok AS (SELECT * FROM t WHERE coalesce(status, '') NOT IN ('deprecated', 'merged_into')),
g AS (SELECT s.type_id AS source, d.type_id AS target, s.evidence_count AS se FROM ok s JOIN ok d ON d.type_id = s.parent_type_id AND d.type_id <> s.type_id WHERE s.evidence_count = 1)"""


def _merge_pairs(t: DataFrame) -> DataFrame:
    return t.where("evidence_count = 1 and parent_type_id is not null").select(F.col("type_id").alias("source_type_id"), F.col("parent_type_id").alias("target_type_id"))


def _types(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "types"), "type_id", "canonical_name", "aliases", "parent_type_id", "status", "merged_into_type_id", "evidence_count", "created_via")


@query(f"""WITH {_PAIRS} SELECT t.type_id, CASE WHEN s.target IS NOT NULL THEN 'merged_into' ELSE t.status END AS status, coalesce(s.target, t.merged_into_type_id) AS merged_into_type_id, (t.evidence_count + coalesce(m.more, 0))::INTEGER AS evidence_count
 FROM t LEFT JOIN g s ON s.source = t.type_id LEFT JOIN (SELECT target, sum(se) AS more FROM g GROUP BY target) m ON m.target = t.type_id""")
def type_merge(spark: SparkSession, folder: str) -> DataFrame:
    t = _types(spark, folder)
    return types.merge(t, _merge_pairs(t)).select("type_id", "status", "merged_into_type_id", "evidence_count")


@query(f"""WITH {_PAIRS} SELECT coalesce(g.target, o.stable_type_id) AS stable_type_id, count(*) AS n FROM observations o LEFT JOIN g ON g.source = o.stable_type_id GROUP BY 1""")
def merge_migration(spark: SparkSession, folder: str) -> DataFrame:
    t = _types(spark, folder)
    merged = types.merge(t, _merge_pairs(t)).where("status = 'merged_into'").select(F.col("type_id").alias("old"), F.col("merged_into_type_id").alias("new"))
    already = t.where("status = 'merged_into'").select(F.col("type_id").alias("old"))
    moves = merged.join(already, "old", "left_anti")
    return types.repointed(table(spark, folder, "observations"), "stable_type_id", moves).groupBy("stable_type_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS {_TYPE}, x AS (SELECT type_id, canonical_name || s AS name, parent_type_id, created_via FROM t, (VALUES ('_a'), ('_b')) v(s) WHERE canonical_name IS NOT NULL),
 bad AS (SELECT type_id FROM (SELECT type_id, name, count(*) OVER (PARTITION BY name) AS n FROM x) WHERE n > 1 OR name IN (SELECT canonical_name FROM t WHERE canonical_name IS NOT NULL))
 SELECT substr(sha256('type|' || name), 1, 32) AS type_id, name AS canonical_name, parent_type_id, 'provisional' AS status, created_via FROM x WHERE type_id NOT IN (SELECT type_id FROM bad) AND type_id IN (SELECT type_id FROM t WHERE coalesce(status, '') NOT IN ('deprecated', 'merged_into'))""")
def type_split(spark: SparkSession, folder: str) -> DataFrame:
    t = _types(spark, folder)
    specs = t.where("canonical_name is not null").select(F.col("type_id").alias("source_type_id"), F.explode(F.array(F.concat("canonical_name", F.lit("_a")), F.concat("canonical_name", F.lit("_b")))).alias("name"))
    return types.split(t, specs, False).select("type_id", "canonical_name", "parent_type_id", "status", "created_via")


# Reading


@query("""SELECT 'medium' AS of, medium AS value, count(*) AS n, grouping(medium)::INTEGER AS is_total FROM observations GROUP BY ROLLUP (medium)
 UNION ALL SELECT 'entity status', status, count(*), grouping(status)::INTEGER FROM entities GROUP BY ROLLUP (status) UNION ALL SELECT 'type status', status, count(*), grouping(status)::INTEGER FROM types GROUP BY ROLLUP (status)
 UNION ALL SELECT 'candidate status', status, count(*), grouping(status)::INTEGER FROM type_candidates GROUP BY ROLLUP (status)""")
def world_stats(spark: SparkSession, folder: str) -> DataFrame:
    parts = [world.counts(table(spark, folder, t), c).select(F.lit(of).alias("of"), F.col(c).alias("value"), "n", F.col("is_total").cast("int").alias("is_total")) for of, t, c in (("medium", "observations", "medium"), ("entity status", "entities", "status"), ("type status", "types", "status"), ("candidate status", "type_candidates", "status"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(_SEEDS + f""" SELECT x.entity_id, count(DISTINCT observation_id) AS observations, any_value(e.name) AS name FROM x JOIN {_ENT} e ON e.entity_id = x.entity_id WHERE NOT regexp_matches(lower(coalesce(e.name, '')), 'serial|unique_id') GROUP BY x.entity_id HAVING count(DISTINCT observation_id) >= 2""")
def multi_linked(spark: SparkSession, folder: str) -> DataFrame:
    e = current_rows(table(spark, folder, "entities"), "entity_id", "name")
    return world.shared_entities(reconcile.reconcile(_seed_links(spark, folder)), e).select("entity_id", "observations", "name")


@query(f"""SELECT entity_id, coalesce(entity_nature, 'unknown') AS nature, CASE entity_nature WHEN 'event' THEN 1 WHEN 'individual' THEN 2 WHEN 'class' THEN 3 WHEN 'group' THEN 4 ELSE 5 END AS nature_rank, name FROM {_ENT}""")
def world_by_nature(spark: SparkSession, folder: str) -> DataFrame:
    return world.by_nature(current_rows(table(spark, folder, "entities"), "entity_id", "entity_nature", "name"))


@query("SELECT observation_id, source_id, split_part(source_id, '/', -1) AS basename FROM observations WHERE source_id ILIKE '%.CR3%' ORDER BY source_id, observation_id LIMIT 10")
def search_observations(spark: SparkSession, folder: str) -> DataFrame:
    return world.search_sources(table(spark, folder, "observations"), ".CR3").select("observation_id", "source_id", names.source_basename("source_id").alias("basename"))


@query("""WITH s AS (SELECT DISTINCT left(entity_id, 6) AS start FROM similarity_results WHERE entity_id IS NOT NULL UNION SELECT DISTINCT left(entity_id, 3) FROM similarity_results WHERE entity_id IS NOT NULL), k AS (SELECT DISTINCT entity_id FROM entities WHERE entity_id IS NOT NULL)
 SELECT start, min(k.entity_id) AS entity_id, CASE count(k.entity_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome FROM s LEFT JOIN k ON starts_with(k.entity_id, s.start) GROUP BY start""")
def id_start_lookup(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "similarity_results").where("entity_id is not null")
    starts = r.select(F.substring("entity_id", 1, 6).alias("start")).union(r.select(F.substring("entity_id", 1, 3))).distinct()
    return world.by_id_start(table(spark, folder, "entities").where("entity_id is not null"), "entity_id", starts)


@query(f"SELECT candidate_id, normalized_name, evidence_count FROM {_CAND} WHERE status = 'proposed' ORDER BY evidence_count DESC, candidate_id LIMIT 20")
def review_candidates(spark: SparkSession, folder: str) -> DataFrame:
    c = current_rows(table(spark, folder, "type_candidates"), "candidate_id", "normalized_name", "status", "evidence_count")
    return world.review(c, "proposed").select("candidate_id", "normalized_name", "evidence_count")


@query("""WITH e AS (SELECT event_id, user_id, event_type, 'event/' || event_id AS source_id, '{"event_id":' || event_id || CASE WHEN user_id IS NULL THEN '' ELSE ',"ref":' || user_id END || CASE WHEN event_type IS NULL THEN '' ELSE ',"code":"' || event_type || '"' END || '}' AS content FROM events),
o AS (SELECT *, substr(sha256('blob|' || sha256(content)), 1, 32) AS blob_id FROM e),
i AS (SELECT *, 'ref' AS id_type, user_id::VARCHAR AS id_value FROM o WHERE user_id IS NOT NULL UNION ALL SELECT *, 'code', trim(event_type) FROM o WHERE trim(event_type) <> '')
SELECT substr(sha256('observation|' || blob_id || '|' || source_id), 1, 32) AS observation_id, substr(sha256('entity|' || id_type || '|' || id_value || '|source:stream'), 1, 32) AS entity_id, 'hard' AS status, id_type, id_value FROM i""")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming pipeline over all event rows as JSON contents; its links."""
    scratch = Scratch(spark, "ingest")
    props = table(spark, folder, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("source_id"), F.to_json(F.struct(F.col("event_id"), F.col("user_id").alias("ref"), F.col("event_type").alias("code"))).alias("content"), F.col("event_id").alias("ingest_seq"))
    stored = scratch.save(props, "incoming")
    pipeline.run(spark.readStream.schema(stored.schema).parquet(scratch.path("incoming")), scratch.path("state"), scratch.path("checkpoint"))
    return pipeline.state(spark, scratch.path("state"), "links").select("observation_id", "entity_id", "status", "id_type", "id_value")
