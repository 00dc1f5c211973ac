"""``python -m kinweave.cli WORLD COMMAND ...``: the read surface and ingestion over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.documents import decoded
from kinweave.operators import ingest, types, world
from kinweave.session import local_session
from kinweave.sources.tables import table
from kinweave.streaming import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    p.add_argument("world", help="folder of the tables")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("init-world", "reset-world", "stats", "show-world"):
        c.add_parser(name)
    for kind in ("observation", "entity", "event", "type"):
        c.add_parser(f"show-{kind}").add_argument("id")
    one = c.add_parser("ingest")
    one.add_argument("path")
    one.add_argument("-r", "--recursive", action="store_true")
    c.add_parser("search").add_argument("text")
    c.add_parser("type-history").add_argument("id")
    for name in ("review-candidates", "review-types"):
        c.add_parser(name).add_argument("--status")
    c.add_parser("show-links").add_argument("--multi", action="store_true")
    one = c.add_parser("type-alias")
    one.add_argument("name")
    one.add_argument("alias")
    one.add_argument("-r", "--remove", action="store_true")
    one = c.add_parser("type-merge")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--dry-run", action="store_true")
    one = c.add_parser("type-split")
    one.add_argument("source")
    one.add_argument("names", nargs="+")
    one.add_argument("-k", "--keep-parent", action="store_true")
    one = c.add_parser("type-deprecate")
    one.add_argument("name")
    one.add_argument("--replacement")
    return p


def _changed_types(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Runs a command that changes types: what changed is shown, and stored with a row of history unless nothing does or it's a dry run."""
    t, types_of = (lambda name: table(spark, args.world, name)), table(spark, args.world, "types")
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    named = {r["canonical_name"]: r["type_id"] for r in types_of.where(F.col("canonical_name").isin([x for x in (getattr(args, k, None) for k in ("name", "source", "target", "replacement")) if x])).select("canonical_name", "type_id").collect()}
    own, other = named.get(getattr(args, "source", None) or args.name), getattr(args, "target", None) or getattr(args, "replacement", None)
    if own is None or (other and other not in named):
        return {"not_found": rows("name string", (other if own else getattr(args, "source", None) or args.name,))}
    goal, moves = named.get(other), None
    match args.command:
        case "type-alias" if args.remove:
            after = types.alias_removed(types_of, rows("type_id string, alias string", (own, args.alias)))
        case "type-alias":
            change = rows("type_id string, alias string", (own, args.alias))
            good = types.alias_added(types_of, change).where("outcome = 'added'").select("type_id", F.col("alias").alias("_a"))
            after = types_of.join(good, "type_id", "left").withColumn("aliases", F.when(F.col("_a").isNotNull(), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("_a"))).otherwise(F.col("aliases"))).drop("_a")
        case "type-merge":
            after, moves = types.merge(types_of, rows("source_type_id string, target_type_id string", (own, goal))), goal
        case "type-split":
            after = types.after_split(types_of, rows("source_type_id string, name string", *((own, n) for n in args.names)), args.keep_parent)
        case _:
            after, moves = types.deprecated(types_of, rows("type_id string, replacement_type_id string", (own, goal))).drop("moves_to"), goal
    after = after.select(types_of.columns)
    changed = after.exceptAll(types_of).persist()
    if changed.isEmpty() or getattr(args, "dry_run", False):
        return {"types": changed}
    if moves:
        for name, column in (("observations", "stable_type_id"), ("entities", "type_id")):
            world.replace(spark, args.world, name, types.repointed(t(name), column, rows("old string, new string", (own, moves))).select(t(name).columns))
    kind = args.command.removeprefix("type-")
    said = rows("x int", (1,)).select(types.evolution(kind, own, goal, f"{kind} by command", " ".join(map(str, (getattr(args, "alias", ""), *getattr(args, "names", ())))).strip()).alias("e")).select("e.*")
    shown = spark.createDataFrame(changed.collect(), changed.schema)  # the one or two types that a command changes, and those it makes
    world.replace(spark, args.world, "type_evolution", t("type_evolution").unionByName(said))
    world.replace(spark, args.world, "types", after)
    return {"types": shown}


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables that a command shows."""
    t = lambda name: table(spark, args.world, name)
    match args.command:
        case "init-world" | "reset-world":
            names = world.init_world(spark, args.world, args.command == "reset-world")
            return {"written": spark.createDataFrame([(n,) for n in names], "table string")}
        case "ingest":
            files = ingest.scan_files(spark, args.path, args.recursive).select("source_id", decoded("content").alias("content"), F.xxhash64("source_id").alias("ingest_seq"))
            state = f"{args.world}/state"
            known = {name: pipeline.state(spark, state, name) for name in pipeline.TABLES}
            number = 1 + (spark.read.parquet(f"{state}/observations").agg(F.max("batch")).first()[0] if known["observations"].count() else -1)
            new = pipeline.ingest_batch(files, known, "source:ingest")
            for name, rows in new.items():
                rows.write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")
            return {name: spark.read.parquet(f"{state}/{name}/batch={number}") for name in new}
        case "stats":
            of = (("observations", "medium"), ("entities", "status"), ("types", "status"), ("type_candidates", "status"))
            return {name: world.counts(t(name), column).orderBy(F.col("n").desc()) for name, column in of}
        case "show-world":
            return {"entities": world.by_nature(t("entities")).orderBy("nature_rank", F.coalesce("name", F.lit("")), "entity_id")}
        case "show-links":
            links = t("observation_entity_links")
            shown = world.shared_entities(links, t("entities")) if args.multi else world.links_per_entity(links)
            return {"links": shown.orderBy(F.col("observations").desc(), "entity_id").limit(20)}
        case "search":
            return {"observations": world.search_sources(t("observations"), args.text)}
        case "type-history":
            return {"type_evolution": world.history(t("type_evolution"), args.id)}
        case "type-alias" | "type-merge" | "type-split" | "type-deprecate":
            return _changed_types(spark, args)
        case "review-candidates":
            return {"type_candidates": world.review(t("type_candidates"), args.status)}
        case "review-types":
            return {"types": world.review(t("types").withColumnRenamed("type_id", "candidate_id"), args.status).withColumnRenamed("candidate_id", "type_id")}
    kind = args.command.removeprefix("show-")
    home, key = {"observation": ("observations", "observation_id"), "entity": ("entities", "entity_id"), "event": ("entities", "entity_id"), "type": ("types", "type_id")}[kind]
    found = world.by_id_start(t(home), key, spark.createDataFrame([(args.id,)], "start string")).first()
    if found is None or found["outcome"] != "found":
        return {found["outcome"] if found else "not_found": spark.createDataFrame([(args.id,)], "id string")}
    return world.show(kind, found[key], {name: t(name) for name in world.SCHEMAS})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session("*", "kinweave")
    for name, df in run(spark, args).items():
        print(name)
        df.show(50, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
