"""int8 vector index: spaces, steps, codes, readiness and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalore.functions.vectors import absmax, quantize, scale_from_absmax
from catalore.sources.catalog import Catalog

#: Vectors from which a space gets an index.
ARTIFACT_MIN_VECTORS = 1024


def vector_rows(catalog: Catalog) -> DataFrame:
    """(id, setter_id, setter, data_type, dim, embedding) of stored vectors."""
    made = catalog["item_data"].where("data_type in ('clip', 'text-embedding')").select("id", "setter_id", "data_type")
    setters = catalog["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    return catalog["embeddings"].where("embedding is not null").join(made, "id").join(F.broadcast(setters), "setter_id").withColumn("dim", F.size("embedding"))


def spaces(catalog: Catalog) -> DataFrame:
    """(setter, space, data_type, dim, vectors): which setters share an embedding space.

    A text setter ``t`` + model shares the image model's space if both have the
    same dimension and complementary types. A setter's dimension is its most
    frequent one.
    """
    counts = vector_rows(catalog).groupBy("setter", "data_type", "dim").agg(F.count(F.lit(1)).alias("vectors"))
    usual = counts.groupBy("setter", "data_type").agg(F.max_by("dim", F.struct("vectors", "dim")).alias("dim"), F.sum("vectors").alias("vectors"))
    images = usual.where("data_type = 'clip'").select(F.concat(F.lit("t"), "setter").alias("setter"), F.col("setter").alias("image"), F.col("dim").alias("image_dim"))
    paired = (F.col("data_type") == "text-embedding") & (F.col("dim") == F.col("image_dim"))
    return usual.join(F.broadcast(images), "setter", "left").select("setter", F.when(paired, F.col("image")).otherwise(F.col("setter")).alias("space"), "data_type", F.col("dim").cast("long").alias("dim"), "vectors")


def scales(catalog: Catalog) -> DataFrame:
    """(space, absmax, vectors): one row per embedding space, over its vectors of the space's dimension."""
    named = vector_rows(catalog).join(F.broadcast(spaces(catalog).select("setter", "space", F.col("dim").alias("usual"))), "setter").where("dim = usual")
    return named.groupBy("space").agg(F.max(absmax(F.col("embedding"))).alias("absmax"), F.count(F.lit(1)).alias("vectors"))


def encode(catalog: Catalog, profile_id: int = 1, rev: int = 1, known: DataFrame | None = None, least: int = ARTIFACT_MIN_VECTORS) -> tuple[DataFrame, dict[str, float]]:
    """(codes (id, profile_id, rev, quant, setter), step of each space).

    Only spaces of at least ``least`` vectors are coded; vectors that ``known``
    has at this revision are left out. The steps are one number a space.
    """
    steps = {r["space"]: scale_from_absmax(r["absmax"]) for r in scales(catalog).collect() if r["vectors"] >= least}
    # one pass with the step beside the vector; a union of one scan a space can't be joined by id under adaptive execution (Spark 4.1 zips unequal partitions)
    stepped = F.broadcast(catalog.spark.createDataFrame(list(steps.items()), "space string, step double"))
    usual = spaces(catalog).select("setter", "space", F.col("dim").alias("usual")).join(stepped, "space")
    named = vector_rows(catalog).join(F.broadcast(usual), "setter").where("dim = usual")
    if known is not None:
        named = named.join(known.where((F.col("profile_id") == profile_id) & (F.col("rev") == rev)).select("id"), "id", "left_anti")
    codes = named.select("id", F.lit(profile_id).cast("long").alias("profile_id"), F.lit(rev).cast("long").alias("rev"), quantize(F.col("embedding"), F.col("step")).alias("quant"), "setter")
    return codes, steps


def inline(new: DataFrame, catalog: Catalog, profile_id: int, rev: int = 1) -> DataFrame:
    """Codes (id, profile_id, rev, quant) of new vectors (id, setter_id, embedding) whose setter's step is settled.

    Vectors of another dimension than the setter's get no code.
    """
    cover = catalog["vector_quant_coverage"].where((F.col("profile_id") == profile_id) & F.col("artifact").isNotNull())
    steps = {r["setter_id"]: (r["artifact"], r["dim"]) for r in cover.select("setter_id", "artifact", "dim").collect()}  # one row a setter
    parts = [new.where((F.col("setter_id") == s) & (F.size("embedding") == dim)).select("id", quantize(F.col("embedding"), step).alias("quant")) for s, (step, dim) in sorted(steps.items())]
    if not parts:
        parts = [new.limit(0).select("id", F.lit(None).cast("array<tinyint>").alias("quant"))]
    return reduce(DataFrame.unionByName, parts).select("id", F.lit(profile_id).cast("long").alias("profile_id"), F.lit(rev).cast("long").alias("rev"), "quant")


def finished(catalog: Catalog, profile_id: int, rev: int, least: int = ARTIFACT_MIN_VECTORS) -> DataFrame:
    """(setter, vectors, remaining, state): ready once enough vectors exist and none lacks its code."""
    usual = spaces(catalog).select("setter", F.col("dim").alias("usual"))
    vectors = vector_rows(catalog).join(F.broadcast(usual), "setter").where("dim = usual").select("id", "setter")
    coded = catalog["embedding_quants"].where((F.col("profile_id") == profile_id) & (F.col("rev") == rev)).select("id", F.lit(1).alias("_coded"))
    each = vectors.join(coded, "id", "left").groupBy("setter").agg(F.count(F.lit(1)).alias("vectors"), (F.count(F.lit(1)) - F.count("_coded")).alias("remaining"))
    state = F.when(F.col("vectors") < least, "pending").when(F.col("remaining") > 0, "building").otherwise("ready")
    return each.withColumn("state", state)


def coverage(catalog: Catalog) -> DataFrame:
    """(setter, vectors, coded): stored vectors of each setter and those that have a code."""
    made = catalog["item_data"].where("data_type in ('clip', 'text-embedding') and not coalesce(is_placeholder, false)").select("id", "setter_id")
    coded = catalog["embedding_quants"].select("id").distinct().withColumn("_coded", F.lit(1))
    setters = catalog["setters"].select(F.col("id").alias("setter_id"), F.col("name").alias("setter"))
    return made.join(coded, "id", "left").join(F.broadcast(setters), "setter_id").groupBy("setter").agg(F.count(F.lit(1)).alias("vectors"), F.count("_coded").alias("coded"))


def ready(catalog: Catalog, models: list[str], variant: str | None = None):
    """(profile id, step) if every existing setter of ``models`` is covered alike by an active profile, else None."""
    profiles = catalog["vector_quant_profiles"].where("state = 'active'")
    profiles = profiles.where(F.col("name") == variant) if variant else profiles.where("is_default")
    setters = catalog["setters"].where(F.col("name").isin(*models)).select(F.col("id").alias("setter_id"))
    cover = catalog["vector_quant_coverage"]
    state = profiles.select(F.col("id").alias("profile_id")).crossJoin(F.broadcast(setters)).join(cover, ["profile_id", "setter_id"], "left")
    found = state.select("profile_id", "state", "artifact", "dim").collect()  # profiles x the models asked for
    if not found or any(r["state"] != "ready" for r in found) or len({(r["profile_id"], r["artifact"], r["dim"]) for r in found}) != 1:
        return None
    return found[0]["profile_id"], found[0]["artifact"]


def reconcile(desired: dict[str, dict], actual: dict[str, dict]) -> dict[str, list]:
    """What turns ``actual`` profiles into ``desired``: create, update, remove names and spaces to build.

    Pure and repeatable: applying part of it and asking again gives the rest.
    """
    plan: dict[str, list] = {"create": [], "update": [], "remove": sorted(set(actual) - set(desired)), "build": []}
    for name, want in sorted(desired.items()):
        have = actual.get(name)
        if have is None:
            plan["create"].append(name)
        elif any(have.get(k) != want.get(k) for k in ("quantizer", "options", "is_default")):
            plan["update"].append(name)
        recoded = have is None or have.get("quantizer") != want.get("quantizer") or have.get("options") != want.get("options")
        done = set() if recoded else set(have.get("ready", ()))
        plan["build"] += [(name, space) for space in sorted(want.get("spaces", ())) if space not in done]
    return plan
