"""Models, providers, service instances and tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import listed, skill_document

REQUEST_BLOCK = 100_000  #: ids of a block of requests


def route(mappings: DataFrame, providers: DataFrame) -> DataFrame:
    """Per model its preferred mapping, else any (the least id), and whether its provider can serve; there is no second choice."""
    first = Window.partitionBy("model_id").orderBy(F.desc("is_preferred"), "provider_id")
    chosen = mappings.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")
    status = F.when(F.col("is_active").isNull(), "missing_provider").when(~F.col("is_active"), "inactive_provider").otherwise("ok")
    return chosen.join(providers.select("provider_id", "is_active"), "provider_id", "left").withColumn("status", status).drop("is_active")


def model_catalogue(models: DataFrame, default_id: int) -> DataFrame:
    """Active models by kind, with the default marked."""
    kind = F.when(F.col("type") == 1, "standard").when(F.col("type") == 2, "advanced").otherwise("other")
    return models.filter("is_active").select("model_id", kind.alias("kind"), (F.col("model_id") == default_id).alias("is_default"))


def model_rows(models: DataFrame, default_id: int) -> DataFrame:
    """Active models as an interface shows them."""
    kinds = model_catalogue(models, default_id)
    named = models.select("model_id", F.col("model_name").alias("name"), "type", F.col("billing_ratio").alias("ratio"))
    return kinds.join(named, "model_id").select(F.col("model_id").alias("id"), "name", "type", "ratio", "kind", "is_default")


def overlaid_tools(registered: DataFrame, runtime: DataFrame) -> DataFrame:
    """Registered tools and those found at run time; of a name the later one, a run-time tool always, with the place of the first.

    Both: (seq, name, ...) of the same columns.  The place is two columns, in
    whose order tools go: place_late (1 where the name is of run-time tools
    only) and place_seq.
    """
    both = registered.withColumn("__late", F.lit(0)).unionByName(runtime.withColumn("__late", F.lit(1)))
    own = Window.partitionBy("name")
    ranked = both.withColumn("__rank", F.row_number().over(own.orderBy(F.desc("__late"), F.desc("seq")))).withColumn("__place", F.min(F.struct("__late", "seq")).over(own))
    return ranked.filter("__rank = 1").withColumn("place_late", F.col("__place.__late")).withColumn("place_seq", F.col("__place.seq")).drop("__rank", "__late", "__place")


def visible_tools(tools: DataFrame) -> DataFrame:
    """tools (name, reserved, exposed, allow, deny): reserved tools are seen where exposed; others where no list is given, the allow list has them, or the deny list doesn't."""
    name, allow, deny = F.col("name"), F.col("allow"), F.col("deny")
    other = (allow.isNull() & deny.isNull()) | F.coalesce(F.array_contains(allow, name), F.lit(False)) | F.coalesce(~F.array_contains(deny, name), F.lit(False))
    return tools.withColumn("visible", F.when(F.col("reserved"), F.coalesce(F.array_contains("exposed", name), F.lit(False))).otherwise(other))


def usable_instances(instances: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Healthy and enabled instances (null counts as true) that have not been tried."""
    rows = instances.filter(F.coalesce("healthy", F.lit(True)) & F.coalesce("enabled", F.lit(True)))
    return rows if tried is None else rows.join(tried, "address", "left_anti")


def weighted_shares(instances: DataFrame) -> DataFrame:
    """low and high bounds of each instance in [0, 1): by weight, evenly where no weight is positive."""
    own = Window.partitionBy("service")
    weight = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0))
    rows = instances.withColumn("w", weight).withColumn("total", F.sum("w").over(own)).withColumn("w", F.when(F.col("total") > 0, F.col("w")).otherwise(F.lit(1.0)))
    running = F.sum("w").over(own.orderBy("address").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("total", F.sum("w").over(own)).withColumn("high", running / F.col("total")).withColumn("low", (running - F.col("w")) / F.col("total"))


def pick_weighted(instances: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, service, draw in [0, 1)): the instance whose share holds the draw.

    A service's shares are one row with an array, so a request is one row
    throughout; it is halved until one share is left, so that a request's work
    is the logarithm of the number of instances.
    """
    share = F.struct("high", "address")  # a share begins where the one before it ends
    shares = weighted_shares(instances).filter("high > low").groupBy("service").agg(F.array_sort(F.collect_list(share)).alias("shares"))
    n = F.size("shares")
    steps = F.sequence(F.lit(1), F.length(F.bin(n)))
    span = F.struct(F.lit(0).alias("low"), (n - 1).alias("high"))  # places that the first share with high > draw can have

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        left = F.get("shares", middle)["high"] > F.col("draw")
        return F.struct(F.when(left, s["low"]).otherwise(F.least(middle + 1, s["high"])).alias("low"), F.when(left, middle).otherwise(s["high"]).alias("high"))

    held = requests.join(shares, "service").filter((F.col("draw") >= 0) & (F.col("draw") < F.get("shares", n - 1)["high"]))
    return held.select("request_id", "service", F.get("shares", F.reduce(steps, span, halved)["low"])["address"].alias("address"))


def pick_in_turn(instances: DataFrame, requests: DataFrame) -> DataFrame:
    """Round robin: the n-th request of a service goes to instance n modulo their number, in order of address.

    Requests are numbered in blocks of ids, whose counts are then summed, so a
    busy service is spread over many tasks.  request_id is a number, of which
    a service has each once.
    """
    own = Window.partitionBy("service")
    services = instances.groupBy("service").agg(F.array_sort(F.collect_list("address")).alias("addresses"))
    blocked = requests.withColumn("__block", F.col("request_id") - F.pmod("request_id", F.lit(REQUEST_BLOCK)))
    before = F.coalesce(F.sum("n").over(own.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = blocked.groupBy("service", "__block").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    turn = F.col("before") + F.row_number().over(Window.partitionBy("service", "__block").orderBy("request_id")) - 1
    turns = blocked.join(firsts, ["service", "__block"]).withColumn("turn", turn).join(services, "service")
    return turns.select("request_id", "service", F.get("addresses", (F.col("turn") % F.size("addresses")).cast("int")).alias("address"))


def manifest_lookup(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """requests (request_id, skill_id, path) against manifests (skill_id, path, object_key): outcome ok, unknown_path or no_key, and a text that says so."""
    found = requests.join(manifests.withColumn("__known", F.lit(True)), ["skill_id", "path"], "left")
    paths = manifests.groupBy("skill_id").agg(F.collect_set("path").alias("paths"))  # goes to unknown paths only
    outcome = F.when(F.col("__known").isNull(), "unknown_path").when(F.coalesce("object_key", F.lit("")) == "", "no_key").otherwise("ok")
    said = F.when(outcome == "unknown_path", F.concat(F.lit("no such path; there are: "), listed(F.coalesce("paths", F.array().cast("array<string>"))))).when(outcome == "no_key", "the path has no object")
    asking = found.withColumn("__skill", F.when(F.col("__known").isNull(), F.col("skill_id"))).join(paths.withColumnRenamed("skill_id", "__skill"), "__skill", "left")
    return asking.select("request_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("object_key")).alias("object_key"), said.alias("message"))


def skill_by_id(skills: DataFrame, skill_id: str) -> DataFrame:
    return skills.filter(F.col("skill_id") == skill_id).limit(1)


def loaded_skills(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """requests (request_id, skill_id, allowed): the document of an allowed skill, or a text that says why there is none.

    skills: one row an id, with the columns of `skill_document`.
    """
    documents = skills.select("skill_id", skill_document().alias("__document"))
    wanted = F.trim(F.coalesce("skill_id", F.lit("")))
    rows = requests.withColumn("skill_id", wanted).join(documents, "skill_id", "left")
    allowed = F.coalesce("allowed", F.array().cast("array<string>"))
    text = (
        F.when(F.col("skill_id") == "", "a skill id is needed")
        .when(~F.array_contains(allowed, F.col("skill_id")), F.concat(F.lit("not allowed now; allowed: "), listed(allowed)))
        .when(F.col("__document").isNull(), "no such skill").otherwise(F.col("__document"))
    )
    return rows.select("request_id", "skill_id", text.alias("text"))
