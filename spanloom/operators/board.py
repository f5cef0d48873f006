"""Scores of contexts: how much shorter than whole files, how many items repeat, whether two runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "encoding string, scenarios array<struct<name: string, fixture_path: string, queries: array<string>, tier: string, budget: bigint, probe_first: boolean>>"


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(encoding, name, fixture_path, queries, tier, budget, probe_first): a row for each scenario of plan files."""
    plan = spark.read.schema(PLAN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return plan.select("encoding", F.inline("scenarios"))


def path_of(item_id: Column) -> Column:
    """What comes before the last colon; null without one."""
    return F.when(item_id.contains(":"), F.regexp_extract(item_id, r"(?s)^(.*):[^:]*$", 1))


def first_paths(items: DataFrame, key: str = "name") -> DataFrame:
    """(key, path, pos): the paths of items (key, pos, id), each where it comes first."""
    return items.select(key, "pos", path_of(F.col("id")).alias("path")).where("path is not null").groupBy(key, "path").agg(F.min("pos").alias("pos"))


def scores(items: DataFrame, baseline: DataFrame, key: str = "name") -> DataFrame:
    """(key, items_count, actual_tokens, baseline_tokens, cef, dcr) of items (key, pos, id, tokens), with the tokens of whole files (path, tokens).

    cef: baseline for each actual token, 0 without any; dcr: the share of items whose id came before.
    """
    own = items.groupBy(key).agg(F.count("*").alias("items_count"), F.sum("tokens").alias("actual_tokens"), F.countDistinct("id").alias("ids"))
    whole = first_paths(items, key).join(baseline.select("path", F.col("tokens").alias("whole")), "path").groupBy(key).agg(F.sum("whole").alias("baseline_tokens"))
    out = own.join(whole, key, "left").withColumn("baseline_tokens", F.coalesce("baseline_tokens", F.lit(0)))
    cef = F.when(F.col("actual_tokens") == 0, 0.0).otherwise(F.col("baseline_tokens") / F.col("actual_tokens"))
    return out.select(key, "items_count", "actual_tokens", "baseline_tokens", cef.alias("cef"), (1.0 - F.col("ids") / F.col("items_count")).alias("dcr"))


def agreement(first: DataFrame, second: DataFrame, key: str = "name") -> DataFrame:
    """(key, deterministic): whether two runs' items (key, pos, id, tokens, content) are the same, row by row."""
    cols = ["pos", "id", "tokens", "content"]
    rows = first.select(key, *cols, F.lit(1).alias("run")).unionByName(second.select(key, *cols, F.lit(2).alias("run")))
    places = rows.groupBy(key, "pos").agg(F.count_distinct("run").alias("runs"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols[1:]])).alias("kinds"))
    return places.groupBy(key).agg(F.bool_and((F.col("runs") == 2) & (F.col("kinds") == 1)).alias("deterministic"))


def board(plan: DataFrame, first: DataFrame, second: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row for each scenario of read_plan(), from two runs of it and the tokens of its whole files."""
    out = plan.select("encoding", "name", "tier", "budget", F.when(F.coalesce("probe_first", F.lit(False)), 1.0).otherwise(0.0).alias("pfr"))
    out = out.join(scores(first, baseline), "name", "left").join(agreement(first, second), "name", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("items_count", "actual_tokens", "baseline_tokens")} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("cef", "dcr")}
    return out.withColumns(zero).withColumn("deterministic_json_equal", F.coalesce("deterministic", F.lit(True))).withColumn("within_budget", F.col("actual_tokens") <= F.col("budget")).drop("deterministic")


def write_board(rows: DataFrame, path: str) -> None:
    rows.orderBy("name").write.mode("overwrite").json(path)
