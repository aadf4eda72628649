"""Keyed writes as transformations that yield the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.operators.ordered import latest

# Layer limits.
MAX_LAYER_ID, MAX_NAME, MAX_SHAPE = 100, 200, 50
MAX_GEOJSON = 5 * 1024 * 1024
MAX_BULK_LAYERS = 200


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], now: Column, kept: tuple = ("created_at",)) -> DataFrame:
    """Incoming rows replace current ones by key; `kept` columns survive, a later duplicate wins."""
    newest = latest(incoming, keys, order)
    values = [c for c in current.columns if c not in (*keys, *kept, "updated_at")]
    both = current.join(newest.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new")), keys, "full")
    is_new = F.coalesce("_new", F.lit(False))
    return both.select(
        *keys,
        *[F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        *[F.coalesce(F.col(c), now).alias(c) for c in kept],
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*current.columns)


def layer_error() -> Column:
    """First failing layer rule, or null."""
    geo = F.get_json_object("geojson", "$")

    def text_rule(name: str, limit: int) -> list[Column]:
        return [
            F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"'{name}' is required.")),
            F.when(F.length(name) > limit, F.lit(f"'{name}' exceeds {limit} characters.")),
        ]

    return F.coalesce(
        *text_rule("layer_id", MAX_LAYER_ID),
        *text_rule("name", MAX_NAME),
        *text_rule("shape", MAX_SHAPE),
        F.when(geo.isNull() | ~F.startswith(geo, F.lit("{")) | (geo == "{}"), F.lit("'geojson' must be a non-empty object.")),
        F.when(F.length("geojson") > MAX_GEOJSON, F.lit(f"'geojson' exceeds {MAX_GEOJSON // (1024 * 1024)} MB limit.")),
    )


def validate_layers(layers: DataFrame) -> DataFrame:
    return layers.withColumn("error", layer_error())


def bulk_request_errors(layers: DataFrame) -> DataFrame:
    """One row per rejected bulk request (chat): too many layers, or its first invalid layer."""
    per = validate_layers(layers).groupBy("chat_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("ix", "error"))).alias("bad")
    )
    too_many = F.when(F.col("n") > MAX_BULK_LAYERS, F.lit(f"Too many layers (max {MAX_BULK_LAYERS})."))
    first = F.concat(F.lit("Layer "), F.col("bad.ix").cast("string"), F.lit(": "), F.col("bad.error"))
    return per.select("chat_id", F.coalesce(too_many, first).alias("error")).filter("error IS NOT NULL")


def patch_layers(current: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Applies only provided fields (`has_<field>` flags); returns (next version, rejected patches)."""
    keys = ["chat_id", "layer_id"]
    name = F.left(F.trim(F.coalesce("name", F.lit(""))), F.lit(MAX_NAME))
    shape = F.left(F.coalesce("shape", F.lit("")), F.lit(MAX_SHAPE))
    checked = patches.withColumn("name", name).withColumn("shape", shape).withColumn(
        "error",
        F.coalesce(
            F.when(F.col("has_name") & (F.col("name") == ""), F.lit("'name' cannot be empty.")),
            F.when(F.col("has_shape") & (F.col("shape") == ""), F.lit("'shape' cannot be empty.")),
            F.when(~F.col("has_visible") & ~F.col("has_name") & ~F.col("has_shape"), F.lit("No fields to update.")),
        ),
    )
    good = checked.filter("error IS NULL")
    missing = good.join(current.select(*keys), keys, "left_anti").withColumn("error", F.lit("Layer not found."))
    rejected = checked.filter("error IS NOT NULL").unionByName(missing).select(*keys, "error")
    p = good.select(*keys, *[F.struct(F.col(f"has_{c}").alias("has"), F.col(c).alias("v")).alias(f"_{c}") for c in ("visible", "name", "shape")])
    both = current.join(p, keys, "left")
    out = both.withColumn("updated_at", F.when(F.col("_name").isNotNull(), now).otherwise(F.col("updated_at")))
    for c in ("visible", "name", "shape"):
        out = out.withColumn(c, F.when(F.coalesce(F.col(f"_{c}.has"), F.lit(False)), F.col(f"_{c}.v")).otherwise(F.col(c)))
    return out.select(*current.columns), rejected


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Rows of every table whose parent key is not deleted."""
    ids = gone.select(key).distinct()
    tables = {"parents": parents, **children}
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def replace_children(current: DataFrame, fresh: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """All rows of the listed owners are replaced by `fresh`; the rest stay."""
    return current.join(owners.select(key).distinct(), key, "left_anti").unionByName(fresh)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent has; a null key refers to nothing."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; rows with a null in the key do not count."""
    whole = df
    for k in keys:
        whole = whole.filter(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def append_exchange(messages: DataFrame, chats: DataFrame, exchange: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Adds the user's and the assistant's message of each exchange and touches the chats."""
    user = exchange.select("chat_id", "seq", F.lit("user").alias("role"), F.col("message").alias("content"), now.alias("created_at"))
    reply = exchange.select(
        "chat_id", (F.col("seq") + 1).alias("seq"), F.lit("assistant").alias("role"), F.col("reply").alias("content"), now.alias("created_at")
    )
    touched = exchange.select("chat_id").distinct().withColumn("_t", F.lit(True))
    next_chats = chats.join(touched, "chat_id", "left").withColumn(
        "updated_at", F.when(F.col("_t"), now).otherwise(F.col("updated_at"))
    )
    return messages.unionByName(user).unionByName(reply), next_chats.drop("_t")
