"""Code lists and the tool catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjelldoc.functions.headings import stripped

# Row cap of ad-hoc queries, preview rows, tool hints per message.
ADHOC_ROWS = 200
PEEK_ROWS = 5
MAX_HINTS = 10


def search_codes(codes: DataFrame, search: str = "") -> DataFrame:
    """Codes whose identifier or description contains the text, any case; `%` and `_` are wildcards."""
    if search:
        pattern = f"%{search}%"
        codes = codes.filter(F.col("identifier").ilike(pattern) | F.col("description").ilike(pattern))
    return codes.select("identifier", "description").orderBy("identifier")


def filter_tools(tools: DataFrame, categories: list[str], text: str) -> DataFrame:
    """Visible tools of the categories (none = all) whose name contains the text."""
    keep = ~F.col("hidden") & F.lower("name").contains(text.lower())
    return tools.filter(keep & F.col("category").isin(categories) if categories else keep)


def validate_tools(tools: DataFrame) -> DataFrame:
    """First failing rule per record; a later record with a known id is a duplicate."""
    required = ["name", "category", "desc", "tool_id", "server"]
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    first = tools.groupBy("tool_id").agg(F.min("pos").alias("_first"))
    rule = F.coalesce(
        F.when(blank, F.lit("required field missing")),
        F.when(F.col("hidden").isNull(), F.lit("hidden must be a boolean")),
        F.when(F.col("pos") > F.col("_first"), F.lit("duplicate id")),
    )
    return tools.join(first, "tool_id", "left").withColumn("error", rule).drop("_first")


def distinct_categories(tools: DataFrame) -> DataFrame:
    """Categories in order of first appearance."""
    return tools.groupBy("category").agg(F.min("pos").alias("first_pos")).orderBy("first_pos")


def sort_by_name(tools: DataFrame) -> DataFrame:
    """Norwegian alphabetical order."""
    return tools.orderBy(F.collate(F.col("name"), "nb"), "tool_id")


def known_hints(hints: Column, allowed: list[str]) -> Column:
    """Trimmed known hints, first occurrences only, at most ten."""
    kept = F.filter(F.transform(hints, stripped), lambda h: h.isin(allowed))
    return F.slice(F.array_distinct(kept), 1, MAX_HINTS)


def hint_names(hints: DataFrame, tools: DataFrame) -> DataFrame:
    """Display name per hint id, the id itself when unknown."""
    names = tools.groupBy("tool_id").agg(F.min_by("name", "pos").alias("_name")).withColumnRenamed("tool_id", "hint")
    return hints.join(names, "hint", "left").withColumn("name", F.coalesce("_name", "hint")).drop("_name")


def sync_selection(previous: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Previously selected ids still available, then newly available ones, each in its own order."""
    kept = previous.join(available.select(*keys), keys, "left_semi").select(*keys, F.lit(0).alias("part"), "pos")
    added = available.join(previous.select(*keys), keys, "left_anti").select(*keys, F.lit(1).alias("part"), "pos")
    return kept.unionByName(added)


def capped_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SELECT over the given tables, at most two hundred rows; as a subquery, no other statement parses."""
    return spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n) LIMIT {ADHOC_ROWS}", **tables)


def peek(df: DataFrame) -> DataFrame:
    return df.limit(PEEK_ROWS)
