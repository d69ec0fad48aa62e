"""Reads that respect who is asking."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.columns import mask


def entitlements(plants: DataFrame, grants: DataFrame, members: DataFrame, everywhere: Sequence[str]) -> DataFrame:
    """(principal, plant_id): a plant is open to whoever has a grant for it or belongs to a group that sees all.

    `plants` holds each plant_id that occurs, a small dimension; `members` holds principal and member_of.
    """
    every_plant = plants.agg(F.collect_set("plant_id")).scalar()
    leads = members.where(F.col("member_of").isin(*everywhere)).select("principal", F.explode(every_plant).alias("plant_id"))
    return grants.select("principal", "plant_id").union(leads).distinct()


def visible_rows(df: DataFrame, entitled: DataFrame, plant_column: str) -> DataFrame:
    """Each row once for every principal who may see it, as `seen_by`: one join, whoever is asking."""
    who = entitled.select(F.col("principal").alias("seen_by"), F.col("plant_id").alias("_plant"))
    return df.join(who, F.col(plant_column) == F.col("_plant")).drop("_plant")


def masked(df: DataFrame, private: Sequence[str], revealed: Column) -> DataFrame:
    """Personal data where `revealed` is TRUE, a fixed text elsewhere."""
    return df.withColumns({c: mask(c, revealed) for c in private})


def masked_for(df: DataFrame, private: Sequence[str], members: DataFrame, groups: Sequence[str]) -> DataFrame:
    """`masked` by who is asking (`seen_by`): members of one of the groups see personal data."""
    trusted = members.where(F.col("member_of").isin(*groups)).select(F.col("principal").alias("_trusted")).distinct()
    asked = df.join(trusted, F.col("seen_by") == F.col("_trusted"), "left")
    return masked(asked, private, F.col("_trusted").isNotNull()).drop("_trusted")


def register_functions(spark: SparkSession) -> None:
    """The same two rules for SQL users. Whether a reader may see personal data, and which plants, are arguments."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION mask_personal(v STRING, revealed BOOLEAN) RETURNS STRING
                 RETURN CASE WHEN revealed THEN v ELSE '***redacted***' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION may_see_plant(plant STRING, plants ARRAY<STRING>, exempt BOOLEAN)
                 RETURNS BOOLEAN RETURN exempt OR array_contains(plants, plant)""")


def register_secured_read(df: DataFrame, name: str, plant_column: str, private: Sequence[str], entitled: DataFrame,
                          trusted: DataFrame) -> None:
    """A temporary SQL table function `<name>_for(asked_by STRING)`: the rows that a principal may see, personal data
    masked unless the principal is among `trusted`. An unknown or NULL principal sees nothing.

    `entitled` holds (principal, plant_id) once each, `trusted` holds principal.
    """
    spark = df.sparkSession
    register_functions(spark)
    df.createOrReplaceTempView(f"{name}_all")
    entitled.select("principal", "plant_id").distinct().createOrReplaceTempView(f"{name}_entitled")
    trusted.select("principal").distinct().createOrReplaceTempView(f"{name}_trusted")
    shown = ", ".join(f"mask_personal(d.{c}, t.principal IS NOT NULL)" if c in private else f"d.{c}" for c in df.columns)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_for(asked_by STRING) RETURNS TABLE ({columns})
        RETURN SELECT {shown} FROM {name}_all d JOIN {name}_entitled e ON d.{plant_column} = e.plant_id
        LEFT JOIN {name}_trusted t ON e.principal = t.principal WHERE e.principal = asked_by""")


def grants_per_principal(plant_access: DataFrame) -> DataFrame:
    """Plants of each principal as one sorted, comma-separated text. A principal has no more entries than plants."""
    return plant_access.select("principal", "plant_id").distinct().groupBy("principal").agg(
        F.count(F.lit(1)).alias("n_plants"), F.array_join(F.array_sort(F.collect_list("plant_id")), ",").alias("plants"))
