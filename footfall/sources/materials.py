"""Material tables (fixed, a handful of rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.functions import constants as K


def _inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    def literal(value) -> str:
        return f"'{value}'" if isinstance(value, str) else f"{value!r}D"

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def materials(spark: SparkSession) -> DataFrame:
    return _inline(spark, K.MATERIALS, "material, name, k_spec_value, k_spec_units, hardness")


def material_priors(spark: SparkSession) -> DataFrame:
    return _inline(spark, K.MATERIAL_PRIORS, "material, k_spec_median, log_std")


def with_material(rows: DataFrame, column: str = "material") -> DataFrame:
    """Add the properties of each row's material; an unknown name is an error."""
    known = materials(rows.sparkSession).withColumnRenamed("material", column)
    out = rows.join(F.broadcast(known), column, "left")  # five fixed rows
    missing = F.raise_error(F.concat(F.lit("unknown material: "), F.col(column))).cast("double")
    return out.withColumn("k_spec_value", F.when(F.col("name").isNotNull(), F.col("k_spec_value")).otherwise(missing))


def with_material_prior(rows: DataFrame, column: str = "material", compat: bool = False) -> DataFrame:
    """Add the Monte Carlo prior of each row's material (case-insensitive).

    The prior table calls oak "wood"; ``compat`` keeps that mismatch an error.
    """
    name = F.lower(F.col(column))
    if not compat:
        name = F.when(name == "oak", F.lit("wood")).otherwise(name)
    priors = material_priors(rows.sparkSession).withColumnRenamed("material", "prior_name")
    out = rows.withColumn("prior_name", name).join(F.broadcast(priors), "prior_name", "left")  # five fixed rows
    missing = F.raise_error(F.concat(F.lit("unknown material: "), F.col(column))).cast("double")
    return out.withColumn("log_std", F.when(F.col("k_spec_median").isNotNull(), F.col("log_std")).otherwise(missing))
