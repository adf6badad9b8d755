"""Driver tables read as surfaces, point clouds and sample vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators.mesh import Mesh


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_surfaces(spark: SparkSession, sf_dir: str) -> Mesh:
    """Every three neighbouring embedding dimensions form one surface.

    The third coordinate is flattened by 64 so that most faces lie near horizontal.
    Vertex ids are the vector ids; three consecutive vectors form a face.
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    surface = F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / F.lit(3)).cast("int") - 1))
    vertices = emb.select("vec_id", "embedding", surface.alias("k")).select(
        F.concat(F.lit("s"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("mesh_id"),
        F.col("vec_id").alias("vid"),
        F.col("embedding")[F.col("k") * 3].cast("double").alias("x"),
        F.col("embedding")[F.col("k") * 3 + 1].cast("double").alias("y"),
        (F.col("embedding")[F.col("k") * 3 + 2].cast("double") / 64.0).alias("z"),
    )
    triples = emb.groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("fid")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")
    ).where("n = 3")
    first = F.col("fid") * 3
    faces = triples.select(
        "fid", F.explode(F.sequence(F.lit(0), F.floor(F.col("dims") / F.lit(3)).cast("int") - 1)).alias("k")
    ).select(
        F.concat(F.lit("s"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("mesh_id"), "fid",
        first.alias("v0"), (first + 1).alias("v1"), (first + 2).alias("v2"),
    )
    return Mesh(vertices, faces)


def spread_small(df: DataFrame) -> DataFrame:
    """Give a scan that has fewer splits than cores one part per core; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shipment_points(spark: SparkSession, sf_dir: str, mesh: str = "l_suppkey") -> DataFrame:
    """Line items as points (mesh_id, w, d, u) in metres, one cloud per supplier by default."""
    lines = table(spark, sf_dir, "lineitem").select(mesh, "l_extendedprice", "l_shipdate", "l_quantity")
    return spread_small(lines).select(
        F.concat(F.lit("p"), F.col(mesh).cast("string")).alias("mesh_id"),
        (F.col("l_extendedprice") / 100000.0).alias("w"),
        (F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")) / 8192.0).alias("d"),
        (F.col("l_quantity") / 4096.0).alias("u"),
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "value")
