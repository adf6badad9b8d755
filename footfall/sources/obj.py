"""Wavefront OBJ text as vertex and face tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from footfall.operators.keyed import KeyTable, attach, settle
from footfall.operators.mesh import Mesh, scaled
from footfall.session import materialize


def obj_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all OBJ files under ``path``: (mesh_id, chunk, pos, value).

    Files are read in splits, so a huge file is parsed by many tasks. ``chunk`` is the
    split's offset in its file and ``pos`` grows along the split: together they are the
    line order. The mesh id is the file path.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("mesh_id"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """File-order numbers per mesh from numbers within a split and the splits before it."""
    before = Window.partitionBy("mesh_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("mesh_id", "chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        "mesh_id", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy("mesh_id", "chunk").orderBy(*order)
    return (
        rows.withColumn("_k", F.row_number().over(inside) - 1)
        .join(offsets, ["mesh_id", "chunk"])
        .withColumn(name, (F.col("_off") + F.col("_k")).cast("long"))
        .drop("_off", "_k", "chunk", *order)
    )


def tokens(lines: DataFrame) -> DataFrame:
    """Lines of the record kinds in use as token arrays ``t``; comments, blanks and other keywords go."""
    kept = lines.where(F.col("value").rlike(r"^\s*(v|vn|f)(\s|$)"))
    return kept.select("mesh_id", "chunk", "pos", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"))


def _records(rows: DataFrame, keyword: str) -> DataFrame:
    return rows.where(F.col("t")[0] == keyword)


def _three(lines: DataFrame, keyword: str, id_name: str, names: tuple[str, str, str]) -> DataFrame:
    rows = _records(lines, keyword).select(
        "mesh_id", "chunk", "pos", *[F.col("t")[k + 1].cast("double").alias(n) for k, n in enumerate(names)]
    )
    return _numbered(rows, id_name, "pos").select("mesh_id", id_name, *names)


def _vertex_index(token: Column) -> Column:
    index = F.split_part(token, F.lit("/"), F.lit(1)).cast("long")
    relative = F.raise_error(F.concat(F.lit("vertex index must be 1 or more: "), token)).cast("long")
    return F.when(index >= 1, index - 1).otherwise(relative)


def parse_obj(lines: DataFrame, scale: float = 1.0) -> Mesh:
    """Mesh of OBJ lines, split into tokens once into a written table."""
    return parse_tokens(materialize(tokens(lines), "obj"), scale)


def parse_tokens(lines: DataFrame, scale: float = 1.0) -> Mesh:
    """Vertices and normals in file order; polygons become triangle fans, short faces vanish.

    Vertex numbers below 1 are rejected.
    """
    vertices = _three(lines, "v", "vid", ("x", "y", "z"))
    if scale != 1.0:
        vertices = scaled(vertices, scale)
    corners = _records(lines, "f").select(
        "mesh_id", "chunk", "pos", F.slice("t", F.lit(2), F.size("t") - 1).alias("c")
    ).where(F.size("c") >= 3)
    fans = corners.select("mesh_id", "chunk", "pos", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    faces = _numbered(
        fans.select(
            "mesh_id", "chunk", "pos", "k", _vertex_index(F.col("c")[0]).alias("v0"),
            _vertex_index(F.col("c")[F.col("k")]).alias("v1"), _vertex_index(F.col("c")[F.col("k") + 1]).alias("v2"),
        ),
        "fid", "pos", "k",
    ).select("mesh_id", "fid", "v0", "v1", "v2")
    return Mesh(vertices, faces, _three(lines, "vn", "nid", ("nx", "ny", "nz")))


def read_obj(spark: SparkSession, path: str, scale: float = 1.0) -> Mesh:
    """Parse OBJ files once into written vertex and face tables. A file without vertices is an error."""
    lines = materialize(tokens(obj_lines(spark, path)), "obj")
    parsed = parse_tokens(lines, scale)
    vertices = settle(parsed.vertices, "vertices")
    # the names of the files, which the driver lists anyway; scans leave out empty files
    files = spark.createDataFrame([(name,) for name in spark.read.text(path).inputFiles()], "mesh_id string")
    place = F.regexp_replace("mesh_id", "^([A-Za-z]+):/+", "$1:/").alias("place")  # slashes after the scheme vary
    bare = files.select("mesh_id", place).join(vertices.df.select(place).distinct(), "place", "left_anti").limit(1).collect()
    if bare or vertices.rows == 0:
        raise ValueError(f"no vertices found in {bare[0].mesh_id if bare else path}")
    return Mesh(vertices.df, materialize(parsed.faces, "faces"), parsed.normals)


def scale_to_width(mesh: Mesh, frame_table: KeyTable, measured_m: float) -> tuple[Mesh, DataFrame]:
    """Scale each mesh so that its width equals the measured one: (mesh, mesh_id + scale)."""
    factor = frame_table.df.select("mesh_id", (F.lit(float(measured_m)) / (F.col("w_max") - F.col("w_min"))).alias("scale"))
    joined = attach(mesh.vertices, frame_table.of(factor), spread=["vid"])
    return Mesh(scaled(joined, F.col("scale")).drop("scale"), mesh.faces, mesh.normals), factor
