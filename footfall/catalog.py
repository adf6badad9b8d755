"""Every operator as a named query over the driver tables, with its SQL counterpart.

Surfaces come from ``embeddings`` (three dimensions each), point clouds and sample sets
from ``lineitem`` and ``events``. Queries without SQL rest on seeded draws or on
expectation-maximisation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.functions import constants as K
from footfall.functions import geometry as G
from footfall.operators import clamped, grid as Gr, mesh as M, plane as P, traffic as T, uncertainty as U
from footfall.operators.keyed import KeyTable, attach, settle, with_ordinals
from footfall.operators.mixture import lateral_mixture
from footfall.operators.quantiles import exact_quantiles
from footfall.operators.volume import wear_volume
from footfall.plans import pipeline as PL
from footfall.session import materialize
from footfall.sinks import charts, report
from footfall.sources import obj
from footfall.sources.materials import material_priors, materials, with_material, with_material_prior
from footfall.sources.tables import embedding_surfaces, event_samples, shipment_points, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

GRID = K.GRID
PLANES = 500
AXES = (0, 1, 2)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r(col: str | Column, digits: int = 9, name: str | None = None) -> Column:
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(name or col) if name or isinstance(col, str) else out


# --- shared pieces of SQL ---------------------------------------------------------

SV = """sv AS (SELECT 's' || lpad(CAST(k AS VARCHAR), 2, '0') AS mesh_id, vec_id AS vid,
  CAST(embedding[3*k+1] AS DOUBLE) AS x, CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE)/64.0 AS z
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding)//3)) AS k FROM embeddings))"""
SF = """sf AS (SELECT mesh_id, vid//3 AS fid, vid AS v0, vid+1 AS v1, vid+2 AS v2 FROM sv
  WHERE vid % 3 = 0 AND vid + 2 <= (SELECT max(vec_id) FROM embeddings))"""
ST = """st AS (SELECT f.mesh_id, f.fid, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1,
  c.x AS x2, c.y AS y2, c.z AS z2 FROM sf f JOIN sv a ON a.mesh_id=f.mesh_id AND a.vid=f.v0
  JOIN sv b ON b.mesh_id=f.mesh_id AND b.vid=f.v1 JOIN sv c ON c.mesh_id=f.mesh_id AND c.vid=f.v2)"""
SN = """sn AS (SELECT *, (y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) AS ny,
  (x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) AS nz FROM st)"""
SL = """sl AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS len FROM sn)"""
BOX = """box AS (SELECT mesh_id, count(*) AS n_vertices, min(x) AS x_min, max(x) AS x_max, avg(x) AS x_center, max(x)-min(x) AS x_size,
  min(y) AS y_min, max(y) AS y_max, avg(y) AS y_center, max(y)-min(y) AS y_size,
  min(z) AS z_min, max(z) AS z_max, avg(z) AS z_center, max(z)-min(z) AS z_size FROM sv GROUP BY mesh_id)"""
PV = """pv AS (SELECT 'p' || CAST(l_suppkey AS VARCHAR) AS mesh_id, l_extendedprice/100000.0 AS w,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))/8192.0 AS d, l_quantity/4096.0 AS u FROM lineitem)"""
PB = """pb AS (SELECT mesh_id, min(w) AS w_min, max(w) AS w_max, min(d) AS d_min, max(d) AS d_max, max(u) AS u_max FROM pv GROUP BY mesh_id)"""
STRIP = """strip AS (SELECT v.mesh_id, v.vid, v.x AS w, v.y AS d, v.z AS u FROM sv v JOIN box b ON b.mesh_id=v.mesh_id
  WHERE v.x < x_min+0.1*(x_max-x_min) OR v.x > x_max-0.1*(x_max-x_min) OR v.y < y_min+0.1*(y_max-y_min) OR v.y > y_max-0.1*(y_max-y_min))"""
CAND = """q75 AS (SELECT mesh_id, count(*) AS n, quantile_cont(u, 0.75) AS q FROM strip GROUP BY mesh_id),
cand AS (SELECT s.* FROM strip s JOIN q75 ON q75.mesh_id=s.mesh_id WHERE n <= 100 OR u >= q)"""
MATERIAL = "mat AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{n}', {k!r}::DOUBLE, '{u}', {h!r}::DOUBLE)" for m, n, k, u, h in K.MATERIALS
) + ") t(material, name, k_spec_value, k_spec_units, hardness))"


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def grid_sql(points: str, extents: str, g: int = GRID) -> str:
    """Nodes, and the highest point near each: a point can only be near the two nodes around it on each axis."""
    step = {a: f"(({a}_max-{a}_min)/{g-1}.0)" for a in "wd"}
    place = lambda a, k: f"CASE WHEN {k}={g-1} THEN {a}_max ELSE {a}_min + {k}*{step[a]} END"
    below = lambda a: f"CAST(floor((p.{a}-{a}_min)*{g-1}.0/nullif({a}_max-{a}_min, 0)) AS INTEGER)"
    return f"""nodes AS (SELECT mesh_id, i, j, w_min, w_max, d_min, d_max, {place('w', 'j')} AS x, {place('d', 'i')} AS y
  FROM {extents}, range(0,{g}) a(i), range(0,{g}) b(j)),
around AS (SELECT p.mesh_id, p.w, p.d, p.u, w_min, w_max, d_min, d_max, {below('w')}+q AS j, {below('d')}+r AS i
  FROM {points} p JOIN {extents} e ON e.mesh_id=p.mesh_id, range(0,2) a(q), range(0,2) b(r)),
top AS (SELECT mesh_id, i, j, max(u) AS u_top FROM around WHERE i BETWEEN 0 AND {g-1} AND j BETWEEN 0 AND {g-1}
  AND abs(w-({place('w', 'j')})) < (w_max-w_min)/{g}.0 AND abs(d-({place('d', 'i')})) < (d_max-d_min)/{g}.0 GROUP BY mesh_id, i, j)"""


LEGACY = """edge AS (SELECT p.mesh_id, quantile_cont(u, 0.95) AS q95 FROM pv p JOIN pb b ON b.mesh_id=p.mesh_id
  WHERE w < w_min+0.1*(w_max-w_min) OR w > w_max-0.1*(w_max-w_min) GROUP BY p.mesh_id),
ref AS (SELECT b.mesh_id, coalesce(q95, u_max) AS h FROM pb b LEFT JOIN edge e ON e.mesh_id=b.mesh_id),
cell AS (SELECT n.mesh_id, n.i, n.j, n.x, n.y, coalesce(greatest(0.0, h-u_top), 0.0)*1000.0 AS depth_mm FROM nodes n
  JOIN ref ON ref.mesh_id=n.mesh_id LEFT JOIN top t ON t.mesh_id=n.mesh_id AND t.i=n.i AND t.j=n.j)"""
LEG = (PV, PB, grid_sql("pv", "pb"), LEGACY)
LATERAL = f"""col AS (SELECT mesh_id, j, min(x) AS x, CAST(sum(CAST(round(depth_mm*1e6) AS BIGINT)) AS BIGINT) AS v FROM cell GROUP BY mesh_id, j),
tot AS (SELECT mesh_id, CAST(sum(v) AS BIGINT) AS t FROM col GROUP BY mesh_id),
lat AS (SELECT c.mesh_id, j, x, CASE WHEN t > 0 THEN v/t ELSE 0.0 END AS share,
  CASE WHEN t > 0 THEN v*1000 // t ELSE 0 END AS weight FROM col c JOIN tot ON tot.mesh_id=c.mesh_id)"""
REGION = f"""lon AS (SELECT mesh_id, i, min(y) AS y, sum(depth_mm) AS v FROM cell GROUP BY mesh_id, i),
lm AS (SELECT mesh_id, avg(v) AS m FROM lon GROUP BY mesh_id),
reg0 AS (SELECT l.mesh_id, avg(v) FILTER (i < {GRID//4}) AS nosing_wear, avg(v) FILTER (i >= {GRID//4} AND i < {3*GRID//4}) AS center_wear,
  avg(v) FILTER (i >= {3*GRID//4}) AS back_wear, CASE WHEN max(v) > min(v) THEN avg((v-m)**3)/(avg((v-m)**2)**1.5) END AS skewness
  FROM lon l JOIN lm ON lm.mesh_id=l.mesh_id GROUP BY l.mesh_id),
reg AS (SELECT *, CASE WHEN center_wear > 0 THEN nosing_wear/center_wear ELSE 0.0 END AS nosing_wear_ratio FROM reg0)"""


# --- inputs ----------------------------------------------------------------------

def surfaces(spark: SparkSession, sf: str) -> M.Mesh:
    return embedding_surfaces(spark, sf)


def plain_frame(mesh: M.Mesh) -> KeyTable:
    """Frame with x, y, z as width, depth, up."""
    return M.frame(M.given_roles(M.bounds(mesh.vertices), *AXES))


def points_of(mesh: M.Mesh, frame: KeyTable) -> DataFrame:
    return M.oriented_points(mesh.vertices, frame)


def faces_of(mesh: M.Mesh, frame: KeyTable) -> DataFrame:
    return M.oriented_triangles(M.triangles(mesh), frame)


def level_plane(frame: KeyTable) -> KeyTable:
    """Fixed plane u = w/1024 - d/512 + 1/1024 for every mesh."""
    return frame.of(frame.df.select(
        "mesh_id", F.lit(1 / 1024).alias("a"), F.lit(-1 / 512).alias("b"), F.lit(1 / 1024).alias("c")
    ))


def shipments(spark: SparkSession, sf: str) -> tuple[DataFrame, KeyTable]:
    pts = shipment_points(spark, sf)
    ext = pts.groupBy("mesh_id").agg(
        F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.min("d").alias("d_min"), F.max("d").alias("d_max"),
        F.max("u").alias("u_max"), F.count(F.lit(1)).alias("n_vertices"),
    )
    return pts, settle(ext, "extents", most_vertices=F.max("n_vertices"), vertices=F.sum("n_vertices")).with_hot("n_vertices")


def shipment_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, KeyTable]:
    pts, ext = shipments(spark, sf)
    cells, _ = Gr.legacy_cells(pts, ext, GRID)
    return materialize(cells, "cells"), ext


# --- sources ---------------------------------------------------------------------

def obj_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as OBJ lines, one scan per three dimensions: vertices, normals, texture noise, comments, polygons of 2 to 6 corners."""
    scan = F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / F.lit(3)).cast("int") - 1)).alias("scan")
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding", scan)
    e = [F.col("embedding")[F.col("scan") * 3 + k].cast("double").cast("string") for k in range(3)]
    corner = lambda k: F.concat((F.col("vec_id") + 1 - k).cast("string"), F.lit("/1/2"))
    size = F.least(F.col("vec_id") + 1, F.lit(2) + F.pmod("vec_id", F.lit(5)))
    face = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), corner), "  "))
    lines = F.array(
        F.concat(F.lit("# vector "), F.col("vec_id").cast("string")), F.lit(""), F.lit("vt 0.5 0.5"),
        F.concat_ws(" ", F.lit(" v"), *e, F.lit("1.0")), F.concat_ws("\t", F.lit("vn"), e[2], e[1], e[0]), face, F.lit("g part"),
    )
    return emb.select(
        F.concat(F.lit("scan"), F.lpad(F.col("scan").cast("string"), 2, "0")).alias("mesh_id"), F.floor(F.col("vec_id") / 64).alias("chunk"), F.posexplode(lines).alias("k", "value"), "vec_id"
    ).select("mesh_id", "chunk", (F.col("vec_id") * 16 + F.col("k")).alias("pos"), "value")


SCANS = """sc AS (SELECT 'scan' || lpad(CAST(k AS VARCHAR), 2, '0') AS mesh_id, vec_id, CAST(embedding[3*k+1] AS DOUBLE) AS p,
  CAST(embedding[3*k+2] AS DOUBLE) AS q, CAST(embedding[3*k+3] AS DOUBLE) AS s FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding)//3)) AS k FROM embeddings))"""


@query("obj_vertices", cte(SCANS) + "SELECT mesh_id, vec_id AS vid, p*0.5 AS x, q*0.5 AS y, s*0.5 AS z FROM sc")
def _(spark, sf):
    return obj.parse_obj(obj_text(spark, sf), 0.5).vertices


@query("obj_faces", cte(SCANS, """n AS (SELECT mesh_id, vec_id, least(vec_id+1, 2 + vec_id % 5) AS n FROM sc)""",
       "t AS (SELECT mesh_id, vec_id, k FROM n, range(1, 5) r(k) WHERE k <= n-2)") + """
SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY vec_id, k)-1 AS fid, vec_id AS v0, vec_id-k AS v1, vec_id-k-1 AS v2 FROM t""")
def _(spark, sf):
    return obj.parse_obj(obj_text(spark, sf)).faces


@query("obj_normals", cte(SCANS) + "SELECT mesh_id, vec_id AS nid, s AS nx, q AS ny, p AS nz FROM sc")
def _(spark, sf):
    return obj.parse_obj(obj_text(spark, sf)).normals


@query("mesh_scaling", cte(SV) + "SELECT mesh_id, vid, x*0.001 AS x, y*0.001 AS y, z*0.001 AS z FROM sv")
def _(spark, sf):
    return M.scaled(surfaces(spark, sf).vertices, 0.001)


BOUND_COLS = [f"{c}_{k}" for c in "xyz" for k in ("min", "max", "center", "size")]


@query("mesh_bounds", cte(SV, BOX) + "SELECT mesh_id, n_vertices, " + ", ".join(f"round({c},9) AS {c}" for c in BOUND_COLS) + " FROM box")
def _(spark, sf):
    return M.bounds(surfaces(spark, sf).vertices).select("mesh_id", "n_vertices", *[r(c) for c in BOUND_COLS])


AXIS_SQL = """an AS (SELECT mesh_id, avg(abs(nx/(len+1e-10))) AS ax, avg(abs(ny/(len+1e-10))) AS ay, avg(abs(nz/(len+1e-10))) AS az FROM sl GROUP BY mesh_id),
up AS (SELECT b.*, CASE WHEN ax >= ay AND ax >= az THEN 0 WHEN ay >= az THEN 1 ELSE 2 END AS up_axis FROM box b JOIN an ON an.mesh_id=b.mesh_id),
two AS (SELECT *, CASE WHEN up_axis=0 THEN 1 ELSE 0 END AS p, CASE WHEN up_axis=2 THEN 1 ELSE 2 END AS q,
  [x_size, y_size, z_size] AS s FROM up),
ax AS (SELECT *, CASE WHEN s[p+1] < s[q+1] THEN p ELSE q END AS width_axis, CASE WHEN s[p+1] < s[q+1] THEN q ELSE p END AS depth_axis FROM two)"""
AXES_CTE = (SV, SF, ST, SN, SL, BOX, AXIS_SQL)


@query("axis_inference", cte(*AXES_CTE) + """SELECT mesh_id, substr('XYZ', width_axis+1, 1) AS width, substr('XYZ', depth_axis+1, 1) AS depth,
substr('XYZ', up_axis+1, 1) AS up, 'AxisConfig(width=' || substr('XYZ', width_axis+1, 1) || ', depth=' || substr('XYZ', depth_axis+1, 1)
|| ', up=' || substr('XYZ', up_axis+1, 1) || ')' AS axis_repr FROM ax""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    return M.axis_names(M.axis_roles(M.bounds(mesh.vertices), M.triangles(mesh)))


@query("measured_width_scale", cte(*AXES_CTE) + "SELECT mesh_id, round(1.2/s[width_axis+1], 9) AS scale FROM ax")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = M.frame(M.axis_roles(M.bounds(mesh.vertices), M.triangles(mesh)))
    return obj.scale_to_width(mesh, frame, 1.2)[1].select("mesh_id", r("scale"))


# --- projections -----------------------------------------------------------------

@query("face_normals", cte(SV, SF, ST, SN, SL) + "SELECT mesh_id, fid, " + ", ".join(
    f"round(n{c}/(len+1e-10),9) AS n{c}" for c in "xyz") + " FROM sl")
def _(spark, sf):
    n = G.unit_normal(G.normal())
    return M.triangles(surfaces(spark, sf)).select("mesh_id", "fid", *[r(v, 9, f"n{c}") for v, c in zip(n, "xyz")])


TILT = """tilt AS (SELECT *, (x0+x1+x2)/3.0 AS cw, (y0+y1+y2)/3.0 AS cd,
  degrees(acos(least(1.0, CASE WHEN len > 1e-10 THEN abs(nz)/len ELSE 1.0 END))) AS tilt FROM sl)"""


@query("triangle_tilt", cte(SV, SF, ST, SN, SL, TILT) + "SELECT mesh_id, fid, round(cw,9) AS cw, round(cd,9) AS cd, round(tilt,6) AS tilt FROM tilt")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    tilted = M.with_tilt(faces_of(mesh, plain_frame(mesh)))
    return tilted.select("mesh_id", "fid", r("cw"), r("cd"), r("tilt", 6))


@query("plane_depths", cte(SV) + "SELECT mesh_id, vid, round((x/1024.0 - y/512.0 + 1.0/1024)*1000, 6) AS predicted_mm, "
       "round(greatest(0.0, x/1024.0 - y/512.0 + 1.0/1024 - z)*1000, 6) AS depth_mm FROM sv")
def _(spark, sf):
    height = G.plane_height(F.lit(1 / 1024), F.lit(-1 / 512), F.lit(1 / 1024), F.col("x"), F.col("y"))
    return surfaces(spark, sf).vertices.select(
        "mesh_id", "vid", r(height * 1000, 6, "predicted_mm"), r(G.depth(height, F.col("z")) * 1000, 6, "depth_mm")
    )


# --- segmentation and volume -----------------------------------------------------

ROI = """roi AS (SELECT mesh_id, count(*) AS n, quantile_cont(cw, 0.01) AS w_lo, quantile_cont(cw, 0.99) AS w_hi,
  quantile_cont(cd, 0.01) AS d_lo, quantile_cont(cd, 0.99) AS d_hi FROM tilt GROUP BY mesh_id)"""
TREAD = """tread AS (SELECT t.*, t.tilt < 25 AND cw BETWEEN w_lo AND w_hi AND cd BETWEEN d_lo AND d_hi AS is_tread
  FROM tilt t JOIN roi ON roi.mesh_id=t.mesh_id)"""
TREAD_CTE = (SV, SF, ST, SN, SL, TILT, ROI, TREAD)


@query("roi_percentiles", cte(SV, SF, ST, SN, SL, TILT, ROI) + "SELECT mesh_id, n, " + ", ".join(
    f"round({c},9) AS {c}" for c in ("w_lo", "w_hi", "d_lo", "d_hi")) + " FROM roi")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    window = M.roi_window(M.with_tilt(faces_of(mesh, plain_frame(mesh))), K.ROI_QUANTILES)
    return window.select("mesh_id", "n", *[r(c) for c in ("w_lo", "w_hi", "d_lo", "d_hi")])


def tread_of(spark, sf) -> tuple[M.Mesh, KeyTable, DataFrame]:
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    tris = materialize(faces_of(mesh, frame), "faces")
    return mesh, frame, M.segment_tread(tris)


@query("tread_segmentation", cte(*TREAD_CTE) + """SELECT mesh_id, count(*) FILTER (is_tread) AS tread_count, count(*) FILTER (NOT is_tread) AS excluded_count,
round(1.0 - count(*) FILTER (is_tread)/count(*), 9) AS excluded_fraction FROM tread GROUP BY mesh_id""")
def _(spark, sf):
    return M.tread_summary(tread_of(spark, sf)[2]).withColumn("excluded_fraction", r("excluded_fraction"))


VOLUME = """dep AS (SELECT *, greatest(0.0, x0*a+y0*b+c-z0) AS p0, greatest(0.0, x1*a+y1*b+c-z1) AS p1, greatest(0.0, x2*a+y2*b+c-z2) AS p2,
  0.5*abs((x1-x0)*(y2-y0)-(x2-x0)*(y1-y0)) AS area FROM tri)"""
VOLUME_OUT = """round(sum((p0+p1+p2)/3.0*area)*1e6, 6) AS volume_cm3, round(max(greatest(p0,p1,p2))*1000.0, 6) AS max_depth,
round(coalesce(avg(CASE WHEN p0+p1+p2 > 0 THEN (p0+p1+p2)/3.0 END), 0)*1000.0, 6) AS mean_depth"""
FIXED_TRI = "tri AS (SELECT *, 1/1024.0 AS a, -1/512.0 AS b, 1/1024.0 AS c FROM tread WHERE is_tread)"


def volume_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r(F.col("volume") * 1e6, 6, "volume_cm3"), r("max_depth", 6), r("mean_depth", 6))


@query("triangle_wear_volume", cte(*TREAD_CTE, FIXED_TRI, VOLUME) + f"SELECT mesh_id, count(*) AS triangles_used, {VOLUME_OUT} FROM dep GROUP BY mesh_id")
def _(spark, sf):
    _, frame, tread = tread_of(spark, sf)
    return volume_columns(wear_volume(tread.where("is_tread"), level_plane(frame)), "mesh_id", "triangles_used")


# --- reference plane -------------------------------------------------------------

@query("plane_candidates", cte(SV, BOX, STRIP, CAND) + "SELECT mesh_id, vid, w, d, u FROM cand")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    return P.plane_candidates(points_of(mesh, frame), frame)


def candidates_of(spark, sf) -> DataFrame:
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    return materialize(with_ordinals(P.plane_candidates(points_of(mesh, frame), frame), "vid"), "candidates")


OLS = """mo AS (SELECT mesh_id, count(*) AS n, avg(w) AS mw, avg(d) AS md, avg(u) AS mu, var_pop(w) AS vw, var_pop(d) AS vd,
  covar_pop(w,d) AS cwd, covar_pop(w,u) AS cwu, covar_pop(d,u) AS cdu FROM cand GROUP BY mesh_id),
ab AS (SELECT *, (cwu*vd-cdu*cwd)/(vw*vd-cwd*cwd) AS a, (cdu*vw-cwu*cwd)/(vw*vd-cwd*cwd) AS b FROM mo),
ols AS (SELECT mesh_id, n, a, b, mu-a*mw-b*md AS c FROM ab)"""


@query("plane_ols", cte(SV, BOX, STRIP, CAND, OLS) + "SELECT mesh_id, n, round(a,9) AS a, round(b,9) AS b, round(c,9) AS c FROM ols")
def _(spark, sf):
    return P.ols_planes(candidates_of(spark, sf)).select("mesh_id", "n", r("a"), r("b"), r("c"))


@query("plane_rms", cte(SV, BOX, STRIP, CAND, OLS) + """SELECT k.mesh_id, round(sqrt(avg((a*w+b*d+c-u)**2))*1000.0, 6) AS rms_error_mm
FROM cand k JOIN ols ON ols.mesh_id=k.mesh_id GROUP BY k.mesh_id""")
def _(spark, sf):
    cand = candidates_of(spark, sf)
    return P.rms_mm(cand, settle(P.ols_planes(cand).drop("n"), "ols")).select("mesh_id", r("rms_error_mm", 6))


def fixed_triples(counts: DataFrame) -> DataFrame:
    """Index triples by a rule of the iteration number, so that any engine can repeat them."""
    it = counts.select("mesh_id", "n", F.explode(F.sequence(F.lit(0), F.lit(PLANES - 1))).alias("it"))
    picks = F.array(F.col("it") * 7, F.col("it") * 13 + 1, F.col("it") * 29 + 2)
    return it.select("mesh_id", "it", F.posexplode(picks).alias("corner", "k"), "n").select(
        "mesh_id", "it", "corner", F.pmod("k", "n").cast("long").alias("ord")
    )


HYP = f"""num AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY vid)-1 AS o, count(*) OVER (PARTITION BY mesh_id) AS n FROM cand),
cn AS (SELECT mesh_id, max(n) AS n FROM num GROUP BY mesh_id),
tr AS (SELECT mesh_id, it, (it*7)%n AS i0, (it*13+1)%n AS i1, (it*29+2)%n AS i2 FROM cn, range(0,{PLANES}) r(it)),
co AS (SELECT t.mesh_id, t.it, p.w AS w0, p.d AS d0, p.u AS u0, q.w-p.w AS w1, q.d-p.d AS d1, q.u-p.u AS u1, s.w-p.w AS w2, s.d-p.d AS d2, s.u-p.u AS u2
  FROM tr t JOIN num p ON p.mesh_id=t.mesh_id AND p.o=i0 JOIN num q ON q.mesh_id=t.mesh_id AND q.o=i1 JOIN num s ON s.mesh_id=t.mesh_id AND s.o=i2),
de AS (SELECT *, w1*d2-w2*d1 AS det FROM co),
sol AS (SELECT *, (u1*d2-u2*d1)/det AS a, (w1*u2-w2*u1)/det AS b FROM de WHERE det <> 0),
hyp AS (SELECT mesh_id, it, a, b, u0-a*w0-b*d0 AS c FROM sol)"""
SCORE = """sc AS (SELECT h.mesh_id, h.it, count(*) FILTER (abs(a*w+b*d+c-u) < 0.002) AS inliers FROM hyp h JOIN num n ON n.mesh_id=h.mesh_id GROUP BY h.mesh_id, h.it)"""
HYP_CTE = (SV, BOX, STRIP, CAND, HYP)


def hypotheses_of(spark, sf) -> tuple[DataFrame, KeyTable, DataFrame]:
    cand = candidates_of(spark, sf)
    counts = settle(cand.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")), "n")
    return cand, counts, materialize(P.solve_triples(fixed_triples(counts.df), cand), "hyp")


@query("ransac_hypotheses", cte(*HYP_CTE) + "SELECT mesh_id, CAST(it AS INTEGER) AS it, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c FROM hyp")
def _(spark, sf):
    return hypotheses_of(spark, sf)[2].select("mesh_id", "it", r("a", 6), r("b", 6), r("c", 6))


@query("plane_inlier_count", cte(*HYP_CTE, SCORE) + "SELECT mesh_id, CAST(it AS INTEGER) AS it, inliers FROM sc")
def _(spark, sf):
    cand, counts, hyps = hypotheses_of(spark, sf)
    return P.inlier_counts(cand, hyps, counts, 0.002)


@query("ransac_best_plane", cte(*HYP_CTE, SCORE) + """SELECT s.mesh_id, s.inliers, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c
FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY inliers DESC, it) AS k FROM sc WHERE inliers > 0) s
JOIN hyp h ON h.mesh_id=s.mesh_id AND h.it=s.it WHERE k = 1""")
def _(spark, sf):
    cand, counts, hyps = hypotheses_of(spark, sf)
    best = P.best_plane(P.inlier_counts(cand, hyps, counts, 0.002), hyps)
    return best.select("mesh_id", "inliers", r("a", 6), r("b", 6), r("c", 6))


@query("fallback_plane", cte(PV) + "SELECT mesh_id, count(*) AS n, round(quantile_cont(u, 0.5), 9) AS c FROM pv GROUP BY mesh_id")
def _(spark, sf):
    level = exact_quantiles(shipment_points(spark, sf), "u", [0.5])
    return level.select("mesh_id", "n", r(F.col("q")[0], 9, "c"))


FIT = """bs AS (SELECT s.mesh_id, s.inliers, a AS ha, b AS hb, c AS hc FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY inliers DESC, it) AS k FROM sc WHERE inliers > 0) s
  JOIN hyp h ON h.mesh_id=s.mesh_id AND h.it=s.it WHERE k = 1 AND s.inliers >= 10),
nl AS (SELECT n.* FROM num n JOIN bs ON bs.mesh_id=n.mesh_id WHERE abs(ha*w+hb*d+hc-u) < 0.002),
im AS (SELECT mesh_id, avg(w) AS mw, avg(d) AS md, avg(u) AS mu, var_pop(w) AS vw, var_pop(d) AS vd, covar_pop(w,d) AS cwd, covar_pop(w,u) AS cwu, covar_pop(d,u) AS cdu FROM nl GROUP BY mesh_id),
ia AS (SELECT *, (cwu*vd-cdu*cwd)/(vw*vd-cwd*cwd) AS a, (cdu*vw-cwu*cwd)/(vw*vd-cwd*cwd) AS b FROM im),
rf AS (SELECT mesh_id, a, b, mu-a*mw-b*md AS c FROM ia),
rm AS (SELECT l.mesh_id, sqrt(avg((a*w+b*d+c-u)**2))*1000.0 AS rms FROM nl l JOIN rf ON rf.mesh_id=l.mesh_id GROUP BY l.mesh_id)"""


def plane_columns(df: DataFrame) -> DataFrame:
    return df.select("mesh_id", r("a", 6), r("b", 6), r("c", 6), r("inlier_fraction"), r("rms_error_mm", 6), "method", "candidates_used", "inlier_count")


@query("ruled_plane", cte(*HYP_CTE, SCORE, FIT) + """SELECT b.mesh_id, coalesce(round(a,6), 0.0) AS a, coalesce(round(rf.b,6), 0.0) AS b,
round(coalesce(rf.c, (SELECT quantile_cont(z, 0.5) FROM sv WHERE sv.mesh_id=b.mesh_id)), 6) AS c, round(coalesce(inliers/cn.n, 0.0), 9) AS inlier_fraction,
round(coalesce(rms, 0.0), 6) AS rms_error_mm, CASE WHEN rf.mesh_id IS NULL THEN 'fallback' ELSE 'RANSAC' END AS method, coalesce(cn.n, 0) AS candidates_used, coalesce(inliers, 0) AS inlier_count
FROM box b LEFT JOIN cn ON cn.mesh_id=b.mesh_id LEFT JOIN bs ON bs.mesh_id=b.mesh_id LEFT JOIN rf ON rf.mesh_id=b.mesh_id LEFT JOIN rm ON rm.mesh_id=b.mesh_id""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    return plane_columns(P.fit_planes(points_of(mesh, frame), frame, PLANES, draw=lambda counts, iters: fixed_triples(counts)).plane.df)


@query("fallback_decision", """WITH ov AS (SELECT 'p' || CAST(l_orderkey AS VARCHAR) AS mesh_id, l_extendedprice/100000.0 AS w,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))/8192.0 AS d, l_quantity/4096.0 AS u FROM lineitem),
ob AS (SELECT mesh_id, count(*) AS n, min(w) AS wl, max(w) AS wh, min(d) AS dl, max(d) AS dh, quantile_cont(u, 0.5) AS c FROM ov GROUP BY mesh_id),
oc AS (SELECT v.mesh_id, count(*) AS n FROM ov v JOIN ob ON ob.mesh_id=v.mesh_id WHERE w < wl+0.1*(wh-wl) OR w > wh-0.1*(wh-wl) OR d < dl+0.1*(dh-dl) OR d > dh-0.1*(dh-dl) GROUP BY v.mesh_id)
SELECT ob.mesh_id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, round(c, 6) AS c, 0.0::DOUBLE AS inlier_fraction, 0.0::DOUBLE AS rms_error_mm, 'fallback' AS method, coalesce(oc.n, 0) AS candidates_used,
CAST(0 AS BIGINT) AS inlier_count FROM ob LEFT JOIN oc ON oc.mesh_id=ob.mesh_id WHERE ob.n < 10""")
def _(spark, sf):
    pts = shipment_points(spark, sf, "l_orderkey")
    small = settle(pts.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where("n < 10").select("mesh_id"), "small")
    pts = materialize(attach(pts, small, spread=["w"]).withColumn("vid", F.monotonically_increasing_id()), "small")
    ext = pts.groupBy("mesh_id").agg(
        F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.count(F.lit(1)).alias("n_vertices")
    )
    return plane_columns(P.fit_planes(pts, settle(ext, "extents", most_vertices=F.max("n_vertices"))).plane.df)


@query("robust_plane")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    return P.fit_planes(points_of(mesh, frame), frame).plane.df


@query("bootstrap_planes")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    pts = points_of(mesh, frame)
    support, planes = P.bootstrap_support(pts, frame, P.fit_planes(pts, frame))
    return P.bootstrap_planes(support, planes, K.MC_SAMPLES)[0]


# --- grids and profiles ----------------------------------------------------------

SGRID = "sp AS (SELECT mesh_id, x AS w, y AS d, z AS u FROM sv)", "sb AS (SELECT mesh_id, x_min AS w_min, x_max AS w_max, y_min AS d_min, y_max AS d_max FROM box)"


@query("depth_grid", cte(SV, BOX, *SGRID, grid_sql("sp", "sb")) + """SELECT n.mesh_id, CAST(n.i AS INTEGER) AS i, CAST(n.j AS INTEGER) AS j, round(n.y,9) AS y, round(n.x,9) AS x,
round(coalesce(greatest(0.0, n.x/1024.0 - n.y/512.0 + 1.0/1024 - u_top), 0.0)*1000, 6) AS depth_mm
FROM nodes n LEFT JOIN top t ON t.mesh_id=n.mesh_id AND t.i=n.i AND t.j=n.j""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    cells = Gr.depth_cells(points_of(mesh, frame), frame, level_plane(frame), GRID)
    return Gr.dense_grid(cells, frame, GRID).select("mesh_id", "i", "j", r("y"), r("x"), r("depth_mm", 6))


@query("legacy_grid", cte(*LEG) + "SELECT mesh_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(depth_mm, 6) AS depth_mm FROM cell WHERE depth_mm > 0")
def _(spark, sf):
    return shipment_cells(spark, sf)[0].select("mesh_id", "i", "j", r("depth_mm", 6))


@query("legacy_volume", cte(*LEG) + f"""SELECT c.mesh_id, round(sum(depth_mm/1000.0)*min(((w_max-w_min)/{GRID-1})*((d_max-d_min)/{GRID-1}))*1e6, 6) AS volume_cm3,
round(max(depth_mm), 6) AS max_depth, round(coalesce(avg(depth_mm) FILTER (depth_mm > 0), 0), 6) AS mean_depth
FROM cell c JOIN pb ON pb.mesh_id=c.mesh_id GROUP BY c.mesh_id""")
def _(spark, sf):
    return volume_columns(Gr.legacy_volume(*shipment_cells(spark, sf), GRID), "mesh_id")


@query("lateral_profile", cte(*LEG, LATERAL) + "SELECT mesh_id, CAST(j AS INTEGER) AS j, round(x,9) AS x, round(share,9) AS share, weight FROM lat")
def _(spark, sf):
    return Gr.lateral_profile(*shipment_cells(spark, sf), GRID).select("mesh_id", "j", r("x"), r("share"), "weight")


MOMENTS = """lmean AS (SELECT mesh_id, sum(weight) AS n, sum(weight*x)/sum(weight) AS m, max(x)-min(x) AS w_nom FROM lat GROUP BY mesh_id),
lmom AS (SELECT l.mesh_id, n, w_nom, sum(weight*(x-m)**2)/n AS m2, sum(weight*(x-m)**3)/n AS m3, sum(weight*(x-m)**4)/n AS m4
  FROM lat l JOIN lmean ON lmean.mesh_id=l.mesh_id GROUP BY l.mesh_id, n, w_nom)"""


@query("profile_moments", cte(*LEG, LATERAL, MOMENTS) + """SELECT mesh_id, CAST(n AS BIGINT) AS n_samples, round(w_nom,9) AS w_nom,
round(m3/(m2*sqrt(m2)), 6) AS skewness, round(m4/(m2*m2)-3.0, 6) AS kurtosis FROM lmom""")
def _(spark, sf):
    moments = Gr.lateral_moments(Gr.lateral_profile(*shipment_cells(spark, sf), GRID))
    return moments.select("mesh_id", "n_samples", r("w_nom"), r("skewness", 6), r("kurtosis", 6))


REGION_COLS = ("nosing_wear", "center_wear", "back_wear", "nosing_wear_ratio", "skewness")


@query("longitudinal_regions", cte(*LEG, REGION) + "SELECT mesh_id, " + ", ".join(f"round({c},6) AS {c}" for c in REGION_COLS) + " FROM reg")
def _(spark, sf):
    out = Gr.longitudinal_regions(Gr.longitudinal_profile(*shipment_cells(spark, sf), GRID), GRID)
    return out.select("mesh_id", *[r(c, 6) for c in REGION_COLS])


DRIFT = """lim AS (SELECT mesh_id, count(*) AS n, quantile_cont(depth_mm, 0.6) AS t0, quantile_cont(depth_mm, 0.75) AS t1, quantile_cont(depth_mm, 0.9) AS t2
  FROM cell WHERE depth_mm > 0 GROUP BY mesh_id),
pk AS (SELECT c.mesh_id, """ + ", ".join(
    f"CASE WHEN count(*) FILTER (depth_mm >= t{k}) >= 5 THEN sum(x*depth_mm) FILTER (depth_mm >= t{k})/sum(depth_mm) FILTER (depth_mm >= t{k}) END AS peak_{k}"
    for k in range(3)) + """ FROM cell c JOIN lim ON lim.mesh_id=c.mesh_id WHERE n >= 10 AND depth_mm > 0 GROUP BY c.mesh_id),
wid AS (SELECT mesh_id, max(x)-min(x) AS w_nom FROM lat GROUP BY mesh_id),
dr AS (SELECT w.mesh_id, w_nom, peak_0, peak_1, peak_2, CASE WHEN (peak_0 IS NOT NULL)::INT+(peak_1 IS NOT NULL)::INT+(peak_2 IS NOT NULL)::INT >= 2 THEN
  CASE WHEN w_nom-0.4 > 0 THEN (greatest(peak_0,peak_1,peak_2)-least(peak_0,peak_1,peak_2))/(w_nom-0.4) ELSE 0.0 END END AS shift_ratio
  FROM wid w LEFT JOIN pk ON pk.mesh_id=w.mesh_id)"""


@query("temporal_drift", cte(*LEG, LATERAL, DRIFT) + """SELECT mesh_id, round(peak_0,9) AS peak_0, round(peak_1,9) AS peak_1, round(peak_2,9) AS peak_2,
round(shift_ratio,9) AS shift_ratio, coalesce(shift_ratio > 0.15, false) AS drift FROM dr""")
def _(spark, sf):
    cells, ext = shipment_cells(spark, sf)
    widths = Gr.lateral_moments(Gr.lateral_profile(cells, ext, GRID))
    out = Gr.temporal_drift(cells, widths, g=GRID)
    return out.select("mesh_id", *[r(c) for c in ("peak_0", "peak_1", "peak_2", "shift_ratio")], "drift")


@query("gmm_bic")
def _(spark, sf):
    return lateral_mixture(materialize(Gr.lateral_profile(*shipment_cells(spark, sf), GRID), "lateral"))


# --- traffic ---------------------------------------------------------------------

def material_volumes(spark, sf) -> DataFrame:
    """Wear volume per part and material: shipped quantity in mm3, deepest discount in mm."""
    parts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        (F.sum("l_quantity") * 1e-9).alias("volume"), (F.max("l_discount") * 2500.0).alias("max_depth")
    )
    names = F.array(*[F.lit(m[0]) for m in K.MATERIALS])
    return with_material(parts.select(F.col("l_partkey").alias("part"), "volume", "max_depth", F.explode(names).alias("material")))


MAT_VOLUME = """mv AS (SELECT l_partkey AS part, material, name, k_spec_value*1e-9 AS k, sum(l_quantity)*1e-9 AS volume, max(l_discount)*2500.0 AS max_depth
  FROM lineitem, mat GROUP BY l_partkey, material, name, k_spec_value),
tv AS (SELECT *, volume/(k*(700.0*1.7)*0.002) AS total_steps FROM mv),
ts AS (SELECT *, total_steps/(500*365.0) AS daily_500y, CASE WHEN total_steps > 0 THEN volume/total_steps ELSE 0 END AS step_volume FROM tv)"""


@query("archard_traffic", cte(MATERIAL, MAT_VOLUME) + """SELECT part, material, name, round(volume*1e9, 6) AS volume_mm3, round(total_steps, 3) AS total_steps,
round(step_volume*1e18, 6) AS step_attolitre FROM ts""")
def _(spark, sf):
    out = T.traffic_volume(material_volumes(spark, sf))
    return out.select(
        "part", "material", "name", r(F.col("volume") * 1e9, 6, "volume_mm3"), r("total_steps", 3),
        r(F.col("per_step_wear_volume") * 1e18, 6, "step_attolitre"),
    )


@query("age_horizons", cte(MATERIAL, MAT_VOLUME) + f"""SELECT part, material, CAST(years AS INTEGER) AS years, round(total_steps/(years*365.0), 6) AS daily
FROM ts, (VALUES {', '.join(f'({y})' for y in K.HORIZONS_YEARS)}) h(years)""")
def _(spark, sf):
    rows = T.traffic_volume(material_volumes(spark, sf))
    return T.horizon_rows(rows, ["part", "material"]).withColumn("daily", r("daily", 6))


@query("traffic_warnings", cte(MATERIAL, MAT_VOLUME) + """SELECT part, material, concat_ws(' / ',
CASE WHEN max_depth > 200 THEN 'Max wear depth > 200mm: likely axis/scale/segmentation issue' END,
CASE WHEN daily_500y > 50000 THEN 'Extremely high traffic (' || printf('%.0f', daily_500y) || ' footsteps/day): check k_spec and scale' END,
CASE WHEN daily_500y < 0.1 AND total_steps > 0 THEN 'Extremely low traffic (' || printf('%.3f', daily_500y) || ' footsteps/day): likely k_spec units mismatch or wear volume under-estimated' END
) AS warnings FROM ts""")
def _(spark, sf):
    rows = T.traffic_volume(material_volumes(spark, sf))
    return rows.select("part", "material", F.array_join("warnings", " / ").alias("warnings"))


@query("unit_mixup_warnings", """WITH v AS (SELECT l_partkey AS part, sum(l_quantity)*1e-9 AS volume FROM lineitem GROUP BY l_partkey),
t AS (SELECT part, volume, volume/(1e-6*(700.0*1.7)*0.002) AS n FROM v)
SELECT part, round(n, 9) AS total_steps, 'Per-step wear volume ' || printf('%.2e', volume/n) || ' m³ is implausibly high for stone - check k_spec units (expected mm3_per_Nm but got m2_per_N?)' AS step_warning FROM t""")
def _(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg((F.sum("l_quantity") * 1e-9).alias("volume"))
    rows = parts.withColumns({"max_depth": F.lit(1.0), "k_spec_value": F.lit(1e-6), "k_spec_units": F.lit("m2_per_N")})
    out = T.traffic_volume(rows)
    step = F.filter("warnings", lambda w: w.startswith("Per-step"))
    return out.select("part", r("total_steps"), step[0].alias("step_warning"))


@query("material_priors", cte(MATERIAL, "pr AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {k!r}::DOUBLE, {s!r}::DOUBLE)" for m, k, s in K.MATERIAL_PRIORS) + ") t(prior_name, k_spec_median, log_std))") + """
SELECT p_partkey AS part, material, prior_name, k_spec_median*1e6 AS k_micro, log_std FROM part, mat
JOIN pr ON prior_name = CASE WHEN material = 'oak' THEN 'wood' ELSE material END
WHERE material = ['granite','marble','sandstone','limestone','oak'][(p_partkey % 5) + 1]""")
def _(spark, sf):
    names = F.array(*[F.lit(m[0]) for m in K.MATERIALS])
    part = F.col("p_partkey")
    rows = table(spark, sf, "part").select(part.alias("part"), F.element_at(names, (F.pmod(part, F.lit(5)) + 1).cast("int")).alias("material"))
    return with_material_prior(rows).select("part", "material", "prior_name", (F.col("k_spec_median") * 1e6).alias("k_micro"), "log_std")


CASES = [
    ("nosing_wear_ratio > 1.3", K.DESCENT, "least(95.0, 50 + (nosing_wear_ratio-1.0)*50)"),
    ("nosing_wear_ratio < 0.7", K.ASCENT, "least(95.0, 50 + (1.0-nosing_wear_ratio)*50)"),
    ("skewness > 0.5", K.DESCENT_MODERATE, "60 + skewness*20"),
    ("skewness < -0.5", K.ASCENT_MODERATE, "60 + abs(skewness)*20"),
    ("true", K.BALANCED, "70.0"),
]
DIRECTION = "dir AS (SELECT *, " + ", ".join(
    "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" END AS {name}" for name, pairs in (
        ("dominant_direction", [(t, f"'{d[0]}'") for t, d, _ in CASES]),
        ("explanation", [(t, f"'{d[1]}'") for t, d, _ in CASES]),
        ("confidence", [(t, c) for t, _, c in CASES]),
        ("ascent_descent_ratio", [("nosing_wear_ratio > 1.0", "1.0/nosing_wear_ratio"), ("true", "1.0/(nosing_wear_ratio+0.1)")]),
    )) + " FROM reg)"


@query("directionality", cte(*LEG, REGION, DIRECTION) + """SELECT mesh_id, dominant_direction, round(confidence,6) AS confidence,
round(ascent_descent_ratio,6) AS ascent_descent_ratio, explanation FROM dir""")
def _(spark, sf):
    regions = Gr.longitudinal_regions(Gr.longitudinal_profile(*shipment_cells(spark, sf), GRID), GRID)
    return T.directionality(regions).select(
        "mesh_id", "dominant_direction", r("confidence", 6), r("ascent_descent_ratio", 6), "explanation"
    )


# Lane inputs per order: quantities give the component means, line count the modes.
LANES = """ln AS (SELECT l_orderkey AS mesh_id, count(*) % 4 AS n_modes, max(l_tax)*100-3 AS kurtosis, min(l_quantity)/25.0 AS m0, max(l_quantity)/25.0 AS m1,
  sum(l_quantity)/40.0 AS w_nom, max(l_discount) > 0.095 AS drift FROM lineitem GROUP BY l_orderkey),
le AS (SELECT *, w_nom-0.4 AS w_eff, CASE WHEN w_nom-0.4 > 0 THEN CAST(floor((w_nom-0.4)/0.55) AS INTEGER) ELSE 0 END AS fits FROM ln),
ls AS (SELECT *, CASE WHEN n_modes=2 THEN abs(m1-m0) END AS sep, CASE WHEN n_modes=2 THEN CASE WHEN w_eff > 0 THEN abs(m1-m0)/w_eff ELSE 0.0 END END AS ratio FROM le),
lp AS (SELECT *, printf('%.2f', w_eff) AS wide, CASE WHEN fits < 2 THEN 'SINGLE FILE' WHEN n_modes=0 THEN 'INSUFFICIENT DATA' WHEN n_modes=1 THEN 'SINGLE FILE'
  WHEN n_modes=2 AND ratio BETWEEN 0.45 AND 0.75 THEN 'TWO LANES POSSIBLE' WHEN n_modes=2 AND ratio < 0.35 THEN 'SINGLE FILE (alternating feet)'
  WHEN n_modes=2 THEN 'UNCERTAIN (two modes)' WHEN fits < n_modes THEN 'SINGLE FILE (complex)' ELSE 'COMPLEX MULTI-LANE' END AS pattern FROM ls),
lo AS (SELECT *, CASE WHEN fits < 2 THEN 1 WHEN n_modes=0 THEN 0 WHEN n_modes=1 THEN 1 WHEN pattern IN ('TWO LANES POSSIBLE','UNCERTAIN (two modes)') THEN 2
  WHEN pattern LIKE 'SINGLE%' THEN 1 ELSE least(n_modes, fits) END AS n_lanes,
  CASE WHEN fits=0 THEN 'Effective width ' || wide || 'm < 0.55m: physically constrained to single file (cannot fit standard lane width)'
  WHEN fits<2 THEN 'Effective width ' || wide || 'm < 1.10m: only single lane fits, single-file traffic' WHEN n_modes=0 THEN 'No wear pattern detected'
  WHEN n_modes=1 AND kurtosis>3 THEN 'Unimodal peaked distribution (kurtosis=' || printf('%.2f', kurtosis) || '): single-file traffic'
  WHEN n_modes=1 THEN 'Unimodal dispersed distribution (kurtosis=' || printf('%.2f', kurtosis) || '): low-density single-file'
  WHEN pattern='TWO LANES POSSIBLE' THEN 'Two peaks separated by ' || printf('%.2f', sep) || 'm (sep_ratio=' || printf('%.2f', ratio) || '): consistent with bi-directional lanes'
  WHEN pattern LIKE '%feet)' THEN 'Two close peaks (sep=' || printf('%.2f', sep) || 'm, ratio=' || printf('%.2f', ratio) || '): likely alternating foot placement'
  WHEN n_modes=2 THEN 'Two peaks with intermediate separation (sep_ratio=' || printf('%.2f', ratio) || '): ambiguous pattern'
  WHEN fits<n_modes THEN 'GMM detected ' || n_modes || ' modes but W_eff=' || wide || 'm only allows ' || fits || ' two-abreast lanes: likely temporal drift or artifacts'
  ELSE n_modes || ' modes detected within physical constraints (M_max_two_abreast=' || fits || ')' END
  || CASE WHEN drift THEN ' | TEMPORAL DRIFT DETECTED: peaks may represent different usage periods' ELSE '' END AS rationale FROM lp)"""


@query("simultaneity", cte(LANES) + """SELECT mesh_id, pattern, CAST(n_lanes AS INTEGER) AS n_lanes, round(w_eff,6) AS w_eff, fits AS m_max_two_abreast, round(sep,6) AS separation,
round(ratio,6) AS sep_ratio, rationale, CASE WHEN pattern='SINGLE FILE' AND fits=0 THEN 'Single-file traffic (W_eff=' || wide || 'm cannot fit standard lane, single file always possible)'
WHEN pattern='SINGLE FILE' THEN 'Single-file traffic (W_eff=' || wide || 'm allows max ' || fits || ' two-abreast lanes)'
WHEN pattern LIKE '%feet)' THEN 'Single-file with alternating foot placement pattern'
WHEN pattern LIKE '%complex)' THEN 'Single-file traffic with temporal variation (constrained by W_eff=' || wide || 'm)'
WHEN pattern LIKE 'TWO%' THEN 'Two distinct lanes detected (bi-directional or paired traffic)'
WHEN pattern LIKE 'COMPLEX%' THEN 'Multiple lanes detected (' || n_lanes || ' lanes within ' || fits || ' max two-abreast)'
WHEN pattern LIKE 'UNCERTAIN%' THEN 'Two modes detected but separation is ambiguous' ELSE 'Pattern: ' || pattern END AS description FROM lo""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("mesh_id")).agg(
        F.pmod(F.count(F.lit(1)), F.lit(4)).cast("int").alias("n_modes"), (F.max("l_tax") * 100 - 3).alias("kurtosis"),
        F.array(F.min("l_quantity") / 25.0, F.max("l_quantity") / 25.0).alias("means"),
        (F.sum("l_quantity") / 40.0).alias("w_nom"), (F.max("l_discount") > 0.095).alias("drift"),
    )
    return T.simultaneity(lines).select(
        "mesh_id", "pattern", "n_lanes", r("w_eff", 6), "m_max_two_abreast", r("separation", 6), r("sep_ratio", 6), "rationale", "description"
    )


# --- quality ---------------------------------------------------------------------

@query("unit_detector", """WITH o AS (SELECT o_orderkey, o_totalprice/500.0 AS w, CASE WHEN o_orderstatus = 'F' THEN 0.25 ELSE 1.0 END AS s FROM orders)
SELECT o_orderkey, CASE WHEN s <> 1 THEN 'scaled' WHEN w BETWEEN 500 AND 1500 THEN 'mm' WHEN w BETWEEN 50 AND 150 THEN 'cm' WHEN w BETWEEN 0.4 AND 5 THEN 'm' ELSE 'unknown' END AS likely_units,
CASE WHEN s <> 1 THEN s WHEN w BETWEEN 500 AND 1500 THEN 0.001 WHEN w BETWEEN 50 AND 150 THEN 0.01 WHEN w BETWEEN 0.4 AND 5 THEN 1.0 END AS suggested_scale,
CASE WHEN s <> 1 THEN 'user_specified' WHEN w BETWEEN 500 AND 1500 OR w BETWEEN 0.4 AND 5 THEN 'high' WHEN w BETWEEN 50 AND 150 THEN 'medium' ELSE 'low' END AS unit_confidence,
CASE WHEN s <> 1 THEN 'User specified scale=0.25' WHEN w BETWEEN 500 AND 1500 THEN 'Width ' || printf('%.1f', w) || ' units suggests millimeters'
WHEN w BETWEEN 50 AND 150 THEN 'Width ' || printf('%.1f', w) || ' units suggests centimeters' WHEN w BETWEEN 0.4 AND 5 THEN 'Width ' || printf('%.2f', w) || ' units suggests meters'
ELSE 'Width ' || printf('%.2f', w) || ' units outside typical range' END AS unit_reasoning FROM o""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500.0).alias("width_raw"),
        F.when(F.col("o_orderstatus") == "F", 0.25).otherwise(1.0).alias("scale"),
    )
    return T.likely_units(rows).drop("width_raw", "scale")


@query("scale_prior", """WITH o AS (SELECT o_orderkey, o_totalprice/500.0 AS w, CASE WHEN o_orderstatus = 'F' THEN 0.001 END AS s FROM orders)
SELECT o_orderkey, s IS NOT NULL AS user_provided, label, scale, prob FROM o, LATERAL (SELECT unnest(['mm','cm','m']) AS label, unnest([0.001,0.01,1.0]) AS scale,
unnest(CASE WHEN s IS NOT NULL THEN [0.4,0.3,0.3] WHEN w > 100 THEN [0.7,0.2,0.1] WHEN w > 1 THEN [0.1,0.5,0.4] ELSE [0.1,0.2,0.7] END) AS prob)""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500.0).alias("width_raw"), F.when(F.col("o_orderstatus") == "F", 0.001).alias("user_scale")
    )
    out = U.scale_prior(rows).select("o_orderkey", "user_provided", F.inline("hypotheses"))
    return out.select("o_orderkey", "user_provided", "label", "scale", "prob")


@query("hypothesis_labels", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'mm,cm,m' END AS labels FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500.0).alias("width_raw"), F.when(F.col("o_orderstatus") == "F", 0.001).alias("user_scale")
    )
    return U.scale_prior(rows).select("o_orderkey", F.array_join(U.hypothesis_labels(), ",").alias("labels"))


@query("calibration_limited", cte(MATERIAL, MAT_VOLUME, """cl AS (SELECT *, volume*1e8 AS width, max_depth/250.0 AS inl FROM ts)""") + """
SELECT part, material, concat_ws(' / ', CASE WHEN daily_500y > 50000 THEN 'Extremely high traffic (' || printf('%.0f', daily_500y) || ' footsteps/day at 500y)' END,
CASE WHEN width < 0.4 OR width > 5.0 THEN 'Implausible surface width (' || printf('%.2f', width) || 'm) with scale=1.0 - likely unit mismatch' END,
CASE WHEN inl < 0.5 THEN 'Weak reference plane fit (' || printf('%.1f', inl*100) || '% inliers) - results less reliable' END,
CASE WHEN daily_500y < 0.1 AND total_steps > 0 THEN 'Extremely low traffic (' || printf('%.3f', daily_500y) || ' footsteps/day) - likely calibration issue' END) AS reasons,
daily_500y > 50000 OR width < 0.4 OR width > 5.0 OR inl < 0.5 OR (daily_500y < 0.1 AND total_steps > 0) AS is_limited,
daily_500y > 50000 OR daily_500y < 0.1 OR max_depth > 200 AS banner FROM cl""")
def _(spark, sf):
    rows = T.traffic_volume(material_volumes(spark, sf)).withColumns({
        "scale": F.lit(1.0), "width_m": F.col("volume") * 1e8, "inlier_fraction": F.col("max_depth") / 250.0
    })
    out = T.calibration_limits(rows).withColumn("banner", T.calibration_banner())
    return out.select("part", "material", F.array_join("reasons", " / ").alias("reasons"), "is_limited", "banner")


@query("quality_flags", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity/50.0 < 0.5 AS weak_plane, l_discount*10 > 0.55 AS high_exclusion, l_extendedprice/250.0 > 200 AS implausible_depth,
l_quantity/50.0 < 0.6 OR l_tax*100 > 5.5 AS weak_fit FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity") / 50.0).alias("inlier_fraction"),
        (F.col("l_discount") * 10).alias("high"), (F.col("l_extendedprice") / 250.0).alias("max_depth"), (F.col("l_tax") * 100 - 0.5).alias("rms"),
    )
    out = T.quality_flags(rows.withColumn("excluded_fraction", F.col("high") - 0.05))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "weak_plane", "high_exclusion", "implausible_depth",
        P.weak_fit(F.col("inlier_fraction"), F.col("rms")).alias("weak_fit"),
    )


# --- uncertainty -----------------------------------------------------------------

DIST_SQL = """d AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, quantile_cont(value, 0.25) AS lo50,
  quantile_cont(value, 0.75) AS hi50, quantile_cont(value, 0.025) AS lo95, quantile_cont(value, 0.975) AS hi95 FROM events GROUP BY event_type)"""
DIST_COLS = ("mean", "median", "std", "lo50", "hi50", "lo95", "hi95")


@query("distribution_summary", cte(DIST_SQL) + "SELECT event_type, n, " + ", ".join(f"round({c},6) AS {c}" for c in DIST_COLS) + " FROM d")
def _(spark, sf):
    d = U.exact_distribution(event_samples(spark, sf), "value", ["event_type"])
    parts = ("mean", "median", "std", "ci_50.lo", "ci_50.hi", "ci_95.lo", "ci_95.hi")
    return d.select("event_type", "n", *[r(F.col(f"dist.{p}"), 6, c) for p, c in zip(parts, DIST_COLS)])


@query("distribution_text", cte(DIST_SQL) + """SELECT event_type, printf('%.2f [%.2f - %.2f]', median, lo95, hi95) AS with_ci,
printf('%.2e [%.2e - %.2e]', median, lo95, hi95) AS scientific, printf('%.2f [%.2f-%.2f]', median, lo50, hi50) AS compact FROM d""")
def _(spark, sf):
    d = U.exact_distribution(event_samples(spark, sf), "value", ["event_type"])
    return d.select(
        "event_type", U.format_with_ci("dist").alias("with_ci"), U.format_with_ci("dist", 2, True).alias("scientific"),
        U.format_compact("dist").alias("compact"),
    )


def shipment_samples(spark, sf) -> DataFrame:
    """Line items as Monte Carlo samples per return flag."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("mesh_id"), (c("l_extendedprice") / c("l_quantity")).alias("traffic"), (c("l_quantity") * 1e-6).alias("k_spec"),
        ((c("l_discount") + 1) / 1000.0).alias("scale"), (c("l_tax") + 1.5).alias("grf"), (F.pmod("l_partkey", F.lit(97)) / 1000.0).alias("slip"),
        (c("l_extendedprice") * 1e-6).alias("volume"), (c("l_extendedprice") / 50000.0).alias("nosing_ratio"), c("l_linestatus").alias("hypothesis"),
    )


SAMPLES = """sm AS (SELECT l_returnflag AS mesh_id, l_extendedprice/l_quantity AS traffic, l_quantity*1e-6 AS k_spec, (l_discount+1)/1000.0 AS scale, l_tax+1.5 AS grf,
  (l_partkey % 97)/1000.0 AS slip, l_extendedprice*1e-6 AS volume, l_extendedprice/50000.0 AS nosing_ratio, l_linestatus AS hypothesis FROM lineitem)"""
SOURCE_COLS = U.SOURCE_COLS
RANKS = "rk AS (SELECT mesh_id, " + ", ".join(
    f"rank() OVER (PARTITION BY mesh_id ORDER BY {c}) + (count(*) OVER (PARTITION BY mesh_id, {c})-1)/2.0 AS {c}"
    for c in ("traffic", *SOURCE_COLS.values())) + " FROM sm)"
RHO = "rho AS (SELECT mesh_id, " + ", ".join(f"corr({c}, traffic)**2 AS {s}" for s, c in SOURCE_COLS.items()) + " FROM rk GROUP BY mesh_id)"


def correlations(spark, sf) -> DataFrame:
    return U.correlations(shipment_samples(spark, sf))


@query("spearman_squared", cte(SAMPLES, RANKS, RHO) + "SELECT mesh_id, " + ", ".join(f"round({s},6) AS {s}" for s in SOURCE_COLS) + " FROM rho")
def _(spark, sf):
    return correlations(spark, sf).select("mesh_id", *[r(s, 6) for s in SOURCE_COLS])


SHARES = "pl AS (SELECT mesh_id, k_spec, scale, greatest(0.02, plane*0.3) AS plane, grf, slip FROM rho)"
SHARE_LIST = "[k_spec, scale, plane, grf, slip]"


@query("sensitivity_shares", cte(SAMPLES, RANKS, RHO, SHARES) + "SELECT mesh_id, " + ", ".join(
    f"round({s}/(k_spec+scale+plane+grf+slip),6) AS {s}" for s in K.SENSITIVITY_SOURCES
) + f", ['k_spec','scale','plane','grf','slip'][list_position({SHARE_LIST}, list_max({SHARE_LIST}))] AS dominant FROM pl")
def _(spark, sf):
    shares = U.normalize_shares(correlations(spark, sf))
    return shares.select("mesh_id", *[r(s, 6) for s in K.SENSITIVITY_SOURCES], U.dominant_source().alias("dominant"))


@query("sensitivity_tornado", cte(SAMPLES, RANKS, RHO, SHARES, """br AS (SELECT mesh_id, k_spec+scale+plane+grf+slip AS t,
  unnest(['k_spec','scale','plane','grf','slip']) AS source, unnest([k_spec, scale, plane, grf, slip]) AS v FROM pl)""") + """
SELECT mesh_id, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY v DESC) AS INTEGER) AS place, source, round(v/t, 6) AS share, printf('%.0f', 100*v/t) || '%' AS label,
v = max(v) OVER (PARTITION BY mesh_id) AS is_dominant FROM br""")
def _(spark, sf):
    shares = U.normalize_shares(correlations(spark, sf))
    return charts.tornado(U.share_map(shares)).withColumn("share", r("share", 6))


@query("hypothesis_frequency", cte(SAMPLES) + """SELECT mesh_id, hypothesis, round(count(*)/sum(count(*)) OVER (PARTITION BY mesh_id), 9) AS share FROM sm GROUP BY mesh_id, hypothesis""")
def _(spark, sf):
    return U.hypothesis_shares(shipment_samples(spark, sf)).withColumn("share", r("share"))


@query("scale_ambiguity", cte(SAMPLES, "hy AS (SELECT mesh_id, hypothesis, count(*)/sum(count(*)) OVER (PARTITION BY mesh_id) AS p FROM sm GROUP BY mesh_id, hypothesis)",
       "lk AS (SELECT mesh_id, count(*) FILTER (p > 0.1) AS likely FROM hy GROUP BY mesh_id)") + """
SELECT s.mesh_id, round(stddev_pop(scale*800.0)/avg(scale*800.0), 6) AS cv, any_value(likely) AS likely, stddev_pop(scale*800.0)/avg(scale*800.0) > 0.5 OR any_value(likely) > 1 AS scale_ambiguous
FROM sm s JOIN lk ON lk.mesh_id=s.mesh_id GROUP BY s.mesh_id""")
def _(spark, sf):
    rows = shipment_samples(spark, sf)
    likely = U.hypothesis_shares(rows).groupBy("mesh_id").agg(F.count_if(F.col("share") > 0.1).alias("likely"))
    width = F.col("scale") * 800.0
    stats = rows.groupBy("mesh_id").agg(F.avg(width).alias("m"), F.stddev_pop(width).alias("s")).join(likely, "mesh_id")
    return stats.select("mesh_id", r(F.col("s") / F.col("m"), 6, "cv"), "likely", U.scale_ambiguous(F.col("m"), F.col("s"), F.col("likely")).alias("scale_ambiguous"))


@query("axis_ambiguity", cte(SAMPLES) + """SELECT mesh_id, round(quantile_cont(nosing_ratio, 0.5), 9) AS median_ratio, round(quantile_cont(1/(nosing_ratio+1e-10), 0.5), 9) AS median_flipped,
(quantile_cont(nosing_ratio, 0.5) < 0.85) <> (quantile_cont(1/(nosing_ratio+1e-10), 0.5) < 0.85) AS axis_ambiguous FROM sm GROUP BY mesh_id""")
def _(spark, sf):
    rows = shipment_samples(spark, sf).withColumn("flipped", 1 / (F.col("nosing_ratio") + 1e-10))
    a = exact_quantiles(rows, "nosing_ratio", [0.5]).select("mesh_id", F.col("q")[0].alias("a"))
    b = exact_quantiles(rows, "flipped", [0.5]).select("mesh_id", F.col("q")[0].alias("b"))
    return a.join(b, "mesh_id").select("mesh_id", r("a", 9).alias("median_ratio"), r("b", 9).alias("median_flipped"), U.axis_ambiguous(F.col("a"), F.col("b")).alias("axis_ambiguous"))


PROB = "pa AS (SELECT event_type, 1/(1+exp(5.0*(value/100.0-1.0))) AS p FROM events)"
CI = """ci AS (SELECT event_type, quantile_cont(p, 0.5) AS m, quantile_cont(p, 0.025) AS lo, quantile_cont(p, 0.975) AS hi FROM pa GROUP BY event_type)"""


def ascent_distribution(spark, sf) -> DataFrame:
    rows = event_samples(spark, sf).withColumn("p", U.prob_ascent(F.col("value") / 100.0, F.lit(1.0), F.lit(5.0)))
    return U.exact_distribution(rows, "p", ["event_type"])


@query("prob_ascent", cte(PROB) + "SELECT event_type, round(avg(p), 9) AS mean, round(min(p), 9) AS low, round(max(p), 9) AS high FROM pa GROUP BY event_type")
def _(spark, sf):
    p = U.prob_ascent(F.col("value") / 100.0, F.lit(1.0), F.lit(5.0))
    return event_samples(spark, sf).groupBy("event_type").agg(r(F.avg(p), 9, "mean"), r(F.min(p), 9, "low"), r(F.max(p), 9, "high"))


@query("direction_ci", cte(PROB, CI) + """SELECT event_type, CASE WHEN lo > 0.5 THEN 'ASCENT' WHEN hi < 0.5 THEN 'DESCENT' ELSE 'AMBIGUOUS' END AS kind,
CASE WHEN lo > 0.5 THEN printf('ASCENT (%.0f%% [%.0f-%.0f%%])', m*100, lo*100, hi*100) WHEN hi < 0.5 THEN printf('DESCENT (%.0f%% [%.0f-%.0f%%])', (1-m)*100, (1-hi)*100, (1-lo)*100)
ELSE printf('AMBIGUOUS (P_ascent=%.0f%% [%.0f-%.0f%%])', m*100, lo*100, hi*100) END AS label FROM ci""")
def _(spark, sf):
    d = ascent_distribution(spark, sf)
    m, lo, hi = F.col("dist.median"), F.col("dist.ci_95.lo"), F.col("dist.ci_95.hi")
    return d.select("event_type", U.direction_class(lo, hi).alias("kind"), U.direction_label(m, lo, hi).alias("label"))


@query("direction_panel", cte(PROB, CI) + """SELECT event_type AS mesh_id, CASE WHEN lo > 0.5 THEN '↑ ASCENT' WHEN hi < 0.5 THEN '↓ DESCENT' ELSE '↔ AMBIGUOUS' END AS heading,
round(0.1+0.8*lo, 9) AS bar_lo, round(0.1+0.8*hi, 9) AS bar_hi, round(0.1+0.8*m, 9) AS bar_median, 'Note: Assumes depth axis orientation is correct' AS caveat FROM ci""")
def _(spark, sf):
    d = ascent_distribution(spark, sf).select(
        F.col("event_type").alias("mesh_id"), F.col("dist").alias("prob_ascent"), F.lit("").alias("classification"), F.lit(False).alias("axis_ambiguous")
    )
    return charts.direction_panel(d).select("mesh_id", "heading", r("bar_lo"), r("bar_hi"), r("bar_median"), "caveat")


@query("traffic_intervals", cte(DIST_SQL) + "SELECT event_type AS mesh_id, horizon, " + ", ".join(
    f"round({c}/(y*365.0)*1e6, 6) AS {n}" for c, n in (("median", "median"), ("lo50", "ci50_lo"), ("hi50", "ci50_hi"), ("lo95", "ci95_lo"), ("hi95", "ci95_hi"))
) + ", (hi95/(50*365.0))/(lo95/(1000*365.0)+1e-20) > 100 AS log_scale FROM d, (VALUES " + ", ".join(f"('{y}y', {y})" for y in K.HORIZONS_YEARS) + ") h(horizon, y)")
def _(spark, sf):
    d = U.exact_distribution(event_samples(spark, sf), "value", ["event_type"]).withColumnRenamed("event_type", "mesh_id")
    out = charts.traffic_intervals(d.select("mesh_id", *[
        U.scaled_distribution("dist", float(y * K.DAYS_PER_YEAR)).alias(f"daily_{y}y") for y in K.HORIZONS_YEARS
    ]))
    return out.select("mesh_id", "horizon", *[r(F.col(c) * 1e6, 6, c) for c in ("median", "ci50_lo", "ci50_hi", "ci95_lo", "ci95_hi")], "log_scale")


def fixed_planes(frame: KeyTable) -> DataFrame:
    """Many neighbouring planes per mesh by a rule of the plane number."""
    pid = F.col("pid")
    rows = frame.df.select("mesh_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLANES - 1).cast("long"))).alias("pid"))
    return rows.select(
        "mesh_id", "pid", (F.lit(1 / 1024) + (F.pmod(pid, F.lit(17)) - 8) / 65536.0).alias("a"),
        (F.lit(-1 / 512) + (F.pmod(pid, F.lit(23)) - 11) / 65536.0).alias("b"),
        (F.lit(1 / 1024) + (pid - 250) / 4194304.0).alias("c"), F.lit(1.0).alias("s"),
    )


FIXED_PLANES = f"""fp AS (SELECT CAST(k AS BIGINT) AS pid, 1/1024.0 + ((k % 17)-8)/65536.0 AS a, -1/512.0 + ((k % 23)-11)/65536.0 AS b, 1/1024.0 + (k-250)/4194304.0 AS c FROM range(0,{PLANES}) r(k))"""


@query("mc_volume", cte(*TREAD_CTE, FIXED_PLANES, "tri AS (SELECT t.*, fp.* FROM tread t, fp WHERE is_tread)", VOLUME) + f"SELECT mesh_id, pid, {VOLUME_OUT} FROM dep GROUP BY mesh_id, pid")
def _(spark, sf):
    _, frame, tread = tread_of(spark, sf)
    tread = materialize(tread.where("is_tread"), "tread")
    return volume_columns(clamped.volume_by_plane(tread, fixed_planes(frame), frame), "mesh_id", "pid")


@query("mc_nosing", cte(SV, BOX, FIXED_PLANES, "fs AS (SELECT *, 0.75 + pid/2048.0 AS s FROM fp)", """
fd AS (SELECT v.mesh_id, pid, CASE WHEN y < y_min+0.25*(y_max-y_min) THEN 0 WHEN y <= y_max-0.25*(y_max-y_min) THEN 1 END AS zone, greatest(0.0, a*s*x+b*s*y+c-s*z) AS dep
  FROM sv v JOIN box b ON b.mesh_id=v.mesh_id, fs)""") + """SELECT mesh_id, pid, round(avg(dep) FILTER (zone=0)*1000, 6) AS front_mm, round(avg(dep) FILTER (zone=1)*1000, 6) AS centre_mm,
round((avg(dep) FILTER (zone=0))/(avg(dep) FILTER (zone=1)), 6) AS nosing_ratio FROM fd GROUP BY mesh_id, pid""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    frame = plain_frame(mesh)
    s = F.lit(0.75) + F.col("pid") / 2048.0
    settings = fixed_planes(frame).withColumns({"s": s, "a": F.col("a") * s, "b": F.col("b") * s})
    out = clamped.nosing_by_plane(points_of(mesh, frame), settings, frame)
    return out.select(
        "mesh_id", "pid", r(F.col("front") * 1000, 6, "front_mm"), r(F.col("centre") * 1000, 6, "centre_mm"),
        r(U.nosing_ratio(F.col("front"), F.col("centre")), 6, "nosing_ratio"),
    )


@query("mc_propagation")
def _(spark, sf):
    return PL.propagate(PL.load(surfaces(spark, sf)), K.MC_SAMPLES, K.MC_SEED)


@query("mc_samples")
def _(spark, sf):
    return PL.propagate(PL.load(surfaces(spark, sf)), K.MC_SAMPLES, K.MC_SEED, samples_only=True)


# --- whole analyses and documents ------------------------------------------------

@query("wear_analysis")
def _(spark, sf):
    return PL.analyze(surfaces(spark, sf))[2]


@query("wear_report")
def _(spark, sf):
    return report.report(PL.analyze(surfaces(spark, sf))[2])


@query("uncertainty_document")
def _(spark, sf):
    return report.uncertainty_document(PL.propagate(PL.load(surfaces(spark, sf)), K.MC_SAMPLES, K.MC_SEED))


@query("lateral_curves")
def _(spark, sf):
    profile = materialize(Gr.lateral_profile(*shipment_cells(spark, sf), GRID), "lateral")
    return charts.lateral_curves(profile, lateral_mixture(profile))


LEGACY_RESULT = f"""lv AS (SELECT c.mesh_id, sum(depth_mm/1000.0)*min(((w_max-w_min)/{GRID-1})*((d_max-d_min)/{GRID-1})) AS volume, max(depth_mm) AS max_depth
  FROM cell c JOIN pb ON pb.mesh_id=c.mesh_id GROUP BY c.mesh_id),
lt AS (SELECT lv.*, volume/(5e-5*1e-9*(700.0*1.7)*0.002) AS n, dominant_direction, confidence, nosing_wear_ratio FROM lv JOIN dir ON dir.mesh_id=lv.mesh_id)"""


def legacy_results(spark, sf) -> DataFrame:
    """Sandstone verdicts of the level-reference method for every supplier cloud."""
    cells, ext = shipment_cells(spark, sf)
    regions = Gr.longitudinal_regions(Gr.longitudinal_profile(cells, ext, GRID), GRID)
    rows = Gr.legacy_volume(cells, ext, GRID).join(regions, "mesh_id").withColumn("material", F.lit("sandstone"))
    return T.directionality(T.traffic_volume(with_material(rows)))


@query("direction_report", cte(*LEG, REGION, DIRECTION, LEGACY_RESULT) + """SELECT mesh_id, 'Material: Sandstone' || chr(10) || 'Traffic: ' || printf('%.2e', n) || ' steps' || chr(10) ||
'Direction: ' || dominant_direction || chr(10) || 'Confidence: ' || printf('%.1f', confidence) || '%' AS text FROM lt""")
def _(spark, sf):
    from footfall.functions.text import fill, fixed, sci
    return legacy_results(spark, sf).select("mesh_id", F.concat_ws(
        "\n", fill("Material: {0}", F.col("name")), fill("Traffic: {0} steps", sci(F.col("total_steps"), 2)),
        fill("Direction: {0}", F.col("dominant_direction")), fill("Confidence: {0}%", fixed(F.col("confidence"), 1)),
    ).alias("text"))


@query("traffic_table", cte(*LEG, REGION, DIRECTION, LEGACY_RESULT) + "SELECT mesh_id, 'Total footsteps: ' || printf('%.2e', n) || chr(10) || " + " || chr(10) || ".join(
    f"'{(str(y) + ' years').ljust(12)}' || format('{{:,.1f}}', n/({y}*365.0)) || ' footsteps/day'" for y in K.HORIZONS_YEARS
) + " AS traffic_text, n/(500*365.0) > 50000 OR n/(500*365.0) < 0.1 OR max_depth > 200 AS is_limited FROM lt")
def _(spark, sf):
    return charts.traffic_assumptions(legacy_results(spark, sf)).select("mesh_id", "traffic_text", "is_limited")


@query("volume_text", cte(*LEG, REGION, DIRECTION, LEGACY_RESULT) + """SELECT mesh_id, printf('%.3g', volume) AS m3, printf('%.1f', volume*1000) AS litres FROM lt""")
def _(spark, sf):
    from footfall.functions.text import fixed, general
    return legacy_results(spark, sf).select("mesh_id", general(F.col("volume"), 3).alias("m3"), fixed(F.col("volume") * 1000, 1).alias("litres"))


@query("traffic_by_supplier", cte(MATERIAL, PV, """vo AS (SELECT mesh_id, sum(greatest(0.0, 0.0125-u)*w*d) AS volume FROM pv GROUP BY mesh_id)""") + """
SELECT mesh_id, material, round(volume*1e6, 6) AS volume_cm3, round(volume/(k_spec_value*1e-9*(700.0*1.7)*0.002)/(500*365.0), 3) AS daily_500y FROM vo, mat""")
def _(spark, sf):
    volume = shipment_points(spark, sf).groupBy("mesh_id").agg(
        F.sum(G.depth(F.lit(0.0125), F.col("u")) * F.col("w") * F.col("d")).alias("volume")
    )
    names = F.array(*[F.lit(m[0]) for m in K.MATERIALS])
    rows = with_material(volume.select("mesh_id", "volume", F.lit(0.0).alias("max_depth"), F.explode(names).alias("material")))
    return T.traffic_volume(rows).select("mesh_id", "material", r(F.col("volume") * 1e6, 6, "volume_cm3"), r("daily_500y", 3))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Tread wear of every surface under a fixed plane, as daily traffic per material and age."""
    _, frame, tread = tread_of(spark, sf)
    volumes = wear_volume(tread.where("is_tread"), level_plane(frame))
    names = F.array(*[F.lit(m[0]) for m in K.MATERIALS])
    rows = T.traffic_volume(with_material(volumes.select("*", F.explode(names).alias("material"))))
    return T.horizon_rows(rows, ["mesh_id", "material", "volume"]).select(
        "mesh_id", "material", "years", r(F.col("volume") * 1e6, 6, "volume_cm3"), r("daily", 2)
    )


QUERIES["tread_traffic"] = flagship
ORACLE["tread_traffic"] = cte(*TREAD_CTE, FIXED_TRI, VOLUME, MATERIAL, "tvol AS (SELECT mesh_id, sum((p0+p1+p2)/3.0*area) AS volume FROM dep GROUP BY mesh_id)") + f"""
SELECT mesh_id, material, CAST(years AS INTEGER) AS years, round(volume*1e6, 6) AS volume_cm3, round(volume/(k_spec_value*1e-9*(700.0*1.7)*0.002)/(years*365.0), 2) AS daily
FROM tvol, mat, (VALUES {', '.join(f'({y})' for y in K.HORIZONS_YEARS)}) h(years)"""
