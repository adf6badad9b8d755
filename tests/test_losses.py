"""Nothing is lost without a word, and nothing depends on how much there is."""

import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from footfall import cli
from footfall.operators import mesh as M
from footfall.operators.keyed import with_ordinals
from footfall.operators.mesh import Mesh
from footfall.operators.quantiles import exact_quantiles
from footfall.sources.obj import read_obj

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SQUARE = "v 0 0 0\nv 1 0 0\nv 1 0.3 0.01\nv 0 0.3 0\nf 1 2 3\nf 1 3 4\n"


@pytest.fixture
def square(spark):
    vertices = spark.createDataFrame([("m", k, float(k % 2), float(k // 2), 0.0) for k in range(4)], "mesh_id string, vid long, x double, y double, z double")
    return lambda faces: Mesh(vertices, spark.createDataFrame(faces, "mesh_id string, fid long, v0 long, v1 long, v2 long"))


@pytest.mark.parametrize("bad", [("m", 1, 7, 8, 9), ("m", 1, 0, 1, 9), ("other", 1, 0, 1, 2)])
def test_faces_with_unknown_vertices_fail_for_every_reader(square, bad):
    tris = M.triangles(square([("m", 0, 0, 1, 2), bad]))
    for read in (tris.count, tris.select("y1").collect, lambda: M.mean_abs_normals(tris).collect()):
        with pytest.raises(PySparkException, match=f"missing vertex in mesh {bad[0]}"):
            read()
    assert M.triangles(square([("m", 0, 0, 1, 2)])).count() == 1


def test_meshes_without_faces_fail_or_keep_given_axes(spark, square):
    mesh = square([("m", 0, 0, 1, 2)])
    more = mesh.vertices.union(mesh.vertices.withColumn("mesh_id", F.lit("bare")))
    box = M.bounds(more)
    with pytest.raises(PySparkException, match="no faces .* in mesh bare"):
        M.axis_roles(box, M.triangles(Mesh(more, mesh.faces))).count()
    assert M.given_roles(box, 0, 1, 2).count() == 2


@pytest.mark.parametrize("content", ["", "# nothing\nf 1 2 3\n"])
def test_files_without_vertices_fail(spark, tmp_path, content):
    (tmp_path / "a.obj").write_text(SQUARE)
    (tmp_path / "b.obj").write_text(content)
    with pytest.raises(ValueError, match="b.obj"):
        read_obj(spark, str(tmp_path / "*.obj"))


@pytest.mark.parametrize("extra", [[math.inf], [math.nan], [-math.inf, math.inf, math.nan], [-math.inf] * 900, [math.nan] * 1500, [1.7e308, -1.7e308], [5e-324, 0.0]])
def test_quantile_routes_agree_on_special_values(spark, extra):
    values = [float((k * 7919) % 1000) for k in range(2000)] + extra
    df = spark.createDataFrame([("m", v) for v in values], "mesh_id string, v double")
    probs = [0.0, 0.025, 0.25, 0.31, 0.5, 0.75, 0.9, 0.975, 1.0]
    a, b = (exact_quantiles(df, "v", probs, bound=bound).first() for bound in (10**6, 100))
    assert a.n == b.n == len(values)
    assert [repr(x) for x in a.q] == [repr(x) for x in b.q]


def test_only_special_values(spark):
    df = spark.createDataFrame([("m", math.inf), ("m", math.inf), ("m", math.nan)], "mesh_id string, v double")
    a, b = (exact_quantiles(df, "v", [0.0, 0.5, 1.0], bound=bound).first().q for bound in (10, 1))
    assert [repr(x) for x in a] == [repr(x) for x in b] == ["inf", "inf", "nan"]


def test_ordinals_of_sparse_ids(spark):
    ids = [k * k * (1 << 40) % (1 << 60) + k for k in range(500)]
    got = {r.vid: r["ord"] for r in with_ordinals(spark.createDataFrame([("m", i) for i in ids], "mesh_id string, vid long"), "vid").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_full_report_for_each_of_25_meshes(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"s{k:02}.obj").write_text(SQUARE)
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "*.obj"), "--use-legacy-wear-volume", "-o", str(out)]) == 0
    rows = [json.loads(line) for p in (out / "report").glob("*.json") for line in p.read_text().splitlines()]
    assert len(rows) == 25 and all("QUESTION 3" in r["text"] for r in rows)


@pytest.mark.parametrize("start", ["cli", "workers"])
def test_started_from_another_folder(tmp_path, start):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if start == "cli":
        command = [sys.executable, os.path.join(ROOT, "footfall", "cli.py"), "--help"]
    else:
        code = (
            f"import sys; sys.path.insert(0, {ROOT!r})\nimport __spark_entry__ as e\nfrom footfall.session import session\n"
            "s = session('other', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
            "print('rows', e.queries()['plane_inlier_count'](s, '/root/testdata/sf0.001').count())"
        )
        command = [sys.executable, "-c", code]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and ("--material" in done.stdout or "rows " in done.stdout), done.stderr[-800:]
