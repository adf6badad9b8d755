import pandas as pd

from footfall.operators.mesh import Mesh


def to_mesh(spark, named):
    """{name: (vertices, faces)} -> Mesh."""
    vs, fs = [], []
    for name, (v, f) in named.items():
        vs.append(pd.DataFrame({"mesh_id": name, "vid": range(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]}))
        fs.append(pd.DataFrame({"mesh_id": name, "fid": range(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]}))
    return Mesh(
        spark.createDataFrame(pd.concat(vs), "mesh_id string, vid long, x double, y double, z double").repartition(4),
        spark.createDataFrame(pd.concat(fs), "mesh_id string, fid long, v0 long, v1 long, v2 long").repartition(4),
    )
