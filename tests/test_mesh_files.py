"""Mesh files: written, read in part, and their geometry."""

import numpy as np
import pytest

from tracefold.functions import gll
from tracefold.sources import fields, mesh

N = fields.EDGE


def shard_rows(iproc, n, size):
    """n cubes of a size along x: points, their nodes, and derivatives of a plain scaling."""
    x, _ = gll.nodes_and_weights(N)
    rows = []
    for e in range(n):
        points = [((e + (x[a] + 1) / 2) * size + 10 * iproc, (x[b] + 1) / 2 * size, (x[c] + 1) / 2 * size) for c in range(N) for b in range(N) for a in range(N)]
        nodes = [(c * N + b) * (n * (N - 1) + 1) + e * (N - 1) + a for c in range(N) for b in range(N) for a in range(N)]
        slope = {d: [2 / size if d in ("dxsi_dx", "deta_dy", "dgam_dz") else 0.0] * N**3 for d in mesh.DERIVATIVES}
        rows.append((iproc, e, nodes, *[[float(p[i]) for p in points] for i in range(3)], e % 2, 1, *slope.values()))
    return rows


SCHEMA = "iproc int, ispec int, iglob array<int>, x array<double>, y array<double>, z array<double>, idoubling int, ispec_is_tiso int, " + ", ".join(f"{d} array<double>" for d in mesh.DERIVATIVES)


def test_mesh_files(spark, tmp_path):
    df = spark.createDataFrame([*shard_rows(0, 3, 2.0), *shard_rows(7, 2, 1.0)], SCHEMA).repartition(4)
    path = str(tmp_path / "mesh")
    assert sorted(r.iproc for r in mesh.write_mesh(df, path).collect()) == [0, 7]
    with pytest.raises(FileExistsError):
        mesh.write_mesh(df, path)
    mesh.write_mesh(df, path, overwrite=True)
    got = mesh.read_mesh(spark, path, ("z", "idoubling", "iglob"))
    assert got.columns == ["iproc", "ispec", "z", "idoubling", "iglob"] and got.rdd.getNumPartitions() == 2
    want = {(r.iproc, r.ispec): r for r in df.collect()}
    rows = got.collect()
    assert len(rows) == 5
    for r in rows:
        w = want[r.iproc, r.ispec]
        assert r.iglob == w.iglob and r.idoubling == w.idoubling and np.allclose(r.z, w.z)
    assert {r.iproc for r in mesh.read_mesh(spark, "file://" + path, ("x",), shards=(7,)).collect()} == {7}
    for r in mesh.element_geometry(mesh.read_mesh(spark, path, ("x", "y", "z", *mesh.DERIVATIVES))).collect():
        size = 2.0 if r.iproc == 0 else 1.0
        assert np.allclose(r.center, [(r.ispec + 0.5) * size + 10 * r.iproc, size / 2, size / 2])
        assert sum(r.volume) == pytest.approx(size**3, rel=1e-5) and len(r.anchors) == 81
        assert np.allclose(r.anchors[:3], [r.ispec * size + 10 * r.iproc, 0, 0])
    with pytest.raises(Exception, match="not an array"):
        mesh.read_mesh(spark, path, ("ibool",)).collect()
    (tmp_path / "mesh" / "proc000009_reg1_solver_data.bin").write_bytes(b"\x04\0\0\0\1\0\0\0\x04\0\0\0\x04\0")
    with pytest.raises(Exception, match="ends before its record"):
        mesh.read_mesh(spark, path, shards=(9,)).collect()


def test_interfaces(spark, tmp_path):
    def record(values):
        raw = np.asarray(values, "<i4").tobytes()
        return len(raw).to_bytes(4, "little") + raw + len(raw).to_bytes(4, "little")

    (tmp_path / "proc000003_reg1_solver_data_mpi.bin").write_bytes(b"".join(map(record, [[2], [3], [1, 4], [3, 2], [5, 6, 7, 8, 9, 0]])))
    assert [tuple(r) for r in mesh.read_interfaces(spark, str(tmp_path)).collect()] == [(3, 1, [4, 5, 6]), (3, 4, [7, 8])]


def test_field_files_again(spark, tmp_path):
    df = spark.createDataFrame([(p, i // 125, i % 125, float(p * 1000 + i)) for p in (0, 2) for i in range(250)], "iproc int, ispec int, igll int, vsv float")
    path = str(tmp_path / "out")
    assert [r.n_bytes for r in mesh.write_field_files(df.repartition(3), path, "vsv").collect()] == [1008, 1008]
    again = fields.read_field_files(spark, path, "vsv")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        mesh.write_field_files(df, path, "vsv")
