"""Mesh files of several records per shard, as a Spark data source, and their writers.

A shard is one partition. Records stand one after the other, each between its length in bytes; those
that are not asked for are skipped by seeking, so a scan of three arrays reads three arrays. Files are
opened through Arrow's file systems by the path's scheme.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .fields import EDGE, encode_record

#: The records of a mesh file and of its file of interfaces, in their order.
MESH_RECORDS = (
    ("nspec", "i4"), ("nglob", "i4"), ("x", "f4"), ("y", "f4"), ("z", "f4"), ("ibool", "i4"), ("idoubling", "i4"), ("ispec_is_tiso", "i4"),
    ("dxsi_dx", "f4"), ("dxsi_dy", "f4"), ("dxsi_dz", "f4"), ("deta_dx", "f4"), ("deta_dy", "f4"), ("deta_dz", "f4"), ("dgam_dx", "f4"), ("dgam_dy", "f4"), ("dgam_dz", "f4"),
)
INTERFACE_RECORDS = (("num_interfaces", "i4"), ("max_nibool_interfaces", "i4"), ("my_neighbors", "i4"), ("nibool_interfaces", "i4"), ("ibool_interfaces", "i4"))
MESH_FILE, INTERFACE_FILE = "proc{:06d}_{}_solver_data.bin", "proc{:06d}_{}_solver_data_mpi.bin"
BY_NODE, BY_ELEMENT = ("x", "y", "z"), ("idoubling", "ispec_is_tiso")
DERIVATIVES = tuple(n for n, _ in MESH_RECORDS if n.startswith("d"))
#: Elements that are handed to Spark at once.
ELEMENTS = 512


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def read_records(stream, wanted: set[str], layout: tuple) -> dict[str, np.ndarray]:
    """The wanted records of an open file; the others are skipped. A file that is cut off or whose lengths differ is an error."""
    found: dict[str, np.ndarray] = {}
    for name, kind in layout:
        head = stream.read(4)
        if len(head) < 4:
            raise ValueError(f"the file ends before its record {name}")
        size = int.from_bytes(head, "little")
        if name in wanted:
            raw = stream.read(size)
            if len(raw) < size:
                raise ValueError(f"the file ends inside its record {name}")
            found[name] = np.frombuffer(raw, "<" + kind)
        else:
            stream.seek(stream.tell() + size)
        if stream.read(4) != head:
            raise ValueError(f"the lengths around the record {name} differ")
    return found


class Shard(InputPartition):
    def __init__(self, iproc: int, path: str):
        self.iproc, self.path = iproc, path


class ShardReader(DataSourceReader):
    """Lists the shards on the driver; each is read by a task of its own."""

    pattern = MESH_FILE

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path, self.region = options["path"], options.get("region", "reg1")
        self.shards = {int(s) for s in options.get("shards", "").split(",") if s.strip()}
        self.arrays = [a.strip() for a in options.get("arrays", "x,y,z").split(",") if a.strip()]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.path)
        name = re.compile(re.escape(self.pattern.format(0, self.region)).replace("000000", r"(\d{6})") + "$")
        found = [(int(m[1]), f.path) for f in system.get_file_info(fs.FileSelector(root)) if (m := name.fullmatch(f.base_name))]
        return [Shard(i, p) for i, p in sorted(found) if not self.shards or i in self.shards]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as stream:
            yield from self.rows(partition.iproc, stream)


class MeshReader(ShardReader):
    def rows(self, iproc: int, stream) -> Iterator[pa.RecordBatch]:
        # by node means through the node numbers, which are then needed too
        own = read_records(stream, {"nspec", "nglob", "ibool", *self.arrays} - {"iglob"}, MESH_RECORDS)
        n, points = int(own["nspec"][0]), EDGE**3
        nodes = own["ibool"].reshape(n, points) - 1
        if n and (nodes.min() < 0 or nodes.max() >= int(own["nglob"][0])):
            raise ValueError(f"shard {iproc} has a node number out of range")
        columns = {a: nodes if a == "iglob" else own[a][nodes] if a in BY_NODE else own[a] if a in BY_ELEMENT else own[a].reshape(n, points) for a in self.arrays}
        for start in range(0, n, ELEMENTS):
            some = slice(start, min(n, start + ELEMENTS))
            count = some.stop - start
            arrays = [pa.array(np.full(count, iproc, np.int32)), pa.array(np.arange(start, some.stop, dtype=np.int32))]
            for a in self.arrays:
                part = columns[a][some]
                if a in BY_ELEMENT:
                    arrays.append(pa.array(part.astype(np.int32)))
                else:
                    kind = np.int32 if a == "iglob" else np.float32
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * points, pa.int32()), pa.array(part.ravel().astype(kind))))
            yield pa.RecordBatch.from_arrays(arrays, names=["iproc", "ispec", *self.arrays])


class InterfaceReader(ShardReader):
    pattern = INTERFACE_FILE

    def rows(self, iproc: int, stream) -> Iterator[pa.RecordBatch]:
        own = read_records(stream, {n for n, _ in INTERFACE_RECORDS}, INTERFACE_RECORDS)
        n, widest = int(own["num_interfaces"][0]), int(own["max_nibool_interfaces"][0])
        nodes, sizes = own["ibool_interfaces"].reshape(n, widest) - 1, own["nibool_interfaces"]
        lists = pa.array([nodes[i, : sizes[i]].tolist() for i in range(n)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, iproc, np.int32)), pa.array(own["my_neighbors"][:n]), lists], names=["iproc", "neighbor", "iglob"])


class MeshSource(DataSource):
    """Format ``mesh_records``: a row per element, (iproc, ispec, arrays). Options: ``path``; ``arrays``, names with commas
    between (those of the file, with x, y, z taken to the 125 points, and iglob, the 0-based nodes); ``shards``, numbers
    (all by default); ``region``; ``kind`` mesh or interfaces: (iproc, neighbor, iglob), the nodes shared with each neighbour."""

    @classmethod
    def name(cls) -> str:
        return "mesh_records"

    def schema(self) -> str:
        if self.options.get("kind", "mesh") == "interfaces":
            return "iproc int, neighbor int, iglob array<int>"
        arrays = [a.strip() for a in self.options.get("arrays", "x,y,z").split(",") if a.strip()]
        known = {n for n, _ in MESH_RECORDS} - {"nspec", "nglob", "ibool"} | {"iglob"}
        if bad := [a for a in arrays if a not in known]:
            raise ValueError(f"not an array of a mesh: {bad}")
        kind = lambda a: "int" if a in BY_ELEMENT else "array<int>" if a == "iglob" else "array<float>"
        return ", ".join(["iproc int", "ispec int", *[f"{a} {kind(a)}" for a in arrays]])

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return InterfaceReader(options) if options.get("kind", "mesh") == "interfaces" else MeshReader(options)


def read_mesh(spark: SparkSession, path: str, arrays: tuple[str, ...] = ("x", "y", "z"), shards: tuple[int, ...] = (), region: str = "reg1") -> DataFrame:
    """(iproc, ispec, arrays), a row per element; see :class:`MeshSource`."""
    spark.dataSource.register(MeshSource)
    return spark.read.format("mesh_records").option("path", path).option("arrays", ",".join(arrays)).option("shards", ",".join(map(str, shards))).option("region", region).load()


def read_interfaces(spark: SparkSession, path: str, shards: tuple[int, ...] = (), region: str = "reg1") -> DataFrame:
    """(iproc, neighbor, iglob): the nodes that a shard shares with each of its neighbours."""
    spark.dataSource.register(MeshSource)
    return spark.read.format("mesh_records").option("path", path).option("kind", "interfaces").option("shards", ",".join(map(str, shards))).option("region", region).load()


def element_geometry(mesh: DataFrame) -> DataFrame:
    """A mesh with x, y, z and the nine derivatives, and with center (its middle point), anchors (27 places),
    jacobian and volume (of the 125 points, with their quadrature weights)."""
    from ..functions import gll

    middle, anchor = EDGE // 2, [0, EDGE // 2, EDGE - 1]
    at = lambda a, b, c: (c * EDGE + b) * EDGE + a
    _, w = gll.nodes_and_weights(EDGE)
    weights = F.array(*[F.lit(float(w[p % EDGE] * w[p // EDGE % EDGE] * w[p // EDGE**2])) for p in range(EDGE**3)])
    place = lambda p: [F.get(F.col(c), F.lit(p)).cast("double") for c in BY_NODE]
    d: dict[str, Column] = {n: None for n in DERIVATIVES}
    zipped = F.arrays_zip(*DERIVATIVES)

    def jacobian(x: Column) -> Column:
        d.update({n: x[n].cast("double") for n in DERIVATIVES})
        minor = lambda a, b: d[f"deta_d{a}"] * d[f"dgam_d{b}"] - d[f"deta_d{b}"] * d[f"dgam_d{a}"]
        return F.try_divide(F.lit(1.0), d["dxsi_dx"] * minor("y", "z") - d["dxsi_dy"] * minor("x", "z") + d["dxsi_dz"] * minor("x", "y"))

    return mesh.withColumns({
        "center": F.array(*place(at(middle, middle, middle))),
        "anchors": F.array(*[v for c in anchor for b in anchor for a in anchor for v in place(at(a, b, c))]),
        "jacobian": F.transform(zipped, jacobian),
    }).withColumn("volume", F.zip_with("jacobian", weights, lambda j, v: j * v))


def written_by_shard(df: DataFrame, order: list[str], path: str, name: str, encode) -> DataFrame:
    """(iproc, path, n_bytes): a file for every shard, made of its rows in order by one task.

    A shard is what a file of this format holds, so it must fit a task. A file is written under another name and moved,
    so a task that is tried again leaves one whole file.
    """
    rows = df.repartition("iproc").sortWithinPartitions("iproc", *order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            iproc = table.column("iproc")[0].as_py()
            data, place = encode(table), f"{root.rstrip('/')}/{name.format(iproc)}"
            with system.open_output_stream(f"{place}.part") as out:
                out.write(data)
            system.move(f"{place}.part", place)
            return pa.RecordBatch.from_pydict({"iproc": pa.array([iproc], pa.int32()), "path": [place], "n_bytes": [len(data)]})

        for batch in batches:
            shards = batch.column("iproc").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column("iproc")[0].as_py() != int(shards[a]):
                    yield flush()
                    held.clear()
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return rows.mapInArrow(work, "iproc int, path string, n_bytes long")


def prepare(path: str, name: str, overwrite: bool) -> None:
    """Make the folder; complain if it has such files already."""
    from pyarrow import fs

    system, root = file_system(path)
    system.create_dir(root, recursive=True)
    pattern = re.compile(re.escape(name.format(0)).replace("000000", r"\d{6}") + "$")
    there = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if pattern.fullmatch(f.base_name)]
    if there and not overwrite:
        raise FileExistsError(f"{path} has {there[0]} already")


def write_field_files(df: DataFrame, path: str, tag: str, region: str = "reg1", overwrite: bool = False) -> DataFrame:
    """A field (iproc, ispec, igll, <tag>) as one record a shard; (iproc, path, n_bytes) of the files. Refuses to overwrite unless asked."""
    name = f"proc{{:06d}}_{region}_{tag}.bin"
    prepare(path, name, overwrite)
    done = written_by_shard(df.select("iproc", "ispec", "igll", F.col(tag).cast("float").alias("v")), ["ispec", "igll"], path, name, lambda t: encode_record(t.column("v").to_numpy()))
    return df.sparkSession.createDataFrame(done.collect(), done.schema)  # as many rows as files


def write_mesh(mesh: DataFrame, path: str, region: str = "reg1", overwrite: bool = False) -> DataFrame:
    """Mesh files of element rows with iproc, ispec, iglob (0-based), x, y, z, and all other arrays of the format."""
    name = MESH_FILE.replace("_{}_", f"_{region}_")

    def encode(table: pa.Table) -> bytes:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        nodes = flat("iglob")
        n_nodes = int(nodes.max()) + 1
        out = []
        for record, kind in MESH_RECORDS:
            if record == "nspec":
                values = np.array([table.num_rows])
            elif record == "nglob":
                values = np.array([n_nodes])
            elif record in BY_NODE:
                values = np.zeros(n_nodes, np.float32)
                values[nodes] = flat(record)
            elif record == "ibool":
                values = nodes + 1
            elif record in BY_ELEMENT:
                values = table.column(record).to_numpy()
            else:
                values = flat(record)
            raw = np.asarray(values, "<" + kind).tobytes()
            size = len(raw).to_bytes(4, "little")
            out += [size, raw, size]
        return b"".join(out)

    prepare(path, name, overwrite)
    wanted = ["iproc", "ispec", "iglob", *BY_NODE, *BY_ELEMENT, *DERIVATIVES]
    done = written_by_shard(mesh.select(*wanted), ["ispec"], path, name, encode)
    return mesh.sparkSession.createDataFrame(done.collect(), done.schema)
