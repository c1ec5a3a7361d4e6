"""A Spark data source for point files: spark.read.format("pointcloud").load(path) of XYZ, PLY, PCD and LAS.

The format follows from the extension and, where a file has a signature, must agree with its first bytes. Files are read
through Arrow's file systems in ranges of records, so that a large file makes many tasks; ASCII ranges begin at line ends.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
RANGE_BYTES = 32 << 20
SCHEMA = "point_id long, x double, y double, z double, r double, g double, b double, intensity double, file string"
#: Extensions, and the first bytes of files that have a signature.
FORMATS = {"xyz": None, "txt": None, "pts": None, "csv": None, "ply": b"ply", "pcd": b"# .PCD", "las": b"LASF"}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
NAMES = {"red": "r", "green": "g", "blue": "b"}


def format_of(path: str, head: bytes) -> str:
    """The format by extension; a signature that isn't the extension's is an error."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    sign = next((k for k, v in FORMATS.items() if v and head.startswith(v)), None)
    if ext not in FORMATS:
        if sign is None:
            raise ValueError(f"{path}: unknown format")
        return sign
    if FORMATS[ext] and sign != ext or not FORMATS[ext] and sign:
        raise ValueError(f"{path}: its content is {sign or 'not'} {ext if not sign else ''}".strip())
    return ext if FORMATS[ext] else "xyz"


@dataclass
class Layout:
    """Where the points of a file are: kind ascii or binary, offset of the first, number (-1 unknown), and columns."""

    kind: str
    offset: int
    count: int
    columns: list[str]
    dtype: list[tuple[str, str]] = field(default_factory=list)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)
    shift: tuple[float, ...] = (0.0, 0.0, 0.0)


def layout_of(path: str, head: bytes) -> Layout:
    """Reads a header from the first bytes of a file."""
    kind = format_of(path, head)
    if kind == "xyz":
        return Layout("ascii", 0, -1, ["x", "y", "z", "r", "g", "b"])
    if kind == "ply":
        end = head.index(b"end_header")
        offset = head.index(b"\n", end) + 1
        style, count, props, inside = "ascii", 0, [], False
        for line in head[:end].decode("ascii", "replace").splitlines():
            w = line.split()
            if w[:1] == ["format"]:
                style = w[1]
            elif w[:1] == ["element"]:
                inside = w[1] == "vertex"
                count = int(w[2]) if inside else count
            elif w[:1] == ["property"] and inside:
                if w[1] == "list":
                    raise ValueError(f"{path}: lists in vertices")
                props.append((NAMES.get(w[2], w[2]), PLY_TYPES[w[1]]))
        order = ">" if style == "binary_big_endian" else "<"
        return Layout("ascii" if style == "ascii" else "binary", offset, count, [n for n, _ in props], [(n, order + t) for n, t in props])
    if kind == "pcd":
        end = head.index(b"\nDATA") + 1
        offset = head.index(b"\n", end) + 1
        h = {line.split()[0]: line.split()[1:] for line in head[:offset].decode("ascii", "replace").splitlines() if line and not line.startswith("#")}
        if h["DATA"][0] == "binary_compressed":
            raise ValueError(f"{path}: compressed PCD is not read")
        names = [NAMES.get(x.lower(), x.lower()) for x in h["FIELDS"]]
        kinds = [("<" + {"F": "f", "I": "i", "U": "u"}[t] + s) for t, s in zip(h["TYPE"], h["SIZE"], strict=True)]
        return Layout("ascii" if h["DATA"][0] == "ascii" else "binary", offset, int(h["POINTS"][0]), names, list(zip(names, kinds, strict=True)))
    (offset,) = struct.unpack_from("<I", head, 96)
    point, size = head[104] & 0x3F, struct.unpack_from("<H", head, 105)[0]
    count = struct.unpack_from("<I", head, 107)[0] or (struct.unpack_from("<Q", head, 247)[0] if head[25] >= 4 else 0)
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    if head[104] & 0x80:
        raise ValueError(f"{path}: compressed LAS is not read")
    at = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}.get(point)
    dtype = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2")]
    used = 14
    if at:
        dtype += [("_a", f"V{at - used}"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
        used = at + 6
    if size > used:
        dtype.append(("_z", f"V{size - used}"))
    return Layout("binary", offset, count, [n for n, _ in dtype if n[0] != "_"], dtype, scale, shift)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    first: int
    layout: Layout


class PointReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            info = store.get_file_info(root)
            files = [info] if info.is_file else sorted((x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name.rsplit(".", 1)[-1].lower() in FORMATS), key=lambda x: x.path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            for f in files:
                with store.open_input_file(f.path) as s:
                    layout = layout_of(f.path, s.read(min(f.size, 1 << 16)))
                uri = f"{path}" if info.is_file else f"{path.rstrip('/')}/{f.base_name}"
                if layout.kind == "binary":
                    size = np.dtype(layout.dtype).itemsize
                    step = max(1, self.range_bytes // size)
                    out += [Range(uri, layout.offset + i * size, layout.offset + min(i + step, layout.count) * size, i, layout) for i in range(0, layout.count, step)]
                else:
                    out += [Range(uri, i, min(i + self.range_bytes, f.size), i, layout) for i in range(layout.offset, f.size, self.range_bytes)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        path = part.path
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with store.open_input_file(root) as f:
            if part.layout.kind == "binary":
                f.seek(part.begin)
                rows = np.frombuffer(f.read(part.end - part.begin), np.dtype(part.layout.dtype))
                cols = {n: rows[n].astype(float) for n in part.layout.columns if n in ("x", "y", "z", "r", "g", "b", "intensity")}
                for i, a in enumerate("xyz"):
                    cols[a] = cols[a] * part.layout.scale[i] + part.layout.shift[i]
                ids = part.first + np.arange(len(rows))
            else:
                begin = part.begin
                if begin > part.layout.offset:  # the line that begins before belongs to the range before
                    f.seek(begin - 1)
                    while (c := f.read(1)) and c != b"\n":
                        pass
                    begin = f.tell()
                f.seek(begin)
                data = f.read(max(0, part.end - begin))
                while data and not data.endswith(b"\n") and (c := f.read(4096)):
                    head, nl, _ = c.partition(b"\n")
                    data += head + nl
                rows, ids, at = [], [], begin
                for line in data.split(b"\n"):
                    w = line.replace(b",", b" ").split()
                    if len(w) >= 3 and not line.lstrip().startswith((b"#", b"//")):
                        rows.append([float(x) for x in w[: len(part.layout.columns)]])
                        ids.append(at)  # lines have no number before all are read: their place in the file names them
                    at += len(line) + 1
                cols = {n: np.array([r[i] if i < len(r) else np.nan for r in rows], float) for i, n in enumerate(part.layout.columns) if n in ("x", "y", "z", "r", "g", "b", "intensity")}
                ids = np.array(ids, np.int64)
        if not len(ids):
            return
        n = len(ids)
        out = [pa.array(ids.astype(np.int64)), *[pa.array(cols[c], from_pandas=True) if c in cols else pa.nulls(n, pa.float64()) for c in ("x", "y", "z", "r", "g", "b", "intensity")], pa.array([part.path] * n)]
        yield pa.RecordBatch.from_arrays(out, names=["point_id", "x", "y", "z", "r", "g", "b", "intensity", "file"])


class PointCloud(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PointReader:
        return PointReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointCloud)


def load(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format("pointcloud")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def unit_colours(points: DataFrame) -> DataFrame:
    """Colours in 0 to 1: divided by 65535 where a file's largest is above 255, else by 255; without colours, grey by intensity."""
    top = points.groupBy("file").agg(F.max(F.greatest("r", "g", "b")).alias("top"), F.max("intensity").alias("most"))
    joined = points.join(top, "file")
    grey = F.try_divide(F.col("intensity"), F.col("most"))
    scale = F.when(F.col("top") > 255, 65535.0).otherwise(255.0)
    return joined.withColumns({c: F.coalesce(F.col(c) / scale, grey) for c in "rgb"}).drop("top", "most")


def validate(spark: SparkSession, path: str, least_bytes: int = 1, most_bytes: int = 1 << 40) -> DataFrame:
    """path, length, errors of files, from their metadata: no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ext = F.lower(F.substring_index("path", ".", -1))
    errors = F.array_compact(F.array(F.when(F.col("length") < least_bytes, F.lit("too_small")), F.when(F.col("length") > most_bytes, F.lit("too_large")), F.when(~ext.isin(*FORMATS), F.lit("unknown_format"))))
    return files.select("path", "length", errors.alias("errors"))
