"""Avro object containers as tables, for sessions without Spark's own Avro data source.

A file is a header (schema, codec, sync marker) and blocks of records. Records are decoded into Arrow
batches by functions built once from the schema. Files are tasks: one file is read by one task, in blocks.
"""

from __future__ import annotations

import bz2
import datetime
import json
import lzma
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# fixed values of the format
MAGIC = b"Obj\x01"
SYNC = 16
EPOCH = datetime.date(1970, 1, 1)
EPOCH_TIME = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
PRIMITIVES = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType()}


class DamagedFile(ValueError):
    pass


class Input:
    """A position in bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise DamagedFile("cut short")
        out = self.data[self.at : end]
        self.at = end
        return out

    def number(self) -> int:
        """A zigzag variable-length integer."""
        value = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise DamagedFile("cut short")
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def text(self) -> bytes:
        return self.take(self.number())


def zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def inflate(codec: str, body: bytes) -> bytes:
    if codec in ("", "null"):
        return body
    if codec == "deflate":
        return zlib.decompress(body, -15)
    if codec == "snappy":
        size, at, shift = 0, 0, 0
        while True:  # the raw length that snappy data begin with
            byte = body[at]
            size |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                break
        raw = pa.Codec("snappy").decompress(body[:-4], decompressed_size=size, asbytes=True)
        if struct.unpack(">I", body[-4:])[0] != zlib.crc32(raw):
            raise DamagedFile("checksum of a block")
        return raw
    if codec == "bzip2":
        return bz2.decompress(body)
    if codec == "xz":
        return lzma.decompress(body)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    raise DamagedFile(f"unknown codec {codec!r}")


def deflate(codec: str, body: bytes) -> bytes:
    if codec == "null":
        return body
    if codec == "deflate":
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return packer.compress(body) + packer.flush()
    if codec == "snappy":
        return pa.Codec("snappy").compress(body, asbytes=True) + struct.pack(">I", zlib.crc32(body))
    raise ValueError(f"can't write codec {codec!r}")


def _named(schema, names: dict) -> dict:
    """A schema with references by name resolved, and its own names entered."""
    if isinstance(schema, str):
        return names.get(schema, {"type": schema})
    if isinstance(schema, list):
        return {"type": "union", "branches": [_named(s, names) for s in schema]}
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return _named(kind, names)
    out = dict(schema)
    if kind in ("record", "error", "enum", "fixed"):
        space = schema.get("namespace", "")
        names[schema["name"]] = out
        names[f"{space}.{schema['name']}"] = out
    if kind in ("record", "error"):
        out["fields"] = [{**f, "type": _named(f["type"], names)} for f in schema["fields"]]
    elif kind == "array":
        out["items"] = _named(schema["items"], names)
    elif kind == "map":
        out["values"] = _named(schema["values"], names)
    return out


def parse_schema(text: str) -> dict:
    return _named(json.loads(text), {})


def _branches(schema: dict) -> tuple[list[dict], bool]:
    """A union's kinds without null, and whether null is one."""
    kinds = [b for b in schema["branches"] if b["type"] != "null"]
    return kinds, len(kinds) < len(schema["branches"])


def spark_type(schema: dict) -> T.DataType:
    kind = schema["type"]
    if kind == "union":
        kinds, _ = _branches(schema)
        if len(kinds) == 1:
            return spark_type(kinds[0])
        found = [spark_type(k) for k in kinds]
        if all(f == found[0] for f in found):
            return found[0]
        if {k["type"] for k in kinds} <= {"int", "long"}:
            return T.LongType()
        if {k["type"] for k in kinds} <= {"float", "double"}:
            return T.DoubleType()
        raise ValueError("unions of several kinds aren't read")
    if kind in ("record", "error"):
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if kind == "enum":
        return T.StringType()
    if kind == "fixed":
        return T.BinaryType()
    if kind in ("int", "long") and schema.get("logicalType") in LOGICAL:
        return LOGICAL[schema["logicalType"]]
    return PRIMITIVES[kind]


def reader(schema: dict) -> Callable[[Input], object]:
    """A function that decodes one value."""
    kind = schema["type"]
    if kind == "union":
        each = [reader(b) for b in schema["branches"]]

        def union(i: Input):
            n = i.number()
            if not 0 <= n < len(each):
                raise DamagedFile("branch of a union")
            return each[n](i)

        return union
    if kind in ("record", "error"):
        fields = [(f["name"], reader(f["type"])) for f in schema["fields"]]
        return lambda i: {name: read(i) for name, read in fields}
    if kind == "array":
        item = reader(schema["items"])

        def array(i: Input):
            out = []
            while n := i.number():
                if n < 0:
                    n = -n
                    i.number()
                out += [item(i) for _ in range(n)]
            return out

        return array
    if kind == "map":
        value = reader(schema["values"])

        def mapping(i: Input):
            out = []
            while n := i.number():
                if n < 0:
                    n = -n
                    i.number()
                out += [(i.text().decode(), value(i)) for _ in range(n)]
            return out

        return mapping
    if kind == "enum":
        symbols = schema["symbols"]
        return lambda i: symbols[i.number()]
    if kind == "fixed":
        size = schema["size"]
        return lambda i: i.take(size)
    logical = schema.get("logicalType")
    if logical == "date":
        return lambda i: EPOCH + datetime.timedelta(days=i.number())
    if logical in ("timestamp-millis", "timestamp-micros"):
        unit = 1000 if logical == "timestamp-millis" else 1
        return lambda i: EPOCH_TIME + datetime.timedelta(microseconds=i.number() * unit)
    return {
        "null": lambda i: None, "boolean": lambda i: i.take(1) != b"\x00", "int": Input.number, "long": Input.number,
        "float": lambda i: struct.unpack("<f", i.take(4))[0], "double": lambda i: struct.unpack("<d", i.take(8))[0],
        "bytes": Input.text, "string": lambda i: i.text().decode(),
    }[kind]


def header(data: bytes) -> tuple[str, str, bytes, int]:
    """(schema text, codec, sync marker, where blocks begin)."""
    if data[:4] != MAGIC:
        raise DamagedFile("not an Avro container")
    i, meta = Input(data), {}
    i.at = 4
    while n := i.number():
        if n < 0:
            n = -n
            i.number()
        for _ in range(n):
            key = i.text().decode()
            meta[key] = i.text()
    return meta["avro.schema"].decode(), meta.get("avro.codec", b"null").decode(), i.take(SYNC), i.at


def records(data: bytes) -> Iterator[list[dict]]:
    """A list of records for each block."""
    text, codec, sync, at = header(data)
    read, i = reader(parse_schema(text)), Input(data)
    i.at = at
    while i.at < len(data):
        n = i.number()
        block = Input(inflate(codec, i.text()))
        yield [read(block) for _ in range(n)]
        if i.take(SYNC) != sync:
            raise DamagedFile("sync marker")


def _files(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(paths).select("path", "content")


def read(spark: SparkSession, paths: str | list[str], pattern: str = "*.avro", skip_unreadable: bool = False, exclude: str | None = None) -> DataFrame:
    """The records of Avro files in folders, or of single files, as one table.

    Columns are those of the first file by path; columns that a file lacks are null, others it has are left
    out. Damaged files raise, or with ``skip_unreadable`` have no rows. ``exclude``: a path that isn't read,
    such as the table's own output.
    """
    files = _files(spark, paths, pattern)
    if exclude:
        files = files.where(~F.endswith("path", F.lit(exclude)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    whole = data.as_buffer()
                    text = header(whole.slice(0, min(len(whole), 1 << 20)).to_pybytes())[0]
                except (DamagedFile, KeyError, UnicodeDecodeError):
                    if not skip_unreadable:
                        raise
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text])], names=["path", "schema"])

    # one row comes back: the first file's schema
    first = files.mapInArrow(heads, "path string, schema string").orderBy("path").first()
    if first is None:
        raise FileNotFoundError(f"no Avro file can be read in {paths}")
    kind = spark_type(parse_schema(first["schema"]))
    if not isinstance(kind, T.StructType):
        kind = T.StructType([T.StructField("value", kind)])
    arrow, plain = to_arrow_schema(kind), kind.fieldNames() == ["value"] and parse_schema(first["schema"])["type"] not in ("record", "error")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                try:
                    blocks = records(data.as_buffer().to_pybytes())
                    if skip_unreadable:  # a file that is damaged further on has no rows at all
                        blocks = list(blocks)
                    for block in blocks:
                        yield pa.RecordBatch.from_pylist([{"value": r} for r in block] if plain else block, arrow)
                except (DamagedFile, KeyError, IndexError, UnicodeDecodeError, zlib.error):
                    if not skip_unreadable:
                        raise

    return files.mapInArrow(rows, kind)


def schema_of(kind: T.DataType, name: str = "row") -> object:
    """The Avro schema of a Spark type, all kinds nullable."""
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", schema_of(f.dataType, f"{name}_{f.name}")], "default": None} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", schema_of(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", schema_of(kind.valueType, f"{name}_value")]}
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(kind, (T.ByteType, T.ShortType)):
        return "int"
    found = next((k for k, v in PRIMITIVES.items() if v == kind), None)
    if found is None or found == "null":
        raise ValueError(f"{kind.simpleString()} has no Avro type here")
    return found


def writer(kind: T.DataType) -> Callable[[object], bytes]:
    """A function that encodes one value that isn't null."""

    def nullable(inner: T.DataType) -> Callable[[object], bytes]:
        write = writer(inner)
        return lambda v: b"\x00" if v is None else b"\x02" + write(v)

    if isinstance(kind, T.StructType):
        fields = [(f.name, nullable(f.dataType)) for f in kind.fields]
        return lambda v: b"".join(write(v[name]) for name, write in fields)
    if isinstance(kind, T.ArrayType):
        item = nullable(kind.elementType)
        return lambda v: (zigzag(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if isinstance(kind, T.MapType):
        value, text = nullable(kind.valueType), writer(T.StringType())
        return lambda v: (zigzag(len(v)) + b"".join(text(k) + value(x) for k, x in v) if v else b"") + b"\x00"
    if isinstance(kind, T.DateType):
        return lambda v: zigzag((v - EPOCH).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return lambda v: zigzag(((v if v.tzinfo else v.replace(tzinfo=datetime.timezone.utc)) - EPOCH_TIME) // datetime.timedelta(microseconds=1))
    if isinstance(kind, T.BooleanType):
        return lambda v: b"\x01" if v else b"\x00"
    if isinstance(kind, T.FloatType):
        return lambda v: struct.pack("<f", v)
    if isinstance(kind, T.DoubleType):
        return lambda v: struct.pack("<d", v)
    if isinstance(kind, T.StringType):
        return lambda v: (lambda b: zigzag(len(b)) + b)(v.encode())
    if isinstance(kind, T.BinaryType):
        return lambda v: zigzag(len(v)) + v
    return zigzag


def container(kind: T.StructType, codec: str, sync: bytes) -> bytes:
    """A file's header."""
    meta = {"avro.schema": json.dumps(schema_of(kind)).encode(), "avro.codec": codec.encode()}
    body = b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items())
    return MAGIC + zigzag(len(meta)) + body + b"\x00" + sync


def write(df: DataFrame, folder: str, codec: str = "snappy", name: str = "part") -> int:
    """Write a file for each partition that has rows, below a folder that all executors share; returns how many.

    Where the session has Spark's Avro data source, use that instead: it writes to any store. A file appears
    whole or not at all, under a name of its own for each attempt of a task, of which one is kept.
    """
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("without Spark's Avro data source files can be written to a mounted folder only")
    folder, kind = folder.removeprefix("file://"), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sync, out = writer(kind), uuid.uuid4().bytes, None
        target = os.path.join(folder, f"{name}-{uuid.uuid4().hex}.avro")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                os.makedirs(folder, exist_ok=True)
                out = open(f"{target}.part", "wb")  # noqa: SIM115
                out.write(container(kind, codec, sync))
            rows = batch.to_pylist()
            body = deflate(codec, b"".join(map(encode, rows)))
            out.write(zigzag(len(rows)) + zigzag(len(body)) + body + sync)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])

    done = df.mapInArrow(run, "path string").collect()  # a path a partition
    for r in done:  # files of attempts that failed keep their temporary names
        os.replace(r["path"] + ".part", r["path"])
    return len(done)


def write_by_group(df: DataFrame, folder: str, key: str, codec: str = "snappy") -> int:
    """One file for each value of ``key``, named by it, as one task a group; a hot group is written in blocks."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("without Spark's Avro data source files can be written to a mounted folder only")
    folder, kind = folder.removeprefix("file://"), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sync, current, out, done = writer(kind), uuid.uuid4().bytes, object(), None, []
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                value, end = rows[at][key], at
                while end < len(rows) and rows[end][key] == value:
                    end += 1
                if value != current:
                    if out is not None:
                        out.close()
                    current = value
                    os.makedirs(folder, exist_ok=True)
                    done.append((os.path.join(folder, f"{str(value).replace('/', '_').replace('..', '__')}.avro"), uuid.uuid4().hex))
                    out = open(".".join((*done[-1], "part")), "wb")  # noqa: SIM115
                    out.write(container(kind, codec, sync))
                body = deflate(codec, b"".join(map(encode, rows[at:end])))
                out.write(zigzag(end - at) + zigzag(len(body)) + body + sync)
                at = end
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["path", "attempt"])

    done = df.repartition(key).sortWithinPartitions(key).mapInArrow(run, "path string, attempt string").collect()  # a path a group
    for r in done:
        os.replace(f"{r['path']}.{r['attempt']}.part", r["path"])
    return len(done)
