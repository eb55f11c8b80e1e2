"""Media columns: content-addressed payloads in tar shards (operator 6).

:func:`store` writes payloads as members of tar shards in the shared store, named by
their digest, and returns a manifest: one row per input row with digest, shard, offset
and length.  A payload that a task meets again is stored once; :func:`one_place` gives a
payload that several tasks met one place, so all its rows carry the same.  Shards are named by task attempt, so a lost or repeated task leaves files
that no manifest names, never a half-written file that one does.

:func:`headers` fills metadata columns from range reads of a member's first bytes alone;
:func:`features` reads whole members back, checks the digest and computes features.

The stored form is a losslessly compressed 8-bit greyscale PNG of 576 samples a line.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.shared import drop_written, fresh_path, map_batches, text_rows, written

LINE = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, then the whole IHDR chunk: 4 length, 4 name, 13 body, 4 check.
HEADER_BYTES = 33


def padded(data: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * ((-len(data)) % LINE if data else LINE)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """A PNG whose samples are the payload; equal payloads give equal bytes."""
    lines = len(payload) // LINE
    rows = np.zeros((lines, LINE + 1), np.uint8)  # each line after its filter type, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(lines, LINE)
    head = struct.pack(">IIBBBBB", LINE, lines, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, str]:
    """Width, height, bits a sample and format from the first bytes of a stored member."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits, "png"


def decode(data: bytes) -> bytes:
    width, height, _, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return rows[:, 1:].tobytes()


class Shards:
    """Tar shards of one task attempt, rolled at ``most`` bytes."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        context = TaskContext.get()
        self.stem = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.number, self.out, self.at = 0, None, 0
        self.places: dict[str, tuple] = {}

    def put(self, payload: bytes, digest: str) -> tuple:
        """(shard, offset, length, digest of the stored form) of a payload."""
        if digest not in self.places:
            from pyarrow import fs

            if self.out is None:
                store, where = fs.FileSystem.from_uri(self.stem)
                store.create_dir(where.rsplit("/", 1)[0], recursive=True)
                self.shard = f"{self.stem}-{self.number:04d}.tar"
                self.out, self.at = store.open_output_stream(fs.FileSystem.from_uri(self.shard)[1]), 0
                self.number += 1
            data = encode(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            place = self.places[digest] = (self.shard, self.at + len(head), len(data), hashlib.sha256(data).hexdigest())
            self.at += len(head) + len(data) + -len(data) % 512
            if self.at >= self.most:
                self.close()
            return place
        return self.places[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """The manifest of the texts' payloads: doc_id, n_bytes, digest, shard, offset, length, media_sha256.

    Null and empty texts have the payload of 576 bytes 255.  Repeated rows get a row each.
    """
    rows = text_rows(df, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long, media_sha256 string"

    from pyspark.sql.pandas.types import to_arrow_schema

    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches):
        from scriptorium.llm.shared import slices

        shards = Shards(folder, shard_bytes)
        for whole in batches:
            for batch in slices(whole):
                found = []
                for key_, text_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    data = (text_ or "").encode()
                    payload = padded(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    shard, offset, length, stored = shards.put(payload, digest)
                    found.append((key_, len(data), digest, shard, offset, length, stored))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)
        shards.close()  # before the task ends, so a manifest that is kept names whole files

    return rows.mapInArrow(run, target)


class Reader:
    """Range reads of shards; keeps the last file open."""

    def __init__(self):
        self.name, self.file = None, None

    def __call__(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            from pyarrow import fs

            store, where = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, store.open_input_file(where)
        return self.file.read_at(length, offset)


def headers(manifest: DataFrame) -> DataFrame:
    """Adds width, height, bits, format: ``HEADER_BYTES`` are read of each member, no more."""
    names = manifest.columns

    def start():
        read = Reader()

        def fill(batch: pa.RecordBatch) -> dict:
            heads = [header(read(*x, HEADER_BYTES)) for x in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            return {n: batch.column(n) for n in names} | {n: [h[i] for h in heads] for i, n in enumerate(("width", "height", "bits", "format"))}

        return fill

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    return map_batches(manifest, start, f"{fields}, width int, height int, bits int, format string")


def describe(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and a 64-bit mean hash of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    deviation = max(0.0, float(counts @ (values * values)) / len(samples) - mean * mean) ** 0.5
    blocks = samples[: len(samples) // 64 * 64].reshape(64, -1).mean(axis=1)
    bits = int("".join("1" if b > blocks.mean() else "0" for b in blocks), 2)
    return f"{mean:.4f}:{deviation:.4f}:{-float(share @ np.log2(share)) + 0.0:.4f}:{bits:016x}"


def features(manifest: DataFrame) -> DataFrame:
    """The manifest's columns and, from the bytes read back, payload and stored digests, sizes, feature.

    A member whose payload does not match its digest raises: the store is damaged.
    """
    names = [n for n in manifest.columns if n != "media_sha256"]

    def start():
        read, last = Reader(), {}

        def look(shard: str, offset: int, length: int, digest: str) -> tuple:
            if (shard, offset) not in last:
                data = read(shard, offset, length)
                payload = decode(data)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"{shard} at {offset}: payload differs from its digest")
                if len(last) > 20_000:
                    last.clear()
                last[shard, offset] = (len(payload), found, zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(payload))
            return last[shard, offset]

        def fill(batch: pa.RecordBatch) -> dict:
            seen = [look(*x) for x in zip(*(batch.column(n).to_pylist() for n in ("shard", "offset", "length", "digest")))]
            named = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return {n: batch.column(n) for n in names} | {n: [s[i] for s in seen] for i, n in enumerate(named)}

        return fill

    fields = ", ".join(f"`{n}` {manifest.schema[n].dataType.simpleString()}" for n in names)
    return map_batches(manifest, start, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def one_place(manifest: DataFrame, salts: int = 16) -> DataFrame:
    """The manifest with one place for each digest, the first by shard and offset; ``row`` tells rows apart.

    Tasks store what they meet, so a payload that several tasks met has several places.
    Only those digests travel; rows of one that many share are spread over ``salts`` keys.
    """
    place = F.struct("shard", "offset", "length")
    several = manifest.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    several = several.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    salted = manifest.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    joined = salted.join(several, ["digest", "salt"], "left").withColumn("place", F.coalesce("first", place))
    return joined.select(*[F.col("place")[c].alias(c) if c in ("shard", "offset", "length") else F.col(c) for c in manifest.columns])


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = 64 << 20) -> DataFrame:
    """Stores every text; fills the header columns by range reads of headers, the others from the bytes read back.

    Rows: one for each input row, whatever its key; empty table: none.  Equal texts have
    equal values in all columns, digest, shard, offset and length included.  Other columns
    are not read.  A reading task has some ``task_bytes`` of stored members, in the order
    they are stored.
    """
    stored = store(df, fresh_path(df.sparkSession, "media"), key, text).drop("media_sha256").withColumn("row", F.monotonically_increasing_id())
    first = written(stored, "manifest")
    manifest = written(one_place(first), "places")
    drop_written(first)
    total = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    order = ("shard", "offset", "row")  # rows of one place may be dealt to several tasks
    dealt = manifest.repartitionByRange(max(1, -(-total // task_bytes)), *order).sortWithinPartitions(*order)
    return features(headers(dealt.drop("row")))
