"""A log of document changes, replay, and generations of segments."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["collection_id", "doc_id"]


def latest(log: DataFrame, order: str = "seq") -> DataFrame:
    """The current documents: the last change of each, without deleted ones. One aggregation, made in each task first."""
    rest = [c for c in log.columns if c not in KEY]
    last = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"))
    return last.filter(F.col("x.op") != "delete").select(*KEY, *[F.col(f"x.{c}").alias(c) for c in rest if c != "op"])


def replay(log: DataFrame, commits: DataFrame) -> DataFrame:
    """latest() of what is committed: commits (collection_id, committed)."""
    return latest(log.join(commits, "collection_id").filter(F.col("seq") <= F.col("committed")).drop("committed"))


def truncate(log: DataFrame, points: DataFrame) -> DataFrame:
    """The log after a checkpoint: points (collection_id, base). Sequences go on as they were."""
    return log.join(points, "collection_id").filter(F.col("seq") > F.col("base")).drop("base")


def gaps(log: DataFrame) -> DataFrame:
    """Rows whose sequence is not the one before plus one, found without ordering a collection in one task: a row is
    fine if its predecessor is there or it is the first."""
    first = log.groupBy("collection_id").agg(F.min("seq").alias("low"))
    before = log.select("collection_id", (F.col("seq") + 1).alias("seq"))
    return log.join(before, ["collection_id", "seq"], "left_anti").join(first, "collection_id").filter(F.col("seq") > F.col("low")).drop("low")


def append(log: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (collection_id, n, op, doc_id, body), numbered on from the log's last sequence by their order n."""
    from pyspark.sql import Window

    last = log.groupBy("collection_id").agg(F.max("seq").alias("base"))
    n = F.row_number().over(Window.partitionBy("collection_id").orderBy("n"))
    return changes.join(last, "collection_id", "left").select("collection_id", (F.coalesce("base", F.lit(0)) + n).cast("long").alias("seq"), "op", "doc_id", "body")


def publish(segment: DataFrame, path: str) -> int:
    """Write one more generation; ids are unique within it and there is one at least."""
    spark = segment.sparkSession
    bad = segment.groupBy(*KEY).count().filter("count > 1").limit(1).count()
    if bad or not segment.limit(1).count():
        raise ValueError("a segment has each id once, and one at least")
    n = _top(spark, path) + 1
    segment.write.parquet(f"{path}/generation={n:020d}")
    return n


#: Neighbouring generations that publish_all writes in one task.
TOGETHER = 256


def publish_all(segments: DataFrame, path: str) -> int:
    """Write the segments of all generations (numbered from 1 by the column `generation`) after those that are there, in one
    job. They go to one folder, written aside, checked there and renamed whole, so that files and renames are as many as tasks, not as generations. Rows
    are in the order of generations, which neighbours share a file; ids are unique within each."""
    spark = segments.sparkSession
    base = _top(spark, path)
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    named = segments.withColumn("generation", F.col("generation").cast("long") + base)
    named.repartition(F.expr(f"generation div {TOGETHER}")).sortWithinPartitions("generation").write.parquet(aside)
    got = spark.read.schema(named.schema).parquet(aside)
    bad = got.groupBy(*KEY, "generation").count().filter(f"count > 1 or generation is null or generation <= {base}").limit(1).count()
    low, high = got.agg(F.min("generation"), F.max("generation")).first()
    fs, at = _store(spark, aside)
    if bad or high is None:
        fs.delete(at, True)
        raise ValueError("a segment has each id once, and one at least")
    name = f"packed-{low:020d}-{high:020d}"
    if not fs.rename(at, _store(spark, f"{path}/{name}")[1]):
        raise OSError(f"{name} is there already")
    return high


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """First and last generation and path of each folder: generation=N has one, packed-N-M those of one publish_all."""
    fs, at = _store(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    own = [(n, n.removeprefix("generation=").removeprefix("packed-").split("-")) for n in names if n.startswith(("generation=", "packed-"))]
    ok = [x for x in own if fs.exists(_store(spark, f"{path}/{x[0]}/_SUCCESS")[1])]  # what never ended is no generation
    return sorted((int(ends[0]), int(ends[-1]), f"{path}/{n}") for n, ends in ok)


def _top(spark: SparkSession, path: str) -> int:
    return max((last for _, last, _ in _folders(spark, path)), default=0)


def _packed(spark: SparkSession, folders: list[tuple[int, int, str]]) -> list[str]:
    return [p for _, _, p in folders if "/packed-" in p[p.rindex("/") :]]


def generations(spark: SparkSession, path: str) -> list[int]:
    folders = _folders(spark, path)
    packed = _packed(spark, folders)
    out = [n for n, _, p in folders if p not in packed]
    return sorted(out + ([r[0] for r in spark.read.parquet(*packed).select("generation").distinct().collect()] if packed else []))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    folders = _folders(spark, path)
    if not folders:
        raise ValueError(f"no generation has been published at {path}")
    packed = _packed(spark, folders)
    single = [p for _, _, p in folders if p not in packed]
    parts = [spark.read.parquet(*packed)] if packed else []
    if single:
        parts.append(spark.read.option("basePath", path).parquet(*single).withColumn("generation", F.col("generation").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def segment_documents(segments: DataFrame) -> DataFrame:
    """The documents of all generations, the latest of each, without tombstones."""
    return latest(segments, "generation")


def compact(segments: DataFrame, most: int) -> DataFrame:
    """All generations as one more if there are more than `most`, else as they are."""
    n, top = segments.agg(F.countDistinct("generation"), F.max("generation")).first()
    if n <= most:
        return segments
    return segment_documents(segments).withColumn("op", F.lit("upsert")).withColumn("generation", F.lit(top + 1).cast("long")).select(segments.columns)


def _crc32c_table() -> list[int]:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0x82F63B78 if c & 1 else c >> 1
        out.append(c)
    return out


_CRC = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def frame(kind: int, seq: int, payload: bytes = b"") -> bytes:
    """A framed log record: length, CRC32C, then kind, sequence and payload."""
    body = bytes([kind]) + struct.pack(">Q", seq) + payload
    return struct.pack(">II", len(body), crc32c(body)) + body


def decode_frames(files: DataFrame) -> DataFrame:
    """Records (path, position, kind, seq, payload) of binary logs (path, content). A torn tail ends a log; a record before
    it whose checksum fails raises."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                while at + 8 <= len(data):
                    n, crc = struct.unpack_from(">II", data, at)
                    body = data[at + 8 : at + 8 + n]
                    if len(body) < n:
                        break
                    if crc32c(body) != crc:
                        raise ValueError(f"a record of {path} is damaged at {at}")
                    rows.append((at, body[0], struct.unpack_from(">Q", body, 1)[0], body[9:]))
                    at += 8 + n
                yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "position": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "seq": pa.array([r[2] for r in rows], pa.int64()), "payload": pa.array([r[3] for r in rows], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "path string, position long, kind int, seq long, payload binary")


MAGIC, VERSION, HEADER, MOST = b"PMWAL001", 1, 20, 32 << 20
UPSERT, DELETE, COMMIT = 1, 2, 3


def log_header(base: int = 0) -> bytes:
    return MAGIC + struct.pack(">HHQ", VERSION, HEADER, base)


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string after its length as a varint, and where it ends."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("invalid string length")
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            break
    if n > MOST or at + n > len(data):
        raise ValueError("invalid string length")
    return data[at : at + n], at + n


def scan_log(data: bytes) -> tuple[list[tuple], int]:
    """The changes (seq, op, doc_id, title, body) of a whole log, and the last committed sequence. A torn tail ends it;
    anything else that is not as the format has it raises."""
    if len(data) < HEADER or data[:8] != MAGIC:
        raise ValueError("incorrect header or magic")
    version, size, last = struct.unpack_from(">HHQ", data, 8)
    if version != VERSION or size != HEADER:
        raise ValueError("unsupported version or incorrect header size")
    at, committed, rows = HEADER, last, []
    while at + 8 <= len(data):
        n, crc = struct.unpack_from(">II", data, at)
        if not 0 < n <= MOST:
            raise ValueError("invalid record size")
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            break
        if crc32c(body) != crc or n < 9:
            raise ValueError(f"a record is damaged at {at}")
        kind, seq = struct.unpack_from(">BQ", body)
        if not seq or kind not in (UPSERT, DELETE, COMMIT):
            raise ValueError("zero sequence or unknown kind")
        if kind == COMMIT:
            if n != 9 or not committed <= seq <= last:
                raise ValueError("malformed or invalid commit")
            committed = seq
        else:
            fields, end = [], 9
            for _ in range(3 if kind == UPSERT else 1):
                x, end = _string(body, end)
                fields.append(x.decode("utf-8", "replace"))
            if end != n or not fields[0].strip():
                raise ValueError("malformed change")
            if seq != last + 1:
                raise ValueError("sequences are not contiguous")
            last = seq
            rows.append((seq, "upsert" if kind == UPSERT else "delete", *fields, *[None] * (3 - len(fields))))
        at += 8 + n
    return rows, committed


def decode_log(files: DataFrame) -> DataFrame:
    """Changes (path, seq, op, doc_id, title, body, committed) of binary logs (path, content), each checked as scan_log does."""
    names = ["seq", "op", "doc_id", "title", "body"]
    types = [pa.int64(), *[pa.string()] * 4]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, committed = scan_log(data)
                cols = {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types, strict=True))}
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(rows), pa.string())} | cols | {"committed": pa.array([committed] * len(rows), pa.int64())})

    return files.select("path", "content").mapInArrow(run, "path string, seq long, op string, doc_id string, title string, body string, committed long")


def _varint(data: bytes) -> bytes:
    n, out = len(data), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + data


def encode_log(log: DataFrame, size: int) -> DataFrame:
    """Binary logs (path, content) of a gapless log (collection_id, seq, op, doc_id, body): files of `size` changes each, numbered on
    from the sequence before their first, all committed, with empty titles. Files are made from sorted rows, one at a time."""

    def close(key, rows: list[bytes], last: int) -> dict:
        base = key[1] * size
        return {"path": f"{key[0]}/{base:020d}", "content": log_header(base) + b"".join(rows) + frame(COMMIT, last)}

    def run(batches):
        key, rows, last = None, [], 0
        for batch in batches:
            done = []
            for c, seq, op, doc, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                at = (c, (seq - 1) // size)
                if at != key and key is not None:
                    done.append(close(key, rows, last))
                    rows = []
                key, last = at, seq
                fields = [doc] if op == "delete" else [doc, "", body or ""]
                rows.append(frame(DELETE if op == "delete" else UPSERT, seq, b"".join(_varint(x.encode()) for x in fields)))
            if done:
                yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("content", pa.binary())]))
        if key is not None:
            yield pa.RecordBatch.from_pylist([close(key, rows, last)], pa.schema([("path", pa.string()), ("content", pa.binary())]))

    dealt = log.withColumn("file", F.expr(f"(seq - 1) div {size}")).repartition("collection_id", "file").sortWithinPartitions("collection_id", "seq")
    return dealt.select("collection_id", "seq", "op", "doc_id", "body").mapInArrow(run, "path string, content binary")
