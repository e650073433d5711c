"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker unpacks into words at a time.
CHUNK_BYTES = 3 << 20

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode
    (tests) and an error elsewhere: the executors of a cluster do not see the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, for tables or files; forget() or release() deletes it."""
    path = f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}/{label}"
    _written[path] = spark
    return path


def forget(path: str) -> None:
    """Delete a folder of folder() that nothing reads any more."""
    spark = _written.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives the loss of executors.

    The table stays until discard() or release(), for results are lazy and may read it.
    """
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        forget(t._ledgerloom_path)


def release() -> None:
    """Delete all that materialize() wrote; results that have not been consumed are lost with it."""
    while _written:
        try:
            forget(next(iter(_written)))
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            return


atexit.register(release)


def place(names: list[str], name: str) -> int:
    """Where a column stands; as in SQL, names compare without case."""
    return names.index(name) if name in names else [n.lower() for n in names].index(name)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_batches(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """docs.mapInArrow(run, schema) for columns of any name, dots and back ticks too: by number on the way to the task, by name in it."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(lambda batches: run(b.rename_columns(names) for b in batches), schema)


def as_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[quoted(c) for c in docs.columns])


def crc_mod(col: str, m: int) -> Column:
    """crc32(col as text) mod m; null ids have no remainder."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bytes(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def appended(schema: T.StructType, new: str) -> T.StructType:
    """schema without the columns that `new` defines (names compare without case), then those of `new`."""
    own = T._parse_datatype_string(new)
    names = {f.name.lower() for f in own}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + own.fields)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: Tasks over which the rows of one hot key are dealt.
SALTS = 16
#: A key is hot if it holds more than one in HOT_SHARE of the rows, so there are at most HOT_SHARE of them.
HOT_SHARE = 2000


def followed(rows: DataFrame, n: int, *on: str) -> DataFrame:
    """rows dealt by `on` over n partitions, a number that follows the input, where fewer are set for shuffles: what a task sorts is then no
    fixed share of the input. Else rows as they are, for the planner to deal and to join to fewer."""
    return rows.repartition(n, *on) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def all_salts() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with each row of right copied to SALTS tasks, so that a hot key of left is dealt over as many. right is unique on the key."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    return left.join(right.withColumn("_salt", F.explode(all_salts())), [*on, "_salt"], how).drop("_salt")


def dealt(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """As salted(), with the rows of right copied to those tasks only that have rows of left with their key. left is read twice."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    used = left.groupBy(*on).agg(F.collect_set("_salt").alias("_salt"))
    return left.join(right.join(used, on).withColumn("_salt", F.explode("_salt")), [*on, "_salt"], how).drop("_salt")


def hot_keys(counts: DataFrame, key: str, size: str) -> list[int]:
    """The keys (numbers) that hold over a HOT_SHARE-th of all rows: at most HOT_SHARE of them, which the driver holds."""
    total = counts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return [r[0] for r in counts.where((F.col(size) * HOT_SHARE > total) & (F.col(size) > SALTS)).select(key).collect()]


def spread(left: DataFrame, right: DataFrame, on: list[str], hot: list[int]) -> DataFrame:
    """Inner join with the rows of left whose first key is hot dealt over SALTS tasks, and those of right copied there. Other keys go
    as in a plain join. Hot keys are a literal set, so no side is joined to be marked; without any, the plan is the same, with a set of one."""
    is_hot, cold = F.coalesce(F.col(on[0]).isin(hot or [0]), F.lit(False)), F.lit(0).cast("long")
    a = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(cold))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, all_salts()).otherwise(F.array(cold))))
    return a.join(b, [*on, "_salt"]).drop("_salt")


def fit_sample(docs: DataFrame, labelled: DataFrame, per_class: int, most_bytes: int, most_classes: int = 1000, seed: int = 1) -> DataFrame:
    """Rows (doc_id, text, label) to fit a classifier on: for each label the `per_class` documents that come first in the
    order of a hash of doc_id, so a sample that depends on neither layout nor order.

    labelled: (doc_id, label), without nulls. A doc_id with different labels says nothing and is left out; of a doc_id with
    several texts the one of the smallest hash stands for it; texts over `most_bytes` are passed over. Only the `most_classes`
    commonest labels count. So there are at most most_classes * per_class rows, one a doc_id, of at most most_bytes each,
    however often rows repeat.
    """
    from pyspark.sql import Window

    labelled = labelled.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other")
    labelled = labelled.select("doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)).alias("_h"))
    # A label's first hashes only: as many as are wanted and some to spare, however many rows it has.
    size = labelled.groupBy("label").agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), "label").limit(most_classes)
    near = labelled.join(F.broadcast(size), "label").where(F.col("_h") / F.lit(float(1 << 40)) * F.col("_size") <= 2 * per_class + 100)
    order = Window.partitionBy("label").orderBy("_h", "doc_id")
    ids = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class).select("doc_id", "label")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)).join(F.broadcast(ids), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), "label")


def pack(x: np.ndarray) -> bytes:
    """Numbers of up to 64 bits by byte planes, without the upper ones that are empty."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if x.size else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """pack() of the differences of ascending numbers, behind the first of them."""
    return x[:1].tobytes() + pack(np.diff(x))


def unpack_sorted(b: bytes) -> np.ndarray:
    if len(b) < 8:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(b, np.uint64, 1), unpack(b[8:])]), dtype=np.uint64)


def power_of_two(x: float) -> int:
    """The smallest power of two that is at least x."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def occupied(key: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of ascending keys of `bits` bits that share a bucket: the upper bits, for a power of two of buckets."""
    if not key.size:
        return
    own = key >> np.uint64(bits - buckets.bit_length() + 1) if buckets > 1 else np.zeros(key.size, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    yield from zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), key.size], strict=True)
