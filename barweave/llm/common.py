"""What the operators share: storage that every executor sees, words, word and window hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when the application ends. Where that is unset, a
    temporary folder in local mode; on a cluster that would be seen by one machine alone, so it is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barweave-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/barweave-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


#: Folders that the open scratches have made, the innermost last.
_SCRATCHES: list[list[str]] = []


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: cuts the lineage, survives
    lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    if _SCRATCHES:
        _SCRATCHES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """What was stored last outlives its scratch."""
    _SCRATCHES[-1].pop()
    return df


@contextmanager
def scratch(spark: SparkSession):
    """What is stored inside is removed at the end, but for what is ``kept``."""
    _SCRATCHES.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _SCRATCHES.pop():
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def commonest(counts: DataFrame, value: str, count: str, most: int) -> list[tuple]:
    """(value, count) of the ``most`` commonest values that occur more than once, from distinct values with their counts.
    Counts are compared by powers of the eighth root of two; of the values on the last level that does not fit, those with
    the least hashes are taken. The commonest come first, equals by value. What comes to the driver is a histogram of
    levels, one of 4,096 ranges of hashes, and at most ``most`` rows: unlike a sort with a limit over all values, no
    partition sends its own best ones."""
    levels = stored(counts.where(F.col(count) > 1).select(F.col(value).alias("v"), F.col(count).alias("n"), F.floor(8 * F.log2(count)).cast("int").alias("level")))
    whole, over, room = None, None, most
    for r in levels.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if r["n"] > room:
            over = r["level"]
            break
        whole, room = r["level"], room - r["n"]
    found = [] if whole is None else levels.where(F.col("level") >= whole).select("v", "n").collect()
    if over is not None and room:
        rest = levels.where(F.col("level") == over).select("v", "n", F.xxhash64("v").alias("h")).withColumn("range", F.shiftrightunsigned("h", 52))
        last, cut = -1, None
        for r in rest.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
            if r["n"] > room:
                cut = r["range"]
                break
            last, room = r["range"], room - r["n"]
        found += rest.where(F.col("range") <= last).select("v", "n").collect()
        if cut is not None and room:
            found += rest.where(F.col("range") == cut).orderBy("h", "v").limit(room).select("v", "n").collect()
    return sorted(map(tuple, found), key=lambda x: (-x[1], x[0]))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row: rows of the same id and text share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


#: Bits of the largest map that ``apart`` broadcasts.
MAP_BITS = 1 << 26


def apart(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` is surely none of ``keys``, and the others, which are few if ``keys`` are few.
    Both have one column of hashes, as longs. A bit map with 16 bits a key, MAP_BITS at most, is broadcast; nothing of
    ``rows`` is shuffled. Where more keys fill the map, more rows land among the others."""
    bits = min(MAP_BITS, 1 << (16 * keys.count() | 0xFFFF).bit_length())
    slot, bit = fresh("slot", rows), fresh("bits", rows)
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    at = F.shiftright(place, 6).cast("int")
    here = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
    filled = stored(keys.select(at.alias(slot), here.alias(bit)).groupBy(slot).agg(F.bit_or(bit).alias(bit)))
    marked = rows.withColumn(slot, at).join(F.broadcast(filled), slot, "left")  # at most MAP_BITS / 64 rows
    held = F.coalesce(F.col(bit).bitwiseAND(here), F.lit(0)) != 0
    return marked.where(~held).select(*rows.columns), marked.where(held).select(*rows.columns)


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that the operators use, named ``doc_id`` and ``text``; a null text stays null."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_RNG = np.random.default_rng(20240131)
_BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    if n:
        np.multiply.accumulate(np.full(n, base, dtype=np.uint64), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], by differences of a prefix polynomial modulo 2**64."""
    n = len(codes)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * powers(n)[:n], out=acc[1:])
    inverse = powers(n, _BASE_INV)
    return mix((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_codes(data: bytes) -> np.ndarray:
    return _BYTE_CODES[np.frombuffer(data, dtype=np.uint8)]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of the words."""
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.ones(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, dtype=np.uint8)]
    inside[0] = inside[-1] = 0
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text. A hash is a sum of mixed values of the bytes with their
    places in the word: unlike a polynomial modulo a power of two, it has no structure that words could share."""
    starts, ends = word_spans(data)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    first, last = int(starts[0]), int(ends[-1])
    place = np.arange(first, last, dtype=np.int64) - np.repeat(starts, np.diff(starts, append=last))
    values = mix(_BYTE_CODES[np.frombuffer(data, dtype=np.uint8)[first:last]] + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    acc = np.zeros(last - first + 1, dtype=np.uint64)
    np.cumsum(values, out=acc[1:])
    return starts, ends, mix(acc[ends - first] - acc[starts - first] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def map_texts(source: DataFrame, columns: str, judge, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row per row of ``source``: the ``keep`` columns as they are, then ``columns`` (a DDL list) from
    ``judge()(texts)``, which gets a list of strings (null: None) of bounded size and returns one tuple for
    each. ``judge`` builds the function once per task. Runs without a shuffle, on Arrow batches."""
    import pyarrow as pa

    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    out = source.select(*keep, text).sparkSession.createDataFrame([], columns).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        one = judge()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = one(part.column(at).to_pylist())
                made = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=[*keep, *arrow.names])

    return source.select(*keep, text).mapInArrow(run, f"{kept}, {columns}")
