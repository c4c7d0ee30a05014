"""What the operators of this subpackage have in common: shared storage, null-safe columns, word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)
#: Bytes that one numpy step holds (texts are never cut: a longer text is a step of its own).
STEP_BYTES = 1 << 20
NULL_ID = -(1 << 63)
#: Bytes of the longest word that is hashed in numpy.
LONG_WORD = 512


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir). Where that is unset a local master gets a temporary folder; a cluster, whose executors would each write to a disk of their own, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="signfold-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation. Tables that df alone was read from (its attribute `spent`) are deleted."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    release(df)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(result: DataFrame) -> None:
    """Delete the intermediate tables that an operator's result reads, once the result has been used."""
    discard(*getattr(result, "spent", ()))
    result.spent = []


def ident(key: str) -> Column:
    """An id as bigint; a null one travels as NULL_ID, so that joins keep its rows, until restored()."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_ID))


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with ids by ident() and null texts as empty ones; further columns are left aside."""
    return df.select(ident(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def restored(df: DataFrame, *keys: str) -> DataFrame:
    """NULL_ID becomes null again."""
    return df.withColumns({k: F.nullif(F.col(k), F.lit(NULL_ID)) for k in keys})


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_of(df: DataFrame, partition_bytes: int = 256 << 20) -> int:
    """Partitions for the texts of df: as many as their estimated bytes need, the session's number at least. Parquet holds text in about a quarter of its bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Plans of unknown size state a huge one.
    return max(shuffle_width(df.sparkSession), min(4 * size // partition_bytes, 1 << 20) if size < 1 << 60 else 0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, row: str = "row") -> DataFrame:
    """df, written down with a number for each row. Ids can be null or repeat and scans can be dealt anew, so a row is named by the number it was written with."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


#: A key with so large a share of all rows counts as hot; there are fewer of them than its inverse.
HOT_SHARE = 0.002


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows join small, which has each of the keys once, with the rows of it as `weight`; total: the sum of weights.

    A key of more than HOT_SHARE of all rows would make one task's work. Fewer than 1 / HOT_SHARE keys can be as
    frequent, so these are broadcast whatever the size of the tables, and only rows of other keys are shuffled.
    """
    least = max(2, int(total * HOT_SHARE) + 1)
    hot = F.broadcast(small.filter(F.col(weight) >= least))
    cold = small.filter(F.col(weight) < least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how))


#: Parts of a hot key's rows.
SALTS = 64


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, least: int, by: str) -> DataFrame:
    """rows join small, which has each of the keys once. Rows of a key whose `weight` in small is `least` or more are dealt to SALTS parts by a hash of the column `by`, and the key's row of small goes to all of them.

    Both sides are read once by the join; the hot keys (fewer than the sum of weights / least) are broadcast to the rows.
    """
    salt, hot = fresh(rows, "salt"), fresh(rows, "hot")
    named = F.broadcast(small.filter(F.col(weight) >= least).select(*keys, F.lit(True).alias(hot)))
    dealt = rows.join(named, keys, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(F.col(by)), F.lit(SALTS)).cast("int")).otherwise(0)).drop(hot)
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(weight) >= least, SALTS - 1).otherwise(0))))
    return dealt.join(copied.hint("merge"), [*keys, salt]).drop(salt)


# --- UTF-8 bytes of an Arrow column ----------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Row ranges of about `most` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of about `most` bytes of the text column; a longer text is one of its own."""
    held, size = [], 0
    for batch in batches:
        at, offsets = 0, utf8(batch.column(column))[1]
        while at < batch.num_rows:
            upto = max(at + (not held), int(np.searchsorted(offsets, offsets[at] + most - size, side="right")) - 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(offsets[upto] - offsets[at])
                at = upto
            if at < batch.num_rows or size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def ragged(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and the number in each row."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


# --- packed arrays in binary columns ------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x, max_output_size=1 << 31), dtype=kind)


def packed_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences, byte plane by byte plane: the planes that are zero cost nothing."""
    steps_ = np.diff(keys, prepend=np.uint64(0))
    return packed(steps_.view(np.uint8).reshape(-1, 8).T)


def unpacked_sorted(x: bytes) -> np.ndarray:
    planes = unpacked(x, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


# --- word hashes -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[SEPARATORS] = False
#: Letters, digits and all bytes beyond ASCII.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least."""
    if len(_powers.get("up", ())) < n:
        m = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (that of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """len + 1 running sums; the hash of data[a:b] is (out[b] - out[a]) * inverse power a."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: its bytes, eight at a time, mixed into two states that begin with its length.

    A block could be chosen to undo the difference of earlier ones in one state, but not in both at once: one takes it
    by exclusive or, the other by addition, and each goes through its own mixing. Words of up to eight bytes and equal
    length never collide. Words beyond LONG_WORD bytes take BLAKE2b, so that the number of rounds stays small.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F))

    def block(live: np.ndarray, at: int) -> np.ndarray:
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        return eights[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))

    live = np.flatnonzero((size > 0) & (size <= 8))
    h[live] = mixed((h[live] ^ block(live, 0)) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x589965CC75374CC3))
    longer = live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    g, at = mixed(h + np.uint64(0xE7037ED1A0B428DB)) if len(live) else h, 0
    while len(live):
        x = block(live, at)
        h[live] = mixed((h[live] ^ x) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x589965CC75374CC3))
        g[live] = mixed((g[live] + x) * np.uint64(0x8EBC6AF09C88C6E3) ^ np.uint64(0x1D8E4E27C47D124F))
        at += 8
        live = live[size[live] > at]
    h[longer] = mixed(h[longer] + g[longer] * np.uint64(0xEB44ACCAB455D165))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = long_hash(data[starts[i] : ends[i]].tobytes())
    return h


def words(data: np.ndarray, offsets: np.ndarray, inside_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word `[^\\x20\\x09-\\x0D]+` of the texts data[offsets[i]:offsets[i + 1]], and the number of words of each text.

    A-Z are lower-cased. All separators are ASCII, so words of UTF-8 bytes are those of code points.
    inside_word: by byte, whether it belongs to a word (ALNUM for words without punctuation).
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    edges = offsets - base
    data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = inside_word[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else False
    cut = edges[:-1][edges[:-1] < n]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    ends_here = inside[:n] & ~inside[1:]
    cut = cut[cut > 0]
    ends_here[cut - 1] |= inside[cut - 1]
    ends = np.flatnonzero(ends_here) + 1
    counts = np.diff(np.searchsorted(starts, edges))
    return word_hashes(data, starts, ends), starts + base, ends + base, counts


def shingles(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the number of each; a text of fewer words is one shingle, one without words none."""
    last = np.cumsum(counts)
    size = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(counts)), size)
    at = np.arange(total) - np.repeat(ends - size, size) + (last - counts)[owner]
    stop = last[owner]
    out = np.zeros(total, dtype=np.uint64)
    twin = np.full(total, np.uint64(0xE7037ED1A0B428DB))
    for k in range(width):
        here = at + k
        word = np.where(here < stop, h[np.minimum(here, len(h) - 1)] if len(h) else np.uint64(0), np.uint64(0))
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + word + np.uint64(k + 1))
        # A second state, so that no word can undo the difference of the words before it.
        twin = mixed((twin ^ word) * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(k + 1))
    out = mixed(out + twin * np.uint64(0xEB44ACCAB455D165))
    for a, b in zip((ends - size).tolist(), ends.tolist()):
        out[a:b].sort()
    keep = np.ones(total, dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.bincount(owner[keep], minlength=len(counts))
