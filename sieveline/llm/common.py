"""What the corpus operators share: the shared folder, sizing, and numpy hashing of words and windows."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import secrets
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.session import shared_dir, ship

#: Fixed: white space of the contracts, as a Java or RE2 character class and as bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For tables of a few large rows that don't compress: one row a page, row groups of 32 MB, no buffers for compression.
LARGE_ROWS = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that lineage ends and lost executors cost no upstream work.

    Shuffle files of the write are removed once it has ended, where this Spark offers that.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/sieveline/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    for scope in _scopes:
        scope.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables saved inside are deleted at the end, less those taken out of the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        forget(*made)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of that column, which clashes with none.

    Rows of stored files are numbered by file and place in it, so they keep their numbers however a later read splits the
    files. A file's part of the number is a hash of its path; the driver gets these hashes to see that all differ. Another
    table is written with its numbers first.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    try:
        meta = docs.metadataColumn("_metadata")
        path, index = meta["file_path"], meta["row_index"]
        paths = docs.select(path.alias("path"), index.alias("index")).select("path").distinct().cache()  # formats without places fail here
    except AnalysisException:
        return save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    try:
        bits = 2 * max(1, paths.count()).bit_length() + 2
        for seed in range(100):
            slot = lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), 64 - bits)  # noqa: B023, E731
            slots = [r[0] for r in paths.select(slot("path")).collect()]
            if len(set(slots)) == len(slots):
                break
    finally:
        paths.unpersist()
    most = 1 << 63 - bits
    checked = F.when(index < most, index).otherwise(F.raise_error(F.lit(f"a file of more than {most} rows")).cast("long"))
    return docs.withColumn(name, F.shiftleft(slot(path), 63 - bits) + checked), name


def forget(*tables: DataFrame) -> None:
    """Delete tables made by save() that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes in a text column (one scan of that column)."""
    ship(docs.sparkSession)
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def parts_for(total: int, per: int, least: int = 12) -> int:
    """Number of buckets so that each holds about `per` of `total`."""
    return max(least, -(-int(total) // per))


def block_of(doc_id: Column, n: int) -> Column:
    """A bucket of a long id, as block_of_np computes it; null goes to bucket 0."""
    return F.coalesce(F.pmod(F.shiftright(F.pmod(doc_id, F.lit(2147483647)) * F.lit(2654435761), 15), F.lit(n)), F.lit(0)).cast("int")


def block_of_np(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids % 2147483647) * 2654435761 >> 15) % n


# --- numpy hashing ---------------------------------------------------------------------------

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BASES = [int(x) * 8 + 5 for x in _SEED.integers(2**58, 2**60, 4, dtype=np.uint64)]
_STARTS = _SEED.integers(0, 2**64, 4, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond this many bytes are hashed one by one.
_SHORT_WORD = 64
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """b**0 .. b**(n-1) modulo 2**64, of a base or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASES[which] % 2**64
        base = pow(base, -1, 2**64) if inverse else base
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hashes of values[lo:hi], for many ranges at once."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(which, len(values)), out=total[1:])
    return mix((total[hi] - total[lo]) * _power(which, len(values) + 1, True)[lo] + (hi - lo).astype(np.uint64))


def trim() -> None:
    """Give memory that a task no longer uses back to the system, as Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, rows + 1) of a string array; null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32, len(arr) + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    data = arr.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def new_key() -> int:
    """A secret for word hashes: nobody who writes a text knows it, so no text can hold words made to collide."""
    return secrets.randbits(63)


def _word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, family: int, key: int = 0) -> np.ndarray:
    """64-bit hashes of the words data[lo:hi] under a key; families are independent of each other.

    Eight bytes at a time go through a bijective mix, so words of up to eight bytes and one length never collide. Longer words that
    collide can be computed by those who know the key, which is why operators draw one for each run (see new_key).
    """
    start, base = (int(mix(np.array([x ^ key * 0x9E3779B97F4A7C15 % 2**64], np.uint64))[0]) if key else x for x in (int(_STARTS[family]), _BASES[family]))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = hi - lo
    h = mix(np.uint64(start) ^ size.astype(np.uint64))
    at, left = np.arange(len(lo)), size
    for k in range(0, _SHORT_WORD, 8):
        chosen = (left > k) & (size[at] <= _SHORT_WORD)
        at, left = at[chosen], left[chosen]
        if not len(at):
            break
        h[at] = mix((h[at] ^ (eight[lo[at] + k] & _FIRST_BYTES[np.minimum(left - k, 8)])) * np.uint64(base | 1))
    for i in np.flatnonzero(size > _SHORT_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[lo[i] : hi[i]].tobytes(), digest_size=8, salt=bytes([family]), key=key.to_bytes(8, "little")).digest(), "little")
    return h


def _words(data: np.ndarray, starts_at: np.ndarray, lower: bool, families: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (a row for each family) and start of every word of data; a text begins at each of starts_at."""
    black = ~_IS_SPACE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    begin = starts_at[starts_at < len(data)]
    first[begin] = black[begin]
    last = black.copy()
    last[:-1] &= ~black[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    data = _LOWER[data] if lower else data
    return np.stack([_word_hashes(data, lo, hi, f, key) for f in range(families)]), lo


def word_chunks(arr: pa.Array, lower: bool = False, size: int = 4 << 20, families: int = 1, key: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, 64-bit hash of each word, number of words of each row) for runs of rows of about `size` bytes.

    With several families the hashes have a row for each. A single longer text is one run. Runs are hashed in pieces of a
    megabyte or two, cut at white space.
    """
    data, offsets = text_buffers(arr)
    piece = min(size, 1 << 20)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        found, at, lo = [], [], int(offsets[row])
        while lo < offsets[end]:
            hi = int(offsets[end])
            if hi - lo > 2 * piece:
                cut = lo + piece
                while cut < hi and not _IS_SPACE[data[cut]]:
                    cut += 1
                hi = cut
            inside = offsets[row:end]
            h, p = _words(data[lo:hi], inside[(inside >= lo) & (inside < hi)] - lo, lower, families, key)
            found.append(h)
            at.append(p + lo)
            lo = hi
        h = np.concatenate(found, 1) if found else np.zeros((families, 0), np.uint64)
        p = np.concatenate(at) if at else np.zeros(0, np.int64)
        yield row, end, h if families > 1 else h[0], np.diff(np.searchsorted(p, offsets[row : end + 1]))
        row = end


def windows(words: np.ndarray, counts: np.ndarray, n: int, which: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index of the first word, hash) of every run of n words inside one row."""
    per = np.maximum(counts - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), per)
    before = np.cumsum(counts) - counts
    start = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per) + before[rows]
    return rows, start, _ranges(words, start, start + n, which)


# --- packed arrays ---------------------------------------------------------------------------


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences of the least whole bytes that hold them."""
    if not len(x):
        return b""
    gaps = np.diff(x, prepend=x[:1])
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([width]) + int(x[0]).to_bytes(8, "little") + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width, first = b[0], int.from_bytes(b[1:9], "little")
    n = (len(b) - 9) // width
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(b, np.uint8, n * width, 9).reshape(n, width)
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)


def pack_small(x: np.ndarray) -> bytes:
    """Non-negative numbers as 1, 2, 4 or 8 bytes each."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpack_small(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", -1, 1)


def range_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where, in ascending 64-bit keys, each of `parts` equal ranges begins and the last one ends."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def to_sortable(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def from_sortable(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)
