"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators.graph import connected_components, cut, gathered, shared_folder

__all__ = ["checkpoint", "connected_components", "gathered", "shared_folder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


checkpoint = cut


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(docs: DataFrame, text_col: str, passed: dict[str, str], start: Callable[[], Callable], made: str) -> DataFrame:
    """Rows made from texts, with columns of docs passed on (new name: name) unchanged, nulls and all.

    start() is called once in each task; what it returns gets a list of texts, a batch at
    a time, and returns (which text each new row is of, or None for one row each; one
    sequence for each column of `made`).
    """
    source = docs.select(*[F.col(old).alias(f"p{i}") for i, old in enumerate(passed.values())], F.col(text_col).alias("t"))
    new = StructType.fromDDL(made)
    schema = StructType([*(f for f in docs.select(*[F.col(old).alias(name) for name, old in passed.items()]).schema), *new])
    kinds = [to_arrow_type(f.dataType) for f in new]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            which, columns = work(batch.column(len(passed)).to_pylist())
            old = [batch.column(i) for i in range(len(passed))]
            if which is not None:
                old = [c.take(pa.array(which, pa.int64())) for c in old]
            new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=names)

    return source.mapInArrow(run, schema)


def keep_texts(docs: DataFrame, text_col: str, start: Callable[[], Callable[[list], Sequence[bool]]]) -> DataFrame:
    """The rows of docs, unchanged, whose texts the function that start() returns keeps."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 1_000_003


def fold_table() -> np.ndarray:
    """Code point to lower-case letter or digit, everything else to a space; 0 stays 0."""
    fold = np.full(65536, 32, np.uint32)
    for i in range(1, 65536):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            fold[i] = ord(low) if len(low) == 1 else i
    fold[0] = 0
    return fold


_FOLD: list[np.ndarray] = []


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits of text, lower case, each run of other
    characters as one space; and the place in text of each."""
    if not _FOLD:
        _FOLD.append(fold_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _FOLD[0][np.minimum(codes, 65535)]
    high = codes > 65535
    if high.any():
        low = np.where(high, codes, low)
    gap = low == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    places = np.flatnonzero(keep)
    return low[places], places


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n codes, by doubling."""
    codes = codes.astype(np.uint64)
    if len(codes) < n:
        return np.empty(0, np.uint64)
    powers, sizes = {1: codes}, [1]
    while sizes[-1] * 2 <= n:
        s = sizes[-1]
        h = powers[s]
        powers[2 * s] = h[:-s] * np.uint64(pow(BASE, s, 2**64)) + h[s:]
        sizes.append(2 * s)
    count, out, at = len(codes) - n + 1, None, 0
    for s in reversed(sizes):
        if at + s <= n:
            part = powers[s][at : at + count]
            out = part if out is None else out * np.uint64(pow(BASE, s, 2**64)) + part
            at += s
    out = out * MIX
    return out ^ (out >> np.uint64(31))


def rolling_up(codes: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """rolling() for increasing sizes, each built on the one before."""
    codes = codes.astype(np.uint64)
    h, n = codes, 1
    for size in sizes:
        while n < size:
            h = h[:-1] * np.uint64(BASE) + codes[n:] if len(h) else h
            n += 1
        out = h * MIX
        yield out ^ (out >> np.uint64(31))


#: Characters of text looked at together; longer texts are cut into overlapping windows.
WINDOW = 1 << 20


def windows(texts: list[str], overlap: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Texts joined by NUL to windows: (which text, offset in it, place in the window) of each part, window."""
    parts, pieces, size = [], [], 0
    for which, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - overlap), WINDOW):
            piece = text[offset : offset + WINDOW + overlap]
            if size and size + len(piece) > WINDOW + overlap:
                yield parts, "\x00".join(pieces)
                parts, pieces, size = [], [], 0
            parts.append((which, offset, size))
            pieces.append(piece)
            size += len(piece) + 1
    if parts:
        yield parts, "\x00".join(pieces)


class Lookup:
    """Finds which hashes are among sorted keys: a bitmap first, then binary search."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(keys * MIX) >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that hit, and the index of the key hit at each."""
        places = np.flatnonzero(self.bitmap[(hashes * MIX) >> self.shift])
        if not len(places) or not len(self.keys):
            return places[:0], places[:0]
        got = hashes[places]
        at = np.minimum(np.searchsorted(self.keys, got), len(self.keys) - 1)
        same = self.keys[at] == got
        return places[same], at[same]
