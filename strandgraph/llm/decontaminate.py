"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most k edits shares at least
m - q + 1 - k*q of its q-grams with the place where it occurs, all of them on
diagonals that lie within k of one another. So: count shared q-grams in overlapping
bands of diagonals, keep the bands that reach the item's bound, and verify each by
banded alignment. q is 8, or the length over one more than the edits, rounded down, where that is less: the bound is 1 or more then;
items of under 8 characters have no edits to spend and are looked for as they are.

Both sides are compared as lower-case letters and digits, with one space for each
run of anything else. The benchmark is a query set; it is taken in blocks of at most
`block_chars` characters, each sent to all tasks, so its size may grow without limit.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, folded, keep_texts, map_texts, rolling, table, windows

Q, ERROR_RATE, MIN_CHARS = 8, 0.1, 1
BLOCK_CHARS = 4_000_000
#: Shared q-grams looked at together; a window that has more is halved.
HITS = 1 << 22


def trimmed(text: str | None) -> np.ndarray:
    """Folded codes of an item without a space at either end."""
    codes = folded((text or "").replace("\x00", " "))[0]
    return codes[int(len(codes) and codes[0] == 32) : len(codes) - int(len(codes) > 1 and codes[-1] == 32)]


def item_blocks(items: list[tuple[object, str]], q: int, error_rate: float, min_chars: int) -> list[ItemBlock]:
    """The items in blocks of one q each: the largest up to q at which the lemma's bound is 1 or more."""
    by_q: dict[int, list[tuple[object, np.ndarray, int]]] = {}
    for item_id, text in items:
        codes = trimmed(text)
        edits = int(len(codes) * error_rate)
        if len(codes) >= max(1, min_chars):
            by_q.setdefault(min(q, len(codes) // (edits + 1)), []).append((item_id, codes, edits))
    return [ItemBlock(own, size) for size, own in sorted(by_q.items())]


class ItemBlock:
    """q-grams of items, with where they occur, and each item's bounds."""

    def __init__(self, items: list[tuple[object, np.ndarray, int]], q: int):
        self.q, self.ids, self.codes = q, [x[0] for x in items], [x[1] for x in items]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([x[2] for x in items], np.int64)
        self.least = m - q + 1 - self.edits * q
        self.stride = np.maximum(self.edits, 8)
        self.longest = int((m + 4 * self.stride).max())
        grams = [rolling(c, q) for c in self.codes]
        every = np.concatenate(grams)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(every, kind="stable")
        keys, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.lookup, self.first, self.count = Lookup(keys), first, count
        self.item, self.place = item[order], place[order]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of the bands whose count of shared q-grams reaches the item's bound."""
        at, key = self.lookup.find(rolling(codes, self.q))
        if not len(at):
            return []
        n = self.count[key]
        if n.sum() > HITS and len(codes) > 8 * self.longest:
            half, lap = len(codes) // 2, 2 * self.longest
            right = [(item, d + half - lap) for item, d in self.bands(codes[half - lap :])]
            return list(dict.fromkeys([*self.bands(codes[: half + lap]), *right]))
        hit = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[hit]
        band = (np.repeat(at, n) - self.place[hit]) // self.stride[item]
        cells = item * (1 << 32) + band + (1 << 31)
        # Bands are two strides wide, one stride apart. Counts in a small table bound the
        # true ones from above; only what passes is sorted.
        cells = np.concatenate([cells, cells - 1])
        slot = ((cells * 0x9E3779B97F4A7C1) >> 11) & 0xFFFFF
        some = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= self.least[cells >> 32])
        # Each place of the item counts once, however often the band repeats its q-gram.
        cells, place = cells[some], self.place[hit][some % len(hit)]
        order = np.lexsort((place, cells))
        cells, place = cells[order], place[order]
        new = np.ones(len(cells), bool)
        new[1:] = (cells[1:] != cells[:-1]) | (place[1:] != place[:-1])
        cells, n = np.unique(cells[new], return_counts=True)
        item = cells >> 32
        keep = n >= self.least[item]
        item, band = item[keep], (cells[keep] & 0xFFFFFFFF) - (1 << 31)
        return list(zip(item.tolist(), (band * self.stride[item]).tolist(), strict=True))

    def align(self, codes: np.ndarray, item: int, diagonal: int) -> list[tuple[int, int, int]]:
        """(edits, start, end) of the best place of the item in the band that begins at a diagonal, or of all places that equal it; none beyond its edit budget."""
        want, k, stride = self.codes[item], int(self.edits[item]), int(self.stride[item])
        begin, out = max(0, diagonal - k), []
        there, sought, size = codes[begin : max(0, diagonal + 2 * stride + k + len(want))].tobytes(), want.tobytes(), codes.itemsize
        at = there.find(sought)
        while at >= 0:
            if at % size == 0:
                out.append((0, begin + at // size, begin + at // size + len(want)))
            at = there.find(sought, at + (1 if at % size else len(sought)))
        if out:
            return out
        found = banded(want, codes, diagonal - k, 2 * stride + 2 * k + 1, 0, k) if k else None
        if found is None:
            return []
        edits, end = found
        begin = max(0, end - len(want) - k)
        back = banded(want[::-1], codes[begin:end][::-1], -k, 2 * k + 1, None, k)
        start = end - back[1] if back else begin
        return [(edits, start, end)] if end > start else []


def banded(want: np.ndarray, codes: np.ndarray, low: int, width: int, start: int | None, budget: int) -> tuple[int, int] | None:
    """Least edits that turn want into a run of codes, with its end (the smallest), along diagonals
    low to low + width - 1; None beyond the budget. start 0: the run may start anywhere; None: at 0."""
    far = len(want) + len(codes) + 1
    steps = np.arange(width)
    padded = np.full(len(want) + width, -1, np.int64)
    a, b = max(0, low), min(len(codes), low + len(padded))
    if a >= b:
        return None
    padded[a - low : b - low] = codes[a:b]
    inside = low >= 0 and low + len(want) + width <= len(codes)
    column = low + steps
    row = np.where((column >= 0) & (column <= len(codes)), column if start is None else 0, far)
    for i, c in enumerate(want):
        step = row + (padded[i : i + width] != c)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        if not inside:
            column = low + i + 1 + steps
            out = (column < 0) | (column > len(codes))
            step[out] = far
        row = np.minimum.accumulate(step - steps) + steps
        if not inside:
            row[out] = far
        if i & 7 == 7 and row.min() > budget:  # it never falls again
            return None
    at = int(row.argmin())
    return (int(row[at]), int(low + len(want) + at)) if row[at] <= budget else None


def matches_in(texts: list[str], blocks: list[ItemBlock]) -> list[tuple[int, object, int, int, int]]:
    """(which text, item id, start, end, edits) of every place; places of an item that overlap give the best one."""
    found: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    lap = 4 * max((b.longest for b in blocks), default=0)
    for parts, window in windows([t.replace("\x00", " ") if "\x00" in t else t for t in texts], lap) if blocks else ():
        codes, places = folded(window)
        ends = np.append(np.flatnonzero(codes == 0), len(codes))
        starts = np.append(0, ends[:-1] + 1)
        for number, block in enumerate(blocks):
            for item, diagonal in block.bands(codes):
                stride, edits = int(block.stride[item]), int(block.edits[item])
                low = max(0, diagonal - edits)
                high = diagonal + 2 * stride + edits + len(block.codes[item])
                for part in range(np.searchsorted(ends, low), min(len(parts), np.searchsorted(starts, high, "right"))):
                    a, b = int(starts[part]), int(ends[part])
                    for n, s, e in block.align(codes[a:b], item, diagonal - a):
                        which, offset, base = parts[part]
                        first, last = int(places[s + a]) - base + offset, int(places[e + a - 1]) + 1 - base + offset
                        found.setdefault((which, number, item), []).append((n, first, last))
    out = []
    for (which, number, item), hits in found.items():
        taken: list[tuple[int, int]] = []
        for edits, s, e in sorted(set(hits)):
            if all(e <= x or s >= y for x, y in taken):
                taken.append((s, e))
                out.append((which, blocks[number].ids[item], s, e, edits))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", q: int = Q, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every place where an item occurs with at most error_rate edits a character: id, item_id, start, end
    (code points of the text, end exclusive), edits.

    Null and empty texts and items match nothing; so do items without a letter or digit, and those of
    under min_chars letters, digits and gaps, where that is set higher: short items prove little.
    A repeated document row gives its matches again, a repeated item matches under each of its
    ids, a null id under null. Of equally good overlapping places the first stays. Texts of any length are read whole.
    """
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    made = f"item_id {item_kind}, start int, end int, edits int"
    out = None
    for items in _blocks(benchmark, item_col, item_text, block_chars):
        blocks = item_blocks(items, q, error_rate, min_chars)

        def start(blocks: list[ItemBlock] = blocks):
            def work(texts):
                hits = matches_in([t or "" for t in texts], blocks)
                which, *columns = zip(*hits, strict=True) if hits else [()] * 5
                return which, columns

            return work

        found = map_texts(docs, text_col, {id_col: id_col}, start, made)
        out = found if out is None else out.union(found)
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    q: int = Q, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs without the rows whose text holds an item. Each row is judged by its own text, so null and repeated ids make no difference."""
    for items in _blocks(benchmark, item_col, item_text, block_chars):
        blocks = item_blocks(items, q, error_rate, min_chars)

        def start(blocks: list[ItemBlock] = blocks):
            def clean(texts):
                hit = {h[0] for h in matches_in([t or "" for t in texts], blocks)}
                return [i not in hit for i in range(len(texts))]

            return clean

        docs = keep_texts(docs, text_col, start)
    return docs


def op1_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_qgram_decontamination": op1_qgram_decontamination}
SQL: dict[str, str] = {}
