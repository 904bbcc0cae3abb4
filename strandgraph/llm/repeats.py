"""Removing repeated passages by longest-previous-factor arrays, over suffixes that are dealt by their content.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or in the same
one at an earlier start. A start's longest previous factor (the longest string there that also starts earlier) is found
from suffix order: it is shared with the previous or with the next smaller position in that order. A factor of LENGTH
bytes or more is what counts, so suffixes that differ in their first LENGTH bytes needn't meet, and each task
orders the suffixes of one bucket only:

1. The LENGTH bytes at a start have an anchor, the least-ranked of their grams of GRAM bytes (leftmost among equals). Equal strings
   have equal anchors at equal distance. Neighbouring starts share anchors, so a run of up to LENGTH - GRAM + 1 starts goes as one row: hashes of the
   anchor and of the run's content (64 bits each), document, first start, number of starts.
   Grams that are frequent in a bounded sample of documents rank last, so what
   is anchored there lies in a frequent passage whole and has the same content everywhere: no anchor
   gathers a common line's many contexts. The sample decides who meets where, never what is found.
2. Of runs with equal content only the earliest stays in question; the others are copies as a whole. This is done in each task before
   the shuffle, and then by bucket of anchors. Runs whose anchor has other content, too, are contested.
3. Contested runs meet again by anchor with their bytes. Each bucket's suffixes are ordered, the
   lengths common to neighbours taken, and previous and next smaller positions tell the starts whose longest previous factor has LENGTH bytes.
4. The starts found are gathered by document and cut from the text.

Rows travel as arrays in binary columns, one for each bucket that a task has rows for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, Lookup, checkpoint, rolling, table

LENGTH, GRAM = 100, 32
#: Bytes of text hashed together; longer texts are cut into overlapping windows, whose runs end there.
WINDOW = 1 << 20
#: Runs that a task sorts together before it sends them on, and bytes of contested runs likewise.
CHUNK_RUNS, CHUNK_BYTES = 200_000, 16 << 20
#: Documents whose grams are counted to rank frequent ones last, and the bytes read of these at most. A gram that FREQUENT of so many
#: documents hold is frequent; with fewer documents, none may be.
SAMPLE_ROWS, SAMPLE_BYTES, FREQUENT = 4_000, 32 << 20, 20
#: Slots that count the sample's grams first.
SLOT_BITS = 24
#: Bytes of text for one bucket, as far as the number of buckets allows.
BUCKET_BYTES, BUCKET_BITS = 1 << 20, (10, 18)
#: A missing id comes after all others.
NO_ID = np.iinfo(np.int64).max

RUN = np.dtype([("anchor", "<u4"), ("content", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("n", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("end", "<u4")])
PART = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("n", "u1"), ("anchor", "<u8")])
KINDS = "kind int, bucket int, data binary"


def packed(rows: dict[str, np.ndarray], kind: np.dtype) -> bytes:
    """Columns one after another: these compress better than records."""
    return b"".join(np.ascontiguousarray(rows[n], kind[n]).tobytes() for n in kind.names)


def unpacked(parts: list[bytes], kind: np.dtype) -> dict[str, np.ndarray]:
    columns: dict[str, list[np.ndarray]] = {n: [] for n in kind.names}
    for part in parts:
        n, at = len(part) // kind.itemsize, 0
        for name in kind.names:
            columns[name].append(np.frombuffer(part, kind[name], n, at))
            at += n * kind[name].itemsize
    return {n: np.concatenate(c) if c else np.empty(0, kind[n]) for n, c in columns.items()}


def taken(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {n: c[which] for n, c in rows.items()}


def by_bucket(rows: dict[str, np.ndarray], bucket: np.ndarray, kind: np.dtype) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), packed(taken(rows, order[a:b]), kind)


def of_document(rows: dict[str, np.ndarray], bits: int) -> np.ndarray:
    """The bucket of each row's document."""
    h = (rows["doc"].astype(np.uint64) * MIX ^ rows["tie"].astype(np.uint64)) * MIX
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def merged(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of each document without overlaps, neighbours joined."""
    rows = taken(rows, np.lexsort((rows["start"], rows["tie"], rows["doc"])))
    if not len(rows["doc"]):
        return rows
    new = np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))
    shift = np.cumsum(new) << 32  # starts and ends stay under 2^32
    start, end = rows["start"].astype(np.int64) + shift, np.maximum.accumulate(rows["end"].astype(np.int64) + shift)
    first = np.append(True, start[1:] > end[:-1])
    last = np.append(first[1:], True)
    return taken(rows, first) | {"end": (end[last] - shift[last]).astype(np.uint32)}


# --- runs of starts that share an anchor


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of each gram of codes; grams of one repeated byte are no less random than others."""
    return rolling(codes + np.uint64(1), GRAM)


def runs(data: np.ndarray, offsets: np.ndarray, frequent: Lookup | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first start in data, number of starts) of the runs of each window of some texts laid end to end."""
    span = LENGTH - GRAM + 1
    offsets = offsets.astype(np.int64)
    for begin in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        stop = min(begin + WINDOW + LENGTH - 1, int(offsets[-1]))
        if stop - begin < LENGTH:
            return
        h = hashed(data[begin:stop].astype(np.uint64))
        place = np.arange(len(h), dtype=np.uint64)
        rank = (h >> np.uint64(23) << np.uint64(22)) | place  # a bit for rank, 41 of the hash, 22 of the place
        if frequent is not None:
            rank[frequent.find(h)[0]] |= np.uint64(1 << 63)
        least, size = rank, 1
        while size * 2 <= span:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        n = len(rank) - span + 1
        least = np.minimum(least[:n], least[span - size : span - size + n])
        anchor = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        inside = np.ones(n, bool)
        for end in offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, stop, "left")] - begin:
            inside[max(0, end - LENGTH + 1) : end] = False
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        if len(first):
            ends = np.cumsum(inside)
            count = np.diff(np.append(ends[first] - 1, ends[-1]))
            yield h[anchor[first]], first + begin, count


def frequent_grams(docs: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the grams that FREQUENT documents of a bounded sample hold, sorted."""
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    texts, size = [], 0
    for (text,) in docs.where("text is not null").sample(share, 7).select("text").limit(2 * SAMPLE_ROWS).toLocalIterator():
        texts.append(text.encode("utf-8", "surrogatepass")[: SAMPLE_BYTES - size])
        size += len(texts[-1])
        if size >= SAMPLE_BYTES:
            break
    grams = lambda text: np.unique(hashed(np.frombuffer(text, np.uint8).astype(np.uint64)))
    # Counts by a part of the hash bound the true ones from above; only grams that pass are counted by themselves.
    slots, some = np.zeros(1 << SLOT_BITS, np.uint16), []
    for text in texts:
        slots[np.unique(grams(text) >> np.uint64(64 - SLOT_BITS))] += 1
    for text in texts:
        own = grams(text)
        some.append(own[slots[own >> np.uint64(64 - SLOT_BITS)] >= FREQUENT])
    keys, count = np.unique(np.concatenate(some), return_counts=True) if some else (np.empty(0, np.uint64), np.empty(0, int))
    return keys[count >= FREQUENT]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def earliest(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """rows by anchor and content, without repeats, and which of them aren't at the earliest place of their content. Rows at
    equal places (documents that share an id) are both earliest."""
    order = np.lexsort((rows["tie"], rows["start"], rows["doc"], rows["content"], rows["anchor"]))
    rows = taken(rows, order)
    if not len(order):
        return rows, np.empty(0, bool)
    same = lambda *names: np.append(False, np.logical_and.reduce([rows[n][1:] == rows[n][:-1] for n in names]))
    rows = taken(rows, ~same("anchor", "content", "doc", "start", "tie"))
    first = np.flatnonzero(~same("anchor", "content"))
    group = np.repeat(first, np.diff(np.append(first, len(rows["doc"]))))
    return rows, (rows["doc"] != rows["doc"][group]) | (rows["start"] != rows["start"][group])


def covered(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    start = rows["start"]
    return merged({"doc": rows["doc"], "tie": rows["tie"], "start": start, "end": start + rows["n"].astype(np.uint32) + np.uint32(LENGTH - 1)})


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bucket", "data"])


def cut_into_runs(frequent: np.ndarray, bits: int) -> Callable:
    """doc, tie, text to kind 0: runs by bucket of anchors; kind 1: spans of copies within what a task sorts together, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Lookup(frequent) if len(frequent) else None
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            rows = {n: np.concatenate([h[n] for h in held]) for n in ("anchor", "content", "doc", "tie", "start", "n")}
            rows, copies = earliest(rows)
            spans = covered(taken(rows, copies))
            out = [(1, *x) for x in by_bucket(spans, of_document(spans, bits), SPAN)]
            rows = taken(rows, ~copies)
            bucket = (rows["anchor"] >> np.uint64(64 - bits)).astype(np.int32)
            short = rows | {"anchor": (rows["anchor"] >> np.uint64(32 - bits)).astype(np.uint32)}
            return batch_of(out + [(0, *x) for x in by_bucket(short, bucket, RUN)])

        for batch in batches:
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = buffers(batch.column(2))
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            for anchor, start, n in runs(data, offsets, ranks):
                ends = start + n + (LENGTH - 1)
                content = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), ends.tolist())), np.uint64, len(start))
                which = np.searchsorted(offsets, start, "right") - 1
                held.append({"anchor": anchor, "content": content, "doc": doc[which], "tie": tie[which], "start": (start - offsets[which]).astype(np.uint32), "n": n.astype(np.uint8)})
                count += len(start)
                if count >= CHUNK_RUNS:
                    yield sent()
                    held, count = [], 0
        if count:
            yield sent()

    return run


def gathered_by(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """Rows sorted by their first columns: (key, data) of each key."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(keys + 1)]
        for *key, data in zip(*columns):
            if tuple(key) != now:
                if held:
                    yield now, held
                now, held = tuple(key), []
            held.append(data)
    if held:
        yield now, held


def resolved(bits: int) -> Callable:
    """Runs of a bucket of anchors to kind 1: spans of copies, and kind 2: contested runs, both by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), parts in gathered_by(batches, 2):
            if kind == 1:
                yield batch_of([(1, bucket, part) for part in parts])
                continue
            rows, copies = earliest(unpacked(parts, RUN))
            spans = covered(taken(rows, copies))
            out = [(1, *x) for x in by_bucket(spans, of_document(spans, bits), SPAN)]
            rows = taken(rows, ~copies)
            if len(rows["doc"]):
                first = np.flatnonzero(np.append(True, rows["anchor"][1:] != rows["anchor"][:-1]))
                size = np.diff(np.append(first, len(rows["doc"])))
                differ = np.append(0, np.cumsum(rows["content"][1:] != rows["content"][:-1]))
                several = differ[first + size - 1] != differ[first]
                rows = taken(rows, np.repeat(several, size))
                rows["anchor"] = (np.uint64(bucket) << np.uint64(32)) | rows["anchor"]
                out += [(2, *x) for x in by_bucket(rows, of_document(rows, bits), PART)]
            if out:
                yield batch_of(out)

    return run


def by_document(kind: np.dtype) -> Callable:
    """Rows of a bucket of documents to one row for each document: doc, tie, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in gathered_by(batches, 1):
            rows = unpacked(parts, kind)
            rows = merged(rows) if kind is SPAN else taken(rows, np.lexsort((rows["start"], rows["tie"], rows["doc"])))
            new = np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))
            cuts = np.flatnonzero(new)
            data = [packed(taken(rows, slice(a, b)), kind) for a, b in zip(cuts, [*cuts[1:], len(new)])]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc"][cuts]), pa.array(rows["tie"][cuts]), pa.array(data, pa.binary())], names=["doc", "tie", "data"])

    return run


# --- suffix order


def earlier(common: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Whether the longest previous factor of each suffix has `least` bytes or more.

    common: bytes that each suffix shares with the one before it in suffix order; place: ranks of positions, equal for equal places. The longest previous factor is shared
    with the previous or the next smaller position in suffix order; it is that long if one of these is reached over
    common lengths of `least` or more, which running minima from both sides show.
    """
    group = np.cumsum(common < least)
    n = len(place) + 1
    forth = np.minimum.accumulate(place + (group[-1] - group) * n) - (group[-1] - group) * n
    back = (np.minimum.accumulate((place + group * n)[::-1]) - (group * n)[::-1])[::-1]
    return (forth < place) | (back < place)


def factors(text: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at each place `at` of text also start at a smaller place."""
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]
    order = np.argsort(windows.view(f"S{LENGTH}").ravel(), kind="stable")
    windows = windows[order]
    same = windows[1:] == windows[:-1]
    common = np.append(0, np.where(same.all(1), LENGTH, same.argmin(1)))
    out = np.empty(len(at), bool)
    out[order] = earlier(common, place[order], LENGTH)
    return out


def with_bytes(bits: int) -> Callable:
    """data (contested runs of a document), text to the runs with their bytes by bucket of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, list[bytes]]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            rows = {n: np.concatenate([h[n] for h, _ in held]) for n in PART.names}
            texts = [t for _, ts in held for t in ts]
            bucket = (rows["anchor"] >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                part = packed(taken(rows, order[a:b]), PART)
                out.append((0, int(bucket[order[a]]), len(part).to_bytes(8, "little") + part + b"".join(texts[i] for i in order[a:b].tolist())))
            return batch_of(out)

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, part in enumerate(batch.column(0).to_pylist()):
                rows = unpacked([part], PART)
                begin = rows["start"].astype(np.int64) + int(offsets[i])
                ends = begin + rows["n"] + (LENGTH - 1)
                held.append((rows, [data[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist())]))
                size += int((ends - begin).sum())
                if size >= CHUNK_BYTES:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return run


#: Starts whose suffixes are ordered together; those of one anchor always are.
TOGETHER = 200_000


def compared(bits: int) -> Callable:
    """Runs with their bytes to spans whose longest previous factor has LENGTH bytes, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in gathered_by(((b.select([1, 2])) for b in batches), 1):
            sizes = [int.from_bytes(p[:8], "little") for p in parts]
            rows = unpacked([p[8 : 8 + n] for p, n in zip(parts, sizes)], PART)
            text = np.frombuffer(b"".join(p[8 + n :] for p, n in zip(parts, sizes)), np.uint8)
            n = rows["n"].astype(np.int64)
            begin = np.append(0, np.cumsum(n + LENGTH - 1))[:-1]
            order = np.argsort(rows["anchor"], kind="stable")
            ends = np.cumsum(n[order])
            last = np.append(rows["anchor"][order][1:] != rows["anchor"][order][:-1], True)
            a, found = 0, []
            while a < len(order):
                b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right"))
                b += int(np.argmax(last[b:])) + 1 if b < len(order) else 0
                own = order[a : min(b, len(order))]
                run_of = np.repeat(own, n[own])
                step = np.arange(len(run_of)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                start = rows["start"][run_of].astype(np.int64) + step
                sorted_by = np.lexsort((start, rows["doc"][run_of]))
                place = np.empty(len(start), np.int64)
                moved = np.append(True, (np.diff(start[sorted_by]) != 0) | (np.diff(rows["doc"][run_of][sorted_by]) != 0))
                place[sorted_by] = np.cumsum(moved) - 1
                hit = factors(text, begin[run_of] + step, place)
                found.append(merged({"doc": rows["doc"][run_of][hit], "tie": rows["tie"][run_of][hit], "start": start[hit].astype(np.uint32), "end": (start[hit] + LENGTH).astype(np.uint32)}))
                a = b
            spans = {name: np.concatenate([f[name] for f in found]) for name in SPAN.names}
            if len(spans["doc"]):
                yield batch_of([(1, *x) for x in by_bucket(spans, of_document(spans, bits), SPAN)])

    return run


# --- the operator


def keyed(docs: DataFrame, id_col: str, text_col: str, unique: bool) -> DataFrame:
    """doc, tie, text: documents that share an id are told apart by a hash of their texts."""
    tie: Column = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(text_col, F.lit("")))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), tie.alias("tie"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, tie, text of docs; doc, tie, data with the spans of documents that lose any)."""
    plain = keyed(docs, id_col, text_col, True)
    rows, size = plain.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    unique = plain.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows_of = keyed(docs, id_col, text_col, unique)
    bits = min(max(int(np.ceil(np.log2(max(size or 0, 1) / BUCKET_BYTES + 1))), BUCKET_BITS[0]), BUCKET_BITS[1])
    frequent = frequent_grams(plain, rows)
    long = rows_of.where(F.octet_length("text") >= LENGTH)
    dealt = long.mapInArrow(cut_into_runs(frequent, bits), KINDS).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    first = checkpoint(dealt.mapInArrow(resolved(bits), KINDS))
    per_doc = lambda found, kind: found.select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_document(kind), "doc long, tie long, data binary")
    contested = per_doc(first.where("kind = 2"), PART)
    parts = contested.join(long.distinct() if not unique else long, ["doc", "tie"]).select("data", "text").mapInArrow(with_bytes(bits), KINDS)
    second = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compared(bits), KINDS)
    return rows_of, per_doc(first.where("kind = 1").union(second), SPAN)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, kept (the text's remaining bytes), n_bytes, n_removed, spans (array of start, end: the
    maximal runs removed, in bytes of the text).

    Ids are integers; a null id counts as larger than all others. Rows that share an id are one document for the order of
    places: of strings in two such rows the one at the smaller start is earlier, and at equal starts neither is. So repeated rows lose
    the same bytes. Null, empty and short texts lose nothing. Texts of any length are read whole. An empty table gives an
    empty result; other columns of docs are left aside.
    """
    rows_of, found = repeated_spans(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            kept, sizes, gone, spans = [], [], [], []
            for i, part in enumerate(batch.column(2).to_pylist()):
                own, size = data[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])
                rows = unpacked([part] if part else [], SPAN)
                stay = np.ones(size, bool)
                for a, b in zip(rows["start"].tolist(), rows["end"].tolist()):
                    stay[a:b] = False
                kept.append(own[stay].tobytes())
                sizes.append(size)
                gone.append(size - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in zip(rows["start"].tolist(), rows["end"].tolist())])
            columns = [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "kept", "n_bytes", "n_removed", "spans"])

    joined = rows_of.join(found, ["doc", "tie"], "left").select("doc", "text", "data")
    out = joined.mapInArrow(run, "doc long, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>")
    return out.withColumn("doc", F.nullif("doc", F.lit(int(NO_ID)))).withColumnRenamed("doc", id_col)


def op13_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op13_previous_factors": op13_previous_factors}
SQL = {
    "op13_previous_factors": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID}) AS d, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, d, s, b[s:s + {LENGTH - 1}] AS string FROM (SELECT r, d, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS s FROM docs)),
firsts AS (SELECT string, min((d, s)) AS place FROM starts GROUP BY string HAVING count(*) > 1),
later AS (SELECT r, s, s > lag(s, 1, -{LENGTH + 1}) OVER (PARTITION BY r ORDER BY s) + {LENGTH} AS opens FROM starts JOIN firsts USING (string) WHERE (d, s) > place),
spans AS (SELECT r, min(s) AS a, max(s) + {LENGTH} AS z FROM (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM later) GROUP BY r, k),
pieces AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS x, a - 1 AS y, z - a AS gone, 1 AS n FROM spans
  UNION ALL SELECT r, coalesce(max(z), 1), NULL, 0, 0 FROM docs LEFT JOIN spans USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, sum(gone)::BIGINT AS n_removed, sum(n)::BIGINT AS n_spans,
  sha256(unhex(string_agg(hex(b[x:coalesce(y, octet_length(b))]), '' ORDER BY x, y NULLS LAST))) AS kept_sha256
FROM docs JOIN pieces USING (r) GROUP BY r, doc_id, b
"""
}
