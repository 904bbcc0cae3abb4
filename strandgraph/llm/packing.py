"""Best-fit packing with certified bounds.

Pieces of documents are dealt over partitions and packed best-fit decreasing. Dual
feasible functions give each partition a lower bound on its number of bins. While
partitions need more bins than their bounds, the documents of their bins that aren't
full are exchanged: dealt anew over fewer partitions, packed again, and the result is
taken if it needs fewer bins; this ends when the bounds are met or an exchange saves no bin.
`certificate` then holds the number of sequences against the bound of all pieces together.
Each packing task holds lengths and row numbers, never texts, of a bounded number of pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, table

CAPACITY, END_ID = 1024, 2
#: Pieces packed in one task.
PER_TASK = 20_000
#: Memory bound of the cache of encoded words of a task; when full it starts anew.
CACHE_WORDS = 300_000

_GAP_BEFORE_GAP = re.compile(r" \s")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    The pre-tokenizer always begins a new piece at a space before a character that isn't
    white space, so the ids of such stretches are looked up one by one, and only new words are
    encoded: in long stretches that are cut again where an id begins with a space, by a
    merging table over the file's own vocabulary, whose ids are the ranks of its merges.
    Texts with a space before white space, and texts that hold an added token, are encoded
    whole by the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        letters = byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.merging = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def _words(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.merging.encode_ordinary(" " + " ".join(part)), "<u4")
            cuts = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            whole = ids.tobytes()
            for word, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
                self.cache[word] = whole[4 * a : 4 * b]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if t[:1] == " " or t[-1:] == " " or _GAP_BEFORE_GAP.search(t) or self.added.search(t)]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        words = {i: t.split(" ") for i, t in enumerate(texts) if out[i] is None and t}
        missing: set[str] = set()
        for w in words.values():
            missing.update(w[1:])
        self._words([x for x in missing if x not in self.cache])
        first = self._encode([w[0] for w in words.values()])
        for (i, w), head in zip(words.items(), first, strict=True):
            out[i] = head + b"".join(map(self.cache.__getitem__, w[1:]))
        return [x or b"" for x in out]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each text and its end token: id, piece, start, length, ids_crc32 and, if asked for, ids (binary).

    Only documents longer than the capacity are cut, into full pieces; the first piece may be shorter.
    """

    def start():
        encode = WordEncoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def work(texts):
            which, piece, begin, length, crc, ids = [], [], [], [], [], []
            for at in range(0, len(texts), 256):
                for i, own in enumerate(encode([t or "" for t in texts[at : at + 256]]), at):
                    own += end
                    n = len(own) // 4
                    cut = 0
                    for k in range(-(-n // capacity)):
                        size = (n % capacity or capacity) if k == 0 else capacity
                        part = own[4 * cut : 4 * (cut + size)]
                        which.append(i)
                        piece.append(k)
                        begin.append(cut)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        ids.append(part)
                        cut += size
            columns = (piece, begin, length, crc)
            return which, (*columns, ids) if with_ids else columns

        return work

    made = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_texts(docs, text_col, {id_col: id_col}, start, made)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    free: list[int] = []  # the amounts of room that some open bin has, in order
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(free, size)
        if at == len(free):
            b, left = count, capacity
            count += 1
        else:
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                free.pop(at)
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            if not room.setdefault(left, []):
                bisect.insort(free, left)
            room[left].append(b)
    return bins, offsets


def bins_at_least(lengths: np.ndarray, capacity: int) -> int:
    """The best of the lower bounds that dual feasible functions give on the bins for some lengths."""
    return _bound(np.bincount(lengths, minlength=capacity + 1))


def _bound(count: np.ndarray) -> int:
    """The bound for count[n] items of each length n up to the capacity.

    Rounding functions u_k (k = 1 to 20), and for each threshold up to half the capacity the
    function that counts large items as whole, small ones as nothing and others as they are.
    """
    capacity, n = len(count) - 1, count.astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, ((k + 1) * size // capacity) * capacity)  # in 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    number, total = np.cumsum(n), np.cumsum(n * size)
    cut = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - cut]
    rest = total[capacity - cut] - total[cut - 1]
    return max(best, int((large + -(-rest // capacity)).max(initial=0)))


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, rounds: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset; pieces need a column length of 1 to capacity and keep their other columns.

    Pieces of a full sequence are one of their own. No two sequences share an id, and no
    sequence holds more than the capacity; offsets are gapless from 0. Any row may repeat.
    Exchanges go on until they save nothing, or for as many rounds as given.
    Columns of pieces that are called sequence_id or offset are replaced; any other name may occur.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    back = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    held = checkpoint(pieces.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    placed = held.where(F.col("length") >= capacity).select(*back, (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_rows, bins, number = held.where(F.col("length") < capacity), None, 0
    size = open_rows.count()
    while size:
        parts = -(-size // per_task)
        dealt = open_rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)).cast("long"))
        packed = checkpoint(_packed(dealt, capacity, number))
        sums = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("least").alias("least"))
        now = sums.agg(F.sum("bins"), F.sum(F.col("bins") - F.col("least"))).first()
        if bins is not None and now[0] >= bins:  # the last exchange saved nothing
            packed, settled = before, None
        elif parts == 1 or now[1] == 0 or number == rounds:
            settled = None
        else:
            # Bins of partitions that meet their bound are final; so are full bins of the others.
            settled = (F.col("bins") == F.col("least")) | (F.col("fill") == capacity)
        placed = placed.unionByName((packed if settled is None else packed.where(settled)).select(*back, "sequence_id", "offset"))
        if settled is None:
            break
        before = packed.where(~settled)
        bins = before.select("sequence_id").distinct().count()
        open_rows = before.select(*held.columns)
        size, number = open_rows.count(), number + 1
    return placed


def _packed(dealt: DataFrame, capacity: int, number: int) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        first = (number << 50) + (int(group["part"].iloc[0]) << 20)  # a part has fewer than 2^20 bins
        return group.assign(sequence_id=first + bins, offset=offsets, bins=len(fill), least=bins_at_least(lengths, capacity), fill=fill[bins])

    return dealt.groupBy("part").applyInPandas(one, kinds + ", sequence_id long, offset long, bins long, least long, fill long")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, least): how many sequences packed pieces have, and how many any packing of them needs at least. The driver gets one row for each length."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator():
        count[r["length"]] = r["n"]
    return packed.select("sequence_id").distinct().count(), _bound(count)


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of docs with their sequences. Null and empty texts are one end token each; an empty table gives an
    empty result; rows that repeat an id are packed one by one; extra columns are not looked at."""
    return pack(token_pieces(docs, tokenizer, id_col, text_col))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary, little-endian unsigned 32-bit) from packed pieces that carry ids."""
    return pieces.groupBy("sequence_id").agg(
        F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")
    )


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with their sequences, and beside them the certificate: the number of sequences, and the least that any packing needs."""
    packed = packed_documents(table(spark, sf_dir, "documents"), public_tokenizer())
    bins, least = certificate(packed)
    return packed.withColumn("n_sequences", F.lit(bins).cast("long")).withColumn("least_sequences", F.lit(least).cast("long"))


QUERIES = {"op7_certified_packing": op7_certified_packing}
SQL: dict[str, str] = {}
