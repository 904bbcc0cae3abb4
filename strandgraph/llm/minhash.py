"""Min-max hashing: near-duplicate groups of documents.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Each of 64
permutations gives two signature values, the minimum and the maximum of the permuted
set: 128 values for 64 evaluations, each equal in two sets with probability equal to
their Jaccard similarity. 32 bands of 4 values, each from a permutation of its own,
propose candidates (a pair at similarity 0.75 shares no band with probability 5e-6);
every link is then confirmed on the full sets.

Groups are never expanded into pairs. Equal sets collapse to one representative
first. Within a bucket each member is compared with one hub, the member that meets the
most others. Only where members then still lie in several components, those outside the
bucket's largest component are compared with all others, inside tasks, which pass on
links only. Buckets in which that would be more than MOST_PAIRS pairs are dealt anew by
prefix filter instead: near sets share one of the rarest seventh of the smaller
one's shingles that is in the rarest quarter of the larger one's, so members meet by these.
Members that have a long passage in common, but not enough of it to be near, meet nobody. Each comparison is made in tiles of bounded size: a hub and a chunk of its
members, or two chunks of a bucket; a task gets each signature or set once for all its
tiles. Signatures are compared first, and sets are made and sent only of documents that
have a partner whose signature is near. When this ends, each pair that shares a band has
been compared, or is connected already, or can't be near by its sizes, prefixes or
signatures, so no link between components is lost, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, gathered, map_texts, table

WORDS, PERMUTATIONS, ROWS = 5, 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 75
#: Members of a tile's chunk; bytes of sets in a group of tiles, which is what a task takes at once.
CHUNK, GROUP_BYTES = 256, 12 << 20
#: Pairs whose signatures agree less aren't compared in full: at similarity 0.75 that is 8 deviations away.
LEAST_AGREEMENT = 0.75 - 8 * (0.75 * 0.25 / (2 * PERMUTATIONS)) ** 0.5
#: Pairs of members of one bucket, in different components, up to which they are compared by signatures; beyond, they meet by prefix first.
MOST_PAIRS = 1 << 24
#: Slots in which shingles are counted to order them by rarity: one number each, on the driver and in tasks. Any order is right, rare first is fast.
SLOTS = 1 << 18
#: Ids are broadcast up to so many, if they have no more bytes than that in all; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20
#: Memory bound of the word-hash cache of a task; when full it starts anew.
CACHE_WORDS = 400_000

_rng = np.random.default_rng(20_240_607)
_SCALE = (_rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_WORD = (_rng.integers(1, 2**63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND = (_rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words, of the whole sequence; empty without words.

    bytes.split() and bytes.lower() know ASCII white space (0x20, 0x09 to 0x0D) and A-Z only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    found = list(map(cache.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = cache[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    w = np.array(found, np.uint64)
    if len(w) < WORDS:
        return mixed(np.array([(w * _WORD[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))
    n = len(w) - WORDS + 1
    h = w[:n] * _WORD[0]
    for i in range(1, WORDS):
        h = h + w[i : i + n] * _WORD[i]
    return np.unique(mixed(h))


def band_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the min-max signature of a set that isn't empty: the key of each band, and a byte of each value."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), 8192):
        part = np.multiply.outer(_SCALE, values[at : at + 8192]) + _SHIFT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
        np.maximum(high, part.max(axis=1), out=high)
    # Of small sets a permutation's minimum and maximum depend on each other, so a band takes them from four permutations.
    signature = mixed(np.concatenate([low.reshape(BANDS, 2), np.roll(high, 2).reshape(BANDS, 2)], axis=1))
    keys = mixed((signature * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys, (signature & np.uint64(255)).astype(np.uint8).ravel()


def _signed():
    cache: dict[bytes, int] = {}

    def work(texts):
        sizes, one, two, bands, sketches = [], [], [], [], []
        for text in texts:
            values = shingle_set(text, cache)
            sizes.append(len(values))
            digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
            one.append(digest[0])
            two.append(digest[1])
            keys, sketch = band_keys(values) if len(values) else (None, None)
            bands.append(None if keys is None else keys.view(np.int64))
            sketches.append(None if sketch is None else sketch.tobytes())
        return None, (sizes, one, two, bands, sketches)

    return work


def _sets():
    cache: dict[bytes, int] = {}

    def work(texts):
        items, bands, sketches = [], [], []
        for text in texts:
            values = shingle_set(text, cache)
            keys, sketch = band_keys(values) if len(values) else (None, None)
            items.append(values.tobytes())
            bands.append(None if keys is None else keys.view(np.int64))
            sketches.append(None if sketch is None else sketch.tobytes())
        return None, (items, bands, sketches)

    return work


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are near-duplicates."""
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if not len(short) or 100 * len(short) < PERCENT * len(long):
        return False
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    both = int((long[at] == short).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Null, empty and blank texts have no set: they are linked with nothing. A row with
    a null id belongs to no component: its component_id is null and kept is true. Rows
    that share an id are one node, linked by each of their texts. Equal texts are linked.
    An empty table gives an empty result. Other columns of docs are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = checkpoint(map_texts(rows, "text", {"id": "id"}, _signed, "n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"))
    with_set = signed.where("n_shingles > 0 and id is not null")
    first = [F.first(c).alias(c) for c in ("bands", "sketch", "n_shingles")]
    reps = checkpoint(with_set.groupBy("s1", "s2").agg(F.min("id").alias("id"), *first))
    # A repeated id may have several signatures, and all count.
    signs = reps.select("id", F.col("n_shingles").alias("n"), "bands", "sketch")

    # The band's number is part of its key. Counts are joined from a table of their own, so that a hot key can be split.
    entries = reps.select("id", F.explode("bands").alias("key"))
    shared = checkpoint(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = checkpoint(entries.join(shared, "key"))
    buckets = gathered(buckets, buckets.count())
    met = buckets.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = checkpoint(buckets.join(met, "id").groupBy("key").agg(F.min_by("id", F.struct((-F.col("met")).alias("m"), "id")).alias("hub")))
    starred = checkpoint(buckets.join(gathered(hubs, hubs.count()), "key"))
    starred = gathered(starred, starred.count())

    # Rows that share an id tie their sets together.
    links = _links_to_hubs(starred, signs, rows)
    odd = with_set.groupBy("id").agg(F.min("s1").alias("l1"), F.max("s1").alias("h1"), F.min("s2").alias("l2"), F.max("s2").alias("h2")).where("l1 <> h1 or l2 <> h2")
    odd = checkpoint(odd.select("id"))
    if not odd.isEmpty():
        of_odd = with_set.join(odd, "id").select("id", "s1", "s2").distinct()
        links = links.union(of_odd.join(reps.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"]).select(F.col("id").alias("a"), "b"))
    component = checkpoint(connected_components(links, "a", "b"))
    component = gathered(component, component.count())
    place = reps.select("s1", "s2", "id").join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).select("s1", "s2", "c")
    rest = _pending(starred.where("n > 2").withColumn("brief", F.lit(True)), component)
    if not rest.isEmpty():
        pairs = F.col("n") * F.col("small")
        links, wide = _links_within(rest.where(pairs <= MOST_PAIRS), signs, rows), rest.where(pairs > MOST_PAIRS)
        if not wide.isEmpty():
            links = links.union(_links_within(_pending(_by_prefix(wide, rows), component), signs, rows, banded=False))
        further = checkpoint(connected_components(links, "a", "b")).toDF("c", "component")
        place = place.join(further, "c", "left").select("s1", "s2", F.coalesce("component", "c").alias("c"))
    return (
        signed.select("id", "n_shingles", "s1", "s2")
        .join(place, ["s1", "s2"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def _broadcast_if_small(ids: DataFrame) -> DataFrame:
    """ids (a checkpoint that has a column id), to be broadcast if a check of their number and bytes allows it."""
    n, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("id").cast("string"))), F.lit(0))).first()
    return F.broadcast(ids) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else ids


def _in_tiles(members: DataFrame, held: DataFrame, row_bytes: float, tile: list[str], compare, made: str) -> DataFrame:
    """What `compare` makes of groups of tiles: members (a checkpoint of rows with id and the columns that name their tile) beside the
    rows that `held` has for their ids, each once a group."""
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, int(members.count() * row_bytes / GROUP_BYTES) + 1)
    members = members.withColumn("g", F.pmod(F.xxhash64(*tile), F.lit(groups)).cast("int"))
    need = checkpoint(members.select("g", "id").distinct())
    beside = held.join(_broadcast_if_small(need), "id")
    beside = beside.toDF(*beside.columns)  # columns of its own, as both sides come from one table
    return members.groupBy("g").cogroup(beside.groupBy("g")).applyInPandas(compare, made)


def _compared_by_sets(members: DataFrame, rows: DataFrame, tile: list[str], compare, kind: str) -> DataFrame:
    """The links that `compare` finds by the full sets of the members, made from their texts."""
    ids = checkpoint(members.select("id").distinct())
    texts = rows.join(_broadcast_if_small(ids), "id", "left_semi")
    full = checkpoint(map_texts(texts, "text", {"id": "id"}, _sets, "items binary, bands array<long>, sketch binary").where("length(items) > 0"))
    size = full.agg(F.avg(F.length("items"))).first()[0] or 1.0
    return _in_tiles(members, full, size + 400, tile, compare, f"a {kind}, b {kind}")


def _links_to_hubs(starred: DataFrame, signs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of members with the hubs of their buckets."""
    kind = dict(starred.dtypes)["id"]
    pairs = starred.where("id <> hub").groupBy("hub", "id").agg(F.max("n").alias("n"))
    pairs = pairs.select("hub", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("y"), "id")
    # A hub is a member of each of its tiles.
    with_hub = lambda pairs: checkpoint(pairs.union(pairs.select("hub", "y", F.col("hub").alias("id")).distinct()))
    near = checkpoint(_in_tiles(with_hub(pairs), signs.select("id", "n", "sketch"), 200, ["hub", "y"], _hub_near, f"hub {kind}, y int, id {kind}"))
    return _compared_by_sets(with_hub(near), rows, ["hub", "y"], _hub_links, kind)


def _by_id(held: pd.DataFrame, *columns: str) -> dict:
    """The rows of each id as tuples; of a repeated id several."""
    out: dict = {}
    for i, *row in zip(held["id"], *[held[c] for c in columns], strict=True):
        out.setdefault(i, []).append(tuple(np.frombuffer(x, np.uint64 if c == "items" else np.uint8) if c in ("items", "sketch") else x for c, x in zip(columns, row, strict=True)))
    return out


def _hub_near(members: pd.DataFrame, signs: pd.DataFrame) -> pd.DataFrame:
    held = _by_id(signs, "n", "sketch")
    agree = lambda x, y: 100 * min(x[0], y[0]) >= PERCENT * max(x[0], y[0]) and (x[1] == y[1]).mean() >= LEAST_AGREEMENT
    near = [hub != i and any(agree(x, y) for x in held.get(hub, ()) for y in held.get(i, ())) for hub, i in zip(members["hub"], members["id"], strict=True)]
    return members.loc[np.array(near, bool), ["hub", "y", "id"]]


def _hub_links(members: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    held = _by_id(sets, "items")
    links = [(hub, i) for hub, i in zip(members["hub"], members["id"], strict=True) if hub != i and any(similar(x, y) for (x,) in held.get(hub, ()) for (y,) in held.get(i, ()))]
    return pd.DataFrame(links, columns=["a", "b"])


def _pending(starred: DataFrame, component: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component: key, id, hub, component, asks, and over the hub's buckets the most members (n) and
    the most that ask (small).

    Those ask that are outside the bucket's largest component, or those that are brief there if they are fewer: of a pair to be compared one is.
    """
    at = starred.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")).select("key", "id", "hub", "component", "brief")
    at = checkpoint(at)
    at = gathered(at, at.count())
    sizes = at.groupBy("key", "hub", "component").agg(F.count("*").alias("own"), F.count_if("brief").alias("briefs"))
    parts = sizes.groupBy("key", "hub").agg(F.count("*").alias("parts"), F.sum("own").alias("n"), F.sum("briefs").alias("briefs"), F.max("own").alias("largest"), F.max_by("component", F.struct("own", "component")).alias("most")).where("parts > 1")
    parts = parts.withColumn("outside", F.col("n") - F.col("largest")).withColumn("by_brief", F.col("briefs") < F.col("outside"))
    parts = checkpoint(parts.withColumn("ask", F.least("briefs", "outside")).where("ask > 0"))
    parts = gathered(parts, parts.count())
    widest = parts.groupBy("hub").agg(F.max("n").alias("n"), F.max("ask").alias("small"))
    rest = at.join(parts.select("key", "most", "by_brief").join(widest.join(parts.select("hub", "key"), "hub"), "key"), ["key", "hub"])
    rest = checkpoint(rest.withColumn("asks", F.when(F.col("by_brief"), F.col("brief")).otherwise(F.col("component") != F.col("most"))).drop("brief", "by_brief", "most"))
    return gathered(rest, rest.count())


def _by_prefix(wide: DataFrame, rows: DataFrame) -> DataFrame:
    """Members of wide buckets by the shingles of their prefixes, as buckets: key (the shingle), id, n (its members), hub (the shingle again: no two share tiles),
    brief (whether it is in the shorter prefix, too).

    Near sets of m <= n shingles share t n or more, and 2 t m / (1 + t) or more, with t = PERCENT / 100. So in any one order of all
    shingles their first shared one is among the first n - ceil(t n) + 1 of the larger set and the first m - ceil(2 t m / (1 + t)) + 1 of
    the smaller one: a shingle that is in nobody's shorter prefix makes no bucket. Shingles are ordered by the count of their slot.
    """
    kind = dict(wide.dtypes)["id"]
    ids = checkpoint(wide.select("id").distinct())
    texts = rows.join(_broadcast_if_small(ids), "id", "left_semi")
    full = checkpoint(map_texts(texts, "text", {"id": "id"}, _sets, "items binary, bands array<long>, sketch binary").where("length(items) > 0").select("id", "items"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in full.mapInPandas(_slot_counts, "slot int, n long").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        counts[slot] = n

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [prefix(np.frombuffer(items, np.uint64), counts) for items in batch["items"]]
            keys = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in found]]).view(np.int64)
            brief = np.concatenate([np.empty(0, bool), *[np.arange(len(k)) < m for k, m in found]])
            yield pd.DataFrame({"id": batch["id"].repeat([len(k) for k, _ in found]), "key": keys, "brief": brief})

    tokens = checkpoint(full.mapInPandas(prefixes, f"id {kind}, key long, brief boolean").groupBy("id", "key").agg(F.max("brief").alias("brief")))
    shared = checkpoint(tokens.groupBy("key").agg(F.count("*").alias("n"), F.max("brief").alias("some")).where("n > 1 and some").drop("some").withColumn("hub", F.col("key")))
    return checkpoint(tokens.join(shared, "key"))


def _slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for items in batch["items"]:
            counts += np.bincount(np.frombuffer(items, np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": slots.astype(np.int32), "n": counts[slots]})


def prefix(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, rarest shingles first, by the count of their slots and then their hash; and the length of the shorter prefix in it."""
    n, m = (len(values) - -(-part * len(values) // whole) + 1 for part, whole in ((PERCENT, 100), (2 * PERCENT, 100 + PERCENT)))
    return values[np.lexsort((values, counts[values % np.uint64(len(counts))]))[:n]], m


def _links_within(rest: DataFrame, signs: DataFrame, rows: DataFrame, banded: bool = True) -> DataFrame:
    """Links (a, b) of components by members of a bucket that lie in different ones.

    Members that ask are one side; all members are the other side. Buckets that
    aren't bands don't tell which of a pair's shared ones is the first, so there a pair may be compared in each.
    """
    kind, hub = dict(rest.dtypes)["id"], dict(rest.dtypes)["hub"]
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), chunks(n)).cast("int")
    columns = ["hub", "x", "y", "key", "id", "component"]
    asking = rest.where("asks").withColumn("x", of("small", 1)).withColumn("y", every("n")).select(*columns, F.lit(True).alias("asks"))
    asked = rest.withColumn("y", of("n", 2)).withColumn("x", every("small")).select(*columns, F.lit(False).alias("asks"))
    tile, made = ["hub", "x", "y", "key"], f"hub {hub}, x int, y int, key long, id {kind}, component {kind}, asks boolean"
    near = checkpoint(_in_tiles(checkpoint(asking.union(asked)), signs, 450, tile, partial(_near_members, banded), made))
    return _compared_by_sets(near, rows, tile, partial(_component_links, banded), kind)


def _near_places(members: pd.DataFrame, held: dict, banded: bool):
    """For each row that asks and each of its id's tuples (n or set, bands, sketch): the row's place, the tuple, the other side's places and tuples, and which of these are near.

    If buckets are bands, a pair counts in the first band that it shares only.
    """
    size = lambda x: x if np.ndim(x) == 0 else len(x)
    ids, own, asks = members["id"].to_numpy(), members["component"].to_numpy(), members["asks"].to_numpy(bool)
    for (_, _, _, key), at in members.groupby(["hub", "x", "y", "key"], sort=False).indices.items():
        asked = [(j, x) for j in at[~asks[at]] for x in held.get(ids[j], ())]
        asking = [(i, x) for i in at[asks[at]] for x in held.get(ids[i], ())]
        if not asked or not asking:
            continue
        places = np.array([j for j, _ in asked])
        sizes, bands, sketches = np.array([size(x[0]) for _, x in asked]), np.stack([x[1] for _, x in asked]), np.stack([x[2] for _, x in asked])
        for i, x in asking:
            near = np.minimum(sizes, size(x[0])) * 100 >= PERCENT * np.maximum(sizes, size(x[0]))
            near &= (own[places] != own[i]) & ((sketches == x[2]).mean(axis=1) >= LEAST_AGREEMENT)
            hits = np.flatnonzero(near)
            yield i, x, asked, hits[(bands[hits] == x[1]).argmax(axis=1) == (x[1] == key).argmax()] if banded else hits


def _near_members(banded: bool, members: pd.DataFrame, signs: pd.DataFrame) -> pd.DataFrame:
    keep = np.zeros(len(members), bool)
    for i, _, asked, hits in _near_places(members, _by_id(signs, "n", "bands", "sketch"), banded):
        if len(hits):
            keep[i] = True
            keep[[asked[j][0] for j in hits.tolist()]] = True
    return members.loc[keep, ["hub", "x", "y", "key", "id", "component", "asks"]]


def _component_links(banded: bool, members: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    links: list[tuple] = []
    joined: dict = {}  # component to the one that it has joined in this group
    own = members["component"].to_numpy()

    def root(c):
        while c in joined:
            c = joined[c]
        return c

    for i, x, asked, hits in _near_places(members, _by_id(sets, "items", "bands", "sketch"), banded):
        for j in hits.tolist():
            c, d = root(own[i]), root(own[asked[j][0]])
            if c != d and similar(x[0], asked[j][1][0]):
                links.append((own[i], own[asked[j][0]]))
                joined[d] = c
    return pd.DataFrame(links, columns=["a", "b"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, with all their columns; rows that repeat an id are one document and stay together."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")), "left_anti")


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op5_minmax_near_dedup": op5_minmax_near_dedup}
SQL = {
    "op5_minmax_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.id WHERE reach.r < e.b),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c AS component_id, s.doc_id = c AS kept
FROM sets s JOIN least ON least.id = s.doc_id
"""
}
