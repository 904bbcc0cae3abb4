"""Many phrases in many texts: an automaton over blocks of phrases, run over each text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of the phrases of one automaton, which takes some hundred bytes for each.
BLOCK_CHARS = 1_000_000
#: The block that a Python worker has built last, and its automaton.
_BUILT: list = [None, None]


def phrase_blocks(phrases: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """(key, phrase) of columns of these names, in blocks of about block_chars characters; one block at a time is held here."""
    block, size = [], 0
    for key, phrase in phrases.select("key", "phrase").toLocalIterator():
        if block and size + len(phrase) > block_chars:
            yield block
            block, size = [], 0
        block.append((key, phrase))
        size += len(phrase)
    if block:
        yield block


def automaton(phrases: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """The automaton of a block, whose hits are places in the block."""
    if _BUILT[0] is not phrases:
        _BUILT[:] = None, None
        built = ahocorasick.Automaton()
        for i, (_, phrase) in enumerate(phrases):
            built.add_word(phrase, i)
        built.make_automaton()
        _BUILT[:] = phrases, built
    return _BUILT[1]


def held_phrases(phrases: DataFrame, texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """text_id, key of each phrase (key, phrase; distinct phrases) that a text (text_id, text) holds anywhere, once for each row of texts.

    Each block of phrases goes to all tasks and is one pass over the texts, which are never shuffled. Phrases are of any
    length, may overlap and hold one another. Null texts hold nothing, null and empty phrases are in nothing.
    """
    spark = texts.sparkSession
    schema = texts.select("text_id").schema.add("key", phrases.schema["key"].dataType)
    kind = to_arrow_type(schema["key"].dataType)
    held = texts.where("text is not null").select("text_id", "text")
    out = None
    for block in phrase_blocks(phrases.where("phrase <> ''"), block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            built = automaton(own)
            for batch in batches:
                which, keys = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = {hit for _, hit in built.iter(text)}
                    which.extend([i] * len(hits))
                    keys.extend(own[hit][0] for hit in hits)
                rows = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(keys, kind)]
                yield pa.RecordBatch.from_arrays(rows, names=["text_id", "key"])

        found = held.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def quoted(items: DataFrame, texts: DataFrame, item_id: str, item: str, text_id: str, text: str, multi: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, text_id of texts that hold an item verbatim; distinct.

    Equal items are looked for once, under the smallest of their ids. multi: an item is the parts between " / ", blank ones apart, and
    a text must hold all of them, in any order; an item without a part is held by none. Rows without an id, and null or empty items, are left out.
    """
    own = items.select(F.col(item_id).alias("item_id"), F.col(item).alias("item")).where("item_id is not null and item <> ''")
    held = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")).where("text_id is not null")
    if multi:
        parts = own.select("item_id", F.explode(F.array_distinct(F.filter(F.split("item", " / "), lambda p: F.trim(p) != ""))).alias("item"))
        wanted = parts.groupBy("item_id").agg(F.count_distinct("item").alias("n"))
        pairs = quoted(parts.withColumn("item_id", F.struct("item_id", "item")), held, "item_id", "item", "text_id", "text", False, block_chars)
        each = pairs.select("item_id.item_id", F.col("item_id.item").alias("part"), "text_id").distinct()
        return each.groupBy("item_id", "text_id").agg(F.count("*").alias("n")).join(wanted, ["item_id", "n"], "left_semi").select("item_id", "text_id")
    phrases = own.groupBy(F.col("item").alias("phrase")).agg(F.min("item_id").alias("key"))
    found = held_phrases(phrases, held, block_chars).distinct()
    ids = own.distinct().join(phrases, F.col("item") == F.col("phrase")).select("key", "item_id")
    return found.join(ids, "key").select("item_id", "text_id").distinct()
