"""Texts and the keys they name: keys of one or more whole words, matched as consecutive words of the lower-cased text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES = 32 << 20  # keys up to this size are handed to every task
_GAP = r"[^\p{L}\p{N}_]+"


def whole_words(text: Column) -> Column:
    """The words of a text in lower case; of null none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def mentions(texts: DataFrame, keys: DataFrame, id: str = "doc_id", text: str = "text", key: str = "key",
             key_bytes: int = KEY_BYTES) -> DataFrame:
    """(`id`, key, n): how often each key stands in the texts of an id, overlapping places included; `key` in its lower-cased words with
    one blank between. Keys without a word name nothing, equal keys are one. Rows of one id are counted together.

    Keys of up to `key_bytes` in all go to every task as one automaton, and a text is read once whatever the number of keys. Larger sets
    are joined: the runs of words of each length that a key has meet the key they equal, so no first word is a hot group by itself."""
    wanted = keys.select(F.array_join(whole_words(F.col(key)), " ").alias("key")).where("key <> ''").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("key") + 2), F.lit(0))).first()[0]
    read = texts.select(F.col(id).alias("_id"), whole_words(F.col(text)).alias("_w"))
    if size <= key_bytes:
        found = _by_automaton(read, [r.key for r in wanted.collect()])
    else:
        found = _by_join(read, wanted)
    return found.groupBy("_id", "key").agg(F.sum("n").cast("bigint").alias("n")).select(F.col("_id").alias(id), "key", "n")


def _by_automaton(read: DataFrame, keys: list[str]) -> DataFrame:
    kind = read.schema["_id"].dataType.simpleString()
    if not keys:
        return read.limit(0).select("_id", F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n"))
    shipped = read.sparkSession.sparkContext.broadcast(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for i, key in enumerate(shipped.value):
            machine.add_word(f" {key} ", i)
        machine.make_automaton()
        for batch in batches:
            rows, hits, times = [], [], []
            for row, line in enumerate(batch.column(1)):
                seen: dict[int, int] = {}
                for _, i in machine.iter(line.as_py()):
                    seen[i] = seen.get(i, 0) + 1
                rows += [row] * len(seen)
                hits += seen.keys()
                times += seen.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([shipped.value[i] for i in hits], pa.string()),
                 pa.array(times, pa.int64())], names=["_id", "key", "n"])

    lines = read.select("_id", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_line"))
    return lines.mapInArrow(find, f"_id {kind}, key string, n bigint")


def _by_join(read: DataFrame, wanted: DataFrame) -> DataFrame:
    lengths = sorted(r[0] for r in wanted.select(F.size(F.split("key", " "))).distinct().collect())  # as many as keys have lengths
    runs = None
    for length in lengths:
        places = F.when(F.size("_w") >= length, F.sequence(F.lit(1), F.size("_w") - (length - 1)))
        words = read.select("_id", "_w", F.explode(places).alias("_at")).select(
            "_id", F.array_join(F.slice("_w", F.col("_at"), F.lit(length)), " ").alias("key"))
        counted = words.groupBy("_id", "key").agg(F.count(F.lit(1)).alias("n"))
        runs = counted if runs is None else runs.unionByName(counted)
    return runs.join(wanted, "key").select("_id", "key", "n")
