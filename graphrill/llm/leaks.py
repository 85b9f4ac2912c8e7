"""Evaluation items that stand, fully or partly, in a corpus, by winnowed fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.llm.words import hashes, words
from graphrill.session import FEW_ROWS, cut, cut_and_count, top_k

#: Words of a fingerprint, and the least words that a span must share. Any span of SPAN words has a whole window of
#: SPAN - GRAM + 1 grams, whose least gram is kept on both sides.
GRAM, SPAN = 5, 13
#: The filter of fingerprints has 16 bits for each, but no more than these (8 MiB), however many items there are.
MOST_BITS = 26
#: Hits of a fingerprint that very many texts have go to so many tasks; so many such fingerprints are split.
SPLIT, HOT = 64, 200


def fingerprints(tokens: np.ndarray, starts: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in a window; text i has tokens[starts[i]:starts[i + 1]]."""
    window = span - gram + 1
    n = len(tokens) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = tokens.view(np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
        g ^= g >> np.uint64(29)
    m = n - window + 1
    least = g[:m].copy()
    for i in range(1, window):
        np.minimum(least, g[i : i + m], out=least)
    # A window counts if it lies in one text.
    whole = np.zeros(m, bool)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole[:] = text[:m] == text[span - 1 : span - 1 + m]
    kept = np.zeros(n, bool)
    for i in range(window):
        kept[i : i + m] |= whole & (g[i : i + m] == least)
    at = np.flatnonzero(kept)
    return at, g[at]


def _prints(shared, gram: int, span: int):
    """Batches (id, words) to rows (id, print, near): each fingerprint with the words that a span around it can have, null beyond
    the text. With a filter only fingerprints that pass it, and of a text that repeats itself each once."""
    around = np.arange(gram - span, span)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            tokens = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            at, g = fingerprints(tokens, starts, gram, span)
            if shared is not None:
                bits = shared.value
                low = g & np.uint64(len(bits) * 64 - 1)
                hit = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
                at, g = at[hit], g[hit]
            text = np.searchsorted(starts, at, "right") - 1
            where = at[:, None] + around
            there = (where >= starts[text][:, None]) & (where < starts[text + 1][:, None])
            near = np.where(there, tokens[np.clip(where, 0, max(0, len(tokens) - 1))], 0) if len(at) else np.zeros((0, len(around)), np.int64)
            # Equal surroundings of one text can tell nothing new.
            rows = np.ascontiguousarray(np.column_stack([text, there @ (1 << np.arange(len(around))), near]))
            first = np.sort(np.unique(rows, axis=0, return_index=True)[1]) if len(rows) else np.zeros(0, np.int64)
            for part in np.array_split(first, math.ceil(len(first) / 10_000)) if len(first) else []:
                flat = pa.array(near[part].reshape(-1), mask=~there[part].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(around), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[part])), pa.array(g[part].view(np.int64)), lists], names=["id", "print", "near"])

    return run


def _filter(prints: DataFrame, count: int) -> np.ndarray:
    """A bit for each fingerprint by its last bits, as 64-bit words; what the driver gets is bounded by MOST_BITS."""
    size = min(MOST_BITS, max(10, math.ceil(math.log2(16 * count + 1))))
    low = F.col("print").bitwiseAND(F.lit((1 << size) - 1))
    words_ = prints.select(F.shiftright(low, 6).alias("w"), F.expr("1L << CAST(print & 63 AS INT)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words_["w"].to_numpy()] = words_["b"].to_numpy().view(np.uint64)
    return bits


def _shared(a: str, b: str, span: int) -> Column:
    """Are ``span`` consecutive words of two surroundings of the same fingerprint equal?"""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.lit(0), lambda n, x: F.when(x, n + 1).when(n >= span, n).otherwise(0)) >= span


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id): each text of the corpus and item that share at least ``span`` consecutive words.

    Null and empty texts, and items of fewer words than ``span``, share nothing. Items with equal texts are all named; a row
    comes out once for each row of the corpus and item. Words are compared by 64-bit hashes, all words of a span.

    The corpus is read once, whatever the number of items: its fingerprints pass a filter of the items' fingerprints, and the
    few that pass are joined with them and extended by the words around. If the items' fingerprints are few they are
    broadcast; else hits and items meet by fingerprint, and hits of hot fingerprints are split over SPLIT tasks.
    """
    spark = corpus.sparkSession
    tokens = items.select(F.col(item_id).alias("id"), hashes(words(F.col(item_text))).alias("t")).where(F.size("t") >= span)
    of = lambda t: f"id {t.simpleString()}, print bigint, near array<bigint>"
    prints, count = cut_and_count(tokens.mapInArrow(_prints(None, gram, span), of(tokens.schema["id"].dataType)))
    row = F.struct(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"))
    docs = corpus.select(row.alias("id"), hashes(words(F.col(text))).alias("t")).where(F.size("t") >= span)
    shared = spark.sparkContext.broadcast(_filter(prints, count))
    hits = docs.mapInArrow(_prints(shared, gram, span), of(docs.schema["id"].dataType))
    known = prints.select(F.col("id").alias("item"), "print", F.col("near").alias("other"))
    if count <= FEW_ROWS:
        joined = hits.join(F.broadcast(known), "print")
    else:
        hits = cut(hits)
        top = hits.agg(top_k(F.col("print"), HOT, 64 * HOT).alias("t")).select(F.explode("t.item").alias("print"), F.lit(True).alias("hot"))
        hot = F.broadcast(top.where(F.col("print").isNotNull()))  # at most HOT rows
        own = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SPLIT))).otherwise(0)
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
        hits = hits.join(hot, "print", "left").select("id", "print", "near", own.cast("int").alias("slot"))
        joined = hits.join(known.join(hot, "print", "left").select("item", "print", "other", F.explode(every).alias("slot")), ["print", "slot"])
    found = joined.where(_shared("near", "other", span)).select("id", "item").distinct()
    return found.select(F.col("id.doc").alias(doc_id), F.col("item").alias(item_id))
