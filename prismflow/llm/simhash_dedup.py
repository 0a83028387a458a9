"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint is taken over its sequences of three words (A-Z lower-cased, words are runs of other characters than
ASCII white space, repeats included; a text with fewer words is one sequence). A bit of it is 1 if more than half of
the sequences' XXH64 hashes have it set. Fingerprints link at ``DISTANCE`` (2) or fewer differing bits; a component is what links reach.

Keys: 64 bits are cut into segments of 22, 21 and 21 bits, each a vector of the perfect binary Golay code [23, 12, 7]
with zeros in front. ``golay_keys`` decodes a segment to the code words within distance 4. There is one if the nearest lies
within 2, and six if it lies at 3. Two vectors at distance 2 or less always share one of them: if both lie at 3 from their own code word, the
word of weight 7 through three errors of the one and one error of the other is within 4 of both. By the pigeonhole principle two bit
errors leave one of three segments without any, so a key is that segment as it is, together with one code word of the segment after
it: at most 18 keys a fingerprint. Fingerprints that share a key are compared bit by bit.

Crowded keys: within a key that more than ``CROWD`` different fingerprints share no pairs are formed. Those fingerprints are joined by
their neighbours instead: two fingerprints at distance 2 have a common neighbour at distance 1, and all that share such a neighbour are
linked to each other, at most 65 of them. That way is exact as well, and its rows grow with the fingerprints, not with their pairs.

Equal fingerprints are one node, so copies never meet each other. Defined results for odd input: null and empty texts, and texts of white
space, have fingerprint zero, which links like any other; a row with null id takes part, but never names a component (a component
of such rows only has a null name); rows that share an id are judged by their own texts; texts of any length are read whole; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import skew
from prismflow.llm import textkit as tk
from prismflow.llm.components import connected_components

WORDS, SEED, DISTANCE = 3, 42, 2
#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 64
#: Sequences hashed at a time.
BLOCK = 1 << 15
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the Golay code.
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: max(1, len(words) - WORDS + 1)]
    ends = ends[min(len(words), WORDS) - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print): one row per row of ``docs``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return storage.spread(rows).mapInArrow(tk.tidy(emit), "id long, print long")


def syndromes(vectors: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit vectors, as polynomials over GF(2), by the generator."""
    rest = vectors.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


class Golay:
    """Error patterns of weight 4 or less for every syndrome: ``count`` of them in each row of ``patterns``."""

    def __init__(self):
        found = np.array([sum(1 << b for b in places) for weight in range(5) for places in combinations(range(LENGTH), weight)])
        of = syndromes(found)
        order = np.argsort(of, kind="stable")
        self.count = np.bincount(of, minlength=1 << CHECKS)
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.patterns = np.zeros((1 << CHECKS, int(self.count.max())), np.int64)
        self.patterns[of[order], place] = found[order]

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``vectors``, index of a code word within distance 4) for each such code word; a word's index is its upper 12 bits."""
        of = syndromes(vectors)
        times = self.count[of]
        at = np.repeat(np.arange(len(vectors)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return at, (vectors[at] ^ self.patterns[of[at], nth]) >> CHECKS


def golay_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``prints``, key): number and bits of the error-free segment, and a code word of the next one."""
    parts = [((prints >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64) for first, size in SEGMENTS]
    places, keys = [], []
    for k, part in enumerate(parts):
        at, word = code.keys(parts[(k + 1) % len(parts)])
        places.append(at)
        keys.append((np.int64(k) << np.int64(34)) | (part[at] << np.int64(12)) | word)
    return np.concatenate(places), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, print) for every key of every fingerprint."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            prints = batch.column(0).to_numpy()
            at, keys = golay_keys(prints.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at])], ["key", "print"])

    return nodes.select("print").mapInArrow(tk.tidy(emit), "key long, print long")


def links(nodes: DataFrame, n: int, scratch: storage.Scratch, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of linked fingerprints that connect all that links connect. ``nodes`` (print) holds ``n`` rows without repeats."""
    keys = scratch.cut(keyed(nodes))
    shared = scratch.cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.cut(keys.join(shared, "key"))
    few = members.where(F.col("n") <= crowd).select("key", "print")
    other = few.select("key", F.col("print").alias("b"))
    near = few.withColumnRenamed("print", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    crowded = scratch.cut(members.where(F.col("n") > crowd).select("print").distinct(), n)
    if not crowded.limit(1).count():
        return scratch.cut(near.distinct())
    flips = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {bit})") for bit in range(64)))
    around = crowded.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("around"))
    hubs = around.groupBy("around").agg(F.min("print").alias("a"), F.sort_array(F.collect_list("print")).alias("all")).where(F.size("all") > 1)
    stars = hubs.select("a", F.explode(F.slice("all", 2, 64)).alias("b"))
    return scratch.cut(near.unionByName(stars).distinct())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.
    The result is written, all else removed."""
    storage.bounded_batches(docs.sparkSession)
    scratch = storage.Scratch()
    rows = scratch.cut(fingerprints(docs, id_col, text_col))
    total = rows.count()
    nodes = scratch.cut(rows.groupBy("print").agg(F.min("id").alias("first")), total)
    n = nodes.count()
    labels = connected_components(links(nodes, n, scratch, crowd), "a", "b", scratch)
    whole = nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("component"))
    whole = scratch.cut(whole, total)
    names = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.cut(skew.lookup(whole, names, "component", "print", total).select("print", "component_id"), total)
    found = skew.lookup(rows, named, "print", "id", total)
    result = storage.cut(found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))
    scratch.close()
    return result
