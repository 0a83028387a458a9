"""Near-duplicate classes by DartMinHash signatures and banded joining.

Texts are sets of sequences of five normalised words (runs of ASCII letters, digits and non-ASCII
bytes, lower-cased; a text with fewer words is one sequence). Two texts are linked if the Jaccard
similarity of their sets is at least ``threshold``; a class is a connected component of the links.

Signatures: every element owns a Poisson process of hashed darts over its weight region; the darts of
a text are those whose rank is below a limit that shrinks with the total weight, so the work follows
the number of elements, not elements times coordinates. Each dart falls on one coordinate and the
earliest dart per coordinate is kept. Weights may be fractional (``weights``); in a set every element has weight 1.
With ``counted`` texts are bags instead: an element's weight is how often it occurs, and the similarity is
the sum of the smaller counts over the sum of the larger ones.

Joining: rows with equal sets are one node. Nodes sharing a band form a bucket. Instead of pairs of a
bucket, every member is compared with the bucket's hub, the member that shares most bands with others.
Every comparison is checked on the whole texts. Buckets whose members then still lie in different
components are worked off further: in small ones each pair from different components is compared, larger
ones meet further hubs for up to ``HUB_ROUNDS`` rounds. What is mixed after that is worked off exactly: the members
outside a bucket's largest component meet all others, block by block (``across``), so of two texts that share
a band and are linked none stays apart.

Defined results for odd input: null text counts as empty; texts without words are classes of their own;
a row with null id is a class of its own (null); rows that share an id share a class, and each of their texts links on its own; other
columns are ignored. Results do not depend on the order or the partitions of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import skew
from prismflow.llm import textkit as tk
from prismflow.llm.components import connected_components, extended
from prismflow.llm.skew import Heavy

WORDS = 5
ROWS, BANDS = 6, 32
SMALL = 24
HUB_ROUNDS = 3
#: Members and characters of a block of a large bucket.
BLOCK, BLOCK_CHARS = 256, 4 << 20
#: Pairs that one copy of a text serves.
TEXT_FAN = 20_000


class Shingler:
    """Hashed word sequences of many texts."""

    def __init__(self, words: int = WORDS):
        self.hasher, self.n, self.flags = tk.WordHasher(), words, tk.separators("alnum")

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, element, times it occurs), sorted by row and element."""
        raw, offsets = tk.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
        starts, ends, first = tk.word_spans(raw, offsets, self.flags)
        words = self.hasher(raw, starts, ends)
        at, row = tk.within_rows(first, self.n)
        element = tk.grams(words, self.n, 21)
        element = element[at] if len(at) else element[:0]
        counts = np.diff(first)
        few = np.flatnonzero((counts > 0) & (counts < self.n))
        if len(few):
            whole = np.array([tk.grams(words[first[r] : first[r + 1]], int(counts[r]), 21 + int(counts[r]))[0] for r in few], np.uint64)
            element, row = np.concatenate((element, whole)), np.concatenate((row, few))
        order = np.lexsort((element, row))
        element, row = element[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
        at = np.flatnonzero(new)
        return row[at], element[at], np.diff(np.concatenate((at, [len(row)])))

    def __call__(self, column: pa.Array, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, element), sorted by both, without repeats; ``counted`` turns the k-th occurrence of an element into one of its own."""
        row, element, times = self.counts(column)
        if not counted or not (times > 1).any():
            return row, element
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        row, element = np.repeat(row, times), np.repeat(element, times)
        element = np.where(nth > 0, tk.mix(element + nth.astype(np.uint64) * np.uint64(BASE_STEP), 23), element)
        order = np.lexsort((element, row))
        return row[order], element[order]


def dart_signatures(rows: int, row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, coordinates: int) -> np.ndarray:
    """``rows`` x ``coordinates`` packed darts (rank bits above, dart bits below); rows without elements keep the largest value."""
    nothing = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * coordinates, nothing, np.uint64)
    if not len(row):
        return out.reshape(rows, coordinates)
    weight = np.ones(len(row)) if weight is None else weight.astype(float)
    total = np.bincount(row, weight, rows)
    want = coordinates * math.log(coordinates) + 2 * coordinates
    cells = np.ceil(weight).astype(np.int64)
    index = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(index)) - np.repeat(np.cumsum(cells) - cells, cells)
    part = np.minimum(1.0, weight[index] - cell)
    seed0, row0 = tk.mix(element[index] + cell.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03), 31), row[index]
    limit = np.zeros(rows)
    limit[total > 0] = want / total[total > 0]
    todo = total > 0
    while todo.any():
        use = todo[row0]
        seed, at, share = seed0[use], row0[use], part[use]
        out.reshape(rows, coordinates)[todo] = nothing
        rank, k = np.zeros(len(seed)), 0
        while len(seed):
            dart = tk.mix(seed, 100 + k)
            rank = rank - np.log(((dart >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52)
            keep = rank < limit[at]
            seed, at, share, rank, dart = seed[keep], at[keep], share[keep], rank[keep], dart[keep]
            other = tk.mix(dart, 7)
            hit = (other >> np.uint64(40)).astype(float) * 2.0**-24 < share
            packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (other & np.uint64(0xFFFFFFFF))
            coordinate = ((dart & np.uint64(0xFFF)) * np.uint64(coordinates) >> np.uint64(12)).astype(np.int64)
            np.minimum.at(out, at[hit] * coordinates + coordinate[hit], packed[hit])
            k += 1
        todo = todo & (out.reshape(rows, coordinates) == nothing).any(axis=1)
        limit[todo] *= 2
    return out.reshape(rows, coordinates)


def sketches(docs: DataFrame, id_col: str, text_col: str, weights: Callable | None = None, counted: bool = False) -> DataFrame:
    """(id, set hash in two longs, hashed bands, bytes of text); the bands of a text without words are null."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1), 3 << 19):
                n = b - a
                row, element, times = shingler.counts(batch.column(1).slice(a, n))
                weight = weights(row, element) if weights else times if counted else None
                signature = dart_signatures(n, row, element, weight, ROWS * BANDS)
                bands = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    bands += signature[:, r * BANDS : (r + 1) * BANDS] * tk.multipliers(ROWS, 41)[r]
                bands = tk.mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(BASE_STEP)).view(np.int64)
                edges = np.searchsorted(row, np.arange(n + 1))
                full = edges[:-1] < edges[1:]
                sums = []
                for salt in (51, 53):
                    shares = tk.mix(element, salt) * times.astype(np.uint64) if counted else tk.mix(element, salt)
                    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shares)))
                    sums.append(pa.array((mixed[edges[1:]] - mixed[edges[:-1]]).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32)), pa.array(bands[full].ravel()))
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~full)) if n else lists
                chars = pc.fill_null(pc.binary_length(batch.column(1).slice(a, n)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).cast(pa.int64()), *sums, lists, chars], ["id", "set1", "set2", "bands", "chars"])

    return storage.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(tk.tidy(emit), "id long, set1 long, set2 long, bands array<long>, chars long")


BASE_STEP = 0x9E3779B97F4A7C15


def checked(pairs: DataFrame, n: int, docs: DataFrame, id_col: str, text_col: str, threshold: float, counted: bool = False) -> DataFrame:
    """Those (a, b) of ``pairs``, a cut table of up to ``n`` rows, whose texts reach ``threshold``, judged on all their word sequences.
    A text that very many pairs share is handed to several tasks."""
    texts = skew.possible(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), pairs.select("a").union(pairs.select("b")).toDF("id"), "id")
    often_a, often_b = (Heavy(pairs, [end], n, TEXT_FAN) for end in "ab")
    both = often_a.join(pairs, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "b")
    both = often_b.join(both, texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "a")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            sets: dict[int, np.ndarray] = {}
            for ids, texts in ((a, batch.column(2)), (b, batch.column(3))):
                fresh, where = np.unique(ids, return_index=True)
                use = [i for i, x in zip(where.tolist(), fresh.tolist(), strict=True) if x not in sets]
                some = texts.take(pa.array(use, pa.int64()))
                for s, e in tk.text_slices(some):
                    row, element = shingler(some.slice(s, e - s), counted)
                    edges = np.searchsorted(row, np.arange(e - s + 1))
                    for i in range(e - s):
                        sets[int(ids[use[s + i]])] = element[edges[i] : edges[i + 1]]
            keep = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                s, t = sets[x], sets[y]
                if len(s) > len(t):
                    s, t = t, s
                same = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s) if len(s) else 0
                keep.append(same >= threshold * (len(s) + len(t) - same) and same > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tk.tidy(judge), "a long, b long")


def linked_sets(row: np.ndarray, element: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked (left, right) members of different components; ``row`` and ``element`` hold every member's set."""
    sizes = np.bincount(row, minlength=len(component))
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    use = times[column] > 1
    row, column = row[use], column[use]
    if not len(row):
        return left[:0], right[:0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    same = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = np.zeros((len(component), 4096), np.float32)
        part[row[a:b], column[a:b] % 4096] = 1
        same += part[left] @ part[right].T
    most = sizes[left][:, None] + sizes[right][None, :] - same.astype(np.int64)
    linked = (same > 0) & (same >= threshold * most) & (component[left][:, None] != component[right][None, :])
    x, y = np.nonzero(linked)
    return left[x], right[y]


def across(open_: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, counted: bool = False) -> DataFrame:
    """Links between members of different components, for all buckets of ``open_`` (band, node, chars, component).

    A bucket's largest component and its other members ("rest") are dealt by hash into blocks; each block of the
    rest meets every block of the bucket. The rows handed out are the members times the blocks of the rest.
    """
    open_ = open_.groupBy("band", "node").agg(F.min("component").alias("component"), F.max("chars").alias("chars"))
    parts = open_.groupBy("band", "component").agg(F.count("*").alias("m"), F.sum("chars").alias("c"))
    sizes = parts.groupBy("band").agg(F.sum("m").alias("m"), F.sum("c").alias("c"), F.max(F.struct("m", "component", "c")).alias("top"))
    blocks = lambda m, c: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(c / BLOCK_CHARS)).cast("long")
    sizes = sizes.select("band", F.col("top.component").alias("largest"), blocks(F.col("m") - F.col("top.m"), F.col("c") - F.col("top.c")).alias("rest"), blocks(F.col("top.m"), F.col("top.c")).alias("tops"))
    spot = F.xxhash64(F.lit(3), "node")
    placed = open_.join(sizes, "band").withColumn("at", F.when(F.col("component") == F.col("largest"), F.col("rest") + F.pmod(spot, "tops")).otherwise(F.pmod(spot, "rest")))
    whole = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)
    meets = F.when(F.col("at") >= F.col("rest"), F.transform(whole, lambda i: F.struct(i.alias("low"), F.col("at").alias("high"))))
    meets = meets.otherwise(
        F.concat(
            F.transform(F.filter(whole, lambda i: i != F.col("at")), lambda i: F.struct(F.least(i, "at").alias("low"), F.greatest(i, F.col("at")).alias("high"))),
            F.transform(F.sequence(F.col("rest"), F.col("rest") + F.col("tops") - 1), lambda i: F.struct(F.col("at").alias("low"), i.alias("high"))),
        )
    )
    texts = skew.possible(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), open_.select(F.col("node").alias("id")).distinct(), "id")
    texts = texts.join(open_.select(F.col("node").alias("id")).distinct(), "id").dropDuplicates(["id", "text"]).withColumnRenamed("id", "node")
    met = placed.select("band", "node", "component", "at", "rest", F.explode(meets).alias("pair")).select("band", "node", "component", "at", "rest", "pair.low", "pair.high").join(texts, "node")

    def judge(group: pa.Table) -> pa.Table:
        shingler, rows, elements = Shingler(), [], []
        column = group.column("text").combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
        for a, b in tk.text_slices(column):
            row, element = shingler(column.slice(a, b - a), counted)
            rows.append(row + a)
            elements.append(element)
        node, component, at = (group.column(k).to_numpy() for k in ("node", "component", "at"))
        low, high, rest = (group.column(k)[0].as_py() for k in ("low", "high", "rest"))
        # The first block of the largest component also sees to the pairs inside a block of the rest.
        right = np.arange(len(node)) if high == rest else np.flatnonzero(at == high)
        x, y = linked_sets(np.concatenate(rows), np.concatenate(elements), component, np.flatnonzero(at == low), right, threshold)
        x, y = node[x], node[y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return met.groupBy("band", "low", "high").applyInArrow(tk.tidy_group(judge), "a long, b long").distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``class_id``, the smallest id of its class. The result is written, all else removed."""
    storage.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    repeated = storage.cut(rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col))
    if repeated.limit(1).count():
        found = _classes_of_repeated(rows, repeated, id_col, text_col, threshold, counted)
    else:
        found = _classes(rows, id_col, text_col, threshold, counted)
    storage.drop(repeated)
    return found


def _classes_of_repeated(rows: DataFrame, repeated: DataFrame, id_col: str, text_col: str, threshold: float, counted: bool) -> DataFrame:
    """The same where ids repeat: every different text of such an id takes part under a number of its own, so each pair is judged on its own
    texts; then the classes of one id's texts are joined."""
    scratch = storage.Scratch()
    n, low = rows.agg(F.count("*"), F.min(id_col)).first()
    low = min(low, 0)
    if low < -(1 << 62):
        raise ValueError("ids below -2^62 leave no room for numbers of repeated ids")
    texts = Heavy(rows, [id_col], n).join(rows, repeated, text_col).select(id_col, text_col).distinct()
    texts = scratch.cut(texts.select(id_col, text_col, (F.lit(low) - 1 - F.monotonically_increasing_id()).alias("number")))
    single = rows.join(F.broadcast(repeated) if repeated.count() < skew.FAN else repeated, id_col, "left_anti").select(id_col, text_col)
    parts = _classes(single.unionByName(texts.select(F.col("number").alias(id_col), text_col)), id_col, text_col, threshold, counted)
    scratch.tables.append(parts)
    named = parts.join(texts.select(F.col("number").alias(id_col), F.col(id_col).alias("real")), id_col, "left")
    named = scratch.cut(named.select(F.coalesce("real", id_col).alias("id"), F.col("class_id").alias("part")), n)
    first = named.where("id is not null").groupBy("id").agg(F.min("part").alias("first"))
    same = scratch.cut(skew.lookup(named, first, "id", "part", n).where("part <> first").select("part", "first").distinct(), n)
    joined = connected_components(same, "part", "first", scratch)
    whole = skew.lookup(named, joined.withColumnRenamed("node", "part"), "part", "id", n, "left").select("id", F.coalesce("component", "part").alias("part"))
    whole = scratch.cut(whole.distinct(), n)
    least = whole.groupBy("part").agg(F.min("id").alias("class_id"))
    classes = skew.lookup(whole, least, "part", "id", n).where("id is not null").select(F.col("id").alias(id_col), "class_id")
    found = storage.cut(skew.lookup(rows, classes, id_col, text_col, n, "left").select(id_col, "class_id"))
    scratch.close()
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, counted: bool) -> DataFrame:
    """Classes of rows whose ids do not repeat."""
    scratch = storage.Scratch()
    judge = dict(docs=docs, id_col=id_col, text_col=text_col, threshold=threshold, counted=counted)
    rows = scratch.cut(sketches(docs, id_col, text_col, counted=counted))
    total = rows.count()
    worded = rows.where("id is not null and bands is not null")
    nodes = scratch.cut(worded.groupBy("set1", "set2").agg(F.min("id").alias("node"), F.min("bands").alias("bands"), F.min("chars").alias("chars")), total, 10_000)
    in_bands = nodes.select("node", "chars", F.explode("bands").alias("band"))
    shared = scratch.cut(in_bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), 4 * total)
    crowded = Heavy(in_bands, ["band"], BANDS * total)
    members = scratch.cut(crowded.join(in_bands, shared, "node"), 8 * total)
    n = members.count()
    members = scratch.cut(members.join(members.groupBy("node").agg(F.sum("n").alias("score")), "node"), n)

    def hubs(of: DataFrame) -> DataFrame:
        return of.groupBy("band").agg(F.max(F.struct("score", (-F.col("node")).alias("node"))).alias("top")).select("band", (-F.col("top.node")).alias("hub"))

    def linked(pairs: DataFrame) -> DataFrame:
        return scratch.cut(checked(scratch.cut(pairs.distinct(), n), n, **judge))

    compared = scratch.cut(hubs(members), n)
    first = crowded.join(members, compared, "node").where("node <> hub").select(*_ordered("node", "hub"))
    labels = connected_components(linked(first), "a", "b", scratch)
    for round_ in range(HUB_ROUNDS + 1):
        named = members.join(labels, "node", "left").select("band", "node", "n", "score", "chars", F.coalesce("component", "node").alias("component"))
        mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
        open_ = scratch.cut(crowded.join(named, mixed, "node"), n)
        large = open_.where(F.col("n") > SMALL)
        if round_ == HUB_ROUNDS:
            found = scratch.cut(across(large, **judge))
        else:
            hub = hubs(large.join(compared.withColumnRenamed("hub", "node"), ["band", "node"], "left_anti"))
            own = hub.join(named.select("band", F.col("node").alias("hub"), F.col("component").alias("its")), ["band", "hub"])
            pairs = crowded.join(large, own, "node").where("node <> hub and component <> its").select(*_ordered("node", "hub"))
            if round_ == 0:
                small = open_.where(F.col("n") <= SMALL)
                other = small.select("band", F.col("node").alias("other"), F.col("component").alias("its"))
                pairs = pairs.unionByName(small.join(other, "band").where("node < other and component <> its").select(F.col("node").alias("a"), F.col("other").alias("b")))
            compared = scratch.cut(compared.unionByName(hub), n)
            found = linked(pairs)
        if found.limit(1).count():
            labels = extended(labels, found.select("a", "b"), n, scratch)
        elif round_ and round_ < HUB_ROUNDS:
            found = scratch.cut(across(large, **judge))
            labels = extended(labels, found.select("a", "b"), n, scratch)
            break
    copies = worded.select("id", "set1", "set2")
    alike = Heavy(copies, ["set1", "set2"], total).join(copies, nodes.select("set1", "set2", "node"), "id").select("id", "node")
    whole = Heavy(alike, ["node"], total).join(alike, labels, "id", "left").select("id", F.coalesce("component", "node").alias("class_id"))
    whole = whole.groupBy("id").agg(F.min("class_id").alias("class_id"))
    found = storage.cut(rows.select("id").join(whole, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id")))
    scratch.close()
    return found


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, counted: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id names their class; of rows that share an id one stays. Null ids stay."""
    classes = near_duplicate_classes(docs, id_col, text_col, threshold, counted)
    gone = classes.where(F.col("class_id") < F.col(id_col)).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    repeated = storage.cut(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col))
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col])
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).unionByName(once)
