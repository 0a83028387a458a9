"""Incremental removal of repeated 13-word passages with a log-structured fingerprint index.

A window is ``span`` consecutive words of one document (words are runs of bytes other than
ASCII white space). A word goes if some window covering it has a word sequence that also
starts in an earlier document: one of an earlier batch, or one of the same batch with a smaller id.

The index is a folder that outlives the session. It follows a log-structured merge tree:

* The documents of a batch are packed into *chunks* of about a megabyte (Arrow IPC, compressed), addressed by number
  and stored as a table clustered by number.
* The fingerprints of a batch's windows are dealt into buckets, and every bucket is written once as a sorted,
  immutable *run* of (fingerprint, chunk). The fingerprint of a window is the smallest hash among its 5-word
  sequences, so equal windows have equal fingerprints and a run holds about a fifth as many entries as there are windows.
  Runs form a table clustered by bucket: only new data moves when a batch meets its history.
* A new batch is merge-joined, bucket by bucket, with the runs of all earlier batches and with itself.
* Hits are *verified*: every chunk holding a hit recomputes the windows behind it, and the windows are
  compared by a 96-bit BLAKE2b digest of their bytes together with the document ids.
* ``compact`` merges the runs into one. ``state.json`` names the live runs; a step that it does not name never happened.

Sizes: a fingerprint or digest occurs once per chunk at most, so however often a passage repeats, its
bucket grows by one entry (16 bytes or less) per megabyte of text. A batch is meant to be up to ``BATCH_BYTES``; ``digests``
and ``without_repeats`` deal larger tables into more batches by id. The history has no bound: a bucket's share of
it is its runs' entries alone (about 0.2 bytes per byte of text over all buckets).

Defined results for odd input: null text counts as empty; a null id counts as larger than all others;
rows of a batch that share an id are not each other's predecessors; texts shorter than a window are left alone;
an empty table gives an empty result; columns other than id and text are carried through untouched,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismflow import storage
from prismflow.llm import textkit as tk

SPAN, SHORT = 13, 5
LAST_ID, EARLIER = np.iinfo(np.int64).max, np.iinfo(np.int64).min
BATCH_BYTES = 1 << 40
CHUNK_BYTES = 1 << 20
#: Chunks whose fingerprints a task gathers before it deals them into buckets.
GATHER = 16
CHUNK_SCHEMA = "chunk long, blob binary"
RUN_SCHEMA = "bucket int, chunk long, marks binary, chunks binary, kind string"


def _pack(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as source:
        return source.read_next_batch()


def chunked(docs: DataFrame, step: int, limit: int = CHUNK_BYTES) -> DataFrame:
    """``docs``, with the id first and the text second, as chunks; the number names step, task and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (step << 44) + (TaskContext.get().partitionId() << 20)
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1), limit):
                blob = _pack(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([blob], pa.binary())], ["chunk", "blob"])
                number += 1

    return storage.spread(docs).mapInArrow(tk.tidy(pack), CHUNK_SCHEMA)


class _Windows:
    """All windows of a chunk: index of the first word, row, fingerprint."""

    def __init__(self, hasher: tk.WordHasher, batch: pa.RecordBatch):
        self.raw, self.offsets = tk.text_bytes(batch.column(1))
        self.starts, self.ends, self.first = tk.word_spans(self.raw, self.offsets, tk.separators("space"))
        words = hasher(self.raw, self.starts, self.ends)
        self.at, row = tk.within_rows(self.first, SPAN)
        self.ids = pc.fill_null(batch.column(0).cast(pa.int64()), LAST_ID).to_numpy(zero_copy_only=False)
        self.id = self.ids[row]
        m = tk.grams(words, SHORT, 3)
        width = SPAN - SHORT + 1
        step = 1
        while 2 * step <= width:
            m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
            step *= 2
        rest = width - step
        if rest:
            m = np.minimum(m[:-rest], m[rest:]) if len(m) > rest else m[:0]
        self.mark = m[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def rows(self) -> Iterator[list[bytes]]:
        """The words of each row."""
        data = self.raw.tobytes()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield data[a:b].split()

    def digests(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digest (64 and 32 bits) of the bytes of windows ``of``, their words joined by one space."""
        text = b" ".join(b" ".join(words) for words in self.rows() if words)
        size = self.ends - self.starts
        start = np.cumsum(size + 1) - size - 1
        first = self.at[of]
        low, high = start[first].tolist(), (start + size)[first + SPAN - 1].tolist()
        made = b"".join([hashlib.blake2b(text[a:b], digest_size=12).digest() for a, b in zip(low, high, strict=True)])
        found = np.frombuffer(made, np.dtype([("full", "<u8"), ("check", "<u4")]))
        return found["full"].copy(), found["check"].copy()


def _split(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bounds of each bucket within sorted ``keys`` of ``bits`` significant bits."""
    shift = bits - (buckets.bit_length() - 1)
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(shift)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def _compact_marks(mark: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bucket bits and 32 more."""
    return mark >> np.uint64(32 - (buckets.bit_length() - 1))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype("<u2" if numbers.max(initial=0) < 1 << 16 else "<u4")


def _read_run(marks: bytes, chunks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and chunk numbers of a run's bucket."""
    low = np.frombuffer(marks, "<u4")
    n = int(np.frombuffer(chunks[:8], "<i8")[0])
    numbers = np.frombuffer(chunks[8 : 8 + 8 * n], "<i8")
    rest = chunks[8 + 8 * n :]
    index = np.frombuffer(rest, "<u2" if len(rest) == 2 * len(low) else "<u4")
    return low, numbers[index]


def _write_run(low: np.ndarray, chunk: np.ndarray) -> tuple[bytes, bytes]:
    numbers, index = np.unique(chunk, return_inverse=True)
    return low.astype("<u4").tobytes(), np.int64(len(numbers)).tobytes() + numbers.astype("<i8").tobytes() + _narrow(index).tobytes()


#: Added to a chunk number of a new batch whose fingerprint two of its documents share.
SEVERAL = 1 << 62


def marks_of(chunks: DataFrame, buckets: int) -> DataFrame:
    """Small sorted runs of the chunks' distinct fingerprints: per bucket one for every ``GATHER`` chunks of a task."""
    bits = 32 + buckets.bit_length() - 1

    def flush(keys: list, numbers: list) -> pa.RecordBatch:
        key, number = np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(key, kind="stable")
        key, number = key[order], number[order]
        bounds = _split(key, bits, buckets)
        full = np.flatnonzero(bounds[:-1] < bounds[1:]).tolist()
        low = key & np.uint64(0xFFFFFFFF)
        made = [_write_run(low[bounds[b] : bounds[b + 1]], number[bounds[b] : bounds[b + 1]]) for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))], ["bucket", "marks", "chunks"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher(quick=True)
        keys, numbers = [], []
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = _Windows(hasher, _unpack(blob))
                key = _compact_marks(w.mark, buckets)
                order = np.lexsort((w.id, key))
                key, ids = key[order], w.id[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(new)
                ends = np.concatenate((at[1:], [len(key)]))[: len(at)]
                several = ids[at] != ids[ends - 1] if len(at) else np.zeros(0, bool)
                keys.append(key[at])
                numbers.append(number + SEVERAL * several.astype(np.int64))
                if len(keys) == GATHER:
                    yield flush(keys, numbers)
                    keys, numbers = [], []
        if keys:
            yield flush(keys, numbers)

    return chunks.select("chunk", "blob").mapInArrow(tk.tidy(emit), "bucket int, marks binary, chunks binary")


def _run_arrow() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("marks", pa.binary()), ("chunks", pa.binary()), ("kind", pa.string())])


def _runs_in(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for marks, chunks in zip(table["marks"].to_pylist(), table["chunks"].to_pylist(), strict=True):
        yield _read_run(marks, chunks)


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several sorted runs as one; the stable sort merges the sorted stretches that it finds."""
    low, chunk = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(low, kind="stable")
    return low[order], chunk[order]


def merge_join(new: pa.Table, old: pa.Table) -> pa.Table:
    """One bucket: fingerprints of a new batch against themselves and the earlier runs; gives the new run and, per chunk, its hits."""
    out: dict[str, list] = {name: [] for name in _run_arrow().names}
    if not new.num_rows:
        return pa.table(out, schema=_run_arrow())
    bucket = new["bucket"][0].as_py()

    def add(number: int | None, marks: bytes, chunks: bytes | None, kind: str) -> None:
        for name, value in zip(out, (bucket, number, marks, chunks, kind), strict=True):
            out[name].append(value)

    low, chunk = _merged(list(_runs_in(new)))
    several, chunk = chunk >= SEVERAL, chunk % SEVERAL
    starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    size = np.diff(np.concatenate((starts, [len(low)])))
    distinct = low[starts]
    hit = (size > 1) | np.logical_or.reduceat(several, starts)
    hit_marks, hit_chunks = [], []
    for run, numbers in _runs_in(old):
        at = np.minimum(np.searchsorted(distinct, run), len(distinct) - 1)
        met = distinct[at] == run
        hit[at[met]] = True
        hit_marks.append(run[met])
        hit_chunks.append(numbers[met])
    add(None, *_write_run(low, chunk), "run")
    every = np.repeat(hit, size)
    m, c = np.concatenate([low[every], *hit_marks]), np.concatenate([chunk[every], *hit_chunks])
    by = np.lexsort((m, c))
    m, c = m[by], c[by]
    edges = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True]))) if len(c) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        add(int(c[a]), m[a:b].tobytes(), None, "hit")
    return pa.table(out, schema=_run_arrow())


def merge_runs(table: pa.Table) -> pa.Table:
    """One bucket: several runs into one."""
    marks, chunks = _write_run(*_merged(list(_runs_in(table))))
    return pa.table({"bucket": [table["bucket"][0].as_py()], "chunk": [None], "marks": [marks], "chunks": [chunks], "kind": ["run"]}, schema=_run_arrow())


class FingerprintIndex:
    """The index below ``path``, made if there is none. ``expected`` bytes of text, all batches together, fix how many
    buckets a new index has; more text than that makes buckets larger, nothing else."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 1 << 30):
        self.spark, self.path = spark, path.rstrip("/")
        found = storage.read_text(spark, f"{self.path}/state.json")
        self.state = json.loads(found) if found else {
            "span": SPAN,
            "buckets": 1 << min(17, max(3, (expected >> 23).bit_length())),
            "chunk_buckets": max(8, min(1 << 17, expected >> 23)),
            "runs": [],
            "batches": [],
            "next": 1,
        }
        if self.state["span"] != SPAN:
            raise ValueError("the index was made with another window")
        self.buckets, tag = self.state["buckets"], uuid.uuid4().hex
        self.runs_table, self.chunks_table = f"prismflow_runs_{tag}", f"prismflow_chunks_{tag}"
        spark.sql(f"CREATE TABLE {self.runs_table} ({RUN_SCHEMA}, step INT) USING parquet PARTITIONED BY (kind, step) CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")
        spark.sql(f"CREATE TABLE {self.chunks_table} ({CHUNK_SCHEMA}, step INT) USING parquet PARTITIONED BY (step) CLUSTERED BY (chunk) SORTED BY (chunk) INTO {self.state['chunk_buckets']} BUCKETS LOCATION '{self.path}/chunks'")
        if found:
            for name in (self.runs_table, self.chunks_table):
                spark.sql(f"MSCK REPAIR TABLE {name}")

    def close(self) -> None:
        """Forget the tables' names in this session; the files stay."""
        for name in (self.runs_table, self.chunks_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _commit(self, **changes) -> None:
        self.state |= changes
        storage.write_text(self.spark, f"{self.path}/state.json", json.dumps(self.state))

    def _clear(self, step: int) -> None:
        """Remove what an unfinished attempt at ``step`` has left."""
        for folder in (f"chunks/step={step}", f"runs/kind=run/step={step}", f"runs/kind=hit/step={step}"):
            storage.remove(self.spark, f"{self.path}/{folder}")

    def _chunks(self, steps: list[int]) -> DataFrame:
        return self.spark.table(self.chunks_table).where(F.col("step").isin(steps))

    def _kind(self, kind: str, steps: list[int]) -> DataFrame:
        return self.spark.table(self.runs_table).where((F.col("kind") == kind) & F.col("step").isin(steps))

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch (id first, text second, any other columns); gives its chunks as (blob, hits, flags)."""
        step = self.state["next"]
        self._clear(step)
        new = chunked(docs, step).repartition(self.state["chunk_buckets"], "chunk")
        new.select("chunk", "blob", F.lit(step).alias("step")).write.insertInto(self.chunks_table)
        chunks = self._chunks([step])
        marks, earlier = marks_of(chunks, self.buckets), self._kind("run", self.state["runs"])
        merged = marks.groupBy("bucket").cogroup(earlier.select("bucket", "marks", "chunks").groupBy("bucket")).applyInArrow(merge_join, RUN_SCHEMA)
        merged.withColumn("step", F.lit(step)).write.insertInto(self.runs_table)
        before = self.state["batches"]
        self._commit(runs=[*self.state["runs"], step], batches=[*before, step], next=step + 1)
        return verified(self._chunks([*before, step]), self._kind("hit", [step]), step, self.buckets, 1 << min(12, self.buckets.bit_length() - 1), self.state["chunk_buckets"])

    def compact(self) -> None:
        """Merge all runs into one; buckets stay where they are."""
        old = self.state["runs"]
        if len(old) < 2:
            return
        step = self.state["next"]
        self._clear(step)
        one = self._kind("run", old).select("bucket", "marks", "chunks").groupBy("bucket").applyInArrow(tk.tidy_group(merge_runs), RUN_SCHEMA)
        one.withColumn("step", F.lit(step)).write.insertInto(self.runs_table)
        self._commit(runs=[step], next=step + 1)
        for gone in old:
            self.spark.sql(f"ALTER TABLE {self.runs_table} DROP IF EXISTS PARTITION (kind='run', step={gone})")
            storage.remove(self.spark, f"{self.path}/runs/kind=run/step={gone}")


def _candidates(w: _Windows, hits: list, buckets: int) -> np.ndarray:
    """Indexes of windows whose fingerprint was hit."""
    top = [np.frombuffer(h["marks"], "<u4").astype(np.uint64) | (np.uint64(h["bucket"]) << np.uint64(32)) for h in hits or []]
    if not top or not len(w.mark):
        return np.zeros(0, np.int64)
    wanted = np.unique(np.concatenate(top))
    key = _compact_marks(w.mark, buckets)
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    return np.flatnonzero(wanted[at] == key)


class _Entries:
    """Distinct windows among a chunk's candidates, in digest order, each with its smallest id."""

    def __init__(self, w: _Windows, cand: np.ndarray):
        self.cand = cand
        full, check = w.digests(cand)
        ids = w.id[cand]
        order = np.lexsort((ids, check, full))
        f, c = full[order], check[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        self.full, self.check, self.ids = f[at], c[at], ids[order][at]
        self.entry = np.empty(len(f), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def verified(chunks: DataFrame, hits: DataFrame, step: int, buckets: int, parts: int, chunk_buckets: int) -> DataFrame:
    """The chunks of ``step`` as (blob, hits, flags): flags tell, per part of the digests, which entries have a predecessor.
    Hits and flags are dealt as the chunks are clustered, so the chunks stay where they are."""
    per_chunk = hits.repartition(chunk_buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks")).alias("hits"))
    with_hits = chunks.select("chunk", "blob", "step").join(per_chunk, "chunk", "left")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher(quick=True)
        for batch in batches:
            for number, blob, of, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = _Windows(hasher, _unpack(blob))
                e = _Entries(w, _candidates(w, found, buckets))
                if not len(e.full):
                    continue
                bounds = _split(e.full, 64, parts)
                old = of != step
                base = 0 if old else int(e.ids.min())
                offset = e.ids.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
                offset = np.zeros(0, "<u4") if old else offset.astype("<u4" if offset.max() < 1 << 32 else "<u8")
                full = np.flatnonzero(bounds[:-1] < bounds[1:]).tolist()
                cut = [slice(bounds[b], bounds[b + 1]) for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([None if old else number] * len(full), pa.int64()), pa.array([base] * len(full), pa.int64())]
                    + [pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (e.full.astype("<u8"), e.check.astype("<u4"), offset)],
                    ["part", "chunk", "base", "full", "checks", "offsets"],
                )

    def decide(table: pa.Table) -> pa.Table:
        digests, checks, ids, sizes = [], [], [], []
        for number, base, full, check, offsets in zip(*(table[c].to_pylist() for c in ("chunk", "base", "full", "checks", "offsets")), strict=True):
            digests.append(np.frombuffer(full, "<u8"))
            checks.append(np.frombuffer(check, "<u4"))
            n = len(digests[-1])
            sizes.append(n)
            if number is None:
                ids.append(np.full(n, EARLIER))
            else:
                wide = np.frombuffer(offsets, "<u4" if len(offsets) == 4 * n else "<u8").astype(np.uint64)
                ids.append((wide + np.uint64(base & 0xFFFFFFFFFFFFFFFF)).astype(np.int64))
        full, check, id_ = (np.concatenate(p) for p in (digests, checks, ids))
        order = np.lexsort((id_, check, full))
        f, c, i = full[order], check[order], id_[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        flag = np.empty(len(f), bool)
        flag[order] = least < i
        edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
        answers = [(k, np.packbits(flag[a:b]).tobytes()) for k, a, b in zip(table["chunk"].to_pylist(), edges[:-1], edges[1:], strict=True) if k is not None]
        return pa.table({"chunk": pa.array([a[0] for a in answers], pa.int64()), "part": pa.array([table["part"][0].as_py()] * len(answers), pa.int32()), "flags": pa.array([a[1] for a in answers], pa.binary())})

    entries = with_hits.where("hits is not null").select("chunk", "blob", "step", "hits").mapInArrow(tk.tidy(emit), "part int, chunk long, base long, full binary, checks binary, offsets binary")
    flags = entries.groupBy("part").applyInArrow(tk.tidy_group(decide), "chunk long, part int, flags binary")
    per_chunk = flags.repartition(chunk_buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "flags")).alias("flags"))
    return with_hits.where(F.col("step") == step).join(per_chunk, "chunk", "left").select("blob", "hits", "flags", F.lit(buckets).alias("buckets"), F.lit(parts).alias("parts"))


def repeated_words(hasher: tk.WordHasher, batch: pa.RecordBatch, found: list, flags: list, buckets: int, parts: int) -> tuple[_Windows, np.ndarray]:
    """Windows of a chunk and, per word, whether it goes."""
    w = _Windows(hasher, batch)
    e = _Entries(w, _candidates(w, found, buckets))
    gone = np.zeros(len(w.starts) + 1, np.int64)
    if len(e.full):
        bounds = _split(e.full, 64, parts)
        later = np.zeros(len(e.full), bool)
        for f in flags or []:
            a, b = bounds[f["part"]], bounds[f["part"] + 1]
            later[a:b] = np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=b - a).astype(bool)
        drop = later[e.entry] | (w.id[e.cand] > e.ids[e.entry])
        at = w.at[e.cand[drop]]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + SPAN, -1)
    return w, np.cumsum(gone)[:-1] > 0


def kept_texts(w: _Windows, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Per row: words, removed words, the kept words joined by a space."""
    keep = ~gone
    for words, a, b in zip(w.rows(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        lost = int(b - a - np.count_nonzero(keep[a:b]))
        yield b - a, lost, b" ".join(compress(words, keep[a:b].tolist()) if lost else words)


def _resolved_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    """Each chunk with what ``kept_texts`` says of its rows."""
    hasher = tk.WordHasher(quick=True)
    for batch in rows:
        for blob, hits, flags, buckets, parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            chunk = _unpack(blob)
            yield chunk, list(kept_texts(*repeated_words(hasher, chunk, hits, flags, buckets, parts)))


def digest_rows(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of a batch, as ``FingerprintIndex.add`` gives it: id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, out in _resolved_rows(rows):
            n, lost, sha = zip(*((n, lost, hashlib.sha256(text).hexdigest()) for n, lost, text in out), strict=True)
            yield pa.RecordBatch.from_arrays([chunk.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], [id_col, "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(tk.tidy(apply), f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")


def cut_rows(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of a batch (of ``schema``, id first, text second) with repeated passages cut out. Texts that lose nothing stay as they are; a text that loses every word goes."""

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, out in _resolved_rows(rows):
            old = chunk.column(1).to_pylist()
            texts = [text.decode() if lost else was for was, (_, lost, text) in zip(old, out, strict=True)]
            columns = [chunk.column(0), pa.array(texts, chunk.schema.field(1).type), *chunk.columns[2:]]
            keep = pa.array([not (n and n == lost) for n, lost, _ in out])
            yield pa.RecordBatch.from_arrays(columns, schema=chunk.schema).filter(keep)

    return found.mapInArrow(tk.tidy(apply), schema)


def batches_by_id(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """``docs`` in up to ``n`` parts of ascending ids, about equally large; null ids are in the last."""
    id_ = F.col(id_col).cast("long")
    edges = docs.agg(F.percentile_approx(id_, [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    parts, low = [], F.lit(True)
    for edge in sorted(set(edges or [])):
        parts.append(docs.where(low & (id_ <= edge)))
        low = id_ > edge
    parts.append(docs.where(F.coalesce(low, F.lit(True))))
    return parts


def _each_batch(docs: DataFrame, id_col: str, text_col: str, batches: int, path: str, use) -> tuple[DataFrame, FingerprintIndex]:
    """What ``use`` makes of all batches, and the index, to be closed when that has been written: it reads the index's tables."""
    spark = docs.sparkSession
    storage.bounded_batches(spark)
    size = storage.scan_bytes(docs, text_col)
    index = FingerprintIndex(spark, path, size)
    ordered = docs.select(id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col)))
    out = None
    for part in batches_by_id(ordered, id_col, max(batches, -(-size // BATCH_BYTES))):
        found = use(index.add(part))
        out = found if out is None else out.unionByName(found)
    index.compact()
    return out, index


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Per row: id, n_words, n_removed and the SHA-256 of the kept words joined by one space; the index is removed afterwards."""
    path = storage.fresh_path(docs.sparkSession, "fingerprints")
    rows, index = _each_batch(docs.select(id_col, text_col), id_col, text_col, batches, path, lambda x: digest_rows(x, id_col))
    found = storage.cut(rows)
    index.close()
    storage.remove(docs.sparkSession, path)
    return found


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, index_path: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out, those of documents that the index at ``index_path`` already holds included.

    Without a path the index is a transient one (``storage.clean`` removes it). The result reads the index's tables.
    """
    path = index_path or storage.transient(docs.sparkSession, "fingerprints")
    schema = docs.select(id_col, text_col, *(c for c in docs.columns if c not in (id_col, text_col))).schema
    rows, index = _each_batch(docs, id_col, text_col, batches, path, lambda x: cut_rows(x, schema))
    storage.later(docs.sparkSession, index.close)
    return rows.select(*docs.columns)
