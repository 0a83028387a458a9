"""Token ids in files of patched frame-of-reference blocks.

Format of a segment (little-endian), a whole number of documents in id order::

    "PFB1"  u32 documents  u64 ids  u32 blocks
    i64 document ids            (smallest value: null)
    u64 ids per document
    u32 block minima | u8 block widths | u8 exceptions per block | u64 block starts (from the first block)
    blocks

A block holds 128 ids (the last fewer, padded with its minimum): differences from the block's minimum, packed at the
width that fits a given percentile of them, then the exceptions, positions (u8) and full differences
(u32). Block starts make any block readable alone (``read_block``). A file is a Parquet container with one segment
per row, so any store that Spark writes to will do; shards and segments are numbered in id order.

Defined results for odd input: null text counts as empty (its only id is the end id); null ids come first;
rows that share an id are ordered by text; an empty table gives no segments; other columns are ignored. Control strings
of the tokenizer in a text become their ids, as the library does it by default, unless ``control_as_text`` is set.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import textkit as tk
from prismflow.llm.pool import Pool, file_digest, kept_in_worker

BLOCK, PERCENTILE = 128, 0.95
NULL_ID = np.iinfo(np.int64).min
SEGMENT_SCHEMA = "shard int, segment int, n_docs long, n_ids long, payload binary"
HEADER = "<4sIQI"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed by each number."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))) + 1, 0).astype(np.int64)


def _lanes(width: int) -> tuple[int, str]:
    """Bytes and type of the smallest machine number that holds ``width`` bits."""
    return (1, "u1") if width <= 8 else (2, "<u2") if width <= 16 else (4, "<u4")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 numbers below 2**width as rows of 16 * width bytes."""
    size, kind = _lanes(width)
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), BLOCK, size), axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    size, kind = _lanes(width)
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    if width == 8 * size:
        return np.packbits(bits, axis=2, bitorder="little").reshape(len(rows), BLOCK * size).view(kind)
    lanes = np.zeros((len(rows), BLOCK, 8 * size), np.uint8)
    lanes[:, :, :width] = bits
    return np.packbits(lanes, axis=2, bitorder="little").reshape(len(rows), BLOCK * size).view(kind)


def write_segment(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(ids)] = ids
    if blocks:
        grid[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = grid - least[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _bits(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    odd = rest >= (np.int64(1) << width)[:, None]
    exceptions = odd.sum(axis=1)
    length = BLOCK // 8 * width + 5 * exceptions
    start = np.cumsum(length) - length
    body = np.zeros(int(length.sum()), np.uint8)
    inside = np.where(odd, 0, rest)
    for w in np.unique(width).tolist():
        if w:
            of = np.flatnonzero(width == w)
            body[start[of][:, None] + np.arange(BLOCK // 8 * w)] = _pack(inside[of], w)
    row, place = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        list_at = start[row] + BLOCK // 8 * width[row]
        body[list_at + nth] = place
        values = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(list_at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return b"".join(
        [struct.pack(HEADER, b"PFB1", len(doc_ids), len(ids), blocks), doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), exceptions.astype(np.uint8).tobytes(), start.astype("<u8").tobytes(), body.tobytes()]
    )


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, self.blocks = struct.unpack_from(HEADER, data)
        if magic != b"PFB1":
            raise ValueError("not a segment")
        at = struct.calcsize(HEADER)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.sizes = take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.least, self.width, self.exceptions, self.start = take("<u4", self.blocks), take("u1", self.blocks), take("u1", self.blocks), take("<u8", self.blocks).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, -1, at)

    def _read(self, of: np.ndarray) -> np.ndarray:
        out = np.zeros((len(of), BLOCK), np.int64)
        width, count, start = self.width[of].astype(np.int64), self.exceptions[of].astype(np.int64), self.start[of]
        for w in np.unique(width).tolist():
            if w:
                some = np.flatnonzero(width == w)
                out[some] = _unpack(self.body[start[some][:, None] + np.arange(BLOCK // 8 * w)], w)
        row = np.repeat(np.arange(len(of)), count)
        if len(row):
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            list_at = start[row] + BLOCK // 8 * width[row]
            values = self.body[(list_at + count[row] + 4 * nth)[:, None] + np.arange(4)]
            out[row, self.body[list_at + nth]] = np.ascontiguousarray(values).view("<u4")[:, 0]
        return (out + self.least[of].astype(np.int64)[:, None]).astype(np.uint32)

    def read_block(self, k: int) -> np.ndarray:
        """Ids of block ``k`` alone."""
        return self._read(np.array([k]))[0][: min(BLOCK, self.n_ids - k * BLOCK)]

    def ids(self) -> np.ndarray:
        """All ids."""
        return self._read(np.arange(self.blocks)).ravel()[: self.n_ids]


#: The normalizer and pre-tokenizer for which texts may be encoded piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, BYTE_LEVEL]}
WORD_END = "</w>"


class WordEncoder:
    """The ids that a tokenizers model gives for whole texts.

    A model with the normalizer and pre-tokenizer above and word ends in its vocabulary drops white space and merges
    inside pieces only, so distinct pieces are encoded once. Texts of letters up to U+017F are cut into pieces here; for
    others words between blanks go to the library. Texts that hold a control string of the model, and all texts of other
    models, go to the library whole. With ``control_as_text`` control strings in texts are ordinary text.
    """

    MARKS = "★☆♥•…→†§"

    def __init__(self, path: str, control_as_text: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = control_as_text
        model, added = spec["model"], [t["content"] for t in spec["added_tokens"]]
        plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not spec["post_processor"] and not spec["truncation"] and not spec["padding"]
        bpe = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "unk_token", "ignore_merges"))
        special = all(t["special"] and not t["normalized"] for t in spec["added_tokens"])
        self.known = plain and bpe and special
        self.control = [] if control_as_text else added
        if not self.known:
            return
        lean = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTE_LEVEL]}}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        self.ends_word = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends_word[[i for token, i in model["vocab"].items() if token.endswith(WORD_END)]] = True
        #: Neither beyond Latin Extended-A, nor the capital that lower case makes two letters of, nor white space that libraries see differently.
        self.beyond = re.compile("[^\\x00-\u012f\u0131-\u017f]|[\x1c-\x1f\x85\xa0]")
        letters, digits = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
        self.pieces = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^ \t\n\x0b\f\r{letters}{digits}]+").findall
        self.mark, self.mark_id = next(((m, i[0]) for m in self.MARKS if len(i := self._ids(m)) == 1), ("", -1))
        self.piece_pool, self.word_pool = Pool(self._encode_pieces, 900_000), Pool(self._encode_words, 100_000)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self._ids(w) for w in words]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)

    def _in_parts(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """Many words a thousand at a time; where ``encode`` cannot tell the words apart, one by one."""
        out, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            flat, size = encode(some) or self._alone(some)
            out.append(flat)
            sizes.append(size)
        return np.concatenate(out).astype(np.uint32), np.concatenate(sizes)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces; the last id of a piece is one that ends a word."""

        def encode(some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
            ids = np.array(self.lean.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids])
            return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(some) and ends[-1] == len(ids) - 1 else None

        return self._in_parts(pieces, encode)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, parted by a mark whose single id cannot come from a word without the mark."""

        def encode(some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
            joined = f" {self.mark} ".join(some)
            if not self.mark or joined.count(self.mark) != len(some) - 1:
                return None
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            edges = np.concatenate(([-1], np.flatnonzero(ids == self.mark_id), [len(ids)]))
            return (ids[ids != self.mark_id], np.diff(edges) - 1) if len(edges) == len(some) + 1 else None

        return self._in_parts(words, encode)

    def _sorted_out(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Indexes of the texts to be encoded whole, and of those to be encoded word by word."""
        if not self.known:
            return list(range(len(texts))), []
        joined = "\n".join(texts)
        some = [c for c in self.control if c in joined]
        whole = [k for k, t in enumerate(texts) if any(c in t for c in some)] if some else []
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        after = raw[1:]
        suspect = (raw >= 0xC6).any() or ((raw >= 0x1C) & (raw <= 0x1F)).any() or ((raw[:-1] == 0xC4) & (after == 0xB0)).any() or ((raw[:-1] == 0xC2) & ((after == 0x85) | (after == 0xA0))).any()
        taken = set(whole)
        return whole, [k for k, t in enumerate(texts) if k not in taken and self.beyond.search(t)] if suspect else []

    def _pooled(self, pool: Pool, texts: list[list[str]]) -> list[np.ndarray]:
        ids, sizes = pool([x for text in texts for x in text])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole, wide = self._sorted_out(texts)
        taken = {*whole, *wide}
        narrow = [k for k in range(len(texts)) if k not in taken]
        out: list = [None] * len(texts)
        for k in whole:
            out[k] = np.array(self._ids(texts[k]), np.uint32)
        if wide:
            for k, ids in zip(wide, self._pooled(self.word_pool, [texts[k].replace("\n", " ").split(" ") for k in wide]), strict=True):
                out[k] = ids
        if narrow:
            for k, ids in zip(narrow, self._pooled(self.piece_pool, [self.pieces(texts[k].lower()) for k in narrow]), strict=True):
                out[k] = ids
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, control_as_text: bool = False) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending id order below ``path``."""
    storage.bounded_batches(docs.sparkSession)
    made_of = file_digest(tokenizer_path)
    size, cores = storage.scan_bytes(docs, text_col), docs.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-size // shard_bytes), min(cores, -(-size // (shard_bytes // 8))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = TaskContext.get().partitionId(), 0
        encode = kept_in_worker(f"word encoder {made_of} {control_as_text}", lambda: WordEncoder(tokenizer_path, control_as_text))
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1), 2 << 20):
                ids, sizes = encode([x or "" for x in batch.column(1).slice(a, b - a).to_pylist()])
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                doc_ids = batch.column(0).slice(a, b - a).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                payload = write_segment(doc_ids, sizes + 1, ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([b - a], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["shard", "segment", "n_docs", "n_ids", "payload"])
                segment += 1

    ordered.mapInArrow(tk.tidy(write), SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """(shard, segment, start): the number of ids before each segment. Only one row per shard is ordered globally."""
    sizes = files.select("shard", "segment", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return inner.join(base, "shard").select("shard", "segment", (F.col("base") + F.col("inner")).alias("before"))


def digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start, n_tokens, CRC-32 of its ids (little-endian, 32 bits each)."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    names = ["shard", "segment", "id", "first", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                segment = Segment(payload)
                data, ends = segment.ids().astype("<u4").tobytes(), np.cumsum(segment.sizes)
                first = ends - segment.sizes
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(segment.doc_ids, mask=segment.doc_ids == NULL_ID)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), ids, pa.array(first), pa.array(segment.sizes), pa.array(crc, pa.int64())], names)

    found = files.select("shard", "segment", "payload").mapInArrow(tk.tidy(read), "shard int, segment int, id long, first long, n_tokens long, ids_crc32 long")
    placed = found.join(segment_starts(files), ["shard", "segment"])
    return placed.select(F.col("id").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
