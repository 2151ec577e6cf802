"""Token ids in a directly addressable binary format.

Documents are range-partitioned and sorted by id, encoded, and written as
*segments*: each holds the ids of whole documents as directly addressable
codes. An id is cut into 8-bit chunks; level 0 has the low chunk of every id,
level 1 the next chunk of those ids that continue, and so on. Beside each level
lie a bitmap (does this id continue?) and a rank directory (how many continue
before each block of 512), so any single token is read with one rank for each
level, without decoding a block.

A segment is a row of a Parquet table in the shared folder: Spark's commit
protocol makes the write safe when an executor is lost.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, shuffle_width
from .text import text_slices

BLOCK = 512
SEGMENT_TOKENS = 1 << 20
SEGMENTS = "part int, seg int, first long, n_tokens long, doc_ids array<long>, ends array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunk levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    chunks, bitmaps, ranks = [], [], []
    left = np.asarray(ids, np.uint32)
    while True:
        chunks.append((left & 255).astype(np.uint8).tobytes())
        left = left >> 8
        goes_on = left > 0
        bitmaps.append(np.packbits(goes_on, bitorder="little").tobytes())
        blocks = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK)) if len(goes_on) else np.zeros(0)
        ranks.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
        left = left[goes_on]
        if not len(left):
            return chunks, bitmaps, ranks


def dac_decode(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    out = np.zeros(0, np.uint32)
    for chunk, bits in zip(reversed(chunks), reversed(bitmaps), strict=True):
        level = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(level), bitorder="little").view(bool)
        level[goes_on] |= out << 8
        out = level
    return out


def dac_access(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i``: one rank for each level, no block is decoded."""
    value = 0
    for level in range(len(chunks)):
        value |= chunks[level][i] << (8 * level)
        if not bitmaps[level][i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK
        before = bitmaps[level][block * BLOCK // 8 : i // 8 + 1]
        bits = int.from_bytes(before, "little") & ((1 << (i - block * BLOCK)) - 1)
        i = int(np.frombuffer(ranks[level], "<u4")[block]) + bits.bit_count()
    raise ValueError("the last level can't go on")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceIds(dict):
    """Text between ASCII blanks -> its ids as little-endian unsigned 32-bit integers; emptied when full.

    The tokenizer's normalizer lower-cases and maps every run of blanks to one,
    and its pre-tokenizer drops it, so a text's ids are those of its pieces one
    after another (the tests compare with whole texts). New pieces are encoded
    many at a time, with a mark between them that no other text has as a token.
    """

    LIMIT = 900_000
    #: Signs that may serve as the mark; the first that is one token is taken.
    MARKS, GROUP = "\u00a4\u2605\u2665\u20ac\u2122\u00a9\u00bb", 256

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        single = [(c, i) for c in self.MARKS if len(i := self.tok.encode(c, add_special_tokens=False).ids) == 1]
        self.sign, self.mark = (single[0][0], single[0][1][0]) if single else ("", None)

        vocabulary = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, pieces: set[bytes]) -> None:
        """Encode what is new. A comma or stop after an ASCII letter is a run of signs of its own, so the word before it serves both."""
        if len(self) + len(pieces) > self.LIMIT:
            self.clear()
        new = [p for p in pieces if p not in self]
        stopped = [p for p in new if p[-1] in b",." and p[-2:-1].isalpha()]
        words = set(new).difference(stopped)
        words.update(p[:-1] for p in stopped)
        words.update((b",", b"."))
        letters, others = [], []
        for p in words:
            if p not in self:
                (letters if p.isalpha() or p.decode().isalpha() else others).append(p)
        for group, ids in self._batches(letters, " "):
            self._cut(group, ids, np.flatnonzero(self.ends_word[ids]) + 1)
        if self.mark is None:
            self._one_by_one(others)
        else:
            for group, ids in self._batches(others, f" {self.sign} "):
                self._cut(group, ids, np.append(np.flatnonzero(ids == self.mark) + 1, len(ids) + 1), 1)
        for p in stopped:
            self[p] = self[p[:-1]] + self[p[-1:]]

    def _batches(self, pieces: list[bytes], between: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for at in range(0, len(pieces), 64 * self.GROUP):
            groups = [pieces[i : i + self.GROUP] for i in range(at, min(at + 64 * self.GROUP, len(pieces)), self.GROUP)]
            joined = [between.join(p.decode() for p in g) for g in groups]
            for group, e in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                yield group, np.array(e.ids, "<u4")

    def _cut(self, group: list[bytes], ids: np.ndarray, after: np.ndarray, gap: int = 0) -> None:
        """Each piece's ids end before ``after``, less ``gap`` marks; if the numbers don't fit, one by one."""
        if len(after) != len(group):
            self._one_by_one(group)
            return
        raw, start = ids.tobytes(), 0
        for p, end in zip(group, (4 * after).tolist(), strict=True):
            self[p] = raw[start : end - 4 * gap]
            start = end

    def _one_by_one(self, pieces: list[bytes]) -> None:
        for p, e in zip(pieces, self.tok.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False), strict=True):
            self[p] = np.array(e.ids, "<u4").tobytes()


def encode_texts(texts: list[bytes], cache: PieceIds, end: bytes) -> list[bytes]:
    split = [t.lower().split() for t in texts]
    cache.learn(set().union(*split))
    return [b"".join(map(cache.__getitem__, pieces)) + end for pieces in split]


@functools.lru_cache(maxsize=2)
def piece_cache(path: str) -> PieceIds:
    """One cache for a worker process, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceIds(path)


def _segments(path: str, end_id: int | None, id_col: str, text_col: str):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = piece_cache(path)
        part, seg, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, first, size
            ids = np.frombuffer(b"".join(held), "<u4")
            chunks, bitmaps, ranks = dac_encode(ids)
            ends = np.cumsum([len(x) // 4 for x in held])
            row = {"part": part, "seg": seg, "first": first, "n_tokens": len(ids), "doc_ids": doc_ids.copy(), "ends": ends.tolist(), "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}
            seg, first, size = seg + 1, first + len(ids), 0
            doc_ids.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for b, texts in text_slices(batches, text_col):
            for i, x in zip(b.column(b.schema.get_field_index(id_col)).to_pylist(), encode_texts(texts, cache, end), strict=True):
                doc_ids.append(i)
                held.append(x)
                size += len(x) // 4
                if size >= SEGMENT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


SCHEMA = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode every whole text and write the ids in ascending id order; returns the path.

    Null text: no ids but the end id. Null document ids come first. Repeated
    rows are written once each, ties in text order. An empty table gives a
    table without segments. Other columns are not read. The id must be an
    integer. Segments hold whole documents: a very long one has its own.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(shuffle_width(spark), "id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(_segments(tokenizer_path, end_id, "id", "text"), SEGMENTS)
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the place of their first token in the whole corpus.

    The prefix sum runs over one total for each written partition, not over rows.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return segments.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("first"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: id, start, length, checksum; read from the segments alone."""
    for b in batches:
        for r in range(b.num_rows):
            row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
            ids = dac_decode(row["chunks"].as_py(), row["bitmaps"].as_py()).astype("<u4")
            ends = np.asarray(row["ends"].as_py(), np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(starts + row["start"].as_py(), pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_segments(spark, path).select("start", "doc_ids", "ends", "chunks", "bitmaps").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document the ids themselves: ``doc_id, ids array<int>``."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, at = dac_decode(row["chunks"], row["bitmaps"]), 0
                for doc_id, end in zip(row["doc_ids"], row["ends"], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids[at:end].astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    at = end

    return spark.read.schema(SEGMENTS).parquet(path).select("doc_ids", "ends", "chunks", "bitmaps").mapInArrow(run, "doc_id long, ids array<int>")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Random access: the token at each ``place`` (long) of the corpus, ``place, token``; places outside, and nulls, are left out.

    Places find their segment by the segment's 1M-token bins (an equi-join without
    codes) and are gathered by segment, each distinct place once with its count, so a
    segment is sent and read once. Each token is read by rank.
    """
    width = SEGMENT_TOKENS
    seg = read_segments(spark, path).where("n_tokens > 0")
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))
    spans = seg.select("start", "n_tokens", F.explode(bins).alias("bin"))
    asked = places.groupBy("place").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("place") / width))
    asked = asked.join(spans, "bin").where("place >= start and place < start + n_tokens")
    asked = asked.groupBy("start").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                tokens = [dac_access(r["chunks"], r["bitmaps"], r["ranks"], p - r["start"]) for p in r["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["places"], pa.int64()), pa.array(tokens, pa.int32()), pa.array(r["counts"], pa.int64())], names=["place", "token", "n"])

    read = seg.join(asked, "start").select("start", "chunks", "bitmaps", "ranks", "places", "counts")
    read = read.mapInArrow(run, "place long, token int, n long")
    return read.select("place", "token", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")
