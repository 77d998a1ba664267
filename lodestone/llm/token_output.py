"""Token ids as compressed binary files: static range asymmetric numeral systems.

Documents are ordered by identifier over range partitions; each partition is
tokenised and becomes one file, or several of about FILE_BYTES.  A file is a row
of segments of about
SEGMENT_IDS ids: a frequency table, then blocks of whole documents that share
it (a very long document's block stands alone).  A block is coded by up to
LANES interleaved coders and keeps their checkpoints (final states and the
number of words), its documents' identifiers and lengths, and a checksum, so
that any block decodes alone, in parallel.

A file: MAGIC, segments, footer (per block: its own offset and length, its
table's offset and length, documents, ids), footer length, MAGIC.  Numbers are
little-endian.

Defined cases: a null text counts as empty and yields the end id alone;
documents are ordered by identifier (null first), repeated ones in the order of
a hash of their texts; an empty table writes no file and reads as no rows.  A
text of any length is encoded whole; the literal of a special token in a text is
that token, as the library has it by default.  Other columns are left out,
whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_columns, fresh_path, read_table, stored
from .files import read_range, store, write_whole
from .textbuf import buffers, chunks
from .tokenize import byte_encoder, default_path

MAGIC = b"LODERANS"
SCALE_BITS = 20
END_ID = 2
#: Ids that a block gathers before it is coded.
BLOCK_IDS = 1 << 20
LANES = 4096
#: Ids that share a frequency table, about; also what a task holds at once.
SEGMENT_IDS = 4 << 20
#: A file is closed and the next one begun when it has this many bytes.
FILE_BYTES = 1 << 30
_LOW = np.uint64(1 << 31)
FOOTER = "<6Q"
INDEX = "file string, part long, block long, offset long, length long, table_offset long, table_length long, n_docs long, n_ids long"


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, each at least 1, in proportion to the counts (all above 0)."""
    total, n = 1 << bits, len(counts)
    if n > total // 2:
        raise ValueError("too many different ids for the table")
    freq = np.maximum(1, np.floor(counts * ((total - n) / counts.sum()))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    short = total - int(freq.sum())
    if short > 0:
        freq[order[0]] += short
    for i in order:  # the many ones may have taken too much
        if short >= 0:
            break
        take = min(int(freq[i]) - 1, -short)
        freq[i] -= take
        short += take
    return freq


class Table:
    """Frequencies of the ids that occur, their running sums, and the id of each slot."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids = ids.astype(np.uint32)
        top = int(ids[-1]) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[ids], self.start[ids] = freq, np.cumsum(freq) - freq
        self.slot = np.repeat(self.ids, freq)

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Table:
        counts = np.zeros(1, np.int64)
        for part in parts:
            own = np.bincount(part, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        ids = np.flatnonzero(counts)
        return cls(ids, scaled(counts[ids]))

    def to_bytes(self) -> bytes:
        steps = np.diff(self.ids.astype(np.int64), prepend=0).astype("<u4")
        body = zlib.compress(steps.tobytes() + self.freq[self.ids].astype("<u4").tobytes(), 6)
        return struct.pack("<II", zlib.crc32(body), len(self.ids)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        crc, n = struct.unpack_from("<II", raw)
        if zlib.crc32(raw[8:]) != crc:
            raise ValueError("a table's checksum is wrong")
        both = np.frombuffer(zlib.decompress(raw[8:]), "<u4")
        return cls(np.cumsum(both[:n]).astype(np.int64), both[n:].astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One block: number of ids, lanes, words, the lanes' states, then the words in reading order."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words = []
    for step in range(steps - 1, -1, -1):
        sym = ids[step * lanes : (step + 1) * lanes]
        k = len(sym)
        s, f, c = state[:k], table.freq[sym], table.start[sym]
        full = s >= (f << np.uint64(63 - SCALE_BITS))
        if full.any():
            words.append((s[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            s[full] >>= np.uint64(32)
        q = s // f
        state[:k] = (q << np.uint64(SCALE_BITS)) + (s - q * f) + c
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    return struct.pack("<QII", n, lanes, len(stream)) + state.astype("<u8").tobytes() + stream.tobytes()


def decode(block: bytes, table: Table) -> np.ndarray:
    n, lanes, many = struct.unpack_from("<QII", block)
    state = np.frombuffer(block, "<u8", lanes, 16).astype(np.uint64)
    stream = np.frombuffer(block, "<u4", many, 16 + 8 * lanes)
    out, at, mask = np.empty(n, np.uint32), 0, np.uint64((1 << SCALE_BITS) - 1)
    for begin in range(0, n, lanes):
        k = min(lanes, n - begin)
        s = state[:k]
        low = s & mask
        sym = table.slot[low]
        out[begin : begin + k] = sym
        s = table.freq[sym] * (s >> np.uint64(SCALE_BITS)) + low - table.start[sym]
        need = np.flatnonzero(s < _LOW)
        if len(need):
            s[need] = (s[need] << np.uint64(32)) | stream[at : at + len(need)].astype(np.uint64)
            at += len(need)
        state[:k] = s
    if at != many:
        raise ValueError("the block's words don't end with its ids")
    return out


def pack_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """Checksum, then header (identifiers with null flags, lengths) and the coded ids."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = struct.pack("<I", len(doc_ids)) + null.tobytes() + known.tobytes() + lengths.astype("<u8").tobytes() + encode(ids, table)
    return struct.pack("<I", zlib.crc32(body)) + body


def unpack_block(block: bytes, table: Table) -> tuple[list, np.ndarray, np.ndarray]:
    if struct.unpack_from("<I", block)[0] != zlib.crc32(block[4:]):
        raise ValueError("a block's checksum is wrong")
    (n,) = struct.unpack_from("<I", block, 4)
    null = np.frombuffer(block, np.uint8, n, 8)
    known = np.frombuffer(block, "<i8", n, 8 + n)
    lengths = np.frombuffer(block, "<u8", n, 8 + 9 * n).astype(np.int64)
    return [None if z else int(d) for z, d in zip(null, known)], lengths, decode(block[8 + 17 * n :], table)


def _segment(docs: list[tuple[int | None, np.ndarray]], at: int, index: list[tuple]) -> Iterator[bytes]:
    """A table and the blocks that share it; notes each block in the index."""
    table = Table.of([ids for _, ids in docs])
    raw = table.to_bytes()
    table_at, at = at, at + len(raw)
    yield raw
    lo = 0
    while lo < len(docs):
        hi, held = lo, 0
        while hi < len(docs) and held < BLOCK_IDS:
            held += len(docs[hi][1])
            hi += 1
        block = pack_block([d for d, _ in docs[lo:hi]], np.array([len(x) for _, x in docs[lo:hi]]), np.concatenate([x for _, x in docs[lo:hi]]), table)
        index.append((at, len(block), table_at, len(raw), hi - lo, held))
        yield block
        lo, at = hi, at + len(block)


def write(docs: DataFrame, out_dir: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and writes the files; returns their index, a row per block."""
    path = path or default_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = doc_columns(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, end = byte_encoder(path), TaskContext.get().partitionId(), np.array([end_id], np.uint32)

        def segments() -> Iterator[list]:
            docs_, held = [], 0
            for batch in batches:
                buf, offsets = buffers(batch.column("text"))
                names = batch.column("doc_id").to_pylist()
                for lo, hi in chunks(offsets):
                    ids, counts = encoder.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    ends = np.cumsum(counts)
                    for name, e, n in zip(names[lo:hi], ends, counts):
                        docs_.append((name, np.concatenate([ids[e - n : e], end])))
                        held += n + 1
                    if held >= SEGMENT_IDS:
                        yield docs_
                        docs_, held = [], 0
            if docs_:
                yield docs_

        def content(docs_: list | None, index: list) -> Iterator[bytes]:
            """One file, beginning with these documents."""
            at = len(MAGIC)
            yield MAGIC
            while docs_ is not None:
                for piece in _segment(docs_, at, index):
                    at += len(piece)
                    yield piece
                docs_ = next(rest, None) if at < FILE_BYTES else None
            footer = b"".join(struct.pack(FOOTER, *x) for x in index)
            yield footer + struct.pack("<Q", len(footer)) + MAGIC

        rest = segments()
        for number, first in enumerate(iter(lambda: next(rest, None), None)):
            uri, index = f"{out_dir}/ids-{part:06d}-{number:06d}.rans", []
            write_whole(uri, content(first, index))
            yield _index_rows(uri, index)

    return stored(ordered.mapInArrow(run, INDEX), "index")


def _index_rows(uri: str, blocks: list[tuple[int, ...]]) -> pa.RecordBatch:
    """Index rows of a file's blocks; the file's name tells its partition and its number there, and blocks count on over a partition's files."""
    part, number = map(int, uri.rpartition("/")[2].removesuffix(".rans").split("-")[1:])
    rows = [(uri, part, (number << 32) + k, *x) for k, x in enumerate(blocks)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] + [pa.int64()] * 8)], names=[c.split()[0] for c in INDEX.split(", ")])


def read_footer(uri: str) -> list[tuple[int, ...]]:
    """Blocks of a file, from the file alone: offset, length, table_offset, table_length, n_docs, n_ids."""
    system, path = store(uri)
    with system.open_input_file(path) as f:
        end = f.size()
        size, magic = struct.unpack("<Q8s", f.read_at(16, end - 16))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a file of this format")
        footer = f.read_at(size, end - 16 - size)
    return list(struct.iter_unpack(FOOTER, footer))


def open_index(spark: SparkSession, out_dir: str) -> DataFrame:
    """The index of a folder of files, from their footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                yield _index_rows(uri, read_footer(uri))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(out_dir).select("path")
    return files.mapInArrow(run, INDEX)


def read(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decodes all blocks, each by itself: doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit)."""
    spark = index.sparkSession
    # ids before each block: sums over files first (a row per file), then inside each file
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).toPandas().sort_values("part")
    before = pd.DataFrame({"part": parts["part"], "part_start": parts["part_ids"].cumsum() - parts["part_ids"]})
    starts = spark.createDataFrame(before.astype("int64"), "part long, part_start long")
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = index.withColumn("inside", inside).join(starts, "part").withColumn("start", F.col("part_start") + F.col("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != (row["file"], row["table_offset"]):
                    held, table = (row["file"], row["table_offset"]), Table.from_bytes(read_range(row["file"], row["table_offset"], row["table_length"]))
                doc_ids, lengths, ids = unpack_block(read_range(row["file"], row["offset"], row["length"]), table)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(row["start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "file", "table_offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    out_dir = fresh_path(spark, "rans")
    write(read_table(spark, sf_dir, "documents"), out_dir)
    return read(open_index(spark, out_dir))
