"""Problem 8: filling fixed-capacity containers along a space-filling curve."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.llm.bpe import TOKENIZERS, Encoded, encoder, rank_file, slices, words
from runeworks.llm.settings import settings_rows
from runeworks.session import settle

#: Dimensions of the projected document vectors and bits of each on the curve.
DIMENSIONS, BITS = 3, 10

#: Neighbours on the curve that are sorted by size together, and containers kept open.
WINDOW, OPEN = 4096, 4096


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of ``points``: rows of whole coordinates below ``2 ** bits``.

    Coordinates are turned bit by bit into the transposed index by undoing the rotations
    and reflections of each level, then Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            high = (x[d] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def _directions(different: list[str]) -> np.ndarray:
    """A fixed direction for each word, from its hash: the columns of a random projection."""
    seeds = np.fromiter((zlib.crc32(w.strip().lower().encode()) for w in different), dtype=np.uint64, count=len(different))
    out = np.empty((len(different), DIMENSIONS))
    for d in range(DIMENSIONS):
        mixed = (seeds + np.uint64(d + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, d] = (mixed >> np.uint64(40)).astype(np.float64) / float(1 << 23) - 1.0
    return out


def placed_documents(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, tokens, curve``: size and place on the curve of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    side = 1 << BITS

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for part in slices(batches):
            found = Encoded(part.column(1), coder)
            counts = np.maximum(np.diff(found.row_ends), 1)
            vectors = found.sum_by_row(_directions(found.different)) / np.sqrt(counts)[:, None]
            cells = np.clip(((np.tanh(vectors) + 1) / 2 * side).astype(np.int64), 0, side - 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found.counts()), pa.array(hilbert_keys(cells))], names=["doc_id", "tokens", "curve"]
            )

    return documents.select("doc_id", words(F.col("text")).alias("__w")).mapInArrow(
        place, f"doc_id {kind}, tokens bigint, curve bigint"
    )


class Packer:
    """Best fit over a bounded set of open containers of one capacity."""

    def __init__(self, name: str | None, capacity: int, prefix: str) -> None:
        self.name, self.capacity, self.prefix = name, capacity, prefix
        self.open: list[tuple[int, int]] = []
        self.made = 0

    def add(self, size: int) -> str:
        """The container that takes ``size`` with the least room left over."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            room, number, self.made = self.capacity, self.made, self.made + 1
        if room - size > 0 or size == 0:
            insort(self.open, (room - size, number))
            if len(self.open) > OPEN:
                self.open.pop(0)
        return f"{self.prefix}-{number}"


def pack_documents(
    documents: DataFrame, limits: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """The container of every document, or piece of one, under each limit.

    Result: ``limit_name, capacity_tokens, container, doc_id, piece, first_token, tokens``. A
    container never holds more than its capacity. Only a document larger than the capacity is
    split: into pieces of the full capacity and one of the rest. Null and empty texts have
    size 0 and take a place without room. A limit with a null or non-positive capacity can
    hold nothing and is left out; empty tables give an empty result.

    Hashed document vectors are projected to three dimensions and rows are range-sorted by
    their Hilbert key, so each task packs a stretch of the curve. Inside it, neighbours are
    taken in windows, largest first, each into the open container that leaves least room.
    Waste per task is at most a few part-filled containers for each limit. ``limits`` holds settings, a few
    rows, and is read by the driver.
    """
    path = rank_file(tokenizer, folder)
    capacities = [
        (n, int(c)) for n, c in settings_rows(limits.select("limit_name", "capacity_tokens")) if c is not None and c > 0
    ]
    kind = documents.schema["doc_id"].dataType.simpleString()
    slots = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The few numbers of each document are kept once: sampling for the ranges and the
    # exchange both read them, and a lost task finds the same ranges again.
    sorted_rows = (
        settle(placed_documents(documents, path))
        .repartitionByRange(slots, "curve", "doc_id")
        .sortWithinPartitions("curve", "doc_id")
    )
    schema = f"limit_name string, capacity_tokens bigint, container string, doc_id {kind}, piece int, first_token bigint, tokens bigint"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packers = [Packer(n, c, f"{n}-{task}") for n, c in capacities]

        def window(ids: list, sizes: list[int]) -> Iterator[pa.RecordBatch]:
            for packer in packers:
                pieces = []
                for i, size in zip(ids, sizes):
                    full, rest = divmod(size, packer.capacity)
                    pieces += [(packer.capacity, i, p) for p in range(full)]
                    if rest or not full:
                        pieces.append((rest, i, full))
                pieces.sort(key=lambda p: -p[0])
                homes = [packer.add(p[0]) for p in pieces]
                count = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([packer.name] * count, pa.string()),
                        pa.array([packer.capacity] * count, pa.int64()),
                        pa.array(homes, pa.string()),
                        pa.array([p[1] for p in pieces], ids_type),
                        pa.array([p[2] for p in pieces], pa.int32()),
                        pa.array([p[2] * packer.capacity for p in pieces], pa.int64()),
                        pa.array([p[0] for p in pieces], pa.int64()),
                    ],
                    names=["limit_name", "capacity_tokens", "container", "doc_id", "piece", "first_token", "tokens"],
                )

        ids: list = []
        sizes: list[int] = []
        ids_type = pa.int64()
        for batch in batches:
            ids_type = batch.column(0).type
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            while len(ids) >= WINDOW:
                yield from window(ids[:WINDOW], sizes[:WINDOW])
                del ids[:WINDOW], sizes[:WINDOW]
        if ids:
            yield from window(ids, sizes)

    return sorted_rows.select("doc_id", "tokens").mapInArrow(pack, schema)


def packing_report(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: ``containers, pieces, tokens, fill``, the used share of all room."""
    packed = pack_documents(documents, limits)
    return packed.groupBy("limit_name", "capacity_tokens", "container").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")
    ).groupBy("limit_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("pieces").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count(F.lit(1)) * F.col("capacity_tokens"))).alias("fill"),
    )
