"""Sequence packing over the length histogram, shortest pack first.

Documents become pieces of at most ``size`` ids. Only the histogram of piece lengths (``size`` numbers) reaches the driver:
lengths are placed longest first, each into the open packing pattern with the fewest ids so far that still has room, and
pattern counts are split and updated as whole batches (Krell et al. 2021). The patterns then go back to the pieces by rank:
the r-th piece of a length takes the r-th place that the patterns hold for that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import cut, small_batches
from folio.llm.textops import chunks
from folio.llm.token_store import ENCODE_BYTES, encoder


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths in order of placing) that hold every piece of the histogram exactly once.

    Open patterns are kept by their free room. A length goes into the patterns with the most room (the shortest packs)
    first, as long as the room suffices; what is left opens new patterns, as many equal pieces to each as fit.
    """
    room: dict[int, list[list]] = defaultdict(list)  # free ids -> [count, lengths]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in sorted((r for r in room if r >= length), reverse=True):
            while left and room[free]:
                count, lengths = room[free].pop()
                fit = min(free // length, -(-left // count))
                whole = min(count, left // fit)
                if whole < count:
                    room[free].append([count - whole, lengths])
                room[free - fit * length].append([whole, (*lengths, *[length] * fit)])
                left -= whole * fit
            if not left:
                break
        each = size // length
        if left >= each:
            room[size - each * length].append([left // each, (length,) * each])
        if left % each:
            room[size - left % each * length].append([1, (length,) * (left % each)])
    return sorted((c, p) for held in room.values() for c, p in held if c)


class Places:
    """Maps (length, rank) to (sequence, offset)."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        base = 0
        for count, lengths in patterns:
            offset = 0
            for n in lengths:
                rows[n].append((count, base, offset))
                offset += n
            base += count
        self.tables = {}
        for n, r in rows.items():
            count, first, offset = np.array(r, dtype=np.int64).T
            self.tables[n] = (np.cumsum(count) - count, first, offset)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, at = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for n in np.unique(length).tolist():
            own = length == n
            start, first, offset = self.tables[n]
            k = np.searchsorted(start, rank[own], side="right") - 1
            sequence[own], at[own] = first[k] + rank[own] - start[k], offset[k]
        return sequence, at


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, keep_space: bool = True, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 2000) -> DataFrame:
    """All pieces with their places: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are cut into pieces of ``size`` and a rest. Null texts are empty and give the end id alone; repeated
    rows are packed each; a null id stays null. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keep_space)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        for batch in chunks(batches, limit=ENCODE_BYTES):
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column("id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.frombuffer(raw + end, dtype=encode.dtype).astype("<u4")
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    for column, x in zip(rows, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in rows], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = cut(source.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    places = docs.sparkSession.sparkContext.broadcast(Places(pack_histogram(counts, size)))

    slices = max([16, *(n // slice_rows for n in counts.values())])
    ranked = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(slices)))
    sizes = ranked.groupBy("length", "slice").agg(F.count("*").alias("n"))
    first = sizes.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "start")) - 1
    ranked = ranked.withColumn("k", within).join(first, ["length", "slice"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *map(pa.array, found)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
