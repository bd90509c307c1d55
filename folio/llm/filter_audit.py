"""How the filters of a cleaning recipe interact, in any order, from one pass of flags.

1. One native scan gives each document a bit per filter it fails and hashes of its text.
2. A counting Bloom sketch of the text hashes, built by segments in the tasks and merged by Spark segment by segment, clears every
   text that surely occurs once. Only the rest, the possible repeats, are shuffled with their whole texts, for the exact smallest id
   of each text.
3. Flags and labels join by document id, and documents are counted by part, mask and labels. All orders of the filters follow from
   these counts, which add up over parts of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import cut, small_batches

#: Counters of a segment of the sketch; all counters of one text lie in one segment.
SEGMENT = 1 << 16
#: Counters a text, hashes a text, and the most segments that are sent to all tasks (8 KB each).
PER_TEXT, HASHES, MOST_SEGMENTS = 16, 3, 8192
FILTERS = "ABCDE"


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions A to D over ``text`` (not null): few words, many repeated words, many capitals, odd marks."""
    body = F.col(text)
    words = F.array_remove(F.split(body, "[ \\x09-\\x0D]+"), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > 10 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
    }


def _slots(hashed: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash and its counters there (a row each)."""
    x = hashed.astype(np.int64).view(np.uint64)
    segment = (x >> np.uint64(51)).astype(np.int64) % segments
    return segment, np.stack([(x >> np.uint64(16 * k)).astype(np.int64) & (SEGMENT - 1) for k in range(HASHES)])


def _counted(segment: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counters (segment * SEGMENT + slot) and their counts; a text that hits a counter twice counts once."""
    slots = np.sort(slots, axis=0)
    fresh = np.ones(slots.shape, dtype=bool)
    fresh[1:] = slots[1:] != slots[:-1]
    return np.unique((segment * SEGMENT + slots)[fresh], return_counts=True)


class RepeatSketch:
    """Says surely of a text hash that it occurs once in ``hashes``; of the others, nothing.

    Two counting passes never meet: tasks count what they see, at most some million counters at a time, and Spark adds the counts up by
    segment. Only counters of two or more are kept, a bit each. The sketch grows with the table, 16 counters a text, up to
    ``MOST_SEGMENTS`` segments (64 MB of bits); beyond that fewer texts are cleared, and the results stay the same.
    """

    def __init__(self, hashes: DataFrame, col: str, most_segments: int = MOST_SEGMENTS):
        n = hashes.count()
        self.segments = segments = max(1, min(most_segments, -(-n * PER_TEXT // SEGMENT)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                counters, n = _counted(*_slots(np.concatenate(held), segments))
                bounds = np.flatnonzero(np.diff(counters // SEGMENT, prepend=-1, append=segments))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_pydict(
                        {"segment": pa.array([counters[a] // SEGMENT], pa.int32()), "slots": [(counters[a:b] % SEGMENT).astype("<u2").tobytes()], "counts": [np.minimum(n[a:b], 255).astype("u1").tobytes()]}
                    )

            for batch in batches:
                held.append(batch.column(0).to_numpy())
                size += batch.num_rows
                if size >= 1 << 20:
                    yield from out()
                    held, size = [], 0
            if size:
                yield from out()

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, total = None, np.zeros(SEGMENT, dtype=np.int64)
            for batch in batches:
                for segment, slots, counts in zip(batch["segment"], batch["slots"], batch["counts"], strict=True):
                    if now is not None and segment != now:
                        yield pd.DataFrame({"segment": [now], "bits": [np.packbits(total > 1).tobytes()]})
                        total[:] = 0
                    now = segment
                    total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, "u1")
            if now is not None:
                yield pd.DataFrame({"segment": [now], "bits": [np.packbits(total > 1).tobytes()]})

        counted = hashes.select(F.col(col).cast("long")).mapInArrow(count, "segment int, slots binary, counts binary")
        merged = counted.repartition("segment").sortWithinPartitions("segment").mapInPandas(merge, "segment int, bits binary").toPandas()
        bits = np.zeros((segments, SEGMENT // 8), dtype=np.uint8)
        for segment, row in zip(merged["segment"], merged["bits"], strict=True):
            bits[segment] = np.frombuffer(row, np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def may_repeat(self, hashed: Column) -> Column:
        """False only for hashes that occur once."""
        shared, segments = self.shared, self.segments

        @F.pandas_udf("boolean")
        def look(x: pd.Series) -> pd.Series:
            segment, slots = _slots(x.to_numpy(), segments)
            return pd.Series(((shared.value[segment, slots >> 3] << (slots & 7).astype(np.uint8)) & 128 > 0).all(axis=0))

        return look(hashed)


def first_ids(docs: DataFrame, sketch: RepeatSketch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): the smallest id of each text that ``sketch`` cannot clear, by grouping the whole texts. Null texts are empty ones."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    possible = texts.where(sketch.may_repeat(F.xxhash64("text")))
    return possible.groupBy("text").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("id", F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters, bit k standing for the k-th of ``FILTERS``.

    E fails a document whose whole text is also that of a smaller id anywhere in the table. A row with a null id has no smaller id and no
    label; rows that repeat an id fail E together or not at all. ``good`` and ``toxic`` count the documents of which any row of ``labels``
    says quality 1, toxic 1. Null texts are empty texts; a null part is the empty string. Repeated rows count each. An empty
    table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text, part = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text.alias("text"))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters().values())]
    flags = cut(source.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest")))

    sketch = RepeatSketch(flags, "hash")
    marked = flags.withColumn("possible", sketch.may_repeat(F.col("hash")))
    first = first_ids(docs, sketch, id_col, text_col).withColumn("first", F.lit(True))
    once = marked.where("NOT possible OR id IS NULL").select("id", "part", "mask")
    again = marked.where("possible AND id IS NOT NULL").join(first, ["id", "digest"], "left")
    judged = once.unionByName(again.select("id", "part", (F.col("mask") + F.when(F.col("first").isNull(), 1 << 4).otherwise(0)).alias("mask")))

    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    known, nameless = judged.where("id IS NOT NULL").join(said, "id", "left"), judged.where("id IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, by part, from ``mask_counts``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): documents left after the step; removed by
    it; failing its filter but removed before; failing its filter only; removed with a good, a toxic label; and its filter's removals summed
    over all orders. Zeros are rows too; a part with no counts has none.
    """
    n = len(FILTERS)
    pairs = [(before, 1 << k) for k in range(n) for before in range(1 << n) if not before >> k & 1]
    each = counts.withColumn("at", F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(f).alias("own")) for s, f in pairs)))).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    done = each.groupBy("part", "before", "own").agg(
        count(~fails & ~gone, "n", "kept"), count(fails & ~gone, "n", "removed"), count(fails & gone, "n", "redundant"), count(F.col("mask") == F.col("own"), "n", "unique_fails"),
        count(fails & ~gone, "good", "good_lost"), count(fails & ~gone, "toxic", "toxic_lost"),
    )
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), (F.bit_count("before") + 1).cast("int"))
    done = done.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "own")))  # 16 rows each
    steps = [("".join(FILTERS[k] for k in order), i + 1, sum(1 << k for k in order[:i]), 1 << order[i]) for order in permutations(range(n)) for i in range(n)]
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, own int")
    return done.join(F.broadcast(orders), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
