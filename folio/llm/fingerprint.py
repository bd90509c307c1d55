"""Bottom-k sketches of word-shingle hashes: mergeable, estimating resemblance, containment and distinct shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import range_bounds, range_of, small_batches
from folio.llm.textops import chunks, shingle_sets, utf8

#: Kept hashes have 48 bits: 6 bytes each in a fingerprint.
BITS = 48


def sketch(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of the distinct hashes, sorted."""
    values = np.unique(shingles >> np.uint64(64 - BITS))
    return values[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Sketch of the union of two sets, from their sketches."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / (1 << BITS))


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity; exact while the union has at most k shingles. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, low, assume_unique=True).sum() / len(low))


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained in any."""
    if not len(a):
        return 1.0
    low = np.union1d(a, b)[:k]
    own = np.isin(low, a, assume_unique=True)
    seen = own & np.isin(low, b, assume_unique=True)
    return float(seen.sum() / own.sum()) if own.any() else 0.0


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), dtype=np.uint8), raw], axis=1).copy().view(">u8").reshape(-1).astype(np.uint64)


def sketches(texts: list[str], shingle: int, k: int) -> list[np.ndarray]:
    return [sketch(s, k) for s in shingle_sets(*utf8(pa.array(texts, type=pa.large_string())), shingle)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 128) -> DataFrame:
    """(id_col, n_chars, n_shingles, fingerprint) of every row.

    Null texts are empty; a text without words has the empty fingerprint, one with fewer words than a shingle one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = sketches(texts, shingle, k)
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "n_chars": pa.array(map(len, texts), type=pa.int64()), "n_shingles": pa.array([distinct(s, k) for s in made], type=pa.float64()), "fingerprint": pa.array(map(to_text, made), type=pa.string())}
            )

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_chars long, n_shingles double, fingerprint string").withColumnRenamed("id", id_col)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt over id ranges, each sorted by descending id and closed by the first row of the range that follows.

    Columns: part, pad (true for the closing row), id, text. After the last range comes the first again. One shuffle; the
    closing rows are one per range.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bounds = range_bounds(source.select("id"), "id")
    part = F.lit(len(bounds)).cast("int") - range_of("id", bounds) if len(bounds) else F.lit(0)
    heads = source.select("id", part.alias("part")).groupBy("part").agg(F.max("id").alias("head")).orderBy("part").collect()  # a row per range
    order = [r["part"] for r in heads]
    closes = {r["head"]: order[i - 1] for i, r in enumerate(heads)}  # the head also closes the range before it
    spark = docs.sparkSession
    table = spark.createDataFrame([(h, p) for h, p in closes.items()], "head long, closed int")  # a row per range
    placed = source.withColumn("part", part).join(F.broadcast(table), F.col("id").eqNullSafe(F.col("head")), "left")
    own = F.array(F.struct(F.col("part"), F.lit(False).alias("pad")))
    both = F.concat(own, F.array(F.struct(F.col("closed").alias("part"), F.lit(True).alias("pad"))))
    spread = placed.select("id", "text", F.explode(F.when(F.col("closed").isNull(), own).otherwise(both)).alias("at"))
    return spread.select("at.part", "at.pad", "id", "text").repartition("part").sortWithinPartitions("part", "pad", F.col("id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 128) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last ``floor(n / 2)`` characters are replaced by as many (or
    all) first ones of the next document in descending id order, the first following the last.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty.
    Rows that repeat an id follow one another in text order. An empty table gives an empty result; a single row is its own
    next. Other columns are not read.
    """
    fields = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text, sketch) of the row before
        for batch in chunks(batches, limit=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = sketches(texts, shingle, k)
            rows, edits = [], []
            for part, pad, i, text, s in zip(batch.column("part").to_pylist(), batch.column("pad").to_pylist(), batch.column("id").to_pylist(), texts, own, strict=True):
                if held is not None and held[0] == part:
                    cut = len(held[2]) // 2
                    edits.append(held[2][: len(held[2]) - cut] + text[:cut])
                    rows.append((held[1], len(held[2]), held[3], s))
                held = None if pad else (part, i, text, s)
            made = sketches(edits, shingle, k) if edits else []
            out: list[list] = [[] for _ in fields]
            for (i, n, s, after), edit, e in zip(rows, edits, made, strict=True):
                row = (i, n, hashlib.sha256(edit.encode()).hexdigest(), to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, after, k))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, fields.values(), strict=True)], names=list(fields))

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
