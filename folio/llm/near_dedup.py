"""MinHash near-duplicates: banded candidates, Odd Sketch screening, exact confirmation, components.

Stages, all keyed and shuffled by Spark:

1. One scan turns each text into its shingle set, a MinHash sample, band keys and an Odd Sketch: the sample's values are
   folded into a parity bitmap, so that the population count of two bitmaps' XOR estimates how many sampled values differ.
2. Documents with equal sets collapse into their smallest id (a pre-aggregated group-by; a hot group never meets in a task).
3. Star round: every member of a band bucket is held against the bucket's leader; Odd Sketches screen the pairs, the
   likeliest few per document are confirmed on full sets, and the confirmed links give first components.
4. Cross round: in buckets that still hold several components, the members outside the largest one are held against all
   members of other components, screened by their Odd Sketches and confirmed on full sets, so no candidate is left out. Small
   buckets give screened pairs that are then confirmed. Large ones (a group of near copies) are cut into blocks of bounded size
   on both sides; a block screens and confirms on the spot and only links come out, so no pairs are emitted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.llm.store import IdFilter, cut, join_counted, join_dealt, may_hold, small_batches
from folio.llm.textops import chunks, mix, shingle_sets, utf8

BLOCK = 256
#: Text bytes whose shingles are in memory at once.
SIGN_BYTES = 1 << 18


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, count, dtype=np.uint64)


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a non-empty set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(values), BLOCK):
        np.minimum(out, (values[None, s : s + BLOCK] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of (permutation, value) pairs as signed 64-bit words."""
    where = mix(sample + np.arange(len(sample), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    odd = (np.bincount(where.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def odd_distance(a: str, b: str, words: int) -> Column:
    """Population count of the XOR of two sketches."""
    return F.expr(" + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(words)))


def odd_limit(similarity: float, samples: int, bits: int) -> int:
    """The XOR population count expected of two sets with this similarity."""
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, bits: int, seed: int) -> DataFrame:
    a, b = permutations(bands * rows, seed)
    band_seed = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SIGN_BYTES):
            out: dict[str, list] = {"n_shingles": [], "set_key": [], "sketch": [], "bands": []}
            for values in shingle_sets(*utf8(batch.column("text")), shingle):
                out["n_shingles"].append(len(values))
                if not len(values):
                    out["set_key"].append(None), out["sketch"].append(None), out["bands"].append(None)
                    continue
                sample = minhash(values, a, b)
                key = band_seed
                for part in sample.reshape(bands, rows).T:
                    key = mix(key * np.uint64(0x2545F4914F6CDD1D) + part)
                out["set_key"].append(hashlib.md5(values.tobytes(), usedforsecurity=False).digest())
                out["sketch"].append(odd_sketch(sample, bits))
                out["bands"].append(key.view(np.int64))
            kinds = {"n_shingles": pa.int64(), "set_key": pa.binary(), "sketch": pa.list_(pa.int64()), "bands": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, type=kinds[k]) for k, v in out.items())], names=["id", *out])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, set_key binary, sketch array<long>, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` and of a few others that the bitmap cannot tell from them."""
    wanted = IdFilter(ids, "id")
    packed = wanted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks((b.filter(pa.array(may_hold(packed.value, b.column("slot").to_numpy()))) for b in batches), limit=SIGN_BYTES):
            if batch.num_rows:
                sets = [s.view(np.int64) for s in shingle_sets(*utf8(batch.column("text")), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, type=pa.list_(pa.int64()))], names=["id", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.withColumn("slot", wanted.slot("id")).mapInArrow(run, "id long, shingles array<long>")


def block_links(sets: DataFrame, mixed: DataFrame, percent: int, block: int, limit: int) -> DataFrame:
    """Links (a, b) between members of different components of a bucket, at least one for each document and component linked.

    ``mixed`` has (bucket, id, part, main, n_shingles, sketch), ``sets`` (id, shingles). Both sides of a bucket are dealt over blocks
    of about ``block`` shingles; each pair of blocks is one group. Pairs whose sketches differ in more than ``limit`` bits are out.
    """
    totals = mixed.groupBy("bucket").agg(F.sum("n_shingles").alias("all"), F.sum(F.when(F.col("part") != F.col("main"), F.col("n_shingles"))).alias("some"), F.count("*").alias("n"))
    totals = totals.select("bucket", "n", F.ceil(F.col("all") / block).cast("int").alias("nm"), F.ceil(F.col("some") / block).cast("int").alias("nq"))
    rows = join_counted(mixed, cut(totals), ["bucket"], "id").join(sets, "id")
    slot = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n).cast("long")).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("bucket", copies("nq").alias("q"), slot("nm").alias("m"), "id", "part", "sketch", "shingles", F.lit(False).alias("asks"))
    asked = rows.where("part <> main").select("bucket", slot("nq").alias("q"), copies("nm").alias("m"), "id", "part", "sketch", "shingles", F.lit(True).alias("asks"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["asks"]], group[~group["asks"]]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = right["shingles"].map(len).to_numpy()
            starts = np.cumsum(sizes) - sizes
            known, place = np.unique(np.concatenate(right["shingles"].to_list()), return_inverse=True)
            ids, parts, sketches = right["id"].to_numpy(), right["part"].to_numpy(), np.stack(right["sketch"].to_list()).view(np.uint64)
            for i, part, own, sketch in zip(left["id"], left["part"], left["shingles"], left["sketch"], strict=True):
                near = np.flatnonzero((np.bitwise_count(sketches ^ sketch.view(np.uint64)).sum(axis=1) <= limit) & (parts != part))
                if not len(near):
                    continue
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                has = np.zeros(len(known), dtype=np.int64)
                has[at[known[at] == own]] = 1
                if 4 * len(near) < len(ids):
                    both = np.array([has[place[starts[k] : starts[k] + sizes[k]]].sum() for k in near.tolist()])
                else:
                    both = np.add.reduceat(has[place], starts)[near]
                linked = near[100 * both >= percent * (len(own) + sizes[near] - both)]
                out += [(i, ids[linked[k]]) for k in np.unique(parts[linked], return_index=True)[1]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.unionByName(asked).groupBy("bucket", "q", "m").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
    sketch_bits: int = 256,
    star_links: int = 3,
    large_bucket: int = 48,
    block: int = 500_000,
    seed: int = 20240229,
) -> DataFrame:
    """Near-duplicate class of every row: (id_col, n_shingles, component_id, kept).

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of word shingles; the links are
    confirmed on the full sets. Buckets of more than ``large_bucket`` members are compared in blocks instead of pairs, with the
    same screen and the same links. ``component_id`` is the smallest id that links reach; ``kept`` marks it. With the default
    40 bands of 6 rows a pair at 80 % is missed by all bands with probability 5e-6.

    Null or empty texts and texts without words have no shingles and are linked with nothing; a text with fewer words than
    a shingle has its whole word sequence as its only one. Rows that repeat an id are one document: all get its class. A
    row with a null id belongs to the class of its set; it is its own when it has none, and is kept if so. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    samples, words = bands * rows, sketch_bits // 64
    limit = odd_limit(max(0.0, percent / 100 - 0.25), samples, sketch_bits)
    seen = cut(signatures(docs, id_col, text_col, shingle, bands, rows, sketch_bits, seed))
    classes = cut(seen.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    firsts = seen.join(classes.where("rep IS NOT NULL"), (seen["set_key"] == classes["set_key"]) & (seen["id"] == classes["rep"]), "left_semi")
    sketches = firsts.select("id", "sketch").dropDuplicates(["id"])

    keyed = firsts.select("id", F.explode("bands").alias("bucket"))
    leaders = keyed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket"), "id"))["id"].alias("leader"), F.max("id").alias("top"), F.min("id").alias("low"), F.count("*").alias("n"))
    shared = cut(leaders.where("low < top").select("bucket", "leader", "n"))
    members = cut(join_counted(keyed, shared, ["bucket"], "id").select("bucket", "id", "leader"))

    def screened(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", odd_distance("sa", "sb", words).alias("far")).where(F.col("far") <= limit)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among written ``pairs``. The full set of a ``b`` of many pairs, as a leader of near copies, goes to several tasks."""
        sets = cut(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col, shingle))
        a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        shared = F.size(F.array_intersect("sa", "sb"))
        both = join_dealt(pairs.join(a, "a"), b, ["b"], cut(pairs.groupBy("b").agg(F.count("*").alias("n"))), "a")
        sized = both.select("a", "b", shared.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
        return sized.where(F.expr(f"100L * both >= {percent}L * (total - both)")).select("a", "b")

    star = screened(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct())
    best = Window.partitionBy("a").orderBy("far", "b")
    tried = cut(star.withColumn("k", F.row_number().over(best)).where(F.col("k") <= star_links).select("a", "b"))
    links = cut(confirmed(tried))
    found = cut(connected_components(links))

    placed = members.join(found, members["id"] == found["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("part"))
    parts = placed.groupBy("bucket", "part").count()
    split = parts.groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("n"), F.sum("count").alias("size")).where("n > 1")
    mixed = cut(join_counted(placed, cut(split.select("bucket", "main", "size")), ["bucket"], "id", "size"))
    small, large = mixed.where(F.col("size") <= large_bucket), mixed.where(F.col("size") > large_bucket)
    one, other = small.where("part <> main").alias("x"), small.alias("y")
    apart = F.expr("x.bucket = y.bucket AND x.part <> y.part AND (y.part = y.main OR x.id < y.id)")
    cross = one.join(other, apart).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    tested = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = cut(screened(cross.join(tested, ["a", "b"], "left_anti")).select("a", "b"))
    more = confirmed(late)
    if not large.isEmpty():
        sizes = firsts.select("id", "n_shingles", "sketch").dropDuplicates(["id"])
        sets = cut(full_sets(docs, large.select("id"), id_col, text_col, shingle).dropDuplicates(["id"]))
        more = more.union(block_links(sets, large.join(sizes, "id"), percent, block, limit))

    final = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(more))
    named = cut(classes.join(final, classes["rep"] == final["node"], "left").select("set_key", "n", F.coalesce("component", "rep").alias("class")))
    component = F.coalesce("class", "id")
    with_class = join_counted(seen.where("set_key IS NOT NULL"), named, ["set_key"], "id").select("id", "n_shingles", "class")
    return with_class.unionByName(seen.where("set_key IS NULL").select("id", "n_shingles", F.lit(None).cast("long").alias("class"))).select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept")
    )
