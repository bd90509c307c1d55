"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 with escape probabilities (method C: a context that was seen T times
with D different next bytes gives a seen byte n / (T + D) and escapes to the next shorter context with D / (T + D); below
order 0 all bytes are alike). The statistics are frozen, so a text's code length under a language is an exact sum over its
bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.store import own_columns, small_batches, with_fields
from folio.llm.textops import chunks, utf8

ORDER = 3
SLOT_BITS = 22
UNDETERMINED = "und"


def grams(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte the four bytes that end in it, as one number; before a text's start there are zeros."""
    wide = raw.astype(np.uint32)
    out = wide.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(wide)
        before[k:] = wide[:-k] if len(wide) > k else wide[:0]
        for j in range(k):
            head = at[:-1] + j
            before[np.minimum(head[head < at[1:]], len(wide) - 1)] = 0
        out |= before << np.uint32(8 * k)
    return out


@dataclass
class Table:
    """Costs in bits by language for a sorted set of numbers, found by a hash slot, or by search where two share one."""

    keys: np.ndarray
    costs: np.ndarray

    def __post_init__(self) -> None:
        self.shift = np.uint32(32 - min(SLOT_BITS, max(8, len(self.keys).bit_length() + 3)))
        self.slots = np.full(1 << int(32 - self.shift), -1, dtype=np.int32)
        where = self._hash(self.keys)
        self.slots[where] = np.arange(len(self.keys))
        taken = np.bincount(where, minlength=len(self.slots))
        self.slots[taken > 1] = -2

    def __reduce__(self):  # slots are made anew where the table arrives
        return Table, (self.keys, self.costs)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint32(2654435769)) >> self.shift

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each number, -1 if absent."""
        at = self.slots[self._hash(x)]
        shared = np.flatnonzero(at == -2)
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self.keys, x[shared]), len(self.keys) - 1)
        if len(self.keys):
            at[self.keys[np.maximum(at, 0)] != x] = -1
        return at


@dataclass
class Model:
    """Frozen statistics of all languages: per order the full cost of each known (context, byte), and of each context's escape."""

    languages: list[str]
    known: list[Table]
    escapes: list[Table]

    def cost(self, x: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits per language of each byte after its context."""
        if order < 0:
            return np.full((len(x), len(self.languages)), 8, dtype=np.float32)
        x = x & np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else x
        at = self.known[order].find(x)
        out = self.known[order].costs[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = self.cost(x[new], order - 1)
            context = self.escapes[order].find(x[new] >> np.uint32(8))
            out[new] += np.where(context[:, None] >= 0, self.escapes[order].costs[context], 0)
        return out

    def code_lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        filled = np.flatnonzero(at[1:] > at[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(self.cost(grams(raw, at)), at[:-1][filled], axis=0, dtype=np.float64)
        return out


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's counts of four-byte numbers."""
    known, escapes = [], []
    lower = Model(languages, known, escapes)
    for order in range(ORDER + 1):
        mask = np.uint32((1 << 8 * (order + 1)) - 1) if order < ORDER else np.uint32(0xFFFFFFFF)
        seen = []
        for keys, n in counts:
            k, back = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(k))
            c, of = np.unique(k >> np.uint32(8), return_inverse=True)
            seen.append((k, n, c, of, np.bincount(of, weights=n, minlength=len(c)), np.bincount(of, minlength=len(c))))
        keys = np.unique(np.concatenate([s[0] for s in seen] or [np.empty(0, np.uint32)]))
        contexts = np.unique(np.concatenate([s[2] for s in seen] or [np.empty(0, np.uint32)]))
        escape = np.zeros((len(contexts), len(languages)), dtype=np.float32)
        cost = lower.cost(keys, order - 1)
        for i, (k, n, c, of, total, kinds) in enumerate(seen):
            escape[np.searchsorted(contexts, c), i] = -np.log2(kinds / (total + kinds))
            cost[:, i] += escape[np.searchsorted(contexts, keys >> np.uint32(8)), i]
            cost[np.searchsorted(keys, k), i] = -np.log2(n / (total + kinds)[of])
        known.append(Table(keys, cost))
        escapes.append(Table(contexts, escape))
    return lower


def fit(docs: DataFrame, trains: Column, text_col: str = "text", lang_col: str = "lang", sample: int = 500) -> Model:
    """Statistics from about ``sample`` documents of each language, drawn by a hash of the text among those that ``trains`` picks.

    The sample is a bound on fitting only, and the only one: every language that occurs is learned, and all of the sampled texts'
    four-byte numbers count. Counting runs on Spark; the driver gets one row per language and distinct number of the sample.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(trains & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return build([], [])
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    most = F.array(*(F.lit(int(min(1.0, sample / sizes[x]) * (1 << 30))) for x in languages))
    drawn = rows.withColumn("k", number).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= most[F.col("k").cast("int")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            langs = batch.column("k").to_numpy()
            for k in np.unique(langs):
                own = batch.filter(pa.array(langs == k))
                keys, n = np.unique(grams(*utf8(own.column("text"))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int64)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["k", "gram", "n"])

    counted = drawn.select("k", "text").mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    whole = counted.toPandas()
    counts = [whole[whole["k"] == k] for k in range(len(languages))]
    return build(languages, [(c["gram"].to_numpy(dtype=np.int64).astype(np.uint32), c["n"].to_numpy(dtype=np.float64)) for c in counts])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte.

    ``score`` is the share of the best language in the sum of all languages' ``2 ** -(bits per byte)`` (0 to 1). A null text,
    one without a letter, or any text when no language was learned gets ``und``, score 0 and null bits. Of languages with equal
    code lengths the first by name wins. Rows, repeated ones too, and columns stay as they are; columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    made = [c for c in ("lang_pred", "score", "bits_per_byte") if c in docs.columns]
    docs = docs.drop(*made)
    source = docs.select(*own_columns(docs), F.col(text_col).alias("_folio_text"), has_letter.alias("_folio_letter"))
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in chunks(batches, "_folio_text"):
            letter = batch.column("_folio_letter").to_numpy(zero_copy_only=False)
            raw, at = utf8(batch.column("_folio_text"))
            if model.languages:
                rate = model.code_lengths(raw, at) / np.maximum(1, np.diff(at))[:, None]
                best = rate.argmin(axis=1)
                bits = rate.min(axis=1)
                score = 1 / np.exp2(bits[:, None] - rate).sum(axis=1)
            else:
                letter = np.zeros(len(letter), dtype=bool)
                best, bits, score = np.zeros(len(letter), dtype=int), np.zeros(len(letter)), np.zeros(len(letter))
            columns = [pa.array(names[np.where(letter, best, len(names) - 1)], type=pa.string()), pa.array(np.where(letter, score, 0.0)), pc.if_else(pa.array(letter), pa.array(bits), pa.scalar(None, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *columns], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    return source.mapInArrow(run, with_fields(docs, lang_pred="string", score="double", bits_per_byte="double"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2
