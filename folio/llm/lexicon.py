"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

1. Spark counts the words (runs between white space) of all texts; the frequent ones, a bounded number, become the lexicon.
2. ``compile_lexicon`` builds the smallest acyclic automaton of these words from their sorted list: equal suffixes share their states.
   Its arcs carry numbers that add up along a word to the word's rank, and the rank leads to the word's token ids.
3. The automaton is one file in the shared folder. Spark hands it to the executors (``addFile``), whose workers map it into memory.
4. Words outside the lexicon are merged exactly: all unseen words of a batch in step, one merge a word and step.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.store import cut, own_columns, shared_dir, small_batches, with_fields
from folio.llm.textops import chunks, utf8
from folio.llm.token_store import ENCODE_BYTES, Encoder

#: Words of so many symbols or fewer are merged in step, longer ones each by itself.
IN_STEP = 48
#: Different words that a task holds while it counts.
COUNTED = 300_000
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ARRAYS = (("first", "<u4"), ("final", "u1"), ("arcs", "<u8"), ("target", "<u4"), ("output", "<u4"), ("at", "<u4"), ("ids", "<u4"))


class Merges:
    """The merge rules of a BPE vocabulary with byte-level symbols and a mark at a word's end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.vocab = vocab

    def start(self, word: str) -> list[int]:
        """The symbols of a word (already in the vocabulary's byte alphabet) before any merge."""
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.suffix]]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the number of rules where there is none) and what it becomes."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.rank[at], len(self.keys)), self.made[at]

    def together(self, words: list[list[int]]) -> list[list[int]]:
        """Each word's tokens: in each step every word makes its merge of lowest rank, the leftmost of equals."""
        done: list = [None] * len(words)
        live = np.arange(len(words))
        sizes = np.array([len(w) for w in words])
        table = np.full((len(words), int(sizes.max(initial=1)) + 1), -1, dtype=np.int64)
        table[np.arange(table.shape[1]) < sizes[:, None]] = [x for w in words for x in w]
        none = len(self.keys)
        while len(live):
            width = int(sizes.max())
            table = table[:, : width + 1]
            rank = np.full((len(live), max(1, width - 1)), none, dtype=np.int64)
            made = np.zeros_like(rank)
            real = table[:, 1:width] >= 0
            if width > 1:
                rank[real], made[real] = self._pairs(table[:, : width - 1][real], table[:, 1:width][real])
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            goes_on = rank[row, best] < none
            for k in np.flatnonzero(~goes_on):
                done[live[k]] = table[k, : sizes[k]].tolist()
            table, best, made, sizes, live = table[goes_on], best[goes_on], made[row, best][goes_on], sizes[goes_on], live[goes_on]
            table[np.arange(len(live)), best] = made
            behind = np.arange(table.shape[1] - 1) > best[:, None]
            table[:, :-1] = np.where(behind, table[:, 1:], table[:, :-1])
            sizes = sizes - 1
        return done

    def alone(self, word: list[int]) -> list[int]:
        """One long word's tokens, by a queue of merges over a linked list."""
        ids = np.array(word, dtype=np.int64)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        none = len(self.keys)
        rank, made = self._pairs(ids[:-1], ids[1:])
        queue = [(r, k, m) for k, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r < none]
        heapq.heapify(queue)
        now: list = ids.tolist()
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(k: int) -> None:
            pair = now[k], now[after[k]]
            if pair not in memo:
                r, m = self._pairs(np.array(pair[:1]), np.array(pair[1:]))
                memo[pair] = int(r[0]), int(m[0])
            if memo[pair][0] < none:
                heapq.heappush(queue, (memo[pair][0], k, memo[pair][1]))

        while queue:
            r, k, m = heapq.heappop(queue)
            b = after[k]
            if now[k] is None or b >= len(now):
                continue
            pair = now[k], now[b]
            if pair not in memo:
                x, y = self._pairs(np.array(pair[:1]), np.array(pair[1:]))
                memo[pair] = int(x[0]), int(y[0])
            if memo[pair] != (r, m):
                continue
            now[k], now[b] = m, None
            after[k] = after[b]
            if after[k] < len(now):
                before[after[k]] = k
                offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [x for x in now if x is not None]


class Cutter:
    """Turns words into the vocabulary's parts, with the tokenizer's own normaliser and splitter, and parts into ids by ``Merges``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)

    def __call__(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; white space beyond ASCII may stand in it and parts it further."""
        whole = words
        pieces = [[x for x in _WIDE.split(w) if x] if _WIDE.search(w) else [w] for w in whole]
        words = [x for p in pieces for x in p]
        belongs = [k for k, p in enumerate(pieces) for _ in p]
        plain = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ") if words else []
        parts: list[list[int]] = []
        owner: list[int] = []
        if len(plain) != len(words):
            raise ValueError("the normaliser joins or parts words")
        ends = np.cumsum([len(w) + 1 for w in plain])
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(plain)) if words else []
        owners = np.searchsorted(ends, np.array([a for _, (a, _) in cut], dtype=np.int64), side="right").tolist()
        distinct: dict[str, int] = {}
        for (text, _), k in zip(cut, owners, strict=True):
            if text not in distinct:
                distinct[text] = len(parts)
                parts.append(self.merges.start(text))
            owner.append(k)
        short = [k for k, p in enumerate(parts) if len(p) <= IN_STEP]
        made = dict(zip(short, self.merges.together([parts[k] for k in short]), strict=True))
        out: list[list[int]] = [[] for _ in whole]
        for (text, _), k in zip(cut, owner, strict=True):
            p = distinct[text]
            if p not in made:
                made[p] = self.merges.alone(parts[p])
            out[belongs[k]] += made[p]
        return out


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of ``words`` (distinct, in byte order) and the ids of each by rank.

    Words are added in order; what the next word no longer shares with the last one is final and is replaced by an equal state,
    if there is one (incremental construction for sorted input).
    """
    states: list[tuple[bool, tuple]] = []  # (ends a word, ((byte, state), ...))
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # of the last word: [ends a word, arcs so far]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            if state not in known:
                known[state] = len(states)
                states.append(state)
            path[-1][1][-1] = (path[-1][1][-1][0], known[state])

    last = b""
    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))  # the root comes last
    below = [0] * len(states)
    for k, (final, arcs) in enumerate(states):  # a state's targets come before it
        below[k] = final + sum(below[t] for _, t in arcs)
    arcs, target, output, first = [], [], [], []
    for k, (final, own) in enumerate(states):
        first.append(len(arcs))
        total = int(final)
        for byte, t in own:
            arcs.append(k << 8 | byte), target.append(t), output.append(total)
            total += below[t]
    made = {"first": first, "final": [f for f, _ in states], "arcs": arcs, "target": target, "output": output, "at": np.append(0, np.cumsum([len(x) for x in ids])), "ids": [x for i in ids for x in i]}
    return {name: np.asarray(made[name], dtype=kind) for name, kind in _ARRAYS}


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([len(arrays[name]) for name, _ in _ARRAYS]).encode().ljust(256)
    return head + b"".join(arrays[name].tobytes() + b"\0" * (-arrays[name].nbytes % 8) for name, _ in _ARRAYS)


class Lexicon:
    """A compiled lexicon over a file that is mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, mode="r", dtype=np.uint8)
        at = 256
        for (name, kind), n in zip(_ARRAYS, json.loads(raw[:256].tobytes()), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size + -size % 8

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each byte string, -1 where it is not in the lexicon. All strings step through the automaton together."""
        state = np.full(len(starts), len(self.first) - 1, dtype=np.int64)
        rank = np.zeros(len(starts), dtype=np.int64)
        live, at = np.arange(len(starts)), starts.astype(np.int64)
        while len(live) and len(self.arcs):
            live, at = live[at < ends[live]], at[at < ends[live]]
            keys = (state[live].astype(np.uint64) << np.uint64(8)) | raw[at]
            arc = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            goes = self.arcs[arc] == keys
            rank[live[~goes]] = -1
            live, at, arc = live[goes], at[goes] + 1, arc[goes]
            state[live] = self.target[arc]
            rank[live] += self.output[arc]
        return np.where((rank >= 0) & (self.final[state] > 0), rank, -1) if len(self.arcs) else np.full(len(starts), -1)


class LexiconEncoder(Encoder):
    """``Encoder`` whose pieces come from a lexicon, and by exact merges where that lacks them. Merged pieces are remembered."""

    def __init__(self, path: str, lexicon: Lexicon, memory: int = 250_000):
        self.lexicon = lexicon
        super().__init__(path, keep_space=False, memory=memory)
        self.cutter = Cutter(path)

    def _forget(self) -> None:
        super()._forget()
        self.flat = np.asarray(self.lexicon.ids).astype(self.dtype)
        self.at = np.asarray(self.lexicon.at).astype(np.int64)

    def _marks(self, raw: np.ndarray, at: np.ndarray, edge: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lexicon has words with their marks."""
        return ends, np.zeros(len(ends), dtype=bool)

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        raw, at = utf8(pieces)
        place = self.lexicon.find(raw, at[:-1], at[1:])
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            place[unseen] = self._merged(pieces.take(pa.array(unseen)))
        return place

    def _merged(self, pieces: pa.Array) -> np.ndarray:
        if len(self.pieces) > self.memory or self.pieces.nbytes > 64 * self.memory:
            self._forget()
        size = len(self.lexicon.at) - 1
        place = self._find(pieces)
        absent = np.flatnonzero(place < 0)
        fresh = pieces.take(pa.array(absent))
        place[absent] = self._note(fresh.cast(pa.large_string()))
        for a in range(0, len(fresh), 8192):
            made = self.cutter(fresh.slice(a, 8192).to_pylist())
            self.flat = np.concatenate([self.flat, np.array([x for ids in made for x in ids], dtype=self.dtype)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(ids) for ids in made], dtype=np.int64)])
        return place + size


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, a word being a run of other bytes than 0x20 and 0x09-0x0D. Tasks add up what they see first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in chunks(batches, limit=ENCODE_BYTES):
            words = pc.split_pattern_regex(pc.drop_null(batch.column("text")), "[ \t-\r]+").flatten()
            seen = pc.value_counts(words)
            held.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
            rows += len(seen)
            if rows > 2 * COUNTED:
                held = [total()]
                rows = held[0].num_rows
                if rows > COUNTED:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from total().combine_chunks().to_batches()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int, text_col: str = "text") -> list[str]:
    """Words of the highest counts in the whole table, at most ``most`` of them.

    Counts are compared in steps of a sixteenth of a doubling, so that the driver chooses the bound from some hundred numbers; the words
    at or above it are all taken.
    """
    counted = count_words(docs, text_col).withColumn("step", F.floor(F.log2("n") * 16).cast("int"))
    counted = cut(counted)
    bound, total = None, 0
    for row in sorted(counted.groupBy("step").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        bound = row["step"]
    return [] if bound is None else [r["word"] for r in counted.where(F.col("step") >= bound).select("word").collect()]


def publish_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    """Compiles the lexicon of ``words``, writes it to the shared folder and hands it to the executors; the name they know it by."""
    by_bytes = sorted({w.encode() for w in words if w})
    cutter = Cutter(path)
    data = dump(compile_lexicon(by_bytes, cutter([w.decode() for w in by_bytes])))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(place.toString())
    return name


@lru_cache(maxsize=2)
def worker_encoder(path: str, name: str) -> LexiconEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LexiconEncoder(path, Lexicon(SparkFiles.get(name)))


@lru_cache(maxsize=2)
def token_names(path: str) -> pa.Array:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return pa.array([tokenizer.id_to_token(i) or "" for i in range(max(tokenizer.get_vocab().values()) + 1)], type=pa.string())


def joined_tokens(names: pa.Array, ids: list[bytes]) -> pa.Array:
    """The decoded text of each array of little-endian unsigned 32-bit ids."""
    at = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
    tokens = names.take(pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), tokens), " ")


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = 200_000, out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text as little-endian unsigned 32-bit integers in the binary column ``out_col``.

    The ids are those of the tokenizers library for the vocabulary file ``tokenizer`` (word BPE: lower case, white space dropped)
    without added special tokens; strings of special tokens in a text are those tokens. The lexicon holds at most ``most`` words
    and decides on speed alone. ``decoded_col`` names a further column for what ``decode`` makes of the ids, worked out in the same
    Python workers. Null and empty texts have no ids. Rows, repeated ones too, and columns stay; columns of these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = publish_lexicon(spark, frequent_words(docs, most, text_col), tokenizer)
    kept = docs.drop(out_col, *[decoded_col] * bool(decoded_col))
    source = docs.select(*own_columns(kept), F.col(text_col).alias("_folio_text"))
    columns, width = kept.columns, len(kept.columns)
    more = {out_col: "binary"} | ({decoded_col: "string"} if decoded_col else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = worker_encoder(tokenizer, name)
        for batch in chunks(batches, "_folio_text", ENCODE_BYTES):
            ids = [np.frombuffer(x, dtype=code.dtype).astype("<u4").tobytes() for x in code(batch.column(width))]
            made = [pa.array(ids, type=pa.binary())] + ([joined_tokens(token_names(tokenizer), ids)] if decoded_col else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), *made], names=[*columns, *more])

    return source.mapInArrow(run, with_fields(kept, **more))


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of the ids as the tokenizers library decodes them, special tokens included.

    A vocabulary without a decoder gives its tokens, with their word marks, joined by blanks. No ids (null or empty) give an empty text.
    Rows and columns stay; a column named ``out_col`` is replaced.
    """
    kept = coded.drop(out_col)
    source = coded.select(*own_columns(kept), F.col(ids_col).alias("_folio_ids"))
    columns, width = kept.columns, len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_folio_ids"):
            text = joined_tokens(token_names(tokenizer), pc.fill_null(batch.column(width), b"").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(width)), text], names=[*columns, out_col])

    return source.mapInArrow(run, with_fields(kept, **{out_col: "string"}))
