"""Token ids in segments of separately compressed documents that share a zstandard dictionary.

A segment is one self-contained byte string:

    magic "FTK1" | version u16 | id width u16 | first range u32 | documents u32 | dictionary hash 32 bytes |
    index: documents x (doc_id i64, has_id u8, frame end u64, tokens u64) | frames

Each frame is one document's ids, little-endian, compressed alone against the dictionary, so a reader fetches one document
by its index entry. Spark writes the segments as a table next to a one-row table with the dictionary, so any store that
Spark writes to will do and a lost executor's segments are simply written again.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import range_bounds, shared_dir, small_batches
from folio.llm.textops import chunks, mix, utf8

MAGIC, HEAD = b"FTK1", struct.Struct("<4sHHII32s")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("end", "<u8"), ("tokens", "<u8")])
#: Parts of a new piece: Latin-1 letters before white space or a mark, marks before white space, or all up to the next white
#: space. White space is Unicode's; Python's own \\s also takes 0x1C-0x1F, which the tokenizers take for ordinary characters.
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = re.compile(rf"{_LATIN}(?=[ \n.,;:!?]|\Z)|[.,;:!?]+(?=[ \n]|\Z)|[\S\x1c-\x1f]+")
_SPACED = re.compile(rf" ?{_LATIN}(?=[ \n.,;:!?]|\Z)|[.,;:!?]+(?=[ \n]|\Z)|[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Text bytes that are encoded at once; one longer text goes alone.
ENCODE_BYTES = 3 << 20
#: Bytes of marks, and of ASCII letters.
_MARKS, _LETTERS = np.isin(np.arange(256), list(b".,;:!?")), np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
#: The low 0 to 8 bytes of a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: UTF-8 of white space beyond ASCII.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def latin(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of ``_LATIN``; one entry more than bytes, which is False."""
    out = np.append(_LETTERS[raw], False)
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def all_of(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether all flags are set in each of these ascending spans, none of them empty."""
    return np.logical_and.reduceat(flags, np.column_stack([starts, ends]).ravel())[::2] if len(starts) else np.zeros(0, dtype=bool)


def piece_keys(pieces: pa.Array) -> np.ndarray:
    """Hashes of the strings: of their size, first 32 and last 16 bytes."""
    raw, at = utf8(pieces)
    size, n = np.diff(at), len(raw)
    words = np.ndarray((n + 1,), "<u8", np.append(raw, np.zeros(8, dtype=np.uint8)), strides=(1,))
    out = size.astype(np.uint64)
    for o in (0, 8, 16, 24):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (words[np.minimum(at[:-1] + o, n)] & _LOW[np.clip(size - o, 0, 8)]))
    for o in (8, 16):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(size >= o, words[np.maximum(at[1:] - o, 0)], 0))
    return out


class Encoder:
    """Encodes texts with a public tokenizer, remembering the ids of each piece between white space.

    A batch is cut by numpy at ASCII white space and between a word of letters and the marks at its end, Arrow finds its distinct
    pieces, and only those are looked up; ids are gathered by position. Neither tokenizer's pattern lets a token span the end of a run
    of letters or marks before other characters, so the ids of a text are those of its pieces one after another, and those of a new
    piece are those of its parts. New pieces of letters alone are encoded many at a time as one text, and told apart by the
    vocabulary's own word marks (a word's end, or its leading blank). What is remembered lies in Arrow and numpy buffers, some 50 bytes
    a piece; it is found by a hash and compared as a whole. ``keep_space`` leaves white space in front of a piece (byte-level
    vocabularies encode it); else it is dropped (word vocabularies ignore it). The memory holds about ``memory`` pieces and then starts
    anew. Strings of special tokens are read as the library reads them by default, as those tokens; texts that hold one are encoded whole.
    """

    def __init__(self, path: str, keep_space: bool, memory: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pattern = _SPACED if keep_space else _WORD
        self.keep_space = keep_space
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.edge = np.array([names.get(i, "").startswith("Ġ") if keep_space else names.get(i, "").endswith("</w>") for i in range(max(names) + 1)])
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.I)
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], type=pa.large_string())
        self.flat = np.empty(0, dtype=self.dtype)
        self.at = np.zeros(1, dtype=np.int64)
        self.keys, self.order = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # ascending, and whose they are

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, serialised little-endian in ``self.dtype``. Null is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string()), "")
        raw, at = utf8(texts)
        data = raw.tobytes()
        odd = {int(k) for k in np.searchsorted(at, [m.start() for m in _WIDE_SPACE.finditer(data)], side="right") - 1} if _WIDE_SPACE.search(data) else set()
        whole = {k for k in range(len(texts)) if self.special.search(texts[k].as_py())} if b"|>" in data else set()
        out = self._gather(raw, at)
        for k in odd - whole:
            coded = pa.array(self.pattern.findall(texts[k].as_py()), type=pa.large_string()).dictionary_encode()
            out[k] = self._ids(self._look_up(coded.dictionary)[coded.indices.to_numpy()])[0]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return out

    def _gather(self, raw: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text, cut at ASCII white space and before the marks that end a word."""
        n = len(raw)
        if not n:
            return [b""] * (len(at) - 1)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        marks, marked = self._marks(raw, at, edge, starts, ends)
        if self.keep_space:  # white space and the word after it, the marks after a word, or what ends a text
            bound = np.append(False, last) | edge
            bound[marks[marked]] = True
            bounds = np.flatnonzero(bound)
            own = np.ones(max(0, len(bounds) - 1), dtype=bool)
        else:  # words, the marks after them if any, and white space by turns
            used = np.column_stack([np.ones_like(marked), marked, np.ones_like(marked)])
            bounds = np.column_stack([starts, marks, ends])[used]
            own = (np.ones_like(used) & [True, True, False])[used][:-1]
        if len(bounds) < 2:
            return [b""] * (len(at) - 1)
        strings = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        coded = strings.dictionary_encode()
        which = coded.indices.to_numpy()[own]
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[which] = True
        place = np.zeros(len(used), dtype=np.int64)
        place[used] = self._look_up(coded.dictionary.filter(pa.array(used)))
        got, total = self._ids(place[which])
        cuts = (total[np.searchsorted(bounds[:-1][own], at)] * self.dtype.itemsize).tolist()
        return [got[a:b] for a, b in zip(cuts, cuts[1:])]

    def _marks(self, raw: np.ndarray, at: np.ndarray, edge: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the marks begin that end each run between white space, and whether a word of letters and nothing else is before them."""
        mark = _MARKS[raw]
        begins = mark.copy()
        begins[1:] &= ~mark[:-1] | edge[1 : len(raw)]
        begins = np.flatnonzero(begins)
        marks = ends.copy()
        some = np.flatnonzero(mark[ends - 1])
        marks[some] = begins[np.searchsorted(begins, ends[some]) - 1]
        some = some[marks[some] > starts[some]]
        some = some[all_of(latin(raw), starts[some], marks[some])]
        if self.keep_space:  # white space before it is one blank at most
            gap = starts[some] - np.maximum(np.append(0, ends)[some], at[np.searchsorted(at, starts[some], side="right") - 1])
            some = some[(gap == 0) | (gap == 1) & (raw[starts[some] - 1] == 32)]
        marked = np.zeros(len(ends), dtype=bool)
        marked[some] = True
        return marks, marked

    def _ids(self, place: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids of the remembered pieces at these places, one after another, and how many stand before each piece."""
        many = np.diff(self.at)[place]
        total = np.append(0, np.cumsum(many))
        return self.flat[np.repeat(self.at[place] - total[:-1], many) + np.arange(total[-1])].tobytes(), total

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is remembered, or -1."""
        keys, place = piece_keys(pieces), np.full(len(pieces), -1, dtype=np.int64)
        k = np.searchsorted(self.keys, keys)
        some = np.flatnonzero(k < len(self.keys))
        some = some[self.keys[k[some]] == keys[some]]
        there = self.order[k[some]]
        same = pc.equal(pieces.take(pa.array(some)), self.pieces.take(pa.array(there))).to_numpy(zero_copy_only=False)
        place[some[same]] = there[same]
        return place

    def _note(self, pieces: pa.Array) -> np.ndarray:
        """Remembers pieces, whose ids are to follow. Returns their places."""
        places, keys = np.arange(len(pieces)) + len(self.pieces), piece_keys(pieces)
        order = np.argsort(keys)
        spot = np.searchsorted(self.keys, keys[order])
        self.keys, self.order = np.insert(self.keys, spot, keys[order]), np.insert(self.order, spot, places[order])
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        return places

    def _add(self, pieces: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remembers pieces with their ids, one after another. Returns their places."""
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return self._note(pieces)

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is remembered once this returns."""
        if len(self.pieces) > self.memory or self.pieces.nbytes > 64 * self.memory:
            self._forget()
        return self._place(pieces)

    def _place(self, pieces: pa.Array) -> np.ndarray:
        place = self._find(pieces)
        absent = np.flatnonzero(place < 0)
        if not len(absent):
            return place
        new = pieces.take(pa.array(absent))
        word = self._words(new)
        if word.any():
            words = new.filter(pa.array(word))
            place[absent[word]] = self._add(words, *self._encode_words(words.to_pylist()))
        others, at = new.filter(pa.array(~word)).to_pylist(), absent[~word]
        if not others:
            return place
        cut = [self.pattern.findall(x) for x in others]
        single = np.array([c == [x] for x, c in zip(others, cut, strict=True)])
        if single.any():
            whole = [others[k] for k in np.flatnonzero(single).tolist()]
            ids = [e.ids for k in range(0, len(whole), 4096) for e in self.tokenizer.encode_batch_fast(whole[k : k + 4096], add_special_tokens=False)]
            flat = np.fromiter((x for i in ids for x in i), dtype=self.dtype)
            place[at[single]] = self._add(pa.array(whole, type=pa.large_string()), flat, np.fromiter(map(len, ids), dtype=np.int64))
        if not single.all():
            split = [(others[k], cut[k]) for k in np.flatnonzero(~single).tolist()]
            coded = pa.array([x for _, c in split for x in c], type=pa.large_string()).dictionary_encode()
            got, total = self._ids(self._place(coded.dictionary)[coded.indices.to_numpy()])
            sizes = np.diff(total[np.append(0, np.cumsum([len(c) for _, c in split]))])
            place[at[~single]] = self._add(pa.array([x for x, _ in split], type=pa.large_string()), np.frombuffer(got, dtype=self.dtype), sizes)
        return place

    def _words(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are letters alone, after a blank if white space is kept."""
        raw, at = utf8(pieces)
        starts, ends = at[:-1] + self.keep_space, at[1:]
        some = np.flatnonzero((starts < ends) & (raw[at[:-1]] == 32)) if self.keep_space else np.flatnonzero(starts < ends)
        out = np.zeros(len(pieces), dtype=bool)
        out[some[all_of(latin(raw), starts[some], ends[some])]] = True
        return out

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of letters, one after another, and how many each has."""
        flat, sizes = [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            (coded,) = self.tokenizer.encode_batch_fast([("" if self.keep_space else " ").join(part)], add_special_tokens=False)
            ids = np.array(coded.ids, dtype=self.dtype)
            edges = np.flatnonzero(self.edge[ids])
            starts = edges if self.keep_space else np.append(0, edges[:-1] + 1)
            if len(starts) != len(part):
                raise ValueError("the vocabulary does not mark its words")
            flat.append(ids), sizes.append(np.diff(np.append(starts, len(ids))))
        return np.concatenate(flat), np.concatenate(sizes)


@lru_cache(maxsize=2)
def encoder(path: str, keep_space: bool) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, keep_space)


def train_dictionary(docs: DataFrame, path: str, keep_space: bool, end_id: int, text_col: str = "text", samples: int = 1000, sample_bytes: int = 16_384, size: int = 65_536) -> bytes:
    """A dictionary for id arrays, from the ``samples`` texts with the smallest hashes; empty if there is too little to learn.

    What is sampled depends on the texts alone. At most the first ``sample_bytes`` of each sampled id array reach the driver. The
    dictionary only sets how well the frames compress.
    """
    known = docs.where(F.col(text_col) != "").select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    cut_at = known.select("h").distinct().orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    chosen = known.where(F.col("h") <= F.lit(cut_at)) if cut_at is not None else known.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, keep_space)
        for batch in chunks(batches, limit=ENCODE_BYTES):
            ids = [x[:sample_bytes] for x in encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(ids, type=pa.binary())], names=["h", "ids"])

    got = chosen.mapInArrow(run, "h long, ids binary").groupBy("h").agg(F.min("ids").alias("ids")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["ids"]) for r in got]).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_segment(part: int, rows: list[tuple[int | None, bytes, int]], width: int, digest: bytes) -> bytes:
    index = np.zeros(len(rows), dtype=INDEX)
    index["doc_id"] = [0 if r[0] is None else r[0] for r in rows]
    index["has_id"] = [r[0] is not None for r in rows]
    index["end"] = np.cumsum([len(r[1]) for r in rows])
    index["tokens"] = [r[2] for r in rows]
    return HEAD.pack(MAGIC, 1, width, part, len(rows), digest) + index.tobytes() + b"".join(r[1] for r in rows)


class Segment:
    """Reads a segment; ``ids(k)`` decompresses the k-th document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, self.part, n, digest = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        self.index = np.frombuffer(data, dtype=INDEX, count=n, offset=HEAD.size)
        self.frames = memoryview(data)[HEAD.size + self.index.nbytes :]
        self.dtype = np.dtype(f"<u{width}")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        start = int(self.index["end"][k - 1]) if k else 0
        raw = self.reader.decompress(self.frames[start : int(self.index["end"][k])])
        return np.frombuffer(raw, dtype=self.dtype).astype("<u4")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, keep_space: bool = False, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4 << 20, level: int = 3
) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending id order under ``path``.

    Null texts are empty: their ids are the end id alone. Rows with a null id come first; rows that repeat an id follow one
    another. An empty table writes no segments. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bounds = range_bounds(docs.select(id_col), id_col)
    dictionary = train_dictionary(docs, tokenizer, keep_space, end_id, text_col)
    digest = hashlib.sha256(dictionary).digest()
    shared = spark.sparkContext.broadcast((bounds, dictionary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, words = shared.value
        to_ids = encoder(tokenizer, keep_space)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        end = np.array([end_id], dtype=to_ids.dtype).tobytes()
        for batch in chunks(batches, limit=ENCODE_BYTES):
            ids = [x + end for x in to_ids(batch.column("text"))]
            key = pc.fill_null(batch.column("id"), np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(bounds, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(part), pa.array([packer.compress(x) for x in ids], type=pa.binary()), pa.array([len(x) // to_ids.dtype.itemsize for x in ids], type=pa.int64())],
                names=["id", "part", "frame", "tokens"],
            )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer, keep_space).dtype.itemsize
        held: list = []
        size = total = seq = 0
        part = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "before": [total], "tokens": [sum(r[2] for r in held)], "data": [pack_segment(part, held, width, digest)]},
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())]),
            )

        for batch in batches:
            for i, p, frame, n in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "frame", "tokens")), strict=True):
                if held and (p != part or size + len(frame) > segment_bytes):
                    yield out()
                    total, seq = (total + sum(r[2] for r in held), seq + 1) if p == part else (0, 0)
                    held, size = [], 0
                part = p
                held.append((i, frame, n))
                size += len(frame)
        if held:
            yield out()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frames = source.mapInArrow(encode, "id long, part int, frame binary, tokens long").repartition("part").sortWithinPartitions("part", "id", "frame")
    frames.mapInArrow(segments, "part int, seq int, before long, tokens long, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(dictionary), bytearray(digest))], "dictionary binary, digest binary").write.mode("overwrite").parquet(f"{path}/dictionary")


def read_tokens(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """What the segments under ``path`` hold, by document: (id_col, start, n_tokens, ids_crc32[, ids]).

    ``start`` counts the ids of all documents before it in ascending id order.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("data"), batch.column("base").to_pylist(), strict=True):
                segment = Segment(data.as_buffer().to_pybytes(), shared.value)
                n = segment.index["tokens"].astype(np.int64)
                ids = [segment.ids(k) for k in range(len(n))]
                columns = [
                    pa.array(segment.index["doc_id"], mask=segment.index["has_id"] == 0),
                    pa.array(base + np.cumsum(n) - n),
                    pa.array(np.array([len(x) for x in ids], dtype=np.int64)),
                    pa.array(np.array([zlib.crc32(x.tobytes()) for x in ids], dtype=np.int64)),
                ]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in ids], type=pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    segments = spark.read.schema("part int, seq int, before long, tokens long, data binary").parquet(f"{path}/segments")
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row per id range
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    based = segments.join(offsets, "part").select("data", (F.col("offset") + F.col("before")).alias("base"))
    out = based.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def new_store(spark) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
