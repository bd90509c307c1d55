"""The trie of conversation prefixes, by truncation peeling.

A conversation is the sequence of keys of its prefixes: key d stands for its first d turns (a chained 128-bit hash of roles and texts),
so equal prefixes have equal keys and a node's parent is the key before it.

Peeling goes from the deepest nodes up: nodes of one depth are the conversations that end there merged with what survives from below;
each gives its row, loses its last turn and is grouped again under its parent. It runs in two parts:

1. Spark counts prefixes. One that more than ``group`` different conversations share is *hot*; every subtree below a conversation's last
   hot prefix is then bounded, and all its levels are peeled in one task.
2. Above, one grouping per level merges the survivors of all subtrees; sums, minima and counts are combined before they are shuffled,
   so a hot prefix is never gathered.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.store import cut, join_sized, small_batches

ROOT = b""
#: Rows of a batch that a task gives, and ids of a piece that waits for its digest.
ROWS, PIECE = 5000, 20_000
_PATH = "conv_id long, keys array<binary>, sizes array<long>"
_NODE = "key binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turns(conversations: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(conv_id, turn, role, digest, size): one row per turn, the text by its hash and its UTF-8 bytes.

    ``columns`` names columns that are called otherwise. Null roles and texts are empty; rows without a conv_id are of no conversation.
    """
    conv, turn, role, text = (F.col((columns or {}).get(c, c)) for c in ("conv_id", "turn", "role", "text"))
    conv, role, text = conv.cast("long"), F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    small_batches(conversations.sparkSession)
    return conversations.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")


def prefix_paths(rows: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """(conv_id, keys, sizes): each conversation's prefix keys and the bytes of its turns' texts, from ``turns``.

    Turns go by number (null first), equal numbers by role and text hash. With ``base`` and ``shared`` (expressions over conv_id) the first
    ``shared`` turns are those of the conversation ``base`` (all if it has fewer, none if it is absent), and the conversation's own
    follow after its first ``shared``. A conversation and its base meet in one task; its turns take some 60 bytes each there.
    """
    rows = rows.withColumn("base", F.col("conv_id") if base is None else base).withColumn("shared", F.lit(0) if shared is None else shared)
    dealt = rows.repartition("base").sortWithinPartitions("base", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest").select("base", "conv_id", "shared", "digest", "size")

    def chain(own: list[tuple[bytes, int]]) -> tuple[list[bytes], list[int]]:
        keys, key = [], ROOT
        for digest, _ in own:
            key = hashlib.blake2b(key + digest, digest_size=16).digest()
            keys.append(key)
        return keys, [size for _, size in own]

    def rebuild(family: dict[int, tuple[int, list]], base: int) -> pa.RecordBatch:
        first = family.get(base, (0, []))[1]
        made = [chain(first[:n] + own[n:]) for n, own in family.values()]
        return pa.RecordBatch.from_arrays([pa.array([*family], pa.int64()), pa.array([k for k, _ in made], pa.list_(pa.binary())), pa.array([s for _, s in made], pa.list_(pa.int64()))], names=["conv_id", "keys", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family: dict[int, tuple[int, list]] = {}
        now = None
        for batch in batches:
            for base, conv, n, digest, size in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "shared", "digest", "size")), strict=True):
                if family and base != now:
                    yield rebuild(family, now)
                    family = {}
                now = base
                family.setdefault(conv, (n, []))[1].append((digest, size))
        if family:
            yield rebuild(family, now)

    return dealt.mapInArrow(run, _PATH)


class _Level:
    """What is known of the nodes of one depth while their subtrees are merged."""

    __slots__ = ("conv_id", "kids", "leaves", "members", "path", "saved", "sizes")

    def __init__(self, path: list[bytes], sizes: list[int], conv_id: int):
        self.path, self.sizes, self.conv_id = path, sizes, conv_id
        self.members = self.leaves = self.saved = 0
        self.kids: list[tuple] = []


def _peel(paths: list[tuple[int, int, list[bytes], list[int]]], down_to: int) -> list[tuple]:
    """Node rows of the subtree of ``paths`` (members, conv_id, keys, sizes) from depth ``down_to`` on.

    The rows end with the path above the node and its sizes for what survives at ``down_to`` (its parent's conv_id is not known yet),
    with nothing for the nodes below.
    """
    ended: dict[int, list] = {}
    for p in paths:
        ended.setdefault(len(p[2]), []).append(p)
    rows: list[tuple] = []
    below: list[_Level] = []
    for depth in range(max(ended), down_to - 1, -1):
        level: dict[bytes, _Level] = {}
        for n, conv, keys, sizes in ended.get(depth, ()):
            node = level.get(keys[depth - 1]) or level.setdefault(keys[depth - 1], _Level(keys, sizes, conv))
            node.members += n
            node.conv_id = min(node.conv_id, conv)
        for child in below:
            key = child.path[depth - 1]
            node = level.get(key) or level.setdefault(key, _Level(child.path, child.sizes, child.conv_id))
            node.members += child.members
            node.conv_id = min(node.conv_id, child.conv_id)
            node.leaves += child.leaves
            node.saved += child.saved
            node.kids.append((child.path[depth], key, depth + 1, child.conv_id, child.members, len(child.kids), child.leaves, child.saved))
        for node in level.values():
            node.leaves = node.leaves or 1
            node.saved += (node.members - 1) * node.sizes[depth - 1]
            rows += [(key, parent, d, conv, node.conv_id, *rest, None, None) for key, parent, d, conv, *rest in node.kids]
        for child in below:
            child.kids = []
        below = [*level.values()]
    for node in below:
        parent = node.path[down_to - 2] if down_to > 1 else ROOT
        rows.append((node.path[down_to - 1], parent, down_to, node.conv_id, None, node.members, len(node.kids), node.leaves, node.saved, node.path[: down_to - 1], node.sizes[: down_to - 1]))
    return rows


def peel_prefixes(paths: DataFrame, group: int = 256) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, keys, sizes), one row each.

    (key, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens): the node's key and its parent's (null for the
    root, whose key is empty), its depth, its smallest member, its parent's smallest member, its members, its children, the childless
    nodes of its subtree with itself, and the sum over its subtree of (members - 1) times the bytes of the node's last text. Without
    paths there are no nodes.
    """
    last = F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(bytearray()))
    whole = cut(paths.groupBy(last.alias("end")).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes")))
    prefixes = whole.select("end", F.explode("keys").alias("key"))
    hot = cut(prefixes.groupBy("key").count().where(F.col("count") > group).select("key"))
    shared = join_sized(prefixes, hot, ["key"], hot.count()).groupBy("end").agg(F.count("*").cast("int").alias("hot"))
    placed = cut(whole.join(shared, "end", "left").withColumn("hot", F.coalesce("hot", F.lit(0))))

    schema = f"{_NODE}, up array<binary>, up_sizes array<long>"
    kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = [*_COLUMNS, "up", "up_sizes"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows: list[tuple] = []
        now = depth = None
        for batch in batches:
            for top, hot, *p in zip(*(batch.column(c).to_pylist() for c in ("top", "hot", "n", "conv_id", "keys", "sizes")), strict=True):
                if held and top != now:
                    rows += _peel(held, depth)
                    held = []
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
                now, depth = top, hot + 1
                held.append(p)
        if held:
            yield batch_of(rows + _peel(held, depth))

    inner = placed.where("size(keys) > hot").withColumn("top", F.expr("keys[hot]"))
    lower = cut(inner.repartition("top").sortWithinPartitions("top").select("top", "hot", "n", "conv_id", "keys", "sizes").mapInArrow(run, schema))

    state = ["up", "up_sizes", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    tops = lower.where("up IS NOT NULL")
    outer = placed.where("size(keys) <= hot").select(F.col("keys").alias("up"), F.col("sizes").alias("up_sizes"), "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    arriving = cut(tops.select(*state, F.lit(1).alias("kid")).unionByName(outer.select(*state, F.lit(0).alias("kid"))).withColumn("d", F.size("up")))
    deepest = arriving.agg(F.max("d")).first()[0]
    upper, survivors = [], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = arriving.where(F.col("d") == depth).drop("d")
        if survivors is not None:
            rows = rows.unionByName(survivors.select(F.expr("slice(up, 1, size(up) - 1)").alias("up"), F.expr("slice(up_sizes, 1, size(up_sizes) - 1)").alias("up_sizes"), *state[2:], F.lit(1).alias("kid")))
        key, size = (F.expr("up[size(up) - 1]"), F.expr("up_sizes[size(up_sizes) - 1]")) if depth else (F.lit(bytearray()), F.lit(0))
        merged = rows.withColumn("key", key).groupBy("key").agg(
            F.first("up").alias("up"), F.first("up_sizes").alias("up_sizes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("kid").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        )
        parent = {0: F.lit(None).cast("binary"), 1: F.lit(bytearray())}.get(depth, F.expr("up[size(up) - 2]"))
        survivors = cut(merged.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * size, "parent": parent, "depth": F.lit(depth)}))
        upper.append(survivors)
    if not upper:
        return lower.select(*_COLUMNS)

    joined = upper[0].drop("up", "up_sizes")
    for level in upper[1:]:
        joined = joined.unionByName(level.drop("up", "up_sizes"))
    named = joined.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    open_rows = tops.drop("up", "up_sizes", "parent_conv_id").unionByName(joined)
    found = join_sized(open_rows.where("parent IS NOT NULL"), named, ["parent"], named.count())
    roots = open_rows.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return lower.where("up IS NULL").select(*_COLUMNS).unionByName(found.select(*_COLUMNS)).unionByName(roots.select(*_COLUMNS))


def ends(paths: DataFrame) -> DataFrame:
    """(key, conv_id): the node at which each conversation ends."""
    return paths.select(F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(bytearray())).alias("key"), "conv_id")


def ends_digest(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the members' decimal ids, ascending, joined by commas, from ``ends``.

    Members are sorted over ranges of (key, id), so those of one node may lie in many tasks. A task gives the digest of a node that lies
    inside it; of others it packs the ids in pieces, and one task per node hashes the pieces in order, holding one at a time (the
    digest of a long list is sequential by definition).
    """
    packed = "key binary, first long, ids binary, digest string"
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "first", "ids", "digest"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, held, open_ended = None, [], True

        def close(whole: bool) -> None:
            joined = ",".join(map(str, held)).encode()
            rows.append((now, held[0], None, hashlib.sha256(joined).hexdigest()) if whole else (now, held[0], zlib.compress(joined, 1), None))

        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and key != now:
                    close(not open_ended)
                    held, open_ended = [], False
                elif len(held) == PIECE:
                    close(False)
                    held, open_ended = [], True
                now = key
                held.append(conv)
            if len(rows) >= ROWS:
                yield batch_of(rows)
                rows = []
        if held:
            close(False)  # may go on in the next range
            yield batch_of(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        for batch in batches:
            done: list[tuple] = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        done.append((now, None, None, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(zlib.decompress(ids))
                else:
                    digest.update(b"," + zlib.decompress(ids))
            if done:
                yield batch_of(done)
        if digest is not None:
            yield batch_of([(now, None, None, digest.hexdigest())])

    ranges = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = cut(ranges.mapInArrow(pack, packed))
    joined = pieces.where("digest IS NULL").repartition("key").sortWithinPartitions("key", "first").mapInArrow(join, packed)
    return pieces.where("digest IS NOT NULL").unionByName(joined).select("key", F.col("digest").alias("ends_sha256"))
