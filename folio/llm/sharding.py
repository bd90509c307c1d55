"""K-d tree partitioning of documents into shards of near-equal bytes, with DataFrame operations only.

Each group of equal texts is one point: in each dimension it stands at the smallest of its documents' values, its weight is the
bytes of all its copies. The tree starts with one node that owns all shards. A node that owns several splits at the weighted
median (for an odd number: at the weighted quantile) along the dimension in which it is widest, until every leaf owns one shard.
The medians are found by radix selection on per-node histograms: each round sums the weights of at most 4096 bins per node, so
what is gathered has a fixed size while the sums run as partial aggregates over all partitions. Points of more than a sixteenth
of a shard (there are at most sixteen times as many as shards) are dealt to the two sides one by one, in their order along the
dimension and in proportion, and the cut through the other points makes up for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.store import cut, join_counted

#: A dimension's coordinate has 20 bits; 40 more bits of hash order equal coordinates.
COORD_BITS, TIE_BITS, RADIX_BITS = 20, 40, 12


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """0 to 2**20 - 1 over the range of the whole table; 0 where the range is empty."""
    return F.coalesce(((value - low) / F.nullif(high - low, F.lit(0.0)) * F.lit((1 << COORD_BITS) - 1)).cast("long"), F.lit(0).cast("long"))


def _pick(by: Column, choices: dict, default: Column) -> Column:
    """CASE over a few literal keys; ``choices`` has at most one entry per shard."""
    return reduce(lambda c, kv: F.when(by == F.lit(kv[0]), kv[1]).otherwise(c), choices.items(), default)


def kd_shards(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = ("n_chars", "source", "lang", "doc_id"),
    overhead: int = 8,
    rows_per_slice: int = 20_000,
    fine: float = 0.0005,
) -> DataFrame:
    """Every row with its shard: (id_col, size, text_crc32, shard, slot).

    ``size`` is the UTF-8 length of the text plus ``overhead``. Shards get near-equal bytes. Equal texts (null counts as
    empty) share a shard, unless their group holds more bytes than a shard's share: such a group is dealt over points of about a
    quarter of a share by a hash of the id, as no even law could hold with it whole. ``slot`` numbers a shard's rows without gaps
    from 0, by hash slice and then id; rows that are the same take any of their slots. String dimensions are placed by hash, so that
    few values still spread; nulls in a dimension are at its low end. Points at the same place are told apart by a hash of the text.
    Repeated rows each take a slot. An empty table gives an empty result;
    columns that are not named here are not read, and a dimension that the table lacks is left out.
    """
    kinds = dict(docs.dtypes)
    dims = [d for d in dimensions if d in kinds]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    coords = [F.crc32(F.encode(F.col(d), "UTF-8")).cast("double") if kinds[d] == "string" else F.log1p(F.abs(F.col(d).cast("double"))) if d == "n_chars" else F.col(d).cast("double") for d in dims]
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("key"), *(c.alias(f"d{i}") for i, c in enumerate(coords)),
    )
    places = [f"d{i}" for i in range(len(dims))]
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"), *(F.min(d).alias(d) for d in places)))
    known = groups.agg(F.sum("bytes").alias("bytes"), *(F.min(d).alias(f"lo_{d}") for d in places), *(F.max(d).alias(f"hi_{d}") for d in places)).first()
    share = max(1, (known["bytes"] or 0) // shards)
    pieces = F.least(F.col("copies"), F.ceil(4 * F.col("bytes") / F.lit(share)))
    parts = F.when(F.col("bytes") <= share, 1).otherwise(pieces).cast("int").alias("parts")
    scale = [_scaled(F.col(d), F.lit(known[f"lo_{d}"]).cast("double"), F.lit(known[f"hi_{d}"]).cast("double")).alias(d) for d in places]
    tie = F.pmod(F.xxhash64("key", "part"), F.lit(1 << TIE_BITS)).alias("tie")
    every = groups.select("key", "bytes", "copies", parts, *scale).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = cut(every.select("key", "part", "parts", "copies", (F.col("bytes") / F.col("parts")).alias("w"), *places, tie, F.lit(0).alias("node")))
    is_heavy = F.col("w") > share / 16
    heavy = [r.asDict() for r in every.where(is_heavy).collect()]  # at most 16 a shard, by weight
    points = every.where(~is_heavy)

    owned = {0: shards}  # first shard of a node -> shards it owns
    while any(n > 1 for n in owned.values()):
        todo = [k for k, n in owned.items() if n > 1]
        light = {r["node"]: r for r in points.groupBy("node").agg(F.sum("w").alias("w"), *(F.struct(F.min(d), F.max(d)).alias(d) for d in places)).collect()}
        along, goal, sides = {}, {}, {}
        for k in todo:
            own = [h for h in heavy if h["node"] == k]
            reach = [[*(light[k][d] if k in light else ()), *(h[d] for h in own)] or [0] for d in places]
            along[k] = max(range(len(places)), key=lambda i: (max(reach[i]) - min(reach[i]), -i)) if places else 0
            share_left = (owned[k] // 2) / owned[k]
            rest = light[k]["w"] if k in light else 0.0
            room, left = sum(h["w"] for h in own) * share_left, 0.0
            sides[k] = []
            for h in sorted(own, key=lambda h: ((h[places[along[k]]] if places else 0), h["tie"])):
                if left + h["w"] <= room * (1 + 1e-9):
                    left += h["w"]
                else:
                    sides[k].append(h)
            goal[k] = min(rest, max(0.0, (rest + sum(h["w"] for h in own)) * share_left - left))
        value = _pick(F.col("node"), {k: F.col(places[i]) for k, i in along.items()}, F.lit(0).cast("long")) if places else F.lit(0).cast("long")
        at = points.where(F.col("node").isin(todo)).select("node", "w", F.shiftleft(value, TIE_BITS).bitwiseOR(F.col("tie")).alias("sort"))
        start, passed = {k: 0 for k in todo}, {k: 0.0 for k in todo}
        for shift in range(COORD_BITS + TIE_BITS - RADIX_BITS, -1, -RADIX_BITS):
            inside = _pick(F.col("node"), {k: F.lit(v) for k, v in start.items()}, F.lit(-1)).cast("long")
            binned = at.where(F.shiftright("sort", shift + RADIX_BITS) == F.shiftright(inside, shift + RADIX_BITS))
            bins = binned.groupBy("node", F.shiftright("sort", shift).alias("bin")).agg(F.sum("w").alias("w"))
            before = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) - F.col("w")
            left = _pick(F.col("node"), {k: F.lit(goal[k] - passed[k]) for k in todo}, F.lit(0.0))
            hits = bins.withColumn("before", before).where(F.col("before") <= left).groupBy("node").agg(F.max_by(F.struct("bin", "before", "w"), "bin").alias("hit")).collect()
            last = shift == 0 or all(r["hit"]["w"] <= share * fine for r in hits)
            for r in hits:
                start[r["node"]] = r["hit"]["bin"] << shift
                passed[r["node"]] += r["hit"]["before"]
                if last and passed[r["node"]] + r["hit"]["w"] / 2 < goal[r["node"]]:  # the nearer side of the last bin
                    start[r["node"]] += 1 << shift
            if last:
                break
        split = {}
        for k in todo:
            half = owned[k] // 2
            split[k] = (places[along[k]] if places else None, start[k], k + half)
            for h in sides[k]:
                h["node"] = k + half
            owned[k + half] = owned[k] - half
            owned[k] = half
        place = {k: (F.shiftleft(F.col(d), TIE_BITS) if d else F.lit(0).cast("long")).bitwiseOR(F.col("tie")) for k, (d, _, _) in split.items()}
        right = {k: F.when(place[k] >= F.lit(start), F.lit(new)).otherwise(F.col("node")) for k, (_, start, new) in split.items()}
        points = cut(points.withColumn("node", _pick(F.col("node"), right, F.col("node"))))

    fields = ["key", "part", "parts", "copies", "node"]
    points = points.select(*fields).union(docs.sparkSession.createDataFrame([tuple(h[c] for c in fields) for h in heavy], "key string, part int, parts int, copies long, node int"))
    spots = F.array_sort(F.collect_list(F.struct("part", F.col("node").alias("shard")))).alias("spots")
    leaf = cut(points.groupBy("key").agg(F.first("parts").alias("parts"), F.first("copies").alias("n"), spots))
    spot = F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")
    dealt = join_counted(rows.select("id", "size", "text_crc32", "key"), leaf, ["key"], "id").select("id", "size", "text_crc32", F.col("spots")[spot]["shard"].cast("int").alias("shard"))
    n = groups.count()
    slices = max(16, n // (shards * rows_per_slice))
    dealt = cut(dealt.withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slices))))
    sizes = dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    offset = (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("base")
    first = sizes.select("shard", "slice", offset)
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32")) - 1
    return dealt.withColumn("k", within).join(first, ["shard", "slice"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("k")).cast("long").alias("slot")
    )
