"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping windows. A window of m characters that occurs in a document with at most k edits
shares at least m - q + 1 - k q of its q-grams with it, on diagonals (document position less window position) that lie within
k of each other. So shared q-grams are counted in overlapping diagonal bands; bands that reach the bound are kept and
verified by an alignment of the window with the band's stretch of the document. No occurrence within the budget is missed.
Short texts are looked up exactly, on token boundaries.

Frequent q-grams stay cheap without loss. A window does without up to half of the q-grams it needs, those that many windows
have, and needs as many fewer. A run of one character is taken as a whole on both sides: its positions fill an interval of
diagonals, and a document's position counts once for a band, so that runs cost their length over the budget, not their product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import own_columns, small_batches, with_fields
from folio.llm.textops import _BASE, _BASE_INV, _power, chunks, mix

SEEN_BITS = 22
#: Occurrences in the windows from which a q-gram counts as frequent.
HOT = 512
#: Pairs of positions that are expanded at once.
PAIRS = 1 << 18
#: Bytes of text that are looked through at once; a longer text stands alone.
TEXT_BYTES = 1 << 18
#: Characters of scripts that put no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Lower case, each run of white space one blank, zero characters gone."""
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgrams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on."""
    n = len(chars)
    if n < q:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * _power("down", _BASE_INV, n)[: n - q + 1])


def infix_distance(window: np.ndarray, region: np.ndarray) -> int:
    """Fewest edits that turn the window into some stretch of the region."""
    step = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, dtype=np.int64)
    for i, c in enumerate(window, 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (region != c), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


@dataclass
class Probes:
    """The windows of benchmark texts with their q-gram table."""

    items: np.ndarray
    windows: list[str]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    last_of: np.ndarray
    q: int
    short: dict[int, tuple[np.ndarray, dict[str, list[int]]]]

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << SEEN_BITS, dtype=bool)
        self.seen[self.grams >> np.uint64(64 - SEEN_BITS)] = True


def _goes_on(left: str, right: str) -> bool:
    """Whether a token holds both neighbours; scripts written without blanks have a boundary at every character."""
    return left.isalnum() and right.isalnum() and not any(UNSPACED.match(c) for c in (left, right))


def probes(benchmark: list[tuple[int, str]], q: int, window: int, percent: int, least: int, fine: int = 0, hot: int = HOT) -> Probes:
    items, texts = [], []
    brief: dict[int, dict[str, list[int]]] = {}
    for item, text in benchmark:
        text = normal(text)
        if len(text) < least:
            if any(c.isalnum() for c in text):
                brief.setdefault(len(text), {}).setdefault(text, []).append(item)
            continue
        starts = [(s, width) for width, step in ((window, window // 2), (fine, fine // 4)) if width for s in (*range(0, max(1, len(text) - width), step), max(0, len(text) - width))]
        for piece in dict.fromkeys(text[s : s + width] for s, width in starts):
            items.append(item)
            texts.append(piece)
    budget = np.array([len(t) * percent // 100 for t in texts], dtype=np.int64)
    need = np.array([len(t) - q + 1 for t in texts], dtype=np.int64) - budget * q
    if len(need) and need.min() < 1:
        raise ValueError("the edit budget leaves nothing to count; take smaller q-grams or fewer edits")
    hashed = [qgrams(codes(t), q) for t in texts]
    sizes = [len(h) for h in hashed]
    whole = np.concatenate(hashed or [np.empty(0, dtype=np.uint64)])
    where = np.repeat(np.arange(len(texts)), sizes) if texts else np.empty(0, dtype=np.int64)
    place = np.concatenate([np.arange(n) for n in sizes] or [np.empty(0, dtype=np.int64)])

    # frequent q-grams that a window can do without
    _, back, often = np.unique(whole, return_inverse=True, return_counts=True)
    often = often[back] if len(whole) else np.empty(0, dtype=np.int64)
    spare = np.zeros(len(whole), dtype=bool)
    for w in np.unique(where[often > hot]).tolist():
        begin = int(np.searchsorted(where, w))
        own = np.arange(begin, begin + sizes[w])
        frequent = own[often[own] > hot]
        frequent = frequent[np.argsort(-often[frequent], kind="stable")][: int(need[w]) // 2]
        spare[frequent] = True
        need[w] -= len(frequent)
    whole, where, place = whole[~spare], where[~spare], place[~spare]

    # runs of one q-gram in a window are one entry with its first and last position
    starts = np.ones(len(whole), dtype=bool)
    starts[1:] = (whole[1:] != whole[:-1]) | (where[1:] != where[:-1]) | (place[1:] != place[:-1] + 1)
    first_at = np.flatnonzero(starts)
    last = place[np.append(first_at[1:], len(whole)) - 1] if len(whole) else place
    whole, where, place = whole[first_at], where[first_at], place[first_at]

    order = np.argsort(whole, kind="stable")
    grams, first = np.unique(whole[order], return_index=True)
    short = {n: (np.unique([qgrams(codes(t), n)[0] for t in own]), own) for n, own in brief.items()}
    return Probes(np.array(items, dtype=np.int64), texts, budget, need, grams, np.append(first, len(whole)), where[order], place[order], last[order], q, short)


def bands(at: np.ndarray, row: np.ndarray, p: Probes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): for each window and diagonal band, ``window * 2 span + band + span``, how many of the positions ``at`` with the
    q-grams ``row`` share a q-gram with the window in that band, at the least bound that no true count exceeds."""
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    begin = np.flatnonzero(fresh)
    low, gram = at[begin], row[begin]
    high = at[np.append(begin[1:], len(at)) - 1]
    n = p.first[gram + 1] - p.first[gram]
    stops = np.cumsum(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    while done < len(gram):
        to = max(done + 1, int(np.searchsorted(stops, (stops[done - 1] if done else 0) + PAIRS, side="right")))
        k = n[done:to]
        pick = np.repeat(p.first[gram[done:to]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        window, a, b = p.window_of[pick], np.repeat(low[done:to], k), np.repeat(high[done:to], k)
        width = p.budget[window] + 1
        c, d = p.place_of[pick], p.last_of[pick]
        one = (a == b) & (c == d)  # no runs: one diagonal, in two bands
        base, band = window[one] * (2 * span) + span, (a[one] - c[one]) // width[one]
        held.append(np.unique(np.concatenate([base + band, base + band - 1]), return_counts=True))
        runs = np.flatnonzero(~one)
        window, width, a, b, c, d = (x[runs] for x in (window, width, a, b, c, d))
        # positions a..b against places c..d lie on the diagonals a - d .. b - c; a band holds two stripes of ``width`` diagonals
        from_, upto = (a - d) // width - 1, (b - c) // width
        many = upto - from_ + 1
        ends, cut = np.cumsum(many), 0
        while cut < len(many):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, side="right")))
            m = many[cut:stop]
            own = np.repeat(np.arange(cut, stop), m)
            band = from_[own] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            # how many of the positions a..b have a diagonal in the band, one each
            left, right = band * width[own] + c[own], (band + 2) * width[own] - 1 + d[own]
            count = np.minimum(b[own], right) - np.maximum(a[own], left) + 1
            real = count > 0
            keys, back = np.unique(window[own][real] * (2 * span) + band[real] + span, return_inverse=True)
            held.append((keys, np.bincount(back, weights=count[real], minlength=len(keys)).astype(np.int64)))
            cut = stop
        done = to
    if len(held) == 1:
        return held[0]
    keys, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([h[1] for h in held]), minlength=len(keys)).astype(np.int64)


def find(texts: list[str], p: Probes) -> dict[int, dict[int, int]]:
    """For each text (by position) that holds a window within its budget: item -> fewest edits found."""
    found: dict[int, dict[int, int]] = {}
    joined = "\0".join(texts) + "\0"
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    chars = codes(joined)
    for n, (hashes, own) in p.short.items():
        hashed = qgrams(chars, n)
        near = np.zeros(1 << 16, dtype=bool)
        near[hashes >> np.uint64(48)] = True
        at = np.flatnonzero(near[hashed >> np.uint64(48)])
        for start in at[np.isin(hashed[at], hashes)].tolist():
            text = joined[start : start + n]
            if text in own and not (start and _goes_on(joined[start - 1], text[0])) and not _goes_on(text[-1], joined[start + n]):
                found.setdefault(int(np.searchsorted(ends, start, side="right")), {}).update(dict.fromkeys(own[text], 0))
    hashed = qgrams(chars, p.q)
    at = np.flatnonzero(p.seen[hashed >> np.uint64(64 - SEEN_BITS)]) if len(p.grams) else np.empty(0, dtype=np.int64)
    if not len(at):
        return found
    row = np.searchsorted(p.grams, hashed[at])
    real = p.grams[np.minimum(row, len(p.grams) - 1)] == hashed[at]
    at, row = at[real], row[real]
    if not len(at):
        return found
    span = len(chars) + 2  # bands of one window
    keys, counts = bands(at, row, p, span)
    good = counts >= p.need[keys // (2 * span)]
    keys = keys[good]
    if not len(keys):
        return found
    window, band = keys // (2 * span), keys % (2 * span) - span
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1] + 1))  # neighbouring bands of a window go together
    for w, first, last in zip(window[starts].tolist(), band[starts].tolist(), band[np.append(starts[1:], len(keys)) - 1].tolist(), strict=True):
        k, text, item = int(p.budget[w]), p.windows[w], int(p.items[w])
        low, high = max(0, first * (k + 1) - k), min(len(joined), (last + 2) * (k + 1) + len(text) + k)
        for d in range(int(np.searchsorted(ends, low, side="right")), len(texts)):
            lo, hi = max(low, int(ends[d] - sizes[d])), min(high, int(ends[d]) - 1)
            if lo >= high:
                break
            if hi - lo < len(text) - k or found.get(d, {}).get(item) == 0:
                continue
            edits = 0 if text in joined[lo:hi] else infix_distance(codes(text), chars[lo:hi])
            if edits <= k:
                own = found.setdefault(d, {})
                own[item] = min(edits, own.get(item, edits))
    return found


def mark_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    q: int = 8, window: int = 120, percent: int = 8, least: int = 24, block_chars: int = 16 << 20, fine: int = 0,
) -> DataFrame:
    """``docs`` with ``matches``: array of (item_id, edits) for the benchmark items of which a window occurs in the text.

    Text is lower-cased and its white space evened out. A window has ``window`` characters (or the whole item, if shorter) and
    may occur with up to ``percent`` edits per 100 of its characters. With ``fine``, windows of that many characters at a stride of
    a quarter of it are looked for as well: at 60, every unedited excerpt of at least 66 characters is found. Items with fewer than
    ``least`` characters match where they stand exactly, on token boundaries. Null items, empty ones and such short ones without a
    letter or digit match nothing; a null or empty text matches nothing. Rows and columns stay as they are (a column ``matches`` is
    replaced). The benchmark goes to the executors in blocks of at most ``block_chars`` characters (a third of it with ``fine``), one
    pass over the documents each.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(item_text_col), F.lit(""))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text.alias("text")).where("item IS NOT NULL AND text <> ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size * (3 if fine else 1) // block_chars))  # short windows hold each character four times more, long ones twice
    docs = docs.drop("matches") if "matches" in docs.columns else docs
    kept = docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
    found_type = "array<struct<item_id:bigint,edits:bigint>>"
    schema = with_fields(docs, matches=found_type)
    out = docs.withColumn("matches", F.expr(f"CAST(array() AS {found_type})"))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()  # bounded by block_chars
        shared = docs.sparkSession.sparkContext.broadcast(probes([(r["item"], r["text"]) for r in own], q, window, percent, least, fine))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in chunks(batches, "_folio_text", TEXT_BYTES):
                found = find([normal(t) for t in batch.column("_folio_text").to_pylist()], p)
                before = batch.column("matches").to_pylist() if blocks > 1 else [[]] * batch.num_rows
                new = [b + [{"item_id": i, "edits": e} for i, e in sorted(found.get(k, {}).items())] for k, b in enumerate(before)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(new, type=kind)], names=[*kept, "matches"])

        out = out.select(*own_columns(out), F.col(text_col).alias("_folio_text")).mapInArrow(run, schema)
    return out
