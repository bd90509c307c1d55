"""Lexical analytics: term statistics, keywords, BM25, summaries, evidence scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.sources.store import cut, small_batches

LATIN_ENDS = "。！？!?；;.\n"


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, token, n). A text's tokens are counted where it lies: nothing is shuffled."""
    return _by_row(docs.select(id_col, X.tokens(F.col(text_col)).alias("tokens")), id_col, "token string, n long", _counts)


class Coded:
    """The tokens of a batch of rows as numbers in the order of their UTF-8 bytes, row by row."""

    def __init__(self, lists: pa.Array):
        self.offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.codes = rank[coded.indices.to_numpy()] if len(coded) else np.empty(0, dtype=np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.offsets))

    @property
    def n(self) -> int:
        return max(1, len(self.words))


#: Tokens that a task works out at once, of whole rows; a longer row stands alone.
TOKENS = 1 << 16


def pieces(lists: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of rows of about ``most`` tokens; the lists hold tokens or lists of them."""
    ends = lists.offsets.to_numpy()
    if pa.types.is_list(lists.type.value_type):
        ends = lists.values.offsets.to_numpy()[ends]
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
        yield begin, min(end, len(lists))
        begin = end


def _by_row(rows: DataFrame, id_col: str, out: str, work: Callable, read: Callable | None = None) -> DataFrame:
    """Rows that ``work`` makes of each row's ``tokens``, with the row's id; about ``TOKENS`` tokens at a time, so that what a task
    holds and hands over does not grow with the number of rows in an Arrow batch. ``read`` makes the tokens of a batch of texts."""
    small_batches(rows.sparkSession)
    names = [id_col, *(c.split()[0] for c in out.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = read(batch.column(1)) if read else batch.column(1)
            for begin, end in pieces(lists, TOKENS):
                row, columns = work(lists.slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + begin)), *columns], names=names)

    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, {out}")


def _counts(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    c = Coded(tokens)
    keys, n = np.unique(c.row * c.n + c.codes, return_counts=True)
    return keys // c.n, [c.words.take(pa.array(keys % c.n)), pa.array(n)]


def top(rows: DataFrame, by: str | list[str], k: int, *order: Column) -> DataFrame:
    """The k first rows of each group; Spark cuts groups to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _best(row: np.ndarray, score: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row, by score and then word."""
    order = np.lexsort((word, -score, row))
    first = np.flatnonzero(np.append(True, np.diff(row[order]) != 0)) if len(order) else order
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[place < k]


def tfidf_keywords(docs: DataFrame, id_col: str, text_col: str, k: int, ends: str = LATIN_ENDS) -> DataFrame:
    """(id_col, keyword, score, frequency): a document's sentences serve as the collection for its idf. Each document is worked out
    in its row."""
    breaks = ends.replace("\n", "\r")

    def read(texts: pa.Array) -> pa.Array:
        """The tokens of each sentence that has any. No token crosses an end mark, so sentences need no more than to be split there."""
        whole = (x or "" for x in texts.to_pylist())
        return pa.array([X.token_lists(x if "\n" in ends else x.replace("\n", " "), breaks) for x in whole], pa.list_(pa.list_(pa.string())))

    def work(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))  # document of each sentence
        c = Coded(lists.flatten())
        doc = own[c.row]
        keys, of, n = np.unique(doc * c.n + c.codes, return_inverse=True, return_counts=True)
        row, word = keys // c.n, keys % c.n
        df = np.bincount(np.unique(c.row * len(keys) + of) % max(1, len(keys)), minlength=len(keys))
        docs, total = np.bincount(own, minlength=len(lists)), np.bincount(doc, minlength=len(lists))
        score = np.round(n / total[row] * (np.log((docs[row] + 1) / (df + 1)) + 1), 9)
        best = _best(row, score, word, k)
        return row[best], [c.words.take(pa.array(word[best])), pa.array(score[best]), pa.array(n[best])]

    made = _by_row(docs.select(id_col, text_col), id_col, "keyword string, score double, frequency long", work, read)
    return made.withColumn("score", F.round("score", 4))


def cooccurrence(docs: DataFrame, id_col: str, text_col: str, window: int = 4) -> DataFrame:
    """(id_col, src, dst, weight): symmetric counts of different tokens within a window of positions, in the document's row."""

    def work(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        c = Coded(tokens)
        ahead = [(c.row[d:], c.codes[:-d], c.codes[d:]) for d in range(1, window) if len(c.codes) > d]
        real = [(c.row[:-d] == c.row[d:]) & (c.codes[:-d] != c.codes[d:]) for d in range(1, window) if len(c.codes) > d]
        row, a, b = (np.concatenate([x[i][r] for x, r in zip(ahead, real, strict=True)] or [np.empty(0, dtype=np.int64)]) for i in range(3))
        keys, weight = np.unique(np.concatenate([(row * c.n + a) * c.n + b, (row * c.n + b) * c.n + a]), return_counts=True)
        return keys // (c.n * c.n), [c.words.take(pa.array(keys // c.n % c.n)), c.words.take(pa.array(keys % c.n)), pa.array(weight)]

    return _by_row(docs.select(id_col, X.tokens(F.col(text_col)).alias("tokens")), id_col, "src string, dst string, weight long", work)


def textrank(tokens: list[str] | np.ndarray, window: int = 4, damping: float = 0.85, rounds: int = 20) -> tuple[list, np.ndarray, np.ndarray] | None:
    """Words, scores and counts of one document by a fixed number of synchronous rounds; None without two different tokens."""
    words, at = np.unique(tokens if isinstance(tokens, np.ndarray) else np.array(tokens, dtype=object), return_inverse=True)
    if len(words) < 2:
        return None
    src = np.concatenate([at[:-d] for d in range(1, window) if len(at) > d])
    dst = np.concatenate([at[d:] for d in range(1, window) if len(at) > d])
    real = src != dst
    src, dst = np.concatenate([src[real], dst[real]]), np.concatenate([dst[real], src[real]])
    edge, weight = np.unique(src * len(words) + dst, return_counts=True)
    src, dst = edge // len(words), edge % len(words)
    out = np.bincount(src, weights=weight, minlength=len(words))
    share = weight / out[src]
    score = np.ones(len(words))
    for _ in range(rounds):
        score = (1 - damping) + damping * np.bincount(dst, weights=share * score[src], minlength=len(words))
    return list(words), score, np.bincount(at)


def textrank_keywords(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id_col, keyword, score, frequency). A document's word graph stands on its own, so each row is ranked where it lies:
    no edges are shuffled. A document of one word, which has no edges, falls back to its TF-IDF keyword."""

    def work(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        c = Coded(tokens)
        rows, words, scores, counts = [], [], [], []
        for row, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
            if (made := textrank(c.codes[a:b])) is not None:
                word, score, n = np.array(made[0]), np.round(made[1], 9), made[2]
                best = np.lexsort((word, -score))[:k]
                rows.append(np.full(len(best), row)), words.append(word[best]), scores.append(score[best]), counts.append(n[best])
        one = lambda parts, kind: np.concatenate(parts or [np.empty(0, dtype=kind)])
        return one(rows, np.int64), [c.words.take(pa.array(one(words, np.int64))), pa.array(one(scores, np.float64)), pa.array(one(counts, np.int64))]

    several = F.size(F.array_distinct("tokens"))
    known = docs.withColumn("tokens", X.tokens(F.col(text_col)))
    ranked = _by_row(known.where(several >= 2).select(id_col, "tokens"), id_col, "keyword string, score double, frequency long", work)
    rest = tfidf_keywords(known.where((F.size("tokens") >= 2) & (several < 2)), id_col, text_col, k)
    return ranked.withColumn("score", F.round("score", 4)).unionByName(rest)


def hybrid_keywords(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id_col, keyword, score, frequency): 0.6 TF-IDF + 0.4 TextRank over the union of both lists of 2k."""
    a = tfidf_keywords(docs, id_col, text_col, 2 * k).withColumnsRenamed({"score": "s1", "frequency": "f1"})
    b = textrank_keywords(docs, id_col, text_col, 2 * k).withColumnsRenamed({"score": "s2", "frequency": "f2"})
    score = F.round(0.6 * F.coalesce("s1", F.lit(0.0)) + 0.4 * F.coalesce("s2", F.lit(0.0)), 4)
    merged = a.join(b, [id_col, "keyword"], "full_outer").select(id_col, "keyword", score.alias("score"), F.coalesce("f1", "f2").alias("frequency"))
    return top(merged, id_col, k, F.desc("score"), F.asc("keyword")).drop("rank")


def bm25_terms(chunks: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, float]:
    """((id_col, token, n, dl), (token, idf), mean length): counts in the rows of the chunks, and their statistics.

    A negative idf is replaced by a quarter of the mean idf. The statistics are one row per token of the vocabulary, kept in the
    shared folder; totals are one row.
    """
    def work(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        row, (token, n) = _counts(tokens)
        return row, [token, n, pa.array(np.diff(tokens.offsets.to_numpy()).astype(np.int64)[row])]

    counts = _by_row(chunks.select(id_col, X.tokens(F.col(text_col)).alias("tokens")), id_col, "token string, n long, dl long", work)
    df = cut(counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("n")))
    docs, words = chunks.count(), df.agg(F.sum("n")).first()[0] or 0
    raw = df.withColumn("idf", F.log(docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    idf = raw.select("token", F.when(F.col("idf") < 0, 0.25 * mean).otherwise(F.col("idf")).alias("idf"))
    return counts, idf, words / max(1, docs) or 1.0


def bm25_weight(average: float, k1: float = 1.5, b: float = 0.75) -> Column:
    n = F.col("n")
    return F.col("idf") * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("dl") / average))


def bm25_index(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id_col, weight): an inverted index whose weights only need summing over query tokens."""
    counts, idf, average = bm25_terms(chunks, id_col, text_col)
    return counts.join(idf, "token").select("token", id_col, bm25_weight(average).alias("weight"))


def bm25_top(questions: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", k: int = 10) -> DataFrame:
    """(query_id, id_col, score, rank): the k best chunks of each question, those with a positive score.

    Only tokens that are asked for leave the rows of the chunks.
    """
    counts, idf, average = bm25_terms(chunks, id_col, text_col)
    asked = term_counts(questions, "query_id", "question").withColumnRenamed("n", "m").join(idf, "token")
    scored = counts.join(asked, "token").groupBy("query_id", id_col).agg(F.round(F.sum(F.col("m") * bm25_weight(average)), 8).alias("score"))
    return top(scored, "query_id", k, F.desc("score"), F.asc(id_col)).where("score > 0")


def scopes(allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((query_id, scope), (scope, document_id)): queries that may see the same documents share a scope, so its statistics are taken once.

    Sets are told apart by their size and two sums of hashes; ``allowed`` has (query_id, document_id).
    """
    allowed = allowed.select("query_id", "document_id").distinct()
    sums = [F.sum(F.xxhash64("document_id", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    named = allowed.groupBy("query_id").agg(F.count("*").alias("n"), *sums)
    named = cut(named.select("query_id", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "s1", "s2")))).alias("scope")))
    first = named.groupBy("scope").agg(F.min("query_id").alias("query_id"))
    return named, allowed.join(first, "query_id").select("scope", "document_id")


def bm25_scoped(questions: DataFrame, chunks: DataFrame, allowed: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each question within its documents, those with a positive score.

    The number of chunks, their mean length, document frequencies and the mean idf that replaces negative ones are those of the scope.
    ``chunks`` has (chunk_id, document_id, content), ``allowed`` (query_id, document_id); a question without documents finds nothing.
    Statistics are first summed up by document, then by scope; only tokens that are asked for meet the chunks.
    """
    named, members = scopes(allowed)
    members = cut(members)
    whole = chunks.select(F.struct("document_id", "chunk_id").alias("at"), X.tokens(F.col("content")).alias("tokens"))

    def work(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        row, (token, n) = _counts(tokens)
        return row, [token, n, pa.array(np.diff(tokens.offsets.to_numpy()).astype(np.int64)[row])]

    counts = cut(_by_row(whole, "at", "token string, n long, dl long", work).select("at.document_id", "at.chunk_id", "token", "n", "dl"))
    sizes = chunks.groupBy("document_id").agg(F.count("*").alias("chunks")).join(counts.groupBy("document_id").agg(F.sum("n").alias("words")), "document_id", "left").na.fill(0, ["words"])
    totals = members.join(sizes, "document_id").groupBy("scope").agg(F.sum("chunks").alias("docs"), F.sum("words").alias("words"))
    df = counts.groupBy("document_id", "token").agg(F.count("*").alias("df"))
    raw = members.join(df, "document_id").groupBy("scope", "token").agg(F.sum("df").alias("df")).join(totals, "scope")
    raw = cut(raw.withColumn("idf", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.groupBy("scope").agg(F.avg("idf").alias("mean"))
    asked = term_counts(questions, "query_id", "question").withColumnRenamed("n", "m").join(named, "query_id")
    idf = raw.join(asked.select("scope", "token").distinct(), ["scope", "token"]).join(mean, "scope")
    idf = idf.select("scope", "token", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf")).alias("idf"), (F.col("words") / F.greatest(F.col("docs"), F.lit(1))).alias("average"))
    weight = F.col("idf") * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("dl") / F.col("average")))
    inside = counts.join(asked.select("token").distinct(), "token", "left_semi").join(members, "document_id").join(idf, ["scope", "token"])
    scored = inside.select("scope", "token", "chunk_id", weight.alias("w")).join(asked, ["scope", "token"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("m") * F.col("w")), 8).alias("score"))
    return top(scored, "query_id", k, F.desc("score"), F.asc("chunk_id")).where("score > 0")


def extractive_summary(docs: DataFrame, id_col: str, text_col: str, limit: int, ends: str = LATIN_ENDS) -> DataFrame:
    """(id_col, summary, source_length): the sentences of the most frequent words in their order, cut to ``limit`` characters.

    Each document is worked out in its row; only the places of the chosen sentences are found in Python.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(id_col, X.strip(F.col(text_col)).alias("text")).withColumn("parts", F.when(F.length("text") > limit, X.sentences(F.col("text"), ends)))
    base = base.withColumn("tokens", F.transform("parts", lambda s: X.tokens(s)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int32), lists.flatten())
            total = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            own = np.repeat(np.arange(len(lists)), total)
            c = Coded(lists.flatten())
            doc = own[c.row]
            keys, of, n = np.unique(doc * c.n + c.codes, return_inverse=True, return_counts=True)
            most = np.zeros(len(lists), dtype=np.int64)
            np.maximum.at(most, keys // c.n, n)
            size = np.bincount(c.row, minlength=len(own))
            word = np.bincount(c.row, weights=n[of] / most[doc], minlength=len(own)) / np.maximum(size, 1)
            i = np.arange(len(own)) - (np.cumsum(total) - total)[own]
            long = pc.list_flatten(batch.column("sizes")).to_numpy(zero_copy_only=False) > 320 if len(own) else np.empty(0, dtype=bool)
            score = np.round(word + 0.15 * (1 - i / np.maximum(total[own], 1)) - 0.05 * long, 9)
            good = np.flatnonzero((size > 0) & (total[own] > 1))
            order = good[np.lexsort((i[good], -score[good], own[good]))]
            first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)) if len(order) else order
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            take = np.maximum(2, np.minimum(total, limit // 90 + 1))[own[order]]
            chosen = np.sort(order[place < take])
            ends_ = np.append(0, np.cumsum(np.bincount(own[chosen], minlength=len(lists)))).astype(np.int32)
            best = pa.ListArray.from_arrays(ends_, pa.array(i[chosen].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("text"), batch.column("parts"), best], names=[id_col, "text", "parts", "best"])

    sized = base.withColumn("sizes", F.transform("parts", lambda s: F.length(s)))
    made = sized.mapInArrow(choose, f"{id_col} {kind}, text string, parts array<string>, best array<int>")
    ended = lambda s: F.when(s.rlike("[。！？.!?]$"), s).otherwise(F.concat(s, F.lit("。")))
    summary = X.strip(F.array_join(F.transform("best", lambda i: ended(F.get("parts", i))), ""))
    tail = lambda c: F.concat(X.sub(F.left(c, F.lit(limit)), "[，,；;。.!? ]+$", ""), F.lit("..."))
    text = F.col("text")
    cut_ = F.when(F.length(text) <= limit, text).when(F.size("best") == 0, tail(text)).when(F.length(summary) > limit, tail(summary)).otherwise(summary)
    return made.select(id_col, cut_.alias("summary"), F.length(text).alias("source_length"))


def evidence_score(question: Column, heading: Column, content: Column, section: Column, fallback: Column, size: int = 360) -> Column:
    """Score of a candidate block: lengths of shared terms, headings one and a half times, penalties and question bonuses."""
    asked, inside, above = X.query_terms(question), X.query_terms(content), X.query_terms(heading)
    weigh = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    male, female = F.contains(content, F.lit("男")), F.contains(content, F.lit("女"))
    gender = (F.contains(question, F.lit("男")) & F.contains(question, F.lit("女"))) | F.contains(question, F.lit("男女"))
    early = fallback & X.any_in(question, X.EARLY_MARKERS)
    quantity = X.any_in(question, X.QUANTITY_MARKERS) & content.rlike("[0-9一二三四五六七八九十两百千]+")
    return (
        weigh(F.array_intersect(asked, inside)) + 1.5 * weigh(F.array_intersect(asked, above)) - F.greatest(F.lit(0), F.length(content) - size) * 0.01
        - F.when(X.is_low_information(content), 5.0).otherwise(0.0) + F.when(early, F.greatest(F.lit(0), 8 - section * 3)).otherwise(0)
        + F.when(gender & male & female, 8).when(gender & (male | female), 2).otherwise(0) + F.when(quantity, 2).otherwise(0)
    )
