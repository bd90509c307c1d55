"""A lexical index that is written once for a snapshot of the chunks and read by the tokens that are asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators.lexical import _by_row, _counts, bm25_weight, term_counts, top
from folio.sources.store import cut

#: Most asked tokens, over all questions, that are broadcast: some 60 bytes each.
FEW = 500_000
#: Rows, and cells (question, chunk), that a task holds at once.
ROWS, CELLS = 1 << 18, 1 << 22


class LexicalIndex:
    """Postings (token, id, n, dl) and terms (token, df) in buckets by the hash of the token, sorted by token, and one row of totals.

    The empty token has one posting a chunk, so that chunks are counted, those without words too, in the pass that tokenises them.
    The totals are written last: an index that has them is whole. A frequent token's postings are spread over several files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.totals = spark.read.parquet(f"{self.path}/totals").first()
        self.id_col = self.totals["id_col"]

    @classmethod
    def build(cls, chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content", buckets: int = 64) -> LexicalIndex:
        """Writes the index of ``chunks`` (id_col, text_col); each text is tokenised once. Null texts count as chunks without words."""

        def work(tokens: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
            row, (token, n) = _counts(tokens)
            every, length = np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            row, token = np.append(row, every), pa.concat_arrays([token, pa.repeat("", len(tokens))])
            return row, [token, pa.array(np.append(n.to_numpy(), np.zeros_like(every))), pa.array(length[row])]

        path, spark = path.rstrip("/"), chunks.sparkSession
        texts = chunks.select(id_col, X.tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))
        postings = _by_row(texts, id_col, "token string, n long, dl long", work).withColumn("bucket", _bucket(buckets))
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        schema = f"{id_col} {dict(chunks.dtypes)[id_col]}, token string, n long, dl long, bucket int"
        counted = spark.read.schema(schema).parquet(f"{path}/postings").groupBy("bucket", "token").agg(F.count("*").alias("df"), F.sum("n").alias("n"))
        counted.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        terms = spark.read.schema("token string, df long, n long, bucket int").parquet(f"{path}/terms")
        docs = terms.where("token = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        sums = terms.where("token <> ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.avg(_raw_idf(docs)), F.lit(0.0)).alias("mean_idf"))
        sums.select(F.lit(docs).cast("long").alias("docs"), "words", "mean_idf", F.lit(buckets).alias("buckets"), F.lit(id_col).alias("id_col"), F.lit(schema).alias("schema")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return cls(spark, path)

    @classmethod
    def of(cls, chunks: DataFrame, path: str, **options) -> LexicalIndex:
        """The index at ``path``, built from ``chunks`` where it is not whole. The path should name the snapshot of the chunks."""
        spark = chunks.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/totals/_SUCCESS")
        whole = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
        return cls(spark, path) if whole else cls.build(chunks, path, **options)

    @property
    def average(self) -> float:
        return self.totals["words"] / max(1, self.totals["docs"]) or 1.0

    def _part(self, name: str, schema: str, buckets: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _idf(self, buckets: list[int] | None = None) -> DataFrame:
        """(bucket, token, idf); a quarter of the mean stands for a negative idf."""
        raw = self._part("terms", "token string, df long, n long, bucket int", buckets).withColumn("idf", _raw_idf(self.totals["docs"]))
        return raw.select("bucket", "token", F.when(F.col("idf") < 0, 0.25 * self.totals["mean_idf"]).otherwise(F.col("idf")).alias("idf"))

    def weights(self) -> DataFrame:
        """(token, id, weight) of all postings."""
        return self._part("postings", self.totals["schema"], None).where("token <> ''").join(self._idf(), ["bucket", "token"]).select("token", self.id_col, bm25_weight(self.average).alias("weight"))

    def top(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank): the k best chunks of each question (query_id, question), those with a positive score.

        Only the buckets of the asked tokens are read. Up to ``FEW`` asked tokens, over all questions, are sent to the tasks: the postings
        are shuffled by chunk as they are, once for all questions, and each task adds up the scores of its chunks and keeps k a question.
        More are joined by a shuffle.
        """
        asked = cut(term_counts(questions, "query_id", "question").withColumnRenamed("n", "m").withColumn("bucket", _bucket(self.totals["buckets"])))
        per = asked.groupBy("bucket").count().collect()
        buckets = sorted(r["bucket"] for r in per)
        if sum(r["count"] for r in per) <= FEW:
            scored = self._best_of_tasks(asked, buckets, k)
        else:
            wanted = self._idf(buckets).join(asked, ["bucket", "token"])
            scored = self._part("postings", self.totals["schema"], buckets).join(wanted, ["bucket", "token"])
            scored = scored.groupBy("query_id", self.id_col).agg(F.round(F.sum(F.col("m") * bm25_weight(self.average)), 8).alias("score"))
        return top(scored, "query_id", k, F.desc("score"), F.asc(self.id_col)).where("score > 0")

    def _best_of_tasks(self, asked: DataFrame, buckets: list[int], k: int) -> DataFrame:
        """(query_id, id, score): the k best chunks of each question in each task."""
        pairs = asked.select("token", "query_id", "m").toArrow().combine_chunks().sort_by("token")
        token, query = (pc.dictionary_encode(pairs.column(c).combine_chunks()) for c in ("token", "query_id"))
        starts = np.append(0, np.cumsum(np.bincount(token.indices.to_numpy(), minlength=len(token.dictionary)))).astype(np.int64)
        add = scorer(starts, query.indices.to_numpy().astype(np.int64), pairs.column("m").to_numpy().astype(np.float64), query.dictionary, self.id_col, k)
        codes = self.spark.createDataFrame(pa.table({"token": token.dictionary, "code": np.arange(len(token.dictionary), dtype=np.int64)}), "token string, code long")
        wanted = F.broadcast(self._idf(buckets).join(F.broadcast(codes), "token"))
        rows = self._part("postings", self.totals["schema"], buckets).join(wanted, ["bucket", "token"])
        rows = rows.select(self.id_col, "code", bm25_weight(self.average).alias("weight")).repartition(self.id_col).sortWithinPartitions(self.id_col)
        return rows.mapInArrow(add, f"query_id {dict(asked.dtypes)['query_id']}, {self.id_col} {dict(rows.dtypes)[self.id_col]}, score double")


def whole_ids(batches: Iterator[pa.RecordBatch], id_col: str, rows: int) -> Iterator[pa.Table]:
    """Rows that lie together by id, in tables of about ``rows`` rows that no id is cut by."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            codes = pc.dictionary_encode(table.column(id_col).combine_chunks(), null_encoding="encode").indices.to_numpy()
            ended = int(np.argmax(codes == codes[-1]))
            if ended:
                yield table.slice(0, ended)
            held, n = table.slice(ended).to_batches(), table.num_rows - ended
    if n:
        yield pa.Table.from_batches(held)


def scorer(starts: np.ndarray, query: np.ndarray, times: np.ndarray, names: pa.Array, id_col: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up weights (id, code, weight), sorted by id, by question and id, and keeps the k best of each question; ties go by id.

    The question numbers of a code, and how often each asks for it, lie in ``query`` and ``times`` from ``starts[code]`` on.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray, pa.Array] | None = None
        for table in whole_ids(batches, id_col, ROWS):
            coded = pc.dictionary_encode(table.column(id_col).combine_chunks(), null_encoding="encode")
            doc, code, weight = coded.indices.to_numpy().astype(np.int64), table.column("code").to_numpy(), table.column("weight").to_numpy()
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            size = starts[code + 1] - starts[code]
            before = np.append(np.cumsum(size) - size, size.sum())
            begin = 0
            while begin < len(first):
                end = int(np.searchsorted(before[np.append(first, len(doc))], before[first[begin]] + CELLS, "right")) - 1
                end = max(begin + 1, min(end, len(first), begin + max(1, CELLS // len(names))))
                a, b = first[begin], first[end] if end < len(first) else len(doc)
                n, width = size[a:b], end - begin
                at = np.repeat(starts[code[a:b]] - (before[a:b] - before[a]), n) + np.arange(n.sum())
                cell = query[at] * width + np.repeat(doc[a:b] - begin, n)
                score = np.round(np.bincount(cell, weights=times[at] * np.repeat(weight[a:b], n), minlength=len(names) * width), 8).reshape(len(names), width)
                least = np.partition(score, width - k, axis=1)[:, width - k, None] if width > k else 0.0
                q, d = np.nonzero((score >= least) & (score > 0))
                got = q, score[q, d], coded.dictionary.take(pa.array(begin + d))
                kept = got if kept is None else (np.append(kept[0], q), np.append(kept[1], got[1]), pa.concat_arrays([kept[2], got[2]]))
                order = np.lexsort((-kept[1], kept[0]))  # stable: ids ascend
                place = np.arange(len(order)) - np.searchsorted(kept[0][order], kept[0][order])
                order = np.sort(order[place < k])
                kept = kept[0][order], kept[1][order], kept[2].take(pa.array(order))
                begin = end
        if kept is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(kept[0])), kept[2], pa.array(kept[1])], names=["query_id", id_col, "score"])

    return add


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


def _raw_idf(docs: int) -> Column:
    return F.log(docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
