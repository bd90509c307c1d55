"""Operators without SQL against plain versions, and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import chunking as C
from folio.operators import datasets as D
from folio.operators import lexical as L
from folio.operators import similarity as M
from folio.sources import corpus as S


def naive_textrank(tokens):
    graph = defaultdict(Counter)
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + 4]:
            if a != b:
                graph[a][b] += 1
                graph[b][a] += 1
    score = dict.fromkeys(graph, 1.0)
    for _ in range(20):
        score = {w: 0.15 + 0.85 * sum(n / sum(graph[v].values()) * score[v] for v, n in near.items()) for w, near in graph.items()}
    return score


def test_textrank_equals_naive():
    rng = random.Random(3)
    tokens = [rng.choice("abcdefgh") for _ in range(200)]
    words, score, counts = L.textrank(tokens)
    want = naive_textrank(tokens)
    assert {w: round(s, 8) for w, s in zip(words, score, strict=True)} == {w: round(s, 8) for w, s in want.items()}
    assert dict(zip(words, counts, strict=True)) == Counter(tokens)
    assert L.textrank(["a", "a"]) is None


def test_blocks_in_python_equal_blocks_in_spark(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    lines = docs.select("doc_id", F.posexplode(F.split(X.normalize_document(F.col("text")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    got = defaultdict(list)
    for r in C.line_blocks(lines).orderBy("doc_id", "block_no").collect():
        got[r["doc_id"]].append(r["block"])
    for r in docs.select("doc_id", X.normalize_document(F.col("text")).alias("text")).collect():
        assert got[r["doc_id"]] == C.blocks_of(r["text"])


@pytest.mark.parametrize(("size", "overlap"), [(50, 0), (50, 10), (120, 60), (500, 50)])
def test_chunks_are_bounded_and_lose_nothing(size, overlap):
    rng = random.Random(size)
    text = "".join(rng.choice("abc defg. hij, k\n") for _ in range(3000))
    pieces = C.split_long(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    squeezed = "".join(text.split())
    at = 0
    for p in pieces:
        flat = "".join(p.split())
        found = squeezed.find(flat, max(0, at - overlap - 1))
        assert 0 <= found <= at
        at = found + len(flat)
    assert at == len(squeezed)
    blocks = [b for b in text.split("\n") if b]
    assert all(len(c) <= size for c in C.pack_with_overlap(blocks, size, overlap))
    assert C.pack_with_overlap([], size, overlap) == [] and C.split_long("", size, overlap) == []


def test_overlap_merge(spark):
    shared = "0123456789abcdefghijXYZ"
    rows = [(["left " + shared, shared + " right"],), (["one", "two"],), ([],), (["same text that is long enough", "same text that is long enough"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(C.merge_overlapping(F.col("p"))).collect()]
    assert got == [f"left {shared} right", "one\n\ntwo", "", "same text that is long enough"]


def test_length_groups(spark):
    rng = random.Random(1)
    items = ["x" * rng.randint(1, 40) for _ in range(50)]
    want, n = [], 0
    for x in items:
        if not want or n + len(x) > 60:
            want, n = [*want, []], 0
        want[-1].append(x)
        n += len(x)
    assert spark.createDataFrame([(items,)], "i array<string>").select(C.length_groups(F.col("i"), 60)).first()[0] == want


def test_candidate_blocks(spark):
    body = "First paragraph with words.\n\n......\n\nSecond paragraph with words.\n\n" + "A sentence of some length; " * 20
    got = spark.createDataFrame([(body,), ("",)], "b string").select(C.candidate_blocks(F.col("b"))).collect()
    blocks = got[0][0]
    assert blocks[0] == "First paragraph with words." and "......" not in blocks and all(len(b) <= 360 for b in blocks) and len(blocks) == len(set(blocks)) and got[1][0] == []


def test_evidence_prefers_shared_terms(spark):
    rows = [("How tall is the tower", "Tower", "The tower is 300 metres tall.", 1), ("How tall is the tower", "Food", "Bread and cheese are sold here.", 2)]
    score = L.evidence_score(F.col("q"), F.col("h"), F.col("c"), F.col("s"), F.lit(False))
    got = [r[0] for r in spark.createDataFrame(rows, "q string, h string, c string, s int").select(score).collect()]
    assert got == [4 + 2 + 3 + 5 + 1.5 * 5, 0.0]


def test_decode_and_markup(spark):
    rows = [(1, "é".encode()), (2, "中文内容".encode("gb18030")), (3, b"\xff\xfe\xfa"), (4, None), (5, b"")]
    got = {r["i"]: r["text"] for r in S.decode(spark.createDataFrame(rows, "i int, c binary"), "c").collect()}
    assert got[1] == "é" and got[2] == "中文内容" and got[3] is not None and got[4] is None and got[5] == ""
    assert S.html_texts("<p>a &amp; b</p><script>x</script> ") == ["a & b", "x"] and S.xml_texts("<a>x<b> y </b></a>") == ["x", "y"] and S.xml_texts("<a>") == ["<a>"]


def test_sequence_ratio(spark):
    got = M.sequence_ratio(spark.createDataFrame([("abcd", "bcde"), ("", "")], "a string, b string"), "a", "b").collect()
    assert [r["lexical"] for r in got] == [0.75, 1.0]


def test_split_and_repeat_sizes(spark):
    assert D.split_sizes(20) == (16, 2, 2) and D.split_sizes(5) == (5, 0, 0) and D.least_records_for(48) == 20
    rows = spark.range(2).select(F.col("id"))
    assert sorted(r["id"] for r in D.repeat_to(rows, 5).collect()) == ["0", "0__dup1", "0__dup2", "1", "1__dup1"]
    with pytest.raises(ValueError):
        D.repeat_to(rows, 7)
    with pytest.raises(ValueError):
        D.sample_exactly(rows, 3, 1)


def test_chapter_headings_make_sections(spark):
    rows = [(1, i, line) for i, line in enumerate(["preface", "第1章 大巴", "", "body one", "Chapter 2 road", "body two", "", "3. empty"])]
    got = C.heading_sections(C.paragraphs(spark.createDataFrame(rows, "doc_id int, pos int, line string"))).orderBy("section_no").collect()
    assert [(r["heading"], r["body"]) for r in got] == [("第1章 大巴", "preface\n\nbody one"), ("Chapter 2 road", "body two")]


def test_han_tokens_and_terms(spark):
    row = spark.createDataFrame([("文档检索 and BM25 的",)], "t string").select(X.tokens(F.col("t")), X.query_terms(F.lit("什么 文档检索系统 42 ab"))).first()
    assert row[0] == ["文档", "档检", "检索", "bm25"] and {"文档" not in row[1], "检索" in row[1], "ab" in row[1], "42" not in row[1]} == {True}


def test_recommendations_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    text = {i: " ".join(rng.sample(vocabulary, rng.randint(6, 12))) if i % 9 else "" for i in range(60)}
    words = {i: set(rng.sample(vocabulary, 10)) for i in range(60)}
    vec = {i: [rng.random(), rng.random() - 0.5, rng.random() - 0.5] for i in range(0, 60, 2)}
    cat = [(i, f"u{i % 2 if i < 50 else 2}", "completed" if i % 5 else "failed", (i * 7) % 20) for i in range(60)]
    want, cut = set(), 0
    for a, user, _, _ in cat:
        near = sorted((-made, b) for b, u, status, made in cat if u == user and status == "completed" and b != a)
        cut += len(near) > 8
        found = []
        for place, (_, b) in enumerate(near[:8]):
            if not text[a] or not text[b]:
                continue
            x, y = set(text[a].split()), set(text[b].split())
            semantic = len(x & y) / len(x | y)
            if a in vec and b in vec:
                dot = lambda p, q: sum(i * j for i, j in zip(p, q))
                semantic = dot(vec[a], vec[b]) / (dot(vec[a], vec[a]) * dot(vec[b], vec[b])) ** 0.5
            score = 0.75 * semantic + 0.25 * min(6, len(words[a] & words[b])) / len(words[a] | words[b])
            if score >= 0.4:
                found.append((-round(score, 4), place, b))
        want |= {(a, b, rank) for rank, (_, _, b) in enumerate(sorted(found)[:3], 1)}
    made = spark.createDataFrame(cat, "id int, user_id string, status string, created_at int")
    pairs = M.latest_candidates(made, made, 8)
    frames = [spark.createDataFrame(rows, f"id int, {kind}") for rows, kind in ((list(text.items()), "text string"), ([(i, sorted(w)) for i, w in words.items()], "words array<string>"), (list(vec.items()), "embedding array<double>"))]
    got = {(r["a"], r["b"], r["rank"]) for r in M.recommend(pairs, *frames, 0.4, 3, F.desc("created_at"), F.asc("b")).collect()}
    assert got == want and len(want) > 60 and cut


def test_recommendations_without_vectors(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "alpha beta delta"), (4, "omega"), (5, "")], "id int, text string")
    words = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["alpha", "beta"]), (3, ["alpha"])], "id int, words array<string>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [1.0, 0.0])], "id int, embedding array<double>")
    pairs = spark.createDataFrame([(1, b) for b in (2, 3, 4, 5)], "a int, b int")
    got = M.recommend(pairs, texts, words, vectors, 0.4, 3, F.asc("b")).orderBy("rank").collect()
    assert [(r["b"], r["semantic"], r["overlap"], r["similarity"]) for r in got] == [(2, 1.0, 1.0, 1.0), (4, 1.0, 0.0, 0.75), (3, 0.5, 0.5, 0.5)]


def test_tokens_jaccard_and_points_cover_all_rows(spark, data):
    from folio.plans import catalogue
    from folio.sources.views import table

    run = lambda name: catalogue.queries()[name](spark, data).collect()
    counts = {r["doc_id"]: Counter(plain_tokens(r["text"])) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {(r["doc_id"], r["token"]): r["n"] for r in run("l01_all_tokens")}
    assert got == {(d, w): n for d, c in counts.items() for w, n in c.items()} and 1 in got.values() and counts

    want = {}
    for r in table(spark, data, "f_predictions").collect():
        x, y = (set(plain_tokens(r[c])) for c in ("ideal_answer", "answer"))
        want[r["id"]] = round(len(x & y) / len(x | y), 6) if x and y else 0.0
    assert {r["id"]: r["similarity"] for r in run("l08_all_predictions")} == want and {i % 5 for i in want} == set(range(5))

    assert len(run("c13_all_chunks")) == table(spark, data, "f_chunks").count()
    texts = ["- one\n* two\n3. three\n- one\n4) four\n+ five", "First part。second one！第三部分内容；First part。fourth bit", "- only", "no end", "ab。cd", "", "x" * 79 + "，y and more"]
    points = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.answer_points(F.col("t")).alias("p")).orderBy("i").select("p").collect()]
    assert points == [["one", "two", "three", "four"], ["First part", "second one", "第三部分内容", "fourth bit"], ["only"], ["no end"], [], [], ["x" * 79]]


HAN = "\u4e00-\u9fff"


def plain_tokens(text):
    """Lower-case runs of letters and digits and bigrams of Han runs, stop words out."""
    words = []
    for w in re.findall(f"[0-9a-z]+|[{HAN}]+", text.lower()):
        words += [w] if w.isascii() or len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)]
    return [w for w in words if w not in X.STOPWORDS]


def test_live_status_of_events_that_tie(spark):
    from folio.plans.administration import live_status

    states = ["completed", "failed", "processing"]
    rows = [(b, 1, s, "2024-01-01") for b in range(6) for s in (states if b % 2 else states[::-1])]
    got = live_status(spark.createDataFrame(rows, "batch_id long, document_no int, status string, ts string").coalesce(1)).collect()
    assert {r["batch_id"]: r["live"] for r in got} == dict.fromkeys(range(6), "processing")


def test_mean_vector_has_no_negative_zero(spark, tmp_path):
    import duckdb
    import pandas as pd

    from folio.plans import catalogue

    pd.DataFrame({"vec_id": [1, 2], "embedding": [[-1e-7, 0.5, 1e-7], [-1e-7, 0.25, 1e-7]], "label": [7, 7]}).to_parquet(tmp_path / "embeddings.parquet")
    got = catalogue.queries()["m01_mean_vector"](spark, str(tmp_path)).first()["embedding"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(catalogue.oracle_sql()["m01_mean_vector"]).fetchone()[1]
    assert [str(x) for x in got] == [str(x) for x in want] == ["0.0", "0.375", "0.0"]


def test_rows_are_worked_out_some_tokens_at_a_time(spark):
    import numpy as np
    import pyarrow as pa

    def work(tokens):
        lists = tokens if not pa.types.is_list(tokens.type.value_type) else tokens.flatten()
        return np.arange(len(tokens)), [pa.array(np.full(len(tokens), len(lists.flatten())))]

    ids = spark.range(400).coalesce(1)
    flat = ids.select("id", F.array_repeat(F.lit("word"), 1000).alias("tokens"))
    nested = ids.select("id", F.array_repeat(F.array_repeat(F.lit("word"), 10), 100).alias("tokens"))
    for rows in (flat, nested):
        got = L._by_row(rows, "id", "seen long", work).collect()
        assert sorted(r["id"] for r in got) == list(range(400))
        assert 1000 <= max(r["seen"] for r in got) <= L.TOKENS
    long = spark.range(3).select("id", F.array_repeat(F.lit("word"), 100_000).alias("tokens"))
    assert [r["seen"] for r in L._by_row(long, "id", "seen long", work).collect()] == [100_000] * 3


def test_recommendations_among_the_latest_equal_those_of_pairs(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    cat = spark.range(240).selectExpr("id", "concat('u', id % 2) AS user_id", "IF(id % 5 = 0, 'failed', 'completed') AS status", "id % 17 AS created_at")
    texts = spark.range(240).select("id", F.concat(F.lit(text), F.lit(" x"), "id").alias("text"))
    words = texts.select("id", F.array(F.lit("w1"), F.concat(F.lit("x"), "id")).alias("words"))
    vectors = spark.range(0, 240, 3).select("id", F.array(F.lit(1.0), F.rand(1)).alias("embedding"))
    vectors = spark.createDataFrame(vectors.collect(), vectors.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    got = M.recommend_latest(cat, cat, texts, words, vectors, 0.4, 5, 20)
    want = M.recommend(M.latest_candidates(cat, cat, 20), texts, words, vectors, 0.4, 5, F.desc("created_at"), F.asc("b"))
    assert rows(got) == rows(want) and got.count() == 240 * 5


def plain_merge(parts, most=240, least=16):
    acc = ""
    for x in parts:
        n = next((n for n in range(min(len(acc), len(x), most), least, -1) if acc[-n:] == x[:n]), 0)
        acc = x if acc == "" else acc + x[n:] if n else acc + "\n\n" + x
    return acc


def test_merged_texts_equal_plain_ones():
    rng = random.Random(5)
    for most, least in ((240, 16), (12, 2), (6, 0)):
        for _ in range(400):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 600)))
            parts, at = [], 0
            while at < len(text):
                end = at + rng.randint(1, 80)
                parts.append(text[at:end])
                at = end - rng.randint(0, min(30, end - at - 1))
            rng.random() < 0.3 and parts.insert(rng.randint(0, len(parts)), "")
            assert C.merged(parts, most, least) == plain_merge(parts, most, least)


def test_merging_long_texts_is_no_search_of_all_of_them(spark):
    import time

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(6000)), lambda i: F.concat(F.repeat(F.lit("0123456789"), 6), i.cast("string"), F.lit(" end"))).alias("p"))
    began = time.time()
    made = rows.select(C.merge_overlapping(F.col("p")).alias("t")).first()["t"]
    assert made.count(" end") == 6001 and time.time() - began < 20


def test_whole_texts_reach_python_some_at_a_time(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("One sentence. Another one.").alias("text"))
    for make in (lambda: C.parent_child_chunks(docs), lambda: S.extract_markup(docs, "doc_id", "text", "html")):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert make().count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_matching_ratio_is_that_of_difflib():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    for k in range(300):
        words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 8))) for _ in range(30)] + ["X", "Qz7", "中文"]
        one, two = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 4 if k % 3 else 400))) for _ in "ab")
        two = one[: len(one) // 2] + two if k % 2 else two
        assert M.matching_ratio(one, two) == SequenceMatcher(None, one, two).ratio()


def test_chunks_of_a_document_are_cut_in_its_row(spark, data):
    from folio.sources.views import table

    assert "Window" not in table(spark, data, "f_chunks")._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    row = spark.range(1).select(counted(F.lit("same")).alias("x")).select(X.let(F.col("x"), lambda v: F.concat(v, v, v)).alias("y")).first()
    assert row["y"] == "samesamesame" and calls.value == 1
    said = X.is_low_information(F.col("b"))._jc.toString()
    assert said.count("{3,}") == 1, said


def test_blocks_of_long_sections_equal_plain_ones(spark):
    rng = random.Random(4)
    words = ["wort", "12345", "----", "....", "alpha beta", "。", "；", "Ünï", "a.", "\n\n", "\n", "!", "中文字符很多的一句"]
    bodies = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 500))) for _ in range(60)]

    def noise(b):
        kept = len(re.sub("[^A-Za-z0-9\u4e00-\u9fff]", "", b))
        return b == "" or bool(re.fullmatch(r"[\W_\d]+", b)) or bool(re.search("[.。·]{4,}", b)) and kept < 10 or kept < 6

    def join(items, glue):
        done, open_ = [], ""
        for x in items:
            if open_ and len(open_ + glue + x) > 360:
                done.append(open_.strip())
                open_ = x
            else:
                open_ = open_ + glue + x if open_ else x
        return done + ([open_.strip()] if open_ else [])

    def plain(body):
        text = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", body)).strip()
        raw = [b for b in map(str.strip, re.split(r"\n\s*\n+", text)) if b and not noise(b)]
        cut = lambda b: [s for s in map(str.strip, re.split("(?<=[。！？!?；;\n])", b)) if s]
        atomic = [p for b in raw for p in ([b] if len(b) <= 360 else join(cut(b), "")) if not noise(p)]
        return [b for b in dict.fromkeys(atomic + join(atomic, "\n\n")) if not noise(b)]

    got = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", C.candidate_blocks(F.col("b")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [plain(b) for b in bodies]


def test_chunks_are_not_shuffled_for_few_hits(spark):
    from folio.operators import retrieval as R

    chunks = spark.range(4000).selectExpr("concat(id, '') AS chunk_id", "id % 100 AS document_id", "CAST(id % 3 AS INT) AS parent_chunk_index", "CAST(id AS INT) AS chunk_index", "repeat('text ', 40) AS content", "1 AS page", "'text' AS type")
    hits = spark.range(5).selectExpr("id AS query_id", "concat(id * 7, '') AS chunk_id", "1.0 / (id + 1) AS score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = R.parent_context(hits, chunks, 3)
        assert "BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString() and made.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summaries_of_empty_texts_have_no_ratio(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["", " \n ", None, "short", "One sentence. Another one here. " * 30]
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["l12_summary_envelope"](spark, str(tmp_path)).orderBy("doc_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [str(tuple(r)) for r in got] == [str(r) for r in con.execute(entry.oracle_sql()["l12_summary_envelope"] + " ORDER BY doc_id").fetchall()]


def test_whole_texts_are_compared(spark):
    one, two = "a" * 8500 + "QX7 end", "b" * 9000 + "QX7 end"
    rows = spark.createDataFrame([(one, two), (one, None)], "a string, b string")
    assert [r["lexical"] for r in M.sequence_ratio(rows, "a", "b").collect()] == [2 * 7 / (len(one) + len(two)), None]


def test_matching_ratio_of_copies_moves_and_other_scripts():
    import time
    from difflib import SequenceMatcher

    rng = random.Random(4)
    for k in range(600):
        letters = rng.choice(["ab", "abcdefgh", "etaoinshrdlu XQZ79]^-", "".join(map(chr, range(0x4E00, 0x4E00 + rng.choice([5, 60, 300])))) + "\U0001f600"])
        one, two = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 350))) for _ in "ab")
        if k % 3:
            two = list(one)
            for _ in range(rng.randint(0, 12)):
                two and two.__setitem__(rng.randrange(len(two)), rng.choice(letters))
            at = rng.randint(0, len(two)) if k % 3 == 2 else 0
            two = "".join(two[at:] + two[:at])
        assert M.matching_ratio(one, two) == SequenceMatcher(None, one, two).ratio()
    long = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    began = time.time()
    assert M.matching_ratio(long, long[10_000:] + long[:10_000]) >= 0.5 and M.matching_ratio(long, long) == 1.0 and time.time() - began < 20


def test_texts_are_compared_in_one_pass(spark):
    texts = ["文档检索 and BM25 的 检索", "İstanbul Kelvin ÉTÉ bm25 the AND 中", "", None, "的 and the", "检索系统 bm25 x的y"]
    rows = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "i int, j int, a string, b string")
    want = M.sequence_ratio(rows.withColumn("semantic", X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b")))), "a", "b").drop("a", "b")
    got = M.compared(rows, "a", "b")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("MapInArrow") == 1


def test_recommendations_deal_a_user_over_parts(spark):
    rng = random.Random(6)
    n = 400
    cat = spark.createDataFrame([(i, None if i % 50 == 7 else f"u{i % 3 if i % 40 else i}", "completed" if i % 7 else "failed", rng.randint(0, 60)) for i in range(n)], "id long, user_id string, status string, created_at int")
    asked = cat.where("id % 4 > 0").select("id", "user_id")
    texts = spark.createDataFrame([(i, " ".join(rng.sample([f"w{k}" for k in range(9)], rng.randint(0, 8)))) for i in range(n)], "id long, text string")
    words = spark.createDataFrame([(i, rng.sample([f"k{k}" for k in range(8)], 5)) for i in range(n) if i % 6], "id long, words array<string>")
    vectors = spark.createDataFrame([(i, [float(i % 9 > 0) * (rng.random() - 0.3) for _ in range(3 + i % 2)]) for i in range(0, n, 3)], "id long, embedding array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    made = M.recommend_latest(asked, cat, texts, words, vectors, 0.4, 5, 20, each=10)
    want = rows(M.recommend(M.latest_candidates(asked, cat, 20), texts, words, vectors, 0.4, 5, F.desc("created_at"), F.asc("b")))
    assert rows(made) == want == rows(M.recommend_latest(asked, cat, texts, words, vectors, 0.4, 5, 20)) and len(want) > 500
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect(ta" not in plan and plan.count("MapInArrow") == 1  # pairs are scored in one pass, none is joined


def test_tokens_in_tasks_are_those_of_expressions(spark):
    texts = ["文档检索 and BM25 的 检索。中文x系统！通过文档\rKelvin İstanbul; ÉTÉ ete", "One, two.  Three?\r\nThe and to.\n\n  “Four” — five", "", None, "的", ". . .", "x中y文档"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["t"], r["s"]) for r in docs.select("id", X.tokens(F.col("text")).alias("t"), F.transform(X.sentences(F.col("text"), L.LATIN_ENDS), lambda s: X.tokens(s)).alias("s")).collect()}
    ends = L.LATIN_ENDS + "\r"
    assert all(got[i][0] == sum(X.token_lists(x), []) and [s for s in got[i][1] if s] == X.token_lists(x, ends) for i, x in enumerate(texts) if x is not None)
    made = L.tfidf_keywords(docs, "id", "text", 50)
    counts = {r["id"]: r["n"] for r in made.groupBy("id").agg(F.sum("frequency").alias("n")).collect()}
    assert counts == {i: sum(map(len, s)) for i, (_, s) in got.items() if s and any(s)}
    first = {r["keyword"]: r["score"] for r in made.where("id = 1").collect()}
    assert first["four"] == round(1 / 5 * (math.log(4 / 2) + 1), 4) == first["one"]
    assert "transform" not in made._jdf.queryExecution().optimizedPlan().toString()
