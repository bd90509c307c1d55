"""Lexicon encoding, filter audit and prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folio.llm")

from folio.llm import filter_audit, lexicon, prefix_trie, queries
from folio.llm.textops import utf8

WORDS = queries.tokenizer("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "", "a" * 5000, "ab" * 300, "Σίσυφος ΣΊΣΥΦΟΣ", "İstanbul ǅ ß ﬁ", "a b　c", "x<|endoftext|>y <|STARTOFTEXT|> <|endoftext|>z", "é e ́x", "don't we'll I'M 'S 12345", "你好 世界abc",
    "😀👩‍👩‍👧 🇩🇪", "\x1c\x1d a\x85b c\n\r\t ", "zero​width", "नमस्ते दुनिया", "مرحبا", "\x00\x01 �", "q" * 49 + " " + "word" * 13,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def odd_texts(n=1500):
    rng = random.Random(1)
    letters = "aAbBéÉßΣς'’ .,;:\t\n  中国🙂0١२<|>endoftext́ͅǅİ"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def compiled(tmp_path, words):
    by_bytes = sorted({w.encode() for w in words})
    made = lexicon.compile_lexicon(by_bytes, lexicon.Cutter(WORDS)([w.decode() for w in by_bytes]))
    (tmp_path / "lexicon.bin").write_bytes(lexicon.dump(made))
    return by_bytes, lexicon.Lexicon(str(tmp_path / "lexicon.bin"))


def test_automaton_is_minimal_and_ranks_its_words(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    by_bytes, lex = compiled(tmp_path, words)
    raw, at = utf8(pa.array([w.decode() for w in by_bytes]))
    assert lex.find(raw, at[:-1], at[1:]).tolist() == list(range(len(by_bytes)))
    tails = {frozenset(w[len(p) :] for w in by_bytes if w.startswith(p)) for w in by_bytes for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lex.first) == len(tails)  # one state per set of continuations
    others = ["".join(rng.choice("abcéx") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    raw, at = utf8(pa.array(others))
    assert [r >= 0 for r in lex.find(raw, at[:-1], at[1:])] == [w in words for w in others]
    assert compiled(tmp_path, [])[1].find(raw, at[:-1], at[1:]).tolist() == [-1] * len(others)


@pytest.mark.parametrize("known", [[], ["a", "the", "don't", "Σίσυφος", "word" * 13, "abc,"]])
def test_lexicon_encoder_equals_the_library(tmp_path, library, known):
    code = lexicon.LexiconEncoder(WORDS, compiled(tmp_path, known)[1], memory=300)
    for texts in (odd_texts(), [None, *odd_texts()[::-1]]):
        for text, got in zip(texts, code(texts), strict=True):
            assert np.frombuffer(got, code.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_merging_in_step_equals_merging_alone(library):
    merges = lexicon.Merges(WORDS)
    rng = random.Random(3)
    words = [merges.start("".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, 40)))) for _ in range(400)]
    assert merges.together(words) == [merges.alone(w) for w in words]
    assert merges.together([]) == []


def test_lexicon_table(spark, library):
    rows = [(k, t, None, None, None) for k, t in enumerate(odd_texts(200))] + [(3, None, "en", None, None), (None, "The same", "en", None, 1), (None, "The same", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("a b:c", F.lit(2))
    coded = lexicon.encode(docs, WORDS, most=50, decoded_col="said")
    done = lexicon.decode(coded, WORDS)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "a b:c", "ids", "said", "decoded"]
    got = done.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == r["said"] == library.decode(want, skip_special_tokens=False)
    assert lexicon.encode(docs.limit(0), WORDS).collect() == []
    assert lexicon.decode(spark.createDataFrame([(None,)], "ids binary"), WORDS).first()["decoded"] == ""


def test_words_are_counted_over_all_texts(spark, data, monkeypatch):
    monkeypatch.setattr(lexicon, "COUNTED", 50)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = Counter(w for r in docs.collect() for w in (r["text"] or "").split())
    assert {r["word"]: r["n"] for r in lexicon.count_words(docs).collect()} == dict(want)
    some = lexicon.frequent_words(docs, 40)
    assert 0 < len(some) <= 40 and min(want[w] for w in some) >= max(n for w, n in want.items() if w not in set(some))
    assert lexicon.frequent_words(docs.limit(0), 10) == []


def plain_audit(docs, labels):
    first, good, toxic, rows = {}, set(), set(), []
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, q, t in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if t == 1 else set()
    for d, text, part in docs:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and d > first[text],
        }
        rows.append((part or "", {k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out, removed_by = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [r for r in own if f in r[1] and not r[1] & set(order[:k])]
                removed_by[part, f] += len(here)
                out[part, order, k + 1] = [
                    sum(not r[1] & set(order[: k + 1]) for r in own), len(here), sum(f in r[1] and bool(r[1] & set(order[:k])) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
    return {(p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit_equals_a_plain_version(spark):
    long = " ".join(f"w{k}" for k in range(120))
    docs = [
        (1, long, "en"), (2, long, "fr"), (2, long, "en"), (3, long + " #", None), (4, None, ""), (5, "", "en"), (None, long, "en"), (None, "alone", "en"), (None, "alone", "en"), (6, "WORD " * 120, "en"), (7, "WORD " * 120, "en"),
        (8, "\t\n", "en"), (9, "x" * 100_000, "de"), (10, "a\x0bb\x0cc \x1cd", "de"), (11, long.upper(), "en"), (11, "other", "en"), (12, "Σ" * 50, "el"), (0, "", "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, 0, 1), (7, None, 1), (None, 1, 1), (11, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(7)).withColumn("id", F.lit(0))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    got = [tuple(r) for r in filter_audit.interactions(filter_audit.mask_counts(table, marks)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(docs, labels)
    assert filter_audit.interactions(filter_audit.mask_counts(table.limit(0), marks.limit(0))).collect() == []
    assert {r[4:6] for r in map(tuple, filter_audit.interactions(filter_audit.mask_counts(table, marks.limit(0))).select("part", "filter_order", "step", "kept", "good_lost", "toxic_lost").collect())} == {(0, 0)}


@pytest.mark.parametrize("most_segments", [1, 64])
def test_sketch_clears_no_repeat(spark, most_segments):
    hashes = spark.range(20_000).select(F.xxhash64(F.expr("id % 19000")).alias("hash")).repartition(5)
    sketch = filter_audit.RepeatSketch(hashes, "hash", most_segments)
    judged = hashes.withColumn("maybe", sketch.may_repeat(F.col("hash"))).groupBy("hash").agg(F.count("*").alias("n"), F.min("maybe").alias("maybe")).collect()
    assert all(r["maybe"] for r in judged if r["n"] > 1)
    assert most_segments == 1 or sum(r["maybe"] for r in judged if r["n"] == 1) < 0.03 * len(judged)


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = [t[2:] for t in sorted(own.get(c - c % 5, []))][:h]
        paths[c] = first + [t[2:] for t in sorted(own[c])][h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ç", "", None])) for c in range(120) for t in range(rng.randrange(0, 7))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # a common conversation
    rows += [(300, t, "user", f"deep {t}") for t in range(60)] + [(305, t, "user", f"deep {t}") for t in range(59)]
    return rows + [(400, None, "user", "null first"), (400, 0, "user", "x"), (400, 0, "user", "x"), (None, 0, "user", "lost"), (401, 1, None, None)]


@pytest.mark.parametrize("group", [1, 8, 256])
def test_prefix_trie_equals_a_plain_version(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "ROWS", 10)
    monkeypatch.setattr(queries, "peel_prefixes", lambda paths: prefix_trie.peel_prefixes(paths, group))
    rows = trie_rows(group)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("base", F.lit(2)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "no conversation")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_prefix_trie"])
def test_query_equals_its_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=repr)
