"""Evidence resolution, preferences, selection and rendering."""

import pytest

from folio.operators import datasets as D
from folio.operators import evidence as V

FILES = {
    "a.md": "## One\nThe tower is three hundred metres tall.\n## Two\nBread and cheese are sold on the market here.\n## Empty\n",
    "c.md": "## 第1章 起点\n这里开始讲述故事的背景内容。\n## 第1章 起点（续1）\n有三个男生和两个女生参加了活动。\n## 第2章 旅程\n他们离开村庄，再也没有回来，男生。",
    "plain.md": "Only words without any heading stand in this file.",
    "blank.md": "  ",
}
SAMPLES = {
    1: ("How tall is the tower", ["a.md#One", "a.md#Nowhere"]), 2: ("开头有几个男女", ["c.md#无"]), 3: ("他们离开村庄", ["c.md#无"]), 4: ("他们离开村庄", ["c.md"]), 5: ("", ["a.md"]), 6: ("Nothing matches", ["a.md#Two", "plain.md"]),
    7: ("x", ["gone.md", "gone.md#One", "blank.md"]), 8: (None, []), 9: ("最初是什么情况", ["c.md#无"]),
}


@pytest.fixture(scope="module")
def tables(spark):
    lines = spark.createDataFrame([(f, k, x) for f, t in FILES.items() for k, x in enumerate(t.split("\n"))], "file_name string, line_no int, line string")
    samples = spark.createDataFrame([(i, q, i % 2 == 1, ["point"]) for i, (q, _) in SAMPLES.items()], "id long, question string, allow_no_answer boolean, points array<string>")
    references = spark.createDataFrame([(i, k, r) for i, (_, rs) in SAMPLES.items() for k, r in enumerate(rs)], "id long, ref_no int, reference string")
    return samples, references, lines


def test_evidence_of_each_kind_of_reference(tables):
    samples, references, lines = tables
    got = {r["id"]: r["evidence"] for r in V.with_evidence(samples, references, lines).collect()}
    tower, bread, plain = "[source] a.md#One\nThe tower is three hundred metres tall.", "[source] a.md#Two\nBread and cheese are sold on the market here.", "[source] plain.md#plain\nOnly words without any heading stand in this file."
    assert got[1] == f"{tower}\n\n{tower}"
    assert got[2] == "[source] c.md#第1章 起点（续1）\n有三个男生和两个女生参加了活动。"  # early, first chapter, both genders
    assert "第2章" not in got[3] and got[4] == "[source] c.md#第2章 旅程\n他们离开村庄，再也没有回来，男生。"
    assert got[5] == f"{tower}\n\n{bread}"  # a blank question takes the first two
    assert got[6] == f"{bread}\n\n{plain}"  # no shared term: the first block of each
    assert got[7] == "" and got[8] == ""
    assert got[9].startswith("[source] c.md#第1章 起点\n") and got[9].count("[source]") == 1


def test_unknown_files_are_listed(tables):
    _, references, lines = tables
    assert sorted(map(tuple, V.unknown_references(references, lines).collect())) == [(7, 0, "gone.md"), (7, 1, "gone.md#One")]


def test_training_records_hold_the_evidence(tables):
    got = {r["id"]: r for r in D.training_records(V.with_evidence(*tables)).collect()}
    assert len(got) == len(SAMPLES) and got[1]["rejectable"] and got[1]["ideal_answer"] == D.REFUSAL_ANSWER
    assert got[6]["ideal_answer"] == "根据提供的文档证据，答案包括：point。 引用：a.md#Two, plain.md。"
    assert [m["role"] for m in got[6]["messages"]] == ["system", "user", "assistant"] and got[6]["messages"][0]["content"] == D.DOCUMENT_SYSTEM
    assert got[6]["evidence"] in got[6]["messages"][1]["content"] and D.NO_EVIDENCE in got[8]["messages"][1]["content"]


def test_preferences_on_no_rows(tables):
    samples, references, lines = tables
    assert V.with_evidence(samples.limit(0), references.limit(0), lines.limit(0)).collect() == []
