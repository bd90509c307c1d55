"""Readers of single documents: delimited headers, JSON, markup without text."""

from folio.sources import corpus as S


def test_header_line(spark):
    assert S.delimited_header(spark.createDataFrame([(1, 2, 3)], ["a", " ", "b "])) == "[表头] a | b"
    assert S.delimited_header(spark.createDataFrame([(1,)], [" "])) == ""


def test_json_documents(spark):
    rows = [(1, '{"b":[1,{"c":"中"}],"a":null}'), (2, "{broken"), (3, None), (4, ""), (5, "7")]
    got = {r["i"]: (r["text"], r["error"]) for r in S.pretty_json(spark.createDataFrame(rows, "i int, j string"), "j").collect()}
    assert got[1] == ('{\n  "b": [\n    1,\n    {\n      "c": "中"\n    }\n  ],\n  "a": null\n}', None) and got[3] == (None, None) and got[5] == ("7", None)
    assert all(got[i][0] is None and got[i][1].startswith("JSONDecodeError") for i in (2, 4))


def test_markup_without_text_nodes():
    assert S.html_texts("<!-- a > b -->") == ["b -->"] and S.html_texts("<br><img src='x'>") == [] and S.html_texts("<p>a</p><!-- b > c -->") == ["a"]
