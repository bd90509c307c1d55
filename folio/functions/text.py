"""Scalar text functions as Column expressions: all of them stay in whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"

# Words and patterns that results depend on.
STOPWORDS = "的 了 和 是 在 与 及 或 对 中 为 将 并 通过 以及 this that with from have has are was were for and the to of in on at by an a".split()
STOP_TERMS = "什么 哪些 是否 有没有 如何 多少 哪个 给出 材料 文档 这份 当前 通常".split()
STOP_CHARS = "的 了 是 在 和 与 及 并 个 这 那 有 上 下 中 前 后 会 能".split()
CREATIVE_WORDS = "写一首诗 诗歌 角色扮演 扮演 小说 故事 剧本 文案 润色 翻译 情书 笑话 poem roleplay story novel".split()
REFUSALS = ["未找到足够依据", "没有足够依据", "暂无足够证据", "无法从提供的文档中找到", "无法根据当前文档确定"]
EARLY_MARKERS = "开头 一开始 最初 起初 前文 最早".split()
QUANTITY_MARKERS = "几 多少 数量 共有 一共".split()
HEADING = r"^(第[一二三四五六七八九十百零\d]+[章节部分篇]|[一二三四五六七八九十]+[、.）)]|\d+(\.\d+){0,3}[、.）)])"
LIST_ITEM = r"^([-*•●▪▶]|(\d+|[A-Za-z])[.)、])"
CHAPTER = [r"^第\s*[0-9零一二三四五六七八九十百千两]+\s*[章节卷篇回部集]\s*.*$", r"^(?i:chapter|part)\s+\d+\b.*$", r"^\d+(?:\.\d+){0,2}[、.．]\s*\S.*$"]
CHAPTER_LIKE = r"^第\s*[0-9零一二三四五六七八九十百千两]+\s*[章节卷篇回部集]"


def sub(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(by))


def strip(col: Column) -> Column:
    return sub(col, r"(?U)^\s+|\s+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named. Expressions inside a lambda are otherwise worked out anew
    each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_in(col: Column, words: list[str]) -> Column:
    """Whether the text contains one of a few fixed words."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def unify_newlines(col: Column) -> Column:
    return sub(col, "\r\n?", "\n")


def normalize_document(col: Column) -> Column:
    text = sub(unify_newlines(col), "\u00a0", " ")
    text = sub(text, "[\ufeff\u200b-\u200f\u2060]", "")
    return strip(sub(sub(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_record(col: Column) -> Column:
    return strip(sub(sub(F.coalesce(col, F.lit("")), "\u3000", " "), r"(?U)\s+", " "))


def plain_body(col: Column) -> Column:
    return strip(sub(sub(sub(unify_newlines(col), "\ufeff", ""), "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def block_text(col: Column) -> Column:
    return strip(sub(sub(sub(unify_newlines(col), "\ufeff", ""), "[ \t]+", " "), "\n{3,}", "\n\n"))


def strip_inline_markdown(col: Column) -> Column:
    text = sub(sub(col, r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_`>#]+", " ")
    return sub(sub(sub(text, "[|—]", " "), r"(?U)\s+", " "), "^[- \t\r\n]+|[- \t\r\n]+$", "")


def normalize_query(col: Column) -> Column:
    return strip(sub(col, r"(?U)\s+", " "))


def embedding_text(col: Column, limit: int = 2000) -> Column:
    """Text as an embedder takes it; null for blank text. The cut is the model's input limit."""
    text = normalize_query(col)
    return F.when(text != "", F.left(text, F.lit(limit)))


def script_ratio(col: Column, script: str = HAN) -> Column:
    """Share of the characters of a script among letters and digits; 0 without any."""
    text = clean_record(col)
    meaningful = F.length(sub(text, rf"[^\p{{L}}\p{{Nd}}{HAN}]", ""))
    return F.when(meaningful == 0, F.lit(0.0)).otherwise(F.length(sub(text, f"[^{script}]", "")) / meaningful)


def is_low_information(col: Column) -> Column:
    def judge(text: Column) -> Column:
        kept = F.length(sub(text, f"[^A-Za-z0-9{HAN}]", ""))
        return let(kept, lambda n: (text == "") | (n < 6) | ((n < 10) & text.rlike("[.。·]{4,}")) | text.rlike(r"(?U)^[\W_\d\s.。·\-—_=:：/\\|]+$"))

    return let(block_text(col), judge)


def is_dropped_line(line: Column) -> Column:
    return line.rlike(r"^\d{1,4}$|^第?\s*\d+\s*页$")


def is_heading_line(line: Column) -> Column:
    return (line != "") & (F.startswith(line, F.lit("#")) | line.rlike(HEADING) | ((F.length(line) <= 28) & ~line.rlike("[。！？!?；;，,]$")))


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def is_chapter_heading(line: Column) -> Column:
    return (line != "") & ~F.contains(line, F.lit("\n")) & (F.length(line) <= 80) & reduce(lambda a, b: a | b, [line.rlike(p) for p in CHAPTER])


def heading_base(col: Column) -> Column:
    return sub(sub(strip(col), r"[（(]续\d+[）)]$", ""), r"(?U)\s+", " ")


def without_headings(col: Column) -> Column:
    kept = F.filter(F.split(col, "\n"), lambda x: ~x.rlike(r"^#{1,6}\s+"))
    return strip(F.array_join(kept, "\n"))


def sentences(col: Column, ends: str = "。！？!?；;\n") -> Column:
    """Non-empty trimmed sentences; a text without an end mark is one."""
    parts = F.transform(F.split(F.regexp_replace(col, "\r", "\n"), f"(?<=[{ends}])"), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def tokens(col: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case runs of Latin letters and digits, and bigrams of Han runs, without stop words; repeats stay."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(f"([0-9a-z]+|[{HAN}]+)"), F.lit(1))
    pieces = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(r.rlike("^[0-9a-z]"), F.array(r))
            .when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    return F.filter(pieces, lambda t: ~t.isin(stopwords))


_RUNS, _HAN, _STOP = re.compile("[0-9a-z]+|[\u4e00-\u9fff]+"), re.compile("[\u4e00-\u9fff]"), frozenset(STOPWORDS)
_LATIN = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz\n" else 32 for c in range(256))


def token_lists(text: str, ends: str = "") -> list[list[str]]:
    """``tokens`` of each piece of a text between line ends and other ``ends``, if it has any; for work in tasks that take whole texts anyway."""
    text = text.lower()
    for c in ends:
        text = text.replace(c, "\n")
    if text.isascii() or not _HAN.search(text):
        pieces = map(str.split, text.encode("ascii", "replace").translate(_LATIN).decode("ascii").split("\n"))
    else:
        pieces = ([t for r in _RUNS.findall(p) for t in ([r] if r[0] <= "z" else [r[i : i + 2] for i in range(len(r) - 1)])] for p in text.split("\n"))
    return [kept for p in pieces if (kept := [t for t in p if t not in _STOP])]


def token_set(text: str) -> set[str]:
    """The distinct ``tokens`` of a text, which no line end divides."""
    return {t for piece in token_lists(text) for t in piece}


def query_terms(col: Column) -> Column:
    """Distinct terms: Latin words of two letters or more, Han 2- and 3-grams and characters; no numbers, no stop terms."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(f"([A-Za-z0-9{HAN}]+)"), F.lit(1))
    runs = F.filter(runs, lambda t: ~t.isin(STOP_TERMS) & ~t.rlike("^[0-9]+$"))

    def grams(t: Column, n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def han(t: Column) -> Column:
        chars = F.filter(F.split(t, ""), lambda c: c.rlike(f"^[{HAN}]$") & ~c.isin(STOP_CHARS))
        whole = F.when(F.length(t) <= 8, F.array(t)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.when(F.length(t) <= 3, F.array(t)).otherwise(F.concat(grams(t, 2), grams(t, 3))), chars, whole)

    terms = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"[{HAN}]"), han(t)).when(F.length(t) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))))
    return F.filter(F.array_distinct(terms), lambda t: (t != "") & ~t.isin(STOP_TERMS))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two term arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def slug(col: Column) -> Column:
    text = sub(sub(F.when(strip(col) == "", F.lit("document")).otherwise(strip(col)), f"[^0-9A-Za-z{HAN}_-]+", "_"), "^_+|_+$", "")
    return F.when(text == "", F.lit("document")).otherwise(text)


def answer_points(col: Column, most: int = 4) -> Column:
    """Bulleted or numbered lines, or else sentences of four characters or more; at most 80 characters each, the first few distinct."""
    lines = F.filter(F.transform(F.split(col, "\n"), strip), lambda x: (x != "") & ~x.rlike("^(```|~~~)"))
    bullets = F.filter(lines, lambda x: x.rlike(r"^[-*+]\s+|^\d+[.)、]\s*"))
    bullets = F.filter(F.transform(bullets, lambda x: strip_inline_markdown(sub(x, r"^([-*+]|\d+[.)、])\s*", ""))), lambda x: x != "")
    parts = F.filter(F.transform(F.split(col, "[。！？；;\n]"), strip_inline_markdown), lambda x: F.length(x) >= 4)
    chosen = F.when(F.size(bullets) > 0, bullets).otherwise(parts)
    cut = F.transform(chosen, lambda x: F.when(F.length(x) > 80, sub(F.left(x, F.lit(80)), "[，,;；:： ]+$", "")).otherwise(x))
    return F.slice(F.array_distinct(F.filter(cut, lambda x: x != "")), 1, most)
