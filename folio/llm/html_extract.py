"""Main text of web pages by union-free wrapper inference per host.

1. Each page becomes a tree of structural elements that hold text; its token stream folds into a skeleton in which runs of
   alike neighbours are one repeated group. Pages of a host with the same skeleton count once.
2. A host's skeletons are aligned: alike elements merge, elements that only one side has become optional, runs of different
   length become repeated groups, and text becomes a slot. The result is the host's wrapper, a regular expression without
   unions. Skeletons are merged in rounds of bounded fan-in, so no task needs all skeletons of a hot host.
3. Every skeleton is matched against its host's wrapper, and what fills each slot is summed up over the host's pages (pages,
   characters, characters in links, same text everywhere or not).
4. The wrapper's element that holds most of the weighted text is the main one; all its slots are kept, but for parts of it that
   are marked as something else. Names only weigh: no name on an element around the main text counts, and none empties a page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import cut, join_sized, shared_dir, small_batches
from folio.llm.textops import chunks
from folio.llm.url_filter import host_of

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|</?[a-zA-Z](?>[^>"']+|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<""",
    re.S,
)
#: Elements whose content is no text of the page, up to their end tag. Only the first two run to the end of the page without one.
RAW = {x: re.compile(f"</{x}(?=[\\s/>])[^>]*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "math")}
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARKS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements inside a line of text: they neither part blocks nor count as structure.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr img input br meta link base source track embed param area col".split())
#: An element of the key closes open elements of the value when it starts.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements and words in class, id or role that mark what is not main text.
ASIDE_TAGS = frozenset("nav header footer aside form menu button dialog fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toolbar toc topbar widget widgets".split()
)
#: Of these the words that also name what an article is about: as part of a word they need a second sign.
AMBIGUOUS = frozenset(
    "ad ads advertising aside banner copyright header login menu nav notice notices promo promotion related replies reply search share sharing skip social sponsor sponsored subscription tags teaser toc widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody main maincontent post story entry content".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Elements nested deeper count as their ancestor at this depth.
DEEPEST = 60
#: A wrapper with more nodes is told apart by element names alone.
MOST_NODES = 2000


@lru_cache(maxsize=20_000)
def element(tag: str) -> tuple[str, str]:
    """(name, label) of an opening tag: the label is the name with up to three words of class, id and role of at most two parts
    each, digits gone; longer words name a page rather than a part of it."""
    name = NAME.match(tag)[1].lower()
    words = {re.sub(r"\d+", "", w) for m in MARKS.finditer(tag) for w in (m[2] or m[3] or m[4] or "").split()}
    words = sorted(w.replace("/", "-") for w in words if w and (len(parts := WORDS.findall(w)) <= 2 or {x.lower() for x in parts} & (ASIDE_WORDS | MAIN_WORDS)))
    return name, f"{name}.{' '.join(words[:3])}" if words else name


def name_of(label: str) -> str:
    return label.partition(".")[0]


@lru_cache(maxsize=20_000)
def mark(label: str) -> str:
    """What the element's own name and marks say: 'tag', 'strong', 'weak' or 'faint' for aside, 'article', 'main', 'content' or ''.

    Strong marks have only aside words in one of their words, as ``cookie-notice`` or ``ad``; weak ones have some, as ``has-sidebar``; faint
    ones have some, all ambiguous, as ``share-price``.
    """
    name, _, words = label.partition(".")
    if name in ASIDE_TAGS:
        return "tag"
    said = [{x.lower() for x in WORDS.findall(w)} for w in words.split()]
    if any(s and s <= ASIDE_WORDS for s in said):
        return "strong"
    if name in ("article", "main"):
        return name
    if any(s & (ASIDE_WORDS - AMBIGUOUS) for s in said):
        return "weak"
    if any(s & ASIDE_WORDS for s in said):
        return "faint"
    return "content" if any(s & MAIN_WORDS for s in said) else ""


# A node is [label, optional, repeated, slot, children, members]; members are the numbers of a page's own blocks.


def parse(page: str) -> tuple[list, list[str], list[int]]:
    """(tree, texts, linked): the elements of a page, its blocks of text in order, references decoded and white space evened out,
    and how many characters of each stand in links."""
    root: list = []
    names: list[str] = []
    inner: list[list] = []
    owner: list[list] = []  # the node of each open element
    texts: list[str] = []
    linked: list[int] = []
    held: list[str] = []
    in_link = False
    link_chars = 0
    top = ["", False, False, False, root, []]

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            node = owner[-1] if owner else top
            node[3] = True
            node[5].append(len(texts))
            texts.append(text)
            linked.append(min(link_chars, len(text)))
        link_chars = 0

    at, unclosed = 0, set()  # names of raw elements that no end tag follows any more
    while at < len(page):
        token = TOKEN.match(page, at)[0]
        at += len(token)
        if token[0] != "<" or token == "<":
            held.append(token)
            if in_link:
                link_chars += len(token)
            continue
        if token[1] in "!?":
            continue
        name = NAME.match(token)[1].lower()
        if name in RAW:
            held.append(" ")
            if token[1] != "/" and name not in unclosed and not (name in ("svg", "math") and token.endswith("/>")):
                end = RAW[name].search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(name)
            continue
        if name in INLINE:
            if name == "a":
                in_link = token[1] != "/"
            elif name == "br" or name == "img":
                held.append(" ")
            continue
        if "-" in name and (name not in names if token[1] == "/" else token.endswith("/>") or page[at : at + len(name) + 2].lower() == f"</{name}"):
            continue  # an empty element of the page's own, as an icon
        if held:
            flush()
        if name == "html" or name == "body" or name == "hr":
            continue
        if token[1] == "/":
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                del names[k:], inner[k:], owner[k:]
            continue
        ends = CLOSES.get(name, ()) if name not in BLOCKS_CLOSE_P else ("p",)
        for k in range(len(names) - 1, -1, -1):
            if names[k] in ends:
                del names[k:], inner[k:], owner[k:]
                break
            if names[k] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                break
        if not token.endswith("/>"):
            names.append(name)
            if len(names) > DEEPEST:
                inner.append(inner[-1]), owner.append(owner[-1])
                continue
            node = [element(token)[1], False, False, False, [], []]
            (inner[-1] if inner else root).append(node)
            inner.append(node[4]), owner.append(node)
    flush()
    if top[3]:
        root.insert(0, ["", False, False, True, [], top[5]])  # text outside all elements
    return root, texts, linked


def skeleton(tree: list) -> list:
    """The folded tree of the elements that hold text."""
    out = []
    for label, _, _, slot, inner, members in tree:
        below = skeleton(inner)
        if slot or below:
            out.append([label, False, False, slot, below, members])
    return fold(out)


def alike(a: list, b: list) -> bool:
    """Whether neighbours are items of one group: the same label, and inside something in common, if there is anything."""
    return a[0] == b[0] and (not a[4] and not b[4] or bool({n[0] for n in a[4]} & {n[0] for n in b[4]}))


def fold(nodes: list) -> list:
    """Neighbours that are alike become a repeated group; so do neighbouring pairs and triples."""
    out: list = []
    for node in nodes:
        out.append(node)
        for size in (1, 2, 3):
            if len(out) >= 2 * size and all(map(alike, out[-2 * size : -size], out[-size:])):
                out[-2 * size :] = [unite(a, b, True) for a, b in zip(out[-2 * size : -size], out[-size:], strict=True)]
                break
    return out


def unite(a: list, b: list, repeated: bool = False) -> list:
    return [a[0], a[1] and b[1] if repeated else a[1] or b[1], repeated or a[2] or b[2], a[3] or b[3], align(a[4], b[4]), a[5] + b[5]]


def likeness(a: list, b: list) -> float:
    if a[0] != b[0] and not (name_of(a[0]) == name_of(b[0]) and b[0] in (name_of(b[0]), a[0])):
        return 0.0
    x, y = {n[0] for n in a[4]}, {n[0] for n in b[4]}
    return (1.0 if a[0] == b[0] else 0.5) + (len(x & y) / len(x | y) if x or y else 1.0)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Positions matched in order by the best alignment of two lists of nodes."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [(k, k) for k in range(len(a))]
    if len(a) * len(b) > 40_000:
        found = SequenceMatcher(None, [n[0] for n in a], [n[0] for n in b], autojunk=False).get_matching_blocks()
        return [(m.a + k, m.b + k) for m in found for k in range(m.size)]
    best = np.zeros((len(a) + 1, len(b) + 1))
    like = [[likeness(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = max(best[i + 1, j], best[i, j + 1], best[i + 1, j + 1] + like[i][j] if like[i][j] else 0)
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if like[i][j] and best[i, j] == best[i + 1, j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """Align two wrappers: matched elements merge, the others become optional."""
    if not a or not b:
        return [[n[0], True, *n[2:]] for n in a or b]
    out: list = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [[n[0], True, *n[2:]] for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(unite(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def coarse(nodes: list) -> list:
    """The wrapper with elements told apart by name alone, if it has grown too large."""
    if sum(1 for _ in walk(nodes)) <= MOST_NODES:
        return nodes
    bare = lambda ns: fold([[name_of(n[0]), *n[1:4], bare(n[4]), n[5]] for n in ns])
    return bare(nodes)


def walk(nodes: list, above: tuple = ()) -> Iterator[tuple[list, tuple]]:
    """(node, its ancestors' labels) in page order."""
    for n in nodes:
        yield n, above
        yield from walk(n[4], (*above, n[0]))


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tags and text slots (#)."""
    parts = []
    for label, optional, repeated, slot, inner, _ in nodes:
        body = f"<{label}>{'#' if slot else ''}{expression(inner)}</>"
        parts.append(f"({body}){'*' if optional and repeated else '?' if optional else '+'}" if optional or repeated else body)
    return "".join(parts)


def to_text(nodes: list) -> str:
    bare = lambda ns: [[n[0], int(n[1]), int(n[2]), int(n[3]), bare(n[4])] for n in ns]
    return json.dumps(bare(nodes), separators=(",", ":"), ensure_ascii=False)


def from_text(text: str) -> list:
    full = lambda ns: [[n[0], bool(n[1]), bool(n[2]), bool(n[3]), full(n[4]), []] for n in ns]
    return full(json.loads(text))


def place(nodes: list, wrapper: list) -> list[int]:
    """For each node of a skeleton, in page order, the number of the wrapper's node that it matches, -1 if none."""
    numbers = {id(n): k for k, (n, _) in enumerate(walk(wrapper))}
    out: list[int] = []

    def down(own: list, theirs: list) -> None:
        found = dict(matches(own, theirs))
        for k, node in enumerate(own):
            if k in found:
                other = theirs[found[k]]
            else:  # one more item of a repeated group
                other = max(theirs, key=lambda t: likeness(node, t), default=None)
                other = other if other is not None and likeness(node, other) else None
            out.append(-1 if other is None else numbers[id(other)])
            down(node[4], other[4] if other is not None else [])

    down(nodes, wrapper)
    return out


def main_nodes(wrapper: list, sums: dict[int, tuple[int, int, int, bool]], alone: bool = False) -> list[int]:
    """The numbers of the nodes whose text is main text. ``sums``: number -> (pages, characters, in links, constant).

    Text weighs less in links, under marks of something else and where it is the same on three pages or more; more in an article
    or main element. From the top, the search goes down into the child with most of the weight until an article, an element of
    blocks, or one with a heading of its own. There every slot counts, the same on all pages or not, but for parts marked
    otherwise: elements such as ``nav``, parts with strong marks, and with weak ones unless they hold half of the text (neither if an
    article stands inside); with faint ones only if they are the same on three pages or more, or at least half links, too. With
    ``alone`` (a single page) strong marks always count, weak and faint ones never.
    """
    order = [(n, up) for n, up in walk(wrapper)]
    numbers = {id(n): k for k, (n, _) in enumerate(order)}
    weight, raw = [0.0] * len(order), [0] * len(order)
    for k, (n, up) in enumerate(order):
        pages, chars, links, constant = sums.get(k, (0, 0, 0, False))
        marks = {mark(x) for x in (*up, n[0])}
        w = max(chars - links, chars / 10)
        w *= (0.02 if "tag" in marks else 1) * (0.1 if "strong" in marks else 0.5 if marks & {"weak", "faint"} else 1) * (3 if "article" in marks else 2 if marks & {"main", "content"} else 1)
        weight[k], raw[k] = w * (0.05 if constant and pages >= 3 else 1), chars
    size = [0] * len(order)  # nodes in each subtree, itself included
    linked = [sums.get(k, (0, 0, 0, False))[2] for k in range(len(order))]
    varying = [chars if not (constant and pages >= 3) else 0 for pages, chars, _, constant in (sums.get(k, (0, 0, 0, False)) for k in range(len(order)))]
    for k in range(len(order) - 1, -1, -1):
        size[k] = 1 + sum(size[numbers[id(c)]] for c in order[k][0][4])
        weight[k] += sum(weight[numbers[id(c)]] for c in order[k][0][4])
        raw[k] += sum(raw[numbers[id(c)]] for c in order[k][0][4])
        linked[k] += sum(linked[numbers[id(c)]] for c in order[k][0][4])
        varying[k] += sum(varying[numbers[id(c)]] for c in order[k][0][4])

    def varies(k: int) -> bool:
        pages, chars, _, constant = sums.get(k, (0, 0, 0, False))
        return chars > 0 and not (constant and pages >= 3)

    def headed(nodes: list, without: list) -> bool:
        """A heading that varies, outside one child and outside parts that are marked."""
        return any(n is not without and (name_of(n[0]) in HEADINGS and varies(numbers[id(n)]) or (name_of(n[0]) == "header" or not mark(n[0])) and headed(n[4], without)) for n in nodes)

    here, nodes = None, wrapper
    while nodes:
        best = max(nodes, key=lambda n: weight[numbers[id(n)]])
        total = sum(weight[numbers[id(n)]] for n in nodes) + (weight[numbers[id(here)]] - sum(weight[numbers[id(n)]] for n in nodes) if here else 0)
        kind = mark(best[0])
        nested = any(mark(n[0]) == "article" for n, _ in walk(best[4]))
        if here and mark(here[0]) in ("article", "main") and not (nested or kind == "article"):
            break
        if not best[4] and kind not in ("article", "main") or weight[numbers[id(best)]] < 0.6 * total or kind == "tag" and name_of(best[0]) not in ("form", "fieldset", "header"):
            break
        if kind not in ("article", "main") and headed(nodes, best):
            break
        here, nodes = best, best[4]

    whole = raw[numbers[id(here)]] if here else sum(raw[numbers[id(n)]] for n in nodes)
    mass = sum(sums[k][1] for k in sums if varies(k))
    out: list[int] = []

    def take(n: list, in_header: bool = False) -> None:
        k = numbers[id(n)]
        if n is not here:
            kind = mark(n[0])
            if kind == "tag" and not (in_header := name_of(n[0]) == "header" and here is not None):
                return
            holds = any(mark(x[0]) in ("article", "main") for x, _ in walk(n[4]))
            other = kind == "weak" or kind == "faint" and (not varying[k] or 2 * linked[k] >= raw[k])
            if kind == "strong" and (alone or not holds) or other and not alone and not holds and raw[k] <= 0.5 * whole:
                return
        template = here is None and not alone and not varies(k) and mass >= 0.5 * sum(s[1] for s in sums.values())
        if n[3] and not template and (not in_header or name_of(n[0]) in HEADINGS):
            out.append(k)
        for c in n[4]:
            take(c, in_header)

    for n in [here] if here else wrapper:
        take(n)
    return out


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A written table of pages: (id, url, host, key, skeleton, slots, texts, filled, own).

    ``slots`` has the skeleton's node of each block in ``texts``, ``filled`` what stands in each node, ``own`` the nodes that count as
    main text of the page by itself.
    """
    spark = pages.sparkSession
    small_batches(spark)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
    filled_type = pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("hash", pa.int64())]))
    kinds = {"skeleton": pa.string(), "slots": ints, "texts": strings, "filled": filled_type, "own": ints}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            out: dict[str, list] = {k: [] for k in kinds}
            for page in batch.column("html").to_pylist():
                tree, texts, linked = parse(page or "")
                nodes = skeleton(tree)
                slots = [0] * len(texts)
                filled, sums = [], {}
                for k, (n, _) in enumerate(walk(nodes)):
                    if n[5]:
                        for b in n[5]:
                            slots[b] = k
                        chars, links = sum(len(texts[b]) for b in n[5]), sum(linked[b] for b in n[5])
                        filled.append({"slot": k, "chars": chars, "links": links, "hash": hash_of("\n".join(texts[b] for b in sorted(n[5])))})
                        sums[k] = (1, chars, links, False)
                for name, value in zip(kinds, (to_text(nodes), slots, texts, filled, main_nodes(nodes, sums, alone=True)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host")), *(pa.array(out[k], type=t) for k, t in kinds.items())], names=["id", "url", "host", *kinds])

    schema = f"id {dict(pages.dtypes)[id_col]}, url string, host string, skeleton string, slots array<int>, texts array<string>, filled array<struct<slot:int,chars:bigint,links:bigint,hash:bigint>>, own array<int>"
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    source.mapInArrow(run, schema).withColumn("key", F.md5("skeleton")).write.parquet(path)
    return spark.read.parquet(path)


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def merge_skeletons(kinds: DataFrame, fan_in: int = 64) -> DataFrame:
    """(host, skeleton): one wrapper for each host of ``kinds`` (host, skeleton), merged about ``fan_in`` at a time."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        made: list = []
        for k, text in enumerate(sorted(group["skeleton"])):
            made = from_text(text) if k == 0 else coarse(align(made, from_text(text)))
        return pd.DataFrame({"host": group["host"].iloc[:1], "skeleton": to_text(made)})

    now, done = kinds.select("host", "skeleton"), None
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        counted = cut(now.join(sizes, "host"))
        single, many = counted.where("n = 1").select("host", "skeleton"), counted.where("n > 1")
        done = single if done is None else done.union(single)
        if many.isEmpty():
            return done
        part = F.pmod(F.xxhash64("skeleton"), F.ceil(F.col("n") / fan_in)).alias("part")
        now = cut(many.groupBy("host", part).applyInPandas(merge, "host string, skeleton string"))


def infer_wrappers(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``read_pages``: (host, wrapper) per host, and (host, key, keep) per skeleton with its nodes that hold main text."""
    kinds = cut(seen.groupBy("host", "key").agg(F.first("skeleton").alias("skeleton")))
    wrappers = cut(merge_skeletons(kinds).withColumnRenamed("skeleton", "wrapper"))
    hosts = wrappers.count()

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lru_cache(maxsize=64)(from_text)
        for frame in frames:
            made = [place(from_text(s), load(w)) for s, w in zip(frame["skeleton"], frame["wrapper"], strict=True)]
            yield pd.DataFrame({"host": frame["host"], "key": frame["key"], "nodes": made})

    placed = cut(join_sized(kinds, wrappers, ["host"], hosts).mapInPandas(match, "host string, key string, nodes array<int>"))
    filled = seen.select("host", "key", F.explode("filled").alias("f")).groupBy("host", "key", "f.slot").agg(
        F.count("*").alias("pages"), F.sum("f.chars").alias("chars"), F.sum("f.links").alias("links"), F.min("f.hash").alias("low"), F.max("f.hash").alias("high")
    )
    by_node = filled.join(placed, ["host", "key"]).groupBy("host", F.get("nodes", F.col("slot")).alias("node")).agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), (F.min("low") == F.max("high")).alias("constant")
    )
    sums = by_node.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "chars", "links", "constant")).alias("sums"))  # at most MOST_NODES or so

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            filled = [{} if s is None else {x["node"]: (x["pages"], x["chars"], x["links"], x["constant"]) for x in s} for s in frame["sums"]]
            yield pd.DataFrame({"host": frame["host"], "main": [main_nodes(from_text(w), f) for w, f in zip(frame["wrapper"], filled, strict=True)]})

    main = wrappers.join(sums, "host", "left").mapInPandas(decide, "host string, main array<int>")
    numbered = F.transform("nodes", lambda n, i: F.when(F.array_contains("main", n), i))
    rules = join_sized(placed, main, ["host"], hosts).select("host", "key", F.filter(numbered, lambda i: i.isNotNull()).alias("keep"))
    return wrappers, rules


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every row: (id_col, url, text, n_chars).

    Null or empty html and pages without text give an empty text. Pages with a null url, or one without a host, form one
    group. Repeated rows are read each; pages of one host that say the same keep their text. Of elements with equal weight the first
    is the main one. A page that fills none of its host's main slots is judged by itself. An empty table gives an empty result.
    Other columns are not read.
    """
    seen = read_pages(pages, id_col, url_col, html_col)
    _, rules = infer_wrappers(seen)
    rules = cut(rules)
    with_rules = join_sized(seen.select("id", "url", "host", "key", "slots", "texts", "own"), rules, ["host", "key"], rules.count(), "left")
    of = lambda keep: F.transform(F.filter(F.arrays_zip("slots", "texts"), lambda b: F.array_contains(keep, b["slots"])), lambda b: b["texts"])
    chosen = with_rules.withColumn("main", of(F.coalesce("keep", F.array().cast("array<int>"))))
    text = F.array_join(F.when(F.size("main") > 0, F.col("main")).otherwise(of(F.col("own"))), "\n\n")
    return chosen.select("id", "url", text.alias("text")).select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
