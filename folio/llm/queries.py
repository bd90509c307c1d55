"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.decontaminate import mark_contaminated
from folio.llm.filter_audit import interactions, mask_counts
from folio.llm.fingerprint import edited_fingerprints
from folio.llm.html_extract import extract_pages
from folio.llm.lang_id import fit, held_out, predict
from folio.llm.lexicon import encode
from folio.llm.near_dedup import near_duplicates
from folio.llm.packing import pack
from folio.llm.pii import replace_entities
from folio.llm.prefix_trie import ends, ends_digest, peel_prefixes, prefix_paths, turns
from folio.llm.sharding import kd_shards
from folio.llm.store import cut, read
from folio.llm.token_store import new_store, read_tokens, write_tokens
from folio.llm.url_filter import ADDRESS, SECOND, judge_urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: For the synthetic tables only; real data needs its own under spark.folio.pii.key.
DEMO_KEY = b"replace-me-by-a-secret"


def pii_key(spark: SparkSession) -> bytes:
    named = spark.conf.get("spark.folio.pii.key", None)
    return named.encode() if named else DEMO_KEY


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_store(spark)
    write_tokens(read(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_entities(read(spark, sf_dir, "documents"), pii_key(spark), report=True)
    return done.select("doc_id", "text", "n_entities", F.array_join("entity_types", ",").alias("entity_types"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(read(spark, sf_dir, "documents"), shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return judge_urls(read(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, size=1024)


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), fine=60)
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.edits")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"), decoded_col="decoded").drop("text")
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return done.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    paths = cut(prefix_paths(turns(read(spark, sf_dir, "conversations")), base=conv - conv % 5, shared=F.crc32(conv.cast("string").cast("binary")) % 9))
    nodes = peel_prefixes(paths).join(ends_digest(ends(paths)), "key", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(bytearray()), 256))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_html_extract, op2_near_dedup, op3_token_store, op4_pii_surrogates, op5_kd_shards, op6_url_filter, op7_pack_histogram, op8_bottom_k, op9_decontaminate, op10_language_id, op11_bpe_lexicon, op12_filter_audit, op13_prefix_trie)
    }


_SECOND = SECOND.replace("'", "''")
_NAME = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\\.+$', '')"
_UNDER = f"CASE WHEN regexp_matches({_NAME}, '{ADDRESS}') THEN {_NAME} ELSE array_to_string(string_split({_NAME}, '.')[-({{n}} + regexp_matches({_NAME}, '{_SECOND}')::INT):], '.') END"


def _strength_sql(units: str, key: str) -> str:
    """The prior's strength by parent, as in ``_strength``."""
    return f"""(SELECT {key}, k, greatest(2.0, least(200.0, CASE WHEN v > 0 AND wi > 0 THEN wi / v - 1 ELSE 200.0 END)) AS strength, pn, pbad FROM (
  SELECT *, (ss - pn * m * m - (k - 1) * wi) / nullif(pn - nn / pn, 0) AS v FROM (SELECT *, m * (1 - m) AS wi FROM (SELECT *, pbad / pn AS m FROM (
    SELECT {key}, sum(n) AS pn, sum(bad) AS pbad, count(*) AS k, sum(n * (bad / n) * (bad / n)) AS ss, sum(n::DOUBLE * n) AS nn FROM {units} GROUP BY ALL)))))"""


def _post_sql(alone: bool = True) -> str:
    mean, weight = "(u.bad + strength * prior) / (u.n + strength)", "u.n + strength"
    return f"CASE WHEN k = 1 THEN prior ELSE {mean} END AS mean, CASE WHEN k = 1 THEN prior_weight ELSE {weight} END AS weight" if alone else f"{mean} AS mean, {weight} AS weight"


_RULES_SQL = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{{k}}}" for k, (_, r) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1]))
)
_Y = NormalDist().inv_cdf(0.95)
OP6_SQL = rf"""WITH ps AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
oc AS (SELECT doc_id AS page_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels GROUP BY ALL),
h0 AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS bad FROM ps JOIN oc USING (page_id) WHERE host <> '' GROUP BY ALL),
hs AS (SELECT *, {_UNDER.format(n=2)} AS domain, {_UNDER.format(n=1)} AS suffix FROM h0),
ds AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hs GROUP BY ALL), ss AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM ds GROUP BY ALL),
t AS (SELECT strength, (pbad + 1) / (pn + 2) AS prior FROM {_strength_sql("ss", "1 AS one")}),
bs AS (SELECT suffix, {_post_sql(False)} FROM ss u, t),
bd AS (SELECT domain, {_post_sql()} FROM ds u JOIN (SELECT suffix, mean AS prior, weight AS prior_weight FROM bs) USING (suffix) JOIN {_strength_sql("ds", "suffix")} USING (suffix)),
bh AS (SELECT host, {_post_sql()} FROM hs u JOIN (SELECT domain, mean AS prior, weight AS prior_weight FROM bd) USING (domain) JOIN {_strength_sql("hs", "domain")} USING (domain)),
q1 AS (SELECT *, mean * weight AS a, (1 - mean) * weight AS b FROM bh),
q2 AS (SELECT *, CASE WHEN a >= 1 AND b >= 1 THEN 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) END AS h, ({_Y}::DOUBLE * {_Y}::DOUBLE - 3) / 6 AS lam, exp(a * ln(a / (a + b))) / a AS lo, exp(b * ln(b / (a + b))) / b AS hi FROM q1),
kn AS (SELECT host, CASE WHEN a >= 1 AND b >= 1 THEN a / (a + b * exp(2 * ({_Y}::DOUBLE * sqrt(lam + h) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (lam + 5.0::DOUBLE / 6 - 2 / (3 * h)))))
  WHEN 0.05 < lo / (lo + hi) THEN pow(a * (lo + hi) * 0.05, 1 / a) ELSE 1 - pow(b * (lo + hi) * 0.95, 1 / b) END AS bound FROM q2)
SELECT page_id, host, path, CASE {_RULES_SQL.format(*(f"'{r}'" for _, r in RULES))} END AS rule,
CASE {_RULES_SQL.format(*(f"'{v}'" for v, _ in RULES))} WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ps LEFT JOIN kn USING (host)"""


_ORDERS = " CROSS JOIN ".join(f"(VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v{k}(c{k})" for k in range(5))
OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY ALL),
f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, (a::INT + b::INT + c::INT + d::INT + e::INT) AS many, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT c0 || c1 || c2 || c3 || c4 AS filter_order FROM {_ORDERS} WHERE len(list_distinct([c0, c1, c2, c3, c4])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, many, fails[filter_order[step]] AS bad, list_bool_or([fails[filter_order[i]] AND i < step for i in [1, 2, 3, 4, 5]]) AS gone FROM m CROSS JOIN o CROSS JOIN range(1, 6) r(step)),
r AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bad AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


#: CRC-32 of the decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda s, k: xor(s // 2, CASE WHEN s % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
OP13_SQL = f"""WITH c AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
h AS (SELECT c, own, {_CRC} % 9 AS h FROM c),
p AS (SELECT h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN c b ON b.c = h.c - h.c % 5),
m AS (SELECT c, d, path[1:d] AS node, path[1:d - 1] AS parent, len(path) = d AS ended, CASE WHEN d > 0 THEN strlen(path[d].t) ELSE 0 END AS size FROM p, unnest(range(0, len(path) + 1)) u(d)),
n AS (SELECT d, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ids FROM m GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, node)),
u AS (SELECT e AS d, node[1:e] AS node, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM w, unnest(range(0, w.d + 1)) x(e) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN u USING (d, node) LEFT JOIN n q ON q.d = w.d - 1 AND q.node = w.parent AND w.d > 0"""


def oracle_sql() -> dict[str, str]:
    return {"op13_prefix_trie": OP13_SQL, "op6_url_filter": OP6_SQL, "op12_filter_audit": OP12_SQL}
