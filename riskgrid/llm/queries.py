"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import bpe, editprint, filteraudit, langid, licenses, merkle, mixing, quality, search, sharding, simhash, tokenfiles, urlfilter
from riskgrid.llm.common import read_table
from riskgrid.session import scratch_path

# The vocabulary file: on every machine of the cluster, found by the package that brings it.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links of three bits or fewer reach."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w FROM r GROUP BY source),
-- Rounds of filling: who is above its limit at the present level is full from then on.
f(k, source, s, w, full_) AS (
  SELECT 0, source, s, w, false FROM t
  UNION ALL
  SELECT k + 1, source, s, w, full_ OR 3 * s <= w * level FROM (
    SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) FILTER (WHERE full_) OVER (), 0))::DOUBLE / sum(w) FILTER (WHERE NOT full_) OVER () AS level
    FROM f) WHERE k < (SELECT count(*) FROM t)),
g AS (SELECT source, s, w, full_, (sum(s) OVER () - coalesce(sum(3 * s) FILTER (WHERE full_) OVER (), 0))::DOUBLE
             / nullif(sum(w) FILTER (WHERE NOT full_) OVER (), 0) AS level FROM f WHERE k = (SELECT count(*) FROM t)),
h AS (SELECT source, s, CASE WHEN full_ THEN (3 * s)::DOUBLE ELSE level * w END AS target FROM g),
q AS (SELECT r.*, h.s, h.target, row_number() OVER () AS row_, sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
      FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, (sent + e * s)::DOUBLE / target AS finish FROM q, range(3) AS x(e) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, key, doc_id, size, sent, e ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT row_, count(*) AS n FROM o WHERE upto <= (SELECT sum(size) FROM r) GROUP BY row_)
SELECT doc_id, size, s AS source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (row_)
"""


@query("op2_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix of all sources at weights 1, 2, 3 takes of it."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_licenses")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places of the base phrases, and the labels of all rules that hold."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    starts, own, ruled = F.col("base.start"), F.col("base.label"), F.col("detections.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.greatest(F.coalesce(F.array_max("detections.sure"), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, ruled)).alias("labels"),
        sure.alias("score"),
    )


@query("op5_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the documents that are not held out."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op6_edit_fingerprints")
def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how like it is to that and to the next document."""
    return editprint.edit_study(read_table(spark, sf_dir, "documents"))


@query("op8_shards")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 with near equal bytes, and its slot there."""
    placed = sharding.place(read_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_bpe")
def bpe_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the tokenization automaton and their decoded text, as digests."""
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path())
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(line, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids with the end id, written to a token store and read back."""
    path = scratch_path(spark, "token-store")
    tokenfiles.write_store(read_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return tokenfiles.read_store(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query("op4_quality")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by two co-trained views, learned from the labelled ones."""
    return quality.assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_topk_search")
def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, taken as a query, against all."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries, k=10)


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL_SQL = (
    r"""
WITH r(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT row_number() OVER () AS row_, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT row_, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
b AS (SELECT p.row_, max(struct_pack(n := length(r.host || r.path), labels := len(string_split(r.host, '.')), blocks := r.action = 'block',
                                     rule := r.host || r.path, action := r.action)) AS best
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row_)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.action, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ["""
    + ", ".join(f"'{w}'" for w in urlfilter.HOST_WORDS)
    + r"""]) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (row_)
"""
)


@query("op11_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under four rules, and under the list of host words where none of them fits."""
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least_ AS (SELECT text, min(doc_id) AS id FROM t GROUP BY text),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        list_concat(CASE WHEN len(words) < 100 THEN ['A'] ELSE []::VARCHAR[] END,
          CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN ['B'] ELSE []::VARCHAR[] END,
          CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN ['C'] ELSE []::VARCHAR[] END,
          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN ['D'] ELSE []::VARCHAR[] END,
          CASE WHEN t.doc_id > least_.id THEN ['E'] ELSE []::VARCHAR[] END) AS fails
      FROM t LEFT JOIN l USING (doc_id) LEFT JOIN least_ USING (text)),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
-- The step at which those who fail these filters go; 6 is never.
w AS (SELECT g.*, filter_order, list_min(list_concat([6], list_transform(fails, lambda x: instr(filter_order, x)))) AS gone FROM g, o),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
        sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant,
        sum(n) FILTER (fails = [substr(filter_order, step, 1)]) AS unique_fails,
        sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
      FROM w, range(1, 6) AS r(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM s
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, for each language."""
    return filteraudit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _manifest_sql() -> str:
    said = lambda c, v: f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')"
    leaf = lambda add: "sha256(" + " || ".join(said(c, f"{c} + {add}" if c == "n_chars" else c) for c in merkle.FIELDS) + ")"
    # One level up: neighbours in pairs, until the group has one node left.
    up = lambda key: (
        f"SELECT {key}, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {{0}} WHERE n > 1 GROUP BY {key}, lvl, i // 2, n"
    )
    return f"""
WITH RECURSIVE crc(doc_id, c) AS (
  SELECT doc_id, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: list_reduce(list_concat([xor(c, x)], list_transform(range(8), lambda k: k::BIGINT)),
      lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), 4294967295::BIGINT)
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
d AS (SELECT doc_id, lang, {leaf(0)} AS leaf, CASE WHEN xor(c, 4294967295) % 7 = 0 THEN {leaf(1)} ELSE {leaf(0)} END AS said
      FROM documents LEFT JOIN crc USING (doc_id)),
k AS (SELECT *, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes(tree, lvl, i, h, n) AS (SELECT tree, 0::BIGINT, i, leaf, n FROM k UNION ALL {up("tree").format("nodes")}),
tops(t, lvl, i, h, n) AS (SELECT 0::BIGINT, 0::BIGINT, tree, h, count(*) OVER () FROM nodes WHERE n = 1 UNION ALL {up("t").format("tops")}),
depth AS (SELECT tree, max(lvl) AS depth FROM nodes GROUP BY tree),
-- Each row's way: its tree's levels, then those of the trees.
way AS (SELECT k.tree, k.i, x.lvl, x.i < (k.i >> x.lvl) AS on_left, x.h FROM k JOIN depth USING (tree)
          JOIN nodes x ON x.tree = k.tree AND x.lvl < depth AND x.i = xor(k.i >> x.lvl, 1::BIGINT)
        UNION ALL
        SELECT k.tree, k.i, depth + x.lvl, x.i < (k.tree >> x.lvl), x.h FROM k JOIN depth USING (tree)
          JOIN tops x ON x.n > 1 AND x.i = xor(k.tree >> x.lvl, 1::BIGINT)),
proof AS (SELECT tree, i, string_agg(h, '' ORDER BY lvl) AS h FROM way GROUP BY tree, i),
high AS (SELECT max(lvl) AS high FROM tops),
fold(tree, i, lvl, most, h) AS (
  SELECT k.tree, k.i, 0::BIGINT, depth + high, said FROM k JOIN depth USING (tree), high
  UNION ALL
  SELECT f.tree, f.i, f.lvl + 1, most, sha256(CASE WHEN on_left THEN w.h || f.h ELSE f.h || coalesce(w.h, '') END)
  FROM fold f LEFT JOIN way w ON w.tree = f.tree AND w.i = f.i AND w.lvl = f.lvl WHERE f.lvl < most)
SELECT k.doc_id, k.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.h, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM k JOIN nodes s ON s.tree = k.tree AND s.n = 1 JOIN tops r ON r.n = 1
  JOIN fold f ON f.tree = k.tree AND f.i = k.i AND f.lvl = f.most LEFT JOIN proof p ON p.tree = k.tree AND p.i = k.i
"""


@query("op13_merkle_manifest", _manifest_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether the row as it came verifies."""
    return merkle.manifest(read_table(spark, sf_dir, "documents")).drop("proof")
