"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from voxelmill.llm.bpe_fold import encode_decode
from voxelmill.llm.common import materialize, read_table
from voxelmill.llm.decontaminate import find_items
from voxelmill.llm.lm_scores import lm_scores
from voxelmill.llm.near_dedup import near_duplicates
from voxelmill.llm.nearest_vectors import nearest_vectors
from voxelmill.llm.packing import pack_documents
from voxelmill.llm.periodic import periodic_runs, planted_period, sharpest
from voxelmill.llm.prefix_trie import ends_digest, prefix_trie, turn_ids, with_shared_heads
from voxelmill.llm.repeated_spans import repeated_spans
from voxelmill.llm.token_counts import token_counts
from voxelmill.llm.token_records import read_records, write_records
from voxelmill.llm.toxicity import toxicity_scores
from voxelmill.llm.url_rules import judge_urls, rule_table
from voxelmill.session import scratch_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


# The host and path rules of the url filter.
URL_RULES = [
    ("org/", "||org/", "allow"),
    ("example.org/es/", "||example.org/es/", "block"),
    ("example.org/en/1", "||example.org/en/1", "block"),
    ("com/fr/", "||com/fr/", "allow"),
    ("com/de/", "||com/de/", "block"),
]

URL_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op2_url_rules", URL_SQL)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@query("op9_token_records")
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-records")
    docs = read_table(spark, sf_dir, "documents")
    write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_bpe_fold")
def op4_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op3_repeated_spans")
def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op5_lm_scores")
def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scores(read_table(spark, sf_dir, "documents"), good)


@query("op8_nearest_vectors")
def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"))


CRC_OF_ID = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda s, b:
  list_reduce(list_concat([xor(s, b)], range(8)), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

TRIE_SQL = f"""
WITH convs AS MATERIALIZED (
  SELECT c, xor({CRC_OF_ID}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), own AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT convs.c, own.pos, own.t, own.words FROM convs JOIN own ON own.c = convs.c - convs.c % 20 AND own.pos <= h
  UNION ALL
  SELECT convs.c, own.pos, own.t, own.words FROM convs JOIN own ON own.c = convs.c AND own.pos > h
), numbered AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, t, words FROM rebuilt
), prefixes AS MATERIALIZED (
  SELECT c, d, sha256(string_agg(t, '') OVER (PARTITION BY c ORDER BY d)) AS k, words FROM numbered
  UNION ALL SELECT c, 0, 'root', 0 FROM convs
), nodes AS MATERIALIZED (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefixes GROUP BY d, k
), linked AS MATERIALIZED (
  SELECT n.d, n.k, n.conv_id, n.n_convs, n.words, up.k AS pk, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN prefixes up ON up.c = n.conv_id AND up.d = n.d - 1
  LEFT JOIN nodes p ON p.d = up.d AND p.k = up.k
), children AS MATERIALIZED (
  SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY 1, 2
), sums AS MATERIALIZED (
  SELECT up.d, up.k, sum(CASE WHEN ch.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN prefixes up ON up.c = n.conv_id AND up.d <= n.d LEFT JOIN children ch ON ch.d = n.d AND ch.k = n.k GROUP BY 1, 2
), ends AS MATERIALIZED (
  SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM (SELECT c, d, k FROM prefixes QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY d, k
)
SELECT n.conv_id, n.d::BIGINT AS depth, n.parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM linked n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN children ch ON ch.d = n.d AND ch.k = n.k LEFT JOIN ends e ON e.d = n.d AND e.k = n.k
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(turn_ids(read_table(spark, sf_dir, "conversations")), "trie-turns")
    trie = prefix_trie(with_shared_heads(turns, every=20, kinds=4))
    nodes = trie.nodes.join(ends_digest(trie), ["depth", "k1", "k2"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    best = found.withColumn("best", sharpest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
