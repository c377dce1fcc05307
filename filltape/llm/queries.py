"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filltape.llm import (
    bpe,
    chat,
    merkle,
    near_dedup,
    nearest,
    packing,
    quality,
    shards,
    substring_dedup,
    token_file,
    toxicity,
    url_rules,
    whitening,
)
from filltape.llm.common import shared_path, table

URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SHARDS = 40


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


RANKS = "byte_bpe_50k.tiktoken"


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path(RANKS))
    pattern = public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = docs.select("doc_id", bpe.encode(F.col("text"), ranks, pattern).alias("ids"))
    decoded = encoded.withColumn("decoded", bpe.decode(F.col("ids"), ranks, pattern))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = rows.union(planted).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_turns(turns).withColumn("read", chat.read_turns(F.col("formatted")))
    said = F.transform(
        "read",
        lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["texts"], ""), F.lit("\n")),
    )
    out = out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(F.col("text")))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels).drop("row")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, span: total + span["length"]
    )
    return parsed.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.quantised(F.col("embedding"), scale=64, shift=1_000_000)
    return whitening.whiten(table(spark, sf_dir, "embeddings").withColumn("x", x), k=16)


TOKENIZER = "byte_bpe_50k.json"


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-file")
    tokenizer = token_file.load_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    token_file.write(table(spark, sf_dir, "documents"), path, tokenizer, end=0)
    return token_file.read(spark, path).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def leaf(n_chars: Column) -> Column:
        return merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    own = leaf(F.col("n_chars"))
    changed = F.when(tampered, leaf(F.col("n_chars") + 1)).otherwise(own)
    found = merkle.manifest(docs, own, changed)
    proof = merkle.proof_digest(F.col("path"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof.alias("proof_sha256"),
        "folded_root",
        "verified",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_nearest": op3_nearest,
    "op4_bpe": op4_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_url_rules": op7_url_rules,
    "op8_shards": op8_shards,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_token_file": op12_token_file,
    "op13_merkle": op13_merkle,
}

_ESCAPE = r"""regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"""

_FIELD = "coalesce(cast(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(_FIELD.format(f"cast({v} AS VARCHAR)") for v in values) + ")"


# Words lie between ASCII white space.
_WORDS = "list_filter(string_split_regex({}, '[ \\x09-\\x0D]+'), lambda word: word <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": f"""
      WITH RECURSIVE split AS (
        SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), "
               "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
        FROM documents),
      shingles AS (
        SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
        FROM split, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i)
        WHERE len(words) > 0),
      sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
      shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id),
      links AS (
        SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
        WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
      both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION
        SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
      least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
      FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op10_substring_dedup": f"""
      WITH split AS (
        SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
      windows AS (
        SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS window_text
        FROM split, unnest(range(1, len(words) - 48)) AS r(i)),
      firsts AS (SELECT window_text, min(doc_id) AS first FROM windows GROUP BY window_text),
      covered AS (
        SELECT DISTINCT w.doc_id, w.i + k AS i
        FROM windows w JOIN firsts USING (window_text), range(50) AS r(k)
        WHERE first < w.doc_id),
      placed AS (
        SELECT doc_id, i, words[i] AS word FROM split, unnest(range(1, len(words) + 1)) AS r(i)),
      kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept_text
        FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id),
      removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
      SELECT s.doc_id, cast(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
             sha256(coalesce(kept_text, '')) AS kept_sha256
      FROM split s LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op13_merkle": f"""
      WITH RECURSIVE crc_steps AS (
        SELECT i, i AS value, 0 AS step FROM range(256) AS r(i)
        UNION ALL
        SELECT i, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END,
               step + 1
        FROM crc_steps WHERE step < 8),
      crc AS (SELECT list(value ORDER BY i) AS t FROM crc_steps WHERE step = 8),
      marked AS (
        SELECT d.*, xor(4294967295, list_reduce(
                 list_prepend(4294967295, list_transform(
                   string_split(cast(doc_id AS VARCHAR), ''), lambda x: cast(ascii(x) AS BIGINT))),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS id_crc
        FROM documents d, crc),
      hashed AS (
        SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN id_crc % 7 = 0 THEN {_leaf_sql("n_chars + 1")}
                    ELSE {_leaf_sql("n_chars")} END AS changed
        FROM marked),
      leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
               count(*) OVER (PARTITION BY tree) AS n
        FROM hashed),
      lower AS (
        SELECT tree, 0 AS level, idx, leaf AS hash, n FROM leaves
        UNION ALL
        SELECT tree, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (n + 1) // 2
        FROM lower WHERE n > 1 GROUP BY tree, level, idx // 2, n),
      subroots AS (
        SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
        FROM lower WHERE n = 1),
      upper AS (
        SELECT 0 AS level, idx, hash, n FROM subroots
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (n + 1) // 2
        FROM upper WHERE n > 1 GROUP BY level, idx // 2, n),
      walked AS (
        SELECT tree, idx AS own, 0 AS level, idx, '' AS proof, changed AS folded, false AS done
        FROM leaves
        UNION ALL
        SELECT w.tree, w.own, w.level + 1, w.idx // 2, w.proof || coalesce(s.hash, ''),
               sha256(CASE WHEN w.idx % 2 = 1 THEN s.hash || w.folded
                           ELSE w.folded || coalesce(s.hash, '') END), false
        FROM walked w JOIN lower m ON m.tree = w.tree AND m.level = w.level AND m.idx = w.idx
        LEFT JOIN lower s ON s.tree = w.tree AND s.level = w.level
                         AND s.idx = CASE WHEN w.idx % 2 = 0 THEN w.idx + 1 ELSE w.idx - 1 END
        WHERE m.n > 1),
      topped AS (
        SELECT w.tree, w.own, 0 AS level, g.idx, w.proof, w.folded
        FROM walked w JOIN lower m ON m.tree = w.tree AND m.level = w.level AND m.n = 1
        JOIN subroots g ON g.tree = w.tree
        UNION ALL
        SELECT w.tree, w.own, w.level + 1, w.idx // 2, w.proof || coalesce(s.hash, ''),
               sha256(CASE WHEN w.idx % 2 = 1 THEN s.hash || w.folded
                           ELSE w.folded || coalesce(s.hash, '') END)
        FROM topped w JOIN upper m ON m.level = w.level AND m.idx = w.idx
        LEFT JOIN upper s ON s.level = w.level
                         AND s.idx = CASE WHEN w.idx % 2 = 0 THEN w.idx + 1 ELSE w.idx - 1 END
        WHERE m.n > 1)
      SELECT l.doc_id, l.leaf, g.hash AS subroot, r.hash AS root, sha256(t.proof) AS proof_sha256,
             t.folded AS folded_root, t.folded = r.hash AS verified
      FROM leaves l JOIN subroots g ON g.tree = l.tree JOIN upper r ON r.n = 1
      JOIN topped t ON t.tree = l.tree AND t.own = l.idx
      JOIN upper m ON m.level = t.level AND m.idx = t.idx AND m.n = 1""",
    "op5_chat_format": f"""
      WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL
        SELECT -7, turn, CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END,
               '</s>[INST] ok [/INST]'
        FROM range(2) AS r(turn))
      SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), ''
                               ORDER BY turn, role, text)) AS turns_sha256,
             cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT)
               AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                             FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
             cast(sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")})
                      + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
      FROM turns GROUP BY conv_id""",
    "op7_url_rules": r"""
      WITH parts AS (
        SELECT page_id,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
      urls AS (
        SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz') AS host, path
        FROM parts),
      judged AS (
        SELECT page_id, host, path,
               CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/')
                      THEN 'example.com/de/'
                    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/')
                      THEN 'example.net/en/'
                    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
               END AS rule
        FROM urls)
      SELECT page_id, host, path, rule,
             CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict
      FROM judged""",
}
