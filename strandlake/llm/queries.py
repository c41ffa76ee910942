"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crf, embed, exact, html, lines, packing, prefixes, resample, simhash, substring, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level BPE file; installed beside this engine, never part of it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_groups(_table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(turns))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(_table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    every = (op1_embedding_near_dedup, op2_chat_formatting, op3_url_filters, op4_quality_classifier, op5_packing, op6_simhash_near_dedup, op7_exact_dedup, op8_substring_dedup, op9_html_extraction, op10_bpe, op11_prefix_trie, op12_importance_resampling, op13_line_dedup)
    return {f.__name__: f for f in every}


#: Common tables of crc32: crc_table, and `checks` (s, crc) of the distinct strings of a table `strings` (s), a byte at a time.
_CRC32 = """
            crc_table AS (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) r(i)),
            hexed AS (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM strings)),
            steps(s, x, i, c) AS (
                SELECT s, x, 0, 4294967295::BIGINT FROM hexed
                UNION ALL
                SELECT s, x, steps.i + 1, xor(c >> 8, v)
                FROM steps JOIN crc_table t ON t.i = xor(c & 255, ('0x' || substr(x, 2 * steps.i + 1, 2))::BIGINT) WHERE 2 * steps.i < length(x)),
            checks AS (SELECT s, xor(c, 4294967295) AS crc FROM steps WHERE 2 * i = length(x))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op11_prefix_trie": f"""
            WITH RECURSIVE strings AS (SELECT DISTINCT conv_id::VARCHAR AS s FROM conversations), {_CRC32},
            shares AS (SELECT s::BIGINT AS c, s::BIGINT - s::BIGINT % 20 AS b, CASE WHEN s::BIGINT % 20 = 0 THEN 0 ELSE crc % 4 END AS h FROM checks),
            indexed AS (
                SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
                FROM conversations),
            turns AS (
                SELECT shares.c, i, role, text FROM shares JOIN indexed ON indexed.c = shares.b WHERE i <= h
                UNION ALL
                SELECT c, i + 10, role, text FROM shares JOIN indexed USING (c) WHERE i > h),
            prefixes AS (
                SELECT c, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS prefix, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words
                FROM turns WINDOW w AS (PARTITION BY c ORDER BY i)),
            rows AS (
                SELECT c, depth, min(c) OVER (PARTITION BY depth, prefix) AS rep, n_words FROM prefixes
                UNION ALL
                SELECT c, 0, min(c) OVER (), 0 FROM shares),
            ends AS (SELECT c, rep, depth FROM rows QUALIFY depth = max(depth) OVER (PARTITION BY c)),
            nodes AS (
                SELECT r.rep, r.depth, any_value(p.rep) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(r.n_words) AS saved
                FROM rows r LEFT JOIN rows p ON p.c = r.c AND p.depth = r.depth - 1 GROUP BY r.rep, r.depth),
            fertile AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
            below AS (
                SELECT up.rep, up.depth, count(*) FILTER (f.n IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
                FROM nodes n LEFT JOIN fertile f USING (rep, depth) JOIN rows up ON up.c = n.rep AND up.depth <= n.depth GROUP BY up.rep, up.depth),
            ended AS (SELECT rep, depth, string_agg(c::VARCHAR, ',' ORDER BY c) AS who FROM ends GROUP BY rep, depth)
            SELECT n.rep AS conv_id, n.depth::BIGINT AS depth, n.parent AS parent_conv_id, n.n_convs, coalesce(f.n, 0)::BIGINT AS n_children,
                   b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.who, '')) AS ends_sha256
            FROM nodes n JOIN below b USING (rep, depth) LEFT JOIN fertile f USING (rep, depth) LEFT JOIN ended e USING (rep, depth)""",
        "op12_importance_resampling": f"""
            WITH RECURSIVE texts AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
            split AS (
                SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
                FROM texts),
            features AS (
                SELECT kind, id, unnest(w) AS s FROM split
                UNION ALL
                SELECT kind, id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM split),
            strings AS (SELECT DISTINCT s FROM features), {_CRC32},
            counted AS (SELECT kind, id, crc % 10000 AS bucket, count(*) AS n FROM features JOIN checks USING (s) GROUP BY ALL),
            sums AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
            totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
            gains AS (SELECT bucket, floor(1000 * ln((x.t + 1) * (y.s + 10000) / ((x.s + 1) * (y.t + 10000))))::BIGINT AS gain FROM sums x, totals y),
            weighed AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::HUGEINT AS total FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
            scored AS (
                SELECT id AS doc_id, coalesce(n, 0) AS n_features, len(w) AS n_words, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
                       floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
                FROM split LEFT JOIN weighed USING (id) WHERE kind = 'd'),
            ranked AS (
                SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id, n_features) END AS place,
                       25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS take
                FROM scored)
            SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= take THEN place END AS rank FROM ranked""",
        "op13_line_dedup": """
            WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM split),
            keyed AS (
                SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM lines),
            repeated AS (SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keep_id <> doc_id) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep_id IS NULL OR keep_id = doc_id), '')) AS kept_sha256
            FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id""",
    }
