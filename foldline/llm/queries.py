"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, durable, egojoin, htmltext, langid, rollup, secrets, sharding, simhash, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 2 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, words=1, radius=2)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )


Counted = Callable[[DataFrame], DataFrame]


def _rollup(spark: SparkSession, sf_dir: str, counted: Counted) -> DataFrame:
    """Totals after three batches: all documents inserted, those labelled toxic deleted, and those with a rights line recounted
    without it. The second batch is sent twice. `counted` gives a row for each row and tokenizer version instead of the text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()

    def changes(op: str, rows: DataFrame) -> DataFrame:
        return counted(rows).select(F.lit(op).alias("op"), "doc_id", "source", "lang", "tokenizer_version", "n_tokens")

    totals = rollup.TokenRollup(spark, f"{durable.shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    totals.commit("load", changes("insert", documents))
    deleted = documents.join(toxic, "doc_id", "left_semi").withColumn("text", F.lit(""))
    for _ in range(2):
        totals.commit("takedown", changes("delete", deleted))
    marked = documents.where(F.contains("text", F.lit("All rights reserved."))).join(toxic, "doc_id", "left_anti")
    totals.commit("recount", changes("revise", marked.withColumn("text", F.replace("text", F.lit("All rights reserved."), F.lit("")))))
    return totals.totals()


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents under two public tokenizers, as deltas left them."""
    import public_tokenizers

    files = {v: tokenizer_path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    return _rollup(spark, sf_dir, lambda rows: tokencount.token_counts(rows, files, public_tokenizers.PATTERN))


def rollup_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches under two built-in rules, which SQL can express: a check of the deltas."""

    def counted(rows: DataFrame) -> DataFrame:
        counts = [F.struct(F.lit(v).alias("tokenizer_version"), rollup.count_tokens(F.col("text"), v).alias("n_tokens")) for v in rollup.VERSIONS]
        return rows.select("doc_id", "source", "lang", F.inline(F.array(*counts)))

    return _rollup(spark, sf_dir, counted)


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = langid.held_out(F.col("doc_id"))
    model = langid.fit(documents.where(~apart))
    found = langid.identify(documents.select("doc_id", "text"), model, keep_text=False)
    return found.select(
        "doc_id", apart.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(documents, table(spark, sf_dir, "benchmark"), keep_text=False)
    leak = F.col("leak")
    words = F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_items = leak["n_items"]
    return found.select(
        "doc_id", leak["n_words"].alias("n_words"), words.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(leak["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"), leak["longest"].alias("longest_match"),
        *[leak[c].alias(c) for c in ("longest_start", "longest_item", "longest_item_start")],
    )


def op5_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted in windows and read back from these."""
    import public_tokenizers

    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_windows(told.unionByName(own), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat.read_back(formatted)


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 8 of equal weight, its slot there, and its shard among 9."""
    placed = sharding.assign_shards(
        table(spark, sf_dir, "documents"), {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)}
    )
    return placed.withColumnRenamed("key", "doc_id")


def tokenizer_path(name: str) -> str:
    """The file of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document under word_bpe_49k, as digests."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(documents, tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through a new ledger in the shared folder: the benchmark's texts are scanned first and the documents
    then, twice, as in a history whose blobs come again; what the ledger holds by then isn't searched again."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, f"{durable.shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    for versions in (table(spark, sf_dir, "benchmark"), documents, documents):
        ledger.scan(versions)
    spans = F.col("secret_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    listed = ledger.findings_of(documents).withColumn("spans", secrets.spans_string(spans))
    return listed.select(
        "doc_id", *[count(rule[0]) for rule in secrets.RULES],
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans",
    )


def op9_ego_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"), limit=0.9).withColumnRenamed("id", "vec_id")


def op10_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_token_rollup": op2_token_rollup,
    "rollup_of_rules": rollup_of_rules,
    "op3_zstd_language": op3_zstd_language,
    "op4_suffix_decontamination": op4_suffix_decontamination,
    "op5_budgeted_chat": op5_budgeted_chat,
    "op6_rendezvous_shards": op6_rendezvous_shards,
    "op7_chunk_bpe": op7_chunk_bpe,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_ego_neardup": op9_ego_neardup,
    "op10_flat_blocks": op10_flat_blocks,
}

#: DuckDB SQL of the queries that SQL can express.
#: The base rules once more, as DuckDB reads them.
_RULES_SQL = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 6, 0),
    ("access", r"()(AKIA[A-Z0-9]+)", 20, 1),
    ("hex", r"()([0-9a-f]+)", 24, 2),
)


def _spans_sql() -> str:
    parts = []
    for kind, pattern, least, rank in _RULES_SQL:
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, pos, piece, {least} AS least FROM (
              SELECT doc_id, unnest(string_split(regexp_replace(body, '{quoted}', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57344), 'g'), chr(57344))) AS piece,
                     generate_subscripts(string_split(regexp_replace(body, '{quoted}', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57344), 'g'), chr(57344)), 1) AS pos
              FROM bodies)"""
        )
    return " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "rollup_of_rules": r"""
        WITH kept AS (
            SELECT source, lang, replace(coalesce(text, ''), 'All rights reserved.', '') AS text FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        ), counted AS (
            SELECT source, lang, 'space-1' AS tokenizer_version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM kept
            UNION ALL
            SELECT source, lang, 'alnum-2', len(regexp_extract_all(text, '[A-Za-z0-9]+')) FROM kept
        )
        SELECT source, lang, tokenizer_version, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens
        FROM counted GROUP BY ALL""",
    "op4_suffix_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[k : k + least(8, len(w)) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS k FROM b WHERE len(w) > 0)
        ),
        spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d WHERE len(w) > 0),
        grams AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM spots, (SELECT DISTINCT n FROM windows) WHERE k + n - 1 <= len(w)),
        found AS (SELECT doc_id, k, n, item_id FROM grams JOIN windows USING (n, gram)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id),
        longest AS (
            SELECT doc_id, len, start, item, item_start FROM (
                SELECT doc_id, item_id::VARCHAR AS item, min(k) - 1 AS start, min(j) - 1 AS item_start, count(*) - 1 + any_value(n) AS len FROM (
                    SELECT f.doc_id, f.item_id, f.n, f.k, j, f.k - row_number() OVER (PARTITION BY f.doc_id, f.item_id, f.k - j ORDER BY f.k) AS run
                    FROM (SELECT DISTINCT doc_id, k, n, item_id FROM found) f
                    JOIN (SELECT DISTINCT item_id, j, array_to_string(w[j : j + least(8, len(w)) - 1], ' ') AS gram, least(8, len(w)) AS n
                          FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS j FROM b WHERE len(w) > 0)) own
                    ON f.item_id IS NOT DISTINCT FROM own.item_id AND f.n = own.n
                    JOIN grams g ON g.doc_id = f.doc_id AND g.k = f.k AND g.n = f.n AND g.gram = own.gram)
                GROUP BY doc_id, item_id, k - j, run)
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, start, item NULLS LAST, item_start) = 1
        )
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_items, 0) >= 2 AS contaminated, coalesce(len, 0)::BIGINT AS longest_match,
               start::BIGINT AS longest_start, item AS longest_item, item_start::BIGINT AS longest_item_start
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op6_rendezvous_shards": """
        WITH bits AS (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
        bytes AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), sums AS (
            SELECT doc_id, n + 1 AS size,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
            FROM bytes, crc
        ), scores AS (
            SELECT doc_id, s, -1.0::DOUBLE / ln((('0x' || md5(doc_id || '#' || s)[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score
            FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS doc_id FROM documents), range(9) r(s)
        ), best AS (
            SELECT doc_id, arg_max(s, score) FILTER (s < 8) AS shard, arg_max(s, score) AS grown_shard FROM scores GROUP BY doc_id
        )
        SELECT sums.doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY md5(sums.doc_id::VARCHAR), sums.doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
        FROM sums JOIN best ON best.doc_id = sums.doc_id::VARCHAR""",
    "op8_secret_ledger": f"""
        WITH bodies AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS body FROM documents),
        pieces AS ({_spans_sql()}),
        placed AS (
            SELECT doc_id, kind, rank, least, pos, piece, CAST(sum(length(piece) - (pos % 2 = 0)::INT) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS BIGINT) AS stop FROM pieces
        ),
        spans AS (
            SELECT doc_id, kind, rank, stop - length(piece) + 1 AS start, stop FROM placed
            WHERE pos % 2 = 0 AND length(string_split(piece, chr(57345))[2]) >= least
        ),
        listed AS (
            SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
                   count(*) FILTER (kind = 'hex') AS h FROM spans GROUP BY doc_id
        )
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN listed USING (doc_id)""",
    "op9_ego_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
        ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
        FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id""",
}
