"""Queries ``opN_<name>`` over the whole tables, and their DuckDB oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..tables import load
from . import bloom_lm, bpe, chat, fim, host_rules, html, shards, simhash, spelling, substring, tiling, token_scan, warc
from .common import text_or_empty, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SEPARATOR = 50_256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_tag_paths")
def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(spark, load(spark, sf_dir, "documents"))


HOST_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t
), win AS (
  SELECT rid, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM win
        QUALIFY count(*) OVER (PARTITION BY rid, win) > 1)
  GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN lines ON lines.rid = w.rid
), j AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS docs, sum(base_failed::INT) AS failed FROM j GROUP BY source
), p AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10 END AS s
  FROM (SELECT avg(failed / docs) AS m, var_samp(failed / docs) AS v FROM h)
), r AS (
  SELECT source, (failed + m * s) / (docs + s) > 0.8 AS rejected FROM h, p
)
"""


@query("op4_host_rules", HOST_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source""")
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and kept of every document."""
    out = host_rules.with_verdicts(spark, load(spark, sf_dir, "documents"), extra=["doc_id", "source"])
    return out.select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


@query("op3_token_scan")
def op3_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written from all documents."""
    path = scratch_path(spark, "token-files")
    token_scan.write_token_files(load(spark, sf_dir, "documents"), path, VOCABULARY, public_tokenizers.PATTERN, SEPARATOR)
    return token_scan.documents(spark, path, SEPARATOR).select("doc_id", "n_tokens")


@query("op5_bloom_lm")
def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact unigram score and model score of every document, from the training documents' counts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.withColumn("held_out", F.crc32(name.cast("binary")) % 10 == 0)
    return bloom_lm.score(spark, docs.filter("not held_out"), docs).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the token ids and of what they decode to."""
    ids = bpe.encode(docs.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their decoding."""
    return encoded(load(spark, sf_dir, "documents"))


@query("op9_string_tiling")
def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose tiles cover enough of the item."""
    found = tiling.matches(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage")


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(4), lambda g: array_to_string(list_transform(range(8), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(h, 10 * g + 1, 10))::BIGINT >> (35 - 5 * i)) & 31)::INT + 1, 1)), '')), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
"""


@query("op7_arc_to_warc", WARC_SQL)
def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC files, converted to WARC and read back."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    arcs = [scratch_path(spark, f"arc-{v}") for v in (1, 2)]
    odd = F.coalesce(F.col("page_id"), F.lit(0)) % 2 != 0
    warc.write_arc(pages.filter(~odd), arcs[0], 1)
    warc.write_arc(pages.filter(odd), arcs[1], 2)
    out = scratch_path(spark, "warc")
    arc = warc.read_arc(spark, arcs[0]).unionByName(warc.read_arc(spark, arcs[1]))
    warc.write_warc(warc.convert(spark, arc), out)
    read = warc.read_warc(spark, out).filter("type in ('response', 'revisit')")
    whole = F.col("type") == "response"
    read = read.select(
        warc.header_value(F.col("head"), "X-Page-Id").cast("bigint").alias("page_id"), "record", "refers_to",
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("bigint").alias("payload_bytes"),
        F.when(whole, warc.base32_sha1(F.col("payload")))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"))
    read = written(spark, read, "warc-read")
    first = read.filter("record_type = 'response'").select(F.col("record").alias("refers_to"),
                                                          F.col("page_id").alias("first_id"))
    return read.join(first, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("first_id").alias("refers_to"))


@query("op8_histogram_sort")
def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 of nearly equal bytes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = shards.shard_by_bytes(spark, docs, shards.document_size())
    return out.select("doc_id", "size", F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(role) + length(escaped) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op10_chat_layouts", CHAT_SQL)
def op10_chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in four layouts, recognised, formatted and read back."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame(
        [(-1, 0, "user", marks), (-1, 1, "assistant", marks)], rows.schema))
    read = chat.read_back(chat.formatted(chat.canonical(chat.as_records(chat.gathered(rows)))))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("read", lambda t: t["loss"]), "")
    return read.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


FIM_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
               ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t)
), p AS (
  SELECT *, t[1:a] AS prefix, t[a + 1:b] AS middle, t[b + 1:n] AS suffix FROM h
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query("op11_swar_fim", FIM_SQL)
def op11_swar_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle form, and the text rebuilt from it."""
    out = fim.transform(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256"))


# crc32 byte by byte, over the 256 values of the polynomial's table
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, n, list_transform(range(octet_length(key)), lambda i: ('0x' || hex(key)[2 * i + 1:2 * i + 2])::BIGINT) AS bytes
        FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS key FROM runs)), crc
), counts AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, word[1:i] AS a, word[i + 2:] AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counts)
), near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN counts w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN counts w ON w.word = c.a || c.b
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word
), forms AS (
  SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form,
         CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM counts c LEFT JOIN best ON best.word = c.word
), chain AS (
  SELECT word, word AS last FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.last WHERE forms.form IS NOT NULL
)
SELECT f.word, n, n_near, form, form_n, r.last AS root
FROM forms f JOIN (SELECT chain.word, chain.last FROM chain JOIN forms ON forms.word = chain.last WHERE form IS NULL) r ON r.word = f.word
"""


@query("op12_trie_pairs", SPELLING_SQL)
def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their spelling neighbours and the form each one goes back to."""
    out = spelling.variants(spark, load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


SUBSTRING_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM t WHERE len(words) >= 50)
), cut AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p
  FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM win)
  WHERE first_id < coalesce(doc_id, 9223372036854775807)
), pos AS (
  SELECT rid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM t
), kept AS (
  SELECT pos.rid, count(*) AS n, string_agg(w, ' ' ORDER BY pos.p) AS s
  FROM pos ANTI JOIN cut ON cut.rid = pos.rid AND cut.p = pos.p GROUP BY pos.rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.rid = t.rid
"""


@query("op13_suffix_automata", SUBSTRING_SQL)
def op13_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that documents with smaller ids have."""
    out = substring.remove_repeats(spark, load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
