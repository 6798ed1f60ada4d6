"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ans, bpe, chat, exact, maxscore, mixing, neardup, paragraphs, phrases, quality, secrets, warc, whitening
from tessella.llm.common import table, whole_text

#: The vocabulary of the queries; operators take its path as a parameter.
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from an archive of all token ids."""
    index, freq = ans.archive(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return ans.read_documents(index, freq)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ids of every document and the text decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    return bpe.encode(docs, vocabulary_path(), keep=["doc_id"], decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by patterns and by the ratio of two Markov models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled(docs)))
    return found.select(
        "doc_id",
        *[secrets.count_kind(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listing("base_spans"), 256).alias("base_sha256"),
        secrets.listing("spans").alias("spans"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    measured = quality.measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select("doc_id", *counts, quality.base_failed().alias("base_failed"), quality.verdict().alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document among near-duplicates; the smallest identifier stays."""
    return neardup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("copies")


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(turns.unionByName(probe)))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and every record read back through the index."""
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.resolve(warc.read(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages with others, and what to remove from them."""
    return paragraphs.removals(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document among equal texts; the largest identifier stays."""
    return exact.classes(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest inner product of every query row."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % maxscore.EVERY == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
           FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every row on the first four components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
     g AS (SELECT lang, unnest(range(1, len(words) + 1)) AS i, words FROM w),
     f AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS a
           FROM g, (VALUES (1), (2), (3), (4), (5)) s(size) WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
     n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
     c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1),
     s AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n.n,
                  CAST((1000 * CAST(c.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS BIGINT) AS score
           FROM c JOIN n ON n.lang = c.lang
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     o AS (SELECT * FROM b WHERE NOT EXISTS (
             SELECT 1 FROM f q WHERE q.lang = b.lang AND q.a >= b.a AND length(q.phrase) > length(b.phrase)
             AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
     k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM k WHERE rank <= 2000
"""


def _stop_words() -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
     h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n FROM g),
     c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY doc_id),
     m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                  len(list_filter(words, lambda x: lower(x) IN ({_stop_words()}))) AS n_stop
           FROM w LEFT JOIN c USING (doc_id)),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words AND n_symbols <= 0.25 * n_words
       AND n_dup_lines <= 0.5 * n_lines AND (n_words < 50 OR n_stop >= 0.01 * n_words) AS kept
FROM b
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_archive": op1_token_archive,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_dedup": op6_near_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_chat_round_trip": op8_chat_round_trip,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_maxscore_search": op11_maxscore_search,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_round_trip": OP3_SQL,
    "op5_quality_rules": OP5_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_maxscore_search": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
