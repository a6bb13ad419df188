"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharrow.llm.bpe import byte_bpe
from logharrow.llm.common import WORD, table
from logharrow.llm.exact import DigestIndex
from logharrow.llm.language import Training, fit_language_model, predict_language
from logharrow.llm.lines import NEAR_FROM, line_dedup
from logharrow.llm.mixing import mix_sources
from logharrow.llm.ngram_join import Jaccard, ngram_components
from logharrow.llm.pii import personal_data
from logharrow.llm.quality import (
    BOILERPLATE, BOILERPLATE_WORDS, MAX_LOST, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PER_WORD, MAX_WORDS_PER_ENTRY, MIN_WORDS,
    SENTENCE_END, SEPARATORS, SYMBOLS, quality_rules,
)
from logharrow.llm.search import Ranking, search
from logharrow.llm.suffixes import repeated_bytes
from logharrow.llm.tokens import token_counts
from logharrow.llm.vector_codes import Lloyd, vector_codes
from logharrow.llm.warc import page_records, read_warc, write_warc
from logharrow.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first load of a fresh index."""
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, work_dir(spark, "digest-index"))
    return index.add(table(spark, sf_dir, "documents"), load="first")


ORACLES["op2_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def _many(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_FAILS = f"""(NOT {_found('line', SENTENCE_END)} OR {_many('line', SYMBOLS)} > {_many('line', WORD)} * {MAX_SYMBOLS_PER_WORD}
  OR ({_many('line', SEPARATORS)} >= 2 AND {_many('line', WORD)} <= ({_many('line', SEPARATORS)} + 1) * {MAX_WORDS_PER_ENTRY + 1})
  OR ({_found('line', BOILERPLATE)} AND {_many('line', WORD)} <= {BOILERPLATE_WORDS}))"""
ORACLES["op7_quality_rules"] = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE {_found('line', WORD)}
), by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars,
         coalesce(sum(length(line)) FILTER (NOT {_FAILS}), 0) AS good FROM lines GROUP BY r
), windows AS (
  SELECT r, i, array_to_string(words[i : i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM t WHERE len(words) >= 5)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST({_many('text', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CASE WHEN coalesce(chars, 0) = 0 THEN 0.0::DOUBLE ELSE 1 - good::DOUBLE / chars END AS lost_share
  FROM t LEFT JOIN by_line USING (r) LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND lost_share <= {MAX_LOST} AS kept FROM judged
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Jaccard(n=3, up=90, down=100))


ORACLES["op1_ngram_jaccard"] = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(words[i : i + 2], ' ') AS s
  FROM (SELECT r, words, unnest(generate_series(1, greatest(len(words) - 2, 1))) AS i FROM t WHERE len(words) > 0)
), sizes AS (
  SELECT t.r, doc_id, count(s) AS n FROM t LEFT JOIN shingles USING (r) GROUP BY ALL
), links AS (
  SELECT a, b FROM (
    SELECT x.r AS a, y.r AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY ALL
  ) JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), reached AS (
  SELECT r AS a, r AS b FROM t UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
)
SELECT x.doc_id, x.n AS n_shingles, min(y.doc_id) AS component_id
FROM sizes x JOIN reached ON x.r = reached.a JOIN sizes y ON y.r = reached.b GROUP BY x.r, x.doc_id, x.n
"""


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to archives and reads them back."""
    folder = work_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return page_records(read_warc(spark, folder))


ORACLES["op5_warc"] = r"""
WITH t AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM t
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), with_text=False)


@query
def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), with_text=False)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), with_text=False, near_from=NEAR_FROM)


@query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the documents that are not held out, applied to all."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_language_model(docs.where(~held_out), Training())
    return predict_language(docs, model).withColumn("held_out", held_out)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Ranking())


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '{_TERM}')"


ORACLES["op12_ranked_search"] = f"""
WITH asked AS MATERIALIZED (
  SELECT q, item_id, term, count(*) AS k FROM (
    SELECT row_number() OVER () AS q, item_id, unnest({_terms("text")}) AS term FROM benchmark
  ) GROUP BY ALL
), held AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS terms FROM documents
), sizes AS (
  SELECT r, doc_id, len(terms) AS n FROM held WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
), postings AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), stretched AS (
  SELECT r, doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM sizes, totals
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN stretched USING (r) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), Lloyd())


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r, p, min({apart} * {entries} + j) AS best FROM cut JOIN book{i} USING (p) GROUP BY r, p
)""")
        if i == rounds:
            break
        steps.append(f"""mean{i} AS (
  SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS j, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT p, best, x, unnest(generate_series(1, len(x))) AS i FROM near{i} JOIN cut USING (r, p)) GROUP BY ALL
  ) GROUP BY p, j
), book{i + 1} AS MATERIALIZED (
  SELECT p, j, coalesce(mean{i}.c, book{i}.c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, j)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
  FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)
), book0 AS (
  SELECT p, r - 1 AS j, x AS c FROM cut WHERE r <= {entries}
), {", ".join(steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


ORACLES["op13_vector_codes"] = _lloyd_sql()
