"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, fim, langid, line_dedup, mixing, pieces, pii, product_codes, secrets, simhash, substring_dedup, token_counts, topk
from .shared import documents, embeddings

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, end, chunks, first_doc_id``: each run that repeats an earlier passage, in code points."""
    return substring_dedup.repeats(documents(spark, sf_dir)).select("doc_id", "start", "end", "chunks", "first_doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_deleted, lines``: for each document that has some, its deleted lines."""
    found = line_dedup.repeated_lines(documents(spark, sf_dir).where("doc_id is not null"))  # as its SQL has it
    return found.select("doc_id", F.size("lines").cast("long").alias("n_deleted"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: the 5 highest integer inner products of each 50th vector with all others."""
    return topk.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    return langid.identify(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return pieces.encode_documents(documents(spark, sf_dir), pieces.load(public_tokenizers.path(PIECE_MODEL)), with_ids=False)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    return pii.find_personal_data(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    return caps.near_duplicates(embeddings(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    return secrets.find_secrets(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    out = fim.fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.load(public_tokenizers.path(BYTE_MODEL)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    return product_codes.code_reports(embeddings(spark, sf_dir))


_QUERIES = (
    op1_substring_dedup, op2_line_dedup, op3_exact_topk, op4_language_id, op5_sentencepiece, op6_personal_data, op7_simhash, op8_cap_filters, op9_secrets, op10_mixing,
    op11_fill_in_middle, op12_token_counts, op13_vector_codes,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_OP2 = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, trim(l[i], E' \t\r\x0b\x0c') AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), numbered AS (
  SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lines WHERE t <> ''
), windows AS (
  SELECT doc_id, k, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2,
         [t, lead(t, 1) OVER w, lead(t, 2) OVER w] AS content
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, k) AS nth FROM windows WHERE l2 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([l0, l1, l2]) AS line FROM ranked WHERE nth > 1
)
SELECT doc_id, count(*) AS n_deleted, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM gone GROUP BY doc_id
"""

_OP3 = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP8 = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(links.n, 0) AS n_links, low.component_id, low.component_id = e.vec_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN links ON links.a = e.vec_id
"""


_OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, length(t) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS UBIGINT) FOR i IN range(4)] AS u FROM d
), cuts AS (
  SELECT doc_id, t, n, u, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b FROM numbers
), parts AS (
  SELECT doc_id, t, n, a, b, substring(t, 1, CAST(a AS BIGINT)) AS p, substring(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS m, substring(t, CAST(b AS BIGINT) + 1) AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u[3] % 100 >= 90 THEN 'plain' WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


def _op13(rounds: int = 4) -> str:
    """Lloyd's rounds by full comparison of every part with every entry."""
    head = """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x : floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS q FROM v, range(4) r(p)
), c0 AS MATERIALIZED (
  SELECT p, j, q AS c FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM x) WHERE j < 256
)"""
    assign = """, a{r} AS MATERIALIZED (
  SELECT vec_id, p, min({{'d': list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c), 'j': j}}) AS best FROM x JOIN c{r} USING (p) GROUP BY vec_id, p
)"""
    update = """, c{s} AS MATERIALIZED (
  SELECT c{r}.p, c{r}.j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT p, j, list(e ORDER BY i) AS c FROM (
      SELECT p, j, i, floor(sum(y) / count(*)) AS e FROM (SELECT p, best.j AS j, unnest(q) AS y, unnest(range(len(q))) AS i FROM a{r} JOIN x USING (vec_id, p)) GROUP BY p, j, i
    ) GROUP BY p, j
  ) m ON m.p = c{r}.p AND m.j = c{r}.j
)"""
    steps = "".join(assign.format(r=r) + update.format(r=r, s=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    tail = f"""
, codes AS (SELECT vec_id, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) AS s FROM (SELECT p, j, unnest(c) AS y, unnest(range(len(c))) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM books) AS codebooks_sha256 FROM codes JOIN v USING (vec_id)
"""
    return head + steps + tail


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op3_exact_topk": _OP3, "op8_cap_filters": _OP8, "op11_fill_in_middle": _OP11, "op13_vector_codes": _op13()}
