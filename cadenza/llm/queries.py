"""The queries of the text operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm.common import read
from cadenza.llm.decontaminate import contaminated
from cadenza.llm.fill_middle import digests, fill_middle
from cadenza.llm.html_text import extract_main_text
from cadenza.llm.language_id import identify
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.merkle import tamper_check
from cadenza.llm.ngram_join import jaccard_components
from cadenza.llm.order_minhash import edit_report
from cadenza.llm.pieces import encode_documents
from cadenza.llm.topk import top_k
from cadenza.llm.toxicity import score_documents
from cadenza.llm.url_filter import filter_urls
from cadenza.llm.warc import archive_round_trip

#: A public byte-pair model with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The URL rules of the contract: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, read(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, read(spark, sf_dir, "documents"), MODEL)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_middle(read(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(spark, read(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(spark, read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sentencepiece, op3_toxicity, op4_line_dedup, op5_html_extraction, op6_exact_top_k, op7_warc, op8_decontamination, op9_url_filters, op10_language_id, op11_fill_middle, op12_merkle_manifest, op13_document_fingerprints)}



def _counted(value: str) -> str:
    """A value with its bytes' count before it, `-` for null."""
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEAD = " || ".join(map(_counted, ("doc_id", "source", "lang", "n_chars")))
#: The CRC-32 of doc_id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
_RULES = " UNION ALL ".join(f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in URL_RULES)
SQL = {
    "op6_exact_top_k": """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f""",
    "op9_url_filters": f"""
WITH r AS ({_RULES}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
m AS (SELECT b.page_id, r.v, r.h || r.p AS rule, row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.h || r.p) DESC) AS k
      FROM b JOIN r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p))
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM b LEFT JOIN m ON m.page_id = b.page_id AND m.k = 1""",
    "op11_fill_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
u AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i <= length(text) - length(replace(text, chr(10), '')) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS u,
             list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(d, k, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT doc_id, text, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_HEAD} || {_counted("text")} AS row_text,
       {_HEAD} || {_counted(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS changed_text FROM documents),
l AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, sha256(row_text) AS leaf, sha256(changed_text) AS changed FROM d),
g(tree, level, idx, n, h) AS (SELECT tree, 0, idx, n, leaf FROM l
       UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM g WHERE n > 1 GROUP BY tree, level, idx // 8, n),
s AS (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM g WHERE n = 1),
t(level, idx, n, h) AS (SELECT 0, idx, n, subroot FROM s
       UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, idx // 8, n),
r AS (SELECT h AS root FROM t WHERE n = 1),
-- nodes under the place at which a path meets them: levels of the group first, then those on top
p AS (SELECT l.doc_id, g.level AS step, g.idx AS i, l.idx // CAST(pow(8, g.level) AS BIGINT) AS own, g.h FROM l JOIN g ON g.tree = l.tree AND g.n > 1 AND g.idx // 8 = l.idx // CAST(pow(8, g.level + 1) AS BIGINT)
      UNION ALL SELECT l.doc_id, 100 + t.level, t.idx, s.idx // CAST(pow(8, t.level) AS BIGINT), t.h FROM l JOIN s ON s.name = l.tree JOIN t ON t.n > 1 AND t.idx // 8 = s.idx // CAST(pow(8, t.level + 1) AS BIGINT)),
q AS (SELECT doc_id, string_agg(h, '' ORDER BY step, i) AS proof FROM p WHERE i <> own GROUP BY doc_id),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS turn, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS lo, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS hi FROM p GROUP BY doc_id, step),
f(doc_id, turn, h) AS (SELECT doc_id, 0, CASE WHEN {_CRC} % 3 = 0 THEN changed ELSE leaf END FROM l
      UNION ALL SELECT k.doc_id, f.turn + 1, sha256(k.lo || f.h || k.hi) FROM f JOIN k ON k.doc_id = f.doc_id AND k.turn = f.turn + 1),
e AS (SELECT doc_id, arg_max(h, turn) AS folded_root FROM f GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM l JOIN s ON s.name = l.tree CROSS JOIN r JOIN e ON e.doc_id = l.doc_id LEFT JOIN q ON q.doc_id = l.doc_id""",
}
