"""One query for each operator, over its whole table, with the columns of its contract; and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import sentencepiece  # noqa: F401  (asked for here, so that no query is offered that lacks its library)
import tokenizers  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.llm import crosstok, embeddings, html_text, licenses, lines, minhash, mixing, packing, ppm, quality, resample, tokens, warc


def tokenizer_path() -> str:
    """The vocabulary file of the queries; operators take any path."""
    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and verdict of the current policy of every document. Null or blank: no words, so failed. Repeated
    rows each have a row."""
    book = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = ~quality.passes(quality.BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & quality.passes(quality.POLICY)).alias("kept"), "fail_bits")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector at a cosine of 0.93. Unusable vectors and null labels: alone, kept. Ties: the
    smallest vec_id names the component."""
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and components of every document at four words and 80 percent. Texts without words: empty set, alone, kept."""
    return minhash.near_texts(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back. Null text: the end id alone. Rows that share a doc_id stand in a row, in any
    order; null doc_ids first."""
    return tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer_path(), end=2)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null, empty or without an article: the empty string, 0 characters."""
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null text: size 0, taken 0. Null source: a source of its own, the last. Rows
    that share a doc_id share what it is given by size."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids. Null text: the end id alone. Equal sizes stand by doc_id."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), end=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and how many go. Null or empty: one empty line. Null doc_id: no holder, loses shared lines."""
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the trie and by counts of words. Null: the end sign alone. Null doc_id: its text is empty."""
    return ppm.score_running(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, read back from the archives. Null html: 0 bytes. Null page_id: a response. Ties: the largest
    page_id is the response."""
    return warc.archive_table(_table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every document towards the benchmark texts. Null or empty: no features, weight 0. Null
    doc_id: hashed as empty. Ties: the smaller doc_id."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of every document. Null, empty, or not given back by the pieces: zeros and the empty string. Ties of
    counts all count as best."""
    return crosstok.align_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document. Null or empty: no words, no labels, score 0. Repeated rows each have a
    row."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN c USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP3_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 150::DOUBLE / 100 - coalesce((sum(cap) OVER o)::BIGINT, 0) AS left_,
         (sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER o)::BIGINT, 0) AS w_, row_number() OVER (ORDER BY cap / weight::DOUBLE, source ASC NULLS LAST) AS rn
  FROM w WINDOW o AS (ORDER BY cap / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(left_ / w_, rn) AS fill FROM l WHERE cap > left_ / w_ * weight),
g AS (SELECT source, source_size, CASE WHEN fill IS NULL OR cap <= fill * weight THEN cap::DOUBLE ELSE fill * weight END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
u AS (SELECT source, k, sum(size)::BIGINT AS unit FROM d GROUP BY source, k),
h AS (SELECT *, coalesce(sum(unit) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held FROM u)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * e.epochs + CASE WHEN h.unit = 0 THEN 0 ELSE floor(d.size * greatest(0, least(h.unit, floor(e.target)::BIGINT - e.epochs * e.source_size - h.held)) / h.unit::DOUBLE) END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.k = h.k
"""

OP8_SQL = """
WITH l AS (
  SELECT r, doc_id, i, x, translate(regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
b AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, b.k IS NOT NULL AND l.doc_id IS DISTINCT FROM b.holder AS gone FROM l LEFT JOIN b USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT // [32768, 1024, 32, 1][i % 4 + 1]) % 32, 1)), '') AS payload_digest
  FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH tab AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b::BIGINT, generate_series(1, 8)), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, 0 AS target, {_WORDS} AS w FROM documents
  UNION ALL SELECT NULL, NULL, 1, {_WORDS} FROM benchmark),
e AS (SELECT r, target, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
n AS (SELECT r, target, f, count(*) AS n FROM e GROUP BY ALL),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(h) - 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM u, tab),
c AS (SELECT b, coalesce(sum(n) FILTER (target = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (target = 1), 0)::BIGINT AS t FROM n JOIN b USING (f) GROUP BY b),
a AS (SELECT sum(s)::BIGINT AS ss, sum(t)::BIGINT AS tt FROM c),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM c, a),
x AS (SELECT r, sum(n.n)::BIGINT AS n_features, sum(n.n * gain)::BIGINT AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE target = 0 GROUP BY r),
y AS (
  SELECT d.r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN x ON x.r = d.r WHERE target = 0),
z AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS FIRST) AS k, (count(*) FILTER (able) OVER ()) * 5 // 100 AS m FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= m THEN k END AS rank FROM z
"""


def _op13_sql(k: int = licenses.RUN) -> str:
    known = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = " UNION ALL ".join(f"SELECT '{label}' AS label, {p.split()!r} AS p" for p, label in licenses.PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS ({phrases}),
i AS (SELECT r, doc_id, w, unnest(generate_series(0, len(w) - 1)) AS pos FROM d),
o AS (SELECT r, pos, label FROM i JOIN p ON w[pos + 1] = p[1] AND w[pos + 1:pos + len(p)] = p),
ob AS (SELECT r, count(*)::BIGINT AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, list(DISTINCT label) AS own FROM o GROUP BY r),
k(template, label, w) AS (VALUES {known}),
kr AS (SELECT template, label, len(w) AS size, tat, array_to_string(w[tat + 1:tat + {k}], ' ') AS run FROM (SELECT *, unnest(generate_series(0, len(w) - {k})) AS tat FROM k)),
h AS (SELECT r, template, label, size, tat, pos, pos - tat AS diagonal FROM i JOIN kr ON array_to_string(w[pos + 1:pos + {k}], ' ') = run),
v AS (SELECT r, template, label, size, diagonal, min(pos) AS a, max(pos) + {k - 1} AS z, list_distinct(flatten(list(generate_series(tat, tat + {k - 1})))) AS held FROM h GROUP BY ALL),
s AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {licenses.GAP} THEN 0 ELSE 1 END AS apart FROM v),
t AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM s),
m AS (SELECT r, label, size, max(z) - min(a) AS wide, len(list_distinct(flatten(list(held)))) / size::DOUBLE AS cover, max(len(held)) / size::DOUBLE AS best FROM t GROUP BY r, template, label, size, span),
q AS (SELECT r, max(cover) AS cover, list(DISTINCT label) FILTER (best >= {licenses.COVER} OR (cover >= {licenses.COVER} AND wide < 2 * size)) AS more FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN ob USING (r) LEFT JOIN q USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_embedding_dedup, op3_minhash_dedup, op4_token_output, op5_html_text, op6_mixing, op7_packing, op8_line_dedup, op9_ppm_score, op10_warc, op11_importance_resampling, op12_tokenizer_alignment, op13_license_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op3_minhash_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_license_scan": _op13_sql()}
