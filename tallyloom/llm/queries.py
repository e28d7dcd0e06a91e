"""Queries of the operators over whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .fillmiddle import fill_middle_digests
from .fingerprints import fingerprint_documents
from .html import extract_pages
from .knn import scaled_vectors, top_k
from .mixing import mix_sources
from .pieces import token_digests
from .pii import find_personal_data
from .quality import score_quality
from .resample import draw_by_importance
from .toxicity import score_toxicity
from .sharding import shard_digests, write_shards
from .simjoin import jaccard_components
from .tokenfile import read_documents, write_segments

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


@registered
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of all sources, weights 1, 2, 3, three epochs at most."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


MIX_SQL = """
WITH sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM {docs}),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS full_at,
         CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
                ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (
                ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM sources),
chosen AS (
  SELECT level FROM levels WHERE full_at >= level ORDER BY full_at, level LIMIT 1),
targets AS (
  SELECT source, source_size,
         coalesce(least(CAST(source_size * 3 AS DOUBLE), (SELECT level FROM chosen) * weight),
                  CAST(source_size * 3 AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, CAST(epochs * size + greatest(0, least(size,
              CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
  FROM placed)
"""
ORACLE["op8_mix_sources"] = (
    MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"
)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@registered
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded again."""
    path = tokenizer_path("piece_bpe_32k.model")
    return token_digests(read_table(spark, sf_dir, "documents"), path)


@registered
def op1_token_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from segment files."""
    docs = read_table(spark, sf_dir, "documents")
    return read_documents(spark, write_segments(docs, tokenizer_path("word_bpe_49k.json")))


@registered
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits, and how alike these are."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


@registered
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every 50th vector."""
    vectors = scaled_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


ORACLE["op5_top_k"] = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
whole AS (
  SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.i = d.i AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@registered
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


@registered
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is kept."""
    return score_quality(read_table(spark, sf_dir, "documents"))


@registered
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels that are not held out."""
    labels = read_table(spark, sf_dir, "labels")
    return score_toxicity(read_table(spark, sf_dir, "documents"), labels)


@registered
def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


@registered
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and places."""
    return find_personal_data(read_table(spark, sf_dir, "documents"))


@registered
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of all documents at line ends, and digests of their outputs and of the texts rebuilt."""
    return fill_middle_digests(read_table(spark, sf_dir, "documents"))


ORACLE["op12_fill_middle"] = """
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS whole,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS three,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS four
  FROM lined),
formed AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>')
                OR contains(whole, '<M>') OR three >= 100 THEN 'plain'
              WHEN four < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN whole
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM formed
"""


@registered
def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the longer documents, drawn by their likeness to the benchmark texts."""
    return draw_by_importance(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


# The remainders of CRC-32 come from its polynomial, bit by bit.
ORACLE["op11_importance_draw"] = r"""
WITH remainders AS (
  SELECT list(rest ORDER BY i) AS rests FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS rest
    FROM range(256) AS bytes(i))),
texts AS (
  SELECT true AS source, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT source, id, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
featured AS (
  SELECT source, id, unnest(words || list_transform(range(1, len(words)),
           lambda i: words[i] || ' ' || words[i + 1])) AS feature
  FROM worded),
counted AS (SELECT source, id, feature, count(*) AS n FROM featured GROUP BY ALL),
bucketed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(feature)),
             lambda i: CAST('0x' || substr(hex(feature), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, rests[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), remainders),
filled AS (
  SELECT bucket, sum(n) FILTER (source) AS s, sum(n) FILTER (NOT source) AS t
  FROM counted JOIN bucketed USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000)
                                      / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM filled, (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s,
                       CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM filled) AS whole),
weighted AS (
  SELECT id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN bucketed USING (feature) JOIN gains USING (bucket) WHERE source GROUP BY id),
scored AS (
  SELECT doc_id, len(words) AS n_words, greatest(0, 2 * len(words) - 1) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
            + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighted USING (id) WHERE source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
FROM ranked
"""


@registered
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in random order in 40 shards of equal numbers of rows, read back from files."""
    return shard_digests(spark, write_shards(read_table(spark, sf_dir, "documents"), 40))
