"""The registered queries opN_<name> and pipeline: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from annolake.llm import collisions, fertility, language_model, lexical, licenses, media, mixing, ngram_join, packing, prefix_trie, quality, secrets, toxicity
from annolake.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"], repetition_limit=2.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), n=3, percent=90)


def op6_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"), folds=7, held_out=2)


def op7_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 1024)


def op9_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: the vectors are shown as such, a grey cell each number."""
    vectors = read(spark, sf_dir, "embeddings").selectExpr("cast(vec_id as long) id", "cast(embedding as array<double>) v")
    return media.find_copies(media.rendered(vectors))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op12_impact_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), k=50)


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_copies(read(spark, sf_dir, "embeddings"), least=0.98)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_temperature_mixing, op2_toxicity, op3_tokeniser_fertility, op4_secret_worklist, op5_ngram_jaccard, op6_recurrent_lm, op7_quality_machine, op8_best_fit_packing, op9_license_alignment, op10_image_descriptors, op11_prefix_trie, op12_impact_slices, op13_collision_counting)}


#: Words, shingle sets, all linked pairs and what they reach, without any candidate search.
NGRAM_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 2], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL"""

#: h is the unsigned crc32 of the decimal conv_id, modulo 9, by eight shifts a byte; every prefix of every rebuilt conversation is a list, and subtrees are lists that begin with it.
PREFIX_TRIE = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS source, list(x ORDER BY seq) AS own FROM t GROUP BY conv_id),
b AS (SELECT conv_id, seq, CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(seq AS BIGINT), 1)) AS BIGINT) AS byte FROM (SELECT conv_id, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS seq FROM c)),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(byte ORDER BY seq)), lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS h FROM b GROUP BY conv_id),
r AS (SELECT conv_id, list_concat(coalesce(s.own[1:h], []), c.own[h + 1:]) AS p FROM c JOIN h USING (conv_id) LEFT JOIN (SELECT conv_id AS source, own FROM c) s USING (source)),
m AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM r),
n AS (SELECT p[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(p) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY ALL),
e AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON n.d = p.d + 1 AND n.k[1:p.d] = p.k),
f AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT e.*, coalesce(n_children, 0) AS n_children, CASE WHEN e.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(e.k[e.d].t) END AS saved FROM e LEFT JOIN f USING (k, d)),
up AS (SELECT k[1:g] AS k, g AS d, n_children AS below, saved FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS g FROM w)),
s AS (SELECT k, d, count(*) FILTER (below = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM w JOIN s USING (k, d)"""

#: Every term of every document counted, and every document that shares a term with an item scored.
IMPACT_SLICES = r"""WITH t AS (SELECT doc_id, rowid_, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents)),
f AS (SELECT doc_id, rowid_, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT rowid_, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY ALL),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, rowid_, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (rowid_), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """The other queries learn, tokenise, decode, iterate or search approximately; they are tested against brute force."""
    return {"op5_ngram_jaccard": NGRAM_JACCARD, "op11_prefix_trie": PREFIX_TRIE, "op12_impact_slices": IMPACT_SLICES}
