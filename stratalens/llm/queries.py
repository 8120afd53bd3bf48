"""The op<N>_<name> queries: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .chat import collapse_and_render
from .common import read, remainder
from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .lattice_lm import lattice_scores
from .licenses import license_scan
from .mixing import mix
from .packing import pack_documents
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .topk import top_k
from .toxicity import FOLDS, HELD_OUT, score_documents, train
from .vector_codes import vector_codes


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(read(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
logged AS (
  SELECT conv_id, list(role || chr(1) || text ORDER BY turn NULLS FIRST, role, text) AS said, count(*) AS n_turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM turns GROUP BY conv_id),
prefixes AS (SELECT DISTINCT said[1:n] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS n FROM logged)),
firsts AS (SELECT min(conv_id) AS conv_id, said FROM logged GROUP BY said)
SELECT l.conv_id, l.n_turns, l.text
FROM logged l JOIN firsts f ON l.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = l.said)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM cells JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON (far.lang, far.source, far.item) = (a.lang, a.source, b.source)
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    shards = F.concat_ws(",", F.transform("copies", lambda c: c["shard"].cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 6) -> str:
    """The rounds unrolled; distances by scalar products, exact in doubles below 2^53."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT r, p, unnest(arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}})) FROM
            (SELECT r, p, e, CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) AS d FROM parts JOIN c{i} USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""u{i} AS MATERIALIZED (SELECT p, e, list(floor((s - ((s % k) + k) % k) / k)::DOUBLE ORDER BY j) AS c FROM
            (SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS k FROM (SELECT p, e, generate_subscripts(x, 1) AS j, unnest(x) AS y FROM parts JOIN n{i} USING (r, p)) GROUP BY ALL) GROUP BY p, e),
            c{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(u{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN u{i} USING (p, e))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM
  (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x FROM v, range(8) t(p)),
c0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16),
{", ".join(steps)},
coded AS (SELECT vec_id, label, code, error FROM v JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r) USING (r)),
flat AS (SELECT p, e, generate_subscripts(c, 1) AS j, unnest(c) AS y FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM flat) AS codebooks_sha256
FROM coded
"""


OP13_SQL = _op13_sql()


QUERIES = {f.__name__: f for f in (op1_lattice_lm, op2_chat_snapshots, op3_exact_dedup, op4_substring_dedup, op5_packing, op6_bpe, op7_license_scan, op8_pivot_topk, op9_simhash, op10_toxicity, op11_source_divergence, op12_source_mix, op13_vector_codes)}
ORACLES = {"op2_chat_snapshots": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_pivot_topk": OP8_SQL, "op11_source_divergence": OP11_SQL, "op13_vector_codes": OP13_SQL}
