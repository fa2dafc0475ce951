"""The queries of the subpackage's operators, with SQL where it can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def TOKENIZER() -> str:
    """The vocabulary file's path; the executors have the same public package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark, sf_dir):
    from .linededup import dedup_lines

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), TOKENIZER())


def op6_pii(spark, sf_dir):
    from .pii import pseudonymise

    # a deployment sets its key, so that values stay linked between runs; else a run has one of its own
    key = spark.conf.get("spark.quillspark.pii.key", None) or secrets.token_hex(32)
    return pseudonymise(read(spark, sf_dir, "documents"), key)


def op10_licenses(spark, sf_dir):
    from .licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    from .suffixdedup import dedup

    return dedup(read(spark, sf_dir, "documents")).drop("kept")


def op8_language_id(spark, sf_dir):
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    from .kneserney import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    from .embedrange import link

    return link(read(spark, sf_dir, "embeddings"))


def op3_decontamination(spark, sf_dir):
    from .decontam import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    from .tokenbits import round_trip

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_periodic_runs(spark, sf_dir):
    from .periodicruns import runs

    return runs(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    from .vectorcodes import compress

    return compress(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_lm_scoring, op4_embedding_dedup, op3_decontamination, op5_packing, op6_pii, op7_suffix_dedup, op8_language_id, op9_simhash, op10_licenses, op11_token_files, op12_periodic_runs, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id""",
}


def _codes_sql(rounds: int = 4) -> str:
    """Rounds unrolled: b0 to b4 are the codebooks (pos, entry, c), a1 to a5 the distinct parts' entries."""
    near = """a{k} AS MATERIALIZED (SELECT p.pos, p.c, p.n, arg_min(b.entry, {d} * 256 + b.entry) AS entry, min({d}) AS error FROM p JOIN b{j} b ON b.pos = p.pos GROUP BY ALL)"""
    distance = "list_aggregate(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')::BIGINT"
    step = """s{k} AS (SELECT pos, entry, i, floor(sum(c[i] * n)::DOUBLE / sum(n))::BIGINT AS m FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(c)) + 1 FROM p))) AS i) GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM b{j} b LEFT JOIN (SELECT pos, entry, list(m ORDER BY i) AS c FROM s{k} GROUP BY ALL) m ON m.pos = b.pos AND m.entry = b.entry)"""
    rows = ",\n".join(near.format(k=k, j=k - 1, d=distance) + ",\n" + step.format(k=k, j=k - 1) for k in range(1, rounds + 1))
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, vec_id, label, pos, v[pos * len(v) // 4 + 1 : (pos + 1) * len(v) // 4] AS c FROM w, (SELECT unnest(range(4)) AS pos)),
p AS MATERIALIZED (SELECT pos, c, count(*) AS n FROM e GROUP BY ALL),
b0 AS MATERIALIZED (SELECT pos, entry, c FROM (SELECT pos, c, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry FROM e) WHERE entry < 256),
{rows},
{near.format(k=rounds + 1, j=rounds, d=distance)},
t AS (SELECT r, vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY e.pos) AS code, sum(error)::BIGINT AS error FROM e JOIN a{rounds + 1} a ON a.pos = e.pos AND a.c = e.c GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY pos, entry)) FROM b{rounds}) AS codebooks_sha256 FROM t"""


ORACLE_SQL["op13_vector_codes"] = _codes_sql()
