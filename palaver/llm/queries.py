"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BPE_FILE = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict, dict]:
    """All queries of the subpackage, the pipeline included."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
    return QUERIES, ORACLES


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_bpe")
def op3(spark, sf):
    """Encode and decode all documents; digests of both."""
    from palaver.llm import bpe

    path = public_tokenizers.path(BPE_FILE)
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# The five rules of the query, as its contract states them.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
URL_SQL = r"""
WITH rules(rhost, rpath, action) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'),
  ('net','/es/','block'), ('net','/fr/','block')),
parts AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS verdict
  FROM split, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
"""


@query("op4_url_filter", URL_SQL)
def op4(spark, sf):
    """Judge all page urls by the five rules."""
    from palaver.llm import urlfilter

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.judge(_read(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op5_pack")
def op5(spark, sf):
    """Pack all documents into sequences of 1024 tokens."""
    from palaver.llm import packing

    done = packing.pack(_read(spark, sf, "documents"), public_tokenizers.path(BPE_FILE), digest=True)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op6_gif")
def op6(spark, sf):
    """Store all documents as GIF samples, read them back."""
    from palaver.llm import gif

    media = gif.store(_read(spark, sf, "documents"))
    done = gif.features(media.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")))
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)
"""


@query("op7_warc", WARC_SQL)
def op7(spark, sf):
    """Write all pages as WARC records and read the archives back."""
    from palaver.llm import warc

    return warc.records(warc.write(_read(spark, sf, "pages")))


PII_KINDS = ("email", "ip", "card", "phone")


@query("op9_pii")
def op9(spark, sf):
    """Spans of personal data and of disclosing words in all documents."""
    from palaver.llm import pii

    found = pii.find(_read(spark, sf, "documents").select("doc_id", "text"), keep_text=False)
    kinds = F.array(*map(F.lit, PII_KINDS))
    base = F.array_join(F.transform("base", lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",")
    terms = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"])), ",")
    every = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(every) - F.size(F.array_remove(every, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(PII_KINDS)]
    spans = F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("terms") > 0, terms))
    return found.select("doc_id", *counts, F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"))


@query("op2_embedding_neardup")
def op2(spark, sf):
    """Links and components of all embeddings at cosine 0.9."""
    from palaver.llm import neardup

    return neardup.near_duplicates(_read(spark, sf, "embeddings"))


@query("op1_quality")
def op1(spark, sf):
    """Quality scores of all documents."""
    from palaver.llm import quality

    scored = quality.scores(_read(spark, sf, "documents"), _read(spark, sf, "labels"))
    return scored.select("doc_id", quality.held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_lm_score")
def op8(spark, sf):
    """Language-model and base scores of all documents."""
    from palaver.llm import lm

    return lm.scores(_read(spark, sf, "documents"))


@query("op10_ngram_jaccard")
def op10(spark, sf):
    """Near-duplicate classes of all documents."""
    from palaver.llm import jaccard

    return jaccard.near_duplicates(_read(spark, sf, "documents"))


@query("op11_shard")
def op11(spark, sf):
    """Deal all documents to 16 shards of near equal bytes."""
    from palaver.llm import sharding

    done = sharding.shard(_read(spark, sf, "documents"), shards=16)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII string in DuckDB, with the table column ``crc_table`` at hand."""
    return (
        f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),"
        " lambda acc, b: xor(acc >> 8, crc_table[(xor(acc, b) & 255) + 1])))"
    )


CRC_TABLE_SQL = """(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(i)))"""


def _sql_tree(name: str, base: str, levels: int) -> str:
    """CTEs of a tree of at most 16 ** levels nodes a group over ``base`` (g, i, h): nodes per level with their siblings."""
    out = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM {base})"]
    for k in range(levels):
        run = "OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}_w{k} AS (SELECT g, i, c > 1 AS live, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (SELECT g, i // 16 AS i,"
            f" CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 16))"
        )
    return ",\n".join(out)


def _merkle_sql(levels: int = 5, top_levels: int = 4) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** top_levels sources."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [("a", k, "a.i") for k in range(levels)] + [("b", k, "b0.i") for k in range(top_levels)]
    joins = " ".join(f"JOIN {t}_w{k} AS {t}x{k} ON {t}x{k}.g = {'a.g' if t == 'a' else chr(39) * 2} AND {t}x{k}.i = {at} // {16 ** k}" for t, k, at in steps)
    proof = " || ".join(f"CASE WHEN {t}x{k}.live THEN {t}x{k}.l || {t}x{k}.r ELSE '' END" for t, k, _ in steps)
    ctes, now = [], "start"
    # one CTE per step, so that the expression does not double
    for n, (t, k, _) in enumerate(steps):
        ctes.append(f"f{n} AS (SELECT * REPLACE (CASE WHEN live[{n + 1}] THEN sha256(l[{n + 1}] || f || r[{n + 1}]) ELSE f END AS f) FROM {now})")
        now = f"f{n}"
    lists = ", ".join(f"[{', '.join(f'{t}x{k}.{c}' for t, k, _ in steps)}] AS {c}" for c in ("live", "l", "r"))
    return f"""
WITH crc AS (SELECT {CRC_TABLE_SQL} AS crc_table),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS h,
  CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lowered)} END AS changed FROM documents, crc),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_sql_tree("a", "a", levels)},
subroots AS (SELECT g, h FROM a{levels}),
b AS (SELECT '' AS g, g AS source_g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM subroots),
{_sql_tree("b", "b", top_levels)},
start AS (SELECT a.doc_id, a.h AS leaf, b0.h AS subroot, (SELECT h FROM b{top_levels}) AS root, sha256({proof}) AS proof_sha256, coalesce(a.changed, a.h) AS f, {lists}
  FROM a JOIN b AS b0 ON b0.source_g = a.g {joins}),
{", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {now}
"""


@query("op13_merkle", _merkle_sql())
def op13(spark, sf):
    """Witnesses of all documents in a manifest, folded with a fifth of the texts changed."""
    from palaver.llm import merkle

    def changed(docs: DataFrame) -> dict:
        lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
        return {"changed": F.when(hit, merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS]))}

    done = merkle.manifest(_read(spark, sf, "documents"), carry=changed)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("witness"))
    out = done.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("witness")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_spelling")
def op12(spark, sf):
    """Spelling variants among the words of all documents."""
    from palaver.llm import spelling

    return spelling.variants(_read(spark, sf, "documents"))
