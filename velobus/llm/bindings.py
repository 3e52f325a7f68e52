"""The operators applied to the given tables, each with its oracle where SQL can express it."""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.bindings.registry import Tables
from velobus.llm import (
    archives,
    hadamard,
    linkgraph,
    lpt,
    oneperm,
    periodic,
    pfair,
    secrets,
    suffixes,
    superminhash,
    templates,
    toxicity,
    treebpe,
)

QUERIES, ORACLES = {}, {}


def query(key: str, sql: str | None = None):
    def register(build):
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


@query("op1_superminhash_dedup")
def op1(t: Tables) -> DataFrame:
    return superminhash.near_duplicates(t.documents)


@query("op2_oneperm_fingerprints")
def op2(t: Tables) -> DataFrame:
    return oneperm.fingerprinted(t.documents)


@query(
    "op3_arc_to_warc",
    """
    WITH given AS (
      SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    digests AS (
      SELECT page_id, strlen(html) AS payload_bytes, hex,
             list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, CAST(5 * i // 4 AS INT) + 1, 2))::INT >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1, 1)),
               'string_agg', '') AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first
      FROM given)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM digests
    """,
)
def op3(t: Tables) -> DataFrame:
    return archives.archived(t.pages)


@query("op4_randomness_secrets")
def op4(t: Tables) -> DataFrame:
    return secrets.found_secrets(t.documents)


@query("op5_nnpu_toxicity")
def op5(t: Tables) -> DataFrame:
    return toxicity.toxicity(t.documents, t.labels)


@query("op6_lpt_shards")
def op6(t: Tables) -> DataFrame:
    return lpt.sharded(t.documents)


@query("op7_template_decontamination")
def op7(t: Tables) -> DataFrame:
    return templates.contaminated(t.documents, t.benchmark)


@query("op8_linkgraph_urls")
def op8(t: Tables) -> DataFrame:
    return linkgraph.judged(t.pages)


@query("op9_pfair_mixing")
def op9(t: Tables) -> DataFrame:
    return pfair.mixed(t.documents)


@query("op10_suffix_passages")
def op10(t: Tables) -> DataFrame:
    return suffixes.without_repeats(t.documents)


PERIODIC_SQL = """
WITH hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(
             range(1, length(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))) AS h
  FROM documents),
split AS (
  SELECT r, doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM hashed),
placed AS (
  SELECT r, doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a,
         CASE WHEN h % 10 = 0 AND len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) END AS p
  FROM split),
edited AS MATERIALIZED (
  SELECT r, doc_id, list_transform(range(len(w)), lambda i: w[CASE WHEN i < a OR a IS NULL THEN i ELSE a + (i - a) % p END + 1]) AS w
  FROM placed),
words AS MATERIALIZED (
  SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM edited),
pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
islands AS (
  SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM pairs),
stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island
  HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
found AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shapes,
         min(struct_pack(l := -length, s := start, p := period)) AS best
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period,
       1000 * -best.l // best.p AS exponent_milli, sha256(coalesce(shapes, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM edited LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document by the checksum of its id repeats a stretch of its own words to its end."""

    def planted(words):
        n = F.size(words)
        a = (F.col("_g") % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # One word list per text: a lambda's argument is evaluated once, however often it is used.
    edited = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(""))[0]
    hashed = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string"))).withColumn("_g", F.floor(F.col("_h") / 10))
    return hashed.select("doc_id", F.when(F.col("_h") % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", PERIODIC_SQL)
def op11(t: Tables) -> DataFrame:
    found = periodic.without_periods(with_planted_periods(t.documents))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    shapes = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(shapes, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_tree_bpe")
def op12(t: Tables) -> DataFrame:
    coded = treebpe.encoded(t.documents, public_tokenizers.path("word_bpe_49k.json"), packed=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def clustering_sql(k: int, rounds: int) -> str:
    """Every round spelled out: whole-number distances to the centroids, then their floored means."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c
  FROM kept QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k})"""
    for n in range(rounds + 1):
        out += f""",
near{n} AS MATERIALIZED (
  SELECT r, vec_id, v, min(struct_pack(d := {distance}, k := cluster)) AS best
  FROM kept, c{n} GROUP BY ALL)"""
        if n < rounds:
            out += f""",
sums{n} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT best.k AS cluster, unnest(range(64)) AS i, unnest(v) AS x FROM near{n}) GROUP BY ALL),
means{n} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM sums{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{n} LEFT JOIN means{n} USING (cluster))"""
    return out + f"""
SELECT vec_id, best.k::INT AS cluster, best.d AS distance,
       sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} ON best.k = cluster
"""


@query("op13_hadamard_clusters", clustering_sql(40, 5))
def op13(t: Tables) -> DataFrame:
    return hadamard.clustered(t.embeddings)
