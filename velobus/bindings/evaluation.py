"""Answer scores and retrieval bound to the given tables."""

from pyspark.sql import functions as F

from velobus.bindings.registry import Tables, query, rounded
from velobus.evaluation.retrieval import CoarseIndex, recall, top_k
from velobus.evaluation.scores import bleu, rouge_l, score_answers


def turn_pairs(t: Tables):
    """Every user turn (truth) with the assistant turn that follows it (answer)."""
    turns = t.conversations
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("truth"))
    given = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("c"), F.col("turn").alias("n"), F.col("text").alias("answer")
    )
    same = (F.col("conv_id") == F.col("c")) & (F.col("turn") + 1 == F.col("n"))
    pair = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return asked.join(given, same).select(pair.alias("pair"), "truth", "answer")


PAIRS_SQL = """
pairs AS MATERIALIZED (
  SELECT u.conv_id || '-' || u.turn AS pair, u.text AS truth, a.text AS answer
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE u.role = 'user' AND a.role = 'assistant'),
words AS MATERIALIZED (
  SELECT pair, regexp_extract_all(lower(truth), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]') AS r,
         regexp_extract_all(lower(answer), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]') AS h FROM pairs)
"""

BLEU_SQL = (
    PAIRS_SQL
    + """,
spots AS (
  SELECT pair, 'r' AS side, n, array_to_string(r[i:i + n - 1], ' ') AS gram
  FROM (SELECT pair, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM words, range(1, 5) s(n))
  UNION ALL
  SELECT pair, 'h', n, array_to_string(h[i:i + n - 1], ' ')
  FROM (SELECT pair, h, n, unnest(range(1, len(h) - n + 2)) AS i FROM words, range(1, 5) s(n))),
counted AS (
  SELECT pair, n, gram, count(*) FILTER (side = 'h') AS ch, count(*) FILTER (side = 'r') AS cr
  FROM spots GROUP BY ALL),
precise AS (
  SELECT pair, n, sum(least(ch, cr)) / sum(ch) AS p FROM counted GROUP BY ALL HAVING sum(ch) > 0),
scored AS (
  SELECT pair, count(*) FILTER (p > 0) AS good,
         avg(CASE WHEN p > 0 THEN ln(p) END) AS mean_log FROM precise GROUP BY pair),
bleus AS (
  SELECT pair, CASE WHEN good = 4 THEN exp(mean_log)
               * CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END ELSE 0 END AS bleu
  FROM words LEFT JOIN scored USING (pair))
"""
)


@query("bleu", "WITH " + BLEU_SQL + "SELECT pair, round(coalesce(bleu, 0), 6) AS bleu FROM bleus")
def bleu_of_turns(t: Tables):
    return rounded(bleu(turn_pairs(t), "pair", "truth", "answer"))


# Row by row of the dynamic programme, all pairs at once: the new row is the running maximum of
# "previous diagonal + 1" on a match and of the previous row elsewhere.
ROUGE_SQL = """
lcs(pair, step, j, best) AS (
  SELECT pair, 0, unnest(range(1, len(h) + 1)), 0 FROM words
  UNION ALL
  SELECT pair, step, j, max(candidate) OVER (PARTITION BY pair ORDER BY j)
  FROM (SELECT l.pair, l.step + 1 AS step, l.j,
               CASE WHEN w.h[l.j] = w.r[l.step + 1]
                    THEN coalesce(lag(l.best) OVER (PARTITION BY l.pair ORDER BY l.j), 0) + 1
                    ELSE l.best END AS candidate
        FROM lcs l JOIN words w ON w.pair = l.pair WHERE l.step < len(w.r))),
longest AS (SELECT pair, max(best) AS n FROM lcs GROUP BY pair)
"""


@query(
    "rouge_l",
    "WITH RECURSIVE "
    + PAIRS_SQL
    + ","
    + ROUGE_SQL
    + "SELECT pair, round(coalesce(2.0 * n / nullif(len(r) + len(h), 0), 0), 6) AS rouge_l "
    "FROM words LEFT JOIN longest USING (pair)",
)
def rouge_of_turns(t: Tables):
    return rounded(rouge_l(turn_pairs(t), "pair", "truth", "answer"))


@query(
    "score_answers",
    "WITH RECURSIVE "
    + BLEU_SQL
    + ","
    + ROUGE_SQL
    + """
SELECT pair AS answer_id, ends_with(pair, '-2') AS llm_error,
       CASE WHEN ends_with(pair, '-2') THEN NULL WHEN ends_with(pair, '-4') THEN 1.0
            ELSE round(coalesce(bleu, 0), 6) END AS bleu_score,
       CASE WHEN ends_with(pair, '-2') THEN NULL WHEN ends_with(pair, '-4') THEN 1.0
            ELSE round(2.0 * n / (len(r) + len(h)), 6) END AS rouge_score
FROM words JOIN bleus USING (pair) LEFT JOIN longest USING (pair)
""",
)
def score_new_answers(t: Tables):
    """Turn 2 counts as failed, turn 4 as scored before; only the others are scored."""
    before = F.when(F.col("pair").endswith("-4"), 1.0)
    answers = turn_pairs(t).select(
        F.col("pair").alias("answer_id"),
        F.col("truth").alias("ground_truth"),
        F.col("answer").alias("llm_response"),
        F.col("pair").endswith("-2").alias("llm_error"),
        before.alias("bleu_score"),
        before.alias("rouge_score"),
    )
    return rounded(score_answers(answers).drop("ground_truth", "llm_response"))


NEIGHBOURS = 5


def asked_vectors(t: Tables):
    """Every twentieth vector is a query against all."""
    asked = t.embeddings.where(F.col("vec_id") % 20 == 0)
    return asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


TOP_K_SQL = f"""
WITH ranked AS (
  SELECT q.vec_id AS query, d.vec_id AS doc,
         list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS similarity
  FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)
SELECT query, doc, round(similarity, 6) AS similarity, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS place FROM ranked)
WHERE place <= {NEIGHBOURS}
"""


@query("topk_cosine", TOP_K_SQL)
def topk_cosine(t: Tables):
    """The five vectors closest to each query, among all."""
    return rounded(top_k(t.embeddings, "vec_id", "embedding", asked_vectors(t), NEIGHBOURS))


@query("topk_recall")
def topk_recall(t: Tables):
    """How many of the exact answers the index finds, per query."""
    index = CoarseIndex(t.embeddings, "vec_id", "embedding")
    exact = top_k(t.embeddings, "vec_id", "embedding", asked_vectors(t), NEIGHBOURS)
    return recall(index.top_k(asked_vectors(t), NEIGHBOURS), exact)
