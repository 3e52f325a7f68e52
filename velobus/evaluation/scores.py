"""BLEU and ROUGE-L of free-text answers against their ground truth."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velobus.schemas import ANSWERS_TABLE
from velobus.sinks.keyed import KeyedTable
from velobus.sources.tables import unscored_answers, unscored_condition

# Fixed value: a token is a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MAX_N = 4


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _grams(side: str, words: str, n: int) -> Column:
    """The n-grams of a token array as structs of (n, side, text)."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    joined = F.transform(
        starts,
        lambda i: F.struct(
            F.lit(n).alias("n"),
            F.lit(side).alias("side"),
            F.concat_ws(" ", F.slice(words, i, F.lit(n))).alias("gram"),
        ),
    )
    empty = F.array().cast("array<struct<n:int,side:string,gram:string>>")
    return F.when(F.size(words) >= n, joined).otherwise(empty)


def bleu(pairs: DataFrame, id_col: str, reference: str, hypothesis: str) -> DataFrame:
    """(id, bleu): four-gram BLEU with uniform weights, no smoothing, brevity penalty.

    The texts are shuffled once by id; n-grams are built and counted behind that exchange, so
    what crosses the network is the text and not its many times larger n-gram list.
    """
    # A given number of partitions: the planner would merge them by the size of the texts, but
    # the work behind the exchange is that of the n-grams.
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs.select(
        id_col, F.col(reference).alias("reference"), F.col(hypothesis).alias("hypothesis")
    ).repartition(width, id_col)
    worded = placed.select(
        id_col, tokens(F.col("reference")).alias("r"), tokens(F.col("hypothesis")).alias("h")
    )
    sized = worded.withColumns({"r_size": F.size("r"), "h_size": F.size("h")})
    grams = F.concat(
        *[_grams("h", "h", n) for n in range(1, MAX_N + 1)],
        *[_grams("r", "r", n) for n in range(1, MAX_N + 1)],
    )
    # explode_outer keeps pairs without any token.
    flat = sized.select(id_col, "r_size", "h_size", F.explode_outer(grams).alias("g"))
    per_gram = flat.groupBy(id_col, "r_size", "h_size", "g.n", "g.gram").agg(
        F.count_if(F.col("g.side") == "h").alias("in_h"),
        F.count_if(F.col("g.side") == "r").alias("in_r"),
    )
    matched = F.least("in_h", "in_r")
    per_pair = per_gram.groupBy(id_col, "r_size", "h_size").agg(
        *[F.sum(F.when(F.col("n") == n, matched)).alias(f"m{n}") for n in range(1, MAX_N + 1)]
    )
    hits = [F.coalesce(f"m{n}", F.lit(0)) for n in range(1, MAX_N + 1)]
    totals = [F.greatest(F.col("h_size") - (n - 1), F.lit(1)) for n in range(1, MAX_N + 1)]
    logs = [F.log(F.nullif(h, F.lit(0)) / t) for h, t in zip(hits, totals)]
    mean_log = reduce(lambda a, b: a + b, logs) / MAX_N
    short = F.least(F.lit(0.0), 1 - F.try_divide(F.col("r_size"), F.col("h_size")))
    score = F.when((F.col("r_size") == 0) | (F.col("h_size") == 0), 0.0).otherwise(
        F.coalesce(F.exp(mean_log + short), F.lit(0.0))
    )
    return per_pair.select(id_col, score.alias("bleu"))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, one bit per token of ``a``."""
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")


def rouge_l_score(reference: Column, hypothesis: Column) -> Column:
    """F-measure of the longest common token subsequence, computed in the row."""
    r, h = tokens(reference), tokens(hypothesis)
    return F.coalesce(F.try_divide(2.0 * _lcs(r, h), F.size(r) + F.size(h)), F.lit(0.0))


def rouge_l(pairs: DataFrame, id_col: str, reference: str, hypothesis: str) -> DataFrame:
    """(id, rouge_l); no shuffle."""
    score = rouge_l_score(F.col(reference), F.col(hypothesis))
    return pairs.select(id_col, score.alias("rouge_l"))


def score_answers(answers: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """A new snapshot of the answers table: unscored answers without error get their scores,
    blank texts keep null scores, all other rows pass unchanged."""

    def present(c):
        return F.coalesce(F.regexp_like(c, F.lit(r"\S")), F.lit(False))

    pending = F.coalesce(unscored_condition(), F.lit(False))
    texts = F.col("ground_truth"), F.col("llm_response")
    both = present("ground_truth") & present("llm_response")
    todo = answers.where(pending & both)
    bleus = bleu(todo, id_col, "ground_truth", "llm_response").withColumnRenamed(id_col, "_id")
    scored = todo.withColumn("rouge_score", rouge_l_score(*texts)).join(
        bleus, F.col(id_col) == F.col("_id")
    )
    filled = scored.withColumn("bleu_score", F.col("bleu")).select(*answers.columns)
    blank = answers.where(pending & ~both).withColumns(
        {c: F.lit(None).cast("double") for c in ("bleu_score", "rouge_score")}
    )
    return answers.where(~pending).unionByName(blank).unionByName(filled)


def record_answers(questions: DataFrame, answers: DataFrame, run_time: Column) -> DataFrame:
    """Evaluation records: asked questions with their truth, joined to the answers that came in
    (question_key, value, llm_response, response_time_ms, llm_error, llm_error_message)."""
    given = answers.select(
        F.col("question_key").alias("_key"),
        F.col("value").alias("_value"),
        "llm_response",
        "response_time_ms",
        "llm_error",
        "llm_error_message",
    )
    same = (F.col("question_key") == F.col("_key")) & F.col("value").eqNullSafe(F.col("_value"))
    return questions.join(given, same).select(
        run_time.alias("timestamp"),
        "question_key",
        "question_text",
        "ground_truth",
        F.coalesce("llm_response", F.lit("")).alias("llm_response"),
        "response_time_ms",
        F.coalesce("llm_error", F.lit(False)).alias("llm_error"),
        "llm_error_message",
        F.lit(None).cast("double").alias("bleu_score"),
        F.lit(None).cast("double").alias("rouge_score"),
    )


ANSWER_KEY = ("timestamp", "question_key", "question_text")


def answers_table(spark, root: str) -> KeyedTable:
    """The recorded answers; scoring appends the scored rows as a delta."""
    return KeyedTable(spark, root, ANSWERS_TABLE, ANSWER_KEY)


def score_cycle(table: KeyedTable) -> int:
    """Score what the newest state of the table lacks, append it, and return the table's version.

    Two cycles at once append the same scores; answers recorded meanwhile are left for the next.
    """
    answers = table.read()
    todo = unscored_answers(answers).withColumn("answer_id", F.to_json(F.struct(*ANSWER_KEY)))
    scored = score_answers(todo).where("bleu_score IS NOT NULL AND rouge_score IS NOT NULL")
    return table.append(scored.select(*answers.columns))
