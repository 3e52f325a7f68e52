"""Secrets in texts by patterns and by a battery of randomness tests, in SQL functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.llm.shared import checkpointed

# The kinds asked for, their patterns, what a text must hold for any match to count,
# and the condition on a match m (v: its second group).
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # Runs that are long enough are the matches of the open patterns that are not dropped.
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
NEEDED = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_-]{20}",
}
# Encodings by the first alphabet that holds all characters.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)
# The approximation 26.2.17 of the normal distribution in Abramowitz and Stegun.
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal variable exceeds z."""
    size = F.least(F.abs(z), F.lit(30.0))
    t = 1 / (1 + TAIL[0] * size)
    series = F.lit(0.0)
    for b in reversed(TAIL[1:]):
        series = (series + b) * t
    tail = F.exp(-size * size / 2) * 0.3989422804014327 * series
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-60))


def tested(tokens: DataFrame) -> DataFrame:
    """The column p: how likely a random string of the token's encoding looks so little random.

    Three tests: chi-squared of the characters against a uniform alphabet, the number of runs above
    and below the alphabet's middle, and the serial correlation of neighbours; Fisher's method
    joins their chances.
    """
    fits = F.lit(ALPHABETS[-1])
    for letters in reversed(ALPHABETS[:-1]):
        escaped = letters.replace("-", r"\-")
        fits = F.when(F.col("core").rlike(f"^[{escaped}]+$"), letters).otherwise(fits)
    tokens = tokens.withColumn("core", F.regexp_replace("token", "=+$", "")).withColumn("alphabet", fits)
    tokens = tokens.withColumns({"n": F.length("core").cast("double"), "k": F.length("alphabet").cast("double")})
    squares = "aggregate(sequence(1, int(k)), 0D, (s, i) -> s + pow(n - length(replace(core, substring(alphabet, i, 1), '')), 2))"
    bits = "translate(core, alphabet, concat(repeat('0', int(k) div 2), repeat('1', int(k) - int(k) div 2)))"
    tokens = tokens.withColumns({"squares": F.expr(squares), "bits": F.expr(bits), "v": F.expr("transform(regexp_extract_all(core, '.', 0), c -> double(instr(alphabet, c)))")})
    tokens = tokens.withColumns({"ones": F.length(F.regexp_replace("bits", "0", "")).cast("double"), "mean": F.expr("aggregate(v, 0D, (s, x) -> s + x) / n")})
    tokens = tokens.withColumns(
        {
            "runs": F.expr("1 + (n - length(replace(bits, '01', ''))) / 2 + (n - length(replace(bits, '10', ''))) / 2"),
            "pairs": F.expr("2 * ones * (n - ones)"),
            "spread": F.expr("aggregate(v, 0D, (s, x) -> s + pow(x - mean, 2))"),
            "joint": F.expr("aggregate(zip_with(slice(v, 1, int(n) - 1), slice(v, 2, int(n) - 1), (a, b) -> (a - mean) * (b - mean)), 0D, (s, x) -> s + x)"),
        }
    )
    n, k = F.col("n"), F.col("k")
    free = k - 1
    uniform = upper_tail((F.cbrt(F.greatest(F.col("squares") * k / n - n, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    variance = F.col("pairs") * (F.col("pairs") - n) / (n * n * (n - 1))
    runs = F.when(variance > 0, 2 * upper_tail(F.abs(F.col("runs") - 1 - F.col("pairs") / n) / F.sqrt(variance))).otherwise(F.lit(1e-60))
    serial = F.when(F.col("spread") > 0, 2 * upper_tail(F.abs((F.col("joint") / F.col("spread") + 1 / n) * F.sqrt(n)))).otherwise(F.lit(1e-60))
    half = -F.log(uniform * 1.0) - F.log(F.least(runs, F.lit(1.0))) - F.log(F.least(serial, F.lit(1.0)))
    return tokens.withColumn("half", half).withColumn("p", F.greatest(F.expr("exp(-half) * (1 + half + half * half / 2)"), F.lit(1e-60)))


def random_tokens(tokens: DataFrame, rate: float) -> DataFrame:
    """The tokens that randomness tests can't tell from random keys.

    Within each class of lengths (doubling from 20 on), a token is dismissed as ordinary by the
    Benjamini-Hochberg rule at ``rate``: of the dismissed, at most that share is expected to be
    random after all. The rule needs only the number of tokens per class and tenth of a decade of
    p, rounded up: a small table, whatever the number of tokens.
    """
    tokens = checkpointed(tested(tokens).select("id", "start", "end", F.floor(F.log2(F.col("n") / 20 + 1e-9)).alias("class"), F.floor(-10 * F.log10("p")).alias("step")))
    counts = tokens.groupBy("class", "step").count()
    above = Window.partitionBy("class").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"upto": F.sum("count").over(above), "all": F.sum("count").over(Window.partitionBy("class"))})
    limits = counts.where(F.pow(F.lit(10.0), -F.col("step") / 10) <= rate * F.col("upto") / F.col("all")).groupBy("class").agg(F.min("step").alias("limit"))
    # One row per class of lengths: fewer than 40.
    return tokens.join(F.broadcast(limits), "class", "left").where("limit IS NULL OR step < limit").select("id", "start", "end")


def found_secrets(docs: DataFrame, rate: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``.

    Assignments of 8 characters or more, access keys of 16, hexadecimal runs of 32, each kind
    leftmost and without overlaps; and as kind ``random``, runs of 20 or more characters of an
    encoding, with letters and digits, that pass for random. Spans are kind:start:end in code
    points, the end excluded, by start and kind, and may overlap across kinds.

    Positions are sums of the lengths of matches and of what lies between them; a window over one
    row's matches adds them up. Null and blank texts have no spans. Rows that repeat an id are rows
    of their own. An empty table gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    columns = {}
    for kind in KINDS:
        quoted = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
        good = {"assign": f"length(regexp_extract(m, '{quoted}', 2)) >= 8", "random": "m rlike '[0-9]' AND m rlike '[A-Za-z]'"}.get(kind, "true")
        token = "m" if kind == "random" else "cast(null AS string)"
        split = f"split(text, '{quoted}', -1)"
        pieces = f"zip_with(slice({split}, 1, size({split}) - 1), regexp_extract_all(text, '{quoted}', 0), (g, m) -> struct(length(g) AS gap, length(m) AS len, {good} AS good, {token} AS token))"
        columns[kind] = F.when(F.col("text").rlike(NEEDED[kind]), F.expr(pieces))
    rows = rows.withColumns(columns).select(F.monotonically_increasing_id().alias("id"), "doc_id", *KINDS)
    rows = checkpointed(rows)
    empty = "cast(array() AS array<struct<gap:int,len:int,good:boolean,token:string>>)"
    lists = [F.expr(f"transform(coalesce(`{k}`, {empty}), (m, i) -> struct({n} AS kind, i AS place, m.gap, m.len, m.good, m.token))") for n, k in enumerate(KINDS)]
    matches = rows.where(" OR ".join(f"{k} IS NOT NULL" for k in KINDS)).select("id", F.explode(F.concat(*lists)).alias("m")).select("id", "m.*")
    reach = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("id", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = checkpointed(matches.withColumn("end", reach).withColumn("start", F.col("end") - F.col("len")).where("good").select("id", "kind", "start", "end", "token"))
    added = random_tokens(spans.where(f"kind = {KINDS.index('random')}"), rate).withColumn("kind", F.lit(KINDS.index("random")))
    chosen = spans.where(f"kind < {KINDS.index('random')}").select("id", "start", "kind", "end").union(added.select("id", "start", "kind", "end"))
    per_row = chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    out = rows.select("id", "doc_id").join(per_row, "id", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>)")))
    names = ", ".join(f"'{k}'" for k in KINDS)
    said = f"x -> concat_ws(':', array({names})[x.kind], x.start, x.end)"
    count = lambda n: f"cast(size(filter(s, x -> x.kind = {n})) AS bigint) AS n_{KINDS[n]}"
    base = f"array_join(transform(filter(s, x -> x.kind < {KINDS.index('random')}), {said}), ',')"
    return out.selectExpr("doc_id", *[count(n) for n in range(3)], f"sha2({base}, 256) AS base_sha256", f"array_join(transform(s, {said}), ',') AS spans")
