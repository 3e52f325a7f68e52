"""URL verdicts by rules, and by trust and distrust that spread over the graph of hosts."""

import itertools
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velobus.llm.shared import stored

# The rules the query is asked to apply: action, host and path as one string.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# The host of a link that names one; links within a site name none.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """What lies between the first :// and the next /, ?, # in lower case, and from there to ?, #."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return lowered(F.regexp_extract(after, "^[^/?#]*", 0)), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def decision(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its action (null where none does)."""
    found, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found, action = F.when(fits, rule).otherwise(found), F.when(fits, verdict).otherwise(action)
    return found, action


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(a, b, weight): links between hosts, summed, and one edge each way between a host and the
    domain it is a part of."""
    links = pages.select("host", F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select(F.col("host").alias("a"), lowered(F.col("to")).alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    hosts = links.select(F.col("b").alias("host")).union(pages.select("host")).distinct()
    # a.b.c.d is part of b.c.d, that of c.d; single labels join nothing.
    labels = F.split("host", r"\.")
    steps = F.expr("transform(sequence(0, size(labels) - 3), k -> struct(array_join(slice(labels, k + 1, size(labels)), '.') AS a, array_join(slice(labels, k + 2, size(labels)), '.') AS b))")
    parts = hosts.withColumn("labels", labels).where("size(labels) > 2").select(F.explode(steps).alias("e")).select("e.a", "e.b").distinct()
    both = parts.union(parts.select("b", "a")).withColumn("weight", F.lit(1.0))
    return links.union(both.toDF("a", "b", "weight")).where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _moving(before: DataFrame, after: DataFrame, tolerance: float) -> int:
    """How many ranks are new or have changed by more than ``tolerance`` of themselves."""
    pairs = after.join(before.withColumnRenamed("rank", "was"), ["way", "x"], "left")
    moved = F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > F.col("rank") * tolerance)
    return pairs.agg(F.count_if(moved)).first()[0]


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = 12, tolerance: float = 1e-3) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from seeds (host, trust, distrust).

    Trust follows the edges from the hosts it is given to, distrust runs against them: who links to
    a bad host is suspect. Both are ranks of one walk over doubled nodes. A host without further
    edges keeps what it has to itself.

    After so many rounds it ends, or, with ``rounds`` null, once four rounds have reached no further
    host and changed no host's trust or distrust by more than ``tolerance`` of itself. A chain of
    hosts takes as many rounds as it has links, and about 40 more.
    """
    walk = edges.select(F.lit(0).alias("way"), F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(edges.select(F.lit(1), "b", "a", "weight"))
    total = walk.groupBy("way", "x").agg(F.sum("weight").alias("total"))
    walk = stored(walk.join(total, ["way", "x"]).select("way", "x", "y", (F.col("weight") / F.col("total")).alias("share")))
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    start = seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), (F.col("trust") / (sums.t or 1.0)).alias("rank")), F.struct(F.lit(1).alias("way"), (F.col("distrust") / (sums.d or 1.0)).alias("rank")))).alias("s"), F.col("host").alias("x"))
    start = stored(start.select("s.way", "x", "s.rank").where("rank > 0"))
    rank = before = start
    for k in itertools.count() if rounds is None else range(rounds):
        moved = walk.join(rank, ["way", "x"]).select("way", F.col("y").alias("x"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        # Stored every round: the next one reads small files in few tasks, whatever the partitions.
        rank = stored(moved.union(start.withColumn("rank", F.col("rank") * (1 - damping))).groupBy("way", "x").agg(F.sum("rank").alias("rank")))
        if rounds is None and k % 4 == 3:
            if not _moving(before, rank, tolerance):
                break
            before = rank
    of = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("rank"))), F.lit(0.0))
    return rank.groupBy(F.col("x").alias("host")).agg(of(0).alias("trust"), of(1).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    The longest fitting rule decides. The pages that rules allow or block make their hosts seeds of
    trust or distrust, by their number; where no rule fits, a page is blocked if distrust is more
    than ``limit`` of its host's trust and distrust together, and else allowed. Both spread until
    four rounds move no host's by more than ``tolerance`` of itself, unless ``rounds`` are given.

    ``rules`` are a configuration list, looked up in order. A null url, or one without ://, has an
    empty host and path; an empty host fits no rule, has no edges and is allowed. Null html has no
    links. Repeated rows are judged alike and count again; an empty table gives an empty result;
    other columns are ignored.
    """
    host, path = host_and_path("url")
    rule, action = decision(rules)
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"host": host, "path": path})
    known = known.withColumns({"rule": rule, "action": action})
    seeds = known.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").cast("double").alias("trust"), F.count_if(F.col("action") == "block").cast("double").alias("distrust"))
    edges = stored(host_edges(known))
    scores = propagated(edges, stored(seeds.where("trust + distrust > 0")), damping, rounds, tolerance)
    bad = scores.where(F.col("distrust") > limit * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("spread"))
    out = known.select("page_id", "host", "path", "rule", "action").join(stored(bad), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))
