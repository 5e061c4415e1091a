"""URL filters: rules on host and path, and a character language-model ratio for URLs that no rule fits.

Two smoothed variable-order Markov models (contexts of two, one and no characters, blended by Witten-Bell weights) are
counted over all accepted and all rejected URLs. A URL's score is the mean log-likelihood difference of its characters;
the threshold is calibrated on the labelled URLs, between the class means in units of their deviations.

DataFrame functions only. Characters are folded to a fixed alphabet, so a model has at most ALPHABET^3 cells; that table
is what is broadcast, whatever the number of URLs.

A null url, or one without ``://``, has an empty host and path; its score is 0. Without labelled URLs of both classes the
threshold is 0. A score at the threshold or above is allowed. Repeated rows give repeated rows and count repeatedly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Start mark, letters, any digit, the marks of URLs, anything else.
SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0./-_:?=&%#@+~"
ALPHABET = len(SYMBOLS)
ORDER = 2

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def folded(url: Column) -> Column:
    """The URL in the model's alphabet, start marks before it."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789^", LOWER + "000000000~")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(low, r"(?s)[^a-z0./\-_:?=&%#@+]", "~"))


def cells(urls: DataFrame) -> DataFrame:
    """One row for each character of each url: its cell (two characters of context and itself) as a number."""
    code = F.transform(F.split(F.col("folded"), ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    cell = lambda k: (F.get(F.col("codes"), k) * ALPHABET + F.get(F.col("codes"), k + 1)) * ALPHABET + F.get(F.col("codes"), k + 2)
    coded = urls.withColumn("codes", F.filter(code, lambda c: c >= 0))
    places = F.when(F.size("codes") > ORDER, F.sequence(F.lit(0), F.size("codes") - (ORDER + 1))).otherwise(F.array().cast("array<int>"))
    return coded.withColumn("cell", F.explode(F.transform(places, cell))).drop("codes", "folded")


def model(labelled: DataFrame) -> DataFrame:
    """(cell, ratio) of every cell: log-likelihood under the accepted model less that under the rejected one.

    ``labelled`` has folded and verdict. Counts cover all rows, summed where they lie before they are shuffled; what
    follows has ALPHABET^3 rows.
    """
    counts = cells(labelled).groupBy("cell").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    grid = labelled.sparkSession.range(ALPHABET**3).select(F.col("id").cast("int").alias("cell"))
    grid = grid.join(counts, "cell", "left").fillna(0, ["allow", "block"])
    grid = grid.select("cell", "allow", "block", F.floor(F.col("cell") / ALPHABET).alias("ab"), (F.col("cell") % ALPHABET**2).alias("bs"), (F.floor(F.col("cell") / ALPHABET) % ALPHABET).alias("b"), (F.col("cell") % ALPHABET).alias("s"))
    for kind in ("allow", "block"):
        grid = grid.withColumn(f"{kind}_bs", F.sum(kind).over(Window.partitionBy("bs")))
    for kind in ("allow", "block"):
        two, one = Window.partitionBy("ab"), Window.partitionBy("b")
        grid = (
            grid.withColumn(f"{kind}_ab", F.sum(kind).over(two))
            .withColumn(f"{kind}_kinds_ab", F.count_if(F.col(kind) > 0).over(two))
            .withColumn(f"{kind}_b", F.sum(kind).over(one))
            # every (b, s) stands in the grid once for each a
            .withColumn(f"{kind}_kinds_b", F.count_if(F.col(f"{kind}_bs") > 0).over(one) / ALPHABET)
        )
    for kind in ("allow", "block"):
        grid = grid.withColumn(f"{kind}_s", F.sum(kind).over(Window.partitionBy("s")))
    total = grid.groupBy("s").agg(F.max("allow_s").alias("allow"), F.max("block_s").alias("block")).agg(*[f(k).alias(f"{k}_{n}") for k in ("allow", "block") for n, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))])
    grid = grid.join(F.broadcast(total), F.lit(True))  # one row

    def log_probability(kind: str) -> Column:
        none = (F.col(f"{kind}_s") + F.col(f"{kind}_kinds") / ALPHABET + 1.0 / ALPHABET) / (F.col(f"{kind}_all") + F.col(f"{kind}_kinds") + 1.0)
        one = blend(F.col(f"{kind}_bs"), F.col(f"{kind}_b"), F.col(f"{kind}_kinds_b"), none)
        return F.ln(blend(F.col(kind), F.col(f"{kind}_ab"), F.col(f"{kind}_kinds_ab"), one))

    return grid.select("cell", (log_probability("allow") - log_probability("block")).alias("ratio"))


def blend(count: Column, context: Column, kinds: Column, shorter: Column) -> Column:
    """Witten-Bell: the more kinds of successors a context has had, the more the shorter context counts."""
    return F.when(context > 0, (count + kinds * shorter) / (context + kinds)).otherwise(shorter)


def scored(urls: DataFrame, ratios: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and score (mean ratio) of every row; the rows of a url are summed in the task that made them."""
    keyed = urls.select(F.monotonically_increasing_id().alias("row"), *kept, "folded")
    means = cells(keyed).join(F.broadcast(ratios), "cell").groupBy("row", *kept).agg(F.round(F.avg("ratio"), 9).alias("score"))
    empty = keyed.filter(F.length("folded") <= ORDER).select("row", *kept, F.lit(0.0).alias("score"))
    return means.unionByName(empty)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, score, threshold, verdict of every row."""
    url = pages[url_col].cast("string")
    host, path = host_and_path(url)
    base = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"), url.alias("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), folded(F.col("url")).alias("folded"))
    labelled = base.filter("ruled IS NOT NULL").select(F.col("ruled").alias("verdict"), "folded")
    ratios = model(labelled)
    allow, block = F.col("verdict") == "allow", F.col("verdict") == "block"
    score = F.col("score")
    spread = lambda kind: F.greatest(F.coalesce(F.stddev_pop(F.when(kind, score)), F.lit(0.0)), F.lit(1e-6))
    middle = scored(labelled, ratios, ["verdict"]).agg(
        F.coalesce(
            F.round((F.avg(F.when(allow, score)) * spread(block) + F.avg(F.when(block, score)) * spread(allow)) / (spread(allow) + spread(block)), 9),
            F.lit(0.0),
        ).alias("threshold")
    )
    unruled = base.filter("ruled IS NULL").select("page_id", "host", "path", "rule", "folded")
    found = scored(unruled, ratios, ["page_id", "host", "path", "rule"]).join(F.broadcast(middle), F.lit(True))  # one row
    found = found.select("page_id", "host", "path", "rule", "score", "threshold", F.when(score >= F.col("threshold"), "allow").otherwise("block").alias("verdict"))
    by_rule = base.filter("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.col("ruled").alias("verdict"))
    return by_rule.unionByName(found)
