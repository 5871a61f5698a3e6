"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule compares a count with a share of another (symbols of the characters of words, repeated lines, repeated
words). Its cutoff is chosen for each stratum of documents from labelled holdouts: among the candidates, the strictest
whose false rejection rate is at most ``risk`` with confidence. For each candidate the exact binomial tail decides: if
the rate were ``risk``, so few false rejections would have at most the corrected error probability. Candidates, rules
and strata are all tested, so the error is divided by their number (Bonferroni), and the risk by the number of rules,
so that all rules together keep it. A stratum with too few labels certifies nothing and rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import store

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Rule: what is counted, and of what.
RULES = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
CUTOFFS = (1, 2, 3, 5, 8, 12, 20, 30, 50)  # percent
STRATA = (100, 1000)  # words where the next stratum begins
RISK, ERROR = 0.05, 0.05


def counts(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text), ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    One row per row of ``docs`` (``text`` and others). Words are runs without ASCII white space. ``n_lines`` counts lines
    with a word, ``n_dup_lines`` those equal to an earlier one, ``n_repeat_words`` the words inside 5-word windows
    that occur twice or more in the text. A null text counts as empty.
    """
    text = F.col("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    df = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    words = F.filter(F.split(text, SPACES, -1), lambda x: x != "")
    df = df.select(
        "row",
        F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    df = df.select(
        "row", "word_chars", "n_symbols", F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "words",
    )
    # Windows by the hash of five words; only texts with a repeated window are looked at further: windows in order of
    # hash and place show which are repeated, and their places in order how many words they cover.
    at = F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    window = F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(F.col("words"), i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("windows", window)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(repeated, ordered)).drop("words", "windows")

    def twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(F.col("ordered"), k - 1)["h"])
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("ordered"), k + 1)["h"] == x["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("ordered", twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        places, start,
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def log_factorial(n: Column) -> Column:
    """By Stirling's series, sixteen steps up, where its error is below 1e-13."""
    x = n.cast("double") + 17.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    down = sum((F.log(n.cast("double") + float(j)) for j in range(2, 17)), F.log(n.cast("double") + 1.0))
    return series - down


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), to double precision; 1 where ``k`` is not below the mean.

    Below the mean the terms fall from k downwards, so after twelve standard deviations the rest no longer counts.
    """
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 100).cast("bigint")
    fall = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0).cast("bigint"), steps - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"),
            (a["sum"] + a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("sum"),
        ), lambda a: a["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * fall)


def over(rule: str, cutoff: Column | int) -> Column:
    """Whether a document breaks a rule at a cutoff in percent. Never where there is nothing to count."""
    part, whole = RULES[rule]
    return 100 * F.col(part) > cutoff * F.col(whole)


def stratum(strata: tuple[int, ...] = STRATA) -> Column:
    """Number of the stratum by words."""
    return sum((F.when(F.col("n_words") >= n, 1).otherwise(0) for n in strata), F.lit(0))


def thresholds(good: DataFrame, n_strata: int, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum`` and a cutoff for each rule (null: the rule rejects nothing there), from counts of good documents.

    One row per stratum that has a good document; the counting is summed up before its shuffle.
    """
    tests = len(RULES) * len(CUTOFFS) * n_strata
    sums = [F.sum(over(r, c).cast("bigint")).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS]
    got = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    picks = []
    for r in RULES:
        passed = [F.when(at_most(F.col(f"{r}_{c}"), F.col("n"), risk / len(RULES)) <= error / tests, F.lit(c)) for c in CUTOFFS]
        picks.append(F.coalesce(*passed).alias(f"cut_{r}"))
    return got.select("stratum", *picks)


def judge(docs: DataFrame, labels: DataFrame, strata: tuple[int, ...] = STRATA, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``row`` (columns of ``docs`` but the text), the counts, ``base_failed`` and ``kept``; one row per row.

    ``docs`` has ``doc_id, text`` and any other columns; ``labels`` has ``doc_id, label`` where label 1 marks documents that
    should be kept. A document fails the base rules with under ten words, or with more than a fifth of its words in
    repeated windows; others are kept unless a rule of their stratum rejects them. Null and empty texts fail. Labels
    without a document or other than 1 are left out; several labels of one id all count. No labels: no rule rejects.
    """
    rows = store(counts(docs).withColumn("stratum", stratum(strata)), "counts")
    good = labels.filter("label = 1").select(F.col("doc_id").alias("at"))
    labelled = rows.withColumn("at", F.col("row.doc_id")).join(good, "at")
    cuts = thresholds(labelled, len(strata) + 1, risk, error)
    # At most one row per stratum, whose number is fixed.
    out = rows.join(F.broadcast(cuts), "stratum", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(over(r, F.col(f"cut_{r}")), F.lit(False))
    return out.select("row", *COLUMNS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_METRICS = {r: f"100 * {a} > {{c}} * {b}" for r, (a, b) in RULES.items()}
_TESTS = len(RULES) * len(CUTOFFS) * (len(STRATA) + 1)
_P = RISK / len(RULES)


def _sql_cut(rule: str) -> str:
    cases = []
    for c in CUTOFFS:
        k = f"(count(*) FILTER (WHERE {_METRICS[rule].format(c=c)}))"
        tail = (
            f"list_sum([exp(lgamma(count(*) + 1) - lgamma(i + 1) - lgamma(count(*) - i + 1) + i * ln({_P!r}::DOUBLE)"
            f" + (count(*) - i) * ln(1 - {_P!r}::DOUBLE)) FOR i IN range({k} + 1)])"
        )
        cases.append(f"WHEN {k} < count(*) * {_P!r}::DOUBLE AND {tail} <= {ERROR / _TESTS!r}::DOUBLE THEN {c}")
    return f"CASE {' '.join(cases)} END AS cut_{rule}"


SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  parts AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM base),
  win AS (SELECT rid, i, words[i : i + 4] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM parts)),
  again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
  cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
  counted AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
    FROM parts LEFT JOIN cover USING (rid)),
  placed AS (SELECT *, {" + ".join(f"CASE WHEN n_words >= {n} THEN 1 ELSE 0 END" for n in STRATA)} AS stratum FROM counted),
  cuts AS (SELECT stratum, {", ".join(map(_sql_cut, RULES))}
    FROM placed JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY stratum),
  judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {" OR ".join(f"coalesce({m.format(c=f'cut_{r}')}, false)" for r, m in _METRICS.items())} AS rejected FROM placed LEFT JOIN cuts USING (stratum))
SELECT doc_id, {", ".join(COLUMNS)}, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""
