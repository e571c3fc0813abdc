"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one fact and votes for good (1), votes for bad (-1) or abstains (0). Expectation-maximisation
estimates, from the votes alone and without labels, how often each rule votes either way on good and on bad
documents; the posterior probability of good, not the failing of any one rule, decides. Documents that the base
check fails are decided already and take no part in the estimate. Abstaining says nothing either way: rules abstain
on short texts, of which there are good and bad ones.

The votes of all documents are counted by pattern in Spark. There are at most 3^9 = 19,683 patterns, however many
documents, so the counts fit on the driver, where the rounds are a sum over them.

Defined cases: null or empty text has no words and fails the base check; a null doc_id and repeated rows are
scored and counted like any other row; a text of any length is one row, counted whole; ties (a posterior of exactly
one half) are kept; over an empty table nothing is returned; if no document passes the base check none is kept.
Columns not asked for are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, document_columns, freeze

WINDOW = 5
ROUNDS = 12
#: Before the first round: odds of good, and what one vote for and one vote against multiply them by. One vote
#: against is not enough for a document that several rules vote for.
START = {"prior": 4.0, 1: 1.5, -1: 0.1}

#: Bad if the first holds, good if the second holds, else no vote; over the columns of ``features``.
CONDITIONS = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "lines": ("n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 10 * n_words", "n_words >= 20 and 100 * n_repeat_words <= n_words"),
    "word_size": ("10 * word_chars < 43 * n_words or word_chars > 7 * n_words", "10 * word_chars >= 45 * n_words and 10 * word_chars <= 62 * n_words"),
    "capitals": ("10 * n_upper > 2 * word_chars", "100 * n_upper <= 4 * word_chars"),
    "exclaiming": ("10 * n_bangs > n_words", "n_words >= 20 and n_bangs = 0"),
    "vocabulary": ("n_words >= 20 and 100 * n_distinct < 60 * n_words", "n_words >= 20 and 100 * n_distinct >= 65 * n_words"),
    "stops": ("n_words >= 20 and 25 * n_stops < n_words", "n_words >= 20 and 20 * n_stops >= n_words and 4 * n_stops <= n_words"),
}
RULES = tuple(CONDITIONS)
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of ``window`` words found twice or more in the array; the first ones count too.

    ``hashes``: a 64-bit hash of each word. Windows are compared by 64-bit hashes. Only a document in which some hash repeats sorts its windows.
    """

    def positions(hashes: Column) -> Column:
        found = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda j, e: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(j - 1, e) | same(j + 1, e)), lambda e: e["i"]))

        return _with(found, repeated)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(_with(positions(hashes), covered))

    def by_words(one: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(one) - window), lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(window)]))
        return _with(windows, count)

    return F.when(F.size(hashes) < window + 1, F.lit(0).cast("long")).otherwise(by_words(hashes))


def features(df: DataFrame) -> DataFrame:
    """Add the counts that the rules use; all over the whole text. ``_words`` and ``_lines`` come along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long = lambda c: c.cast("long")
    count = lambda pattern: long(F.regexp_count(text, F.lit(pattern)))
    split = df.withColumns(
        {
            "_words": F.filter(F.split(text, GAP), lambda w: w != ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        }
    ).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return split.withColumns(
        {
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.array_join("_words", ""))),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": repeat_words(F.col("_hashes")),
            "n_upper": count(r"\p{Lu}"),
            "n_bangs": count("!"),
            "n_stops": count(r"[.?:;]"),
            "n_distinct": long(F.size(F.array_distinct("_hashes"))),
        }
    )


def votes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"v_{r}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for r, (bad, good) in CONDITIONS.items()})


def log_odds(pattern: Sequence[int], model: dict) -> float:
    return model["prior"] + sum(model[r][v] for r, v in zip(RULES, pattern, strict=True) if v)


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over the counts of vote patterns: the log-odds of good of each rule's votes."""
    model: dict = {"prior": math.log(START["prior"])} | {r: {v: math.log(START[v]) for v in (1, -1)} for r in RULES}
    for _ in range(rounds):
        total, good = 0.0, 0.0
        cast = {(r, v): [0.0, 0.0] for r in RULES for v in (1, -1)}
        for pattern, n in counts.items():
            p = 1 / (1 + math.exp(-log_odds(pattern, model)))
            total += n
            good += n * p
            for r, v in zip(RULES, pattern, strict=True):
                if v:
                    cast[r, v][0] += n * p
                    cast[r, v][1] += n * (1 - p)
        model = {"prior": math.log((good + 1) / (total - good + 1))}
        for r in RULES:
            of_good, of_bad = (sum(cast[r, v][k] for v in (1, -1)) + 2 for k in (0, 1))
            model[r] = {v: math.log((cast[r, v][0] + 1) / of_good) - math.log((cast[r, v][1] + 1) / of_bad) for v in (1, -1)}
    return model


def posterior(model: dict) -> Column:
    """Probability of good, given the votes."""
    odds = F.lit(model["prior"])
    for r in RULES:
        odds = odds + F.when(F.col(f"v_{r}") == 1, F.lit(model[r][1])).when(F.col(f"v_{r}") == -1, F.lit(model[r][-1])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """The model of the votes of all rows of ``voted`` that pass the base check; at most 3^9 counts come to the driver."""
    patterns = voted.filter(~F.col("base_failed")).groupBy(*[f"v_{r}" for r in RULES]).agg(F.count("*").alias("n")).collect()
    return estimate({tuple(row)[:-1]: row.n for row in sorted(patterns)}, rounds)


def score(df: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, the counts, a vote for each rule, posterior, base_failed and kept, for every row."""
    counted = features(df.select(*dict.fromkeys([*carry, "text"])))
    kept = [*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"v_{r}" for r in RULES]]
    voted = freeze(votes(counted).select(*kept, F.expr(BASE).alias("base_failed")), "votes")
    model = fit(voted)
    judged = voted.withColumn("posterior", posterior(model))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep."""
    docs = document_columns(docs)
    return score(docs, tuple(docs.columns)).filter("kept").select(*docs.columns)
