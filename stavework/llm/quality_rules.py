"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one property of a text and votes good, votes bad or abstains. Thresholds are loose: a rule alone is often
wrong, and junk mostly breaks two rules or more. Rules are taken as independent given the unseen class of a text.
Expectation-maximisation estimates the share of good texts and how often each rule is right on either class; a text is kept if
the posterior probability that it is good is at least one half, so good votes can outweigh a bad one. Only the counts of vote
patterns enter the estimate: 3 ** len(RULES) rows at most, however large the corpus. Rules on words take these to be
parted by white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpointed, fresh, let

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Words in a window of the repetition count, iterations at most, and the change at which they end.
WINDOW, ITERATIONS, TOLERANCE = 5, 100, 1e-9
#: Beliefs held before any text is seen, for bad texts and for good ones: the share of a rule's votes that are bad, and how much that
#: weighs, as a share of the corpus. No rule is taken as infallible on good texts because it has not failed yet.
PRIOR_BAD, PRIOR_GOOD = (0.2, 0.001), (0.02, 0.1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which occurs twice or more, its first occurrence included.

    Windows are compared by 64-bit hashes. Only texts with fewer distinct windows than windows are looked at further:
    windows are sorted by (hash, place), those with an equal neighbour are repeats, and their places in order give the cover.
    """
    n = F.size(words)

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def cover(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1

        def repeat(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(sorted_windows, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])
            after = (i < last) & (F.get(sorted_windows, F.least(i + 1, last))["h"] == x["h"])
            return before | after

        places = F.sort_array(F.transform(F.filter(sorted_windows, repeat), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"), p.alias("at"))
        return F.aggregate(places, zero, step, lambda acc: acc["n"])

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(pairs, cover))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, count))


def features(docs: DataFrame, text: str = "text", q: str = "_quality") -> DataFrame:
    """docs with the base counts and the properties that rules look at, in one struct q. Null text counts as none."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)

    def measure(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(content, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.regexp_count(content, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_shouted"),
            F.regexp_count(content, F.lit(r"[!?]{2,}")).cast("long").alias("n_exclaimed"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.regexp_count(content, F.lit(r"[^\p{L}\p{M}\s.,;:!?'\x{2019}()\"-]++")).cast("long").alias("n_odd"),
            F.regexp_count(content, F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("long").alias("n_stops"),
        )

    return docs.withColumn(q, let(_words(content), measure))


def votes(q: str = "_quality") -> dict[str, Column]:
    """Each rule's vote from the properties: BAD, ABSTAIN or GOOD."""
    x = lambda name: F.col(f"{q}.{name}")
    n = F.greatest(x("n_words"), F.lit(1))
    mean = x("word_chars") / n

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return {
        "length": rule(x("n_words") < 10, x("n_words") >= 30),
        "repetition": rule(x("n_repeat_words") * 8 > n, x("n_repeat_words") * 25 <= n),
        "symbols": rule(x("n_symbols") * 20 > n, x("n_symbols") * 100 <= n),
        "odd_characters": rule(x("n_odd") * 5 > n, x("n_odd") * 10 <= n),
        "shouting": rule(x("n_shouted") * 10 > n, x("n_shouted") * 30 <= n),
        "exclamation": rule(x("n_exclaimed") * 20 > n, x("n_exclaimed") * 100 <= n),
        "variety": rule((x("n_distinct") * 4 < n) & (n < 2000), x("n_distinct") * 2 >= n),
        "lines": rule(x("n_dup_lines") * 40 > n, x("n_dup_lines") == 0),
        "sentences": rule(x("n_stops") * 40 < n, x("n_stops") * 20 >= n),
        "word_length": rule((mean < 3) | (mean > 9), (mean >= 4) & (mean <= 7)),
    }


RULES = ("length", "repetition", "symbols", "odd_characters", "shouting", "exclamation", "variety", "lines", "sentences", "word_length")


def base_failed(q: str = "_quality") -> Column:
    return (F.col(f"{q}.n_words") < 10) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * 20)


#: Share of good texts, and for each rule how often its votes are bad on bad texts and on good ones.
Model = tuple[float, list[tuple[float, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """The share of good texts and the rules' error rates, by expectation-maximisation.

    patterns: votes of all rules and how many texts cast them; an abstention says nothing. It starts from "probably bad if any
    rule says so". Without texts the beliefs stand.
    """
    total = sum(c for _, c in patterns)
    if not total:
        return 0.5, [(PRIOR_BAD[0], PRIOR_GOOD[0])] * len(RULES)
    patterns = sorted(patterns)
    good = [0.1 if BAD in v else 0.95 for v, _ in patterns]
    model: Model = 0.5, []
    for _ in range(ITERATIONS):
        share = (1 + math.fsum(c * g for (_, c), g in zip(patterns, good, strict=True))) / (2 + total)
        rates = []
        for j in range(len(RULES)):
            pair = []
            for (mean, weight), side in ((PRIOR_BAD, False), (PRIOR_GOOD, True)):
                weights = [(v[j], c * (g if side else 1 - g)) for (v, c), g in zip(patterns, good, strict=True)]
                bad, fine = (p * weight * total + math.fsum(w for x, w in weights if x == vote) for p, vote in zip((mean, 1 - mean), (BAD, GOOD), strict=True))
                pair.append(bad / (bad + fine))
            rates.append((pair[0], pair[1]))
        model = share, rates
        new = [posterior(v, model) for v, _ in patterns]
        change = max(abs(a - b) for a, b in zip(good, new, strict=True))
        good = new
        if change < TOLERANCE:
            break
    return model


def _gains(rates: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log odds that a text is good."""
    on_bad, on_good = rates
    return {BAD: math.log(on_good / on_bad), ABSTAIN: 0.0, GOOD: math.log((1 - on_good) / (1 - on_bad))}


def posterior(v: tuple[int, ...], model: Model) -> float:
    share, rates = model
    odds = math.log(share / (1 - share)) + math.fsum(_gains(r)[x] for x, r in zip(v, rates, strict=True))
    return 1 / (1 + math.exp(-odds))


def fit(measured: DataFrame) -> Model:
    """Estimates from the votes of all rows: a count by vote pattern, of which there are 3 ** len(RULES) at most."""
    cast = votes()
    counts = measured.select(*(cast[r].alias(r) for r in RULES)).groupBy(*RULES).count().collect()
    return estimate([(tuple(x[r] for r in RULES), x["count"]) for x in counts])


def good_probability(model: Model, q: str = "_quality") -> Column:
    """Posterior probability that a row is good, from its votes."""
    cast = votes(q)
    odds = F.lit(math.log(model[0] / (1 - model[0])))
    for r, rates in zip(RULES, model[1], strict=True):
        gain = _gains(rates)
        odds = odds + F.when(cast[r] == BAD, gain[BAD]).when(cast[r] == ABSTAIN, gain[ABSTAIN]).otherwise(gain[GOOD])
    return 1 / (1 + F.exp(-odds))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, votes.

    kept: not base_failed, and p_good >= 0.5. Null and empty texts have no words and fail the base rule. Null and repeated keys are
    rows like others. An empty table gives an empty result. Other columns are dropped. The counts (no text) are
    checkpointed between estimate and verdict, so texts are read once.
    """
    measured = checkpointed(features(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t").select("k", "_quality"))
    p_good = good_probability(fit(measured))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cast = votes()
    out = measured.withColumn("p_good", p_good).withColumn("base_failed", base_failed())
    return out.select(
        F.col("k").alias(key), *(F.col(f"_quality.{c}").alias(c) for c in base), "base_failed", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"),
        "p_good", F.concat(*(cast[r].cast("string") for r in RULES)).alias("votes"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that assess() does not keep; all columns as they were.

    Texts are read twice (estimate, then verdict), which costs less than carrying them through a join.
    """
    plain = docs.select(F.col(text).alias("t"))
    model = fit(features(plain, "t"))
    q = fresh("_quality", docs)
    out = features(docs, text, q)
    return out.where(~base_failed(q) & (good_probability(model, q) >= 0.5)).drop(q)

