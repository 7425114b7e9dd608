"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains; nothing is labelled. Expectation-maximisation over the distinct vote
patterns (at most 3 ** number of rules, counted over all documents) estimates how often each rule votes each way on
good and on bad text. A document's posterior probability of being good replaces a filter in which all rules must pass.
All of it is DataFrame expressions; what reaches the driver is one row of fixed width a round.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, checkpointed, free_name, let, quoted

# Function words that running text of each language can't do without.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on are with as be this by from at have or not when an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec",
    "es": "de la que el en y a los se del las un por con no una su para es lo",
}
#: A vote's rate is never estimated closer to 0 than this, as rare patterns would decide alone.
FLOOR = 1e-3
GOOD, ABSTAIN, BAD = 1, 0, -1


def measures(text: Column) -> dict[str, Column]:
    """Columns over a words column and a text: the base figures, all over the whole text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return {
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(F.col("words")).cast("long"),
    }


def n_repeat_words(words: Column) -> Column:
    """Words inside any 3-word window that the text holds twice or more, the first time included."""
    n = F.size(words) - 2
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def starts(h: Column) -> Column:  # of repeated windows, ascending: equal hashes stand side by side once sorted
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(let(pairs, same))

    # each start covers three words, or as many as there are up to the next start
    covered = lambda p: F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(starts(h), covered))
    return F.when(n < 2, 0).otherwise(let(hashes, counted))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added by a generator, so that the optimizer copies none of them into what uses them."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def base_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.col(text_col)
    out = computed(docs, words=blank_words(text))
    out = computed(out, n_words=F.size("words").cast("long"), **measures(text))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def votes(text: Column) -> dict[str, Column]:
    """Each rule's vote from the base figures; between its two bounds a rule abstains, as all do on text without words."""
    some = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda pattern, of: F.regexp_count(some, F.lit(pattern)) / of
    stops = F.size(F.filter("words", lambda w: w.isin(stop))) / n
    plain = share("(?<!\\S)\\p{L}++[.,;:!?]?+(?!\\S)", n)
    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    dup = F.col("n_dup_lines") / F.greatest(F.lit(1), F.regexp_count(some, F.lit("[^\\n]++")))
    capitals, shouts, length = share("\\p{Lu}", chars), share("[!?]{2,}+", n), F.col("word_chars") / n

    def vote(bad: Column, good: Column | None = None) -> Column:
        v = F.when(F.col("n_words") == 0, ABSTAIN).when(bad, BAD)
        return (v if good is None else v.when(good, GOOD)).otherwise(ABSTAIN)

    return {  # the first six know a fault; that it is missing says little about the rest, so they abstain then
        "word_length": vote((length < 2) | (length > 10)),
        "symbols": vote(symbols > 0.1),
        "repeats": vote(repeats > 0.3),
        "dup_lines": vote(dup > 0.3),
        "capitals": vote(capitals > 0.4),
        "shouts": vote(shouts > 0.1),
        "stop_words": vote(stops < 0.06, stops >= 0.1),
        "plain_words": vote(plain < 0.7, plain >= 0.85),
    }


def _posterior(model: dict) -> Column:
    """The probability that a document with these votes is good. Rates stand in arrays, which are data to the compiled code,
    so that all rounds of fit share it."""
    odds = {r: [math.log(model["good"][r][v] / model["bad"][r][v]) for v in (BAD, ABSTAIN, GOOD)] for r in model["good"]}
    first = next(iter(odds))
    odds[first] = [x + math.log(model["prior"] / (1 - model["prior"])) for x in odds[first]]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, (F.get(F.lit(odds[r]), F.col(r) + 1) for r in odds))))


def fit(patterns: DataFrame, rules: list[str], rounds: int = 25, tolerance: float = 1e-4) -> dict:
    """The label model for patterns (a column for each rule, and n documents). It starts from rules that are right
    four times in five when they vote, so that good and bad keep their sense. No rows: that start."""
    first = {GOOD: 0.4, ABSTAIN: 0.5, BAD: 0.1}
    model = {"prior": 0.8, "good": {r: dict(first) for r in rules}, "bad": {r: {GOOD: first[BAD], ABSTAIN: first[ABSTAIN], BAD: first[GOOD]} for r in rules}}
    for _ in range(rounds):
        w = patterns.withColumn("p", _posterior(model)).withColumns({"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))})
        sums = [F.sum(F.when(F.col(r) == v, F.col(c))).alias(f"{c}_{r}_{v}") for c in ("good", "bad") for r in rules for v in (GOOD, ABSTAIN, BAD)]
        row = w.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *sums).first()
        if row["good"] is None:
            break
        old, total = model["prior"], row["good"] + row["bad"]
        rate = lambda c, r, v: max(FLOOR, ((row[f"{c}_{r}_{v}"] or 0) + 1) / (row[c] + 3))  # noqa: B023, E731
        model = {"prior": min(0.999, max(0.001, row["good"] / total))} | {c: {r: {v: rate(c, r, v) for v in (GOOD, ABSTAIN, BAD)} for r in rules} for c in ("good", "bad")}
        if abs(model["prior"] - old) < tolerance:
            break
    return model


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_judgement(docs: DataFrame, text_col: str = "text", keep_above: float = 0.5, keep_text: bool = True, out: str = "judged") -> DataFrame:
    """docs with the struct `out`: the base figures, votes (a struct of each rule's), quality (posterior, 0 to 1) and kept.

    kept is false where base_failed holds, else quality >= keep_above. Null and empty texts have no words and fail.
    Repeated rows each get their result and count each in the model. Columns of docs stay, whatever their names; one
    called `out` is replaced. An empty table gives an empty result. Texts are measured once; docs is written with its
    figures, as the model needs all votes before any verdict; without keep_text, text_col goes.
    """
    docs = docs.drop(out)
    rest = [x for c, x in zip(docs.columns, quoted(docs), strict=True) if keep_text or c != text_col]
    judged = base_figures(docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text")), "text")
    rules = votes(F.col("text"))
    judged = computed(judged, votes=F.struct(*(v.cast("int").alias(r) for r, v in rules.items())))
    judged = checkpointed(judged.select("row", *FIGURES, "votes"))
    patterns = checkpointed(judged.groupBy("votes").agg(F.count("*").alias("n")).select("votes.*", "n").coalesce(1))  # at most 3 ** len(rules) rows
    of = patterns.withColumn("quality", _posterior(fit(patterns, list(rules)))).select(F.struct(*rules).alias("votes"), "quality")
    judged = judged.join(F.broadcast(of), "votes", "left")  # at most 3 ** len(rules) rows
    kept = (~F.col("base_failed") & (F.col("quality") >= keep_above)).alias("kept")
    return judged.select("row.*", F.struct(*FIGURES, "votes", "quality", kept).alias(out))


def judge_quality(docs: DataFrame, text_col: str = "text", keep_above: float = 0.5, keep_text: bool = True) -> DataFrame:
    """with_judgement, but each field a column of its own (votes: quality_votes); columns of docs with these names are
    replaced."""
    names = {**{c: c for c in (*FIGURES, "quality", "kept")}, "votes": "quality_votes"}
    out = free_name(docs, "judged")
    judged = with_judgement(docs, text_col, keep_above, keep_text, out)
    stay = [x for c, x in zip(judged.columns, quoted(judged), strict=True) if c not in {out, *names.values()}]
    return judged.select(*stay, *(F.col(out)[a].alias(b) for a, b in names.items()))
