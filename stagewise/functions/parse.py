"""Rendering prompts and reading rankings out of model replies. Models are never called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbers(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ints(found: Column) -> Column:
    """Numbers of up to 9 digits; longer ones can't be places or ids."""
    return F.transform(F.filter(found, lambda x: F.length(x) <= 9), lambda x: x.cast("int"))


def without_thoughts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def repaired(order: Column, n: Column) -> Column:
    """Places in 0..n-1 without repeats, then the missing ones in order: always a permutation."""
    every = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    good = F.array_distinct(F.filter(F.coalesce(order, F.array().cast("array<int>")), lambda x: (x >= 0) & (x < n)))
    return F.concat(good, F.array_except(every, good))


def positions(text: Column, n: Column) -> Column:
    """All whole numbers, 1-based, as a permutation of 0..n-1; an empty reply is the identity."""
    found = _ints(_numbers(without_thoughts(F.coalesce(text, F.lit(""))), r"([0-9]+)", 1))
    return repaired(F.transform(found, lambda x: x - 1), n)


def positions_from_lines(text: Column, n: Column) -> Column:
    """Numbers that begin a line, with or without a mark; else all numbers."""
    clean = without_thoughts(F.coalesce(text, F.lit("")))
    lines = _ints(_numbers(clean, r"(?m)^\s*#?([0-9]+)[.):]?", 1))
    every = _ints(_numbers(clean, r"([0-9]+)", 1))
    return repaired(F.transform(F.when(F.size(lines) > 0, lines).otherwise(every), lambda x: x - 1), n)


def positions_from_commas(text: Column, n: Column) -> Column:
    """Comma-separated tokens of digits only."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return repaired(F.transform(_ints(F.filter(parts, lambda x: x.rlike("^[0-9]+$"))), lambda x: x - 1), n)


def item_ids(text: Column, candidates: Column, k: int) -> Column:
    """Ids named as "Item N", "#N" or "ID: N" that are candidates, filled up with candidates in order, cut to k."""
    clean = F.coalesce(text, F.lit(""))
    found = F.concat(*[_ints(_numbers(clean, p, 1)) for p in (r"(?i)item\s*:?\s*([0-9]+)", r"#([0-9]+)", r"(?i)id:\s*([0-9]+)")])
    named = F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("long")), lambda x: F.array_contains(candidates, x)))
    return F.slice(F.concat(named, F.array_except(candidates, named)), 1, k)


def status(text: Column, found: Column, failure: Column) -> Column:
    """How much of a ranking a reply holds: a failed call, nothing, degenerate, short or ok."""
    return F.when(failure.isNotNull(), F.concat(F.lit("api_"), failure)).when(found == 0, "parse_empty").when(found < 3, "degenerate").when(found < 10, "short").otherwise("ok")


def numbers_found(text: Column, n: Column) -> Column:
    """Different places in range that a reply names."""
    found = _ints(_numbers(without_thoughts(F.coalesce(text, F.lit(""))), r"([0-9]+)", 1))
    return F.size(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n))))


def apply_order(candidates: DataFrame, orders: DataFrame, window: int = 30) -> DataFrame:
    """Candidates with the first ``window`` put in the reply's order and the tail kept.

    orders: user_id, order (0-based places, a permutation of the window).
    """
    places = orders.select("user_id", F.posexplode("order").alias("to", "place"))
    shown = candidates.where(F.col("rank") <= window).join(places.withColumn("rank", F.col("place") + 1).drop("place"), ["user_id", "rank"], "left")
    new = shown.select("user_id", F.coalesce(F.col("to") + 1, "rank").cast("int").alias("rank"), "item_id", "score")
    return new.unionByName(candidates.where(F.col("rank") > window).select("user_id", "rank", "item_id", "score"))


def numbered_list(rows: DataFrame, order: str, text: Column, name: str) -> DataFrame:
    """One numbered line per row, in order, per user."""
    line = F.concat(F.col(order).cast("string"), F.lit(". "), text)
    g = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    return g.select("user_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias(name))


#: Prompt families: what is asked after history and candidates.
TEMPLATES = {
    "direct": "Rank the candidates from most to least likely.\nAnswer with numbers only.",
    "steps": "First describe the user's taste, then compare the candidates with it, then rank them.\nEnd with the numbers in order.",
    "enhanced": "Consider recency, category and popularity.\nRank the candidates and answer with numbers only.",
}


def plain_prompt(history: DataFrame, shown: DataFrame, family: str = "direct", width: int = 60) -> DataFrame:
    """user_id, prompt. history: user_id, at, text; shown: user_id, rank, text."""
    h = numbered_list(history, "at", F.substring("text", 1, width), "history")
    c = numbered_list(shown, "rank", F.substring("text", 1, width), "candidates")
    parts = [F.lit("The user chose:\n"), F.coalesce("history", F.lit("")), F.lit("\n\nCandidates:\n"), F.col("candidates"), F.lit("\n\n" + TEMPLATES[family])]
    return c.join(h, "user_id", "left").select("user_id", F.concat(*parts).alias("prompt"))


def score_aware_lines(shown: DataFrame, width: int = 60) -> DataFrame:
    """user_id, candidates with retrieval rank, min-max score and popularity percentile. shown: user_id, rank, text, score (0..1), pct."""
    line = F.concat(F.substring("text", 1, width), F.lit(" [rank "), F.col("rank").cast("string"), F.lit(", score "), F.format_string("%.2f", "score"), F.lit(", popularity "), F.col("pct").cast("string"), F.lit("%]"))
    return numbered_list(shown, "rank", line, "candidates")


def pointwise_prompt(history: Column, title: Column) -> Column:
    return F.concat(F.lit("The user chose: "), history, F.lit("\nWill the user choose \""), title, F.lit("\"? Answer yes or no."))
