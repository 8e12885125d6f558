"""Mixing sources to target weights by soft membership, in DataFrame functions throughout.

1. A labelled table gives domains of some documents. Words that are clearly commoner in one domain become evidence for
   it, and a document's posterior over the domains follows from the words that it holds and the domains' shares.
2. Document rates r >= 0 are fitted so that for each domain the expected tokens, the sum of r x tokens x posterior, are
   the target share of the budget: projected-gradient least squares from r = 1, the residuals scaled by the domains'
   sizes so that a step of 1 is safe. A step changes a rate by the document's own posterior and the residuals alone, so
   an iteration is one aggregate over the documents, and the driver sees one number per domain. It ends at the
   tolerance, or when 20 steps have not brought the residuals down by a hundredth; ``mix`` tells what is left of them.
3. ``copies`` turns a rate into a whole number with that expectation, by a hash of the id.

The evidence is counted on at most ``max_rows`` labelled documents, the ones with the smallest hash of their id, and
every word whose share differs by more than five standard deviations is kept; posteriors, token counts and rates cover every document and its whole text.

Rows: a null id is left out; a null text has no words and no tokens, and its rate stays 1 (it moves no total); repeated
rows of one id count as one document with that many times the words; labelled rows with a null domain, or one that is
not among the targets, are left out; without any labelled row the posterior is uniform. Other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.llm.shared import cut


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def evidence(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = 20000) -> tuple[DataFrame, list[float]]:
    """(word, w_0, w_1, ...) with the log odds of each domain, and the domains' log shares among the labelled documents."""
    marks = labelled.where(F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    marks = marks.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_rows)
    held = cut(docs.join(F.broadcast(marks), "id").select("domain", F.array_distinct(_words("text")).alias("words")))
    sizes = {r["domain"]: r["n"] for r in held.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in domains]
    total = sum(n)
    counts = held.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n_{i}") for i, d in enumerate(domains)))
    seen = sum((F.col(f"n_{i}") for i in range(len(domains))), F.lit(0))
    odds, strength = [], []
    for i in range(len(domains)):
        rest = max(total - n[i], 1)
        inside, outside = (F.col(f"n_{i}") + 0.5) / (n[i] + 1.0), (seen - F.col(f"n_{i}") + 0.5) / (rest + 1.0)
        odds.append(F.log(inside / outside).alias(f"w_{i}"))
        share = seen / F.lit(float(max(total, 1)))
        strength.append(F.abs(F.col(f"n_{i}") / F.lit(float(max(n[i], 1))) - (seen - F.col(f"n_{i}")) / F.lit(float(rest))) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1.0 / max(n[i], 1) + 1.0 / rest)))
    best = F.greatest(*strength) if len(strength) > 1 else strength[0]
    words = counts.where(seen >= 3).withColumn("strength", best).where("strength > 5").select("word", *odds)
    from math import log

    return cut(words), [log((x + 1) / (total + len(domains))) for x in n]


def posteriors(docs: DataFrame, words: DataFrame, shares: list[float], scale: float = 1.0) -> DataFrame:
    """(id, tokens, p_0, p_1, ...) of every document; rows of one id are one document, with the tokens and words of all of them."""
    k = len(shares)
    rows = docs.where("id is not null").select("id", _words(F.coalesce("text", F.lit(""))).alias("all"))
    # counted before the words are exploded, or every word's row would carry and count them all again
    rows = rows.select("id", (F.size("all") - F.size(F.filter("all", lambda w: w == ""))).cast("long").alias("tokens"), F.array_distinct("all").alias("words"))
    rows = rows.select("id", "tokens", F.posexplode_outer("words").alias("nth", "word"))
    # the word table is a written one, so the planner knows its size and broadcasts it if it is small
    held = rows.join(words, "word", "left").groupBy("id").agg(F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("tokens"))).alias("tokens"), *(F.sum(F.coalesce(f"w_{i}", F.lit(0.0))).alias(f"s_{i}") for i in range(k)))
    logit = [F.round(F.lit(shares[i]) + scale * F.col(f"s_{i}"), 6) for i in range(k)]
    held = held.select("id", "tokens", *(x.alias(f"s_{i}") for i, x in enumerate(logit)))
    top = F.greatest(*(F.col(f"s_{i}") for i in range(k))) if k > 1 else F.col("s_0")
    whole = sum((F.exp(F.col(f"s_{i}") - top) for i in range(k)), F.lit(0.0))
    return held.select("id", "tokens", *(F.round(F.exp(F.col(f"s_{i}") - top) / whole, 9).alias(f"p_{i}") for i in range(k)))


def rates(members: DataFrame, weights: list[float], budget: float | None = None, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """(id, tokens, p_*, rate), and the last residuals as shares of the budget."""
    k = len(weights)
    size = members.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * F.col(f"p_{i}")).alias(f"m_{i}") for i in range(k))).first()
    total = float(size["t"] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0)), list(weights)
    want = [w / sum(weights) * (budget or total) / total for w in weights]
    mass = [max(float(size[f"m_{i}"]) / total, 1e-9) for i in range(k)]
    rate, state, residual = F.lit(1.0), members.withColumn("rate", F.lit(1.0)), [mass[i] - want[i] for i in range(k)]
    mark = float("inf")
    for step in count():
        worst = max(abs(x) for x in residual)
        if worst <= tolerance or (step % 20 == 0 and worst > 0.99 * mark):
            break
        mark = worst if step % 20 == 0 else mark
        # the step of each document: its posterior against the scaled residuals, cut off at zero
        pull = sum((F.col(f"p_{i}") * (residual[i] / mass[i]) for i in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.col("rate") - pull)
        state = state.withColumn("rate", rate)
        if step % 10 == 9:
            state = cut(state)  # keeps the expression of a rate short
        sums = state.agg(*(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{i}")).alias(f"m_{i}") for i in range(k))).first()
        residual = [float(sums[f"m_{i}"]) / total - want[i] for i in range(k)]
    return state.withColumn("rate", F.when(F.col("tokens") > 0, F.round("rate", 6)).otherwise(F.lit(1.0))), residual


def copies(rate: Column, key: Column, seed: int = 0) -> Column:
    """A whole number whose expectation is the rate: the same one each time for the same id."""
    chance = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options: float) -> DataFrame:
    """(id, text) and (id, domain) to (id, tokens, p_<domain>, rate, copies, residual_<domain>).

    A residual is a domain's expected tokens less its target, as a share of the budget; the same number in every row.
    """
    domains = list(targets)
    words, shares = evidence(docs, labelled, domains)
    members = cut(posteriors(docs, words, shares))
    found, left = rates(members, [targets[d] for d in domains], **options)
    return found.select("id", "tokens", *(F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies(F.col("rate"), F.col("id")).alias("copies"), *(F.lit(float(x)).alias(f"residual_{d}") for d, x in zip(domains, left, strict=True)))


#: Domains of the labels table, and the shares of the tokens that each should have.
TARGETS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}


def domains_of(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").cast("long").alias("id"), domain.alias("domain")).where("id is not null")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return mix(rows, domains_of(labels), TARGETS).withColumnRenamed("id", "doc_id")
