"""Operator 2: quality rules as weak supervision, in DataFrame functions only.

Base features of each whole text are computed in place by array functions (no
row is exploded, nothing is shuffled).  Each rule looks at one feature and votes good (+1) where it is as in
prose, bad (-1) where it is far from that, and abstains (0) between.  Rules are taken to err independently given the unknown
quality; expectation-maximisation over the table of vote patterns (at most 3^R
rows, whatever the corpus) estimates the share of good documents and how often each
rule votes which way on good and on bad ones, among documents that do not fail already.  A document is kept if its posterior probability of being good
reaches a threshold: one bad vote of a rule that errs does not reject it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Up to so many repeated windows are looked up in a list; more are found by sorting.
FEW = 32
#: Columns that base_features adds, first those of the base rules.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_function_words", "n_sentence_ends")
#: The commonest function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it as with on by this are or be an at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "le la les et de un une du que est pour dans qui par sur en il au ce pas "
    "el los y las por con una para del se al su lo como más"
).split()
#: Fixed value: what ends a sentence, before a separator or at the text's end.
SENTENCE_END = r"[.!?](?=[\x20\x09-\x0D]|\z)"


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the columns of MORE (long).

    Null text counts as empty.  Columns of those names are
    replaced.  Windows of three words are compared by 64-bit hashes.
    """
    row = [F.col(f"`{n}`") for n in docs.columns if n not in {*FEATURES, *MORE}]
    # the caller's columns travel in one struct, so that no name of theirs meets one used here
    df = docs.select(F.struct(*row).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t")).withColumn("_w", words("_t"))
    c = F.col("_t")
    w = F.col("_w")
    windows = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", windows)
    h = F.col("_h")
    df = df.withColumn("_s", F.sort_array("_h"))
    s = F.col("_s")
    df = df.withColumn("_d", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == s[F.greatest(i - 1, F.lit(0))]))))
    d = F.col("_d")
    # positions of windows that occur again: looked up where few hashes repeat, else neighbours in order of (hash, position)
    by_list = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda p: p.isNotNull())
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("p"))))
    df = df.withColumn("_o", F.when(F.size(d) > FEW, pairs))
    o = F.col("_o")
    again = F.filter(
        o,
        lambda e, i: ((i > 0) & (e["x"] == o[F.greatest(i - 1, F.lit(0))]["x"]))
        | ((i < F.size(o) - 1) & (e["x"] == o[F.least(i + 1, F.size(o) - 1)]["x"])),
    )
    by_order = F.sort_array(F.transform(again, lambda e: e["p"]))
    df = df.withColumn("_p", F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= FEW, by_list).otherwise(by_order))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - p[F.greatest(k - 1, F.lit(0))]))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("_l", F.filter(F.split(c, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    common = sorted({*FUNCTION_WORDS, *(x.capitalize() for x in FUNCTION_WORDS)})
    return df.select(
        "_row.*",
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length(c) - F.length(F.regexp_replace(c, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(*common))).cast("long").alias("n_function_words"),
        F.regexp_count(c, F.lit(SENTENCE_END)).cast("long").alias("n_sentence_ends"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains; conditions in SQL over the features.

    right: its first guess of how often a vote of it is right.
    """

    name: str
    good: str
    bad: str
    right: float = 0.8


#: Bad votes are the usual thresholds for web text or wider; good ones leave a distance to them.
RULES = (
    Rule("symbols", "n_symbols * 50 <= n_words", "n_symbols * 10 > n_words"),
    Rule("word_length", "word_chars between 4.4 * n_words and 6.5 * n_words", "word_chars < 3 * n_words or word_chars > 7 * n_words"),
    Rule("function_words", "n_function_words * 100 >= 15 * n_words", "n_function_words * 100 < 10 * n_words"),
    Rule("sentences", "n_sentence_ends * 100 between 5 * n_words and 20 * n_words", "n_sentence_ends * 1000 < 25 * n_words or n_sentence_ends * 3 > n_words"),
    Rule("repeated_words", "n_repeat_words * 20 <= n_words", "n_repeat_words * 5 > n_words"),
    Rule("repeated_lines", "n_lines >= 3 and n_dup_lines = 0", "n_dup_lines * 10 > n_lines * 3"),
)


@dataclass(frozen=True)
class Model:
    """share: of good documents; rates[r]: of votes (+1, -1, 0) given good, and given bad."""

    share: float
    rates: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]] = field(default_factory=dict)


def vote(rule: Rule) -> Column:
    yes, no = F.coalesce(F.expr(rule.good), F.lit(False)), F.coalesce(F.expr(rule.bad), F.lit(False))
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def posterior(rules: tuple[Rule, ...], model: Model) -> Column:
    """Probability of being good given the votes."""
    odds = F.lit(model.share / (1 - model.share))
    for r in rules:
        good, bad = model.rates[r.name]
        v = F.col(f"vote_{r.name}")
        odds = odds * F.when(v == 1, good[0] / bad[0]).when(v == -1, good[1] / bad[1]).otherwise(good[2] / bad[2])
    return odds / (1 + odds)


def first_guess(rule: Rule) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """A rule votes on half of the texts it speaks about, and is right in a share ``right`` of its votes."""
    good, bad = rule.good != "false", rule.bad != "false"
    of_good = (0.5 * rule.right * good, 0.5 * (1 - rule.right) * bad)
    of_bad = (0.5 * (1 - rule.right) * good, 0.5 * rule.right * bad)
    return tuple(tuple(max(x, 1e-3) for x in (*p, 1 - sum(p))) for p in (of_good, of_bad))


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 30, share: float = 0.8) -> Model:
    """Expectation-maximisation on the votes (columns vote_<rule>) of all rows; one small aggregate of the pattern table a round.

    Rates keep away from 0 and 1 by half a vote; without rows the first guess stays.
    """
    names = [f"vote_{r.name}" for r in rules]
    patterns = cut(voted.groupBy(*names).agg(F.count("*").alias("n")))
    n = patterns.agg(F.sum("n").alias("n")).first()["n"] or 0
    model = Model(share, {r.name: first_guess(r) for r in rules})
    for _ in range(rounds if n else 0):
        g = F.col("n") * F.col("_g")
        b = F.col("n") * (1 - F.col("_g"))
        sums = [F.sum(g).alias("good"), F.sum(b).alias("bad")]
        for r in rules:
            for v, tag in ((1, "y"), (-1, "n"), (0, "a")):
                hit = F.col(f"vote_{r.name}") == v
                sums += [F.sum(F.when(hit, g).otherwise(0.0)).alias(f"g_{tag}_{r.name}"), F.sum(F.when(hit, b).otherwise(0.0)).alias(f"b_{tag}_{r.name}")]
        row = patterns.withColumn("_g", posterior(rules, model)).agg(*sums).first()
        rates = {}
        for r in rules:
            rates[r.name] = tuple(tuple((row[f"{k}_{tag}_{r.name}"] + 0.5) / (row[total] + 1.5) for tag in "yna") for k, total in (("g", "good"), ("b", "bad")))
        fresh = Model((row["good"] + 0.5) / (n + 1), rates)
        moved = abs(fresh.share - model.share) + sum(abs(x - y) for name in rates for p, q in zip(rates[name], model.rates[name]) for x, y in zip(p, q))
        model = fresh
        if moved < 1e-6:
            break
    return model


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``carry`` columns (all but the text if not given; keep them few, they are written once), the base features, base_failed, the votes, p_good and kept, of every row.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows.  kept: not base_failed and p_good at
    or over ``threshold``; the model is fitted on rows that do not fail.  Empty and null texts fail; repeated rows count each;
    texts of any length are read whole; columns named like those made here are replaced; an empty table gives an empty one.
    """
    made = {*FEATURES, *MORE, "base_failed", "p_good", "kept", *(f"vote_{r.name}" for r in rules)}
    carried = [n for n in (docs.columns if carry is None else carry) if n not in made and (carry or n != text)]
    feats = base_features(docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*carried, text])]), text)
    feats = feats.select(*[F.col(f"`{n}`") for n in carried], *FEATURES, *MORE)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = cut(feats.select("*", failed.alias("base_failed"), *[vote(r).alias(f"vote_{r.name}") for r in rules]))
    model = fit(voted.where("not base_failed"), rules)
    return voted.withColumn("p_good", posterior(rules, model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
