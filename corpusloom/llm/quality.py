"""Quality rules as weak supervision.

Every rule looks at one figure of a text and votes good, votes bad or abstains.
How far each rule can be trusted isn't set by hand: expectation-maximisation
estimates, from all documents that pass the base rules, how often it is right on good and on bad texts.
The posterior probability that a text is good then decides, so that one odd
figure doesn't cost a document its place, as it would where all rules must pass.

Only DataFrame functions touch the rows. The model is fitted to the histogram
of vote patterns, which has at most 3 ** len(RULES) rows (531,441; some hundreds
in practice), however many documents there are.

Defined cases: a null or empty text has no words, which fails the base rules;
rows that repeat are judged alike, each for itself; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, WORD, cut, fresh, let

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_letters", "n_upper", "n_lines", "n_ended", "n_distinct", "n_function", "n_adjacent", "n_bare")
#: Common words of English, Spanish, French and German that running prose can't do without.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he at are this have from or had an which one "
    "de la que el en y los del se las por un para con no una su al lo le et les des est dans qui pas sur au par il plus ce pour avec "
    "der die und von zu das mit sich auf für ist im dem nicht ein eine auch es er als"
).split()


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words in 5-word windows that are found twice or more, from the words' hashes."""

    def starts(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: (a["h"] == b["h"]) & (F.slice(hashes, a["i"] + 1, 5) == F.slice(hashes, b["i"] + 1, 5))
        return let(
            ordered,
            lambda o: F.array_sort(
                F.transform(
                    F.filter(o, lambda x, k: F.coalesce(same(x, F.get(o, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(o, k + 1)), F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(5)), F.lit(5)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(starts(windows), covered))

    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)]))
    return F.when(n < 6, F.lit(0).cast("long")).otherwise(let(windows, count))


def features(text: Column) -> Column:
    """A struct with the figures of a text that the rules use, all counts."""
    text = F.coalesce(text, F.lit(""))
    only = lambda keep: F.char_length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")

    def of_words(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.struct(
            n.cast("long").alias("n_words"),
            _repeat_words(hashes, n).alias("n_repeat_words"),
            F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"),
            F.size(F.filter(hashes, lambda h: h.isin(*[F.xxhash64(F.lit(w)) for w in dict.fromkeys(FUNCTION_WORDS)]))).cast("long").alias("n_function"),
            F.size(F.filter(hashes, lambda h, i: h == F.get(hashes, i - 1))).cast("long").alias("n_adjacent"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…:;]['\"”»)]*\s*$"))).cast("long").alias("n_ended"),
        )

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return let(
        F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l")),
        lambda x: F.struct(
            x["w"]["n_words"].alias("n_words"),
            F.char_length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
            only(r"#*$%&|<>").alias("n_symbols"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"),
            only(r"\p{L}").alias("n_letters"),
            only(r"\p{Lu}").alias("n_upper"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_ended"].alias("n_ended"),
            x["w"]["n_distinct"].alias("n_distinct"),
            x["w"]["n_function"].alias("n_function"),
            x["w"]["n_adjacent"].alias("n_adjacent"),
            F.regexp_count(text, F.lit(rf"(?<![^{SPACE_CLASS}])[^{SPACE_CLASS}\p{{L}}\p{{N}}]+(?![^{SPACE_CLASS}])")).cast("long").alias("n_bare"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """Votes good between two bounds, bad outside two wider ones, and abstains in the gaps."""

    name: str
    over: str
    under: str | None
    good: tuple[float, float]
    fair: tuple[float, float]
    least: tuple[str, int] = ("n_words", 1)

    def vote(self, x: Column) -> Column:
        value = x[self.over].cast("double")
        if self.under:
            value = value / F.greatest(x[self.under], F.lit(1))
        known = x[self.least[0]] >= self.least[1]
        return F.when(known & value.between(*self.good), 1).when(known & ~value.between(*self.fair), -1).otherwise(0)


INF = float("inf")
RULES = (
    Rule("length", "n_words", None, (60, INF), (25, INF), ("n_words", 0)),
    Rule("word_length", "word_chars", "n_words", (3.5, 9), (2.5, 13)),
    Rule("symbols", "n_symbols", "n_words", (0, 0.01), (0, 0.1)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0, 0.02), (0, 0.3), ("n_lines", 2)),
    Rule("repeated_windows", "n_repeat_words", "n_words", (0, 0.02), (0, 0.2), ("n_words", 20)),
    Rule("letters", "n_letters", "word_chars", (0.85, 1), (0.65, 1), ("n_words", 20)),
    Rule("capitals", "n_upper", "n_letters", (0, 0.15), (0, 0.35), ("n_letters", 20)),
    Rule("line_ends", "n_ended", "n_lines", (0.7, 1), (0.3, 1), ("n_words", 20)),
    Rule("variety", "n_distinct", "n_words", (0.3, 1), (0.15, 1), ("n_words", 50)),
    Rule("function_words", "n_function", "n_words", (0.1, 1), (0.04, 1), ("n_words", 50)),
    Rule("stutter", "n_adjacent", "n_words", (0, 0.04), (0, 0.1)),
    Rule("bare_marks", "n_bare", "n_words", (0, 0.05), (0, 0.2)),
)
#: What a rule is taken to be before any document is seen: how often its vote is right on good and on bad texts,
#: the share of good texts, and how many documents that counts for.
ON_GOOD, ON_BAD, SHARE, WEIGHT = 0.98, 0.3, 0.8, 20


def base_failed(x: Column) -> Column:
    return (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])


@dataclass(frozen=True)
class LabelModel:
    """Of each rule, how often its vote is right on good and on bad texts; and the share of good texts."""

    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    share: float

    def posterior(self, votes: list) -> float:
        s = math.log(self.share / (1 - self.share))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            s += v and (math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))

    def column(self, votes: list[Column]) -> Column:
        s = F.lit(math.log(self.share / (1 - self.share)))
        for v, g, b in zip(votes, self.on_good, self.on_bad, strict=True):
            s = s + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-s))


def fit(histogram: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 300, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents show each.

    It starts from the priors: rules seldom vote bad on good texts, and a bad text
    fails few of them. The priors count for WEIGHT documents in each step, which keeps a
    rule that seldom votes from ending at certainty, or upside down. No documents give the priors.
    """
    histogram = sorted(histogram)
    total = sum(n for _, n in histogram)
    model = LabelModel((ON_GOOD,) * rules, (ON_BAD,) * rules, SHARE)
    for _ in range(rounds):
        p = [model.posterior(list(v)) for v, _ in histogram]
        good, bad = [], []
        for r in range(rules):
            g = [(q * n, v[r]) for q, (v, n) in zip(p, histogram, strict=True) if v[r]]
            b = [((1 - q) * n, v[r]) for q, (v, n) in zip(p, histogram, strict=True) if v[r]]
            good.append((WEIGHT * ON_GOOD + sum(w for w, v in g if v > 0)) / (WEIGHT + sum(w for w, _ in g)))
            bad.append((WEIGHT * ON_BAD + sum(w for w, v in b if v < 0)) / (WEIGHT + sum(w for w, _ in b)))
        share = (WEIGHT * SHARE + sum(q * n for q, (_, n) in zip(p, histogram, strict=True))) / (WEIGHT + total)
        # a rule that is no better than chance loses its say; it never speaks for the other side
        pairs = [(g, b) if g + b > 1 else ((g + 1 - b) / 2, (b + 1 - g) / 2) for g, b in zip(good, bad, strict=True)]
        old, model = model, LabelModel(tuple(g for g, _ in pairs), tuple(b for _, b in pairs), share)
        if max(abs(x - y) for x, y in zip(old.on_good + old.on_bad, model.on_good + model.on_bad, strict=True)) < tolerance:
            break
    return model


def score(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> tuple[DataFrame, LabelModel, dict[str, str]]:
    """``docs`` (of its columns those in ``keep``) with figures, posterior and verdict of each row.

    Returns the frame, the fitted model and the names of the added columns
    (``features``, ``quality``, ``base_failed``, ``kept``). The texts are read
    once: figures go to a table, which both the fit and the result read.
    """
    keep = docs.columns if keep is None else keep
    spare = docs.select(*keep)
    x, quality, base, kept = fresh(spare, "features", "quality", "base_failed", "kept")
    figures = cut(docs.withColumn(x, features(docs[text])).select(*[docs[c] for c in keep], x), "quality")
    votes = [r.vote(F.col(x)) for r in rules]
    counts = figures.filter(~base_failed(F.col(x))).groupBy(*[v.alias(f"v{i}") for i, v in enumerate(votes)]).count()
    model = fit([(tuple(row[:-1]), row[-1]) for row in counts.collect()], len(rules))  # at most 3 ** len(rules) rows
    out = figures.withColumn(base, base_failed(F.col(x))).withColumn(quality, model.column(votes))
    out = out.withColumn(kept, ~F.col(base) & (F.col(quality) >= 0.5))
    return out, model, {"features": x, "quality": quality, "base_failed": base, "kept": kept}


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with the columns of ``docs``."""
    scored, _, names = score(docs, text)
    return scored.filter(F.col(names["kept"])).select(*docs.columns)
