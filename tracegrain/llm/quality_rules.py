"""Quality rules: a learned decision list over statistics of the text, all in Spark expressions.

Sequential covering: rules for the reject class are grown one after another. A rule is a conjunction of
thresholds; each threshold added is the one of highest FOIL gain on the growing part of the labelled
rows, and the rule is then pruned from its end on the other part, as long as that doesn't lower
(p - n) / (p + n). Rows that a rule covers leave. It ends when a rule's precision on the pruning part falls below
the bound. The list is an ordered chain of `when` expressions: the first rule that holds gives the verdict.

The labelled rows are a bounded sample, `max_labelled`, of the lowest hashes of the id; their statistics
(a few numbers a row) are what reaches the driver. All rows are judged, each from its whole text, by built-in
functions in one scan without a shuffle.

Cases: a null text has no word. A text without words has all statistics 0. Labels that are null, and labelled ids
without a document, don't count; of labelled rows that share an id, the one of the smallest statistics counts. Without a reject label the list is
empty and all that pass the base rules are kept. Columns of the input keep their values, but for those named as a statistic, a feature, base_failed, rule
or kept, which are replaced; names that start with two underscores are the module's own. Of candidates of equal gain the first in FEATURES' order and of the
lowest threshold is taken. Repeated rows get a verdict each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends words, as in a regular expression's set.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits")

#: What rules may compare: shares and means, so that a text's length alone rejects nothing.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """df with n_repeat_words, from __h, the word hashes: the words in 3-word windows that occur twice or more.

    Windows are equal if all 64 bits of their hashes are, which a sort of (hash, place) tells. Up to 2**24 words, a window's
    first 40 bits and its place share a long, and a faster sort of longs tells first which windows may have an equal.
    """
    n, at = F.size("__h"), lambda i: F.get("__h", i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("__w", F.when(n >= 3, windows).otherwise(F.array().cast("array<long>")))
    place, few = F.lit((1 << 24) - 1).cast("long"), n <= 1 << 24
    df = df.withColumn("__s", F.when(few, F.sort_array(F.transform("__w", lambda h, i: h.bitwiseAND(F.lit(-1 << 24).cast("long")).bitwiseOR(i.cast("long"))))))

    def equal(s: str, key) -> Column:
        """The entries of a sorted array whose key is also the one before or after."""
        near = lambda x, i: F.coalesce(key(x) == key(F.get(s, i)), F.lit(False))
        return F.filter(s, lambda x, i: near(x, i + 1) | near(x, i - 1))

    short = F.transform(equal("__s", lambda x: F.shiftright(x, 24)), lambda x: x.bitwiseAND(place).cast("int"))
    df = df.withColumn("__m", F.when(few, F.transform(short, lambda i: F.struct(F.get("__w", i).alias("h"), i.alias("i")))).otherwise(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__l", F.sort_array("__m"))
    places = F.transform(equal("__l", lambda x: x["h"]), lambda x: x["i"])
    # of a window, the words past the end of the window before it
    words = F.aggregate(
        F.sort_array(places), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"), p.alias("last")), lambda acc: acc["sum"],
    )
    return df.withColumn("n_repeat_words", words).drop("__w", "__s", "__m", "__l")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with a column for each base statistic and each of FEATURES."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__h", F.transform(words_of(F.col("__t")), lambda w: F.xxhash64(w)))
    text = F.col("__t")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    plain = F.translate(text, SPACE_CHARS, "")
    out = _with_repeated_words(df).withColumns({
        "n_words": F.size("__h").cast("long"),
        "word_chars": F.length(plain).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_upper": _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _count_of(text, "!?|#*$%&<>{}[]=_~^@;"),
        "n_digits": _count_of(text, "0123456789"),
    }).drop("__t", "__h")
    # through a generator, or a filter on a statistic would be pushed below and compute all of them again in place
    out = out.select(*(c for c in out.columns if c not in STATISTICS), F.inline(F.array(F.struct(*STATISTICS))))
    return out.withColumns({k: F.expr(f"cast({v} as double)") for k, v in FEATURES.items()})


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.value) == self.above

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.above else c < self.value


Rule = tuple[Threshold, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(t.holds(r) for t in rule)]


def _candidates(rows: list[dict], cuts: int) -> list[Threshold]:
    out = []
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        steps = [values[i * len(values) // cuts] for i in range(1, cuts)] if len(values) > cuts else values[1:]
        out += [Threshold(f, above, v) for v in sorted(set(steps)) for above in (True, False)]
    return out


def _bad(rows: list[dict]) -> int:
    return sum(r["bad"] for r in rows)


def _grow(rows: list[dict], cuts: int, most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most and 0 < _bad(rows) < len(rows):
        p0, n0 = _bad(rows), len(rows)
        best, gain = None, 1e-9
        for t in _candidates(rows, cuts):
            inside = [r["bad"] for r in rows if t.holds(r)]
            if (p := sum(inside)) and (g := p * (math.log2(p / len(inside)) - math.log2(p0 / n0))) > gain:
                best, gain = t, g
        if best is None:
            break
        rule, rows = (*rule, best), _covers((best,), rows)
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    """(p - n) / (p + n); an unseen rule is worth nothing."""
    inside = _covers(rule, rows)
    return (2 * _bad(inside) - len(inside)) / len(inside) if inside else -1.0


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    best = rule
    for n in range(len(rule) - 1, 0, -1):
        if _worth(rule[:n], rows) >= _worth(best, rows):
            best = rule[:n]
    # of two thresholds of one feature in the same direction, the stricter one says all
    bound = {(t.feature, t.above): (max if t.above else min)(u.value for u in best if (u.feature, u.above) == (t.feature, t.above)) for t in best}
    return tuple(dict.fromkeys(Threshold(f, above, v) for (f, above), v in bound.items()))


def learn(rows: list[dict], precision: float = 0.98, least: int = 5, cuts: int = 24, most: int = 3, rules: int = 24) -> list[Rule]:
    """The decision list from rows of FEATURES, `bad` (1: reject) and `part` (0 to 2; 2 prunes)."""
    out: list[Rule] = []
    grow, prune = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
    while len(out) < rules and _bad(grow):
        rule = _prune(_grow(grow, cuts, most), prune)
        inside = _covers(rule, grow + prune)
        if not rule or len(inside) < least or _bad(inside) < precision * len(inside):
            break
        out.append(rule)
        grow, prune = ([r for r in part if not all(t.holds(r) for t in rule)] for part in (grow, prune))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> list[dict]:
    """Statistics of at most max_labelled labelled documents, those of the lowest hashes of their ids."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "__id")), "__id")
    found = statistics(found, "__text").select(*FEATURES, (F.col("__label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)).alias("part"), F.xxhash64("__id").alias("o"), "__id")
    # of rows that share an id one, so no more than max_labelled reach the driver
    one = found.groupBy("__id").agg(F.min(F.struct("o", *FEATURES, "bad", "part")).alias("x")).select("x.*")
    return sorted((r.asDict() for r in one.collect()), key=lambda r: (r["o"], *(r[f] for f in FEATURES)))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for t in rule:
            test &= t.column()
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with their statistics, base_failed, rule (0: none) and kept."""
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return statistics(docs, text_col).withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000) -> DataFrame:
    """judge() by rules learned from labels (label_col: 0 reject, else keep)."""
    return judge(docs, learn(labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled)), text_col)
