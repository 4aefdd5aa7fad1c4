"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

`measure` describes a whole text by lengths, symbols, repeated lines and words, stop words and
letters; `RULES` says which values are acceptable; `judge` turns both into columns. No user
function runs and nothing is shuffled: repeated word windows are found by sorting hashes inside
the row, and only windows whose hashes meet are compared as text, so counts are exact.

Defined cases: a null text has no words and fails; an empty one too; lines without a word are
never duplicates; texts are read whole whatever their length; repeated rows are judged each;
other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import let, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of the languages the rules are tuned for.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this from or an at",
    "fr": "de la le les et des en un une du dans est que qui par pour sur pas au ce",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y los del se las por un para con no una su al lo es",
}


@dataclass(frozen=True)
class Rule:
    """Acceptable values of a ratio of two measures, as `low * whole <= part <= high * whole`."""

    name: str
    part: str
    whole: str
    low: float = 0.0
    high: float = float("inf")


# The thresholds are wide: they are meant for texts that are not prose at all.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("capitals", "n_capitals", "n_letters", high=0.6),
    Rule("letters", "n_letters", "word_chars", low=0.6),
)


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("long")


def _repeated_positions(words: Column) -> Column:
    """Starts of the word windows that occur twice or more in the array.

    Each window becomes one long: 33 bits of its hash above 31 bits of its position. Sorted,
    equal hashes are neighbours; those few windows are sorted once more by their words.
    """
    low = (1 << 31) - 1

    def keys(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - WINDOW)
        return F.transform(
            starts,
            lambda i: F.shiftleft(F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))), 31).bitwiseOR(
                i.cast("long")
            ),
        )

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a, 31) == F.shiftright(b, 31), F.lit(False))

    def meeting(sorted_: Column) -> Column:
        return F.filter(
            sorted_, lambda x, i: same(x, F.get(sorted_, i - 1)) | same(x, F.get(sorted_, i + 1))
        )

    def window(ws: Column, key: Column) -> Column:
        at = key.bitwiseAND(F.lit(low)).cast("int")
        return F.struct(
            F.concat_ws(" ", *(F.get(ws, at + k) for k in range(WINDOW))).alias("words"), at.alias("at")
        )

    def repeated(windows: Column) -> Column:
        def equal(x, other):
            return F.coalesce(x["words"] == other["words"], F.lit(False))

        kept = F.filter(
            windows, lambda x, i: equal(x, F.get(windows, i - 1)) | equal(x, F.get(windows, i + 1))
        )
        return F.transform(kept, lambda x: x["at"])

    none = F.array().cast("array<int>")
    met = let(F.sort_array(keys(words)), meeting)
    exact = let(F.sort_array(F.transform(met, lambda k: window(words, k))), repeated)
    return F.when(F.size(words) < WINDOW + 1, none).otherwise(exact)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more, each counted once."""
    at = _repeated_positions(words)
    covered = F.flatten(F.transform(at, lambda p: F.sequence(p, p + WINDOW - 1)))
    return F.size(F.array_distinct(covered)).cast("long")


def _nested(text: Column) -> Column:
    """All counts of a text, nested so that no array of words or lines is made twice."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted(set(" ".join(STOP_WORDS.values()).split()))
    written = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_solid(solid: Column) -> Column:
        """Of the words without the white space between them."""
        return F.struct(
            F.length(solid).cast("long").alias("word_chars"),
            _count(solid, SYMBOLS).alias("n_symbols"),
            _count(solid, r"\p{Lu}").alias("n_capitals"),
            _count(solid, r"\P{L}").alias("n_other"),
        )

    def of_words(ws: Column) -> Column:
        # membership in a literal list is a look-up in a set
        stopped = F.filter(ws, lambda w: F.lower(w).isin(*stops))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.size(stopped).cast("long").alias("n_stop_words"),
            let(F.array_join(ws, ""), of_solid).alias("solid"),
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    return F.struct(let(words_of(text), of_words).alias("words"), let(written, of_lines).alias("lines"))


def measure(docs: DataFrame, text_col: str = "text", into: str = "measures") -> DataFrame:
    """`docs` with a struct of counts of each whole text in column `into`; all zero for null."""
    # explode keeps the counts a column of its own: later expressions read it, not recompute it
    counted = docs.drop(into).select("*", F.explode(F.array(_nested(F.col(f"`{text_col}`")))).alias(into))
    words, lines = F.col(into)["words"], F.col(into)["lines"]
    solid = words["solid"]
    return counted.withColumn(
        into,
        F.struct(
            words["n_words"].alias("n_words"),
            solid["word_chars"].alias("word_chars"),
            solid["n_symbols"].alias("n_symbols"),
            lines["n_lines"].alias("n_lines"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"),
            words["n_stop_words"].alias("n_stop_words"),
            solid["n_capitals"].alias("n_capitals"),
            (solid["word_chars"] - solid["n_other"]).alias("n_letters"),
        ),
    )


def base_failed(m: Column) -> Column:
    repeats = m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT
    return (m["n_words"] < MIN_WORDS) | repeats


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures break."""
    broken = []
    for rule in rules:
        part, whole = m[rule.part].cast("double"), m[rule.whole].cast("double")
        bad = part < whole * rule.low
        if rule.high != float("inf"):
            bad = bad | (part > whole * rule.high)
        broken.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `measures`, `base_failed`, `broken` (rule names) and `kept`.

    The new columns replace columns of the same names.
    """
    name = "measures"
    counted = measure(docs, text_col, name)
    m = F.col(name)
    failed, broken = base_failed(m), verdict(m, rules)
    return counted.withColumns({"base_failed": failed, "broken": broken, "kept": ~failed & (F.size(broken) == 0)})
