"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once and keeps, for each row, the measurements and a bit for each failed rule; ``stored_ledger`` writes
that, without texts, for any number of policies to read. Policies are sets of rules with a version; ``apply_policy`` is one bitwise test, and ``ablations`` needs only the counts of distinct masks.

Words are runs without ASCII white space. Windows of eight words are compared by a 64-bit hash within one text. Null text has no
words and fails as too short; null ids stay null, repeated rows are judged each; other columns pass through ``apply_policy`` unread,
but for those with a measurement's name or ``failures``, which give way; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

WHITE = " \t\n\x0b\f\r"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]
#: Rule -> when it fails, over the measurements. A rule's place is its bit, so new rules go to the end.
RULES = {
    "too_short": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "10 * n_exclaim > 3 * n_words",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines",
}
BITS = {name: k for k, name in enumerate(RULES)}
#: Policy and version -> its rules.
POLICIES = {
    "base-1": ["too_short", "repeated_windows"],
    "strict-1": list(RULES),
}


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def repeat_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more in the array."""

    def covered(at: Column) -> Column:
        none = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(at, none, lambda a, p: F.struct((a["total"] + p + WINDOW - F.greatest(p, a["end"])).alias("total"), (p + WINDOW).alias("end")))["total"]

    def twins(pairs: Column) -> Column:
        """Starts of the windows whose hash stands next to an equal one."""
        same = lambda k, p: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        marked = F.transform(pairs, lambda p, k: F.when(same(k - 1, p) | same(k + 1, p), p["i"]))
        return F.sort_array(F.array_compact(marked))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, lambda p: covered(twins(p))))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))

    return F.when(F.size(words) > WINDOW, let(words, lambda w: let(hashed(w), count))).otherwise(F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements; columns of the same names give way."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    held = docs.drop(*MEASURES, "_words", "_lines").withColumns({"_words": words_of(text), "_lines": lines})
    return held.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_exclaim": F.regexp_count(text, F.lit("!")).cast("long"),
        }
    ).drop("_words", "_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and ``failures``, the bits of the failed rules."""
    bits = [F.when(F.expr(when), F.lit(1 << BITS[name])).otherwise(F.lit(0)).cast("long") for name, when in RULES.items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured(docs).withColumn("failures", mask)


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a written table: doc_id, the measurements, ``failures``."""
    return staged(ledger(docs).select("doc_id", *MEASURES, "failures"), "ledger")


def policy_mask(policy: str) -> int:
    return sum(1 << BITS[name] for name in POLICIES[policy])


def apply_policy(book: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    return book.withColumn(column, F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that it alone fails, rows kept without it. From counts of masks only."""
    masks, whole = book.groupBy("failures").agg(F.count("*").alias("n")), policy_mask(policy)
    hit = lambda m: F.col("failures").bitwiseAND(F.lit(m))
    per = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(hit(1 << BITS[name]) != 0, F.col("n"))), F.lit(0)).alias("fails"),
            F.coalesce(F.sum(F.when(hit(whole) == (1 << BITS[name]), F.col("n"))), F.lit(0)).alias("alone"),
            F.coalesce(F.sum(F.when(hit(whole & ~(1 << BITS[name])) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
        for name in POLICIES[policy]
    ]
    return masks.agg(F.array(*per).alias("rules")).select(F.inline("rules"))
