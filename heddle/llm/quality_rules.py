"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a Column that is true where it rejects a document, and a Column
that tells its work: the characters that it reads. On a bounded sample each
rule's cost (mean work) and selectivity (share that it rejects) are estimated in
one pass; the cascade then tests rules by falling rejection per cost and stops
at the first that rejects. Work is counted, not timed, so reruns agree on the
order and on the rule that is named. The order never changes the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SPACE, WORD, sampled, text_of

#: About how many rows the cost and selectivity of a rule are estimated on.
SAMPLE_ROWS = 2000


def with_text_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long).

    Whole texts count; null has no words. A document without two equal 3-word
    windows is told by a hash set of their 64-bit hashes; only others sort them.
    """
    inner = docs.withColumn("__text", text_of()).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), 0))
    grams = """if(size(__words) < 3, cast(array() as array<bigint>),
      transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"""
    inner = inner.withColumn("__grams", F.expr(grams))
    inner = inner.withColumn("__again", F.expr("size(array_distinct(__grams)) < size(__grams)"))
    pairs = "sort_array(transform(__grams, (g, i) -> named_struct('g', g, 'i', i)))"
    inner = inner.withColumn("__pairs", F.expr(f"if(__again, {pairs}, null)"))
    twice = """if(__again, sort_array(transform(
      filter(__pairs, (p, k) -> (k > 0 and __pairs[k - 1].g = p.g) or (k + 1 < size(__pairs) and __pairs[k + 1].g = p.g)),
      p -> p.i)), null)"""
    inner = inner.withColumn("__twice", F.expr(twice))
    covered = """if(__again, aggregate(__twice, named_struct('n', 0L, 'end', 0),
      (a, i) -> named_struct('n', a.n + i + 3 - greatest(a.end, i), 'end', i + 3), a -> a.n), 0L)"""
    inner = inner.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = inner.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("__text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    return out


def share(count: Column, of: Column, most: float) -> Column:
    return count > most * of


def _count(pattern: str) -> Column:
    return F.char_length(text_of()) - F.char_length(F.regexp_replace(text_of(), pattern, ""))


@dataclass(frozen=True)
class Rule:
    rejects: Column
    scans: int = 0  #: How often it reads the whole text, besides the counts that are there.

    @property
    def work(self) -> Column:
        return 1 + self.scans * F.char_length(text_of())


def rules() -> dict[str, Rule]:
    """name -> rule. Null texts and texts without words pass them all (the base rules take those)."""
    c = F.col
    letters = _count(r"\p{L}")
    return {
        "symbols": Rule(share(c("n_symbols"), c("n_words"), 0.3)),
        "word_length": Rule((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        "dup_lines": Rule(share(c("n_dup_lines"), c("n_lines"), 0.5)),
        "capitals": Rule((letters > 0) & share(_count(r"\p{Lu}"), letters, 0.5), scans=2),
        "exclamations": Rule(share(_count("!"), c("n_words"), 0.5), scans=1),
        "letters": Rule(share(c("word_chars") - letters, c("word_chars"), 0.5), scans=1),
    }


def ordered(docs: DataFrame, tests: dict[str, Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, mean work, share rejected) by falling rejection per cost, then by cost and name, from about ``sample_rows`` rows of ``docs``."""
    sample = with_text_counts(sampled(docs, sample_rows))
    told = [F.sum(x).alias(f"{what}_{name}") for name, r in tests.items() for what, x in (("work", r.work), ("hit", F.coalesce(r.rejects, F.lit(False)).cast("int")))]
    row = sample.agg(F.count("*").alias("n"), *told).first()
    n = max(1, row["n"])
    found = [(name, (row[f"work_{name}"] or 0) / n, (row[f"hit_{name}"] or 0) / n) for name in tests]
    return sorted(found, key=lambda x: (-x[2] / max(1, x[1]), x[1], x[0]))


def cascade(tests: dict[str, Rule], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects; null if none does. Later rules aren't evaluated."""
    out = None
    for name in order:
        test = F.coalesce(tests[name].rejects, F.lit(False))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    One row per row of ``docs``. Null and empty texts have zero counts and fail
    the base rules. Repeated rows are judged alike; an empty table gives no
    rows; columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", "text")
    counted = with_text_counts(rows)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tests = rules()
    order = [x[0] for x in ordered(rows, tests, sample_rows)]
    counted = counted.withColumn("base_failed", base_failed)
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(tests, order))
    return counted.withColumn("failed_rule", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule"
    )
