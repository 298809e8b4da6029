"""Spelling variants of frequent words: one-edit neighbours found over a reduced alphabet.

Letters are hashed to a few symbols. Every word's reduced form gets its full one-edit neighbourhood (itself, all deletions,
replacements and insertions of symbols), which is joined with the reduced forms of the vocabulary; the join itself checks
the original strings, so only near words leave it. Words that differ by one edit have reduced forms that differ by one
edit at most, so none is missed. All of it is column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import col
from ledgerwatch.llm.common import materialize, partitions, prepare

#: Letters of a word, as character ranges, and the symbols they are hashed to.
LETTERS, SYMBOLS = (("A", "Z"), ("a", "z"), ("À", "ÿ")), "01234567"
UPPER = "".join(map(chr, range(65, 91)))


def lower_ascii(word) -> Column:
    """The word with A-Z in lower case; all other characters stay."""
    return F.when(col(word).rlike("[A-Z]"), F.translate(col(word), UPPER, UPPER.lower())).otherwise(col(word))


def letter_runs(text) -> Column:
    """Maximal runs of letters, as an array."""
    return F.regexp_extract_all(col(text), F.lit("[" + "".join(f"{a}-{b}" for a, b in LETTERS) + "]+"), F.lit(0))


def reduced(word) -> Column:
    """The word with each letter replaced by its symbol."""
    letters = "".join(chr(c) for a, b in LETTERS for c in range(ord(a), ord(b) + 1))
    return F.translate(col(word), letters, "".join(SYMBOLS[ord(c) % len(SYMBOLS)] for c in letters))


def neighbourhood(form) -> Column:
    """The reduced form and all forms one deletion, replacement or insertion away, each once, as an array."""
    form, n = col(form), F.length(col(form))
    symbols = F.array(*map(F.lit, SYMBOLS))

    def head(i: Column) -> Column:
        return F.substring(form, F.lit(1), i)

    def edits(last: Column, make) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), last), make))

    def with_symbol(skipped: int):
        return lambda i: F.transform(symbols, lambda s: F.concat(head(i), s, F.substring(form, i + 1 + skipped, n)))

    dropped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(head(i), F.substring(form, i + 2, n)))
    return F.array_distinct(F.concat(F.array(form), dropped, edits(n - 1, with_symbol(1)), edits(n, with_symbol(0))))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n) for both directions of all pairs of words one edit apart; ``vocabulary`` has distinct (word, n).

    The relation is symmetric, so of a neighbourhood only the forms that come no later than the word's own (by length, then
    symbols) are sent to the join: each pair meets once, on the side of the later form. A reduced form shared by many
    words is a skewed key of an ordinary join, which Spark splits; comparisons stop after one edit. The join sorts both sides
    whatever their size: Spark sizes the neighbourhoods as the vocabulary they are made of, hundreds of times too low, and
    would broadcast them.
    """
    spread = vocabulary.repartition(partitions(vocabulary.sparkSession), "word")
    forms = spread.select("word", "n", reduced("word").alias("form"))
    size = F.length("key")
    keys = forms.select("word", "n", "form", F.explode(neighbourhood("form")).alias("key")).where(
        (size < F.length("form")) | ((size == F.length("form")) & (F.col("key") <= F.col("form")))
    )
    left = keys.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "key", (F.col("key") == F.col("form")).alias("same"))
    right = forms.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("form").alias("key_b"))
    meets = (F.col("key") == F.col("key_b")) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    pairs = left.join(right.hint("merge"), meets).select("a", "n_a", "b", "n_b")
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.word", "p.near", "p.n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words of ``forms`` (word, form): the last word when forms are followed, by doubling steps.

    Forms must lead to no circle, as those of growing counts do. Chains are written once per round; a round halves them.
    No side is broadcast: words take many times their size in files in memory.
    """
    links = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = materialize(stepped, "spelling-roots")
        links = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            break
    return forms.select("word").join(links.hint("merge"), "word", "left").select("word", F.coalesce("root", "word").alias("root"))


def variants(vocabulary: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, form, root, n_near, form_n of each row of ``vocabulary`` (distinct words with their counts ``n``).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) where that n is at least ``factor``
    times the word's own, else null; ``root`` is where following forms ends. The best near word is a combined aggregate,
    so a word with many neighbours is no group in one task.
    """
    best = F.min(F.struct((-F.col("n")).alias("least"), F.col("near"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(best, F.count(F.lit(1)).alias("n_near"))
    joined = vocabulary.join(near.hint("merge"), "word", "left")
    common = -F.col("best.least") >= F.col("n") * factor
    found = materialize(
        joined.select(
            "word", "n", F.when(common, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, -F.col("best.least")).cast("long").alias("form_n"),
        ),
        "spelling-forms",
    )
    return found.join(roots(found).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, word, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """Spelling variants among the words of all texts of ``docs``, see ``variants``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case, passed through ``word(id, run)``, which
    makes no run longer, of at least ``least_length`` code points; those with ``least_count`` occurrences or more make up the vocabulary. Runs are
    counted before they are shuffled, and repeated rows count as often as they occur. A null text has no words; a null id is
    passed to ``word`` as null. Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    runs = docs.select(F.col(id_col).alias("id"), F.explode(letter_runs(text_col)).alias("run")).where(F.length("run") >= least_length)
    said = runs.select(word(F.col("id"), lower_ascii("run")).alias("word")).where(F.length("word") >= least_length)
    counted = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return variants(materialize(counted, "spelling-words"))
