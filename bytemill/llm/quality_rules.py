"""Quality rules: a threshold table compiled into one projection of column expressions.

Every metric is a ratio of counts over the whole text. Repeated three-word windows are found by
sorting the windows' 64-bit hashes inside the row, and only in texts whose hashes are not distinct;
no row leaves its partition.

Defined cases: a null text has no words and fails the base rule; a division by zero words or lines
counts as ratio 0; a ratio at a threshold passes; other null columns pass through; repeated rows get equal
results; very long texts are measured whole, in time of n log n windows; an empty table gives an empty
result; columns that clash with the result's are replaced. A text in a language without stop words in the
list fails that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.text import BLANKS, let, whole, without, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "the of and to in is that it for was with as be by on are this at from or an not have but they which "
    "der die und den das von mit ist im dem nicht ein eine des zu auf sich für "
    "de la le les et des un une du que est pour qui dans par pas au en "
    "el los las y del se una con por no su para es al lo como más"
).split()
#: name, numerator, denominator, least, most. A text is kept if every ratio lies between the two.
RULES = (
    ("word_length", "word_chars", "n_words", 2.0, 16.0),
    ("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    ("stop_words", "n_stop", "n_words", 0.06, 1.0),
    ("words_per_line", "n_words", "n_lines", 2.0, 100_000.0),
)
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _repeated(hashes: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def search(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

        def look(g: Column) -> Column:
            ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(ordered, covered))

        return F.when(F.size(h) < 3, F.lit(0).cast("long")).otherwise(let(windows, look))

    return let(hashes, search)


def measures(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """The rows with every count that the rules use, n_lines and n_stop among them."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    per_words = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(list(stop_words)))).cast("long").alias("n_stop"),
        _repeated(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
    ))
    per_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    out = docs.drop(*ADDED, "n_stop", "n_lines").withColumns({"_w": per_words, "_l": per_lines})
    return out.withColumns({
        "n_words": F.col("_w.n_words"), "word_chars": F.char_length(without(text, BLANKS)).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": F.col("_l.n_dup_lines"), "n_repeat_words": F.col("_w.n_repeat_words"),
        "n_stop": F.col("_w.n_stop"), "n_lines": F.col("_l.n_lines"),
    }).drop("_w", "_l")


def verdict(measured: DataFrame, rules=RULES) -> DataFrame:
    """Adds base_failed and kept from the counts of ``measures``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = F.lit(True)
    for _, top, bottom, least, most in rules:
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        good = good & ratio.between(F.lit(least), F.lit(most))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & good)


def quality_rules(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """The rows with ADDED; for languages beyond those of STOP_WORDS, pass their words or rules without that ratio."""
    return verdict(measures(docs, stop_words), rules)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c
  FROM (SELECT doc_id, i AS p, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, len(l) AS n_lines
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
""" + "".join(f"       AND coalesce({a}::DOUBLE / nullif({b}, 0), 0.0) BETWEEN {lo} AND {hi}\n" for _, a, b, lo, hi in RULES) + "       AS kept\nFROM m\n"
