"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a Spark expression over the whole text; the verdict is one boolean built from
the table. Nothing is shuffled: each row is judged by itself.

Defined results: a null or empty text has no words, fails the base rule and is not kept; rows
that repeat are judged alike; columns of the input that share a name with a result (in any case
of letters) are replaced by it in `judge`, all others and all in `passing` stay as they are; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the languages served (English, German, French, Spanish).
STOP_WORDS = tuple(
    "the of and to in is that it was for on are as with his they at be this have from or by not but what all were when we there "
    "an which their will each about how up out them then so some her would make like him into has two more no way could "
    "der die das und ist von zu den mit nicht ein eine auch auf für im des dem sich als bei wird "
    "le la les de des et en un une du que qui dans pour par sur au avec ne pas ce il elle est "
    "el los las y a se por una su con para lo como más o pero sus".split()
)


@dataclass(frozen=True)
class Threshold:
    """measure must lie in [least, most]; a null bound is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The table. Ratios are per word (upper case: per character in words; lines: per line with a
#: word); stop_words is the number of different stop words found.
THRESHOLDS = (
    Threshold("mean_word_length", 2.0, 12.0),
    Threshold("symbol_ratio", most=0.1),
    Threshold("bang_ratio", most=0.2),
    Threshold("upper_ratio", most=0.5),
    Threshold("stop_words", least=1),
    Threshold("dup_line_ratio", most=0.4),
)


def bind(value: Column, use) -> Column:
    """use(value) with value computed once per row, also where `use` refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def window_hashes(words: Column) -> Column:
    """A hash of every window of WINDOW words."""

    def windows(h: Column) -> Column:
        first = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), windows)


def repeated_words(windows: Column) -> Column:
    """Words inside a window whose sequence is found twice or more in the text; only texts with such windows sort theirs."""

    def starts(s: Column) -> Column:  # s: (hash, place) in order
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    # windows start in order: each adds the words that its predecessor doesn't hold
    total = F.aggregate(
        bind(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")),
        lambda acc, i: F.struct((acc["n"] + F.least(i - acc["p"], F.lit(WINDOW))).alias("n"), i.alias("p")),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total["n"]).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Base counts of a text, each over the whole of it; `_words` and `_windows` must be its words and window hashes."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_windows")),
        "_lines": F.size(lines),
        "_bangs": F.coalesce(F.regexp_count(text, F.lit("!")), F.lit(0)),
        "_upper": F.coalesce(F.regexp_count(text, F.lit("\\p{Lu}")), F.lit(0)),
        "_stop": F.size(F.array_intersect("_words", F.array(*[F.lit(v) for w in STOP_WORDS for v in (w, w.capitalize())]))),
    }


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "bang_ratio": F.col("_bangs") / n,
        "upper_ratio": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_words": F.col("_stop").cast("double"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
    }


def compiled(table: tuple[Threshold, ...]) -> Column:
    """The threshold table as one boolean expression over the ratios."""
    verdict = F.lit(True)
    for t in table:
        if t.least is not None:
            verdict = verdict & (F.col(t.measure) >= t.least)
        if t.most is not None:
            verdict = verdict & (F.col(t.measure) <= t.most)
    return verdict


def _judged(docs: DataFrame, text: str, table: tuple[Threshold, ...]) -> DataFrame:
    """(row, counts, ratios, base_failed, kept): row is the whole row of docs, so no name of its columns matters."""
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = docs.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), column(text).alias("text"))
    out = out.withColumn("_words", word_list(F.col("text"))).withColumn("_windows", window_hashes(F.col("_words")))
    out = out.withColumns(measures(F.col("text"))).withColumns(ratios())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & compiled(table))


def judge(docs: DataFrame, text: str = "text", table: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Add the base counts, the ratios, base_failed and kept to every row of docs."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *ratios(), "base_failed", "kept"]
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in made]
    return _judged(docs, text, table).select(*own, *made)


def passing(docs: DataFrame, text: str = "text", table: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, also where a name is that of a measure."""
    return _judged(docs, text, table).where("kept").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *ratios())


_STOP_LIST = ", ".join("'" + v + "'" for w in STOP_WORDS for v in (w, w.capitalize()))

#: The same over DuckDB's `documents`: windows are compared as lists of words.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM w GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
            FROM (SELECT doc_id, i, unnest(range(0, {WINDOW})) AS k FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '!')) AS bangs,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS upper_chars,
         CAST(len(list_intersect(words, [{_STOP_LIST}])) AS DOUBLE) AS stop_words
  FROM d LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS mean_word_length,
         CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbol_ratio,
         CAST(bangs AS DOUBLE) / greatest(n_words, 1) AS bang_ratio,
         CAST(upper_chars AS DOUBLE) / greatest(word_chars, 1) AS upper_ratio,
         CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_ratio,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(c for t in THRESHOLDS for c in ([f"{t.measure} >= {t.least}"] if t.least is not None else []) + ([f"{t.measure} <= {t.most}"] if t.most is not None else []))} AS kept,
       mean_word_length, symbol_ratio, bang_ratio, upper_ratio, stop_words, dup_line_ratio
FROM r
"""
