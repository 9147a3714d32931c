"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, split_words, table

SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 5
#: Rows of the sample that costs and selectivities are estimated on (in expectation), and how often each is judged.
SAMPLE_ROWS, TIMES = 2000, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    """Code points of ``text`` besides ``chars``; by a pattern, since translate looks up every character."""
    return F.length(F.regexp_replace(text, "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]+", ""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return split_words(text)


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; ``hashes``: 64-bit hashes of the words.

    Most texts repeat no window; they are told by a hash set. For the others windows are sorted with their places, and
    each place adds the words that its window has before the next such window starts.
    """
    n = F.size(hashes)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )

    def places(found: Column) -> Column:
        def twice(s: Column) -> Column:
            at = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(at, lambda x: x["i"]))

        return let(F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)

    def covered(found: Column) -> Column:
        return let(
            places(found),
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long")
                ),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
        )

    counted = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)),
    )
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
        lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )


def line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns that :func:`prepare` adds; true rejects the row, null doesn't."""

    name: str
    rejects: Column


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def measures(t: Column, w: Column) -> dict[str, Column]:
    """The base measures of a text ``t`` whose words have the hashes ``w``."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": without(t, SPACE_CHARS).cast("long"),
        "n_symbols": (F.length(t) - without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": duplicate_lines(t),
        "n_repeat_words": repeat_words(w),
    }


def base_rules(m: dict[str, Column]) -> list[Rule]:
    return [
        Rule("few_words", m["n_words"] < 10),
        Rule("repeated_windows", 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ]


def more_rules(m: dict[str, Column], t: Column, w: Column) -> list[Rule]:
    """Rules beyond the base ones. Their limits lie far from ordinary prose, so clean documents pass."""
    capitals = F.length(t) - without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    small = F.length(t) - without(t, "abcdefghijklmnopqrstuvwxyz")
    return [
        Rule("symbols", 10 * m["n_symbols"] > m["n_words"]),
        Rule("shouting", capitals > small),
        Rule("duplicate_lines", 2 * m["n_dup_lines"] > line_count(t)),
        Rule("word_length", (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
        Rule("few_distinct_words", (m["n_words"] <= 200) & (10 * F.size(F.array_distinct(w)) < 3 * m["n_words"])),
    ]


def all_rules(t: Column, w: Column) -> list[Rule]:
    m = measures(t, w)
    return base_rules(m) + more_rules(m, t, w)


def rules_by_cost(
    docs: DataFrame, rules: Callable[[Column, Column], list[Rule]] = all_rules, sample_rows: int = SAMPLE_ROWS, text: str = "text"
) -> list[str]:
    """Names of ``rules`` by rejections per second, highest first, as measured on about ``sample_rows`` documents, each
    judged TIMES times by one job a rule.

    The order decides what is computed, never which rows are rejected. An empty table leaves the order as it is.
    """
    t, w = F.col("t"), F.col("w")
    total = docs.count()
    if not total:
        return [r.name for r in rules(t, w)]
    sample = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    sample = sample.sample(min(1.0, sample_rows / total), seed=7).repartition(1)
    sample = cut(sample.select("t", hashed_words(t).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(TIMES)))).drop("col"), "sample")

    def run(condition: Column) -> tuple[float, int]:
        began = time.monotonic()
        hits = sample.agg(F.count(F.when(condition, 1)).alias("n"), F.sum(F.length("t")), F.sum(F.size("w"))).first()
        return time.monotonic() - began, hits["n"]

    run(F.lit(False))  # the first job is slower than the others
    floor, scores = run(F.lit(False))[0], []
    for i, rule in enumerate(rules(t, w)):
        seconds, hits = run(rule.rejects)
        cost = max(seconds - floor, 1e-3)
        scores.append((-hits / cost, cost, i, rule.name))
    return [name for *_, name in sorted(scores)]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, null if none does; later rules aren't evaluated for it."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A row for each document: key, the base measures, base_failed, kept.

    Null texts count as empty and fail. Keys may be null or repeated; each row is judged by itself. Columns of docs
    other than these two aren't read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    order = rules_by_cost(docs, sample_rows=sample_rows, text="t")
    t, w = F.col("t"), F.col("w")
    found = measures(t, w)
    measured = docs.select("doc_id", "t", hashed_words(t).alias("w")).select(
        "doc_id", "t", "w", *[c.alias(n) for n, c in found.items()]
    )
    m = {n: F.col(n) for n in found}
    failed = F.lit(False)
    for rule in base_rules(m):
        failed = failed | rule.rejects
    rules = sorted(base_rules(m) + more_rules(m, t, w), key=lambda r: order.index(r.name))
    return measured.select(
        F.col("doc_id").alias(key), *found, failed.alias("base_failed"), cascade(rules).isNull().alias("kept")
    )


def keep_clean(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with docs' own columns; a rule is evaluated only where those before it in the
    order of rejections per cost have not rejected. Null texts count as empty and go; repeated rows fare alike; an empty
    table gives an empty one."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    column = f"c{names.index(text)}"
    order = rules_by_cost(plain, sample_rows=sample_rows, text=column)

    def clean(t: Column) -> Column:
        return let(
            hashed_words(t),
            lambda w: cascade(sorted(all_rules(t, w), key=lambda r: order.index(r.name))).isNull(),
        )

    # Text and words are bound inside the condition: a filter over a projection would compute them once for each use.
    kept = plain.where(let(F.coalesce(F.col(column).cast("string"), F.lit("")), clean))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdicts of documents, by :func:`assess`; nulls, ties and empty tables as there."""
    return assess(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT r, i, ws[i:i + 4] AS g FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
s AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT x) AS dups
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.dups, 0) AS BIGINT) AS n_dup_lines, coalesce(l.lines, 0) AS lines,
             CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN s USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR length(regexp_replace(t, '[A-Z]', '', 'g')) < length(regexp_replace(t, '[a-z]', '', 'g'))
            OR 2 * n_dup_lines > lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR (n_words <= 200 AND 10 * len(list_distinct(ws)) < 3 * n_words)) AS kept
FROM b
"""
