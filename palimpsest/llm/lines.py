"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, plain_spaces, split_words, table

#: Cells that words are counted in; a word's rarity is its cell's count.
CELLS = 1 << 18
#: Least Jaccard similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Two hashes of a set of words, of 64 bits each; lines of equal sets are one class. They are made of two hashes of each word
#: that don't depend on each other, 119 bits together.
IDS = ["k1", "k2"]
#: Classes with a word beyond which it is settled in rounds, and those rounds; they shape the work, never the result.
HOT, ROUNDS = 512, 2


def constant_array(values: list[int]) -> Column:
    """A constant array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def rarities(texts: DataFrame) -> list[int]:
    """For each of CELLS cells of words, the count of all words of column ``t`` that fall in it, in eighths of a power of
    two. A fixed number of small integers, whatever the corpus."""
    # Rows for lines and then for words: so the hash is generated code.
    lines = texts.select(F.explode(F.split("t", "\n", -1)).alias("line"))
    words = lines.select(F.explode(F.split(plain_spaces(F.col("line")), " ")).alias("word")).where("word != ''")
    cell = F.xxhash64("word").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell")
    found = [0] * CELLS
    for r in words.groupBy(cell).agg(F.count("*").alias("n")).collect():
        found[r["cell"]] = min(255, int(8 * math.log2(r["n"] + 1)))
    return found


def word_keys(words: Column, rarity: list[int]) -> Column:
    """Distinct words as 63-bit keys in ascending order, rarest first: the rarity of the word's cell, then 55 bits of its
    hash. The order is one for all lines. Words of equal keys add candidates; they are never taken for each other."""
    cells = constant_array(rarity)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # Never null, so that the keys are sorted as primitive numbers.
    rare = lambda h: F.coalesce(F.get(cells, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")), F.lit(0))
    return F.sort_array(
        F.transform(hashes, lambda h: F.shiftleft(rare(h).cast("long"), 55).bitwiseOR(h.bitwiseAND(F.lit((1 << 55) - 1))))
    )


def other_hashes(words: Column) -> Column:
    """A second hash of each word, in ascending order."""
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(F.lit(1), w)))


def parity(keys: Column, lane: int) -> Column:
    """64 bits, each flipped by the words that hash to it: sets that differ in d words differ in d bits at most. Lane 1 takes
    the words with one bit of their hash, lane 0 all words; the exclusive or of both is the parity of the others."""

    def flip(k: Column) -> Column:
        mine = F.shiftright(k, 6).bitwiseAND(F.lit(1)) if lane else F.lit(1).cast("long")
        return F.call_function("shiftleft", mine, k.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(flip(k)))


def least_overlap(n: Column, m: Column) -> Column:
    """Words that sets of n and m words must share to reach the similarity."""
    total = NUMERATOR + DENOMINATOR
    return F.floor((NUMERATOR * (n + m) + total - 1) / total)


def prefix_length(n: Column) -> Column:
    """Rarest words of which similar sets share one at least: n - ceil(n * similarity) + 1."""
    return (n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1).cast("int")


def short_prefix(n: Column) -> Column:
    """The same for the smaller set of a pair: it shares ceil(2 n * similarity / (1 + similarity)) words at least."""
    return n - least_overlap(n, n) + 1


def bits_apart(a: str, b: str) -> Column:
    return sum(F.bit_count(F.col(f"{lane}{a}").bitwiseXOR(F.col(f"{lane}{b}"))) for lane in ("bits", "more"))


def may_match(a: str, b: str) -> Column:
    """Length, positional and parity filters on columns n, i, bits and more with these endings, at a common word."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (
        (DENOMINATOR * n >= NUMERATOR * m)
        & (DENOMINATOR * m >= NUMERATOR * n)
        & (bits_apart(a, b) <= n + m - 2 * least_overlap(n, m))
        # The smaller set has the word in its shorter prefix.
        & (F.when(n < m, F.col(f"i{a}") < short_prefix(n)).when(m < n, F.col(f"i{b}") < short_prefix(m)).otherwise(F.greatest(f"i{a}", f"i{b}") < short_prefix(n)))
        # At their first common word the words from there on must suffice.
        & (F.least(n - F.col(f"i{a}"), m - F.col(f"i{b}")) >= least_overlap(n, m))
    )


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, line_no, k1, k2, n, bits, more, p) of the lines with a word: the hash of the text's body, two hashes of the
    set of words, its size and parity, and the rarest words of it that the filter needs."""
    texts = whole_texts(docs, key, text)
    rarity = rarities(texts)
    lines = texts.select(
        "doc_id", F.xxhash64("t").alias("body"), F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line")
    )
    lines = lines.where(F.btrim("line", F.lit(SPACE_CHARS)) != "").select(
        "doc_id", "body", "line_no", F.array_distinct(split_words(F.col("line"))).alias("words")
    )
    lines = lines.select(
        "doc_id", "body", "line_no", word_keys(F.col("words"), rarity).alias("keys"), F.xxhash64(other_hashes(F.col("words"))).alias("k2")
    )
    n = F.size("keys")
    low = F.transform(
        F.slice("keys", F.lit(1), prefix_length(n)), lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)
    )
    return cut(
        lines.select(
            "doc_id",
            "body",
            "line_no",
            F.xxhash64("keys").alias("k1"),
            "k2",
            n.alias("n"),
            parity(F.col("keys"), 0).alias("every"),
            parity(F.col("keys"), 1).alias("more"),
            low.cast("array<int>").alias("p"),
        ).select(
            "doc_id", "body", "line_no", "k1", "k2", "n", F.col("every").bitwiseXOR(F.col("more")).alias("bits"), "more", "p"
        ),
        "lines",
    )


def whole_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def sets_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(c, words) of the classes in ``wanted`` (c): their words, read again from the texts of their first lines."""
    places = classes.join(wanted, "c", "left_semi").select("c", "first.*")
    asked = places.groupBy("doc_id", "body").agg(F.collect_list(F.struct("c", "line_no")).alias("asked"))
    # Written first: where few are asked for, the texts aren't shuffled.
    asked = cut(asked.withColumnRenamed("doc_id", "d").withColumnRenamed("body", "b"), "asked-lines")
    # Of a text that many documents have only that of the first line's document is met.
    lines = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("t") == F.col("b")))
    lines = lines.select(F.split("t", "\n", -1).alias("lines"), "asked")
    found = F.transform(
        "asked", lambda a: F.struct(a["c"].alias("c"), F.array_distinct(split_words(F.get("lines", a["line_no"]))).alias("words"))
    )
    # Repeated rows give a set again.
    return cut(lines.select(F.explode(found).alias("s")).select("s.*").dropDuplicates(["c"]), "line-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c) of the late classes of the pairs (c, e) whose words reach the similarity."""
    early = sets.select(F.col("c").alias("e"), F.col("words").alias("early"))
    enough = F.size(F.array_intersect("words", "early")) >= least_overlap(F.size("words"), F.size("early"))
    return cut(pairs.join(sets, "c").join(early, "e").where(enough).select("c").distinct(), "late-lines")


def late_classes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(c) of the classes that have a similar class before them.

    Words with more than HOT classes are looked at first: in rounds, each class is compared with the first class of each
    such word, and leaves when the pair passes the filters. Classes that have left aren't compared with each other; all other
    pairs are, so a large group of copies costs rows in proportion to its size. Then the words decide: first those of the
    pair by which a class has left, or of its closest pair, and where they fail those of all other candidates; a class that
    has left and fails meets every class. So no link is lost.
    """
    order = F.struct("first.doc_id", "first.line_no", *IDS).alias("order")
    filters = ["n", "bits", "more"]
    hot = classes.select(F.explode("p").alias("word")).groupBy("word").agg(F.count("*").alias("rows"))
    hot = cut(hot.where(F.col("rows") > HOT).select("word"), "hot-words")
    guessed = classes.select("c", F.col("c").alias("e")).limit(0)
    if not hot.isEmpty():
        for _ in range(ROUNDS):
            # Hot words first, so that no other row is looked up among those that have left.
            still = classes.select("c", *filters, order, F.posexplode("p").alias("i", "word")).join(hot, "word", "left_semi")
            still = still.join(guessed.select("c"), "c", "left_anti")
            lead = F.min(F.struct("order", *[F.col(x).alias(f"{x}y") for x in ("c", *filters, "i")]))
            leads = cut(still.groupBy("word").agg(lead.alias("lead")).select("word", "lead.*").drop("order"), "leads")
            near = still.drop("order").join(leads, "word").where((F.col("c") != F.col("cy")) & may_match("", "y"))
            found = cut(near.groupBy("c").agg(F.min_by("cy", F.struct(bits_apart("", "y"), "cy")).alias("e")), "guessed")
            if found.isEmpty():
                break
            guessed = cut(guessed.unionByName(found), "guessed")

    def ends(some: DataFrame) -> DataFrame:
        return some.select(F.explode(F.array("c", "e")).alias("c")).distinct()

    # The sign of n tells those that have left.
    marked = classes.join(guessed.select("c", F.lit(True).alias("done")), "c", "left")
    signed = F.when(F.col("done"), -F.col("n")).otherwise(F.col("n")).alias("n")
    rows = marked.select("c", signed, "bits", "more", F.posexplode("p").alias("i", "word"))
    a, b = (rows.toDF(f"c{e}", f"s{e}", f"bits{e}", f"more{e}", f"i{e}", "word").withColumn(f"n{e}", F.abs(f"s{e}")) for e in "xy")
    near = (a["cx"] < b["cy"]) & ((a["sx"] > 0) | (b["sy"] > 0)) & may_match("x", "y")
    pairs = a.join(b, (a["word"] == b["word"]) & near).select("cx", "cy", bits_apart("x", "y").alias("apart")).distinct()
    places = classes.select("c", order)
    one, two = places.toDF("cx", "ox"), places.toDF("cy", "oy")
    pairs = cut(pairs, "line-pairs").join(one, "cx").join(two, "cy")
    first = F.col("ox") < F.col("oy")
    pairs = pairs.select(
        F.when(first, F.col("cy")).otherwise(F.col("cx")).alias("c"), F.when(first, F.col("cx")).otherwise(F.col("cy")).alias("e"), "apart"
    )
    pairs = cut(pairs.join(guessed.select("c"), "c", "left_anti"), "line-pairs")
    best = pairs.groupBy("c").agg(F.min_by("e", F.struct("apart", "e")).alias("e"))
    best = cut(best.unionByName(guessed), "best-pairs")
    if best.isEmpty():
        return classes.select("c").limit(0)
    # The texts are read once for all candidates.
    sets = sets_of(ends(best.unionByName(pairs.select("c", "e"))), classes, texts)
    sure = verified(best, sets)
    rest = pairs.select("c", "e").join(sure, "c", "left_anti")
    failed = cut(guessed.join(sure, "c", "left_anti").select("c"), "failed")
    if not failed.isEmpty():
        wide = classes.select("c", *filters, order, F.posexplode("p").alias("i", "word"))
        before = wide.select("word", *[F.col(x).alias(f"{x}y") for x in ("c", *filters, "i", "order")])
        # Written first: where these are few, the other side isn't shuffled.
        again = cut(wide.join(failed, "c", "left_semi"), "failed-rows").join(before, "word").where((F.col("ordery") < F.col("order")) & may_match("", "y"))
        rest = cut(rest.unionByName(again.select("c", F.col("cy").alias("e")).distinct()), "line-pairs")
        sets = sets.unionByName(sets_of(ends(rest).join(sets, "c", "left_anti"), classes, texts))
    return sure.unionByName(verified(rest, sets))


def line_verdicts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, body, line_no, n_words, kept) for each line with a word."""
    lines = line_table(docs, key, text)
    place = F.struct("doc_id", "line_no", "body")
    classes = lines.groupBy(*IDS).agg(
        F.min(place).alias("first"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("more").alias("more"), F.any_value("p").alias("p")
    )
    # One number names a class wherever classes meet; written, so that it stays.
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()), "line-classes")
    late = late_classes(classes, whole_texts(docs, key, text)).withColumn("late", F.lit(True))
    fates = cut(classes.join(late, "c", "left").select(*IDS, "first", F.col("late").isNotNull().alias("late")), "line-fates")
    found = lines.select(*IDS, "doc_id", "body", "line_no", "n").join(fates, IDS)
    return found.select(
        "doc_id", "body", "line_no", F.col("n").alias("n_words"), ((place == F.col("first")) & ~F.col("late")).alias("kept")
    )


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line with a word: key, line_no (from 0), n_words (distinct), kept.

    Lines are sets of their words ``[^\\x20\\x09-\\x0D]+``. A line goes if an earlier line, of any document, has a Jaccard
    similarity of 4/5 or more with it, whether that one stays or not; earlier is by key (nulls first), line_no, and then a
    hash. Words themselves decide; equal sets of words are told by 128 bits. Lines without a word are never compared and
    stay, so null and empty texts give no rows. Rows with equal key and text are one document: they get the same verdicts.
    Other columns are ignored; an empty table gives an empty result.
    """
    return line_verdicts(docs, key, text).select(
        F.col("doc_id").alias(key), F.col("line_no").cast("long").alias("line_no"), F.col("n_words").cast("long").alias("n_words"), "kept"
    ).distinct()


def drop_later_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` without the lines that :func:`judge_lines` drops; documents stay, with an empty text if no line is left.

    Column ``length``, if given, gets the code points of the new text.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    gone = (
        line_verdicts(plain, k, t)
        .where("not kept")
        .groupBy("doc_id", "body")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    gone = cut(gone, "gone-lines").withColumnRenamed("doc_id", "d").withColumnRenamed("body", "b")
    body = F.xxhash64(F.coalesce(F.col(t).cast("string"), F.lit("")))
    joined = plain.join(gone, F.col(k).eqNullSafe(F.col("d")) & (body == F.col("b")), "left")
    left = F.array_join(
        F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"
    )
    joined = joined.withColumn(t, F.when(F.col("gone").isNull(), F.col(t)).otherwise(left))
    if length:
        column = f"c{names.index(length)}"
        joined = joined.withColumn(column, F.when(F.col("gone").isNull(), F.col(column)).otherwise(F.length(t)).cast(docs.schema[length].dataType))
    return joined.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op7_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, n_words, kept) of the lines of documents, by :func:`judge_lines`; nulls, ties and empty tables as
    there."""
    return judge_lines(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM s),
t AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT doc_id, line_no, w, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY df, w) AS i,
             count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM t JOIN f USING (w)),
k AS (SELECT doc_id, line_no, n, string_agg(w, ' ' ORDER BY w) AS ws FROM r GROUP BY ALL),
c AS (SELECT ws, any_value(n) AS n, min(struct_pack(d := doc_id, l := line_no)) AS fst FROM k GROUP BY ws),
p AS (SELECT c.ws, c.n, c.fst, r.w FROM c JOIN r ON r.doc_id = c.fst.d AND r.line_no = c.fst.l
      WHERE r.i <= r.n - CAST(ceil(r.n * 4 / 5.0) AS BIGINT) + 1),
q AS (SELECT DISTINCT a.fst AS late, b.fst AS early, a.n AS n, b.n AS m FROM p a JOIN p b ON a.w = b.w
      WHERE b.fst < a.fst AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT late, early, n, m FROM q JOIN t x ON x.doc_id = late.d AND x.line_no = late.l
      JOIN t y ON y.doc_id = early.d AND y.line_no = early.l AND y.w = x.w
      GROUP BY late, early, n, m HAVING 9 * count(*) >= 4 * (n + m)),
g AS (SELECT DISTINCT late FROM v)
SELECT k.doc_id, CAST(k.line_no AS BIGINT) AS line_no, CAST(k.n AS BIGINT) AS n_words,
       c.fst.d = k.doc_id AND c.fst.l = k.line_no AND g.late IS NULL AS kept
FROM k JOIN c USING (ws) LEFT JOIN g ON g.late = c.fst
"""
