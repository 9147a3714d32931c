"""Personal data by bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .lines import constant_array
from .quality import let

KINDS = ("email", "ip", "card", "phone")

#: Base patterns, written so that no text makes them slow: runs are taken whole, and a search starts where a run starts
#: or the last match ended. A card pattern asks for 16 digits at once; a run with fewer holds no match that passes.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose shapes of each kind, which only a trusted context makes a find: spelled-out or undotted mail addresses, IPv6
#: addresses, shorter or misread card numbers, and numbers without a country code.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+(-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
#: Cheap conditions without which a text has no match.
GUARD = {
    "email": lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"[0-9][\x20).-]{0,2}[0-9][\x20).-]{0,2}[0-9]"),
}
SPAN = "array<struct<kind:int,start:int,stop:int,body:string>>"

#: A cue's token ends at white space and after each of these, in a context and in the corpus alike; so 'tel:' of
#: 'tel:555-0199' is a token in both.
ENDS = r"""!"#$&'()*,/:;<=>?\[\\\]^`{|}~"""
TOKEN = rf"([^\x20\x09-\x0D{ENDS}]*[{ENDS}]|[^\x20\x09-\x0D{ENDS}]+)"
#: Rounds of scoring at least; distinct instances that a pattern needs; score that makes a pattern trusted.
ROUNDS, SUPPORT, TRUST = 3, 5, 0.6
#: Cells of the map of cues that keeps words out of the count; fixed, whatever the corpus.
CUES = 1 << 16


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: gaps and matches alternate, their lengths add up."""
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda gap, body: F.struct(F.length(gap).alias("gap"), body.alias("body")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        stop = at + F.coalesce(F.length(x["body"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), stop.alias("stop"), x["body"].alias("body"))
        return F.struct(
            stop.alias("at"), F.when(x["body"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out")
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn test."""
    wide = F.lpad(digits, 20, "0")

    def value(i: Column) -> Column:
        v = F.substring(wide, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(body, r"\."), lambda p: part(p) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda s: passes(kind, s["body"])


def of_kind(kind: int):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind and start."""
    none = F.array().cast(SPAN)
    found = []
    for i, kind in enumerate(KINDS):
        guard = F.contains(text, F.lit("+")) if kind == "phone" else GUARD[kind](text)
        found.append(F.when(guard, F.filter(matches(text, BASE[kind], i), passing(kind))).otherwise(none))
    return F.concat(*found)


def loose_spans(text: Column, base: Column) -> Column:
    """Loose matches that overlap no base span."""
    none = F.array().cast(SPAN)
    found = [
        F.when(GUARD[kind](text), matches(text, LOOSE[kind], i)).otherwise(none) for i, kind in enumerate(KINDS)
    ]
    return F.filter(
        F.concat(*found),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def with_context(text: Column, spans: Column) -> Column:
    """Adds to each span its lexical patterns: the word before it, and the two words before it, in lower case."""

    def context(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - 80, F.lit(0)) + 1, F.least(s["start"], F.lit(80)))
        cues = let(
            tokens_of(F.lower(before)),
            lambda w: F.filter(
                F.array(F.try_element_at(w, F.lit(-1)), F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), F.try_element_at(w, F.lit(-1)))),
                lambda c: F.length(c).between(1, 40),
            ),
        )
        return F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.lower(s["body"]).alias("body"),
            F.array_distinct(cues).alias("cues"),
        )

    return F.transform(spans, context)


def corpus_cues(texts: DataFrame, cues: DataFrame) -> DataFrame:
    """(cue, total): how often each of ``cues`` (distinct) occurs in all texts (column ``t``), whatever follows."""
    cells = [r[0] for r in cues.select(F.pmod(F.xxhash64("cue"), F.lit(CUES)).cast("int").alias("c")).distinct().collect()]
    marked = [0] * CUES
    for c in cells:
        marked[c] = 1
    # A fixed map of CUES cells drops most words before they are counted; the join is exact.
    bits = constant_array(marked)
    asked = lambda c: F.get(bits, F.pmod(F.xxhash64(c), F.lit(CUES)).cast("int")) == 1
    lowered = texts.select(tokens_of(F.lower(F.col("t"))).alias("w"))
    one = F.filter("w", asked)
    two = F.filter(
        F.transform("w", lambda c, i: F.when(i > 0, F.concat_ws(" ", F.get("w", i - 1), c))),
        lambda c: c.isNotNull() & asked(c),
    )
    said = lowered.select(F.explode(F.concat(one, two)).alias("cue")).groupBy("cue").agg(F.count("*").alias("total"))
    # A span may start inside a token (after a letter or a dash); its cue is then known by the graph alone.
    return cues.join(said, "cue", "left").select("cue", F.coalesce("total", F.lit(0)).alias("total"))


def trusted_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, cue) of the trusted patterns. ``edges``: (kind, cue, body, seed, times), the graph of patterns and instances
    with the number of times each pattern precedes each instance.

    An instance's confidence is 1 for seeds, else that no pattern of its own is right to doubt: one minus the product of
    one minus their scores. A pattern's score is its occurrences weighted by the confidence of what follows, over all
    its occurrences in the corpus, which are at least those in the graph; it counts once SUPPORT distinct instances of confidence 1/2 or more support it. Scores never fall, so rounds end once no pattern is newly scored or trusted.
    """
    seen = edges.groupBy("cue").agg(F.sum("times").alias("seen"))
    totals = cut(totals.join(seen, "cue").select("cue", F.greatest("total", "seen").alias("total")), "totals")
    scores, known, rounds = None, None, 0
    while True:
        if scores is None:
            rated = edges.withColumn("sure", F.col("seed").cast("double"))
        else:
            doubt = (
                edges.join(scores, ["kind", "cue"])
                .groupBy("kind", "body")
                .agg(F.product(1 - F.col("score")).alias("doubt"))
            )
            rated = edges.join(doubt, ["kind", "body"], "left").withColumn(
                "sure", F.when(F.col("seed"), 1.0).otherwise(1 - F.coalesce("doubt", F.lit(1.0)))
            )
        scores = cut(
            rated.groupBy("kind", "cue")
            .agg(F.sum(F.col("sure") * F.col("times")).alias("hits"), F.sum((F.col("sure") >= 0.5).cast("int")).alias("support"))
            .join(totals, "cue")
            .where(F.col("support") >= SUPPORT)
            .select("kind", "cue", F.least(F.col("hits") / F.col("total"), F.lit(1.0)).alias("score")),
            "scores",
        )
        now = tuple(scores.agg(F.count("*"), F.count(F.when(F.col("score") >= TRUST, 1))).first())
        rounds += 1
        if rounds >= ROUNDS and now == known:
            break
        known = now
    return scores.where(F.col("score") >= TRUST).select("kind", "cue")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, base and more (arrays of kind, start, stop, body, cues): base spans, and the spans that
    trusted contexts add.

    Base matches are seeds. The words before them are patterns; loose matches and patterns form a graph that is scored in
    rounds until nothing new is trusted; a loose match after a trusted pattern of its kind is added where it overlaps no base span.
    Null texts count as empty. Rows with null or repeated keys are separate documents. Other columns are ignored; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = texts.withColumn("base", base_spans(F.col("t"))).withColumn("loose", loose_spans(F.col("t"), F.col("base")))
    found = cut(
        found.select(
            "key",
            with_context(F.col("t"), F.col("base")).alias("base"),
            with_context(F.col("t"), F.col("loose")).alias("loose"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "personal",
    )

    def edges_of(column: str, seed: bool) -> DataFrame:
        spans = found.select(F.explode(column).alias("s"))
        return (
            spans.select("s.kind", "s.body", F.explode("s.cues").alias("cue"))
            .groupBy("kind", "cue", "body")
            .agg(F.count("*").alias("times"))
            .withColumn("seed", F.lit(seed))
        )

    edges = cut(edges_of("base", True).unionByName(edges_of("loose", False)), "pattern-graph")
    # Only patterns that seeds or, later, finds can support are counted: those before SUPPORT distinct instances.
    support = edges.groupBy("kind", "cue").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    cues = cut(support.select("cue").distinct(), "cues")
    if cues.isEmpty():
        return found.select(F.col("key").alias(key), "base", F.filter("loose", lambda s: F.lit(False)).alias("more"))
    totals = cut(corpus_cues(texts, cues), "cue-totals")
    trusted = trusted_patterns(edges, totals)
    loose = found.select("uid", F.explode("loose").alias("s")).select("uid", "s", F.explode("s.cues").alias("cue"))
    more = (
        loose.withColumn("kind", F.col("s.kind"))
        .join(trusted, ["kind", "cue"], "left_semi")
        .groupBy("uid")
        .agg(F.array_sort(F.collect_set("s")).alias("more"))
    )
    none = F.filter("loose", lambda s: F.lit(False))
    return found.join(more, "uid", "left").select(F.col("key").alias(key), "base", F.coalesce("more", none).alias("more"))


def digest(spans: Column) -> Column:
    """kind:start:stop of spans, by kind as listed and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of every document; nulls, ties and empty tables as
    :func:`find_personal_data` says."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}")
        for i, k in enumerate(KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.concat("base", "more")).alias("spans"),
    )


