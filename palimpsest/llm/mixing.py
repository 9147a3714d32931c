"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, and seeded token-prefixes."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .quality import words_of

#: Share of each domain; a domain that isn't listed weighs 1. Languages and sources of a parent weigh alike unless listed.
DOMAINS = {"web": 3.0, "books": 1.0}
LANGUAGES = {"en": 4.0, "de": 1.0, "fr": 1.0, "es": 1.0}
#: Tokens wanted, as a share of all; how often a document may be seen at most.
SHARE, EPOCHS = 0.9, 2
SEED = 11
#: Leaves that the driver holds at most, at some 500 bytes each; more are an error, as no tree of sources should have them.
LEAVES = 2_000_000
#: Bytes of a table of leaves that every executor gets a copy of, and the salts by which documents meet a larger one.
SMALL, SALTS = 32 << 20, 64
#: Bits by which a leaf's seeded order is sliced at a time, and documents of a slice that are summed one by one.
BITS, FEW = 8, 4096


def domain_of(source: Column) -> Column:
    """Domains for the registered query and the pipeline, as the documents table names none: of the numbered sources every
    fourth is a book source, all others are web. Other tables bring a rule of their own."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when((number != "") & (F.substring(number, -2, 2).cast("int") % 4 == 3), F.lit("books")).otherwise(F.lit("web"))


@dataclass
class Node:
    """A node of the tree: its weight among its siblings, the tokens it can supply, its children, its budget."""

    weight: float
    capacity: float = 0.0
    children: dict | None = None
    budget: float = 0.0


def allocate(children: list[Node], budget: float) -> float:
    """Gives ``budget`` to siblings by weight. What a child can't supply goes to the siblings that can supply more, by
    weight, until all is given or all are full; returns what is left, which the parent's siblings then share."""
    wanting = [c for c in children if c.capacity > 0 and c.weight > 0]
    given = {id(c): 0.0 for c in children}
    left = budget
    while wanting and left > 1e-9 * max(budget, 1.0):
        total = sum(c.weight for c in wanting)
        full = [c for c in wanting if given[id(c)] + left * c.weight / total >= c.capacity]
        if not full:
            for c in wanting:
                given[id(c)] += left * c.weight / total
            left = 0.0
            break
        for c in full:
            left -= c.capacity - given[id(c)]
            given[id(c)] = c.capacity
        wanting = [c for c in wanting if c not in full]
        left = max(left, 0.0)
    for c in children:
        c.budget = given[id(c)]
        if c.children:
            allocate(list(c.children.values()), c.budget)
    return left


def budgets(leaves: list[tuple], total: float, weights: list[dict[str, float]], epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. ``leaves``: (path..., tokens), sorted; ``weights``: by name for each level, 1 if not listed.

    A node can supply ``epochs`` times its leaves' tokens. Budgets are rounded down, so they never exceed the total.
    """
    root = Node(1.0, children={})
    for *path, tokens in leaves:
        node = root
        node.capacity += epochs * tokens
        for level, name in enumerate(path):
            listed = weights[level] if level < len(weights) else {}
            node.children = node.children if node.children is not None else {}
            node = node.children.setdefault(name, Node(listed.get(name, 1.0)))
            node.capacity += epochs * tokens
    allocate([root], total)

    def walk(node: Node, path: tuple):
        if not node.children:
            yield path, int(node.budget + 1e-6)
        for name, child in (node.children or {}).items():
            yield from walk(child, (*path, name))

    return dict(walk(root, ())) if leaves else {}


class Leaves:
    """A row for each leaf, made on the driver, so that its size is known."""

    def __init__(self, spark: SparkSession, path: list[str], columns: dict[str, pa.DataType], rows: list[tuple]):
        types = [*[pa.string()] * len(path), *columns.values()]
        columns_of = zip(*rows, strict=True) if rows else [()] * len(types)
        arrays = [pa.array(c, t) for c, t in zip(columns_of, types, strict=True)]
        found = pa.Table.from_arrays(arrays, names=[*path, *columns])
        self.path, self.small = path, found.nbytes <= SMALL
        self.rows = spark.createDataFrame(found)

    def meet(self, docs: DataFrame, how: str = "inner") -> DataFrame:
        """``docs`` (with a column row) joined by leaf, without dealing documents by leaf: a small table goes to all
        executors; in a larger one each leaf stands once for each salt, and a leaf's documents are spread over the salts."""
        if self.small:
            return docs.join(F.broadcast(self.rows), self.path, how)
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = docs.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(SALTS)).cast("int"))
        return salted.join(self.rows.select("*", salts), [*self.path, "salt"], how).drop("salt")


def mix(
    docs: DataFrame,
    levels: list[Column],
    tokens: Column,
    share: float = SHARE,
    weights: list[dict[str, float]] | None = None,
    epochs: int = EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """``docs``' columns and ``epoch`` (from 0): the chosen documents, a row for each time that one is seen.

    ``share`` of all tokens is the budget of the tree of ``levels``. A leaf takes whole epochs of its documents while its
    budget covers them (a leaf without tokens takes one), and then the first documents of one more, in that epoch's seeded order, up to the document whose
    tokens would go over. Levels that are null form a branch of their own. Documents without tokens are in every epoch
    that their place is in. Null keys and repeated rows are ordered by the hash of the row and count each. An empty table
    gives an empty result.

    Leaves are summed in slices of the seeded order, then slices of the slice in which the budget ends, and only a slice
    of few documents is summed one by one; so no leaf, however large, is sorted in one task. The tree is held on the
    driver: more than LEAVES leaves are an error.
    """
    weights = weights if weights is not None else [DOMAINS, LANGUAGES]
    names = docs.columns
    path = [f"level{i}" for i in range(len(levels))]
    described = docs.select(
        *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)],
        *[F.coalesce(x.cast("string"), F.lit("")).alias(p) for p, x in zip(path, levels, strict=True)],
        F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"),
    )
    where = f"c{names.index(key)}"
    row = F.xxhash64(F.lit(seed), where, *[f"c{i}" for i in range(len(names))])
    described = described.withColumn("row", row)
    slim = cut(described.select(*path, "tokens", "row"), "mix-rows")
    # The leaves are the sources of the corpus, not its documents.
    found = slim.groupBy(*path).agg(F.sum("tokens").alias("tokens")).limit(LEAVES + 1).collect()
    if len(found) > LEAVES:
        raise ValueError(f"the tree has more than {LEAVES} leaves")
    leaves = sorted(tuple(r) for r in found)
    wanted = budgets(leaves, share * sum(r[-1] for r in leaves), weights, epochs)
    plan = {}
    for *leaf, tokens_in in leaves:
        budget = wanted[tuple(leaf)]
        whole = min(epochs, budget // tokens_in) if tokens_in else 1
        plan[tuple(leaf)] = (whole, budget - whole * tokens_in)
    spark = docs.sparkSession
    rank = F.xxhash64(F.lit(seed), F.col("whole"), F.col("row"))
    # The slice in which the budget ends, what is left for it and its documents, from the whole order to ever finer slices.
    ends = {leaf: (0, rest, FEW + 1) for leaf, (whole, rest) in plan.items() if whole < epochs and rest > 0}
    ended = {"whole": pa.int32(), "end": pa.int64(), "room": pa.int64()}
    for bits in range(BITS, 57, BITS):
        if max((n for _, _, n in ends.values()), default=0) <= FEW:
            bits -= BITS
            break
        open_leaves = Leaves(spark, path, ended, [(*leaf, plan[leaf][0], *at[:2]) for leaf, at in ends.items()])
        inside = open_leaves.meet(slim).withColumn("rank", rank)
        if bits > BITS:
            inside = inside.where(F.shiftrightunsigned("rank", 64 - bits + BITS) == F.col("end"))
        sums = inside.groupBy(*path, F.shiftrightunsigned("rank", 64 - bits).alias("slice"), "room").agg(
            F.sum("tokens").alias("sum"), F.count("*").alias("n")
        )
        # A leaf has 2**BITS slices at most.
        before = F.sum("sum").over(
            Window.partitionBy(*path).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        )
        found = (
            sums.withColumn("before", F.coalesce(before, F.lit(0)))
            .where((F.col("before") <= F.col("room")) & (F.col("before") + F.col("sum") > F.col("room")))
            .select(*path, F.col("slice").alias("end"), (F.col("room") - F.col("before")).alias("room"), "n")
            .collect()
        )
        ends = {tuple(r)[: len(path)]: (r["end"], r["room"], r["n"]) for r in found}
    open_leaves = Leaves(spark, path, ended, [(*leaf, plan[leaf][0], *at[:2]) for leaf, at in ends.items()])
    inside = open_leaves.meet(slim).withColumn("rank", rank).where(F.shiftrightunsigned("rank", 64 - bits) == F.col("end"))
    within = F.sum("tokens").over(Window.partitionBy(*path).orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    stop = inside.withColumn("upto", within).where(F.col("upto") > F.col("room")).groupBy(*path)
    stop = {tuple(r)[:-1]: r["stop"] for r in stop.agg(F.min("rank").alias("stop")).collect()}
    decided = {"whole": pa.int32(), "rest": pa.int64(), "stop": pa.int64()}
    # Ranks are compared as unsigned numbers, as slices are.
    chosen = Leaves(spark, path, decided, [(*leaf, *plan[leaf], stop.get(leaf)) for leaf in plan]).meet(described)
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    partial = (F.col("whole") < epochs) & (F.col("rest") > 0) & (
        F.col("stop").isNull() | (unsigned("rank") < unsigned("stop"))
    )
    times = F.col("whole") + F.coalesce(partial, F.lit(False)).cast("int")
    chosen = chosen.withColumn("rank", rank).withColumn("times", times).where("times > 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return chosen.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "epoch")


def word_count(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text.cast("string"), F.lit(""))))


def mix_documents(docs: DataFrame, domain: Column | None = None, **options) -> DataFrame:
    """:func:`mix` for tables like documents: by domains, if there is a column for them, languages and sources; words are
    the tokens."""
    levels, weights = [F.col("lang"), F.col("source")], [LANGUAGES]
    if domain is not None:
        levels, weights = [domain, *levels], [DOMAINS, *weights]
    return mix(docs, levels, word_count(F.col("text")), **{"weights": weights, **options})


def op9_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, epoch, lang, source, n_chars) of the documents that :func:`mix_documents` chooses; nulls, ties and empty
    tables as there."""
    chosen = mix_documents(table(spark, sf_dir, "documents"), domain_of(F.col("source")))
    return chosen.select("doc_id", "epoch", "lang", "source", "n_chars")
