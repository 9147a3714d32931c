import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from palimpsest.llm.mixing import Node, allocate, budgets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens int"


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [("a", "x", 100), ("a", "y", 1000), ("b", "z", 1000)]
    got = budgets(leaves, 800, [{"a": 1, "b": 1}], 1)
    assert got == {("a", "x"): 100, ("a", "y"): 300, ("b", "z"): 400}
    # Only what a's children can't supply goes to b.
    got = budgets([("a", "x", 100), ("a", "y", 50), ("b", "z", 1000)], 800, [], 1)
    assert got == {("a", "x"): 100, ("a", "y"): 50, ("b", "z"): 650}
    assert budgets([("a", 10)], 800, [], 2) == {("a",): 20}
    assert budgets([], 800, [], 2) == {}


def test_allocate_leaves_what_nobody_can_take():
    a, b = Node(1, 10), Node(3, 20)
    assert allocate([a, b], 100) == 70 and (a.budget, b.budget) == (10, 20)


@pytest.mark.parametrize("few,share,small", [(4096, 0.5, 1 << 20), (3, 0.5, 1 << 20), (3, 1.7, 0)])
def test_prefixes_match_brute_force(spark, monkeypatch, few, share, small):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "SMALL", small)  # bytes of a table of leaves that is broadcast
    rows = [(i, "w " * (i % 37), "en" if i % 3 else "de", f"src{i * i % 7}", i, i) for i in range(900)]
    rows += [(None, "a b", None, None, None, None), (None, "a b", None, None, None, None), (5, None, "en", "src1", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_documents(docs, mixing.domain_of(F.col("source")), share=share)
    assert got.columns == [*docs.columns, "epoch"]
    seen = sorted((str(r[:-1]), r.epoch) for r in map(tuple_row, got.collect()))

    cols = [F.col(c) for c in docs.columns]
    ranked = docs.select(
        *cols,
        F.xxhash64(F.lit(mixing.SEED), "doc_id", *cols).alias("row"),
    )
    ranked = ranked.select(
        *cols,
        *[F.xxhash64(F.lit(mixing.SEED), F.lit(e), "row").alias(f"r{e}") for e in range(mixing.EPOCHS)],
        F.coalesce(mixing.domain_of(F.col("source")), F.lit("")).alias("d"),
    ).collect()
    leaves = {}
    for r in ranked:
        leaves.setdefault((r.d, r.lang or "", r.source or ""), []).append(r)
    sizes = {k: sum(len((r.text or "").split()) for r in v) for k, v in leaves.items()}
    wanted = budgets(
        [(*k, n) for k, n in sorted(sizes.items())],
        share * sum(sizes.values()),
        [mixing.DOMAINS, mixing.LANGUAGES],
        mixing.EPOCHS,
    )
    want = []
    for leaf, own in leaves.items():
        left = wanted[leaf]
        for epoch in range(mixing.EPOCHS):
            if left >= sizes[leaf]:
                want += [(str(tuple(r)[:6]), epoch) for r in own]
                left -= sizes[leaf]
                continue
            total = 0
            ranks = sorted({r[f"r{epoch}"] % 2**64 for r in own})
            for rank in ranks:
                tied = [r for r in own if r[f"r{epoch}"] % 2**64 == rank]
                total += sum(len((r.text or "").split()) for r in tied)
                if total > left or left <= 0:
                    break
                want += [(str(tuple(r)[:6]), epoch) for r in tied]
            break
    assert seen == sorted(want)


class tuple_row(tuple):
    def __new__(cls, row):
        self = super().__new__(cls, tuple(row))
        self.epoch = row.epoch
        return self


def test_documents_are_not_dealt_by_leaf(spark):
    rows = [(i, "w " * (i % 9), "en", "hot" if i % 3 else f"s{i % 5}", i, i) for i in range(300)]
    plan = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(level" not in plan


def test_more_leaves_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAVES", 3)
    rows = [(i, "a", "en", f"s{i}", 1, 1) for i in range(4)]
    with pytest.raises(ValueError):
        mixing.mix_documents(spark.createDataFrame(rows, SCHEMA))
    assert mixing.mix_documents(spark.createDataFrame(rows[:3], SCHEMA), share=5.0).count() == 6


def test_a_very_long_text(spark):
    rows = [(1, "w " * 300_000, "en", "a", 1, 1), (2, "w", "en", "a", 1, 1), (3, None, "en", "a", 1, 1)]
    got = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA), share=0.00001).collect()
    assert {r.doc_id for r in got} <= {2, 3}


def test_empty(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
