import random
import zlib

import duckdb
import pandas as pd
import pytest

from palimpsest.llm import chat, quality, toxicity

DOCS = "doc_id long, text string, t string, w long"
TURNS = "conv_id long, turn long, role string, text string, n long"


def tables(**frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con


def texts():
    rng = random.Random(8)
    words = ["the", "of", "a", "ABC", "word", "###", "é|", "x", "!!", "stone", "river"]
    out = [None, "", " ", "one", "\n\n", "a b c d e f g h i j", "a b c d e " * 9, "x " * 40, "é" * 500, ("k%d " * 6000) % tuple(range(6000))]
    for _ in range(300):
        n = rng.choice([3, 9, 12, 40, 150, 400])
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n)))
    return out


def test_quality_matches_sql(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a b c d e f g h i j k", "", 0)]
    got = quality.assess(spark.createDataFrame(rows, DOCS)).toPandas()
    want = tables(documents=pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})).execute(quality.OP10_SQL).df()
    show = lambda f: sorted(str([None if pd.isna(v) else int(v) for v in r]) for r in f[sorted(want.columns)].itertuples(index=False))
    assert show(got) == show(want)
    kept = quality.keep_clean(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "t", "w"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(None if pd.isna(r.doc_id) else int(r.doc_id)) for r in want.itertuples() if r.kept)
    empty = spark.createDataFrame([], DOCS)
    assert quality.assess(empty).count() == 0 and quality.keep_clean(empty).count() == 0


def test_rules_by_cost_keep_all_rules(spark):
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts())], DOCS)
    from pyspark.sql import functions as F

    names = [r.name for r in quality.all_rules(F.col("t"), F.col("w"))]
    assert sorted(quality.rules_by_cost(docs)) == sorted(names)


def conversations():
    rng = random.Random(6)
    turns, rows = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", ""), ("system", "be")], []
    for conv in range(120):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, turn * 2, *rng.choice(turns[:3]), 0))
    return rows


def test_chat_matches_sql(spark):
    rows = conversations()
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.maximal_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    con = tables(conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "n"]))
    assert got == {r[0]: r[1:] for r in con.execute(chat.OP2_SQL).fetchall()}


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", "a", 0),
        (1, 1, None, None, 0),
        (2, None, "user", "a", 0),
        (3, 0, "user", "a", 0),
        (3, 1, "", "", 0),
        (4, 5, "user", "a", 0),
        (4, 6, None, None, 0),
        (5, 0, "user", "b", 0),
        (5, 0, "user", "b", 0),
        (None, 0, "user", "zzz", 0),
    ]
    got = {r.conv_id: r.n_turns for r in chat.maximal_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: 2, 3: 2, 5: 2}
    assert chat.maximal_conversations(spark.createDataFrame([], TURNS)).count() == 0


def labelled_documents():
    rng = random.Random(9)
    calm, rude = ["stone", "river", "cloud", "tree", "lamp", "paper"], ["idiotisch", "moron", "scumbag"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(calm) for _ in range(rng.randint(1, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(rude)
        docs.append((i, " ".join(words), "score", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_documents()
    # Labels of held-out rows are wrong on purpose: they must never be learned from.
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    given = [(i, q, 1 - t if held[i] else t) for i, q, t in labels]
    odd = [(None, "moron", "", 0), (5, docs[5][1], "", 0), (1000, None, "", 0), (1001, "", "", 0), (1002, "x " * 200000, "", 0)]
    frame = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame(given + [(None, 1, 1), (1000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(frame, toxicity.fit(toxicity.labelled(frame, marks))).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert all(r.held_out == held[r.doc_id] for r in got if r.doc_id in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(i, 1, 0) for i in range(9)], None)])
def test_toxicity_without_labels(spark, labels, score):
    docs = spark.createDataFrame([(i, "stone", "", 0) for i in range(9)], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, toxicity.fit(toxicity.labelled(docs, marks))).collect()
    assert len({r.score for r in got}) == 1 and got[0].score < 0.5 and (score is None or got[0].score == score)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score_documents(empty, toxicity.fit(toxicity.labelled(empty, marks))).count() == 0
