import random
import re

import pytest

from palimpsest.llm.audit import FILTERS, ORDERS, audit_filters, first_failures, own_failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def model(docs, labels):
    firsts = {}
    for d, text, *_ in docs:
        if d is not None:
            firsts[text or ""] = min(d, firsts.get(text or "", d))
    rows = []
    for d, text, lang, *_ in docs:
        text = text or ""
        f = [*fails(text), d is not None and firsts[text] < d]
        said = [(q, t) for i, q, t in labels if i is not None and i == d]
        rows.append((lang or "", f, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in ORDERS:
            left = own
            for step, f in enumerate(order):
                k = FILTERS.index(f)
                gone = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                failing = sum(r[1][k] for r in own)
                alone = sum(r[1][k] and sum(r[1]) == 1 for r in own)
                out[part, order, step + 1] = [
                    len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
    for (part, order, step), v in out.items():
        f = order[step - 1]
        v.append(sum(out[part, o, o.index(f) + 1][1] for o in ORDERS))
    return out


def text_of(rng):
    if rng.random() < 0.1:
        return rng.choice([None, "", " \t\n", "é" * 50, "ABC", "a|b"])
    pool = [f"w{i}" for i in range(rng.choice([20, 400]))]
    words = [rng.choice(pool) for _ in range(rng.choice([5, 99, 100, 101, 300]))]
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    return rng.choice([" ", "\n", " "]).join(words) + rng.choice(["", "", "#", " *"])


def test_against_every_order(spark):
    rng = random.Random(3)
    docs = [(i if rng.random() < 0.95 else None, text_of(rng), rng.choice(["en", "fr", None, ""]), "x") for i in range(250)]
    docs += [(rng.randrange(400), rng.choice(docs)[1], rng.choice(["en", "de"]), "y") for _ in range(150)]
    labels = [(rng.choice([None, *range(300)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask string")
    got = audit_filters(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = model(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs, labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""}
    assert all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in one)


@pytest.mark.parametrize("text", ["", "word " * 200_000, "A" * 1_000_000, "\x0b\x0c\r#"])
def test_own_failures_of_long_texts(text):
    assert own_failures(text.encode()) == sum(f << i for i, f in enumerate(fails(text)))


def test_lookup():
    table = first_failures()
    assert table.shape == (32, 120)
    assert (table[0] == 5).all() and (table[31] == 0).all()
    assert table[1 << 2, ORDERS.index("BACDE")] == 2
