import random

import pytest

import palimpsest.llm.lines as lines

SCHEMA = "doc_id long, text string, gone string, c0 long"


def brute(rows):
    """[(doc_id, line_no, n_words, kept)] by comparing all lines."""
    found = []
    for doc, text, *_ in dict.fromkeys(rows):
        for at, line in enumerate((text or "").split("\n")):
            words = frozenset(line.encode().split())
            if words:
                found.append((doc, at, words))
    first = lambda r: (r[0] is not None, r[0] or 0, r[1])
    out = []
    for a in found:
        late = any(first(b) < first(a) and 9 * len(a[2] & b[2]) >= 4 * (len(a[2]) + len(b[2])) for b in found)
        out.append((a[0], a[1], len(a[2]), not late))
    return sorted(out, key=str)


def planted(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß#", "the"] * 20
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 12, 30, 60]))] for _ in range(25)]
    rows = []
    for i in range(docs):
        body = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            body.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(body), "x", i))
    return rows


@pytest.mark.parametrize("hot,rounds", [(32, 4), (2, 4), (2, 1)])
def test_verdicts_match_brute_force(spark, monkeypatch, hot, rounds):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "ROUNDS", rounds)
    rows = planted(hot + rounds)
    got = lines.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.line_no, r.n_words, r.kept) for r in got), key=str) == brute(rows)


def test_words_of_equal_hash_are_two_words(spark):
    from pyspark.sql import functions as F

    one, two = "q88212", "q129256"
    assert spark.range(1).select(F.hash(F.lit(one)) == F.hash(F.lit(two))).first()[0]
    shared = [f"shared{i}" for i in range(15)]
    rows = [(1, " ".join([*shared, one, "a1", "a2"]), "", 1), (2, " ".join([*shared, two, "b1", "b2"]), "", 2)]
    rows += [(i, " ".join(shared[:1] * 3 + [f"filler{i}x{j}" for j in range(9)]), "", i) for i in range(3, 43)]
    got = lines.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.kept for r in got} == {d: True for d, *_ in rows}


def test_words_that_agree_in_55_bits_are_two_words(spark):
    from pyspark.sql import functions as F

    one, two = "yopumzgd", "Gvd&re}b"
    low = lambda w: F.xxhash64(F.lit(w)).bitwiseAND(F.lit((1 << 55) - 1))
    assert spark.range(1).select(low(one) == low(two)).first()[0]
    rows = [(1, one, "", 1), (2, two, "", 2), (3, f"{one} {two}", "", 3), (4, f"{two} {one} {two}", "", 4)]
    shared = [f"s{i}" for i in range(8)]
    rows += [(5, " ".join([*shared, one, two]), "", 5), (6, " ".join([*shared, two, "other"]), "", 6)]
    got = lines.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.line_no, r.n_words, r.kept) for r in got), key=str) == brute(rows)


def test_candidates_that_fail_do_not_hide_others(spark, monkeypatch):
    """Without a parity filter most candidates fail their check; the others of a class still count."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "bits_apart", lambda a, b: F.lit(0))
    monkeypatch.setattr(lines, "HOT", 3)
    rows = planted(11, 90)
    got = lines.judge_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.line_no, r.n_words, r.kept) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [
        (1, "same line here\n\nother one", None, 1),
        (1, "same line here\n\nother one", None, 1),
        (2, None, None, 2),
        (3, "", None, 3),
        (4, "  \n\t\nsame line here\n \n", None, 4),
        (None, "before all\nsame line here", None, None),
        (5, long + "\n" + long, None, 5),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(((r.doc_id, r.line_no, r.n_words, r.kept) for r in lines.judge_lines(docs).collect()), key=str) == brute(rows)
    left = lines.drop_later_lines(docs, length="c0")
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), str(r.c0)) for r in left.collect()) == sorted(
        (str(a), str(b), str(c))
        for a, b, c in [
            (1, "\nother one", 10),
            (1, "\nother one", 10),
            (2, None, 2),
            (3, "", 3),
            (4, "  \n\t\n \n", 7),
            (None, "before all\nsame line here", None),
            (5, long, len(long)),
        ]
    )
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.judge_lines(empty).count() == 0 and lines.drop_later_lines(empty).count() == 0


def test_classes_meet_by_their_number_alone(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "q r s t u v w x y z")], "doc_id long, text string")
    lines_ = lines.line_table(docs).withColumn("k1", F.lit(0)).withColumn("k2", F.lit(0))
    first = F.struct("doc_id", "line_no", "body").alias("first")
    classes = lines_.select("k1", "k2", first, "n", "bits", "more", "p", F.col("doc_id").alias("c"))
    assert [r.c for r in lines.late_classes(classes, lines.whole_texts(docs, "doc_id", "text")).collect()] == [2]
