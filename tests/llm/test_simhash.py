import random

import numpy as np
import pytest
import xxhash

import palimpsest.llm.simhash as simhash

SCHEMA = "doc_id long, text string, fp string, a long"


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names = {}
    for doc, fp in prints:
        seen, todo = {doc}, [fp]
        done = set()
        while todo:
            x = todo.pop()
            done.add(x)
            for d, y in prints:
                if bin(x ^ y).count("1") <= 3:
                    seen.add(d)
                    if y not in done and y not in todo:
                        todo.append(y)
        names[doc] = min(d for d in seen if d is not None)
    return names


def planted():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["É", "Ab", "ß"]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 400, 900]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n", " \t "]).join(w), "x", 1))
    return rows + [(len(rows), None, None, None), (len(rows) + 1, "  ", None, None)]


@pytest.mark.parametrize("tile", [1024, 2])
def test_groups_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = planted()
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [(d, brute_print(t)) for d, t, *_ in rows]
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{fp:016x}" for d, fp in prints}
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints)


def test_links_of_all_distances(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    for bits in (1, 2, 3, 4, 5):
        for _ in range(60):
            x = base
            for b in rng.choice(64, bits, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(fps)]
    frame = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, id long")
    from palimpsest.llm.common import components

    got = {r.node: r.component for r in components(simhash.link_fingerprints(frame)).collect()}
    want = brute_components(list(enumerate(sorted(fps))))
    assert {i: got.get(i, i) for i in want} == want


def test_odd_rows(spark):
    rows = [(5, "a b c d", "", 1), (5, "a b c d", "", 1), (None, "a b c d", "", 2), (9, "a B c d", "", 3), (7, "q r s t u", "", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == [("5", 5), ("5", 5), ("7", 7), ("9", 5), ("None", 5)]
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "None"]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one_of_each(empty).count() == 0


def test_repeated_keys_keep_one_row_of_each_group(spark):
    a, b = "stone river cloud tree lamp paper glass iron " * 4, "merchant ocean violet winter harbor copper falcon quartz " * 4
    rows = [(5, a, "", 1), (9, a, "", 2), (5, b, "", 3), (3, b, "", 4)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, b), (5, a)]
    rows = [(5, a, "", 1), (5, b, "", 2), (5, a, "", 0), (None, b, "", 3)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.a, r.text) for r in kept) == [(0, a), (2, b), (3, b)]
