import hashlib
import random
import re

from palimpsest.llm import pii

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, body):
    digits = [int(c) for c in body if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in body.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return ",".join(
        f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(RX[k], text or "") if ok(k, m.group())
    )


def result(spark, rows, schema="doc_id long, text string, base string, uid string"):
    found = pii.find_personal_data(spark.createDataFrame(rows, schema))
    return found.select("doc_id", pii.digest(found["base"]).alias("b"), pii.digest(found["more"]).alias("m")).collect()


def test_base_matches_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "_d@e.f", "..", "a.b-c@x-y.z9", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112",
            "+1 (952) 555-4063", "+12", "é", "𝒳", " ", "-", "\n", "0000000000000000", "12", "@", "+49.30.123456 ", "000255.1.1.1",
            "x", "5500-0000-0000-0004", "1.2.3", "'", "a@b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += [None, "", "9" * 30000, "a" * 30000 + "@", "a@" + "b." * 9000 + "c", "+1" + " " * 20000, "1." * 20000]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a@b.c", None, None), (0, "a@b.c", None, None)]
    got = result(spark, rows)
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(r[0]), brute(r[1])) for r in rows)
    assert hashlib.sha256(b"").hexdigest()  # what an empty list of spans gives


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"aa{i} bb call us: +1 (202) 555-01{i:02d} cc{i}", "", "") for i in range(10, 30)]
    rows += [(100, "zz call us: 202-555-0199 end", "", ""), (101, "zz it has 202-555-0198 parts", "", "")]
    rows += [(200 + i, f"word the number the word{i}", "", "") for i in range(30)]
    more = {r.doc_id: r.m for r in result(spark, rows) if r.m}
    assert more == {100: "phone:12:24"}


def test_glued_cues(spark):
    rows = [(i, f"aa{i} tel:+1 (202) 555-01{i:02d} cc{i}", "", "") for i in range(10, 30)]
    rows += [(100, "zz tel:202-555-0199 end", "", "")]
    # 'num=' precedes a phone once for every three other things, though it stands alone once.
    rows += [(200 + i, f"bb{i} num=+1 (202) 555-02{i:02d}", "", "") for i in range(10, 30)]
    rows += [(300 + i, f"cc{i} num=word{i}", "", "") for i in range(60)]
    rows += [(400, "dd num= alone", "", ""), (401, "ee num=202-555-0298 end", "", "")]
    more = {r.doc_id: r.m for r in result(spark, rows) if r.m}
    assert more == {100: "phone:7:19"}


def test_rounds_until_nothing_is_trusted(spark):
    # Pattern k is seen before what pattern k + 1 is seen before: each round trusts one more.
    rows = [(i, f"w{i} cue0: +1 (202) 555-01{10 + i % 20}", "", "") for i in range(200)]
    n = 200
    for k in range(6):
        for j in range(10):
            for c in [k] + [k + 1] * 20:
                rows.append((n, f"x{n} cue{c}: 202-5{k}5-01{j:02d}", "", ""))
                n += 1
    more = {r.doc_id for r in result(spark, rows) if r.m}
    assert more == set(range(200, n))


def test_empty(spark):
    assert result(spark, []) == []
