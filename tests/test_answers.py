"""Readers of a service's answers."""

import json


from palimpsest.operators import answers


def frame(spark, *rows):
    return spark.createDataFrame([(t, b if b is None or isinstance(b, str) else json.dumps(b)) for t, b in rows], "titles array<string>, body string")


def change(a, b):
    return {"from": a, "to": b}


def test_titles_through_chains(spark):
    chain = [change(f"t{i}", f"t{i + 1}") for i in range(40)]
    body = {"query": {"normalized": [change("x", "t0")], "redirects": [*chain, change("o1", "o2"), change("o2", "o1")], "pages": {"9": {"title": "t40"}, "-1": {"title": "gone", "missing": ""}, "-2": {"title": "<", "invalid": ""}}}}
    asked = ["x", "t7", "t40", "gone", "<", "o1", "unknown", None, "x"]
    got = {r.title: r.exists for r in answers.existence(frame(spark, (asked, body), (["lost"], "no json"), (["t40"], {}), (None, body))).collect()}
    assert got == {"x": True, "t7": True, "t40": True, "gone": False, "<": False, "o1": False, "unknown": False, "lost": False}


def test_texts_and_files(spark):
    def page(title, text):
        return {"title": title, "revisions": [{"revid": 5, "timestamp": "2024-01-02T03:04:05Z", "slots": {"main": {"*": text}}}]}

    body = {"query": {"pages": {"1": page("N:a", "[[File:x y.png]] [[File:x y.png|b]]"), "2": {"title": "N:b", "missing": ""}, "3": page("c", "")}}}
    rows = frame(spark, (None, body), (None, {"query": {}}), (None, None))
    assert {r.title: r.links for r in answers.documents(rows).collect()} == {"a": ["/wiki/File:x_y.png"], "b": [], "c": []}
    assert {tuple(r) for r in answers.histories(rows).collect()} == {("N:a", 5, "2024,01,02,03:04"), ("c", 5, "2024,01,02,03:04")}
    read = frame(spark, (["p"], {"parse": {"title": "N:q/r: s", "revid": 3, "wikitext": {"*": "text"}}}), (["e"], {"error": {"code": "c"}}), (["n"], None))
    got = {r.titles[0]: (r.title, r.revid, r.wikitext, r.error) for r in answers.contents(read).collect()}
    assert got == {"p": ("q/r: s", 3, "text", None), "e": (None, None, None, "c"), "n": (None, None, None, "no answer")}
