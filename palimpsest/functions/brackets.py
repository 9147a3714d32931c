"""Links and templates of a wikitext, nested in any way, by an automaton over brackets in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is no text of its own: comments, and text that isn't to be read.
HIDDEN = r"(?s)<!--.*?-->|<nowiki>.*?</nowiki>|<nowiki */>"
#: Every character is in one token: a pair of brackets, a bar, or a run of others.
TOKEN = r"(\[\[|\]\]|\{\{|\}\}|\||[^\[\]{}|]+|.)"

_OPEN = "struct<kind:string,start:int,bars:array<int>>"


def shown(text: Column) -> Column:
    """The text without what is hidden."""
    return F.regexp_replace(text, HIDDEN, "")


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often the body's functions ask for it."""
    return F.get(F.transform(F.array(value), body), 0)


def spans(text: Column) -> Column:
    """(start, kind, parts) of the links (``[``) and templates (``{``) of a text without hidden parts, in the order of their
    starts, those around others first; null for null.

    ``parts`` are the raw texts between the brackets and the bars that belong to them, whatever is nested in them. A
    closing pair takes the last open one of its kind; open ones above it are text, and so is a closing pair that finds
    none and what is open at the end. Tokens are looked at once, with the open brackets as a stack.
    """
    return once(F.regexp_extract_all(text, F.lit("(?s)" + TOKEN), 1), _spans)


def _spans(tokens: Column) -> Column:
    """Positions are those of tokens, so that no part is looked for in the whole text."""
    empty = F.array().cast(f"array<{_OPEN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, token: Column) -> Column:
        at, open_, done = s["at"], s["open"], s["done"]
        after = at + 1
        depth = F.size(open_)
        kind = F.when(token == "]]", "[").otherwise("{")
        closes = F.array_max(F.transform(open_, lambda o, i: F.when(o["kind"] == kind, i)))
        own = F.get(open_, closes)
        top = F.get(open_, depth - 1)
        opened = F.array_append(
            open_, F.struct(F.substring(token, 1, 1).alias("kind"), after.alias("start"), F.array().cast("array<int>").alias("bars")).cast(_OPEN)
        )
        barred = F.array_append(
            F.slice(open_, F.lit(1), F.greatest(depth - 1, F.lit(0))),
            F.struct(top["kind"].alias("kind"), top["start"].alias("start"), F.array_append(top["bars"], at).alias("bars")).cast(_OPEN),
        )
        # As text: an array of structs would be copied struct by struct at every step.
        numbers = F.concat(F.array(own["start"]), own["bars"], F.array(at))
        ended = F.array_append(done, F.concat(own["kind"], F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")))
        is_close = token.isin("]]", "}}") & closes.isNotNull()
        return F.struct(
            after.alias("at"),
            F.when(token.isin("[[", "{{"), opened)
            .when((token == "|") & (depth > 0), barred)
            .when(is_close, F.slice(open_, F.lit(1), F.coalesce(closes, F.lit(0))))
            .otherwise(open_)
            .alias("open"),
            F.when(is_close, ended).otherwise(done).alias("done"),
        )

    def read(d: Column) -> Column:
        numbers = F.split(d.substr(F.lit(2), F.length(d)), ",").cast("array<int>")
        return F.struct(F.get(numbers, 0).alias("start"), F.substring(d, 1, 1).alias("kind"), numbers.alias("bounds"))

    def parts(bounds: Column) -> Column:
        """The tokens between the start, the bars and the end; from the second on without the bar before them."""
        part = lambda i: F.when(i == 0, F.get(bounds, 0)).otherwise(F.get(bounds, i) + 1)
        return F.transform(
            F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.array_join(F.slice(tokens, part(i) + 1, F.get(bounds, i + 1) - part(i)), "")
        )

    found = F.sort_array(F.transform(F.aggregate(tokens, start, step, lambda s: s["done"]), read))
    return F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["kind"].alias("kind"), parts(d["bounds"]).alias("parts")))


def links(text: Column) -> Column:
    """(title, text) of the links of a text, in order: the raw title, and what follows its first bar, empty without one.
    What has another link or a line's end in its title is none; links in captions and templates are."""
    own = F.filter(spans(text), lambda s: (s["kind"] == "[") & ~F.contains(F.get(s["parts"], 0), F.lit("[[")) & ~F.contains(F.get(s["parts"], 0), F.lit("\n")))
    return F.transform(
        own,
        lambda s: F.struct(
            F.get(s["parts"], 0).alias("title"), F.array_join(F.slice(s["parts"], F.lit(2), F.size(s["parts"])), "|").alias("text")
        ),
    )


def values(text: Column) -> Column:
    """Values of the parameters of the templates of a text, raw, in order: what follows the first ``=`` of a parameter, or
    all of it."""
    own = F.filter(spans(text), lambda s: s["kind"] == "{")
    value = lambda p: F.when(F.contains(p, F.lit("=")), p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise(p)
    return F.flatten(F.transform(own, lambda s: F.transform(F.slice(s["parts"], F.lit(2), F.size(s["parts"])), value)))
