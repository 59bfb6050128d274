"""ST-12 to ST-15 as columns: places of all forms by running sums over what is between the matches, consumed in one fold.

The forms, lists and patterns are those of :mod:`lexgraph.functions.legal`; that module reads one sentence at a time in Python, this one stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import legal
from .text import document_id

#: Java's flags for what Python's patterns mean by default: case by Unicode, and words, digits and spaces by Unicode.
FLAGS = "(?iuU)"
_TARGETS = "array<struct<article:string,clause:string,point:string>>"
_MENTIONS = "array<struct<at:int,rank:int,labels:array<string>>>"
_GROUPS = "array<struct<points:array<string>,clauses:array<string>,article:string,rank:int>>"


def _java(pattern: str) -> str:
    return FLAGS + pattern.replace(r"\A", "^")


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<start,stop,groups>> of all matches (the whole match is group 0), in order; start counts characters from 0."""
    java = F.lit(_java(pattern))
    found = [F.regexp_extract_all(text, java, F.lit(k)) for k in range(groups + 1)]
    gaps = F.transform(F.split(text, _java(pattern), -1), F.char_length)
    long = F.transform(found[0], F.char_length)
    total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    start = lambda i: total(gaps, i + 1) + total(long, i)
    one = lambda x, i: F.struct(start(i).alias("start"), (start(i) + F.char_length(x)).alias("stop"), F.array(x, *[F.get(g, i) for g in found[1:]]).alias("groups"))
    return F.transform(found[0], one)


def _labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_java(legal.LABEL.pattern)), F.lit(0))


def mentions(text: Column) -> Column:
    """array<struct<at,rank,labels>> of points (0), clauses (1; a repeated label is a mention of its own) and articles (2), by place."""
    points = F.transform(matches(text, legal.POINT_LIST.pattern, 1), lambda m: F.struct(m["start"].alias("at"), F.lit(0).alias("rank"), _labels(m["groups"][1]).alias("labels")))
    parts = lambda m: F.regexp_extract_all(m["groups"][1], F.lit(FLAGS + "(?s)" + legal.LABELLED.pattern), F.lit(1))
    clause = lambda m: F.transform(parts(m), lambda p, i: F.struct((m["start"] + 1 + i).alias("at"), F.lit(1).alias("rank"), _labels(p).alias("labels")))
    clauses = F.flatten(F.transform(matches(text, legal.CLAUSE_LIST.pattern, 1), clause))
    articles = F.transform(matches(text, legal.ARTICLE.pattern, 1), lambda m: F.struct(m["start"].alias("at"), F.lit(2).alias("rank"), F.array(m["groups"][1]).alias("labels")))
    return F.array_sort(F.concat(points, clauses, articles)).cast(_MENTIONS)


def targets(text: Column) -> Column:
    """ST-14, ST-15: as :func:`lexgraph.functions.legal.targets`: groups of mentions that climb in rank, completed by what follows them."""
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")

    def step(groups: Column, m: Column) -> Column:
        last = F.get(groups, F.size(groups) - 1)
        fresh = (F.size(groups) == 0) | ((m["rank"] <= last["rank"]) & ~((m["rank"] == last["rank"]) & (m["rank"] == 0)))
        before = F.when(fresh, groups).otherwise(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))))
        held = lambda field, start: F.when(fresh, start).otherwise(last[field])
        new = F.struct(
            F.concat(held("points", empty), F.when(m["rank"] == 0, m["labels"]).otherwise(empty)).alias("points"), F.concat(held("clauses", empty), F.when(m["rank"] == 1, m["labels"]).otherwise(empty)).alias("clauses"),
            F.when(m["rank"] == 2, F.get(m["labels"], F.lit(0))).otherwise(held("article", none)).alias("article"), m["rank"].alias("rank"),
        )
        return F.concat(before, F.array(new)).cast(_GROUPS)

    groups = F.aggregate(mentions(text), F.array().cast(_GROUPS), step)
    state = f"struct<article:string,clause:string,done:{_GROUPS}>"

    def back(s: Column, g: Column) -> Column:
        article = F.coalesce(g["article"], s["article"])
        clauses = F.when((F.size(g["clauses"]) == 0) & article.isNull() & s["clause"].isNotNull(), F.array(s["clause"])).otherwise(g["clauses"])
        whole = F.struct(g["points"].alias("points"), clauses.alias("clauses"), article.alias("article"), g["rank"].alias("rank"))
        return F.struct(article.alias("article"), F.coalesce(F.get(clauses, F.lit(0)), s["clause"]).alias("clause"), F.concat(F.array(whole), s["done"]).alias("done")).cast(state)

    start = F.struct(none.alias("article"), none.alias("clause"), F.array().cast(_GROUPS).alias("done")).cast(state)
    done = F.aggregate(F.reverse(groups), start, back)["done"]
    or_none = lambda xs: F.when(F.size(xs) == 0, F.array(none)).otherwise(xs)
    spread = lambda g: F.flatten(F.transform(or_none(g["clauses"]), lambda c: F.transform(or_none(g["points"]), lambda p: F.struct(g["article"].alias("article"), c.alias("clause"), p.alias("point")))))
    return F.filter(F.flatten(F.transform(done, spread)), lambda t: t["article"].isNotNull() | t["clause"].isNotNull() | t["point"].isNotNull()).cast(_TARGETS)


def _unit(document: Column, article: Column, clause: Column, point: Column) -> Column:
    """The canonical id; null without a document."""
    part = lambda letter, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(letter), c))
    return F.when(document.isNotNull() & (document != ""), F.concat_ws("_", document_id(document), part("D", article), part("K", clause), part("D", point)))


def references(text: Column, document: Column, article: Column, clause: Column, point: Column, aliases: dict[str, str] | None = None) -> Column:
    """ST-12, ST-13: array<struct<target,relation>> as :func:`lexgraph.functions.legal.references`: a span is consumed by the first form that reads it.

    ``aliases`` are compared one by one, so they should be few; a large registry is looked up by :func:`lexgraph.operators.patterns.longest_alias`. Give the text and the place as columns of an earlier projection."""
    here = {0: article, 1: clause, 2: point}
    held = F.coalesce(text, F.lit(""))

    def named(name: Column) -> Column:
        found = F.lit(None).cast("string")
        ordered = sorted((aliases or {}).items(), key=lambda x: -len(x[0]))  # the longest first, then the order of the registry
        for alias, number in reversed(ordered):
            found = F.when(F.contains(F.lower(name), F.lit(alias)), F.lit(number)).otherwise(found)
        return F.when(name.rlike(f"^{legal.DOCUMENT_NUMBER}$"), name).otherwise(found)

    def span(m: Column, ids: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["stop"].alias("stop"), ids.alias("ids"))

    def series(local: bool):
        def one(m: Column) -> Column:
            said = F.regexp_replace(m["groups"][0], F.lit(FLAGS + r"Điều\s+này"), F.concat(F.lit("Điều "), F.coalesce(article, F.lit("None")))) if local else m["groups"][0]
            return span(m, F.transform(targets(said), lambda t: _unit(document, t["article"], t["clause"], t["point"])))

        return one

    def single(doc: int | str, slots: list):
        def one(m: Column) -> Column:
            place = [here[k] if s == "here" else F.lit(None).cast("string") if s is None else m["groups"][s] for k, s in enumerate(slots)]
            return span(m, F.array(_unit(document if doc == "here" else named(m["groups"][doc]), *place)))

        return one

    spans = []
    for pattern, local in ((legal._SERIES_HERE.pattern, True), (legal._SERIES_NUMBERED.pattern, False)):
        found = matches(held, pattern, 0)
        if local:
            found = F.filter(found, lambda m: ~m["groups"][0].rlike(_java(legal.ARTICLE.pattern)))
        spans.append(F.filter(F.transform(found, series(local)), lambda x: F.size(x["ids"]) > 0))
    for pattern, doc, *slots in legal.FORMS:
        n = max([x for x in (doc, *slots) if isinstance(x, int)], default=0)
        spans.append(F.transform(matches(held, pattern, n), single(doc, slots)))
    kind = "array<struct<start:int,stop:int,ids:array<string>>>"
    every = F.flatten(F.array(*[x.cast(kind) for x in spans]))
    inside = lambda x, taken: F.exists(taken, lambda t: (t["start"] <= x["start"]) & (x["stop"] <= t["stop"]))
    kept = F.aggregate(every, F.array().cast(kind), lambda taken, x: F.when(inside(x, taken), taken).otherwise(F.concat(taken, F.array(x))))

    def relation(x: Column) -> Column:
        before = F.substr(held, F.greatest(x["start"] - 40, F.lit(0)) + 1, F.least(x["start"], F.lit(40)))
        out = F.lit("THAM_CHIEU")
        for label, pattern in reversed(legal.RELATIONS):
            out = F.when(before.rlike(_java(pattern.pattern)), label).otherwise(out)
        return out

    return F.flatten(F.transform(kept, lambda x: F.transform(x["ids"], lambda i: F.struct(i.alias("target"), relation(x).alias("relation")))))
