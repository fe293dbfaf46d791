"""Faceted search: one builder of predicates serves the list, its count and the facets, so they always agree."""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import any_needle, search_fold

#: Most rows a search ever returns, whatever the page.
SEARCH_LIMIT = 300
FACETS = ("venue", "work_type", "year")
SORTS = ("", "relevance", "year", "citations", "title")


@dataclass(frozen=True)
class Filters:
    """An empty facet is unset. Year labels may be decades, 'a-b', with any dash, in either order."""

    query: str = ""
    venue: tuple[str, ...] = ()
    work_type: tuple[str, ...] = ()
    year: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    min_citations: int | None = None
    inclusion_status: tuple[str, ...] = ()
    content_status: tuple[str, ...] = ()
    sort: str = ""
    extra: tuple[Column, ...] = field(default=())


def year_labels(labels: tuple[str, ...]) -> list[list[int]]:
    """Years and spans of years; a label that is neither counts as none."""
    ends = [[x.strip() for x in label.replace("–", "-").replace("—", "-").split("-")] for label in labels]
    return [sorted(map(int, e)) for e in ends if len(e) <= 2 and all(x.isdigit() for x in e)]


def year_clause(labels: tuple[str, ...]) -> Column:
    ends = year_labels(labels)
    exact, ranges = [e for e in ends if len(e) == 1], [e for e in ends if len(e) == 2]
    parts = [F.col("year").isin([e[0] for e in exact])] if exact else []
    return reduce(lambda a, b: a | b, [*parts, *(F.col("year").between(*r) for r in ranges)])


def predicates(f: Filters, without: str | None = None, scoped: bool = False) -> Column:
    """All clauses but those of one facet. An inclusion filter has no meaning without a project, and then nothing matches."""
    parts = [any_needle(f.query, F.col("title"), F.col("abstract"), F.col("venue"))]
    for name in ("venue", "work_type"):
        values = [v for v in getattr(f, name) if v.strip()]
        if values and name != without:
            parts.append(F.col(name).isin(values))
    if year_labels(f.year) and without != "year":
        parts.append(year_clause(f.year))
    included, content = ([v for v in x if v.strip()] for x in (f.inclusion_status, f.content_status))
    if included and without != "inclusion_status":
        parts.append(F.col("inclusion_status").isin(included) if scoped else F.lit(False))
    if content and without != "content_status":
        parts.append(F.coalesce(F.arrays_overlap("content_statuses", F.array(*map(F.lit, content))), F.lit(False)))
    if f.year_from is not None:
        parts.append(F.col("year") >= f.year_from)
    if f.year_to is not None:
        parts.append(F.col("year") <= f.year_to)
    if f.min_citations is not None:
        parts.append(F.col("n_citations") >= f.min_citations)
    return reduce(lambda a, b: a & b, [*parts, *f.extra])


def with_citations(works: DataFrame, citations: DataFrame) -> DataFrame:
    n = citations.groupBy(F.col("cited").alias("work_id")).agg(F.count("*").alias("n_citations"))
    return works.join(n, "work_id", "left").fillna(0, ["n_citations"])


def search(works: DataFrame, citations: DataFrame, authors: DataFrame, f: Filters, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of hits, most cited first, then year (absent last), title without regard to ASCII case, and id; authors in order, a snippet of 200 characters."""
    hits = with_citations(works, citations).where(predicates(f))
    order = [F.desc("n_citations"), F.desc_nulls_last("year"), F.asc("folded"), F.asc("work_id")]
    page = hits.withColumn("folded", F.translate("title", string.ascii_uppercase, string.ascii_lowercase)).orderBy(*order).offset(offset).limit(max(0, min(limit, SEARCH_LIMIT - offset)))
    page = page.withColumn("place", F.row_number().over(W.orderBy(*order)))  # a join may lose the order that a sort then takes for given
    own = authors.join(F.broadcast(page.select("work_id")), "work_id")  # at most SEARCH_LIMIT rows
    names = own.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), "; ").alias("authors"))
    return page.join(names, "work_id", "left").orderBy("place").select("work_id", "title", "year", "venue", "n_citations", F.substring("abstract", 1, 200).alias("snippet"), F.coalesce("authors", F.lit("")).alias("authors"))


def written_by(authors: DataFrame, needles: tuple[str, ...]) -> DataFrame:
    """Ids of works of which any author's folded name holds any of the folded needles; blank needles don't count."""
    wanted = [n.strip() for n in needles if n.strip()]
    clause = reduce(lambda a, b: a | b, (F.contains(search_fold(F.col("name")), search_fold(F.lit(n))) for n in wanted), F.lit(not wanted))
    return authors.where(clause).select("work_id").distinct()


def count(works: DataFrame, citations: DataFrame, f: Filters) -> DataFrame:
    return with_citations(works, citations).where(predicates(f)).agg(F.count("*").alias("n"))


def facets(works: DataFrame, citations: DataFrame, f: Filters) -> DataFrame:
    """(facet, value, n): each facet counted under the query and all other facets, in one pass; absent values dropped."""
    each = F.array(*(F.struct(F.lit(x).alias("facet"), F.col(x).cast("string").alias("value"), predicates(f, x).alias("on")) for x in FACETS))
    rows = with_citations(works, citations).select(F.explode(each).alias("x")).select("x.*")
    return rows.where(F.col("on") & F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))


def population(works: DataFrame, citations: DataFrame, documents: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """What is searched: works with n_citations and the content_statuses of their preferred documents; with ``members``
    (work_id, relevance, inclusion_status of one project) only these, and what they say. List, count and facets all start here."""
    own = documents.where("is_preferred and content_status is not null").groupBy("work_id").agg(F.collect_set("content_status").alias("content_statuses"))
    x = with_citations(works, citations).join(own, "work_id", "left")
    return x if members is None else x.join(members.select("work_id", "relevance", "inclusion_status"), "work_id")


def order_of(sort: str, scoped: bool) -> list[Column]:
    """Titles go without regard to ASCII case; absent years and relevances come last."""
    if sort not in SORTS:
        raise ValueError(f"sorts are {SORTS}")
    tie = [F.translate("title", string.ascii_uppercase, string.ascii_lowercase), F.asc("work_id")]
    first = {"year": [F.desc_nulls_last("year")], "citations": [F.desc("n_citations")], "title": []}
    return first.get(sort, [F.desc_nulls_last("relevance")] if scoped else []) + tie


def page(people: DataFrame, f: Filters, scoped: bool, limit: int = SEARCH_LIMIT, offset: int = 0) -> DataFrame:
    """(place, work_id, title, year, venue, work_type, n_citations, snippet) of a page, numbered from the offset on."""
    start = min(max(0, offset), SEARCH_LIMIT)
    hits = people.where(predicates(f, scoped=scoped)).orderBy(*order_of(f.sort, scoped)).limit(min(SEARCH_LIMIT, start + max(1, limit)))  # SEARCH_LIMIT rows at most
    numbered = hits.withColumn("place", F.row_number().over(W.orderBy(*order_of(f.sort, scoped))))
    return numbered.where(F.col("place") > start).select("place", "work_id", "title", "year", "venue", "work_type", "n_citations", F.substring("abstract", 1, 200).alias("snippet"))


def total(people: DataFrame, f: Filters, scoped: bool) -> DataFrame:
    return people.where(predicates(f, scoped=scoped)).agg(F.count("*").alias("n"))


def buckets(people: DataFrame, f: Filters, scoped: bool) -> DataFrame:
    """(facet, value, n): each of five facets counted under the query and all other facets, in one pass. A work with several
    preferred documents counts for each of their statuses once. Without a project there is no inclusion facet."""
    one = lambda x: F.array(F.col(x).cast("string"))
    values = {x: one(x) for x in FACETS} | {"content_status": F.coalesce("content_statuses", F.array().cast("array<string>"))} | ({"inclusion_status": one("inclusion_status")} if scoped else {})
    each = F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("values"), predicates(f, k, scoped).alias("on")) for k, v in values.items()))
    rows = people.select(F.explode(each).alias("x")).select("x.*").where("on").select("facet", F.explode("values").alias("value"))
    return rows.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
