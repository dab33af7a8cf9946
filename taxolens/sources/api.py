"""A paginated JSON API as a Spark data source, and acquisition built on it.

``spark.read.format("paged_api")`` follows a cursor page by page in one task; pages of a
seeded sample are independent and read in one task each. ``works_api`` turns Spark's filters
into the API's and reads ranges of keys in tasks of their own. Requests are retried on 429,
5xx, network and JSON errors. A snapshot is whole or not at all.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

from taxolens.operators.components import store
from taxolens.operators.ordering import lowest
from taxolens.operators.validate import InputError

# Attempts, first and further waits in seconds, timeout, most pages, page size.
ATTEMPTS, WAIT, WAIT_MORE, TIMEOUT, MOST_PAGES, PAGE = 5, 2, 2, 40, 100, 200


class FetchError(RuntimeError):
    """A request that failed for good, or pages that do not fit together."""


def passing(error: Exception) -> bool:
    """May the same request succeed later? Client errors but 429 stay."""
    return not isinstance(error, urllib.error.HTTPError) or error.code == 429 or error.code // 100 == 5


def get_json(url: str, opener=urllib.request.urlopen, sleep=time.sleep) -> dict:
    """The JSON of a url, asked for up to ATTEMPTS times."""
    waits = [WAIT + WAIT_MORE * i for i in range(ATTEMPTS - 1)]
    for wait in [*waits, None]:
        try:
            with opener(url, timeout=TIMEOUT) as answer:
                return json.loads(answer.read())
        except (OSError, ValueError) as e:
            if wait is None or not passing(e):
                raise FetchError(f"no answer from {url}: {e}") from e
        sleep(wait)
    raise AssertionError


@dataclass(frozen=True)
class Page:
    """What a page says of itself: its cursor and the next, the count of all results."""

    cursor: str
    after: str | None
    count: int
    rows: tuple


def walk(base: str, get=get_json):
    """Pages by cursor, until one names no next."""
    cursor: str | None = "*"
    for _ in range(MOST_PAGES):
        found = get(f"{base}{'&' if '?' in base else '?'}{urllib.parse.urlencode({'per-page': PAGE, 'cursor': cursor})}")
        page = Page(cursor, found["meta"].get("next_cursor"), found["meta"]["count"], tuple(found["results"]))
        yield page
        if not (cursor := page.after):
            return
    raise FetchError(f"more than {MOST_PAGES} pages")


def whole(pages: list[Page]) -> str | None:
    """Why pages do not make up one result, or None if they do."""
    rows = [r["id"] for p in pages for r in p.rows]
    checks = {
        "a cursor came twice": len({p.cursor for p in pages}) == len(pages),
        "the count changed between pages": len({p.count for p in pages}) == 1,
        "results are missing or came twice": 0 < len(rows) == len(set(rows)) == pages[0].count,
    }
    return next((why for why, fine in checks.items() if not fine), None)


def cursor_pages(base: str, get=get_json, empty: bool = False) -> list[dict]:
    """The results of all pages (at most MOST_PAGES of PAGE), or an error if they do not
    make up one result; a result of nothing is one only where it may be ``empty``."""
    pages: list[Page] = []
    for page in walk(base, get):
        if any(page.cursor == p.cursor for p in pages):
            raise FetchError("a cursor came twice")
        pages.append(page)
    if empty and len(pages) == 1 and not pages[0].rows and pages[0].count == 0:
        return []
    if why := whole(pages):
        raise FetchError(why)
    return [r for p in pages for r in p.rows]


class Pages(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        if self.options.get("mode", "cursor") == "cursor":
            return [Pages([self.options["url"]])]
        size = int(self.options["size"])
        if not 1 <= size <= 10_000:
            raise InputError("sample size must be 1-10000")
        each = min(PAGE, size)
        query = {"sample": size, "seed": self.options.get("seed", "42"), "per-page": each}
        query = {"filter": self.options["filter"]} | query
        return [Pages([f"{self.options['url']}?{urllib.parse.urlencode(query | {'page': p})}"]) for p in range(1, -(-size // PAGE) + 1)]

    def read(self, part):
        cursor = self.options.get("mode", "cursor") == "cursor"
        for url in part.urls:
            for row in cursor_pages(url) if cursor else get_json(url)["results"]:
                yield (row["id"], json.dumps(row, ensure_ascii=False))


class PagedSource(DataSource):
    """Options: url; mode (cursor or sample); for samples filter, size and seed."""

    @classmethod
    def name(cls):
        return "paged_api"

    def schema(self):
        return "id string, body string"

    def reader(self, schema):
        return PagedReader(dict(self.options))


_PARENT = "struct<id:string,display_name:string>"
TOPIC = f"id string, display_name string, description string, keywords array<string>, subfield {_PARENT}, field {_PARENT}, domain {_PARENT}, works_count bigint, cited_by_count bigint, created_date string, updated_date string, siblings array<struct<id:string>>"
WORK = "id string, doi string, title string, type string, primary_location struct<source:struct<id:string,display_name:string>>, primary_topic struct<id:string>, topics array<struct<id:string>>"


def read_api(spark: SparkSession, schema: str, **options) -> DataFrame:
    """Rows of a paged API, parsed by ``schema`` (fields it lacks are null)."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_api").options(**options).load().select(F.from_json("body", schema).alias("r")).select("r.*")


def topics(spark: SparkSession, url: str) -> DataFrame:
    """Topics with ``sibling_count`` in place of siblings."""
    rows = read_api(spark, TOPIC, url=url)
    return rows.withColumn("sibling_count", F.when(F.col("siblings").isNotNull(), F.size("siblings")).otherwise(0).cast("long")).drop("siblings")


def sampled_works(spark: SparkSession, url: str, filter_: str, size: int, seed: int = 42) -> DataFrame:
    """A seeded sample of works; a repeated id is an error."""
    rows = store(read_api(spark, WORK, url=url, mode="sample", filter=filter_, size=str(size), seed=str(seed)), "sampled")  # asked once
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise FetchError("duplicate work in seeded pagination")
    return rows.limit(size)


class SampledReader(DataSourceReader):
    """Samples of many groups in one scan: a task for each page of each."""

    def __init__(self, options: dict, get):
        self.options, self.get = options, get

    def partitions(self):
        groups = json.loads(self.options["groups"])
        return [part for name, said in groups for part in (GroupPages(name, p.urls) for p in PagedReader(self.options | {"mode": "sample", "filter": said}).partitions())]

    def read(self, part):
        for url in part.urls:
            for row in self.get(url)["results"]:
                yield (part.name, row["id"], json.dumps(row, ensure_ascii=False))


class GroupPages(Pages):
    def __init__(self, name: str, urls: list[str]):
        super().__init__(urls)
        self.name = name


def sampled_groups(spark: SparkSession, url: str, filters: dict[str, str], size: int, seed: int = 42, get=get_json) -> DataFrame:
    """(group, r): a seeded sample of works of each group (name: filter), read by one scan.
    A work that comes twice in a group is an error; at most ``size`` of each stay."""
    if not filters:
        return spark.createDataFrame([], "group string, body string").select("group", F.from_json("body", WORK).alias("r"))
    spark.dataSource.register(_source("sampled_groups", "group string, id string, body string", lambda o: SampledReader(o, get)))
    rows = spark.read.format("sampled_groups").options(url=url, size=str(size), seed=str(seed), groups=json.dumps(list(filters.items()))).load()
    rows = store(rows, "sampled")
    if not rows.groupBy("group", "id").count().where("count > 1").isEmpty():
        raise FetchError("duplicate work in seeded pagination")
    return lowest(rows, ["group"], F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), [F.col("id")], size).select("group", F.from_json("body", WORK).alias("r"))


# ---- filters that the API applies ------------------------------------------------------

#: Columns of works that the API can filter by, and its names for them.
FILTERED = {"type": "type", "publication_year": "publication_year", "cited_by_count": "cited_by_count", "language": "language", "topic_id": "primary_topic.id", "source_id": "primary_location.source.id"}
_INTEGERS = {"publication_year", "cited_by_count"}
WORKS = "id string, type string, publication_year int, cited_by_count bigint, language string, topic_id string, source_id string, body string"


def parameter(f: Filter) -> str | None:
    """A filter as the API's parameter, or None if it has none for it. Only filters that
    mean the same on both sides are translated: plain values without its signs."""
    negated = isinstance(f, Not)
    inner = f.child if negated else f
    column = ".".join(getattr(inner, "attribute", ()))
    if column not in FILTERED:
        return None
    name, whole = FILTERED[column], column in _INTEGERS

    def said(value) -> str | None:
        if whole:
            return str(value) if isinstance(value, int) and not isinstance(value, bool) else None
        return value if isinstance(value, str) and re.fullmatch(r"[A-Za-z0-9_./:-]*[A-Za-z0-9_./-]", value) and not value.startswith("null") else None

    if isinstance(inner, IsNull | IsNotNull):
        return None if negated else f"{name}:{'null' if isinstance(inner, IsNull) else '!null'}"
    if isinstance(inner, In):
        values = [said(v) for v in inner.value]
        return None if negated or not values or None in values else f"{name}:{'|'.join(values)}"
    if isinstance(inner, EqualTo) and (value := said(inner.value)) is not None:
        return None if negated else f"{name}:{value}"
    if whole and not negated and isinstance(inner, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and said(inner.value) is not None:
        step = {GreaterThanOrEqual: -1, LessThanOrEqual: 1}.get(type(inner), 0)
        return f"{name}:{'>' if isinstance(inner, GreaterThan | GreaterThanOrEqual) else '<'}{inner.value + step}"
    return None


@dataclass
class Range(InputPartition):
    """A part of a scan: what the API is asked for."""

    url: str


class WorksReader(DataSourceReader):
    """Works by cursor. Filters become parameters; with ``by``, ``from`` and ``to``, each
    value of an integer column is a part of its own, read by its own task."""

    def __init__(self, options: dict, get):
        self.options, self.get, self.pushed = options, get, []

    def pushFilters(self, filters):
        for f in filters:
            said = parameter(f)
            if said is None:
                yield f
            else:
                self.pushed.append(said)
                if isinstance(f, IsNotNull):  # costs nothing to look at again
                    yield f

    def partitions(self):
        by = self.options.get("by")
        if by and by not in _INTEGERS:
            raise InputError(f"parts go by one of {', '.join(sorted(_INTEGERS))}")
        parts = [f"{FILTERED[by]}:{v}" for v in range(int(self.options["from"]), int(self.options["to"]) + 1)] if by else [None]
        fixed = [x for x in (self.options.get("filter"),) if x]
        query = lambda part: ",".join([*fixed, *self.pushed, *([part] if part else [])])
        return [Range(f"{self.options['url']}?{urllib.parse.urlencode({'filter': q})}" if (q := query(p)) else self.options["url"]) for p in parts]

    def read(self, part: Range):
        for r in cursor_pages(part.url, self.get, empty=True):
            source, topic = ((r.get("primary_location") or {}).get("source") or {}).get("id"), (r.get("primary_topic") or {}).get("id")
            yield (r["id"], r.get("type"), r.get("publication_year"), r.get("cited_by_count"), r.get("language"), topic, source, json.dumps(r, ensure_ascii=False))


class GroupsReader(DataSourceReader):
    """Counts by the API's own group-by, one task a request."""

    def __init__(self, requests: list[str], get):
        self.requests, self.get = requests, get

    def partitions(self):
        return [Range(url) for url in self.requests]

    def read(self, part: Range):
        for g in self.get(part.url)["group_by"]:
            yield (g["key"], g["key_display_name"], g["count"])


GROUPS = "key string, key_display_name string, count bigint"


def _source(label: str, columns: str, reader) -> type[DataSource]:
    """A data source of the name ``label``; ``reader`` makes a reader from its options."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return columns

        def reader(self, schema):
            return reader(dict(self.options))

    return Source


def works(spark: SparkSession, url: str, get=get_json, **options) -> DataFrame:
    """Works of the API as a table: filters on the columns of ``FILTERED`` go into its
    requests, all others stay with Spark. Options: filter (the API's own words); by, from
    and to, for parts by publication_year or cited_by_count."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source("works_api", WORKS, lambda o: WorksReader(o, get)))
    return spark.read.format("works_api").options(url=url, **options).load()


def grouped(spark: SparkSession, url: str, filter_: str, key: str, get=get_json) -> DataFrame:
    """The API's own group-by as a table: at most PAGE rows of key, its name, count. The
    request is made by a task when the table is read."""
    request = f"{url}?{urllib.parse.urlencode({'filter': filter_, 'group_by': key, 'per-page': PAGE})}"
    spark.dataSource.register(_source("groups_api", GROUPS, lambda o: GroupsReader([o["request"]], get)))
    return spark.read.format("groups_api").option("request", request).load()
