"""Recorded responses of article and forum services as Spark data sources, and live ones through a client.

``spark.read.format("quillmark_replay")`` reads recorded responses (JSON lines of kind, key and body) of one kind, file
by file.  A line that can't be read becomes a row with an error, so one bad response never ends a job.
"""

from __future__ import annotations

import io
import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds between requests, categories of an article and hits of a search at most, prefix of a category.
INTERVAL, MOST_CATEGORIES, MOST_HITS, PREFIX = 0.1, 20, 5, "Category:"
AGENT = "quillmark/1.0"
RECORD = "kind string, key string, body string, error string"
SCHEMAS = {
    "search": "array<struct<title:string,snippet:string,pageid:bigint,wordcount:bigint>>",
    "summary": "string",
    "html": "string",
    "categories": "array<string>",
    "threads": "array<struct<title:string,selftext:string,permalink:string,score:bigint,num_comments:bigint,created_utc:double,removed_by:string,flair:string,comments:array<struct<body:string,score:bigint,author:string,created_utc:double,parent_id:string,awards:bigint>>>>",
}


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.kind = options["path"], options.get("kind")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else "file://" + os.path.abspath(self.uri))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = self._open()
        if store.get_file_info(at).type == fs.FileType.File:
            return [_File(at)]
        files = store.get_file_info(fs.FileSelector(at))
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        store, _ = self._open()
        with store.open_input_stream(partition.path) as f:
            for n, line in enumerate(io.TextIOWrapper(f, encoding="utf-8", errors="replace")):
                if line.strip():
                    row = _record(line, f"{os.path.basename(partition.path)}:{n + 1}")
                    if self.kind is None or row[0] in (None, self.kind):
                        yield row


def _record(line: str, place: str) -> tuple[str | None, str | None, str | None, str | None]:
    try:
        r = json.loads(line)
        return r["kind"], r["key"], json.dumps(r["body"], ensure_ascii=False), None
    except (ValueError, KeyError, TypeError) as e:
        return None, None, None, f"{place}: {type(e).__name__}: {e}"


class ReplaySource(DataSource):
    """Options: path (a JSON lines file, or a folder of them, that every executor reaches) and kind."""

    @classmethod
    def name(cls) -> str:
        return "quillmark_replay"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def replayed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """key, value, error of the recorded responses of one kind, typed by ``SCHEMAS``."""
    spark.dataSource.register(ReplaySource)
    rows = spark.read.format("quillmark_replay").option("kind", kind).load(path)
    value = F.from_json(F.concat(F.lit('{"v":'), "body", F.lit("}")), f"struct<v:{SCHEMAS[kind]}>")["v"]
    return rows.select("key", value.alias("value"), "error")


def search_hits(found: DataFrame) -> DataFrame:
    """search, hit_idx, title, snippet (HTML), pageid and wordcount from replayed searches (key, value)."""
    return found.where("error is null").select(F.col("key").alias("search"), F.posexplode("value").alias("hit_idx", "h")).select("search", "hit_idx", "h.title", "h.snippet", "h.pageid", F.coalesce("h.wordcount", F.lit(0)).alias("wordcount"))


def category_names(categories: Column) -> Column:
    """Names without their prefix, at most 20."""
    return F.transform(F.slice(categories, 1, MOST_CATEGORIES), lambda c: F.replace(c, F.lit(PREFIX), F.lit("")))


class Limiter:
    """Waits until ``interval`` seconds have gone by since the last request, and counts them."""

    def __init__(self, interval: float = INTERVAL, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.last, self.count = float("-inf"), 0

    def wait(self) -> None:
        rest = self.interval - (self.clock() - self.last)
        if rest > 0:
            self.sleep(rest)
        self.last = self.clock()
        self.count += 1


def _get(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    with urlopen(Request(url, headers=headers), timeout=30) as r:  # noqa: S310
        return r.status, r.read()


class ArticleClient:
    """Requests of an article service (``api``: its query endpoint, ``rest``: that of summaries), one limiter for all."""

    def __init__(self, api: str, rest: str, limiter: Limiter | None = None, get: Callable[[str, dict[str, str]], tuple[int, bytes]] = _get):
        self.api, self.rest, self.limiter, self.get = api, rest, limiter or Limiter(), get

    def _json(self, **params) -> dict:
        self.limiter.wait()
        status, body = self.get(f"{self.api}?{urlencode({**params, 'format': 'json'})}", {"User-Agent": AGENT})
        if status >= 400:
            raise OSError(f"status {status}")
        return json.loads(body)

    def search(self, query: str, most: int = MOST_HITS) -> list[dict]:
        found = self._json(action="query", list="search", srsearch=query, srlimit=most, srprop="snippet|titlesnippet|wordcount")
        return [{"title": x["title"], "snippet": x["snippet"], "pageid": x["pageid"], "wordcount": x.get("wordcount", 0)} for x in found.get("query", {}).get("search", [])]

    def summary(self, title: str) -> str:
        """The summary, empty where there is none."""
        self.limiter.wait()
        status, body = self.get(self.rest + quote(title), {"User-Agent": AGENT})
        return json.loads(body).get("extract", "") if status == 200 else ""

    def html(self, title: str) -> str:
        return self._json(action="parse", page=title, prop="text", disabletoc=True)["parse"]["text"]["*"]

    def categories(self, title: str) -> list[str]:
        pages = self._json(action="query", titles=title, prop="categories", cllimit=MOST_CATEGORIES, clshow="!hidden").get("query", {}).get("pages", {})
        return [c["title"] for p in pages.values() for c in p.get("categories", [])]


class ForumClient:
    """Read-only searches of a forum service, with credentials from the environment variables that are named."""

    def __init__(self, api: str, id_variable: str, secret_variable: str, limiter: Limiter | None = None, get: Callable[[str, dict[str, str]], tuple[int, bytes]] = _get):
        self.api, self.limiter, self.get = api, limiter or Limiter(), get
        self.credentials = (os.environ.get(id_variable), os.environ.get(secret_variable))

    def search(self, query: str, forum: str, most: int = 5, sort: str = "relevance", time_filter: str = "all") -> list[dict]:
        self.limiter.wait()
        params = urlencode({"q": query, "sort": sort, "t": time_filter, "limit": most, "restrict_sr": 1})
        status, body = self.get(f"{self.api}/r/{quote(forum)}/search?{params}", {"User-Agent": AGENT})
        if status >= 400:
            raise OSError(f"status {status} for {forum}")
        return json.loads(body)


def fetched(keys: DataFrame, connect: Callable[[], Callable[[str], object]]) -> DataFrame:
    """kind-less records (key, body, error) of ``keys`` (key): ``connect`` makes a request function in each task.

    A request that fails gives a row with its error; the others go on.  Repartition ``keys`` to the number of clients that
    the service allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = connect()
        for b in batches:
            out = []
            for key in b.column(0).to_pylist():
                try:
                    out.append((key, json.dumps(request(key), ensure_ascii=False), None))
                except Exception as e:  # one key's failure is that row's error
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["key", "body", "error"])

    return keys.select(F.col("key").cast("string")).mapInArrow(run, "key string, body string, error string")


def articles(summaries: DataFrame, pages: DataFrame, categories: DataFrame, base: str) -> DataFrame:
    """title, url, summary, html and categories from replayed responses of each kind (key, value), by title."""
    from ..functions.text import quoted

    a = pages.where("error is null").select(F.col("key").alias("title"), F.col("value").alias("html"))
    a = a.join(summaries.where("error is null").select(F.col("key").alias("title"), F.col("value").alias("summary")), "title", "left")
    a = a.join(categories.where("error is null").select(F.col("key").alias("title"), category_names(F.col("value")).alias("categories")), "title", "left")
    return a.select("title", F.concat(F.lit(base), quoted(F.col("title"))).alias("url"), F.coalesce("summary", F.lit("")).alias("summary"), "html", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def threads(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts and comments, as retrieval takes them, from replayed thread searches (key "query_id|forum")."""
    rows = found.where("error is null").select(F.split("key", r"\|")[0].cast("long").alias("query_id"), F.split("key", r"\|")[1].alias("forum"), F.posexplode("value").alias("hit_idx", "t"))
    rows = rows.withColumn("thread_id", F.col("t.permalink"))
    posts = rows.select("query_id", "thread_id", "forum", "hit_idx", F.col("t.permalink").alias("url"), "t.title", "t.score", "t.num_comments", "t.selftext", "t.removed_by")
    said = rows.dropDuplicates(["thread_id"]).select("thread_id", F.posexplode("t.comments").alias("slot", "c")).select("thread_id", "slot", "c.body", "c.score", F.coalesce("c.awards", F.lit(0)).alias("awards"), "c.parent_id")
    return posts, said
