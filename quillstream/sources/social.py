"""Landed pages of social posts as a Spark data source, batch and stream, and posts as items.

A page is a line of JSON, {"posts": [{"id", "text", "created_at", "lang"}], "next": n},
in the files of <path>/username=<name>/page=<n>/. Page 0 is a name's newest one and
``next`` numbers the page of older posts, as a timeline is paged; landing jobs that
only append number on. Each name is one partition, so one bad name costs none but
itself: what goes wrong is a row with ``error`` and without a post.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from ..functions import fixed
from ..operators.reports import post_id, usernames
from .items import age_minutes

POSTS = "username string, page long, place int, post_id string, text string, created_at timestamp, lang string, error string"


class _Name(InputPartition):
    def __init__(self, name: str, first: int = 0, last: int | None = None):
        self.name, self.first, self.last = name, first, last


class _Folder:
    """What is landed below a path, by Arrow's file systems."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs = fs
        self.system, self.path = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")

    def _numbered(self, path: str, key: str) -> list[str]:
        found = self.system.get_file_info(self.fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name.removeprefix(key) for f in found if f.type == self.fs.FileType.Directory and f.base_name.startswith(key))

    def names(self) -> list[str]:
        return self._numbered(self.path, "username=")

    def last_page(self, name: str) -> int:
        return max((int(n) for n in self._numbered(f"{self.path}/username={name}", "page=") if n.isdigit()), default=-1)

    def page(self, name: str, number: int) -> dict:
        folder = f"{self.path}/username={name}/page={number}"
        files = sorted(f.path for f in self.system.get_file_info(self.fs.FileSelector(folder)) if f.is_file and f.base_name[0] not in "._")
        posts, follows = [], None
        for path in files:
            with self.system.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    own = json.loads(line)
                    posts += own.get("posts") or []
                    follows = own.get("next", follows)
        return {"posts": posts, "next": follows}


def _time(value: object):
    """A time with a zone (UTC where none is given), or None."""
    from datetime import UTC, datetime

    try:
        out = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return out if out.tzinfo else out.replace(tzinfo=UTC)


def _rows(name: str, number: int, page: dict) -> Iterator[tuple]:
    for place, p in enumerate(page["posts"]):
        yield (name, number, place, None if p.get("id") is None else str(p["id"]).strip(), p.get("text"), _time(p.get("created_at")), p.get("lang"), None)


class _Timelines(DataSourceReader):
    """Follows each name's pages from the newest on, until one reaches back behind ``since`` or none follows."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most_pages", fixed.SOCIAL_PAGES))
        self.since = _time(options["since"]) if options.get("since") else None
        self.names = [n for n in options.get("names", "").split(",") if n] or None

    def partitions(self) -> list[InputPartition]:
        return [_Name(n) for n in (_Folder(self.path).names() if self.names is None else self.names)]

    def read(self, partition: _Name) -> Iterator[tuple]:
        folder, number, seen = _Folder(self.path), 0, set()
        try:
            while number is not None and number not in seen and len(seen) < self.most:
                seen.add(number)
                page = folder.page(partition.name, number)
                rows = list(_rows(partition.name, number, page))
                yield from rows
                oldest = min((r[5] for r in rows if r[5] is not None), default=None)
                if self.since is not None and oldest is not None and oldest < self.since:
                    return
                number = page["next"]
        except Exception as e:  # noqa: BLE001  one name's failure is a row of its own
            yield (partition.name, number, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


class _PushedTimelines(_Timelines):
    """Takes a lower bound of created_at from the query; Spark still tests each row."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("created_at",):
                bound = f.value if getattr(f.value, "tzinfo", None) else _time(f.value)
                self.since = bound if self.since is None else max(self.since, bound)
            yield f


class _Arrivals(DataSourceStreamReader):
    """New pages of each name, in the order of their numbers; an offset says how many of each name are done."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        folder = _Folder(self.path)
        return {n: folder.last_page(n) + 1 for n in folder.names()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Name(n, start.get(n, 0), last) for n, last in end.items() if last > start.get(n, 0)]

    def read(self, partition: _Name) -> Iterator[tuple]:
        folder = _Folder(self.path)
        for number in range(partition.first, partition.last):
            try:
                yield from _rows(partition.name, number, folder.page(partition.name, number))
            except Exception as e:  # noqa: BLE001
                yield (partition.name, number, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


class SocialPages(DataSource):
    """spark.read.format("social_pages"): options path, names (comma-separated; all that are landed), since (time), most_pages, push."""

    @classmethod
    def name(cls) -> str:
        return "social_pages"

    def schema(self) -> str:
        return POSTS

    def reader(self, schema) -> DataSourceReader:
        return (_PushedTimelines if self.options.get("push") == "true" else _Timelines)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Arrivals(dict(self.options))


def read_posts(spark: SparkSession, path: str, names: str | None = None, since: str | None = None, allowed: str = "") -> DataFrame:
    """Posts of the given names (a comma-separated list of handles, those allowed if any are), back to ``since``.

    Where Spark pushes filters into Python sources, a bound on created_at does the
    same as ``since``.
    """
    spark.dataSource.register(SocialPages)
    own = None if names is None else spark.range(1).select(usernames(F.lit(names)), usernames(F.lit(allowed))).first()
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("social_pages").option("path", path).option("push", push)
    if own is not None:
        chosen = [n for n in own[0] if not own[1] or n in own[1]]
        if not chosen:
            return spark.createDataFrame([], POSTS)
        reader = reader.option("names", ",".join(chosen))
    return (reader.option("since", since) if since else reader).load()


def stream_posts(spark: SparkSession, path: str) -> DataFrame:
    """All pages as they arrive."""
    spark.dataSource.register(SocialPages)
    return spark.readStream.format("social_pages").option("path", path).load()


def land_pages(posts: DataFrame, path: str, per_page: int = 100) -> None:
    """Writes posts (username, post_id, text, created_at, lang) as pages, each name's newest first."""
    from pyspark.sql import Window

    newest = Window.partitionBy("username").orderBy(F.col("created_at").desc(), "post_id")
    rows = posts.withColumn("n", F.row_number().over(newest) - 1).withColumn("page", F.expr(f"n div {int(per_page)}"))
    post = F.struct(F.col("post_id").alias("id"), "text", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "lang")
    pages = rows.groupBy("username", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", post.alias("p")))), lambda x: x["p"]).alias("posts"))  # per_page rows each
    last = rows.groupBy("username").agg(F.max("page").alias("last"))
    pages = pages.join(last, "username").withColumn("next", F.when(F.col("page") < F.col("last"), F.col("page") + 1))
    pages.select("username", "page", F.to_json(F.struct("posts", "next")).alias("value")).write.partitionBy("username", "page").text(path)


def posts_as_items(posts: DataFrame, as_of: Column, weight: float = fixed.SOCIAL_WEIGHT) -> DataFrame:
    """Posts as items, each id once (the first in the order of pages); rows with neither id nor text, and errors, give none."""
    from pyspark.sql import Window

    text, own = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("post_id", F.lit("")))
    headline = F.when(text != "", text).otherwise("(untitled)")
    rows = posts.filter(F.col("error").isNull() & ((text != "") | (own != ""))).select(
        post_id(F.col("username"), F.when(own != "", own).otherwise(headline)).alias("source_id"), F.concat(F.lit("x:"), "username").alias("feed_id"), F.concat(F.lit("@"), "username").alias("outlet"),
        F.lit("social").alias("kind"), F.lit(float(weight)).alias("weight"), F.concat(F.lit("https://x.com/"), "username", F.lit("/status/"), own).alias("url"),
        age_minutes(F.col("created_at"), as_of).alias("minutes_ago"), headline.alias("headline"), F.array(headline).alias("body"), F.when(F.trim("lang") != "", F.trim("lang")).alias("lang"), "page", "place",
    )
    first = Window.partitionBy("source_id").orderBy("page", "place")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "page", "place")


def page_report(posts: DataFrame) -> DataFrame:
    """(username, n_posts, oldest, error): of each name how many posts came, the oldest one's time, and what went wrong, if anything."""
    return posts.groupBy("username").agg(F.count_if(F.col("error").isNull()).alias("n_posts"), F.min("created_at").alias("oldest"), F.min("error").alias("error"))


def missing_names(selected: DataFrame, cached: DataFrame) -> DataFrame:
    """The selected handles (column handle) of which no cached item (column outlet) is there, as usernames."""
    own = selected.select(F.explode(usernames(F.col("handle"))).alias("username")).distinct()
    have = cached.select(F.explode(usernames(F.col("outlet"))).alias("username"))
    return own.join(have, "username", "left_anti")
