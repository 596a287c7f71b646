"""Change feeds: pages of JSON changes, as a batch, as a stream of files, or as a streaming source of pages."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .. import schema

#: The fields that are asked for; nothing else is read.
FIELDS = ("id", "internetMessageId", "conversationId", "subject", "from", "toRecipients", "ccRecipients", "receivedDateTime", "hasAttachments", "webLink", "body")
# What a server is asked for, and the answers after which it is asked again.
PREFER = 'outlook.body-content-type="text"'
RETRIED = (429, 503, 504)
RETRIES = 6

_PERSON = "struct<emailAddress:struct<name:string,address:string>>"
#: Recipients and flags are read as text first: a value of another type must not spoil the row.
ITEM = f"seq long, folder string, id string, `@removed` string, internetMessageId string, conversationId string, subject string, `from` {_PERSON}, toRecipients string, ccRecipients string, receivedDateTime string, hasAttachments string, webLink string, body struct<content:string>"


def parsed(items: DataFrame, folder: str | None = None) -> DataFrame:
    """Changes (``schema.CHANGE``) of raw items (``ITEM``)."""

    def people(name: str):
        every = F.coalesce(F.from_json(name, f"array<{_PERSON}>"), F.array().cast(f"array<{_PERSON}>"))
        known = F.filter(every, lambda p: p["emailAddress"]["address"].isNotNull())
        return F.transform(known, lambda p: F.struct(p["emailAddress"]["name"].alias("name"), p["emailAddress"]["address"].alias("address")))

    where = F.lit(folder) if folder else F.col("folder")
    sender = F.col("from.emailAddress")
    message = F.struct(
        F.col("id"), F.col("internetMessageId").alias("internet_message_id"), F.col("conversationId").alias("conversation_id"), where.alias("folder"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.when(sender["address"].isNotNull(), F.struct(sender["name"].alias("name"), sender["address"].alias("address"))).alias("sender"),
        people("toRecipients").alias("to"), people("ccRecipients").alias("cc"),
        F.expr("try_to_timestamp(receivedDateTime)").alias("received"), F.coalesce(F.col("hasAttachments") == "true", F.lit(False)).alias("has_attachments"),
        F.col("webLink").alias("web_link"), F.coalesce("body.content", F.lit("")).alias("body"),
    )
    change = F.when(F.col("`@removed`").isNull(), message)
    return items.select("seq", "id", where.alias("folder"), change.cast(schema.MESSAGE).alias("message"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Changes of JSON-lines files."""
    return parsed(spark.read.schema(ITEM).json(path))


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream of the files that arrive."""
    return parsed(spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_trigger).json(path))


class FeedError(RuntimeError):
    pass


class Cancelled(RuntimeError):
    """Somebody asked for the work to stop."""


def waited(seconds: float, stop: threading.Event | None = None) -> None:
    """Wait, but not beyond a request to stop."""
    if stop is None:
        time.sleep(seconds)
    elif stop.wait(seconds):
        raise Cancelled("the feed was stopped")


def get_json(fetch: Callable[[str, dict], tuple[int, dict, str]], url: str, headers: dict | None = None, sleep: Callable[[float], None] | None = None, stop: threading.Event | None = None) -> dict:
    """Fetch a page; throttling and outages are waited out, as long as the server says or ever longer."""
    sleep = sleep or (lambda seconds: waited(seconds, stop))
    for attempt in range(RETRIES + 1):
        if stop is not None and stop.is_set():
            raise Cancelled("the feed was stopped")
        status, answered, text = fetch(url, headers or {})
        if status not in RETRIED or attempt == RETRIES:
            break
        sleep(float(answered.get("Retry-After") or 2 ** (attempt + 1)))
    if status != 200:
        raise FeedError(f"HTTP {status}")
    return json.loads(text)


def http_fetch(url: str, headers: dict) -> tuple[int, dict, str]:
    """Status, headers and text of a page of a server."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=120) as answer:
            return answer.status, dict(answer.headers), answer.read().decode()
    except urllib.error.HTTPError as e:
        with e:
            return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


class HttpPages:
    """Pages of a server by their addresses, which are also the tokens to go on from."""

    def __init__(self, token: Callable[[], str] | None = None, page_size: int = 100, fetch: Callable[[str, dict], tuple[int, dict, str]] = http_fetch, stop: threading.Event | None = None):
        self._token, self._page_size, self._fetch, self._stop = token, page_size, fetch, stop

    def __call__(self, url: str) -> dict:
        headers = {"Prefer": f"{PREFER}, odata.maxpagesize={self._page_size}"}
        if self._token is not None:
            headers["Authorization"] = f"Bearer {self._token()}"
        return get_json(self._fetch, url, headers, stop=self._stop)


def start_url(base: str, folder: str) -> str:
    """Where a folder's feed starts."""
    return f"{base.rstrip('/')}/mailFolders/{urllib.parse.quote(folder, safe='')}/messages/delta?$select={','.join(FIELDS)}"


def fetched(spark: SparkSession, get: Callable[[str], dict], folder: str, start: str, state: str | None = None, most: int = 0, seq: int = 0) -> Iterator[tuple[DataFrame, str | None]]:
    """Changes of a folder, page by page, each with the token to go on from; a page is what a server gives at once."""
    for items, following, _ in pages(get, start, state, most):
        rows = [(seq + i, folder, json.dumps(x)) for i, x in enumerate(items)]
        seq += len(rows)
        yield of_items(spark.createDataFrame(rows, "seq long, folder string, item string")), following


def pages(get: Callable[[str], dict], start: str, state: str | None = None, most: int = 0) -> Iterator[tuple[list[dict], str | None, bool]]:
    """Pages of a feed: items, the token to go on from, and whether the feed is drained for now.

    ``most`` limits an initial run, and is looked at only after whole pages; a run that it ends keeps its last token.
    """
    url, count = state or start, 0
    while url:
        page = get(url)
        items = page.get("value", [])
        count += len(items)
        following, final = page.get("@odata.nextLink"), page.get("@odata.deltaLink")
        capped = bool(most and state is None and count >= most)
        yield items, following or final, bool(final) or capped
        if final or capped:
            return
        url = following


class FeedReader(SimpleDataSourceStreamReader):
    """Streams pages; the offset is the token to go on from, so a restart repeats at most one page.

    With the option ``url``, pages are a server's, and tokens their addresses (options ``token`` for sign-in, ``pageSize``
    and ``folder``); with ``path``, they are files named by token in a folder that the driver sees, where pages are read.
    """

    def __init__(self, options: dict):
        self.url, self.folder = options.get("url"), options.get("folder")
        self.path = options.get("path", "").removeprefix("file://")
        self.start = options.get("start") or self.url or "start"
        token = options.get("token")
        self._pages = HttpPages((lambda: token) if token else None, int(options.get("pageSize", 100))) if self.url else None

    def get(self, token: str) -> dict:
        if self._pages is not None:
            return self._pages(token)
        with open(f"{self.path}/{token}.json", encoding="utf-8") as file:
            return json.load(file)

    def initialOffset(self) -> dict:
        return {"token": self.start, "seq": 0}

    def _page(self, offset: dict) -> tuple[list[tuple], dict]:
        try:
            page = self.get(offset["token"])
        except FileNotFoundError:  # not there yet
            return [], offset
        rows = [(offset["seq"] + i, self.folder or page.get("folder"), json.dumps(x)) for i, x in enumerate(page.get("value", []))]
        following = page.get("@odata.nextLink") or page.get("@odata.deltaLink")
        return rows, {"token": following or offset["token"], "seq": offset["seq"] + len(rows)} if following else offset

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._page(start)[0])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """``spark.readStream.format("message_feed")``: ``seq, folder, item`` with items as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "message_feed"

    def schema(self) -> str:
        return "seq long, folder string, item string"

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def of_items(rows: DataFrame) -> DataFrame:
    """Changes of ``seq, folder, item``."""
    kind = ITEM.replace("seq long, folder string, ", "")
    return parsed(rows.select("seq", "folder", F.from_json("item", kind).alias("x")).select("seq", "folder", "x.*"))
