"""Remote feeds behind Spark's Python data source interface.

A feed is described by values (:class:`Feed`): where it lies, what is always asked, which options a user may set within
which bounds, where the items stand in an answer, and what a failure means. How a request travels is a transport, a
callable from :class:`Request` to :class:`Response`: :func:`http` opens a connection, :func:`recorded` answers from
recorded bodies, and option ``transport`` of the data source names any other by ``package.module:factory``. Addresses,
scopes and header names are the caller's configuration; none is built in.
"""

from __future__ import annotations

import importlib
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from base64 import b64encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition


@dataclass(frozen=True)
class Request:
    """What is asked: parameters go into the URL, a body as JSON if it is no string."""

    method: str
    url: str
    headers: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)
    body: dict | str | None = None
    timeout: float = 30.0


@dataclass(frozen=True)
class Response:
    """Status and body of an answer."""

    status: int
    text: str = ""


Transport = Callable[[Request], Response]


class FeedError(Exception):
    """A feed that could not be read; ``stage`` says where: ``connection``, ``token``, ``request`` or ``attempts``."""

    def __init__(self, stage: str, message: str) -> None:
        super().__init__(f"{stage}: {message}")
        self.stage = stage


def http(options: dict) -> Transport:
    """A transport that opens connections."""

    def send(request: Request) -> Response:
        url = request.url + ("?" + urllib.parse.urlencode(request.parameters) if request.parameters else "")
        body = request.body if request.body is None or isinstance(request.body, str) else json.dumps(request.body)
        asked = urllib.request.Request(url, None if body is None else body.encode(), request.headers, method=request.method)
        try:
            with urllib.request.urlopen(asked, timeout=request.timeout) as answer:
                return Response(answer.status, answer.read().decode())
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read().decode(errors="replace"))
        except OSError as e:
            raise FeedError("connection", str(e)) from e

    return send


def recorded(options: dict) -> Transport:
    """A transport over option ``recorded``: JSON of the end of a URL to ``{status, body}``; other URLs can't be reached."""
    answers = json.loads(options["recorded"])

    def send(request: Request) -> Response:
        for end, answer in answers.items():
            if request.url.endswith(end):
                return Response(answer["status"], json.dumps(answer["body"], ensure_ascii=False))
        raise FeedError("connection", request.url)

    return send


def recorded_folder(options: dict) -> Transport:
    """A transport over files: option ``answers`` is a folder of bodies named by the end of the URL, a hyphen and the page.

    A page is what option ``page_parameter`` names in the request; no file, no answer (status 404). Option ``asked`` is
    a folder in which every request leaves an empty file that begins with the page's name.
    """
    from pyarrow import fs

    def send(request: Request) -> Response:
        given = request.parameters or (request.body if isinstance(request.body, dict) else {})
        name = f"{request.url.rsplit('/', 1)[-1]}-{given.get(options.get('page_parameter', ''), '')}"
        if "asked" in options:
            system, root = fs.FileSystem.from_uri(options["asked"])
            system.create_dir(root, recursive=True)
            system.open_output_stream(f"{root}/{name}.{uuid.uuid4().hex}").close()
        system, root = fs.FileSystem.from_uri(options["answers"])
        try:
            with system.open_input_file(f"{root}/{name}.json") as f:
                return Response(200, f.read().decode())
        except FileNotFoundError:
            return Response(404, "{}")

    return send


def recorded_clock(options: dict) -> Callable[[], float]:
    """A clock that stands at the number in file ``clock_file``, to poll recorded answers as of any time."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(options["clock_file"])
    with system.open_input_file(path) as f:
        now = float(f.read())
    return lambda: now


def transport_named(name: str, options: dict) -> Transport:
    """The transport that ``package.module:factory`` makes of the options; the module is imported where it is used."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(options)


@dataclass(frozen=True)
class Grant:
    """A way to get an access token: where, for which scope, and whether the credential goes in a JSON body or by basic
    authentication beside a form. ``authorization`` is the header made of the token."""

    url: str
    scope: str
    as_json: bool = False
    authorization: str = "Bearer {token}"
    prefix: str = ""

    def request(self, credential: str, secret: str) -> Request:
        asked = {"grant_type": "client_credentials", "scope": self.scope}
        if self.as_json:
            return Request("POST", self.url, {"Content-Type": "application/json"}, body=asked | {"client_id": credential, "client_secret": secret})
        basic = b64encode(f"{credential}:{secret}".encode()).decode()
        return Request("POST", self.url, {"Content-Type": "application/x-www-form-urlencoded", "Authorization": f"Basic {basic}"}, body="&".join(f"{k}={v}" for k, v in asked.items()))


def grant_for(credential: str, grants: list[Grant]) -> Grant:
    """The grant whose prefix the credential begins with; the longest prefix wins."""
    return max((g for g in grants if credential.startswith(g.prefix)), key=lambda g: len(g.prefix))


@dataclass
class Access:
    """A token that is fetched when needed, kept until a minute before it ends, and forgotten on request."""

    transport: Transport
    grant: Grant
    credential: str
    secret: str
    clock: Callable[[], float] = time.time
    margin: float = 60.0
    life: float = 3600.0
    _held: tuple[str, float] | None = None

    def headers(self) -> dict:
        if self._held is None or self.clock() >= self._held[1] - self.margin:
            answer = self.transport(self.grant.request(self.credential, self.secret))
            if answer.status != 200:
                raise FeedError("token", f"status {answer.status} {answer.text}")
            told = json.loads(answer.text)
            self._held = told.get("access_token"), self.clock() + told.get("expires_in", self.life)
        return {"Authorization": self.grant.authorization.format(token=self._held[0])}

    def forget(self) -> None:
        self._held = None


@dataclass(frozen=True)
class Retry:
    """Attempts with waits that double up to a bound. Some statuses are answers, some end the token, all others and broken connections are tried again."""

    attempts: int = 5
    longest: float = 30.0
    answers: tuple[int, ...] = (200, 404)
    renewing: tuple[int, ...] = (401,)

    def send(self, transport: Transport, request: Request, access: Access | None = None, sleep: Callable[[float], None] = time.sleep) -> Response:
        why = "no attempt is allowed"
        for n in range(1, self.attempts + 1):
            if n > 1:
                sleep(min(2.0 ** (n - 1), self.longest))
            asked = replace(request, headers=request.headers | access.headers()) if access else request
            try:
                answer = transport(asked)
            except FeedError as e:
                why = str(e)
                continue
            if answer.status in self.answers:
                return answer
            if answer.status in self.renewing and access:
                access.forget()
            why = f"status {answer.status}"
        raise FeedError("request" if self.attempts > 0 else "attempts", why)


@dataclass(frozen=True)
class Option:
    """What a user may set: the parameter it becomes, its default, and the bounds of a number."""

    parameter: str
    default: object = ""
    low: int | None = None
    high: int | None = None

    def value(self, given: str | None) -> object:
        if self.low is None:
            return given or self.default
        try:
            return max(self.low, min(int(given), self.high)) if given not in (None, "") else self.default
        except ValueError:
            return self.default


@dataclass(frozen=True)
class Feed:
    """A feed by its values. ``items`` is the dotted place of the items in an answer; ``empty_on`` says which failures mean
    no items: ``none``, ``server`` (status 500 and up) or ``any``; feeds with ``retried`` are asked with retries, and their
    parameters go into a JSON body; ``lists`` are options that become lists, split at commas."""

    path: str
    items: str
    fixed: dict = field(default_factory=dict)
    options: dict[str, Option] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    empty_on: str = "none"
    retried: bool = False
    timeout: float = 15.0

    def parameters(self, options: dict) -> dict:
        """Fixed and chosen parameters; option ``suffix`` follows a keyword, option ``extra`` (JSON) adds any, such as keys of an application."""
        out = dict(self.fixed)
        for name, option in self.options.items():
            out[option.parameter] = option.value(options.get(name))
            if name == "keyword" and options.get("suffix"):
                out[option.parameter] = f"{out[option.parameter]} {options['suffix']}".strip()
        out |= {to: options[name].split(",") for name, to in self.lists.items() if options.get(name)}
        return out | json.loads(options.get("extra") or "{}")

    def found(self, answer: dict) -> dict:
        """The items under the last part of their place, whatever they stood in."""
        *outer, last = self.items.split(".")
        for part in outer:
            answer = answer.get(part) or {}
        return {last: answer.get(last) or []}

    def fetch(self, transport: Transport, options: dict, access: Access | None = None, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, whole: bool = False) -> dict:
        """The answer's items, or none where a failure means that; with ``whole`` all of the answer."""
        asked, url = self.parameters(options), options.get("base", "") + self.path
        try:
            if self.retried:
                headers = {"Content-Type": "application/json"} | json.loads(options.get("headers", "{}"))
                answer = json.loads(retry.send(transport, Request("POST", url, headers, body=asked, timeout=self.timeout), access, sleep).text)
                return answer if whole else self.found(answer)
            answer = transport(Request("GET", url, parameters=asked, timeout=self.timeout))
        except FeedError:
            if self.empty_on == "any":
                return self.found({})
            raise
        if answer.status == 200:
            return json.loads(answer.text)
        if self.empty_on == "any" or (self.empty_on == "server" and answer.status >= 500):
            return self.found({})
        raise FeedError("request", f"status {answer.status}")


#: The projections that the catalogue is asked for by default, for lookups and for searches.
LOOKUP_FIELDS = [
    "images.primary.small", "images.primary.large", "images.variants.medium", "itemInfo.title", "itemInfo.features", "itemInfo.productInfo", "itemInfo.byLineInfo", "itemInfo.technicalInfo",
    "offersV2.listings.price", "offersV2.listings.availability", "browseNodeInfo.browseNodes",
]
SEARCH_FIELDS = ["images.primary.small", "itemInfo.title", "itemInfo.features", "offersV2.listings.price", "browseNodeInfo.browseNodes"]

#: The feeds by logical name. Parameters and their defaults are fixed values; paths and anything else can be replaced by
#: option ``config``.
FEEDS = {
    "lookup_a": Feed("/getItems", "itemsResult.items", {"itemIdType": "ASIN", "resources": LOOKUP_FIELDS}, {"tag": Option("partnerTag"), "marketplace": Option("marketplace")}, {"ids": "itemIds", "resources": "resources"}, retried=True, timeout=30.0),
    "search_a": Feed(
        "/searchItems", "searchResult.items", {"resources": SEARCH_FIELDS},
        {"keyword": Option("keywords"), "index": Option("searchIndex", "All"), "results": Option("itemCount", 10, 1, 10), "tag": Option("partnerTag"), "marketplace": Option("marketplace")}, {"resources": "resources"}, retried=True, timeout=30.0,
    ),
    "search_b": Feed("/b/search", "Items", {"sort": "-updateTimestamp", "formatVersion": 2, "hits": 30, "genreId": "566382"}, {"keyword": Option("keyword")}),
    "ranking_b": Feed("/b/ranking", "Items", {"genreId": "566382"}, empty_on="any"),
    "hits_c": Feed("/c/search", "hits", {"in_stock": "true"}, {"keyword": Option("query"), "results": Option("results", 5, 1, 50), "sort": Option("sort", "-score"), "image_size": Option("image_size", 300, 76, 600)}),
    "books": Feed("/books", "items", {"maxResults": 3, "orderBy": "relevance"}, {"keyword": Option("q")}, empty_on="server"),
    "videos": Feed("/videos", "items", {"part": "snippet", "maxResults": 5, "type": "video"}, {"keyword": Option("q")}, empty_on="any"),
}


@dataclass(frozen=True)
class Paging:
    """How pages of an answer are asked for: the parameter, where the number of all results stands in an answer (dotted),
    results of a page, the first value, whether values count results or pages, and how many pages are asked for at most: all unless given."""

    parameter: str
    total: str
    size: int
    first: int = 1
    by_result: bool = True
    most: int | None = None

    @classmethod
    def of(cls, options: dict) -> Paging | None:
        """From options ``page_parameter``, ``page_total``, ``page_size``, ``page_first``, ``page_by`` (``result`` or ``page``) and ``page_most``."""
        if "page_parameter" not in options:
            return None
        return cls(options["page_parameter"], options.get("page_total", ""), int(options.get("page_size", "10")), int(options.get("page_first", "1")), options.get("page_by", "result") == "result", int(options["page_most"]) if options.get("page_most") else None)

    def asks(self, page: int) -> dict:
        """The option ``extra`` that asks for a page, counted from 0."""
        return {self.parameter: self.first + page * (self.size if self.by_result else 1)}

    def pages(self, answer: dict) -> int:
        """The number of pages that an answer tells of, one at least."""
        at = answer
        for part in self.total.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        told = -(-int(at or 0) // self.size)
        return max(1, told if self.most is None else min(self.most, told))


@dataclass
class Turns:
    """The instants at which one of ``of`` tasks may ask: each has every ``of``-th interval from ``start`` to itself.

    However late a task starts, it waits for its next own instant, so all tasks together keep the interval as long as their clocks agree.
    """

    start: float
    interval: float
    place: int
    of: int
    last: float = float("-inf")

    def wait(self, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        if self.interval <= 0:
            return
        first, period = self.start + self.place * self.interval, self.interval * self.of
        now = clock()
        turn = max(0, math.ceil((now - first) / period - 1e-9))
        if first + turn * period <= self.last:
            turn = round((self.last - first) / period) + 1
        self.last = first + turn * period
        if self.last > now:
            sleep(self.last - now)


class FeedSource(DataSource):
    """``spark.read.format("feed").option("feed", name)``: a feed's items as one JSON text for each request.

    Options: ``transport`` (a factory's name; the one over recorded answers unless given), ``base`` (what stands before the path), ``config``
    (JSON that replaces values of the feed), ``grants`` (JSON list of :class:`Grant` values) with ``credential`` and
    ``secret``, ``headers`` (JSON), and the feed's own. A filter ``keyword = …`` is pushed into the request. ``batch`` cuts
    a long list of ``ids`` into requests of so many, which are made by as many tasks. Without credentials (option
    ``credentials`` = ``none``) a feed is empty; ``mock`` = ``true`` gives one made-up item instead.

    With the options of :class:`Paging` the first page is asked for when the read is planned, and the pages it tells of are
    dealt to ``tasks`` tasks (4); ``interval`` is the least number of seconds between two requests of all of them.

    ``spark.readStream`` polls: a run begins every ``every`` seconds and asks for ``pages`` pages. Its offset is the run and
    the pages of it that are read, so a query that goes on from a checkpoint asks for none of them again; runs that
    passed meanwhile are over. Option ``clock`` names another clock, by ``package.module:factory`` of the options.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "feed STRING, keyword STRING, response STRING, page INT"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream({k.lower(): v for k, v in self.options.items()})


@dataclass
class Batch(InputPartition):
    """What a task asks for: ids by commas, or pages in turns; or a page's answer that is there already."""

    ids: str | None = None
    pages: tuple[int, ...] = ()
    turns: Turns | None = None
    answer: str | None = None


class FeedReader(DataSourceReader):
    """Requests made by the tasks that read them."""

    def __init__(self, options: dict) -> None:
        self.options, self.keyword = options, options.get("keyword")
        self.feed = replace(FEEDS[options["feed"]], **json.loads(options.get("config", "{}")))
        self.paging = Paging.of(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("keyword",):
                self.keyword = f.value
            else:
                yield f

    def clock(self) -> float:
        return transport_named(self.options["clock"], self.options)() if "clock" in self.options else time.time()

    def access(self, transport: Transport) -> Access | None:
        grants = [Grant(**g) for g in json.loads(self.options.get("grants", "[]"))]
        return Access(transport, grant_for(self.options["credential"], grants), self.options["credential"], self.options.get("secret", "")) if grants else None

    def transport(self) -> Transport:
        return transport_named(self.options.get("transport", f"{__name__}:recorded"), self.options)

    def ask(self, transport: Transport, access: Access | None, more: dict, page: int | None = None) -> dict:
        """The whole answer to one request."""
        options = self.options | ({"keyword": self.keyword} if self.keyword else {}) | more
        if page is not None:
            options["extra"] = json.dumps(json.loads(options.get("extra") or "{}") | self.paging.asks(page))
        return self.feed.fetch(transport, options, access, whole=True)

    def row(self, answer: dict, page: int | None = None) -> tuple:
        """A row of the data source; feeds that are asked with retries give their items only."""
        return self.options["feed"], self.keyword, json.dumps(self.feed.found(answer) if self.feed.retried else answer, ensure_ascii=False), page

    def partitions(self) -> list[InputPartition]:
        if self.paging is not None and self.options.get("credentials") != "none":
            transport = self.transport()
            first = self.ask(transport, self.access(transport), {}, 0)
            left = list(range(1, self.paging.pages(first)))
            of = max(1, min(int(self.options.get("tasks", "4")), len(left)))
            interval = float(self.options.get("interval", "0"))
            start = self.clock() + interval
            return [Batch(pages=(0,), answer=json.dumps(first))] + [Batch(pages=tuple(left[k::of]), turns=Turns(start, interval, k, of)) for k in range(of) if left]
        ids = [i for i in self.options.get("ids", "").split(",") if i]
        size = int(self.options.get("batch", "0")) or len(ids) or 1
        return [Batch(",".join(ids[k : k + size])) for k in range(0, len(ids), size)] or [Batch()]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if partition.answer is not None:
            yield self.row(json.loads(partition.answer), partition.pages[0])
        elif self.options.get("credentials") == "none":
            items = [{"title": "mock item", "name": "mock item"}] if self.options.get("mock") == "true" else []
            yield self.options["feed"], self.keyword, json.dumps({self.feed.items.split(".")[-1]: items}), None
        else:
            transport = self.transport()
            access = self.access(transport)
            for page in partition.pages:
                partition.turns.wait()
                yield self.row(self.ask(transport, access, {}, page), page)
            if not partition.pages:
                yield self.row(self.ask(transport, access, {"ids": partition.ids} if partition.ids else {}))


class FeedStream(DataSourceStreamReader):
    """Polls a feed page by page; what is asked for follows from the clock and the offset alone."""

    def __init__(self, options: dict) -> None:
        self.reader = FeedReader(options)
        self.every, self.count = float(options.get("every", "3600")), int(options.get("pages", "1"))

    def initialOffset(self) -> dict:
        return {"run": int(self.reader.clock() // self.every), "page": 0}

    def latestOffset(self) -> dict:
        return {"run": int(self.reader.clock() // self.every), "page": self.count}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first = start["page"] if start["run"] == end["run"] else 0
        return [Batch(pages=(page,), turns=Turns(0.0, 0.0, 0, 1)) for page in range(first, end["page"])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        return self.reader.read(partition)


def register(spark: SparkSession) -> None:
    """Make ``format("feed")`` known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
