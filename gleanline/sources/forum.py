"""A listing connector as a Python data source: ``spark.read.format("forum")``.

One partition per request of the (community, query) grid, so that requests run in
parallel. Fetching is a function from path and parameters to parsed JSON; the default one
retries over HTTP, another one can be named as ``module:function`` (tests, archives).
"""

from __future__ import annotations

import base64
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, TIMEOUT_S, BASE_DELAY_S = 3, 15, 1.0
POST_SCHEMA = "kind string, name string, subreddit string, title string, selftext string, author string, author_fullname string, url string, permalink string, score int, num_comments int, created_utc double"
COMMENT_SCHEMA = "kind string, name string, subreddit string, link_id string, body string, author string, author_fullname string, permalink string, score int, created_utc double"
RULE_SCHEMA = "subreddit string, ordinal int, short_name string, description string"


class FetchError(Exception):
    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after

    @property
    def rate_limited(self) -> bool:
        return self.status == 429


def http_get(url: str, token: str | None = None) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After")
        raise FetchError(str(e), e.code, float(after) if after and after.isdigit() else None) from e
    except OSError as e:
        raise FetchError(str(e)) from e


class Tokens:
    """An access token, asked for when there is none and again shortly before it ends."""

    BUFFER_S = 60.0

    def __init__(self, ask: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.time):
        self.ask, self.clock, self.token, self.until = ask, clock, None, 0.0

    def get(self, refresh: bool = False) -> str:
        if refresh or self.token is None or self.until <= self.clock():
            self.token, lives = self.ask()
            self.until = self.clock() + lives - self.BUFFER_S
        return self.token


def client_token(url: str, client: str, secret: str) -> tuple[str, float]:
    """A token and its seconds to live for client credentials."""
    if not (client and secret):
        raise FetchError("missing api credentials")
    basic = base64.b64encode(f"{client}:{secret}".encode()).decode()
    request = urllib.request.Request(url, data=b"grant_type=client_credentials", headers={"Authorization": f"Basic {basic}"})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            found = json.load(answer)
    except urllib.error.HTTPError as e:
        raise FetchError(f"authentication failed with status {e.code}", e.code) from e
    except OSError as e:
        raise FetchError("the authentication endpoint can't be reached") from e
    return found["access_token"], float(found["expires_in"])


def authorized(get: Callable[[str], dict], tokens: Tokens) -> dict:
    """What ``get`` returns for a token; one that is refused is renewed once."""
    try:
        return get(tokens.get())
    except FetchError as e:
        if e.status != 401:
            raise
        return get(tokens.get(refresh=True))


def with_retry(get: Callable[[], dict], sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> dict:
    """Tries again after any failure, waiting what the server asks for or one second more each time."""
    for attempt in range(1, attempts + 1):
        try:
            return get()
        except FetchError as e:
            if attempt == attempts:
                raise
            sleep(e.retry_after if e.retry_after is not None else BASE_DELAY_S * attempt)
    raise AssertionError("unreachable")


def drain(terms: list[str], fetch: Callable[[str], list], sleep: Callable[[float], None], size: int = 5, passes: int = 5, base: float = 2.0) -> tuple[list, list[str]]:
    """Results of all terms in batches; rate-limited terms go to the tail, with growing pauses.

    Gives up after ``passes`` batches in a row in which every term was limited, and then
    returns the terms that are left.
    """
    queue, results, limited_in_row = list(terms), [], 0
    while queue:
        batch, queue = queue[:size], queue[size:]
        again = []
        for term in batch:
            try:
                results += fetch(term)
            except FetchError as e:
                if not e.rate_limited:
                    raise
                again.append(term)
        queue += again
        limited_in_row = limited_in_row + 1 if len(again) == len(batch) else 0
        if limited_in_row >= passes:
            return results, queue
        if again:
            sleep(base * max(limited_in_row, 1))
    return results, []


class Request(InputPartition):
    def __init__(self, kind: str, community: str, value: str, limit: int):
        self.kind, self.community, self.value, self.limit = kind, community, value, limit


class ForumReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Request]:
        kind, limit = self.options.get("kind", "posts"), min(max(int(self.options.get("limit", 25)), 1), 100)
        return [Request(kind, r["subreddit"], r.get("value", ""), limit) for r in json.loads(self.options["requests"])]

    def fetcher(self) -> Callable[[str, dict], dict]:
        if "fetch" in self.options:
            module, name = self.options["fetch"].split(":")
            return getattr(importlib.import_module(module), name)
        base, token = self.options["base"].rstrip("/"), self.options.get("token")
        url = lambda path, parameters: f"{base}{path}?{urllib.parse.urlencode(parameters)}"
        if "token_url" in self.options:
            tokens = Tokens(lambda: client_token(self.options["token_url"], self.options.get("client", ""), self.options.get("secret", "")))
            return lambda path, parameters: with_retry(lambda: authorized(lambda t: http_get(url(path, parameters), t), tokens))
        return lambda path, parameters: with_retry(lambda: http_get(url(path, parameters), token))

    def read(self, partition: Request) -> Iterator[tuple]:
        fetch, community = self.fetcher(), urllib.parse.quote(partition.community, safe="")
        if partition.kind == "rules":
            for i, rule in enumerate(fetch(f"/r/{community}/about/rules", {}).get("rules") or []):
                yield (partition.community, i, rule.get("short_name"), rule.get("description"))
            return
        if partition.kind == "comments":
            answer = fetch(f"/r/{community}/comments/{partition.value.removeprefix('t3_')}", {"limit": partition.limit, "depth": 1})
            listing = answer[1] if isinstance(answer, list) and len(answer) > 1 else {}
            wanted, fields = "t1", [f.split()[0] for f in COMMENT_SCHEMA.split(", ")[1:]]
        else:
            listing = fetch(f"/r/{community}/search", {"q": partition.value, "restrict_sr": 1, "sort": "new", "type": "link", "limit": partition.limit})
            wanted, fields = "t3", [f.split()[0] for f in POST_SCHEMA.split(", ")[1:]]
        for child in (listing.get("data") or {}).get("children") or []:
            if child.get("kind") == wanted:
                yield (wanted, *[child["data"].get(f) for f in fields])


class ForumSource(DataSource):
    """Options: ``kind`` (posts, comments, rules), ``requests`` (JSON list of {subreddit, value}), ``limit``, and ``base`` with ``token``, or with ``token_url``, ``client`` and ``secret``, or ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "forum"

    def schema(self) -> str:
        return {"comments": COMMENT_SCHEMA, "rules": RULE_SCHEMA}.get(self.options.get("kind", "posts"), POST_SCHEMA)

    def reader(self, schema) -> ForumReader:
        return ForumReader(self.options)
