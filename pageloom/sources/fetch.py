"""Fetching pages: only public hosts, bounded reads, every redirect checked again."""

from __future__ import annotations

import codecs
import ipaddress
import re
import socket
from collections.abc import Callable
from urllib.error import HTTPError, URLError
from urllib.parse import urlparse
from urllib.request import HTTPRedirectHandler, OpenerDirector, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import is_public
from pageloom.operators.dom import MAX_PAGE_BYTES

TIMEOUT = 20
ACCEPT = "text/html,application/xhtml+xml,*/*;q=0.8"
_DECLARED = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


class FetchError(ValueError):
    """The page can't or must not be read."""


def addresses(host: str, port: int) -> set[str]:
    """All addresses of a host."""
    return {r[4][0].split("%", 1)[0] for r in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)}


def require_public(url: str, resolve: Callable[[str, int], set[str]] = addresses) -> None:
    """Refuse addresses by the URL policy, and hosts of which any address is not global."""
    if not is_public(url):
        raise FetchError("URL must be a public HTTP(S) webpage.")
    parts = urlparse(url)
    host = parts.hostname or ""
    try:
        ipaddress.ip_address(host)
        return  # a global address, as the policy has seen
    except ValueError:
        pass
    try:
        found = resolve(host, parts.port or (443 if parts.scheme == "https" else 80))
    except OSError as error:
        raise FetchError("Could not resolve the public webpage host.") from error
    if not found or not all(ipaddress.ip_address(a).is_global for a in found):
        raise FetchError("Webpage host must resolve only to public IP addresses.")


class _Redirects(HTTPRedirectHandler):
    def __init__(self, resolve):
        self.resolve = resolve

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        require_public(newurl, self.resolve)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def read(url: str, limit: int, expected: str = "", resolve=addresses, opener: OpenerDirector | None = None) -> tuple[bytes, str, str]:
    """Body, content type and final address; at most ``limit`` bytes, the type must begin with ``expected``."""
    require_public(url, resolve)
    too_large = FetchError(f"Response is larger than the {limit // 1024 // 1024} MB limit.")
    try:
        with (opener or build_opener(_Redirects(resolve))).open(Request(url, headers={"Accept": ACCEPT}), timeout=TIMEOUT) as got:
            final, kind, declared = got.geturl(), got.headers.get_content_type(), got.headers.get("Content-Length")
            require_public(final, resolve)
            if declared and int(declared) > limit:
                raise too_large
            if not kind.startswith(expected):
                raise FetchError(f"Expected {expected} content, got {kind}.")
            body = got.read(limit + 1)
    except HTTPError as error:
        raise FetchError(f"Could not fetch article (HTTP {error.code}).") from error
    except URLError as error:
        raise FetchError(f"Could not fetch article: {error.reason}") from error
    if len(body) > limit:
        raise too_large
    return body, kind, final


def decoded(body: bytes) -> str:
    """Text by byte order mark, declared charset, UTF-8 or a one-byte code; what can't be decoded is replaced."""
    charset = next((name for mark, name in _MARKS if body.startswith(mark)), None)
    if charset is None and (found := _DECLARED.search(body[:4096])):
        charset = found[1].decode("ascii")
    for name in (charset, "utf-8"):
        try:
            return body.decode(name, errors="strict" if name != charset else "replace") if name else body.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("windows-1252", errors="replace")


_PAGE = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("html", pa.string()), ("error", pa.string())])


def fetch_pages(urls: DataFrame, url: str = "url", resolve=addresses, make_opener: Callable[[], OpenerDirector] | None = None) -> DataFrame:
    """``url, final_url, html, error``: one row per address. Addresses are dealt by host, so one task at a time talks to a host."""
    dealt = urls.select(F.col(url).alias("url")).repartition(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))

    def run(batches):
        opener = make_opener() if make_opener else None
        for batch in batches:
            out = []
            for address in batch.column("url").to_pylist():
                row = dict.fromkeys(_PAGE.names) | {"url": address}
                try:
                    body, _, final = read(address or "", MAX_PAGE_BYTES, "text/html", resolve, opener)
                    out.append(row | {"final_url": final, "html": decoded(body)})
                except (FetchError, OSError, ValueError) as error:
                    out.append(row | {"error": str(error)})
            yield pa.RecordBatch.from_pylist(out, _PAGE)

    return dealt.mapInArrow(run, "url string, final_url string, html string, error string")
