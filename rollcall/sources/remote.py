"""Records behind HTTP: profile APIs and portfolio pages, fetched through a transport that is given."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (method, url, headers, body, timeout) -> (status, text); raises OSError if nothing answers.
Transport = Callable[[str, str, dict[str, str], str | None, float], tuple[int, str]]


def http(method: str, url: str, headers: dict[str, str], body: str | None, timeout: float) -> tuple[int, str]:
    request = urllib.request.Request(url, body.encode() if body else None, headers, method=method)  # noqa: S310
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def _json(transport: Transport, ok: tuple[int, ...], *request):
    """The answer's JSON; None for another status, no answer or no JSON."""
    try:
        status, text = transport(*request)
        return json.loads(text) if status in ok else None
    except (OSError, ValueError):
        return None


def github_document(user: str, transport: Transport, token: str | None = None, repos: int = 50, timeout: float = 30) -> str | None:
    """A user's profile and repositories as the document that GitHub files hold."""
    headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"token {token}"} if token else {})
    profile = _json(transport, (200,), "GET", f"https://api.github.com/users/{user}", headers, None, timeout)
    if profile is None:
        return None
    listed = _json(transport, (200,), "GET", f"https://api.github.com/users/{user}/repos?sort=pushed&per_page={repos}", headers, None, timeout)
    profile.setdefault("login", user)
    return json.dumps({"profile": profile, "repos": listed or []})


def linkedin_document(url: str, transport: Transport, token: str | None, actor: str | None, timeout: float = 60) -> str | None:
    """The first item that a scraping service returns for a profile; None without its token and actor, or with an error."""
    if not token or not actor:
        return None
    service = f"https://api.apify.com/v2/acts/{actor}/run-sync-get-dataset-items?token={token}"
    items = _json(transport, (200, 201), "POST", service, {"Content-Type": "application/json"}, json.dumps({"profileUrls": [url], "urls": [url]}), timeout)
    item = items[0] if isinstance(items, list) and items else None
    if not isinstance(item, dict) or "error" in item or item.get("status") not in (None, 200, 201):
        return None
    return json.dumps(item.get("profile") or item)


def page(url: str, transport: Transport, timeout: float = 30) -> str | None:
    try:
        status, text = transport("GET", url if "://" in url else f"https://{url}", {"User-Agent": "Mozilla/5.0"}, None, timeout)
    except OSError:
        return None
    return text if status == 200 else None


def fetch(sources: DataFrame, transport: Transport = http, *, repos: int = 50, timeout: float = 30) -> DataFrame:
    """(seq, path, source_type, document) of URL sources (seq, path, source_type, user); those that fail are left out.

    ``transport`` runs on the executors; tokens come from GITHUB_TOKEN, APIFY_TOKEN and APIFY_ACTOR there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kind, path = row["source_type"], row["path"]
                if kind == "github":
                    found = github_document(row["user"], transport, os.environ.get("GITHUB_TOKEN"), repos, timeout) if row["user"] else None
                elif kind == "linkedin_json":
                    found = linkedin_document(path, transport, os.environ.get("APIFY_TOKEN"), os.environ.get("APIFY_ACTOR"))
                else:
                    found = page(path, transport, timeout)
                if found is not None:
                    yield pa.RecordBatch.from_pylist([{"seq": row["seq"], "path": path, "source_type": kind, "document": found}])

    return sources.select("seq", "path", "source_type", "user").mapInArrow(run, "seq bigint, path string, source_type string, document string").where(F.col("document") != "")
