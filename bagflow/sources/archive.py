"""Public events of a code host, archived as one gzip file of JSON lines for each hour."""

from __future__ import annotations

import gzip
import io
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from typing import BinaryIO

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bagflow.operators.dataset import Dataset
from bagflow.sources.external import Partition, external

BASE = "https://data.gharchive.org"
#: Partitions for each day of 24 files.
PARTS = 6

EVENT_SCHEMA = (
    "actor struct<id: bigint, login: string, url: string>, repo struct<id: bigint, name: string>, type string, "
    "payload struct<commits: array<struct<author: struct<email: string, name: string>, message: string, sha: string, distinct: boolean>>>"
)


def urls(first: date, last: date, base: str = BASE) -> list[str]:
    """Files of all hours from the first day to the last, both included."""
    days = [first + timedelta(n) for n in range((last - first).days + 1)]
    return [f"{base}/{day.isoformat()}-{hour}.json.gz" for day in days for hour in range(24)]


def dealt(files: list[str]) -> list[list[str]]:
    """Files dealt in turn to PARTS partitions for each day."""
    n = len(files) // 24 * PARTS
    return [files[i::n] for i in range(n)]


def download(url: str) -> BinaryIO | None:
    """The file as a stream, or None if there is none; anything else but success is an error."""
    try:
        return urllib.request.urlopen(url, timeout=300)
    except urllib.error.HTTPError as error:
        if error.code == 404:
            return None
        raise


def _commit(x: dict) -> tuple:
    return (x["author"]["email"], x["author"]["name"]), x["message"], x["sha"], x.get("distinct", True)


def decoded(line: bytes) -> tuple:
    """An event. Its type, payload, actor's url and repository are required; commits are read from pushes only."""
    x = json.loads(line)
    actor, repo, kind, payload = x["actor"], x["repo"], x["type"], x["payload"]
    commits = ([_commit(c) for c in payload["commits"]],) if kind == "PushEvent" else None
    return (actor.get("id"), actor.get("login"), actor["url"]), (repo["id"], repo["name"]), kind, commits


Fetch = Callable[[str], BinaryIO | bytes | None]


def producer(url: str, fetch: Fetch = download) -> Callable[[], Iterator[tuple]]:
    """The events of a file, inflated and read line by line as they are asked for: no more than a line is held."""

    def produce() -> Iterator[tuple]:
        try:
            packed = fetch(url)
            if packed is None:
                return
            with io.BytesIO(packed) if isinstance(packed, bytes) else packed as stream, gzip.open(stream) as lines:
                for line in lines:
                    if line.strip():
                        yield decoded(line)
        except Exception as error:
            raise RuntimeError(f"{url}: {type(error).__name__}: {error}") from error

    return produce


def events(spark: SparkSession, first: date, last: date, base: str = BASE, fetch: Fetch = download) -> Dataset:
    """All events of some days. An hour without a file has no events; a bad file or record is an error that names the file."""
    parts = [sum((Partition.of(producer(url, fetch)) for url in files), Partition()) for files in dealt(urls(first, last, base))]
    return external(spark, parts, EVENT_SCHEMA)


def commits() -> Column:
    """The commits of an event's push; null for other events."""
    return F.col("payload.commits")
