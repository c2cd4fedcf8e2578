"""Packages kept by a code host: checks of what is asked for, and a data source that reads through a client.

The checks need no network. The source asks a client for entries; the client that speaks HTTPS
is only made where none is given.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SOURCE = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*))/([A-Za-z0-9._-]+?)(?:@([^@\s]+))?$"
HOSTS = ("api.github.com", "raw.githubusercontent.com", "github.com")
MAX_BYTES = 10 << 20


def parse_source(source: str) -> tuple[str, str, str | None]:
    """(owner, repo, ref) of owner/repo[@ref]; ValueError for anything else."""
    m = re.match(SOURCE, source)
    if not m:
        raise ValueError(f"not owner/repo or owner/repo@ref: {source!r}")
    return m[1], m[2], m[3]


def parse_source_column(source: Column | str) -> Column:
    """struct<owner, repo, ref, error>."""
    s = F.col(source) if isinstance(source, str) else source
    ok = s.rlike(SOURCE)
    part = lambda g: F.when(ok & (F.regexp_extract(s, SOURCE, g) != ""), F.regexp_extract(s, SOURCE, g))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("ref"), F.when(~ok, "invalid source").alias("error"))


def validate_entry_name(name: str) -> str:
    """A name of one entry of a folder; ValueError for what leads elsewhere."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or "\0" in name:
        raise ValueError(f"not the name of an entry: {name!r}")
    return name


def validate_download_url(url: str) -> str:
    """A URL over https of a host that is allowed."""
    parts = urllib.parse.urlparse(url)
    if parts.scheme != "https" or parts.hostname not in HOSTS:
        raise ValueError(f"not an address to download from: {url!r}")
    return url


def https_get(url: str) -> bytes:
    request = urllib.request.Request(validate_download_url(url), headers={"Accept": "application/vnd.github+json"})
    if token := os.environ.get("GITHUB_TOKEN"):
        request.add_header("Authorization", f"Bearer {token}")
    with urllib.request.urlopen(request, timeout=30) as answer:
        data = answer.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"over {MAX_BYTES} bytes: {url}")
    return data


def walk(source: str, get: Callable[[str], bytes] = https_get) -> Iterator[tuple[str, int, str]]:
    """(path, size, download URL) of every file of a repository."""
    owner, repo, ref = parse_source(source)
    todo = [""]
    while todo:
        folder = todo.pop()
        url = f"https://api.github.com/repos/{owner}/{repo}/contents/{urllib.parse.quote(folder)}" + (f"?ref={urllib.parse.quote(ref)}" if ref else "")
        for entry in json.loads(get(url)):
            path = f"{folder}/{validate_entry_name(entry['name'])}".lstrip("/")
            if entry["type"] == "dir":
                todo.append(path)
            elif entry["type"] == "file":
                yield path, int(entry.get("size", 0)), validate_download_url(entry["download_url"])


class _File(InputPartition):
    def __init__(self, path: str, size: int, url: str):
        self.path, self.size, self.url = path, size, url


class _Reader(DataSourceReader):
    def __init__(self, source: str, get: Callable[[str], bytes]):
        self.source, self.get = source, get

    def partitions(self) -> list[InputPartition]:
        return [_File(*f) for f in walk(self.source, self.get)]

    def read(self, partition: _File) -> Iterator[tuple]:
        data = self.get(partition.url)
        try:
            text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            text = None
        yield self.source, partition.path, text, partition.size


class RemotePackages(DataSource):
    """spark.dataSource.register(RemotePackages); spark.read.format("remote_package").load("owner/repo@ref"): a partition for each file."""

    #: What fetches; tests put another here.
    get: Callable[[str], bytes] = staticmethod(https_get)

    @classmethod
    def name(cls) -> str:
        return "remote_package"

    def schema(self) -> str:
        return "package_id string, relative_path string, content string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        parse_source(self.options["path"])
        return _Reader(self.options["path"], type(self).get)
