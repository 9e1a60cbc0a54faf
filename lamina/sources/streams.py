"""Byte streams by address: local files and HTTP ranges. Object stores are read through Spark's own file systems."""

from __future__ import annotations

import io
import os
import ssl
import time
import urllib.error
import urllib.request
from pathlib import Path
from urllib.parse import urlsplit

READ_MODES, WRITE_MODES = {"rb"}, {"wb", "wb+", "ab", "rb+"}


class HttpRange(io.RawIOBase):
    """A seekable view of begin <= k < end of an HTTP resource. Seeking forward within the open response reads on,
    anything else sends a new range request; counters tell what was read, skipped and waited for. Requests that fail
    before an answer, or with a server error, are sent again up to retries times; context has certificates, if any."""

    response = None

    def __init__(self, uri: str, begin: int = 0, end: int | None = None, headers: dict | None = None, skip_up_to: int = 1 << 20, retries: int = 2, context: ssl.SSLContext | None = None):
        if begin < 0 or (end is not None and end <= begin):
            raise ValueError("a range must begin at 0 or later and end after its begin")
        self.uri, self.begin, self.end, self.headers, self.skip_up_to = uri, begin, end, dict(headers or {}), skip_up_to
        self.retries, self.context = retries, context
        self.at, self.response_headers = begin, {}
        self.bytes_read = self.bytes_skipped = self.requests = 0
        self.first_byte_seconds = 0.0

    def _connect(self) -> None:
        if self.response:
            self.response.close()
        last = "" if self.end is None else str(self.end - 1)
        began = time.monotonic()
        request = urllib.request.Request(self.uri, headers=self.headers | {"Range": f"bytes={self.at}-{last}"})
        for turn in range(self.retries + 1):
            try:
                self.response = urllib.request.urlopen(request, context=self.context)
                break
            except urllib.error.URLError as e:
                if turn == self.retries or (isinstance(e, urllib.error.HTTPError) and e.code < 500):
                    raise
                time.sleep(0.1 * 2**turn)
        if self.at and self.response.status != 206:
            self.response.close()
            raise OSError(f"{self.uri} does not serve byte ranges")
        self.response_headers = {k.lower(): v for k, v in self.response.headers.items()}
        self.first_byte_seconds += time.monotonic() - began
        self.requests += 1

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence == 2:
            raise io.UnsupportedOperation("the end of a stream is not known")
        target = offset if whence == 0 else self.at + offset
        if target < 0:
            raise ValueError("negative position")
        if target != self.at:
            ahead = target - self.at
            if self.response and 0 < ahead <= self.skip_up_to:
                while ahead and (got := self.response.read(min(ahead, 1 << 16))):
                    ahead -= len(got)
                    self.bytes_skipped += len(got)
            elif self.response:
                self.response.close()
                self.response = None
            self.at = target
        return self.at

    def readinto(self, into) -> int:
        if self.end is not None and self.at >= self.end:
            return 0
        if not self.response:
            self._connect()
        room = len(into) if self.end is None else min(len(into), self.end - self.at)
        got = self.response.read(room)
        into[: len(got)] = got
        self.at += len(got)
        self.bytes_read += len(got)
        return len(got)

    def close(self) -> None:
        if self.response:
            self.response.close()
        super().close()

    @property
    def cache_status(self):
        return self.response_headers.get("x-cache-status", False)


def open_stream(uri: str | os.PathLike, mode: str = "rb", begin: int = 0, end: int | None = None, headers: dict | None = None, buffer_size: int = 1 << 20):
    """A binary stream of an address: http and https (reading), file or a path (reading and writing; folders are made).
    A PathLike is always local."""
    if mode not in READ_MODES | WRITE_MODES:
        raise ValueError(f"mode {mode!r} is not among {sorted(READ_MODES | WRITE_MODES)}")
    scheme = "" if isinstance(uri, os.PathLike) else urlsplit(uri).scheme.lower()
    if scheme in ("http", "https"):
        if mode != "rb":
            raise ValueError("addresses of http can only be read")
        return io.BufferedReader(HttpRange(uri, begin, end, headers), buffer_size)
    if scheme not in ("", "file"):
        raise ValueError(f"{scheme} addresses are read with Spark's file systems; see decode_files")
    path = Path(urlsplit(uri).path if scheme == "file" else uri)
    if mode in WRITE_MODES:
        path.parent.mkdir(parents=True, exist_ok=True)
    file = open(path, mode)  # noqa: SIM115
    if begin:
        file.seek(begin)
    return file
