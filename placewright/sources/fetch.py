"""Fetching an archive once: conditional requests, retries, and the notes kept beside the file.

This runs on the driver before any plan; the archive itself is then read by ``archives.scan_zip``.
"""

import json
import os
import re
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Mapping


def notes_of(path: str) -> dict:
    """The notes beside a file; empty where there are none or they can't be read."""
    try:
        with open(f"{path}.meta.json", encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def keep_notes(path: str, **new) -> dict:
    """Merge values that aren't None into the notes and write them in one step."""
    merged = notes_of(path) | {k: v for k, v in new.items() if v is not None}
    with open(f"{path}.meta.json.tmp", "w", encoding="utf-8") as f:
        json.dump(merged, f)
    os.replace(f"{path}.meta.json.tmp", f"{path}.meta.json")
    return merged


def whole_archive(path: str) -> bool:
    """The file is a ZIP archive and every member's checksum holds."""
    try:
        with zipfile.ZipFile(path) as z:
            return z.testzip() is None
    except (OSError, zipfile.BadZipFile):
        return False


def file_name(headers: Mapping[str, str]) -> str | None:
    found = re.search(r'filename="([^"]+)"', headers.get("Content-Disposition") or "", re.I)
    return found[1] if found else None


def same_version(headers: Mapping[str, str], notes: Mapping) -> bool:
    """The remote file is the one noted: by its name token, its ETag, or its time, whichever agrees."""
    token = file_name(headers)
    return bool(token and token == notes.get("token")) or any(headers.get(h) and headers.get(h) == notes.get(n) for h, n in (("ETag", "etag"), ("Last-Modified", "modified")))


def _open(url: str, headers: Mapping[str, str]):
    try:
        return urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=60)  # noqa: S310
    except urllib.error.HTTPError as e:
        return e


def fetch_archive(url: str, path: str, force: bool = False, tries: int = 3, wait_s: float = 10, opener: Callable = _open, sleep: Callable = time.sleep) -> str | None:
    """The path of a newly fetched archive, or None when the one at ``path`` is still current.

    200 is a new file unless it is the noted version; 304 is unchanged; 202 means not ready, so it is
    asked for again; anything else falls back to a whole archive on disk, and fails without one.
    """
    there = whole_archive(path)
    notes = notes_of(path) if there and not force else {}
    ask = {k: v for k, v in (("If-None-Match", notes.get("etag")), ("If-Modified-Since", notes.get("modified"))) if v}
    status = None
    for n in range(tries):
        try:
            with opener(url, ask) as r:
                status = r.status
                if status == 304 or status == 200 and notes and same_version(r.headers, notes):
                    return None
                if status == 200:
                    with open(f"{path}.tmp", "wb") as f:
                        while block := r.read(1 << 20):
                            f.write(block)
                    if whole_archive(f"{path}.tmp"):
                        os.replace(f"{path}.tmp", path)
                        keep_notes(path, token=file_name(r.headers), etag=r.headers.get("ETag"), modified=r.headers.get("Last-Modified"))
                        return path
                    os.remove(f"{path}.tmp")
        except OSError as e:
            status = e
        if n + 1 < tries:
            sleep(wait_s)
    if there:
        return None
    raise RuntimeError(f"no archive from {url}: {status}")
