"""Conditional fetching, with answers made up here."""

import io
import zipfile

import pytest

from placewright.sources import fetch


class Answer(io.BytesIO):
    def __init__(self, status, data=b"", **headers):
        super().__init__(data)
        self.status, self.headers = status, {k.replace("_", "-"): v for k, v in headers.items()}


def packed():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("objects/1.json", "{}")
    return b.getvalue()


def test_fetch(tmp_path):
    path, asked, waits = str(tmp_path / "a.zip"), [], []

    def fetched(*answers, **how):
        left = list(answers)

        def opener(url, headers):
            asked.append(headers)
            return left.pop(0)

        return fetch.fetch_archive("http://x", path, opener=opener, sleep=waits.append, **how)

    with pytest.raises(RuntimeError):
        fetched(Answer(500), Answer(500), Answer(200, b"no archive"))
    assert fetched(Answer(202), Answer(200, packed(), ETag="e1", Content_Disposition='attachment; FILENAME="f1.zip"')) == path and len(waits) == 3
    assert fetch.notes_of(path) == {"token": "f1.zip", "etag": "e1"}
    assert fetched(Answer(304)) is None and asked[-1] == {"If-None-Match": "e1"}
    assert fetched(Answer(200, packed(), Content_Disposition='attachment; filename="f1.zip"')) is None
    assert fetched(Answer(200, packed(), ETag="e1")) is None
    assert fetched(Answer(200, packed(), ETag="e1"), force=True) == path and asked[-1] == {}
    assert fetched(Answer(500), Answer(500), Answer(500)) is None
    assert fetched(Answer(200, packed(), ETag="e2", Content_Disposition='a; filename="f2.zip"')) == path and fetch.notes_of(path)["token"] == "f2.zip"
    assert fetched(Answer(200, packed(), ETag="e2", Content_Disposition='a; filename="f3.zip"')) is None
    (tmp_path / "a.zip.meta.json").write_text("[broken")
    assert fetch.notes_of(path) == {} and fetch.whole_archive(path) and not fetch.whole_archive(str(tmp_path))
