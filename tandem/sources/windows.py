"""A streaming source of windows that split: halves of a refused window are the next batch's partitions.

Round 0 asks for the windows given, one partition each.  A window that comes back with
`cap` rows or more (the service cuts answers off there), or that fails, leaves a
marker in the state folder; the next round asks for its two halves.  Offsets count
rounds, markers are written under a fixed name, and planning reads nothing else, so a
batch that is run again asks for the same windows.  A refused window of one day has failed.

Every try gives an audit row, every window one row, and every row of an admitted window
a row of its own.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tandem.sources.archive import _store
from tandem.sources.http import attempts_for, get_json, spaced

LANDED = "kind string, key string, from_date string, to_date string, depth int, attempt int, status string, n_rows long, reason string, row string"


def halves(start: str, end: str) -> list[tuple[str, str]]:
    """[start, end] cut after start + days div 2."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    middle = a + timedelta(days=(b - a).days // 2)
    return [(start, middle.isoformat()), ((middle + timedelta(days=1)).isoformat(), end)]


def tumbling(start: str, end: str, days: int = 14) -> list[tuple[str, str]]:
    """Contiguous windows of `days` days; the last one is clipped to the end."""
    a, b, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= b:
        last = min(b, a + timedelta(days=days - 1))
        out.append((a.isoformat(), last.isoformat()))
        a = last + timedelta(days=1)
    return out


class _Part(InputPartition):
    def __init__(self, key: str, start: str, end: str, depth: int):
        super().__init__((key, start, end, depth))
        self.key, self.start, self.end, self.depth = key, start, end, depth


class _Rounds(DataSourceStreamReader):
    def __init__(self, options: dict, send: Callable):
        self.options, self.send = dict(options), send
        self.cap = int(self.options.get("cap", 500))
        self.planned = 0

    def _folder(self, number: int) -> str:
        return f"{self.options['state']}/refused/{number}"

    def _refused(self, number: int) -> list[list]:
        store, root = _store(self._folder(number))
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            with store.open_input_stream(f.path) as given:
                out.append(json.loads(given.read()))
        return out

    def _mark(self, part: _Part) -> None:
        store, root = _store(self._folder(part.depth))
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{part.key}_{part.start}_{part.end}.json") as out:
            out.write(json.dumps([part.key, part.start, part.end]).encode())

    def _windows(self, number: int) -> list[tuple]:
        if number == 0:
            return [tuple(w) for w in json.loads(self.options["windows"])]
        return [(key, *half) for key, a, b in self._refused(number - 1) for half in halves(a, b)]

    def initialOffset(self) -> dict:
        return {"rounds": 0}

    def latestOffset(self) -> dict:
        """One round more while the last one planned has refused windows; a restarted reader finds the last round by the markers."""
        while self.planned == 0 or self._refused(self.planned - 1):
            self.planned += 1
            if not self._refused(self.planned - 1):
                break
        return {"rounds": self.planned}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(*w, number) for number in range(start["rounds"], end["rounds"]) for w in self._windows(number)]

    def read(self, part: _Part) -> Iterator[tuple]:
        where = (part.key, part.start, part.end, part.depth)
        days = (date.fromisoformat(part.end) - date.fromisoformat(part.start)).days + 1
        tries: list[tuple] = []
        send = spaced(self.send, float(self.options.get("gap", 0.0)))
        state, body = get_json(
            self.options.get("url", ""), {"key": part.key, "from": part.start, "to": part.end}, send, attempts=int(self.options.get("attempts", attempts_for(days))),
            pause=float(self.options.get("pause", 1.0)), sleep=time.sleep, audit=lambda n, status: tries.append((n, status)),
        )
        for n, status in tries:
            yield "try", *where, n + 1, str(status), None, None, None
        rows = json.loads(body) if state == "ok" else []
        reason = "" if state != "error" and len(rows) < self.cap else f"ROW_CAP rows={len(rows)}" if state == "ok" else "request failed"
        status = "success" if not reason else "split" if part.start < part.end else "failed"
        if status == "split":
            self._mark(part)
        yield "window", *where, len(tries), status, len(rows), reason, None
        if status == "success":
            for r in rows:
                yield "row", *where, None, None, None, None, json.dumps(r, separators=(",", ":"), ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def splitting_source(name: str, send: Callable) -> type[DataSource]:
    """A streaming source to register with spark.dataSource.

    Options: windows (JSON list of [key, from, to]), state (a shared folder for markers),
    cap, attempts, pause, gap, url.  `send` runs in the tasks and gives (status, body).
    """

    class Splitting(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LANDED

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Rounds(self.options, send)

    return Splitting
