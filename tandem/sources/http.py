"""A Spark data source for windowed JSON requests: one partition per key and date window.

The request function is a parameter, so that landing works against any transport and
is tested without a network.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses worth another try (fixed values).
RETRIED = (429, 500, 502, 503, 504)


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date as mail has it."""
    if not value:
        return None
    if re.fullmatch(r"\s*\d+(\.\d+)?\s*", value):
        return float(value)
    try:
        return max(0.0, (parsedate_to_datetime(value) - now).total_seconds())
    except (TypeError, ValueError):
        return None


def json_within(text: str | None) -> str | None:
    """The outermost JSON object or list inside a text, as a relay that wraps responses gives it."""
    for found in re.finditer(r"[\[{]", text or ""):
        try:
            _, end = json.JSONDecoder().raw_decode(text, found.start())
            return text[found.start() : end]
        except ValueError:
            continue
    return None


def attempts_for(days: int) -> int:
    """How often a window of so many days is asked for: short ones more often, for nothing is left to split."""
    return 1 if days > 7 else 2 if days > 1 else 4


def get_json(
    url: str, parameters: dict, send: Callable, attempts: int = 6, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep, relay: Callable | None = None,
    audit: Callable[[int, int], None] | None = None, jitter: Callable[[], float] = random.random,
) -> tuple[str, str | None]:
    """(state, body): ok, absent (status 400 or an empty body) or error, after retries.

    `send` gives (status, body), or (status, body, Retry-After).  Pauses double up to a
    minute, with up to half as much again by chance, unless the response names one.  A
    relay is asked once when all tries failed, and the JSON inside its text is taken.
    `audit` is told each try and its status.
    """
    body: str | None = None
    for n in range(attempts):
        status, body, *header = send(url, parameters)
        if audit:
            audit(n, status)
        if status == 400 or (status == 200 and not body):
            return "absent", None
        if status == 200:
            try:
                json.loads(body)
                return "ok", body
            except ValueError:
                pass
        elif status not in RETRIED:
            break
        asked = retry_after(header[0] if header else None, datetime.now(UTC))
        sleep(asked if asked is not None else min(60.0, pause * 2**n) * (1 + 0.5 * jitter()))
    inside = json_within(relay(url, parameters)[1]) if relay else None
    return ("ok", inside) if inside is not None else ("error", body)


def spaced(send: Callable, gap: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable:
    """`send` with at least `gap` seconds between two requests of a task; a page that is not there (404) comes back as it is."""
    last: list[float] = []

    def paced(url: str, parameters: dict):
        if last and clock() - last[0] < gap:
            sleep(gap - (clock() - last[0]))
        last[:] = [clock()]
        return send(url, parameters)

    return paced


def either(*clients: Callable) -> Callable:
    """The first client's response, or that of the next one where it fails."""

    def send(url: str, parameters: dict):
        for client in clients:
            out = client(url, parameters)
            if out[0] == 200:
                break
        return out

    return send


class _Window(InputPartition):
    def __init__(self, key: str, start: str, end: str):
        super().__init__((key, start, end))
        self.key, self.start, self.end = key, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict, send: Callable[[str, dict], tuple[int, str]]):
        self.options, self.send = dict(options), send

    def partitions(self) -> list[InputPartition]:
        return [_Window(*w) for w in json.loads(self.options["windows"])]

    def read(self, partition: _Window) -> Iterator[tuple]:
        parameters = {"key": partition.key, "from": partition.start, "to": partition.end}
        days = (date.fromisoformat(partition.end) - date.fromisoformat(partition.start)).days + 1
        tries: list[str] = []
        attempts = int(self.options.get("attempts", attempts_for(days)))
        send = spaced(self.send, float(self.options.get("gap", 0.0)))
        state, body = get_json(self.options["url"], parameters, send, attempts=attempts, pause=float(self.options.get("pause", 1.0)), audit=lambda n, status: tries.append(f"{n}:{status}"))
        yield partition.key, partition.start, partition.end, state, body, ",".join(tries)


def windowed_source(name: str, send: Callable[[str, dict], tuple[int, str]]) -> type[DataSource]:
    """A data source class to register with spark.dataSource; `send` runs in the tasks."""

    class Windowed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, from_date string, to_date string, state string, body string, tries string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, send)

    return Windowed
