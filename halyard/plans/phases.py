"""Running phases in order, with a record after each and a stop at the first failure."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

PHASES = ("download", "encode", "upload", "build-data", "validate")
ALIASES = {"apply-cdn": "build-data"}


def phase_range(first: str | None = None, last: str | None = None, phases: tuple[str, ...] = PHASES) -> tuple[str, ...]:
    a, b = (ALIASES.get(x, x) for x in (first or phases[0], last or phases[-1]))
    if a not in phases or b not in phases or phases.index(a) > phases.index(b):
        raise ValueError(f"invalid phase range {a} to {b}; phases are {', '.join(phases)}")
    return phases[phases.index(a) : phases.index(b) + 1]


def run_phases(steps: dict[str, Callable[[], int]], names: tuple[str, ...], record: Callable[[list[dict]], None] = lambda _: None) -> list[dict]:
    """Run each phase; one that raises or leaves no artifacts fails, and the later ones don't run."""
    log: list[dict] = []
    for name in names:
        began = time.time()
        try:
            made = steps[name]()
            status, reason = ("completed", "") if made > 0 else ("failed", "no artifacts")
        except Exception as e:  # the record says what went wrong
            made, status, reason = 0, "failed", str(e)
        log.append({"phase": name, "status": status, "artifacts": made, "reason": reason, "seconds": time.time() - began})
        record(log)
        if status == "failed":
            break
    return log


def download_plans(formats: list[str], clients: list[str], keep_video: bool = False) -> list[str]:
    """Labels of all attempts, format by format; for videos only the first format is tried."""
    wanted = (formats[:1] or ["video"]) if keep_video else (formats or ["opus", "mp3"])
    return [f"{f}@{c}" for f, c in itertools.product(wanted, clients)]


def playlist_items(selection: str | int | None) -> list[int] | None:
    """Numbers of ``3``, ``2:5``, ``1:9:2`` or ``1,4``; None for all."""
    text = str(selection or "all").strip().lower()
    if text in ("all", ""):
        return None
    out: list[int] = []
    for part in text.split(","):
        numbers = [int(x) for x in part.split(":")]
        if len(numbers) > 3 or any(n < 1 for n in numbers):
            raise ValueError(f"invalid selection {selection}")
        out += range(numbers[0], (numbers[1] if len(numbers) > 1 else numbers[0]) + 1, numbers[2] if len(numbers) > 2 else 1)
    return out
