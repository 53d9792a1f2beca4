"""The timer loop: tick, sleep until the next timer, prune now and then."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..config import QueueConfig


def pause_s(until_s: float | None, config: QueueConfig = QueueConfig()) -> float:
    """How long to sleep when the next timer is until_s away; without one, the longest sleep."""
    floor, ceiling = config.sleep_floor_ms / 1000, config.sleep_ceiling_ms / 1000
    return ceiling if until_s is None else min(max(until_s, floor), ceiling)


def run(
    tick: Callable[[], int],
    until_next: Callable[[], float | None],
    prune: Callable[[], None],
    stopped: Callable[[], bool],
    failed: Callable[[str, Exception], None],
    config: QueueConfig = QueueConfig(),
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Runs until stopped() and returns how many timers fired.

    A tick or a prune that raises is told to `failed` and tried again later, and a
    next time that cannot be read counts as none: housekeeping never ends the loop.
    """
    fired, pruned = 0, clock()
    while not stopped():
        try:
            fired += tick()
        except Exception as e:  # noqa: BLE001
            failed("tick", e)
        try:
            wait = pause_s(until_next(), config)
        except Exception as e:  # noqa: BLE001
            failed("next", e)
            wait = pause_s(None, config)
        sleep(wait)
        if clock() - pruned >= config.prune_every_s:
            pruned = clock()
            try:
                prune()
            except Exception as e:  # noqa: BLE001
                failed("prune", e)
    return fired
