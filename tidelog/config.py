"""Options of consumers and queues, with the defaults that the model was designed for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ConsumerConfig:
    """What `streaming.service.route` reads; without dead letters a failure stalls its partition."""

    max_attempts: int = 5
    base_backoff_ms: int = 100
    dead_letters: bool = True
    dead_letter_prefix: str = "dlq_"


@dataclass(frozen=True)
class QueueConfig:
    """Defaults of `operators.queues` and of `streaming.scheduler`."""

    batch: int = 100
    retention_days: int = 7
    prune_every_s: float = 3600.0
    sleep_floor_ms: int = 5
    sleep_ceiling_ms: int = 1000
