"""What a run reports."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class State(str, Enum):
    QUEUED = "queued"
    PLANNING = "planning"
    STARTING = "starting"
    RUNNING = "running"
    COMPLETED = "completed"
    IDLE = "idle"
    EXCLUDED = "excluded"
    FAILED = "failed"
    UNKNOWN = "unknown"

    @property
    def terminal(self) -> bool:
        return self in (State.COMPLETED, State.EXCLUDED, State.FAILED)


@dataclass(frozen=True)
class Event:
    flow: str
    state: State
    message: str = ""

    def __str__(self) -> str:
        return f"{self.flow}: {self.state.value}" + (f" ({self.message})" if self.message else "")
