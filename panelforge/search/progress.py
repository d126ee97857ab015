"""Progress of a run in one small file of the driver: what is done, what was interrupted, under which configuration."""

from __future__ import annotations

import json
from pathlib import Path

from panelforge.sources.sinks import atomic_text, canonical, stable_hash

#: States of a task.
PENDING, RUNNING, COMPLETED, FAILED, INTERRUPTED = "pending", "running", "completed", "failed", "interrupted"


class Progress:
    """States by task. Opened again, what was running counts as interrupted; another configuration is refused."""

    def __init__(self, path: str | Path, tasks: list[str], config: dict):
        self.path, mark = Path(path), stable_hash(config)
        self.states = dict.fromkeys(tasks, PENDING)
        self.extra: dict = {}
        if self.path.exists():
            kept = json.loads(self.path.read_text())
            if kept["config"] != mark:
                raise ValueError(f"{self.path} belongs to another configuration")
            self.states |= {t: INTERRUPTED if s == RUNNING else s for t, s in kept["states"].items()}
            self.extra = kept["extra"]
        self.config = mark
        self.save()

    def save(self) -> None:
        atomic_text(self.path, canonical({"config": self.config, "states": self.states, "extra": self.extra}))

    def set(self, task: str, state: str, **extra) -> None:
        self.states[task] = state
        if extra:
            self.extra[task] = extra
        self.save()

    def left(self) -> list[str]:
        """All but the completed ones, in order."""
        return [t for t, s in self.states.items() if s != COMPLETED]

    def run(self, work) -> None:
        """Do what is left; a failing task is marked and the others go on, an interrupt stops the run."""
        for task in self.left():
            self.set(task, RUNNING)
            try:
                extra = work(task) or {}
            except KeyboardInterrupt:
                self.set(task, INTERRUPTED)
                raise
            except Exception as error:  # a task's failure is its result
                self.set(task, FAILED, error=f"{type(error).__name__}: {error}")
            else:
                self.set(task, COMPLETED, **extra)
