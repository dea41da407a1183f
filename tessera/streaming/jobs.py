"""Jobs that depend on each other: their order, retries and schedules, run from the driver."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Job:
    name: str
    run: Callable[[], object]
    after: tuple[str, ...] = ()
    priority: int = 0
    retries: int = 0
    every_seconds: float = 0.0


@dataclass
class Jobs:
    """Jobs by name. ``order`` raises if any waits for itself or for one that isn't there."""

    jobs: dict[str, Job] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)

    def add(self, job: Job) -> None:
        if job.name in self.jobs:
            raise ValueError(f"job {job.name} exists")
        self.jobs[job.name] = job

    def order(self) -> list[str]:
        """Every job after those that it waits for, by priority (high first) and name among the ready."""
        waiting = {n: set(j.after) for n, j in self.jobs.items()}
        if gone := set().union(*waiting.values(), set()) - set(self.jobs):
            raise ValueError(f"jobs not found: {', '.join(sorted(gone))}")
        out: list[str] = []
        while waiting:
            ready = [n for n, w in waiting.items() if w <= set(out)]
            if not ready:
                raise ValueError(f"jobs wait for each other: {', '.join(sorted(waiting))}")
            first = min(ready, key=lambda n: (-self.jobs[n].priority, n))
            out.append(first)
            del waiting[first]
        return out

    def due(self, now: float) -> list[str]:
        """Jobs whose interval has passed since their last run, in order; those without one never run twice."""
        return [n for n in self.order() if n not in self.last or 0 < self.jobs[n].every_seconds <= now - self.last[n]]

    def run_due(self, now: float | None = None) -> dict[str, object]:
        """Run what is due; a job is skipped if one that it waits for failed. Gives results or exceptions."""
        now = time.time() if now is None else now
        done: dict[str, object] = {}
        for name in self.due(now):
            job = self.jobs[name]
            if any(isinstance(done.get(a), Exception) for a in job.after):
                done[name] = RuntimeError(f"{name} waits for a job that failed")
                continue
            for attempt in range(job.retries + 1):
                try:
                    done[name] = job.run()
                    break
                except Exception as e:  # reported in the result
                    done[name] = e
            self.last[name] = now
        return done
