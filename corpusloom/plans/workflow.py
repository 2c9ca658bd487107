"""Workflows: named steps between frames, run in dependency order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Workflow:
    """A directed acyclic graph of steps. A step takes the state (a dict, by name) and returns its own value; frames stay lazy."""

    def __init__(self) -> None:
        self.steps: dict[str, Callable[[dict[str, Any]], Any]] = {}
        self.needs: dict[str, tuple[str, ...]] = {}

    def add(self, name: str, step: Callable[[dict[str, Any]], Any], needs: tuple[str, ...] = ()) -> Workflow:
        if name in self.steps:
            raise ValueError(f"there is a step {name} already")
        self.steps[name], self.needs[name] = step, tuple(needs)
        return self

    def order(self, start_at: str | None = None) -> list[str]:
        """Steps in an order that respects their needs; with start_at only that step and those that depend on it."""
        if missing := {n for ns in self.needs.values() for n in ns} - set(self.steps):
            raise ValueError(f"unknown steps: {sorted(missing)}")
        done: list[str] = []
        left = dict(self.needs)
        while left:
            ready = [n for n, ns in left.items() if all(x in done for x in ns)]
            if not ready:
                raise ValueError(f"the steps {sorted(left)} depend on one another in a circle")
            done += ready
            for n in ready:
                del left[n]
        if start_at is None:
            return done
        if start_at not in self.steps:
            raise ValueError(f"unknown step {start_at}")
        kept = {start_at}
        for n in done:
            if any(x in kept for x in self.needs[n]):
                kept.add(n)
        return [n for n in done if n in kept]

    def run(self, state: dict[str, Any] | None = None, start_at: str | None = None) -> dict[str, Any]:
        state = dict(state or {})
        for name in self.order(start_at):
            state[name] = self.steps[name](state)
        return state
