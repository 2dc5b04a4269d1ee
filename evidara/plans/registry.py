"""Registration of queries next to their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None) -> Callable:
        """Register the function under its name, with the SQL that gives the same rows where there is one."""

        def register(run: Callable) -> Callable:
            self.queries[run.__name__] = run
            if oracle is not None:
                self.oracles[run.__name__] = oracle
            return run

        return register
