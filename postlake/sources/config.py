"""Which sources of a run can be asked."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping


def ready(needs: Mapping[str, Iterable[str]], env: Mapping[str, str] | None = None) -> list[str]:
    """Names of the sources all of whose environment variables are set, sorted.
    `needs` gives the variables of each source that a run is to ask."""
    given = os.environ if env is None else env
    return sorted(name for name, wanted in needs.items() if all(map(given.get, wanted)))
