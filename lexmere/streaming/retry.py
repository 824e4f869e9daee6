"""Retries with time-out and growing waits, for calls that the driver makes."""

from __future__ import annotations

import concurrent.futures
import functools
import time
from collections.abc import Callable
from typing import Any


def retrying(tries: int = 3, timeout: float = 30.0, base: float = 2.0, errors: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls up to ``tries`` times, each for ``timeout`` seconds at most, waiting base ** n seconds after the n-th failure; the last error is raised."""
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args: Any, **named: Any) -> Any:
            for n in range(tries):
                pool = concurrent.futures.ThreadPoolExecutor(1)
                try:
                    return pool.submit(f, *args, **named).result(timeout)
                except errors:
                    if n == tries - 1:
                        raise
                    sleep(base**n)
                finally:
                    pool.shutdown(wait=False)

        return run

    return wrap
