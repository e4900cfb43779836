"""Small helpers of the driver: results remembered for a while, calls timed."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable


def timed_lru_cache(seconds: float, maxsize: int = 128) -> Callable:
    """Like functools.lru_cache, but everything is forgotten after ``seconds``."""

    def wrap(f: Callable) -> Callable:
        kept = functools.lru_cache(maxsize=maxsize)(f)
        ends = time.monotonic() + seconds

        @functools.wraps(f)
        def call(*args, **kw):
            nonlocal ends
            if time.monotonic() >= ends:
                kept.cache_clear()
                ends = time.monotonic() + seconds
            return kept(*args, **kw)

        call.cache_info, call.cache_clear = kept.cache_info, kept.cache_clear
        return call

    return wrap


def log_timeit(f: Callable | None = None, logger: logging.Logger | None = None) -> Callable:
    """Logs how long each call takes; with or without arguments."""
    if f is None:
        return functools.partial(log_timeit, logger=logger)
    log = logger or logging.getLogger(f.__module__)

    @functools.wraps(f)
    def call(*args, **kw):
        began = time.perf_counter()
        try:
            return f(*args, **kw)
        finally:
            log.info("%s took %.4f s", f.__qualname__, time.perf_counter() - began)

    return call
