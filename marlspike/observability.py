"""Logging, debugging and profiling of operations."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

log = logging.getLogger("marlspike")
# What counts as slow or large.
SLOW_MS, LARGE_MB = 1000.0, 100.0


@dataclass
class Settings:
    memory: bool = True
    performance: bool = True
    operations: bool = True
    debug: bool = False
    profiling: bool = False


settings = Settings()


def init_logging() -> None:
    init_logging_with_config("info", True, True, True)


def init_logging_with_config(level: str = "info", log_memory: bool = True, log_performance: bool = True, log_operations: bool = True) -> None:
    names = {"trace": logging.DEBUG, "warn": logging.WARNING, "off": logging.CRITICAL + 1}
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.setLevel(names.get(level.lower(), getattr(logging, level.upper(), logging.INFO)))
    settings.memory, settings.performance, settings.operations = log_memory, log_performance, log_operations


def log_operation(operation: str, details: str = "") -> None:
    if settings.operations:
        log.info("%s: %s", operation, details)


def log_memory_usage(operation: str, mb: float) -> None:
    if settings.memory:
        (log.warning if mb > LARGE_MB else log.info)("%s: %.2f MB", operation, mb)


def log_performance(operation: str, ms: float, rows: int | None = None) -> None:
    if settings.performance:
        rate = f", {rows} rows, {rows / ms * 1000:.0f} rows/s" if rows is not None and ms > 0 else ""
        (log.warning if ms > SLOW_MS else log.info)("%s: %.2f ms%s", operation, ms, rate)


def log_error(operation: str, error: str, context: str | None = None) -> None:
    log.error("%s: %s%s", operation, error, f" ({context})" if context else "")


def log_warning(operation: str, warning: str, context: str | None = None) -> None:
    log.warning("%s: %s%s", operation, warning, f" ({context})" if context else "")


def log_debug(operation: str, text: str) -> None:
    log.debug("%s: %s", operation, text)


def log_dataframe_stats(operation: str, rows: int, columns: int) -> None:
    log.info("%s: %d rows, %d columns", operation, rows, columns)


def log_config(name: str, value) -> None:
    log.info("%s = %s", name, value)


def log_trace(operation: str, text: str) -> None:
    log.log(5, "%s: %s", operation, text)


def log_timing(operation: str, started: float) -> float:
    """Milliseconds since a time.perf_counter(), which are logged."""
    ms = (time.perf_counter() - started) * 1000
    log.debug("%s: %.2f ms", operation, ms)
    return ms


def log_feature_usage(feature: str, details: str = "") -> None:
    log.info("%s is used%s", feature, f": {details}" if details else "")


def log_performance_warning(operation: str, ms: float, limit_ms: float = SLOW_MS) -> None:
    if ms > limit_ms:
        log.warning("%s: %.2f ms, over %.2f", operation, ms, limit_ms)


def log_memory_warning(operation: str, mb: float, limit_mb: float = LARGE_MB) -> None:
    if mb > limit_mb:
        log.warning("%s: %.2f MB, over %.2f", operation, mb, limit_mb)


def enable_debug() -> None:
    settings.debug = True


def disable_debug() -> None:
    settings.debug = False


def is_debug_enabled() -> bool:
    return settings.debug


def log_debug_info(operation: str, ms: float | None = None, mb: float | None = None, rows: int | None = None) -> dict:
    """What is known of an operation, which is logged while debugging."""
    info = {k: v for k, v in (("operation", operation), ("duration_ms", ms), ("memory_mb", mb), ("rows", rows)) if v is not None}
    if settings.debug:
        (log.warning if (ms or 0) > SLOW_MS or (mb or 0) > LARGE_MB else log.info)("%s", info)
    return info


def log_operation_start(operation: str) -> None:
    if settings.debug:
        log.info("%s starts", operation)


def log_operation_end(operation: str) -> None:
    if settings.debug:
        log.info("%s ends", operation)


@dataclass
class Profile:
    operation: str
    started: float = field(default_factory=time.perf_counter)
    duration_ms: float = 0.0
    memory_mb: float = 0.0
    rows: int = 0
    metrics: dict = field(default_factory=dict)

    def end(self) -> None:
        self.duration_ms = (time.perf_counter() - self.started) * 1000


_profiles: dict[str, list[Profile]] = {}
_lock = threading.Lock()


def enable_profiling() -> None:
    settings.profiling = True


def disable_profiling() -> None:
    settings.profiling = False


def is_profiling_enabled() -> bool:
    return settings.profiling


def start_profiling(operation: str) -> Profile | None:
    return Profile(operation) if settings.profiling else None


def end_profiling(profile: Profile | None) -> None:
    if profile is not None:
        profile.end()
        with _lock:
            _profiles.setdefault(profile.operation, []).append(profile)


@contextmanager
def profiled(operation: str, memory_mb: float = 0.0, rows: int = 0):
    """Profiles what runs inside; its duration is fixed at the end."""
    own = start_profiling(operation)
    try:
        yield own
    finally:
        if own is not None:
            own.memory_mb, own.rows = own.memory_mb or memory_mb, own.rows or rows
        end_profiling(own)


def profile_function(operation: str, func: Callable, *args, **kw):
    with profiled(operation):
        return func(*args, **kw)


def profile_function_with_metrics(operation: str, func: Callable, *args, metrics: dict | None = None, **kw):
    """The function's result; metrics, a dict that it may fill, goes to the profile."""
    with profiled(operation) as own:
        out = func(*args, **kw)
        if own is not None:
            own.metrics |= metrics or {}
        return out


class MemoryTracker:
    """The largest memory of this process's Python between the beginning and the end, in MB, by the operating system."""

    def __enter__(self) -> MemoryTracker:
        self.before_mb = self._now()
        return self

    def __exit__(self, *_) -> None:
        self.peak_mb = max(self._now(), self.before_mb)
        self.grown_mb = self.peak_mb - self.before_mb

    @staticmethod
    def _now() -> float:
        import resource

        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def get_operation_stats(operation: str) -> dict[str, float] | None:
    with _lock:
        own = list(_profiles.get(operation, ()))
    if not own:
        return None
    out: dict[str, float] = {"count": float(len(own))}
    for name in ("duration_ms", "memory_mb"):
        values = [getattr(p, name) for p in own]
        out |= {f"avg_{name}": sum(values) / len(values), f"min_{name}": min(values), f"max_{name}": max(values)}
    rates = [p.rows / p.duration_ms * 1000 for p in own if p.duration_ms > 0]
    return out | {"avg_rows_per_second": sum(rates) / len(rates) if rates else 0.0}


def get_overall_stats() -> dict[str, float]:
    with _lock:
        own = [p for x in _profiles.values() for p in x]
    out = {"total_operations": float(len(own)), "total_duration_ms": sum(p.duration_ms for p in own), "total_memory_mb": sum(p.memory_mb for p in own), "total_rows_processed": float(sum(p.rows for p in own))}
    if own:
        out |= {"avg_duration_ms": out["total_duration_ms"] / len(own), "avg_memory_mb": out["total_memory_mb"] / len(own)}
    return out


def clear_profiling_data() -> None:
    with _lock:
        _profiles.clear()


def profiling_report() -> str:
    lines = ["operation, count, mean ms, largest ms"]
    for name in sorted(_profiles):
        s = get_operation_stats(name)
        lines.append(f"{name}, {s['count']:.0f}, {s['avg_duration_ms']:.2f}, {s['max_duration_ms']:.2f}")
    return "\n".join(lines)


def print_profiling_report() -> None:
    print(profiling_report())
