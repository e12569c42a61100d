import logging

from marlspike import observability as o


def test_profiles_freeze():
    o.clear_profiling_data()
    o.enable_profiling()
    with o.profiled("a", rows=10):
        pass
    first = o.get_operation_stats("a")
    assert first == o.get_operation_stats("a") and first["count"] == 1.0
    assert o.get_overall_stats()["total_rows_processed"] == 10.0
    assert o.profile_function("b", lambda: 3) == 3
    assert "b, 1" in o.profiling_report()
    o.disable_profiling()
    with o.profiled("a"):
        pass
    assert o.get_operation_stats("a")["count"] == 1.0
    o.clear_profiling_data()
    assert o.get_operation_stats("a") is None


def test_logging(caplog):
    o.init_logging_with_config("info", log_memory=False)
    with caplog.at_level(logging.INFO, "marlspike"):
        o.log_operation("x", "y")
        o.log_memory_usage("x", 1)
        o.log_performance("x", 10, 100)
        o.log_warning("x", "w", "c")
    assert [r.getMessage() for r in caplog.records] == ["x: y", "x: 10.00 ms, 100 rows, 10000 rows/s", "x: w (c)"]


def test_debug():
    o.enable_debug()
    assert o.is_debug_enabled()
    assert o.log_debug_info("x", 1.0, 2.0, 3) == {"operation": "x", "duration_ms": 1.0, "memory_mb": 2.0, "rows": 3}
    o.disable_debug()


def test_more_helpers(caplog):
    import logging
    import time

    from marlspike import observability as o

    caplog.set_level(1, logger="marlspike")
    o.log_trace("a", "b")
    assert o.log_timing("a", time.perf_counter()) < 1000
    o.log_feature_usage("f", "x")
    o.log_performance_warning("slow", 2000.0)
    o.log_performance_warning("fast", 1.0)
    o.log_memory_warning("large", 200.0)
    o.log_memory_warning("small", 1.0)
    warned = [r.message for r in caplog.records if r.levelno == logging.WARNING]
    assert [w.split(":")[0] for w in warned] == ["slow", "large"]
    o.clear_profiling_data()
    o.enable_profiling()
    assert o.profile_function_with_metrics("op", lambda x: x + 1, 2, metrics={"rows": 3}) == 3
    assert o.get_operation_stats("op")["count"] == 1
    o.disable_profiling()
    with o.MemoryTracker() as tracked:
        kept = [0] * 1000
    assert tracked.peak_mb > 0 and tracked.grown_mb >= 0 and kept
