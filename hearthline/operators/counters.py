"""Arithmetic over polled run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_exact
from ..functions.text import as_column

# Counters polled per run.
CPU_COUNTERS = [
    "cpuUser",
    "cpuNice",
    "cpuKernel",
    "cpuIdle",
    "cpuIOWait",
    "cpuIrq",
    "cpuSoftIrq",
    "cpuSteal",
    "cpuGuest",
    "cpuGuestNice",
]
MEMORY_COUNTERS = ["pageFaults", "majorPageFaults"]
# Memory of one CPU, fit of the memory curve, limits of the advice.
MEMORY_PER_CPU = 1792
ADVICE_SLOPE, ADVICE_OFFSET = 0.000556, 0.012346
ADVICE_MIN, ADVICE_MAX = 128, 10240


def counter_deltas(
    polls: DataFrame,
    counters: list[str] | None = None,
    run: str = "run_id",
    order: str = "ts",
) -> DataFrame:
    """Last poll minus first poll, one row per run and one column per counter.

    ``polls`` has the run, an order column, ``metric`` and ``value``. The counter
    list is given, so the pivot needs no pass to find it.
    """
    names = counters or CPU_COUNTERS + MEMORY_COUNTERS
    delta = F.max_by("value", order) - F.min_by("value", order)
    wide = polls.where(F.col("metric").isin(names)).groupBy(run).pivot("metric", names).agg(delta)
    return wide.select(run, *(F.col(n).alias(f"{n}Delta") for n in names))


def size_advice(
    runs: DataFrame,
    memory: str = "functionMemory",
    user: str = "cpuUserDelta",
    kernel: str = "cpuKernelDelta",
    runtime: str = "userRuntime",
) -> DataFrame:
    """Available and used CPUs, and the advised memory."""
    available = as_column(memory) / MEMORY_PER_CPU
    used = (as_column(user) + as_column(kernel)) / F.nullif(as_column(runtime), F.lit(0))
    base = F.when(available - used < 0.1, available * 1.1).otherwise(used)
    advice = F.rint(base * ADVICE_SLOPE + ADVICE_OFFSET).cast("bigint")
    return runs.withColumns(
        {
            "availableCPUs": round_exact(available, 3),
            "utilizedCPUs": round_exact(used, 3),
            "recommendedMemory": F.least(
                F.greatest(advice, F.lit(ADVICE_MIN)), F.lit(ADVICE_MAX)
            ),
        }
    )
