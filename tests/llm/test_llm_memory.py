"""A worker that has done its task holds no memory that it does not use."""

import os
from pathlib import Path

import pyarrow as pa
import pytest

from abacora.llm import _shared


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="memory can't be read here")
def test_lean_gives_back_what_a_task_has_freed():
    held = []

    def run(batches):
        parts = [bytes(bytearray(100_000)) for _ in range(2000)]
        held.append(parts[-1])  # above all that is freed, so the heap can't shrink by itself
        del parts
        held.append(resident_mb())
        yield from batches

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    assert list(_shared.lean(run)(iter([batch]))) == [batch]
    assert resident_mb() < held[1] - 100
