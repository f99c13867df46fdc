"""What stays in a Python worker when a task of a corpus step has ended."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from zonemill.llm.tokens import encoder
from zonemill.llm.worker import lean

BATCH = pa.RecordBatch.from_pydict({"x": [1, 2]})


def _mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_other_steps_drop_encoders():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder.cache_clear()  # other tests fill it

    def step(batches):
        for batch in batches:
            encoder(path).encode(pa.array(["one two"]))
            yield batch
    assert [b.to_pydict() for b in lean(step, encodes=True)(iter([BATCH, BATCH]))] == [BATCH.to_pydict()] * 2
    assert encoder.cache_info().currsize == 1
    assert list(lean(step, encodes=True)(iter([]))) == [] and encoder.cache_info().currsize == 1
    assert [b.to_pydict() for b in lean(lambda b: b)(iter([BATCH]))] == [BATCH.to_pydict()]
    assert encoder.cache_info().currsize == 0


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_leaves_the_worker():
    pins = []

    def step(batches):
        blocks = [np.ones(5000) for _ in range(5000)]  # 200 MB in pieces that the allocator keeps
        pins.append(np.ones(5000))
        del blocks
        yield from batches
    before = _mb()
    list(lean(step)(iter([BATCH])))
    assert _mb() - before < 60
