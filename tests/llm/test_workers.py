"""Memory of Python workers."""

import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from paperloom.llm import words as W
from paperloom.llm.workers import giving_back


def test_a_worker_gives_back_what_its_task_has_freed(spark):
    def run(batches):
        for batch in batches:
            small = [bytearray(50_000) for _ in range(4000)]  # too small to be mapped apart: freed, but kept by the process
            sys.pinned = bytearray(50_000)  # stays above them
            del small
            yield batch

    def rest(batches):
        for _ in batches:
            with open("/proc/self/smaps_rollup") as f:
                held = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024
            yield pa.RecordBatch.from_arrays([pa.array([held])], ["mb"])

    one = spark.range(0, 1, 1, 1)
    before = one.mapInArrow(rest, "mb double").first()["mb"]
    one.mapInArrow(giving_back(run), "id long").collect()
    assert one.mapInArrow(rest, "mb double").first()["mb"] < before + 60

    assert [r.id for r in spark.range(5).mapInArrow(giving_back(lambda batches: batches), "id long").orderBy("id").collect()] == list(range(5))


def test_hashes_of_a_block_need_no_second_array_of_its_size():
    data = np.frombuffer(bytes(range(97, 123)) * 100_000, dtype=np.uint8)
    W.RangeHash(data[:1000])
    tracemalloc.start()
    hashed = W.RangeHash(data)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert hashed.sums.nbytes <= size < peak < 1.5 * hashed.sums.nbytes
    base, total = W._BASE, 0
    for k, b in enumerate(data[:3000].tolist()):
        total = (total + (b + 1) * pow(base, k, 1 << 64)) % (1 << 64)
        assert int(hashed.sums[k + 1]) == total
    start, end = np.array([5, 2_000_005]), np.array([9, 2_000_009])
    assert W.RangeHash(data[2_000_005:2_000_009])(np.array([0]), np.array([4])) == hashed(start[1:], end[1:])
