"""What a worker takes for large batches of text."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import neardup, quality


class Batches:
    """Stands for a DataFrame; keeps the function that workers would run."""

    schema = {"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def mapInArrow(self, work, schema):  # noqa: N802
        self.work = work
        return self

    def groupBy(self, *columns):  # noqa: N802
        return self

    agg = groupBy


@pytest.mark.parametrize("of", ["words", "sketches"])
def test_memory_follows_slices_and_not_batches(spark, of):
    draw = random.Random(1)
    vocabulary = [f"w{draw.randrange(10**6)}" for _ in range(20_000)]
    texts = pa.array([" ".join(draw.choices(vocabulary, k=1000)) for _ in range(600)])
    table = Batches()
    if of == "words":
        quality.word_counts(table, SimpleNamespace(value=(np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.float32))))
        batch = pa.RecordBatch.from_arrays([texts, pa.array([False] * len(texts))], names=["text", "bad"])
    else:
        neardup._sketches(table)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in table.work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= len(texts)
    assert peak < {"words": 180, "sketches": 45}[of] << 20  # 240 and 62 MB in slices of 2 MB or more
