"""A bounded response cache replayed over a request log: which requests would have hit.

Eviction depends on the order of all requests of a cache, so that each cache (one per partition of the corpus, say) is
folded in order by one task, which holds at most its capacity of keys. Without a capacity, use a lag by key instead.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def replay(requests: DataFrame, cache: str, order: str, key: str, capacity: int = 500) -> DataFrame:
    """requests(cache, order, key) with `hit`. A hit makes a key the latest used; a full cache drops the one used
    longest ago before it takes a new key. The log is sorted by Spark and streamed, so that a task holds one cache."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        of: object = held
        for batch in batches:
            hits = []
            for c, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != of:
                    of = c
                    held.clear()
                hits.append(k in held)
                if hits[-1]:
                    held.move_to_end(k)
                    continue
                if len(held) >= capacity:
                    held.popitem(last=False)
                held[k] = None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    log = requests.select(cache, order, key)
    schema = ", ".join(f"`{c}` {t}" for c, t in log.dtypes) + ", hit boolean"
    return log.repartition(cache).sortWithinPartitions(cache, order).mapInArrow(fold, schema)
