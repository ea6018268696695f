import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelens.llm import common


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_sift_loses_no_key_and_without_is_exact(spark, n):
    df = spark.range(20_000).selectExpr("id % 10000 AS k", "id AS v", "1 AS bits", "2 AS _bits", "3 AS bucket")
    keys = spark.range(n).selectExpr("id * 3 AS k")
    own = {r.k for r in keys.collect()}
    seen = common.sift(df, "k", keys, "maybe").collect()
    assert len(seen) == 20_000 and all(r.maybe for r in seen if r.k in own)
    assert sum(r.maybe for r in seen if r.k not in own) < 0.02 * 20_000
    left = common.without(df, "k", keys)
    assert left.columns == df.columns
    assert sorted(r.v for r in left.collect()) == [i for i in range(20_000) if i % 10_000 not in own]


def test_sieve_of_text_and_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in common.without(df, "k", df.where("k = 'a'")).orderBy(F.col("k").asc_nulls_first()).collect()] == [None, "b"]


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Undefined:
        def isDefined(self):
            return False

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://far:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(Undefined)})

    with pytest.raises(ValueError):
        common.shared_folder(Spark())


def test_text_slices_hold_one_range_at_a_time_and_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(1))
    texts = [None, "é" * 10, "", *(str(i % 10) * 100_000 for i in range(200))]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "t": texts})
    got, most = [], 0
    tracemalloc.start()
    for part, some in common.text_slices(batch.slice(1), "t"):
        assert part.num_rows == len(some)
        most = max(most, tracemalloc.get_traced_memory()[0])
        got += [(k, len(t), t[:2]) for k, t in zip(part.column(0).to_pylist(), some)]
    tracemalloc.stop()
    assert got == [(k, len(b), b[:2]) for k, t in enumerate(texts) for b in [(t or "").encode()]][1:]
    assert most < 5_000_000 and given == [1]
    assert [t for _, t in common.text_slices(batch.slice(0, 1), "t")] == [[b""]] and not list(common.text_slices(batch.slice(0, 0), "t"))
