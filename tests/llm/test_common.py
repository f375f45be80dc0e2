import numpy as np

from matricula.llm.common import bitmap, in_bitmap


def test_bitmap_holds_residues_of_all_numbers(spark):
    rng = np.random.default_rng(6)
    numbers = [0, 1, -1, 7, 8, 32767, 32768, 32769, 65536, 2**63 - 1, -(2**63), *rng.integers(-(2**63), 2**63 - 1, 300).tolist()]
    packed = bitmap(spark.createDataFrame([(x,) for x in numbers], "k long"), "k", 1 << 17)
    assert in_bitmap(packed, np.array(numbers, dtype=np.int64)).all()
    known = {x % (1 << 17) for x in numbers}
    found = in_bitmap(packed, np.arange(1 << 17))
    assert set(np.flatnonzero(found).tolist()) == known
    assert not in_bitmap(bitmap(spark.createDataFrame([], "k long"), "k", 1 << 17), np.array(numbers, dtype=np.int64)).any()
