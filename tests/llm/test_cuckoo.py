import numpy as np

from sparkloom.llm.linededup import Cuckoo


def test_cuckoo_round_trip():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(32) + np.uint64(5)  # a shard's keys share low bits
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(32) + np.uint64(6)
    f = Cuckoo()
    for part in np.array_split(keys, 7):
        f.insert(part)
    f = Cuckoo.load(f.dump())
    assert f.has(keys).all()
    assert f.has(other).mean() < 0.01
    f.delete(keys[:500])
    assert f.has(keys[500:]).all()
    assert f.has(keys[:500]).mean() < 0.02


def test_deletions_from_later_parts_leave_the_earlier_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    f = Cuckoo()
    for part in np.array_split(keys, 40):
        f.insert(part)
    assert len(f.parts) > 2
    first = np.zeros(len(keys), bool)
    alone = Cuckoo()
    for part in np.array_split(np.arange(len(keys)), 40):
        alone.insert(keys[part])
        if len(alone.parts) > 2:
            break
        first[part] = True
    f.delete(keys[~first])
    assert f.has(keys[first]).all()
    assert f.has(keys[~first]).mean() < 0.02
