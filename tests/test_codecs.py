"""Round trips, sizes and selection of codecs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from blockloom.operators.codecs import backends, cascade, logical, physical, pool, register, registry, select

SMALL = np.array([10, 1, 9, 3, 4, 5, 6, 7, 2, 8], np.int32)
NEGATIVE = np.array([-7, 3, -2, -2, 5, 0], np.int32)
BORDERS = np.array([0, 127, 128, 16383, 16384, 255, 256, 65535, 65536, 2**28 - 1], np.int32)


def large():
    rng = np.random.default_rng(42)
    top = 2**28 - 1
    return np.array([x for i in range(64) for x in (i, i, top - i, int(rng.integers(0, top + 1)))], np.int32)


ALL = pool("pipeline")
CASES = [SMALL, NEGATIVE, BORDERS, large(), np.arange(512, dtype=np.int32), np.array([], np.int32), np.array([-(2**31), 2**31 - 1] * 20, np.int32)]


@pytest.mark.parametrize("codec", ALL, ids=lambda c: c.name)
def test_round_trips(codec):
    for values in CASES:
        back = codec.decode(codec.encode(values), len(values))
        assert back.dtype == np.int32 and np.array_equal(back, values)


@settings(max_examples=40, deadline=None)
@given(arrays(np.int32, st.integers(0, 90)))
def test_round_trips_of_anything(values):
    for codec in pool():
        assert np.array_equal(codec.decode(codec.encode(values), len(values)), values), codec.name


def integers(name, values):
    return next(c for c in logical() if c.name == name).as_integers(values).tolist()


def test_logical_goldens():
    assert integers("custom_delta_unvec", SMALL) == [10, 17, 16, 11, 2, 2, 2, 2, 9, 12]
    assert integers("custom_delta_vecsse", SMALL) == [20, 17, 1, 13, 11, 2, 4, 6, 3, 12]
    assert integers("custom_delta_vecavx", SMALL) == [20, 2, 18, 6, 8, 10, 12, 14, 9, 12]
    assert integers("custom_delta_vecavx512", SMALL) == [20, 17, 16, 11, 2, 2, 2, 2, 9, 12]
    assert integers("custom_for_unvec", SMALL) == [1, 18, 0, 16, 4, 6, 8, 10, 12, 2, 14]
    assert integers("custom_delta_unvec", NEGATIVE) == [-7, 20, 9, 0, 14, 9]
    assert integers("custom_for_vecavx", NEGATIVE) == [-7, 0, 20, 10, 10, 24, 14]
    assert integers("custom_rle_vecsse", NEGATIVE) == [-7, 1, 3, 1, -2, 2, 5, 1, 0, 1]
    longer = np.array([(7 * i * i + 3 * i) % 101 for i in range(48)], np.int32)
    for name, total, some in (("vecsse", 3296, [23, 64, 156, 74]), ("vecavx", 3497, [44, 100, 200, 110]), ("vecavx512", 3656, [44, 88, 132, 25])):
        got = integers(f"custom_delta_{name}", longer)
        assert (sum(got), got[16:20]) == (total, some)
    assert sum(integers("custom_delta_unvec", longer)) == 2926


def test_sizes():
    u = lambda v: v.view(np.uint32)
    assert backends.width_of(u(SMALL)) == 4 and len(backends.Varint().encode(u(SMALL))) == 10 and len(backends.StreamVbyte().encode(u(SMALL))) == 13
    assert len(backends.Varint().encode(u(BORDERS))) == 23 and len(backends.StreamVbyte().encode(u(BORDERS))) == 22
    narrow, wide = np.arange(256, dtype=np.uint32) % 4, np.arange(256, dtype=np.uint32) * 65537
    for b in (backends.Bitpack(), backends.Frame(), backends.PatchedFrame(), backends.Varint(), backends.StreamVbyte(), backends.WordAligned()):
        assert len(b.encode(narrow)) < len(b.encode(wide))
    noise = np.random.default_rng(0).integers(0, 2**32, 500, dtype=np.uint64).astype(np.uint32)
    assert len(backends.ByteRuns().encode(noise)) == 2001 and len(backends.ByteRuns().encode(np.zeros(500, np.uint32))) < 30


def test_pools_and_selection():
    every = pool()
    assert len(logical()) == 12 and len({c.name for c in every}) == len(every)
    assert len(ALL) == len(every) + 3 * len(physical()) + 1
    assert select(every, ["all"]) == select(every, ["*"]) == every
    assert [c.name for c in select(every, ["STREAMVBYTE", "DEFLATE", "DEFLATE"])] == ["DEFLATE", "STREAMVBYTE"]
    assert select(every, ["no_such_codec_xyz_999"]) == []
    assert all(c.name.startswith("[+]_custom_rle_unvec+") for c in pool("custom_rle_unvec"))
    with pytest.raises(ValueError):
        pool("no_such_codec")
    with pytest.raises(ValueError):
        registry.by_name("no_such_codec")


def test_only_integers_go_on():
    first = {c.name: c for c in (*logical(), *physical())}
    with pytest.raises(ValueError):
        cascade(first["LZ4"], first["DEFLATE"])
    both = registry.by_name("[+]_custom_delta_vecavx+TurboPFor_Delta+TurboPFor256")
    assert np.array_equal(both.decode(both.encode(BORDERS), 10), BORDERS)


def test_users_add_codecs():
    own = registry.Codec("halves", lambda v: v.astype("<i4").tobytes(), lambda d, n: np.frombuffer(d, "<i4").astype(np.int32))
    register(own)
    try:
        assert registry.by_name("halves") is own and own in pool()
    finally:
        registry._ADDED.clear()
