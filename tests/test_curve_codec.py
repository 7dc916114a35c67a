import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeflow.functions import codec, curve

# Points of the curve and their codes.
KNOWN = [
    (255, 0, 65535), (0, 255, 21845), (255, 255, 43690), (256, 256, 131072), (65535, 65535, 2863311530), (65536, 0, 4294967296),
    (0, 65536, 15748213418), (100000, 7, 5370080277), (7, 100000, 16110079637), (2**31 - 1, 0, 1537228672809129301),
    (0, 2**31, 4611686018427387904), (2**31, 0, 16909515400900422314), (3563602788, 1, 17382415444617445043),
    (2**32 - 1, 0, 18446744073709551615), (2**32 - 1, 2**32 - 1, 12297829382473034410),
]
FIRST = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 2), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1), (2, 0), (3, 0)]
GAPS = {1: "01", 2: "02", 255: "FF", 256: "000100", 43687: "00AAA7", 65536: "0000010000", 2**20: "0000100000", 2**60: "00" * 7 + "10" + "00" * 7}


def test_known_codes():
    x, y, c = (np.array(v, np.uint64) for v in zip(*KNOWN, strict=True))
    assert (curve.encode_array(x, y) == c).all()
    assert curve.encode_array(*np.array(FIRST).T).tolist() == list(range(16))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=50))
def test_bijection(points):
    x, y = np.array(points, np.uint64).T
    u, v = curve.decode_array(curve.encode_array(x, y))
    assert (u == x).all() and (v == y).all()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 2))
def test_neighbours(code):
    x, y = curve.decode_array(np.array([code, code + 1], np.uint64))
    assert abs(int(x[0]) - int(x[1])) + abs(int(y[0]) - int(y[1])) == 1


def test_native_equals_arrow(spark):
    rows = spark.createDataFrame([(x, y) for x, y, _ in KNOWN], "x long, y long")
    got = rows.select(
        curve.hilbert_code("x", "y").alias("a"), curve.hilbert_code_native(F.col("x"), F.col("y")).alias("b"), curve.unsigned(curve.hilbert_code("x", "y")).alias("u")
    ).collect()
    assert [int(r["u"]) for r in got] == [c for *_, c in KNOWN] and all(r["a"] == r["b"] for r in got)


def test_codec(spark):
    rows = spark.createDataFrame([(g,) for g in GAPS], "g long")
    got = {r["g"]: (r["h"], r["n"]) for r in rows.select("g", codec.delta_hex(F.col("g")).alias("h"), codec.delta_length(F.col("g")).alias("n")).collect()}
    assert got == {g: (h, len(h) // 2) for g, h in GAPS.items()}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), max_size=20))
def test_delta_round_trip(gaps):
    data = b"".join(bytes((g.bit_length() + 7) // 8 - 1) + g.to_bytes((g.bit_length() + 7) // 8, "big") for g in gaps)
    assert codec.delta_decode(data) == gaps
    if gaps and gaps[-1] > 255:
        with pytest.raises(ValueError):
            codec.delta_decode(data[:-1])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 2**64 - 1), max_size=20), st.integers(1, 7))
def test_delta_streams_in_pieces(gaps, size):
    data = codec.delta_encode(np.array(gaps, np.uint64))
    assert data == b"".join(bytes((g.bit_length() + 7) // 8 - 1) + g.to_bytes((g.bit_length() + 7) // 8, "big") for g in gaps)
    stream = codec.DeltaStream()
    assert [g for i in range(0, len(data), size) for g in stream.feed(data[i : i + size]).tolist()] == gaps
    stream.close()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_leb128_round_trip(values):
    data, size = codec.leb128(np.array(values, np.uint64))
    got, start = codec.leb128_decode(np.frombuffer(data, np.uint8))
    assert got.tolist() == values and np.diff(start, append=len(data)).tolist() == size.tolist()
    assert size.tolist() == [max(1, -(-v.bit_length() // 7)) for v in values]


def test_leb128(spark):
    assert codec.leb128(np.array([5, 295, 1]))[0].hex() == "05a70201"
    with pytest.raises(ValueError):
        codec.leb128_decode(np.frombuffer(b"\x05\xa7", np.uint8))
    values = [0, 1, 127, 128, 16383, 16384, 2**40]
    got = spark.createDataFrame([(v,) for v in values], "g long").select(codec.leb128_length(F.col("g")).alias("n")).collect()
    assert [r["n"] for r in got] == codec.leb128(np.array(values))[1].tolist()


def test_native_code_of_wide_ids_raises(spark):
    wide = spark.createDataFrame([(1 << 32, 0)], "x long, y long")
    with pytest.raises(Exception, match="over 32 bits"):
        wide.select(curve.hilbert_code_native(F.col("x"), F.col("y"))).collect()


def test_native_code_takes_few_steps(spark):
    """A step looks several bits of both axes up at once, and the codes are those of the arrays."""
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 1 << 32, (2, 500))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x long, y long")
    got = [r[0] for r in df.select(curve.hilbert_code_native(F.col("x"), F.col("y"))).collect()]
    assert got == curve.encode_array(x, y).view(np.int64).tolist()
    assert len(range(0, curve.BITS, curve.STEP)) <= 8
