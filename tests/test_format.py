import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.archive import Archive, save
from lamina.operators import crypto, dtype
from lamina.operators.layout import best_cuts
from lamina.operators.tree import flatten, restructure
from lamina.sources import format as codec

F4 = ("a.weight",), codec.PARAM, 0, "<f4", (2, 3), np.arange(6, dtype="<f4").tobytes()
I8 = ("a.count",), codec.BUFFER, 1, "<i8", (4,), np.arange(4, dtype="<i8").tobytes()
EMPTY = ("a.none",), codec.PARAM, 1, "<f2", (0, 3), b""
FLAG = ("a.flag",), codec.PARAM, 1, "|b1", (), b"\1"


def opened(arrays, **options):
    return Archive(io.BytesIO(codec.to_bytes(arrays)), **options)


def test_layout_of_a_plain_archive():
    raw = codec.to_bytes([F4, I8, EMPTY, FLAG])
    assert raw[:5] == bytes([0x7C, 0x54, 0x5A, 0x52, 0x7C]) and struct.unpack("<I", raw[5:9]) == (1,)
    header, entries = codec.read_header(f := io.BytesIO(raw)), None
    entries = codec.read_index(f, header.tensor_count)
    assert entries[0].header_offset == 262217 and header.tensor_bytes == 24 + 32 + 1
    assert [e.shape for e in entries] == [(2, 3), (4,), (0, 3), ()]
    assert raw[-8:] == bytes(8)


def test_round_trip_and_digests():
    a = opened([F4, I8, EMPTY, FLAG], verify=True)
    np.testing.assert_array_equal(a["a.weight"], np.arange(6, dtype="<f4").reshape(2, 3))
    assert a["a.none"].shape == (0, 3) and bool(a["a.flag"]) and len(a) == 4 and "a.count" in a
    ok, each = a.check({"a.weight": a["a.weight"], "a.count": a["a.count"] + 1, "a.none": a["a.none"], "a.flag": a["a.flag"]})
    assert not ok and dict(each) == {"a.weight": True, "a.count": False, "a.none": True, "a.flag": True}
    assert a.check({})[1][0] == ("a.weight", False)


def test_versions_opaque_and_declared_arrays():
    bf = (("b",), codec.STATE_DICT, 0, "<V2\0torch.bfloat16", (2,), np.array([0x3F80, 0xC000], "<u2").tobytes())
    meta = (("m",), codec.STATE_DICT, 0, "<V2\0torch.bfloat16", (3, 2), None)
    a = opened([bf])
    assert a.header.version == 2 and a["b"].tolist() == [1.0, -2.0]
    b = opened([bf, meta])
    assert b.header.version == 4 and b["m"].tolist() == [[0.0] * 2] * 3 and b.entries["m",].is_meta
    with pytest.raises(ValueError, match="raw"):
        list(a.read(raw=False))


def test_eight_bit_floats():
    e5m2, e4m3 = dtype.small_floats("float8_e5m2"), dtype.small_floats("float8_e4m3fn")
    assert e5m2[0x3C] == 1 and np.isinf(e5m2[0x7C]) and np.isnan(e5m2[0x7D]) and e5m2[0x01] == 2.0**-16
    assert e4m3[0x38] == 1 and e4m3[0x7E] == 448 and np.isnan(e4m3[0x7F])
    assert dtype.small_floats("float8_e8m0fnu")[127] == 1 and np.isnan(dtype.small_floats("float8_e4m3fnuz")[128])


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda r: b"x" + r[1:], "not an archive"), (lambda r: r[:5] + struct.pack("<I", 9) + r[9:], "version 9"), (lambda r: r[:40], "expected"),
        (lambda r: r[:9] + b"\2" + r[10:], "flags"), (lambda r: r[:65] + bytes(8) + r[73:], "empty index"),
    ],
)
def test_broken_headers(change, said):
    with pytest.raises(codec.FormatError, match=said):
        Archive(io.BytesIO(change(codec.to_bytes([F4]))))


def test_altered_payload_is_found():
    raw = bytearray(codec.to_bytes([F4]))
    raw[-9] ^= 1
    assert Archive(io.BytesIO(bytes(raw)))["a.weight"].shape == (2, 3)
    with pytest.raises(codec.FormatError, match="hash mismatch"):
        Archive(io.BytesIO(bytes(raw)), verify=True)["a.weight"]


def test_limits():
    with pytest.raises(codec.FormatError, match="overflow"):
        codec.to_bytes([F4], index_space=16)
    with pytest.raises(codec.FormatError, match="256"):
        codec.to_bytes([(("a",), 2, 0, "<V2\0" + "t" * 300, (1,), b"ab")])
    with pytest.raises(codec.FormatError, match="structured"):
        codec.to_bytes([(("a", 0), codec.PARAM, 0, "|u1", (1,), b"a")])
    with pytest.raises(codec.FormatError, match="NUL"):
        codec.split_dtype("a\0b\0c")


@pytest.mark.parametrize("raw", [b"", b"\x1e{}", b"\x1e[1.5]", b"\x1e[NaN]", b"\x1e[{}]", b"\x1e[]", b"\x1e[-1]", b"\x1e[\n1]", b"\x1e[true]", b"\x1e" + b"[" * 100000 + b"]" * 100000])
def test_bad_names(raw):
    with pytest.raises((codec.FormatError, RecursionError)):
        codec.decode_path(raw)


@given(st.lists(st.one_of(st.text(), st.integers(0, 2**40)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_names_round_trip(path):
    path = tuple(path)
    if len(path) == 1 and isinstance(path[0], str) and (not path[0] or path[0][0] == "\x1e"):
        return
    assert codec.decode_path(codec.encode_path(path)) == path


@pytest.mark.parametrize(
    "obj",
    [[np.uint8(i) for i in range(10)], {str(i): np.uint8(i) for i in range(10)}, [{str(i): np.uint8(i)} for i in range(10)],
     {str(i): [np.uint8(i), np.uint8(9 - i)] for i in range(10)}, [{str(i): np.uint8(i), str(9 - i): np.uint8(1)} for i in range(10)]],
)
def test_nested_structures(obj):
    out = io.BytesIO()
    save(obj, out)
    out.seek(0)
    a = Archive(out)
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else int(x)
    assert plain(a.tree()) == plain(obj)
    if isinstance(obj, list) and isinstance(obj[0], dict):
        assert plain(a.tree((1,))) == plain(obj[1]) and int(a.tree((0, "9" if len(obj[0]) > 1 else "0"))) == int(obj[0]["9" if len(obj[0]) > 1 else "0"])
    assert a.tree(("absent",), default=3) == 3
    with pytest.raises(TypeError):
        a.tree("absent")


def test_structure_errors_and_gaps():
    assert restructure([((5,), "b"), ((2,), "a")]) == ["a", "b"]
    for bad in ([(("a",), 1), (("a", "b"), 2)], [(("a",), 1), ((0,), 2)], [(("a",), 1), (("a",), 2)], [((), 1)]):
        with pytest.raises(ValueError):
            restructure(bad)
    with pytest.raises(TypeError):
        flatten({1: 2})
    with pytest.raises(TypeError):
        flatten(5)


def test_filters_limits_and_cursor():
    a = opened([(("t", k), 2, 0, "|u1", (1,), bytes([k])) for k in range(5)])
    names = [int(v[0]) for *_, v, _, _ in a.read(lambda p: p[1] % 2 == 0, 2)]
    assert names == [0, 2]
    assert [int(v[0]) for *_, v, _, _ in a.read(lambda p: p[1] % 2 == 0, 2, after=("t", 2))] == [4]
    assert list(a.read(n=0)) == []
    with pytest.raises(ValueError):
        list(a.read(n=-2))


def test_load_into():
    a, module = opened([F4, I8]), {"a": {}}
    assert a.load_into(module) == 2 and module["a"]["weight"].shape == (2, 3)
    with pytest.raises(ValueError):
        opened([(("x",), 2, 0, "|u1", (1,), b"a")]).load_into({})


@pytest.mark.skipif(not crypto.available(), reason="libsodium is not installed")
@pytest.mark.parametrize("size", [0, 5, 3000, 2 << 20, (2 << 20) + 7])
@pytest.mark.parametrize("passphrase", [False, True])
def test_encryption(size, passphrase):
    key, kdf = crypto.derive("test", bytes(16), "min") if passphrase else (b"k" * 32, None)
    data = np.random.default_rng(1).integers(0, 256, size).astype("u1").tobytes()
    raw = codec.to_bytes([(("x",), 0, 0, "|u1", (size,), data)], seal=crypto.sealer(key, kdf))
    assert size < 100 or data[:64] not in raw
    secret = "test" if passphrase else key
    assert Archive(io.BytesIO(raw), secret=secret, verify=True)["x"].tobytes() == data
    with pytest.raises(crypto.CryptographyError):
        Archive(io.BytesIO(raw))
    with pytest.raises(crypto.CryptographyError):
        Archive(io.BytesIO(codec.to_bytes([F4])), secret=key)
    if size:
        with pytest.raises(crypto.CryptographyError):
            Archive(io.BytesIO(raw), secret="tset" if passphrase else b"j" * 32)["x"]


@pytest.mark.skipif(not crypto.available(), reason="libsodium is not installed")
def test_sequential_cipher_and_nonces():
    body, mac = crypto.seal_chunk(b"hello", b"k" * 32, b"n" * 24)
    assert crypto.opened(body, codec.Crypt("sequential", None, b"n" * 24, [mac]), b"k" * 32) == b"hello"
    assert crypto.nonce_after(b"\xff" * 24, 1) == bytes(24)
    with pytest.raises(ValueError):
        crypto.derive("x", b"short")


def test_partitions():
    assert best_cuts([3, 3, 5, 3, 6], 4) == [0, 0, 1, 2, 3]
    cut = best_cuts([2, 8, 10, 5, 5], 3)
    assert max(sum(w for w, c in zip([2, 8, 10, 5, 5], cut) if c == k) for k in range(3)) == 10


@given(st.lists(st.integers(0, 50), min_size=1, max_size=9), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_partition_is_least(weights, parts):
    import itertools

    n, p = len(weights), min(parts, len(weights))
    best = min(max(sum(weights[a:b]) for a, b in itertools.pairwise((0, *c, n))) for c in itertools.combinations(range(1, n), p - 1))
    cut = best_cuts(weights, parts)
    assert cut == sorted(cut) and len(set(cut)) == p
    assert max(sum(w for w, c in zip(weights, cut) if c == k) for k in range(p)) == best
