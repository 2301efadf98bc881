import pickle

import pytest

from arrayspark.errors import MESSAGES, strerror
from arrayspark.functions.parser import Node, parse
from arrayspark.functions.udf import Registry
from arrayspark.meta import ArrayError, ArrayMeta
from arrayspark.plans.advice import advise, l2_size


@pytest.mark.parametrize(
    "shape, chunk, block",
    [
        ((1_000_000,), (131072,), (8192,)), ((1,), (1,), (1,)), ((15000, 1112000), (32, 4096), (8, 1024)),
        ((513, 257), (256, 256), (64, 128)), ((17000, 3000, 300000), (32, 4, 1024), (8, 2, 512)), ((17000, 3000, 30000, 10000), (32, 4, 32, 32), (16, 2, 16, 16)),
    ],
)
def test_advice(shape, chunk, block):
    assert advise("f64", shape, 0, 1 << 20, 0, 64 << 10) == (chunk, block)


def test_meta_checks_and_json():
    m = ArrayMeta("f32", (4, 0, 3), (2, 1, 3), attrs={"k": b"\x00\x01"})
    assert m.size == 0 and m.nbytes == 0 and m.strides == (0, 3, 1) and m.grid == (2, 0, 1)
    back = ArrayMeta.from_json(m.to_json())
    assert back == m and back.attrs == m.attrs
    for bad in (lambda: ArrayMeta("f64", (1,) * 9), lambda: ArrayMeta("f64", (-1,)), lambda: ArrayMeta("f16", (1,)), lambda: ArrayMeta("f64", (2, 2), (1,)), lambda: ArrayMeta("f64", (2,)).axis(1)):
        with pytest.raises(ArrayError):
            bad()


def test_parser_precedence():
    n = lambda v: Node("number", value=float(v))
    x = Node("name", value="x")
    assert parse("2^3^2") == Node("^", (Node("^", (n(2), n(3))), n(2)))
    assert parse("-x^2", {"x"}) == Node("^", (Node("neg", (x,)), n(2)))
    assert parse("--x", {"x"}) == x
    assert parse("sin x ** 2", {"x"}) == Node("^", (Node("call", (x,), "sin"), n(2)))
    assert parse("1 - 2 - 3") == Node("-", (Node("-", (n(1), n(2))), n(3)))
    assert parse("sin", {"sin"}) == Node("name", value="sin")  # a bound name shadows a function


@pytest.mark.parametrize("bad", ["x +", "a,b", "(a,b)", "foo", "(x", "x y", "min(x)", "pow(x,x,x)", "", "x $ 2", "atan2 x"])
def test_parser_errors(bad):
    with pytest.raises(ArrayError):
        parse(bad, {"x", "a", "b"})


def test_registry():
    r = Registry()
    lib = r.library("m").register("f", lambda x: x, 1)
    assert r.has("m.f") and r.has("m.f()") and not r.has("f") and not r.has("m.f.g") and not r.has("m.g")
    with pytest.raises(ArrayError):
        lib.register("f", lambda x: x, 1)
    with pytest.raises(ArrayError):
        lib.register("none", lambda: 0, 0)
    r.free("m")
    with pytest.raises(ArrayError):
        r.lookup("m.f")


def test_messages(tmp_path):
    assert all(strerror(k) for k in MESSAGES)
    for code, bad in (("INVALID_DTYPE", lambda: ArrayMeta("f16", (1,))), ("INVALID_NDIM", lambda: ArrayMeta("f64", (1,) * 9)), ("INVALID_SHAPE", lambda: ArrayMeta("f64", (-1,))), ("INVALID_BLOCKSHAPE", lambda: ArrayMeta("f64", (2,), (1,), (0,))), ("INVALID_AXIS", lambda: ArrayMeta("f64", (2,)).axis(1))):
        with pytest.raises(ArrayError) as e:
            bad()
        assert e.value.code == code and strerror(e.value) == MESSAGES[code]
        assert pickle.loads(pickle.dumps(e.value)).code == code
    assert l2_size() > 0 and l2_size(str(tmp_path)) == 256 << 10
    with pytest.raises(ArrayError):
        strerror("x")
