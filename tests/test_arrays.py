"""Array operators against numpy, over small and ragged shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayspark.array import NDArray
from arrayspark.functions.expressions import Expression, evaluate
from arrayspark.functions.udf import Registry
from arrayspark.meta import DTYPES, ArrayError, ArrayMeta
from arrayspark.operators import chunks, compare, create, index, linalg
from arrayspark.operators import random as rnd
from arrayspark.operators import reduce as red

pytestmark = pytest.mark.filterwarnings("ignore")
M = np.arange(120.0).reshape(10, 12)


@pytest.fixture(scope="module")
def m(spark):
    return NDArray.from_numpy(spark, M)


def same(a: NDArray, want: np.ndarray) -> None:
    got = a.to_numpy()
    assert got.shape == np.shape(want)
    np.testing.assert_allclose(got.astype(float), np.asarray(want).astype(float), rtol=5e-14, atol=5e-15)


@pytest.mark.parametrize("kind", list(DTYPES))
def test_buffer_round_trip(spark, kind):
    x = (np.arange(24) % 2 == 1) if kind == "bool" else np.arange(24).astype(DTYPES[kind].numpy)
    if kind == "u64":
        x[0] = 2**64 - 1
    a = NDArray.from_numpy(spark, x.reshape(2, 3, 4))
    assert (a.to_numpy() == x.reshape(2, 3, 4)).all() and a.dtype.name == kind


@pytest.mark.parametrize(
    "text, want",
    [
        ("(x - 2.3) * (x - 1.35) * (x + 4.2)", lambda x: (x - 2.3) * (x - 1.35) * (x + 4.2)),
        ("(abs(-x) - 1.35) * ceil(x) * floor(x - 8.5)", lambda x: (abs(x) - 1.35) * np.ceil(x) * np.floor(x - 8.5)),
        ("(x - 1.35) + sin(.45)", lambda x: x - 1.35 + np.sin(0.45)),
        ("sinh(x) + (cosh(x) - 1.35) - tanh(x + .2)", lambda x: np.sinh(x) + np.cosh(x) - 1.35 - np.tanh(x + 0.2)),
        ("arcsin(x) + (arccos(x) - 1.35) - arctan(x + .2)", lambda x: np.arcsin(x) + np.arccos(x) - 1.35 - np.arctan(x + 0.2)),
        ("atan2(x, 2) + pow(x, 2) - power(x, 3.141592)", lambda x: np.arctan2(x, 2) + x**2 - x**3.141592),
        ("min(x, 0.345) + max(x, 0.3)", lambda x: np.minimum(x, 0.345) + np.maximum(x, 0.3)),
        ("exp(x) + (log(x) - 1.35) - log10(x + .2)", lambda x: np.exp(x) + np.log(x) - 1.35 - np.log10(x + 0.2)),
        ("-x^2 + 2^3^2 + sin(x)^2 - --x", lambda x: x * x + 64 + np.sin(x) ** 2 - x),
        ("x / (x - x) + x % 0 + sqrt(-x) + log(-x)", lambda x: np.full_like(x, np.nan)),
        ("x / (x - x)", lambda x: x / (x - x)),
    ],
)
def test_expressions(spark, text, want):
    x = np.arange(10 * 23 * 3).reshape(10, 23, 3) / 690
    with np.errstate(all="ignore"):
        same(evaluate(text, x=NDArray.from_numpy(spark, x)), want(x))


@pytest.mark.parametrize("kind", ["i64", "i32", "i16", "i8"])
def test_whole_numbers_wrap(spark, kind):
    i = np.iinfo(DTYPES[kind].numpy)
    y = np.array([i.min, i.max, -1, 0, 1, 7, i.max // 2, -i.max // 3], DTYPES[kind].numpy)
    z = np.array([3, 2, -1, 5, i.max, 2, 3, -2], DTYPES[kind].numpy)
    a, b = NDArray.from_numpy(spark, y), NDArray.from_numpy(spark, z)
    with np.errstate(all="ignore"):
        for got, want in ((a + b, y + z), (a - b, y - z), (a * b, y * z), (evaluate("abs(x) + min(x, 3) - max(x, 2)", x=a), np.abs(y) + np.minimum(y, 3).astype(y.dtype) - np.maximum(y, 2).astype(y.dtype))):
            assert (got.to_numpy() == want).all()
    cut = [abs(int(p)) // abs(int(q)) * (1 if (p < 0) == (q < 0) else -1) for p, q in zip(y, z, strict=True)]
    assert [int(v) for v in (a / b).to_numpy()] == [(c - i.min) % 2**i.bits + i.min for c in cut]
    with pytest.raises(TypeError):
        evaluate("sin(x)", x=a)


def test_f32_rounds_at_each_step(spark):
    x = np.linspace(0.1, 9, 50, dtype="float32")
    want = ((x - np.float32(3.3)) * x).astype("float32") / np.float32(7.7)
    assert (evaluate("(x - 3.3) * x / 7.7", x=NDArray.from_numpy(spark, x)).to_numpy() == want).all()


def test_expression_checks(spark, m):
    with pytest.raises(ArrayError):
        Expression("u8")
    with pytest.raises(ArrayError):
        Expression("f32").bind("x", m)
    with pytest.raises(ArrayError):
        evaluate("x + y", x=m, y=create.zeros(spark, (12, 10)))
    with pytest.raises(ArrayError):
        Expression("f64").compile("1 + 1").eval()
    b = Expression("bool").bind("x", NDArray.from_numpy(spark, np.array([True, False]))).compile("min(x, 1)").eval()
    assert b.to_numpy().tolist() == [True, False]


def test_aligned_operands_need_no_join(spark, m):
    plan = evaluate("x * y + z", x=m, y=m.astype("f64"), z=m * 2).df._jdf.queryExecution().toString()
    assert "Join" not in plan
    same(evaluate("x + y", x=m, y=m.T.T), M + M)


@pytest.mark.parametrize("source", list(DTYPES))
def test_type_views(spark, source):
    kind = DTYPES[source]
    if source == "bool":
        v = np.array([True, False])
    elif kind.floating:
        v = np.array([-2.7, 3.9, 0.0, 100.5], kind.numpy)
    else:
        i = np.iinfo(kind.numpy)
        v = np.array([i.min, i.max, 0, 5], kind.numpy)
    a = NDArray.from_numpy(spark, v)
    for target in index.VIEW_CASTS[source].split():
        want = v.astype("int64").astype(DTYPES[target].numpy) if kind.floating and target[0] == "u" else v.astype(DTYPES[target].numpy)
        view = index.type_view(a, target)
        assert view.is_view and (view.to_numpy() == want).all()
    for target in set(DTYPES) - {source} - set(index.VIEW_CASTS[source].split()):
        with pytest.raises(ArrayError):
            index.type_view(a, target)


_N = M.copy()
_N[0, :3] = np.nan
_N[3, :] = np.nan


@pytest.mark.parametrize("f", "sum prod max min mean var std median".split())
@pytest.mark.parametrize("axis", [0, 1, (0, 1)])
def test_reductions_with_nan(spark, f, axis):
    a = NDArray.from_numpy(spark, _N)
    same(red.reduce(a, f, axis), getattr(np, f)(_N, axis=axis))
    same(red.reduce(a, "nan" + f, axis), getattr(np, "nan" + f)(_N, axis=axis))


@pytest.mark.parametrize("kind", ["i64", "i32", "i16", "i8", "u64", "u32", "u16", "u8"])
def test_whole_reductions(spark, kind):
    y = np.arange(1, 41).reshape(2, 20).astype(DTYPES[kind].numpy)
    a = NDArray.from_numpy(spark, y)
    wide = "uint64" if kind[0] == "u" else "int64"
    for f, want in (("sum", y.sum(0, dtype=wide)), ("max", y.max(0)), ("min", y.min(0)), ("mean", y.mean(0)), ("median", np.median(y, 0)), ("all", y.all(0)), ("any", y.any(0))):
        assert (red.reduce(a, f, 0).to_numpy() == want).all(), f
    assert (red.reduce(a, "prod", 1).to_numpy() == np.prod(y, axis=1, dtype=wide)).all()


def test_reduction_checks(spark, m):
    same(red.reduce(m, "var", 1, correction=1), M.var(1, ddof=1))
    same(red.reduce(m, "var", (0, 1), correction=1, compat_correction=True), M.var() * 120 / (9 * 11))
    for bad in ({"func": "sum", "correction": 1}, {"func": "var", "oneshot": False}, {"func": "sum", "axis": (1, 1)}, {"func": "sum", "axis": 2}, {"func": "mode"}):
        with pytest.raises(ArrayError):
            red.reduce(m, **bad)
    with pytest.raises(ArrayError):
        red.reduce(m.astype("i32"), "nansum")
    none = create.zeros(spark, (0,))
    assert red.reduce(none, "sum").to_numpy() == 0 and red.reduce(none, "prod").to_numpy() == 1 and red.reduce(none, "all").to_numpy() and not red.reduce(none, "any").to_numpy()
    with pytest.raises(ArrayError):
        red.reduce(none, "max")


def test_medians_of_large_groups(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(3, 4001)), 2)
    x[1, 7] = np.nan
    x[2] = 1.5
    x[2, :10] = 3
    a = NDArray.from_numpy(spark, x)
    monkeypatch.setattr(red, "MEDIAN_CELLS", 40)
    same(red.reduce(a, "median", 1), np.median(x, axis=1))
    same(red.reduce(a, "nanmedian", 1), np.nanmedian(x, axis=1))
    same(red.reduce(a, "nanmedian"), np.nanmedian(x))
    same(red.reduce(NDArray.from_numpy(spark, np.arange(1000)), "median"), np.median(np.arange(1000)))
    same(red.reduce(NDArray.from_numpy(spark, np.full(100, np.nan)), "nanmedian"), np.nan)


def test_user_reduction(spark, m):
    same(red.reduce_udf(m, lambda v: np.ptp(v), 1), np.ptp(M, axis=1))
    assert red.reduce_udf(m, len, None, "i64").to_numpy() == 120


def test_boxes_and_lists(spark, m):
    same(index.get_slice(m, [2, -5], [-1, 12]), M[2:-1, -5:12])
    same(m[3, 2:5], M[3, 2:5])
    c = M.copy()
    c[2:4, 3:6] = 1
    same(index.set_slice(m, [2, 3], [4, 6], create.ones(spark, (2, 3))), c)
    same(index.get_orthogonal(m, [[3, 1, 3], [0, -1]]), M[np.ix_([3, 1, 3], [0, 11])])
    c = M.copy()
    c[np.ix_([3, 1], [0, 11])] = [[1, 2], [3, 4]]
    same(index.set_orthogonal(m, [[3, 1], [0, 11]], np.array([[1.0, 2], [3, 4]])), c)
    c[3] = [7.0 if k in (0, 11) else v for k, v in enumerate(c[3])]
    assert index.set_orthogonal(m, [[3, 3], [0]], np.array([[1.0], [2.0]])).to_numpy()[3, 0] == 2  # the last one counts
    assert index.get_slice_buffer(m, [0, 0], [1, 2]) == M[0, :2].tobytes()
    for bad in (lambda: index.get_slice(m, [5, 0], [2, 3]), lambda: index.get_slice(m, [0], [1]), lambda: index.get_orthogonal(m, [[10], [0]]), lambda: index.set_slice_buffer(m, [-2, 0], [-1, 2], b""), lambda: m[::2], lambda: index.set_slice(m.T, [0, 0], [1, 1], create.ones(spark, (1, 1)))):
        with pytest.raises(ArrayError):
            bad()


def test_shape_changes(spark, m):
    def resized(shape, start):
        out = M
        for k, (n, s) in enumerate(zip(shape, start, strict=True)):
            d = n - out.shape[k]
            out = np.insert(out, [s] * d, 0, axis=k) if d > 0 else np.delete(out, slice(s, s - d), k)
        return out

    for shape, start in (((15, 8), (10, 8)), ((7, 20), (2, 5)), ((20, 25), (10, 5)), ((10, 12), (0, 0))):
        same(index.resize(m, shape, start), resized(shape, start))
    same(index.insert(m, np.ones((10, 5)), 1, 5), np.insert(M, [5] * 5, 1, axis=1))
    same(index.append(m, np.ones((2, 12)), 0), np.append(M, np.ones((2, 12)), 0))
    same(index.delete(m, 1, 2, 5), np.delete(M, slice(2, 7), 1))
    same(m.T, M.T)
    same(index.squeeze(index.get_slice(m, [3, 0], [4, 12])), M[3])
    with pytest.raises(ArrayError):
        index.squeeze(m, [0])
    with pytest.raises(ArrayError):
        index.insert(m, np.ones((9, 5)), 1, 5)


@pytest.mark.parametrize("size", [(3, 5), (10, 12), (1, 1), (4, 7)])
def test_chunks(spark, size):
    a = create.copy(NDArray.from_numpy(spark, M), chunkshape=size)
    same(chunks.from_chunks(chunks.to_chunks(a), a.meta), M)
    same(chunks.map_chunks([a, a], lambda i, at, p: i[0] + i[1] * p[0] + at[0], [2.0]), 3 * M + (np.arange(10) // size[0] * size[0])[:, None])
    for at, block in chunks.blocks(a, size):
        assert (block == M[at[0] : at[0] + size[0], at[1] : at[1] + size[1]]).all()
    same(chunks.from_blocks(spark, "f64", (10, 12), lambda at, n: M[at[0] : at[0] + n[0], at[1] : at[1] + n[1]], size), M)


def test_split_and_gather(spark):
    a = create.copy(NDArray.from_numpy(spark, M), chunkshape=(4, 5))
    parts = chunks.split(a)
    assert [p.shape for p in parts][:3] == [(4, 5), (4, 5), (4, 2)]
    same(chunks.concatenate(parts, a.meta), M)
    a = create.copy(NDArray.from_numpy(spark, M), chunkshape=(5, 4))
    same(chunks.from_chunk_index(a, (5, 8), [4, 0]), np.hstack([M[5:, 4:8], M[:5, :4]]))
    with pytest.raises(ArrayError):
        chunks.from_chunk_index(a, (5, 8), [0])
    assert [f for _, f, _ in index.items(a)][:6] == [0, 1, 2, 3, 12, 13]
    padded = dict(chunks.blocks(a, (4, 7), pad=True))
    assert padded[8, 7].shape == (4, 7) and padded[8, 7][2:].sum() == 0


def test_products(spark, m):
    k = np.random.default_rng(1).normal(size=(12, 7))
    b = NDArray.from_numpy(spark, k)
    for got in (m @ b, linalg._chunked(m, b, 5), linalg.gemm(m, b), linalg.gemm_a(m, b), linalg.gemm_b(m, b)):
        np.testing.assert_allclose(got.to_numpy(), M @ k, rtol=1e-12, atol=1e-11)
    np.testing.assert_allclose((b.T @ m.T).to_numpy(), k.T @ M.T, rtol=1e-12, atol=1e-11)
    np.testing.assert_allclose(linalg.gemv(m, b[:, 0]).to_numpy(), M @ k[:, 0], rtol=1e-12)
    np.testing.assert_allclose(linalg._chunked(m, b[:, 0], 5).to_numpy(), M @ k[:, 0], rtol=1e-12)
    n = M.copy()
    n[0, 0] = np.nan
    zero = create.zeros(spark, (12, 2))
    assert np.isnan((NDArray.from_numpy(spark, n) @ zero).to_numpy()[0]).all()
    assert (linalg.gemm(NDArray.from_numpy(spark, n), zero).to_numpy() == 0).all()  # zeros are left out
    with pytest.raises(TypeError):
        linalg.matmul(m.astype("i32"), m.astype("i32").T)
    with pytest.raises(ArrayError):
        m @ m
    assert linalg.matmul_advice(m, b)[0][1] == linalg.matmul_advice(m, b)[1][0]


def test_comparisons(spark, m):
    i = m.astype("i32")
    assert compare.equal(i, i.T.T) and not compare.equal(i, i + 1) and not compare.equal(i, i.T)
    with pytest.raises(TypeError):
        compare.equal(m, m)
    assert compare.almost_equal(m, m * (1 + 1e-9), 1e-8) and not compare.almost_equal(m, m * 1.1, 1e-8)
    n = NDArray.from_numpy(spark, np.array([-1.0, np.nan]))
    assert not compare.almost_equal(n, n, 1.0) and compare.almost_equal(n, n * 5, 0.1, compat=True)
    assert (compare.gt(m, m.T.T).to_numpy() == False).all() and (compare.gte(m, m).to_numpy()).all()  # noqa: E712
    assert (compare.lt(m, m + 1).to_numpy()).all() and (compare.lte(m, m).to_numpy()).all() and not compare.eq(n, n).to_numpy()[1]
    assert compare.is_triangular(create.tri(spark, (4, 4), 0)) and not compare.is_triangular(m) and not compare.is_symmetric(m)


def test_constructors(spark):
    same(create.linspace(spark, (4, 5), 1, 3), np.linspace(1, 3, 20).reshape(4, 5))
    same(create.logspace(spark, (20,), 1, 3), np.logspace(1, 3, 20))
    same(create.eye(spark, (3, 4)), np.eye(3, 4))
    same(create.tri(spark, (3, 4), 1, "i8"), np.tri(3, 4, 1))
    same(create.arange(spark, (2, 3), 2, 0.7, "i32"), (2 + np.arange(6) * 0.7).astype("i4").reshape(2, 3))
    assert np.isnan(create.linspace(spark, (1,), 1, 3).to_numpy()).all()
    assert create.zeros(spark, (0, 3)).to_numpy().shape == (0, 3) and create.zeros(spark, (0, 3)).is_empty
    assert create.ones(spark, (), "bool").to_numpy() == True  # noqa: E712
    for bad in (lambda: create.eye(spark, (3,)), lambda: create.arange(spark, (3,), kind="bool"), lambda: create.copy(index.get_slice(create.zeros(spark, (3,)), [0], [2], view=True), view=True)):
        with pytest.raises(ArrayError):
            bad()


@pytest.mark.parametrize(
    "name, params, sample",
    [
        ("rand", {}, lambda g, n: g.random(n)), ("randn", {}, lambda g, n: g.normal(size=n)), ("uniform", {"a": -3, "b": 5}, lambda g, n: g.uniform(-3, 5, n)),
        ("normal", {"mu": 3, "sigma": 5}, lambda g, n: g.normal(3, 5, n)), ("lognormal", {"mu": 0.1, "sigma": 0.2}, lambda g, n: g.lognormal(0.1, 0.2, n)),
        ("exponential", {"scale": 3}, lambda g, n: g.exponential(3, n)), ("beta", {"alpha": 3, "beta": 4}, lambda g, n: g.beta(3, 4, n)), ("beta", {"alpha": 0.1, "beta": 5}, lambda g, n: g.beta(0.1, 5, n)),
        ("bernoulli", {"p": 0.7}, lambda g, n: g.random(n) < 0.7), ("binomial", {"m": 3, "p": 0.7}, lambda g, n: g.binomial(3, 0.7, n)), ("poisson", {"lam": 3}, lambda g, n: g.poisson(3, n)),
    ],
)
def test_distributions(spark, name, params, sample):
    ctx = rnd.RandomContext(4)
    for k, v in params.items():
        ctx.set_param(k, v)
    a = getattr(rnd, name)(spark, ctx, (20_000,))
    again = NDArray(a.origin.repartition(3), a.coords, a.value, a.meta)
    assert (a.to_numpy() == again.to_numpy()).all()  # no matter the partitions
    assert rnd.kstest(a, NDArray.from_numpy(spark, sample(np.random.default_rng(2), a.size).astype(a.dtype.numpy)))
    assert not rnd.kstest(a, create.linspace(spark, (20_000,), -40, 41))


def test_distribution_checks(spark):
    c = rnd.RandomContext(1).set_param("a", 2).set_param("b", 1).set_param("sigma", 0).set_param("p", 2).set_param("lam", 0).set_param("scale", 0).set_param("alpha", 0)
    for name in ("uniform", "normal", "lognormal", "exponential", "beta", "bernoulli", "binomial", "poisson"):
        with pytest.raises(ArrayError):
            getattr(rnd, name)(spark, c, (3,))
    with pytest.raises(ArrayError):
        rnd.rand(spark, c, (3,), "i32")
    with pytest.raises(ArrayError):
        c.set_param("q", 1)
    with pytest.raises(ArrayError):
        rnd.kstest(create.zeros(spark, (2,)), create.zeros(spark, (3,)))


def test_user_functions(spark, m):
    r = Registry()
    r.library("lib").register("hyp", np.hypot, 2)
    e = Expression("f64", r).bind("x", m).bind_scalar("k", 2)
    same(e.compile("lib.hyp(x, 3) * k").eval(), np.hypot(M, 3) * 2)
    with pytest.raises(ArrayError):
        e.compile("lib.hyp(x)").eval()
    e = Expression("f64").bind("x", create.copy(m, chunkshape=(3, 5))).bind_param(10)
    same(e.compile_udf(lambda i, at, p: i[0] + p[0]).eval(), M + 10)


def test_projection_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2.0D AS v", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    a = NDArray.from_table(df, ["id"], [1000], v="f64")[0]
    plan = index.get_slice(a, [10], [20]).df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(id,10)" in plan


def test_positions_are_dense(spark):
    a = create.element(spark, "i64", (3, 4, 5), lambda i, flat: flat)
    assert a.df.select(F.countDistinct("i0", "i1", "i2")).first()[0] == 60
    assert (a.to_numpy().ravel() == np.arange(60)).all()
    assert ArrayMeta("f64", (3, 4, 5)).strides == (20, 5, 1)


def test_large_products_go_by_tiles(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(70, 150)), r.normal(size=(150, 90))
    x[20:50, 30:60] = 0  # whole tiles of zeros
    y[:, 40:60] = 0
    x[:10] = 0
    x[60, 3], y[3, 50] = np.nan, 0.0
    a, b = (NDArray.from_numpy(spark, z) for z in (x, y))
    want = np.where(np.isnan(x), 0, x) @ y
    want[60] += np.where(y[3] != 0, np.nan, 0)
    for whole in ("", "a", "b"):
        np.testing.assert_allclose(linalg._chunked(a, b, 10, True, whole).to_numpy(), want, atol=1e-9)
    many = linalg.FOLD
    linalg.FOLD = 3
    try:
        np.testing.assert_allclose(linalg._chunked(a, b, 10).to_numpy(), x @ y, atol=1e-9)
    finally:
        linalg.FOLD = many
    plan = linalg.gemm(create.zeros(spark, (4000, 3000)), create.zeros(spark, (3000, 3700))).df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan  # not cell by cell


def test_index_lists_move_no_cells(spark, tmp_path):
    x = np.arange(600.0).reshape(20, 30)
    spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(20) for j in range(30)], "i0 long, i1 long, v double").write.parquet(f"{tmp_path}/cells")
    a = NDArray.cells(spark.read.parquet(f"{tmp_path}/cells"), ArrayMeta("f64", (20, 30)))
    pick = ([3, 3, -1, 0], [29, 0, 7])
    got, new = index.get_orthogonal(a, pick), index.set_orthogonal(a, pick, np.arange(12.0).reshape(4, 3))
    np.testing.assert_array_equal(got.to_numpy(), x[np.ix_(*pick)])
    want = x.copy()
    want[np.ix_(*pick)] = np.arange(12.0).reshape(4, 3)
    np.testing.assert_array_equal(new.to_numpy(), want)
    for b in (got, new):
        plan = b.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "PushedFilters: [In(i0" in got.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind, shape, chunk", [("f64", (7, 9), (3, 4)), ("u64", (5, 2, 3), (2, 2, 2)), ("bool", (11,), (4,)), ("i8", (), None), ("f32", (0, 3), None)])
def test_elements_are_walked_in_their_tasks_in_the_order_of_the_iterator(spark, kind, shape, chunk):
    x = np.arange(int(np.prod(shape))).reshape(shape).astype(DTYPES[kind].numpy)
    a = NDArray.from_numpy(spark, x, chunkshape=chunk)
    out = index.map_items(a, lambda elements: (([*i], f, float(v)) for i, f, v in elements), "at array<long>, flat long, v double")
    assert [(tuple(r[0]), r[1], r[2]) for r in out.collect()] == [(i, f, float(v)) for i, f, v in index.items(a)]
