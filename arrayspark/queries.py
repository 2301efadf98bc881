"""One query for each array operator, over the driver's tables, and the same in SQL.

Arrays used: ``ev`` (events by event_id) as a vector and in rows of 100, ``price`` (part by
p_partkey, with p_size on the same rows), ``emb`` (embeddings by vec_id and component).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .array import NDArray
from .functions.expressions import Expression, evaluate
from .functions.udf import Registry
from .errors import strerror
from .meta import ArrayError, ArrayMeta, Config
from .operators import chunks, compare, create, index, linalg, random, reduce
from .plans.advice import advise, l2_size, ncores
from .sources import buffers, proxy, storage
from .streaming.appends import append_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _rows(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, int]:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df, df.count()  # from the files' footers


def ev(spark: SparkSession, d: str) -> NDArray:
    df, n = _rows(spark, d, "events")
    return NDArray.from_table(df.select("event_id", "value"), ["event_id"], [n], value="f64")[0]


def ev2(spark: SparkSession, d: str) -> NDArray:
    df, n = _rows(spark, d, "events")
    rows = df.select(F.expr("event_id div 100").alias("a"), (F.col("event_id") % 100).alias("b"), "value")
    return NDArray.from_table(rows, ["a", "b"], [n // 100, 100], value="f64")[0]


def price(spark: SparkSession, d: str) -> list[NDArray]:
    df, n = _rows(spark, d, "part")
    return NDArray.from_table(df.select("p_partkey", "p_retailprice", "p_size"), ["p_partkey"], [n], p_retailprice="f64", p_size="i32")


def emb(spark: SparkSession, d: str) -> NDArray:
    df, n = _rows(spark, d, "embeddings")
    rows = df.select(F.col("vec_id"), F.posexplode("embedding").alias("p", "x"))
    return NDArray.from_table(rows, ["vec_id", "p"], [n, 64], x="f32")[0]


EV = "SELECT event_id AS i0, value AS v FROM events"
EV2 = "SELECT event_id // 100 AS i0, event_id % 100 AS i1, value AS v FROM events"
EMB = "SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, unnest(embedding) AS v FROM embeddings"


def rounded(v: Column, digits: int) -> Column:
    """``v`` rounded as SQL engines do on doubles: scaled, rounded half away from zero, scaled back. Spark's own rounds the
    shortest decimal that stands for the double, so near ties and beyond 16 digits it gives another neighbour."""
    scale = F.lit(10.0**digits)
    whole = F.round(v * scale, 0)
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), v).otherwise(whole / scale)


def nearest(x: float, digits: int) -> float:
    """:func:`rounded` of a number on the driver."""
    scaled = float(x) * 10.0**digits
    if not math.isfinite(scaled):
        return float(x)
    whole = float(math.trunc(scaled))
    return (whole + math.copysign(abs(scaled - whole) >= 0.5, scaled)) / 10.0**digits


def show(a: NDArray, digits: int | None = 6) -> DataFrame:
    """The cells, floats rounded: sums in another order differ in the last digits. No -0."""
    if a.dtype.floating:
        v = F.col("v").cast("double")
        return a.df.withColumn("v", (rounded(v, digits) if digits is not None else v) + 0.0)
    if a.dtype.kind != "b":
        return a.df.withColumn("v", F.col("v").cast("bigint"))
    return a.df


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _array(name: str, make: Callable[[SparkSession, str], NDArray], sql: str | None = None, digits: int | None = 6) -> None:
    query(name, sql)(lambda spark, d: show(make(spark, d), digits))


def _expr(name: str, text: str, sql: str, kind: str = "f64", digits: int = 6) -> None:
    """An expression over x = ev2, with the type of ``kind``."""

    def make(spark: SparkSession, d: str) -> NDArray:
        x = ev2(spark, d)
        return evaluate(text, x=x if kind == "f64" else x.astype(kind))

    cast = {"f64": "v", "f32": "v::FLOAT", "i32": "trunc(v)::INTEGER", "i64": "trunc(v)::BIGINT"}[kind]
    value = f"round(({sql})::DOUBLE, {digits}) + 0.0" if kind[0] == "f" else f"({sql})::BIGINT"
    _array(name, make, f"SELECT i0, i1, {value} AS v FROM (SELECT i0, i1, {cast} AS x FROM ({EV2}))", digits)


# ---------------------------------------------------------------- expressions

_expr("expr_poly", "(x - 1.35) * (x - 4.45) * (x - 8.5)", "(x - 1.35) * (x - 4.45) * (x - 8.5)")
_expr("expr_trans1", "sin(x)*sin(x) + cos(x)*cos(x)", "sin(x)*sin(x) + cos(x)*cos(x)")
_expr("expr_trans2", "(cos(x)-1.35)*(x-4.45)*(sin(x)-8.5)", "(cos(x)-1.35)*(x-4.45)*(sin(x)-8.5)")
_expr("expr_add_sub", "x + 2.5 - 1", "x + 2.5 - 1")
_expr("expr_divide", "x / (x - 6.55)", "CASE WHEN x = 6.55 THEN 'inf'::DOUBLE ELSE x / (x - 6.55) END")
_expr("expr_modulo", "x % 7.5", "x - 7.5 * floor(x / 7.5)", digits=4)
_expr("expr_modulo_negative", "(3 - x) % 7.5", "(3 - x) - 7.5 * trunc((3 - x) / 7.5)", digits=4)
_expr("expr_min_max_nan", "min(x, sqrt(x - 50)) + max(sqrt(x - 50), x)", "CASE WHEN x < 50 THEN x + x ELSE least(x, sqrt(greatest(x - 50, 0))) + greatest(x, sqrt(greatest(x - 50, 0))) END")
_expr("expr_power", "x ** 1.5 + pow(x, 0.5) + 2^3^2", "pow(x, 1.5) + pow(x, 0.5) + 64")
_expr("expr_unary_minus", "-x^2 + negate(x) + +x", "x * x", digits=4)
_expr("expr_abs", "abs(x - 50) + absolute(-x)", "abs(x - 50) + x")
_expr("expr_sqrt", "sqrt(x - 20)", "CASE WHEN x < 20 THEN 'nan'::DOUBLE ELSE sqrt(greatest(x - 20, 0)) END")
_expr("expr_exp", "exp(x / 100)", "exp(x / 100)")
_expr("expr_log", "log(x - 50) + log10(x)", "CASE WHEN x < 50 THEN 'nan'::DOUBLE WHEN x = 50 THEN '-inf'::DOUBLE ELSE ln(CASE WHEN x > 50 THEN x - 50 ELSE 1 END) + log10(x) END")
_expr("expr_tan", "tan(x / 400)", "tan(x / 400)")
_expr("expr_arc", "asin(x/500) + arccos(x/500) - arctan(x)", "asin(x/500) + acos(x/500) - atan(x)")
_expr("expr_atan2", "atan2(x, 2) + arctan2(2, x)", "atan2(x, 2) + atan2(2, x)")
_expr("expr_hyperbolic", "sinh(x/500) + cosh(x/500) - tanh(x/500)", "sinh(x/500) + cosh(x/500) - tanh(x/500)")
_expr("expr_ceil_floor", "ceil(x) * floor(x - 8.5)", "ceil(x) * floor(x - 8.5)")
_expr("expr_min_max", "min(x, 34.5) + max(x, 4.345)", "least(x, 34.5) + greatest(x, 4.345)")
_expr("expr_f32", "(x - 3) * x / 8", "(((x - 3::FLOAT)::FLOAT * x)::FLOAT / 8::FLOAT)::FLOAT", "f32", 3)
_expr("expr_i32", "(x - 3) * (x - 1) / 4 - abs(x - 9) + min(x, 35)", "((x - 3) * (x - 1)) // 4 - abs(x - 9) + least(x, 35)", "i32")
_expr("expr_i64", "x * 1000000007 - max(x, 35) * 2.9", "x::BIGINT * 1000000007 - greatest(x, 35) * 2", "i64")


def _two(spark: SparkSession, d: str) -> NDArray:
    p, size = price(spark, d)
    return evaluate("sin(x) * sin(y) + cos(x)", x=p, y=size.astype("f64"))


_array("expr_two_operands", _two, "SELECT p_partkey AS i0, round(sin(p_retailprice) * sin(p_size) + cos(p_retailprice), 6) + 0.0 AS v FROM part")


def _joined(spark: SparkSession, d: str) -> NDArray:
    x = ev(spark, d)
    return evaluate("x * y - z", x=x, y=create.arange(spark, x.shape, 0, 0.5), z=create.ones(spark, x.shape))


_array("expr_joined_operands", _joined, f"SELECT i0, round(v * i0 * 0.5 - 1, 4) + 0.0 AS v FROM ({EV})", 4)
_array("expr_constant", lambda s, d: Expression("f64").bind_out(ArrayMeta("f64", (40, 25))).compile("2.3 * 2").eval(s), "SELECT r // 25 AS i0, r % 25 AS i1, 4.6::DOUBLE AS v FROM range(1000) t(r)")


def _scalars(spark: SparkSession, d: str) -> NDArray:
    return Expression("f64").bind("x", ev2(spark, d)).bind_scalar("k", 2.5).compile("x * k + k").eval()


_array("expr_bound_scalar", _scalars, f"SELECT i0, i1, round(v * 2.5 + 2.5, 6) AS v FROM ({EV2})")


@query("expr_nthreads_comma", "SELECT true AS threads, 'INVALID_ARGUMENT' AS comma")
def _nthreads(spark: SparkSession, d: str) -> DataFrame:
    """The tasks that an expression's evaluation may use; a comma outside of a call is refused."""
    e = Expression("f64").bind("x", ev2(spark, d))
    try:
        e.compile("x, x")
        refused = ""
    except ArrayError as err:
        refused = err.code
    return spark.createDataFrame([(e.nthreads == spark.sparkContext.defaultParallelism, refused)], "threads boolean, comma string")


def _udf(spark: SparkSession, d: str) -> NDArray:
    r = Registry()
    r.library("lib").register("hypot", np.hypot, 2)
    return Expression("f64", r).bind("x", ev2(spark, d)).compile("lib.hypot(x, 3) - 1").eval()


_array("udf_scalar", _udf, f"SELECT i0, i1, round(sqrt(v * v + 9) - 1, 6) AS v FROM ({EV2})")


def _kernel(inputs: list[np.ndarray], start: tuple[int, ...], params: list) -> np.ndarray:
    rows = np.arange(inputs[0].shape[0])[:, None] + start[0]
    return inputs[0] * params[0] + rows


def _array_udf(spark: SparkSession, d: str) -> NDArray:
    x = ev2(spark, d)
    x = create.copy(x, chunkshape=(7, 30))
    return Expression("f64").bind("x", x).bind_param(3.0).compile_udf(_kernel).eval()


_array("udf_array", _array_udf, f"SELECT i0, i1, round(v * 3 + i0, 6) AS v FROM ({EV2})")

# ---------------------------------------------------------------- constructors

_N = "(SELECT r // 50 AS i0, r % 50 AS i1, r FROM range(2000) t(r))"
for _name, _make, _value in (
    ("create_zeros", lambda s: create.zeros(s, (40, 50)), "0.0::DOUBLE"),
    ("create_ones", lambda s: create.ones(s, (40, 50), "i32"), "1::BIGINT"),
    ("create_fill", lambda s: create.fill(s, (40, 50), 3.14), "3.14::DOUBLE"),
    ("create_empty", lambda s: create.empty(s, (40, 50), "i64"), "0::BIGINT"),
    ("create_uninit", lambda s: create.uninit(s, (40, 50), "bool"), "false"),
    ("create_arange", lambda s: create.arange(s, (40, 50), -3, 0.7, "i32"), "trunc(-3 + r * 0.7::DOUBLE)::BIGINT"),
    ("create_linspace", lambda s: create.linspace(s, (40, 50), -1, 1), "round(r * (2.0::DOUBLE / 1999) - 1, 6) + 0.0"),
    ("create_logspace", lambda s: create.logspace(s, (40, 50), 0, 3, 2.0), "round(pow(2.0::DOUBLE, r * (3.0::DOUBLE / 1999)), 6)"),
    ("create_eye", lambda s: create.eye(s, (40, 50)), "(i0 = i1)::INT::DOUBLE"),
    ("create_tri", lambda s: create.tri(s, (40, 50), 3, "i8"), "(i1 <= i0 + 3)::BIGINT"),
    ("create_element", lambda s: create.element(s, "i64", (40, 50), lambda i, flat: i[0] * 3 + i[1] - flat), "(i0 * 3 + i1 - r)::BIGINT"),
    ("create_blocks", lambda s: chunks.from_blocks(s, "f64", (40, 50), lambda at, n: np.add.outer(np.arange(n[0]) + at[0], (np.arange(n[1]) + at[1]) * 2.0), (16, 16)), "(i0 + 2 * i1)::DOUBLE"),
):
    _array(_name, lambda s, d, f=_make: f(s), f"SELECT i0, i1, {_value} AS v FROM {_N}")

_array("create_copy_rechunk", lambda s, d: chunks.from_chunks(chunks.to_chunks(ev2(s, d), (7, 13)), ev2(s, d).meta.but(chunkshape=(7, 13))), EV2)
# nine chunks, and the chunks of a grid of two by five in reverse order, of all rows
_array("create_split_concatenate", lambda s, d: chunks.concatenate(chunks.split(a := create.copy(ev2(s, d), chunkshape=(-(-ev2(s, d).shape[0] // 3), 40))), a.meta), EV2)


def _reversed_chunks(spark: SparkSession, d: str) -> NDArray:
    a = ev2(spark, d)
    n = a.shape[0]
    a = create.copy(a, chunkshape=(n if n % 2 else n // 2, 20))
    return chunks.from_chunk_index(a, a.shape, list(reversed(range(5 if n % 2 else 10))))


_HALF = "(SELECT CASE WHEN count(*) // 100 % 2 = 1 THEN count(*) // 100 ELSE count(*) // 200 END AS h, count(*) // 100 AS n FROM events)"
_array("create_from_chunk_index", _reversed_chunks, f"SELECT (n // h - 1 - i0 // h) * h + i0 % h AS i0, (4 - i1 // 20) * 20 + i1 % 20 AS i1, v FROM ({EV2}), {_HALF}")


@query("chunk_layout", f"SELECT i0 // 4 AS c0, i1 // 30 AS c1, count(*) AS n, round(list(v ORDER BY i0, i1)[2], 6) AS second, round(sum(v), 4) AS total FROM ({EV2}) GROUP BY ALL")
def _chunk_layout(spark: SparkSession, d: str) -> DataFrame:
    return chunks.to_chunks(ev2(spark, d), (4, 30)).select("c0", "c1", F.size("values").cast("long").alias("n"), rounded(F.get("values", F.lit(1)), 6).alias("second"), rounded(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


# ---------------------------------------------------------------- random


def _ks(make: Callable[[SparkSession], NDArray], sample: Callable[[np.random.Generator, int], np.ndarray]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = make(spark)
        ok = random.kstest(a, NDArray.from_numpy(spark, sample(np.random.default_rng(1), a.size).astype(a.dtype.numpy)))
        return spark.createDataFrame([(a.size, ok)], "n long, same boolean")

    return run


def _ctx(**params: float) -> random.RandomContext:
    c = random.RandomContext(9)
    for k, v in params.items():
        c.set_param(k, v)
    return c


_S = (10_000,)
for _name, _make, _sample in (
    ("rand", lambda s: random.rand(s, _ctx(), _S), lambda g, n: g.random(n)),
    ("randn", lambda s: random.randn(s, _ctx(), _S), lambda g, n: g.normal(size=n)),
    ("uniform", lambda s: random.uniform(s, _ctx(a=-3, b=5), _S), lambda g, n: g.uniform(-3, 5, n)),
    ("normal", lambda s: random.normal(s, _ctx(mu=3, sigma=5), _S), lambda g, n: g.normal(3, 5, n)),
    ("lognormal", lambda s: random.lognormal(s, _ctx(mu=0.1, sigma=0.2), _S), lambda g, n: g.lognormal(0.1, 0.2, n)),
    ("exponential", lambda s: random.exponential(s, _ctx(scale=3), _S), lambda g, n: g.exponential(3, n)),
    ("beta", lambda s: random.beta(s, _ctx(alpha=3, beta=4), _S), lambda g, n: g.beta(3, 4, n)),
    ("bernoulli", lambda s: random.bernoulli(s, _ctx(p=0.7), _S), lambda g, n: g.random(n) < 0.7),
    ("binomial", lambda s: random.binomial(s, _ctx(m=3, p=0.7), _S), lambda g, n: g.binomial(3, 0.7, n)),
    ("poisson", lambda s: random.poisson(s, _ctx(lam=3), _S), lambda g, n: g.poisson(3, n)),
):
    query(f"random_{_name}", "SELECT 10000::BIGINT AS n, true AS same")(_ks(_make, _sample))


@query("random_kstest_differs", "SELECT false AS same")
def _ks_differs(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(random.kstest(random.rand(spark, _ctx(), _S), random.randn(spark, _ctx(), _S)),)], "same boolean")


# ---------------------------------------------------------------- indexing and shape

_array("index_slice", lambda s, d: index.get_slice(ev2(s, d), [2, -40], [-1, 90]), f"SELECT i0 - 2 AS i0, i1 - 60 AS i1, v FROM ({EV2}) WHERE i0 BETWEEN 2 AND (SELECT count(*) // 100 - 2 FROM events) AND i1 BETWEEN 60 AND 89")
_array("index_slice_view", lambda s, d: ev2(s, d)[1:5, 10:20], f"SELECT i0 - 1 AS i0, i1 - 10 AS i1, v FROM ({EV2}) WHERE i0 BETWEEN 1 AND 4 AND i1 BETWEEN 10 AND 19")
_array("index_set_slice", lambda s, d: index.set_slice(ev2(s, d), [1, 5], [4, 9], create.fill(s, (3, 4), -1.0)), f"SELECT i0, i1, CASE WHEN i0 BETWEEN 1 AND 3 AND i1 BETWEEN 5 AND 8 THEN -1 ELSE v END AS v FROM ({EV2})")
_array("index_set_slice_buffer", lambda s, d: index.set_slice_buffer(ev2(s, d), [0, 98], [2, 100], np.arange(4.0).tobytes()), f"SELECT i0, i1, CASE WHEN i0 < 2 AND i1 >= 98 THEN i0 * 2 + i1 - 98 ELSE v END AS v FROM ({EV2})")
_SEL = ([3, 1, 3, 0], [99, 0, 7])
_array("index_orthogonal_get", lambda s, d: index.get_orthogonal(ev2(s, d), _SEL), f"SELECT p0 AS i0, p1 AS i1, v FROM ({EV2}) JOIN (VALUES (3, 0), (1, 1), (3, 2), (0, 3)) a(i0, p0) USING (i0) JOIN (VALUES (99, 0), (0, 1), (7, 2)) b(i1, p1) USING (i1)")
_array("index_orthogonal_set", lambda s, d: index.set_orthogonal(ev2(s, d), ([3, 1], [99, 0, 7]), -np.arange(6.0).reshape(2, 3)), f"SELECT i0, i1, coalesce(-(p0 * 3 + p1), v) + 0.0 AS v FROM ({EV2}) LEFT JOIN (VALUES (3, 0), (1, 1)) a(i0, p0) USING (i0) LEFT JOIN (VALUES (99, 0), (0, 1), (7, 2)) b(i1, p1) USING (i1)")
_array("index_type_view_i64", lambda s, d: index.type_view(ev2(s, d), "i64"), f"SELECT i0, i1, trunc(v)::BIGINT AS v FROM ({EV2})")
_array("index_type_view_u64", lambda s, d: index.type_view(ev2(s, d), "u64"), f"SELECT i0, i1, trunc(v)::BIGINT AS v FROM ({EV2})")
_array("index_type_view_f32_f64", lambda s, d: index.type_view(emb(s, d), "f64"), f"SELECT i0::BIGINT AS i0, i1::BIGINT AS i1, round(v::DOUBLE, 6) + 0.0 AS v FROM ({EMB})")
_array("index_type_view_wrap", lambda s, d: ev2(s, d).astype("i64").astype("i8"), f"SELECT i0, i1, ((trunc(v)::BIGINT + 128) % 256 - 128)::BIGINT AS v FROM ({EV2})")
_array("index_transpose", lambda s, d: ev2(s, d).T, f"SELECT i1 AS i0, i0 AS i1, v FROM ({EV2})")
_array("index_squeeze", lambda s, d: index.squeeze(index.get_slice(ev2(s, d), [3, 0], [4, 100])), f"SELECT i1 AS i0, v FROM ({EV2}) WHERE i0 = 3")
_array("index_squeeze_axis", lambda s, d: ev2(s, d)[:, 42], f"SELECT i0, v FROM ({EV2}) WHERE i1 = 42")
_array("index_resize", lambda s, d: index.resize((a := ev2(s, d)), (a.shape[0], 120), (0, 10)), f"SELECT i0, CASE WHEN i1 >= 10 THEN i1 + 20 ELSE i1 END AS i1, v FROM ({EV2}) UNION ALL SELECT r, 10 + c, 0 FROM range((SELECT count(*) // 100 FROM events)) a(r), range(20) b(c)")
_array("index_resize_shrink", lambda s, d: index.resize((a := ev2(s, d)), (a.shape[0], 60), (0, 10)), f"SELECT i0, CASE WHEN i1 >= 50 THEN i1 - 40 ELSE i1 END AS i1, v FROM ({EV2}) WHERE i1 < 10 OR i1 >= 50")
_array("index_insert", lambda s, d: index.insert((a := ev2(s, d)), create.ones(s, (a.shape[0], 5)), 1, 7), f"SELECT i0, CASE WHEN i1 >= 7 THEN i1 + 5 ELSE i1 END AS i1, v FROM ({EV2}) UNION ALL SELECT r, 7 + c, 1 FROM range((SELECT count(*) // 100 FROM events)) a(r), range(5) b(c)")
_array("index_append", lambda s, d: index.append(ev2(s, d), create.zeros(s, (2, 100)), 0), f"SELECT i0, i1, v FROM ({EV2}) UNION ALL SELECT (SELECT count(*) // 100 FROM events) + r, c, 0 FROM range(2) a(r), range(100) b(c)")
_array("index_delete", lambda s, d: index.delete(ev2(s, d), 1, 5, 20), f"SELECT i0, CASE WHEN i1 >= 25 THEN i1 - 20 ELSE i1 END AS i1, v FROM ({EV2}) WHERE i1 < 5 OR i1 >= 25")


def _counts(elements: Iterator[tuple[tuple[int, ...], int, float]]) -> Iterator[tuple[int, int, int, float]]:
    """Row, number, greatest flat index and sum of the elements that follow each other in one row."""
    row = n = last = total = None
    for i, flat, v in elements:
        if i[0] != row:
            if row is not None:
                yield row, n, last, total
            row, n, last, total = i[0], 0, flat, 0.0
        n, last, total = n + 1, max(last, flat), total + v
    if row is not None:
        yield row, n, last, total


@query("iterate_elements", f"SELECT i0, count(*) AS n, max(i0 * 100 + i1) AS last, round(sum(v), 4) AS total FROM ({EV2}) GROUP BY i0")
def _elements(spark: SparkSession, d: str) -> DataFrame:
    """All elements by the iterator, in the tasks that have them: a row of counts for each row of the array."""
    parts = index.map_items(ev2(spark, d), _counts, "i0 long, n long, last long, total double")
    return parts.groupBy("i0").agg(F.sum("n").alias("n"), F.max("last").alias("last"), rounded(F.sum("total"), 4).alias("total"))


def _summary(start: tuple[int, ...], block: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": [start[0]], "b": [start[1]], "n": [block.size], "top": [float(block.max())]})


@query("iterate_blocks", f"SELECT i0 // 6 * 6 AS a, i1 // 35 * 35 AS b, count(*) AS n, max(v) AS top FROM ({EV2}) GROUP BY ALL")
def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.map_blocks(ev2(spark, d), (6, 35), _summary, "a long, b long, n long, top double")


# ---------------------------------------------------------------- comparisons


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    x, y = ev2(spark, d), ev2(spark, d)
    i, j = x.astype("i64"), y.astype("i64")
    return spark.createDataFrame([(compare.equal(i, j), compare.equal(i, evaluate("x + 1", x=j)), compare.almost_equal(x, evaluate("x * 1.0001", x=y), 1e-3), compare.almost_equal(x, y * 1.1, 1e-3))], "same boolean, other boolean, near boolean, far boolean")


query("compare_equal", "SELECT true AS same, false AS other, true AS near, false AS far")(_verdicts)
for _name, _op in (("gt", ">"), ("lt", "<"), ("gte", ">="), ("lte", "<="), ("eq", "=")):
    _array(f"compare_{_name}", lambda s, d, f=getattr(compare, _name): f(ev2(s, d), create.fill(s, ev2(s, d).shape, 12.31)), f"SELECT i0, i1, v {_op} 12.31 AS v FROM ({EV2})")


@query("compare_matrix_shape", f"SELECT true AS symmetric, (SELECT count(*) = 0 FROM ({EMB}) a JOIN ({EMB}) b ON a.i0 = b.i1 AND a.i1 = b.i0 WHERE a.v <> b.v) AND (SELECT count(*) = 64 FROM embeddings) AS plain, true AS triangular")
def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """The gram of all embeddings, all embeddings themselves, and the gram's lower triangle."""
    e = emb(spark, d)
    g = linalg.gram(index.type_view(e, "f64"))
    near = NDArray.cells(g.df.withColumn("v", F.round("v", 3)), g.meta)
    low = NDArray.cells(g.df.withColumn("v", F.when(F.col("i1") <= F.col("i0"), F.col("v")).otherwise(0.0)), g.meta)
    plain = e.shape[0] == e.shape[1] and compare.is_symmetric(e)
    return spark.createDataFrame([(compare.is_symmetric(near), plain, compare.is_triangular(low))], "symmetric boolean, plain boolean, triangular boolean")


# ---------------------------------------------------------------- reductions


def _with_nan(spark: SparkSession, d: str) -> NDArray:
    """ev2 with NaN where the value is below 2."""
    return evaluate("x + 0 * sqrt(x - 2)", x=ev2(spark, d))


_NAN = f"(SELECT i0, i1, CASE WHEN v < 2 THEN 'nan'::DOUBLE ELSE v END AS v, v >= 2 AS ok, v AS raw FROM ({EV2}))"
_PLAIN = {"sum": "sum({})", "prod": "product({})", "max": "max({})", "min": "min({})", "mean": "avg({})", "var": "var_pop({})", "std": "stddev_pop({})", "median": "median({})"}
for _f, _agg in _PLAIN.items():
    _scale = " / 50" if _f == "prod" else ""
    _make = (lambda s, d: evaluate("x / 50", x=ev2(s, d))) if _f == "prod" else ev2
    _nanm = (lambda s, d: evaluate("x / 50", x=_with_nan(s, d))) if _f == "prod" else _with_nan
    # products of a hundred numbers are compared by their logarithms
    _post = (lambda a: evaluate("log(x)", x=a)) if _f == "prod" else (lambda a: a)
    _wrap = "ln({})" if _f == "prod" else "{}"
    _array(f"reduce_{_f}", lambda s, d, f=_f, m=_make, p=_post: p(reduce.reduce(m(s, d), f, 1)), f"SELECT i0, round({_wrap.format(_agg.format('v' + _scale))}, 4) AS v FROM ({EV2}) GROUP BY i0", 4)
    _array(f"reduce_nan{_f}", lambda s, d, f=_f, m=_nanm, p=_post: p(reduce.reduce(m(s, d), "nan" + f, 1)), f"SELECT i0, round({_wrap.format(_agg.format('raw' + _scale))}, 4) AS v FROM {_NAN} WHERE ok GROUP BY i0", 4)
    _array(f"reduce_{_f}_of_nan", lambda s, d, f=_f, m=_nanm: reduce.reduce(m(s, d), f, 1), f"SELECT i0, CASE WHEN bool_and(ok) THEN round({_agg.format('raw' + _scale)}, 4) ELSE 'nan'::DOUBLE END AS v FROM {_NAN} GROUP BY i0", 4)
_array("reduce_udf", lambda s, d: reduce.reduce_udf(ev2(s, d), lambda v: v.max() - v.min(), 1), f"SELECT i0, round(max(v) - min(v), 6) AS v FROM ({EV2}) GROUP BY i0")
_array("reduce_all", lambda s, d: reduce.reduce(evaluate("floor(x / 3)", x=ev2(s, d)), "all", 1), f"SELECT i0, bool_and(floor(v / 3) <> 0) AS v FROM ({EV2}) GROUP BY i0")
_array("reduce_any", lambda s, d: reduce.reduce(evaluate("floor(x / 400)", x=ev2(s, d)), "any", 1), f"SELECT i0, bool_or(floor(v / 400) <> 0) AS v FROM ({EV2}) GROUP BY i0")
_array("reduce_axis0", lambda s, d: reduce.reduce(ev2(s, d), "sum", 0), f"SELECT i1 AS i0, round(sum(v), 4) AS v FROM ({EV2}) GROUP BY i1", 4)
_array("reduce_multi_axis", lambda s, d: reduce.reduce(ev2(s, d), "mean", (0, 1)), f"SELECT round(avg(v), 4) AS v FROM ({EV2})", 4)
_array("reduce_multipass", lambda s, d: reduce.reduce(ev2(s, d), "max", (1, 1), oneshot=False), f"SELECT i0, max(v) AS v FROM ({EV2}) GROUP BY i0")
_array("reduce_int_sum", lambda s, d: reduce.reduce(ev2(s, d).astype("i32"), "sum", 1), f"SELECT i0, sum(trunc(v)::BIGINT)::BIGINT AS v FROM ({EV2}) GROUP BY i0")
# factors 2, -1 and -2: rows with many twos wrap modulo 2**64
_array("reduce_int_prod", lambda s, d: reduce.reduce(evaluate("2 - 4 * (x - x / 3 * 3) + (x - x / 3 * 3) * (x - x / 3 * 3)", x=ev2(s, d).astype("i64")), "prod", 1), f"SELECT i0, CASE WHEN twos >= 64 THEN 0 WHEN twos = 63 THEN (-9223372036854775808)::BIGINT ELSE (CASE WHEN minus % 2 = 1 THEN -1 ELSE 1 END) * (1::BIGINT << twos::INTEGER) END::BIGINT AS v FROM (SELECT i0, least(count(*) FILTER (m <> 1), 64) AS twos, count(*) FILTER (m <> 0) AS minus FROM (SELECT i0, trunc(v)::BIGINT % 3 AS m FROM ({EV2})) GROUP BY i0)")
_array("reduce_int_median", lambda s, d: reduce.reduce(ev2(s, d).astype("i64"), "median", 1), f"SELECT i0, median(trunc(v))::DOUBLE AS v FROM ({EV2}) GROUP BY i0")
_array("reduce_var_correction", lambda s, d: reduce.reduce(ev2(s, d), "var", 1, correction=1), f"SELECT i0, round(var_samp(v), 4) AS v FROM ({EV2}) GROUP BY i0", 4)
_array("reduce_f32_mean", lambda s, d: reduce.reduce(emb(s, d), "mean", 0), f"SELECT i1::BIGINT AS i0, round(avg(v::DOUBLE)::FLOAT::DOUBLE, 5) + 0.0 AS v FROM ({EMB}) GROUP BY i1", 5)
_array("reduce_of_view", lambda s, d: reduce.reduce(index.get_slice(ev2(s, d), [1, 10], [9, 60], view=True), "sum", 0), f"SELECT i1 - 10 AS i0, round(sum(v), 4) AS v FROM ({EV2}) WHERE i0 BETWEEN 1 AND 8 AND i1 BETWEEN 10 AND 59 GROUP BY i1", 4)

# ---------------------------------------------------------------- linear algebra

_HEAD = f"(SELECT i0::BIGINT AS i0, i1::BIGINT AS i1, v::DOUBLE AS v FROM ({EMB}))"


# products over all rows: each embedding times the 64 x 64 gram of all of them
_GRAM = f"(SELECT a.i1 AS i0, b.i1, sum(a.v * b.v) AS v FROM {_HEAD} a JOIN {_HEAD} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1)"
_WHOLE = f"SELECT a.i0, b.i1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM {_HEAD} a JOIN {_GRAM} b ON a.i1 = b.i0 GROUP BY a.i0, b.i1"
for _f in ("matmul", "gemm", "gemm_a", "gemm_b"):
    _array(f"linalg_{_f}", lambda s, d, f=_f: getattr(linalg, f)(e := index.type_view(emb(s, d), "f64"), linalg.gram(e)), _WHOLE, 4)
for _f, _side, _zeros in (("matmul_tiles", "", False), ("gemm_tiles", "", True), ("gemm_b_tiles", "b", True)):
    _array(f"linalg_{_f}", lambda s, d, w=_side, z=_zeros: linalg._chunked(e := index.type_view(emb(s, d), "f64"), linalg.gram(e), 32, z, w), _WHOLE, 4)
_array("linalg_gemv", lambda s, d: linalg.gemv(e := index.type_view(emb(s, d), "f64"), e[0, :]), f"SELECT a.i0, round(sum(a.v * b.v), 5) + 0.0 AS v FROM {_HEAD} a JOIN {_HEAD} b ON a.i1 = b.i1 WHERE b.i0 = 0 GROUP BY a.i0", 5)
_array("linalg_gram", lambda s, d: linalg.gram(index.type_view(emb(s, d), "f64")), f"SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM {_HEAD} a JOIN {_HEAD} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1", 4)
_array("linalg_transpose", lambda s, d: emb(s, d).T, f"SELECT i1::BIGINT AS i0, i0::BIGINT AS i1, round(v::DOUBLE, 6) + 0.0 AS v FROM ({EMB})")
_array("linalg_dot", lambda s, d: linalg.dot(a := ev(s, d), a), "SELECT round(sum(value * value), 2) AS v FROM events", 2)


@query("linalg_norms", f"SELECT round(sqrt(sum(v * v)), 4) AS fro, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM ({EV2}) GROUP BY i0)), 4) AS inf, round((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM ({EV2}) GROUP BY i1)), 4) AS one, round((SELECT sum(v) FROM ({EV2}) WHERE i0 = i1), 4) AS trace FROM ({EV2})")
def _norms(spark: SparkSession, d: str) -> DataFrame:
    a = ev2(spark, d)
    return spark.createDataFrame([(nearest(linalg.norm(a), 4), nearest(linalg.norm(a, "inf"), 4), nearest(linalg.norm(a, 1), 4), nearest(linalg.trace(a), 4))], "fro double, inf double, one double, trace double")


# what the factors of the gram of all embeddings, plus one on the diagonal, must add up to
_REG = f"(SELECT i0, i1, v + (i0 = i1)::INT AS v FROM {_GRAM})"
_DENSE = {
    "cholesky": f"SELECT sum(v) FROM {_REG} WHERE i0 = i1", "eigen": f"SELECT sum(v) FROM {_REG} WHERE i0 = i1", "eigen_square": f"SELECT sum(v * v) FROM {_REG}",
    "inverse": "SELECT 64.0", "lstsq": "SELECT 2016.0", "lu": f"SELECT sum(v) FROM {_REG}", "qr": f"SELECT sum(v * v) FROM {_REG}", "solve": "SELECT 2016.0", "svd": f"SELECT sum(v * v) FROM {_REG}", "eigen_gram": f"SELECT sum(v * v) FROM {_HEAD}",
}


@query("linalg_dense", " UNION ALL ".join(f"SELECT '{k}' AS what, round(({v})::DOUBLE, 2) AS total" for k, v in _DENSE.items()))
def _dense(spark: SparkSession, d: str) -> DataFrame:
    gram = linalg.gram(index.type_view(emb(spark, d), "f64"))
    m = gram.to_numpy() + np.eye(64)
    g, w = NDArray.from_numpy(spark, m), np.arange(64.0)
    p, low, up = (y.to_numpy() for y in linalg.lu(g))
    got = {
        "cholesky": (linalg.cholesky(g).to_numpy() ** 2).sum(), "eigen": (e := linalg.eigen(g)[0].to_numpy()).sum(), "eigen_square": (e**2).sum(),
        "inverse": (linalg.inverse(g).to_numpy() * m.T).sum(), "lstsq": linalg.lstsq(g, NDArray.from_numpy(spark, m @ w)).to_numpy().sum(), "lu": (p.T @ low @ up).sum(),
        "qr": (linalg.qr(g)[1].to_numpy() ** 2).sum(), "solve": linalg.solve(g, NDArray.from_numpy(spark, m @ w)).to_numpy().sum(), "svd": (linalg.svd(g)[1].to_numpy() ** 2).sum(),
        "eigen_gram": linalg.eigen(gram)[0].to_numpy().sum(),
    }
    return spark.createDataFrame([(k, nearest(x, 2)) for k, x in got.items()], "what string, total double")


@query("linalg_det", "SELECT 64.0::DOUBLE AS logs, 24.0::DOUBLE AS det")
def _det(spark: SparkSession, d: str) -> DataFrame:
    """The determinant of a triangle is its diagonal's product, and that of a product is the factors' product."""
    a = np.triu(np.ones((4, 4))) * np.array([1.0, 2, 3, 4])[:, None]
    g = NDArray.from_numpy(spark, np.triu(np.ones((64, 64))) * np.e ** 0.5)
    return spark.createDataFrame([(round(2 * math.log(linalg.det(g)), 6), round(linalg.det(NDArray.from_numpy(spark, a)), 6))], "logs double, det double")


@query("linalg_matmul_advice", "SELECT 512::BIGINT AS m, 64::BIGINT AS k, 64::BIGINT AS n, true AS fits")
def _matmul_advice(spark: SparkSession, d: str) -> DataFrame:
    (m, k), (k2, n) = linalg.matmul_advice(create.zeros(spark, (100_000, 64)), create.zeros(spark, (64, 64)))
    return spark.createDataFrame([(m, k, n, k == k2)], "m long, k long, n long, fits boolean")


# ---------------------------------------------------------------- sources, metadata, advice

_array("source_buffer", lambda s, d: buffers.from_buffer(s, buffers.to_buffer(ev2(s, d)), "f64", ev2(s, d).shape), EV2)
_array("source_cframe", lambda s, d: buffers.from_cframe(s, buffers.to_cframe(create.copy(ev2(s, d), chunkshape=(3, 30)))), EV2)
_array("source_proxy", lambda s, d: proxy.open_proxy(s, "mem:", lambda url, a, b: np.add.outer(np.arange(a[0], b[0]), 2.0 * np.arange(a[1], b[1])), "f64", (40, 50), (16, 16)), f"SELECT i0, i1, (i0 + 2 * i1)::DOUBLE AS v FROM {_N}")


_array("source_save_open", lambda s, d: storage.save(create.copy(ev2(s, d), chunkshape=(4, 30)), storage.scratch(s)), EV2)
_array("source_open_box", lambda s, d: storage.open_box(s, storage.save(create.copy(ev2(s, d), chunkshape=(4, 30)), storage.scratch(s)).meta.urlpath, [2, 35], [9, 70]), f"SELECT i0 - 2 AS i0, i1 - 35 AS i1, v FROM ({EV2}) WHERE i0 BETWEEN 2 AND 8 AND i1 BETWEEN 35 AND 69")
_array("source_slice_buffer", lambda s, d: buffers.from_buffer(s, index.get_slice_buffer(ev2(s, d), [1, 5], [4, 25]), "f64", (3, 20)), f"SELECT i0 - 1 AS i0, i1 - 5 AS i1, v FROM ({EV2}) WHERE i0 BETWEEN 1 AND 3 AND i1 BETWEEN 5 AND 24")
_array("source_trunc_prec", lambda s, d: storage.trunc_prec(ev2(s, d), 10), f"SELECT i0, i1, round(floor(v * pow(2.0, 10 - floor(log2(v)))) / pow(2.0, 10 - floor(log2(v))), 6) AS v FROM ({EV2})")


def _loaded(spark: SparkSession, d: str) -> NDArray:
    return storage.load(spark, storage.save(create.copy(ev2(spark, d), chunkshape=(4, 30)), storage.scratch(spark)).meta.urlpath)


def _overwritten(spark: SparkSession, d: str) -> NDArray:
    """Twice an array, written over the very array that it is read from."""
    path = storage.save(create.copy(ev2(spark, d), chunkshape=(4, 30)), storage.scratch(spark)).meta.urlpath
    return storage.save(storage.open_array(spark, path) * 2.0, path, overwrite=True)


_array("source_load", _loaded, EV2)
_array("source_save_overwrite", _overwritten, f"SELECT i0, i1, round(2 * v, 6) AS v FROM ({EV2})")


@query("source_remove_free", "SELECT true AS stored, count(*) AS cells, false AS kept, 'FILE_NOT_EXIST' AS code, 'nothing is stored there' AS message FROM events")
def _removed(spark: SparkSession, d: str) -> DataFrame:
    path = storage.save(ev2(spark, d), storage.scratch(spark)).meta.urlpath
    there, a = storage.exists(spark, path), storage.load(spark, path)
    cells = a.df.count()
    storage.free(a)
    storage.remove(spark, path)
    try:
        storage.open_array(spark, path)
        code = ""
    except ArrayError as e:
        code = e.code
    return spark.createDataFrame([(there, cells, storage.exists(spark, path), code, strerror(code))], "stored boolean, cells long, kept boolean, code string, message string")


@query("source_config", f"SELECT 'zstd' AS codec, 9::BIGINT AS level, 10::BIGINT AS bits, round(sum(floor(v * pow(2.0, 10 - floor(log2(v)))) / pow(2.0, 10 - floor(log2(v)))), 3) AS total FROM ({EV2})")
def _config(spark: SparkSession, d: str) -> DataFrame:
    """An array stored under a configuration, which is read back with it; the mantissas are cut as it says."""
    path = storage.save(ev2(spark, d), storage.scratch(spark), Config("zstd", 9, mantissa_bits=10)).meta.urlpath
    a = storage.open_array(spark, path)
    c = storage.get_cfg(a)
    return a.origin.agg(rounded(F.sum(a.value), 3).alias("total")).select(F.lit(c.codec).alias("codec"), F.lit(c.level).cast("long").alias("level"), F.lit(c.mantissa_bits).cast("long").alias("bits"), "total")


@query("meta_same_shape", "SELECT true AS same, false AS other_type, false AS other_shape")
def _same_shape(spark: SparkSession, d: str) -> DataFrame:
    a = ev2(spark, d)
    return spark.createDataFrame([(a.meta.same_shape(ev2(spark, d).meta), a.meta.same_shape(a.astype("f32").meta), a.meta.same_shape(a[:, 1:].meta))], "same boolean, other_type boolean, other_shape boolean")


@query("meta_system", "SELECT true AS cores, 1::BIGINT AS capped, true AS cache, 'DATA TYPE is invalid' AS message")
def _system(spark: SparkSession, d: str) -> DataFrame:
    try:
        ArrayMeta("f16", (1,))
        message = ""
    except ArrayError as e:
        message = strerror(e)
    return spark.createDataFrame([(ncores(spark) == spark.sparkContext.defaultParallelism, ncores(spark, 1), l2_size() >= 1 << 10, message)], "cores boolean, capped long, cache boolean, message string")


@query("meta_named_blobs", "SELECT * FROM (VALUES ('a', 'one'), ('b', 'three')) t(name, value)")
def _blobs(spark: SparkSession, d: str) -> DataFrame:
    a = storage.save(create.zeros(spark, (4,)), storage.scratch(spark))
    a = storage.vlmeta_update(storage.vlmeta_add(storage.vlmeta_add(a, "a", b"one"), "b", b"two"), "b", b"three")
    a = storage.vlmeta_delete(storage.vlmeta_add(a, "c", b""), "c")
    back = storage.open_array(spark, a.meta.urlpath)
    return spark.createDataFrame([(n, storage.vlmeta_get(back, n).decode()) for n in storage.vlmeta_names(back)], "name string, value string")


@query("stream_append", f"SELECT i0, i1, v FROM ({EV2})")
def _stream_append(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of cells, appended to a stored array that starts empty."""
    a, path = ev2(spark, d), storage.scratch(spark)
    storage.save(create.zeros(spark, (0, 100), chunkshape=(1, 100)), path)
    a.df.write.parquet(f"{path}-in")
    stream = spark.readStream.schema(a.df.schema).parquet(f"{path}-in")
    append_stream(stream, path, f"{path}-checkpoint", availableNow=True).awaitTermination()
    return storage.open_array(spark, path).df


@query("meta_advice", "SELECT * FROM (VALUES (0::BIGINT, '131072', '8192'), (1, '32,4096', '8,1024'), (2, '256,256', '64,128'), (3, '32,4,1024', '8,2,512')) t(id, chunk, block)")
def _advice(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for i, shape in enumerate(((1_000_000,), (15_000, 1_112_000), (513, 257), (17_000, 3_000, 300_000))):
        c, b = advise("f64", shape, 0, 1 << 20, 0, 64 << 10)
        rows.append((i, ",".join(map(str, c)), ",".join(map(str, b))))
    return spark.createDataFrame(rows, "id long, chunk string, block string")


@query("meta_info", "SELECT count(*) AS cells, count(*) * 8 AS nbytes, 2::BIGINT AS ndim, false AS is_view, false AS is_empty FROM events")
def _info(spark: SparkSession, d: str) -> DataFrame:
    a = ev2(spark, d)
    return spark.createDataFrame([(a.size, a.info()["nbytes"], a.ndim, a.is_view, a.is_empty)], "cells long, nbytes long, ndim long, is_view boolean, is_empty boolean")


# ---------------------------------------------------------------- the flagship


@query("poly_row_sums", f"SELECT i0, round(sum((v - 1.35) * (v - 4.45) * (v - 8.5)), 2) AS v FROM ({EV2}) GROUP BY i0")
def poly_row_sums(spark: SparkSession, d: str) -> DataFrame:
    """The poly workload and a sum along rows: one scan, one expression in generated code, one partial aggregate."""
    return show(reduce.reduce(evaluate("(x - 1.35) * (x - 4.45) * (x - 8.5)", x=ev2(spark, d)), "sum", 1), 2)
