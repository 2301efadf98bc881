import numpy as np
import pytest

from arrayspark.array import NDArray
from arrayspark.meta import ArrayError, Config
from arrayspark.operators import create, index
from arrayspark.sources import buffers, proxy, storage
from arrayspark.streaming.appends import append_stream, windowed

M = np.arange(12 * 13.0).reshape(12, 13)


def test_save_open_load_remove(spark, tmp_path):
    path = str(tmp_path / "a")
    a = create.copy(NDArray.from_numpy(spark, M), chunkshape=(5, 4))
    saved = storage.save(a, path)
    assert saved.meta.urlpath == path and (saved.to_numpy() == M).all() and saved.info()["cbytes"] > 0
    assert (storage.open_box(spark, path, [2, 3], [9, 13]).to_numpy() == M[2:9, 3:13]).all()
    loaded = storage.load(spark, path)
    assert (loaded.to_numpy() == M).all()
    storage.free(loaded)
    with pytest.raises(ArrayError):
        storage.save(a, path)
    with pytest.raises(ArrayError):
        storage.save(a.T, str(tmp_path / "b"))
    assert (storage.save(a * 2, path, overwrite=True, contiguous=True).to_numpy() == 2 * M).all()
    storage.remove(spark, path)
    assert not storage.exists(spark, path)
    with pytest.raises(ArrayError):
        storage.open_array(spark, path)
    with pytest.raises(ArrayError):
        storage.remove(spark, path)


@pytest.mark.parametrize("kind, shape", [("u32", (3, 2, 1, 2)), ("f32", (0,)), ("bool", (5,)), ("u64", (2, 2))])
def test_kinds_survive_storage(spark, tmp_path, kind, shape):
    a = create.ones(spark, shape, kind)
    assert (storage.save(a, str(tmp_path / "a")).to_numpy() == a.to_numpy()).all()
    assert (buffers.from_cframe(spark, buffers.to_cframe(a)).to_numpy() == a.to_numpy()).all()


def test_named_blobs(spark, tmp_path):
    a = storage.save(create.zeros(spark, (4,)), str(tmp_path / "a"))
    a = storage.vlmeta_add(a, "k", b"one")
    assert storage.vlmeta_exists(a, "k") and storage.vlmeta_nitems(a) == 1
    a = storage.vlmeta_update(a, "k", b"two")
    again = storage.open_array(spark, str(tmp_path / "a"))
    assert storage.vlmeta_get(again, "k") == b"two" and storage.vlmeta_names(again) == ["k"]
    for bad in (lambda: storage.vlmeta_add(a, "k", b""), lambda: storage.vlmeta_get(a, "x"), lambda: storage.vlmeta_update(a, "x", b""), lambda: storage.vlmeta_add(index.get_slice(a, [0], [2], view=True), "y", b"")):
        with pytest.raises(ArrayError):
            bad()
    assert storage.vlmeta_nitems(storage.vlmeta_delete(a, "k")) == 0


def test_buffers_check_lengths(spark):
    with pytest.raises(ArrayError):
        buffers.from_buffer(spark, b"\0" * 7, "f64", (1,))
    with pytest.raises(ArrayError):
        buffers.to_buffer(create.zeros(spark, (2,)), 15)
    with pytest.raises(ArrayError):
        buffers.from_cframe(spark, b"nothing")


def test_truncated_precision(spark):
    x = np.array([0.0, -0.1, 1.0, 1023.7, 1e-300, np.inf, np.nan, 1 - 2**-53])
    got = storage.trunc_prec(NDArray.from_numpy(spark, x), 10).to_numpy()
    m, e = np.frexp(x[[1, 2, 3, 4, 7]])
    want = np.ldexp(np.trunc(m * 2**11) / 2**11, e)
    assert (got[[1, 2, 3, 4, 7]] == want).all() and got[0] == 0 and np.isinf(got[5]) and np.isnan(got[6])


def test_proxy_fetches_chunks(spark):
    a = proxy.open_proxy(spark, "mem:x", lambda url, lo, hi: M[lo[0] : hi[0], lo[1] : hi[1]], "f64", M.shape, (5, 4))
    assert a.is_view and (a.to_numpy() == M).all() and (a[1:3, 5].to_numpy() == M[1:3, 5]).all()


def test_append_stream(spark, tmp_path):
    path, source = str(tmp_path / "a"), str(tmp_path / "in")
    storage.save(create.copy(create.zeros(spark, (0, 3)), chunkshape=(2, 3)), path)
    schema = "i0 long, i1 long, v double"
    full = create.arange(spark, (6, 3))
    for k in range(3):
        full.df.where(f"i0 div 2 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = append_stream(stream, path, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    got = storage.open_array(spark, path)
    assert got.shape == (6, 3) and (got.to_numpy() == np.arange(18.0).reshape(6, 3)).all()


def test_windowed(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, double(id) AS v FROM range(120)").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "e"))
    q = windowed(stream, "ts", "v", "1 minute", "1 minute", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["mean"]) for r in spark.sql("SELECT n, mean FROM w ORDER BY start").collect()] == [(60, 29.5), (60, 89.5)]


def test_an_array_may_replace_what_it_is_read_from(spark, tmp_path):
    path = str(tmp_path / "own")
    x = np.arange(24.0).reshape(4, 6)
    storage.save(NDArray.from_numpy(spark, x), path)
    for k in (1, 2):
        storage.save(storage.open_array(spark, path) * 2.0, path, overwrite=True)
        np.testing.assert_array_equal(storage.open_array(spark, path).to_numpy(), x * 2**k)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["own"]


def test_a_box_of_an_external_array_fetches_its_chunks_alone(spark, tmp_path):
    def handler(url, start, stop):
        open(f"{url}/{start[0]}-{start[1]}", "w").close()
        return np.add.outer(np.arange(start[0], stop[0]), 100.0 * np.arange(start[1], stop[1]))

    a = proxy.open_proxy_box(spark, str(tmp_path), handler, "f64", (40, 50), (10, 20), (12, 5), (20, 39))
    np.testing.assert_array_equal(a.to_numpy(), np.add.outer(np.arange(12, 20), 100.0 * np.arange(5, 39)))
    assert {p.name for p in tmp_path.iterdir()} == {"10-0", "10-20"}


def test_configuration_is_stored(spark, tmp_path):
    c = Config("gzip", 1, mantissa_bits=4, max_tasks=2)
    a = storage.save(NDArray.from_numpy(spark, M + 0.123), str(tmp_path / "a"), c)
    assert storage.get_cfg(storage.open_array(spark, str(tmp_path / "a"))) == c == storage.get_cfg(storage.vlmeta_add(a, "k", b"v"))
    assert storage.get_cfg(storage.open_array(spark, str(tmp_path / "a"))) == c  # blobs rewrite the metadata
    assert storage.get_cfg(create.zeros(spark, (2,))) == Config()
    for bad in (dict(codec="x"), dict(level=-1), dict(level=23)):
        with pytest.raises(ArrayError):
            Config(**bad)


def test_a_chunk_in_two_batches_is_refused_and_nothing_beyond_the_shape_is_read(spark, tmp_path):
    path, source = str(tmp_path / "a"), str(tmp_path / "in")
    storage.save(create.copy(create.zeros(spark, (0, 3)), chunkshape=(2, 3)), path)
    full = create.arange(spark, (4, 3))
    full.df.where("i0 < 3").coalesce(1).write.mode("append").parquet(source)
    start = lambda: append_stream(spark.readStream.schema("i0 long, i1 long, v double").option("maxFilesPerTrigger", 1).parquet(source), path, str(tmp_path / "cp"), availableNow=True)
    start().awaitTermination(120)
    full.df.where("i0 = 3").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="stored already"):
        start().awaitTermination(120)
    assert storage.open_array(spark, path).shape == (3, 3)
    storage.write_meta(spark, storage.read_meta(spark, path).but(shape=(2, 3), chunkshape=(2, 3)), path)
    assert (storage.open_array(spark, path).to_numpy() == np.arange(6.0).reshape(2, 3)).all()
