"""Operators of the llm subpackage against brute force on small fixtures."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrayspark.llm import decontaminate, langid, media, mixing, near_dedup, pii, quality, textblocks, toxicity
from arrayspark.llm.components import components, union_find
from arrayspark.llm.shared import labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = r"[^\x20\x09-\x0D]+"


def frame(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["a"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "x " * 5000, "É ñ ü", "\u0000 a\u001f", "no letters: 123 !!", "same text here again", "same text here again"]


# ---------------------------------------------------------------- text blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té€,1", max_size=12)), max_size=8))
def test_tokens_and_hashes(texts):
    buf, off = textblocks.buffers(pa.array(texts, pa.string()))
    start, end, first = textblocks.tokens(buf, off, textblocks.BLANK)
    want = [re.findall(BLANKS, t or "") for t in texts]
    got = [[buf[s:e].tobytes().decode() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in itertools.pairwise(first)]
    assert got == want
    h = textblocks.span_hashes(buf, start, end)
    lower = [w.translate(str.maketrans("B", "b")) for ws in want for w in ws]
    assert all((x == y) == (p == q) for (x, p), (y, q) in itertools.combinations(zip(h, lower, strict=True), 2))


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c", "d" * 9])], names=["i", "text"])
    parts = list(textblocks.slices(iter([batch.slice(1, 5)]), "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [1, 2, 3, 4, 5] and len(parts) > 1
    assert textblocks.buffers(batch.slice(2, 2).column(1))[1].tolist() == [0, 50, 50]


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, k, percent=80):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(BLANKS, t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)]


def near_fixture():
    r = random.Random(3)
    texts = list(ODD) + ["ONE", "a b", "A  B", "a b c"]
    for g in range(12):
        base = words(g, r.choice([5, 20, 60, 200]))
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 20))):
                w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = near_fixture()
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, texts).withColumn("bucket", F.lit(1)).withColumn("rep", F.lit(2)), k).collect()))
    assert got == brute_components(texts, k)


def template_fixture(docs=500, pairs=100, shared=240, own=40):
    """Texts of one long passage and an end of their own, alike below 0.8; ``pairs`` of them also share part of the end."""
    base = words(1, shared)
    texts = [" ".join([*base, *(f"d{i}x{j}" for j in range(own))]) for i in range(docs)]
    for p in range(pairs):
        i, j = p, docs - 1 - p
        texts[j] = " ".join([*base, *(f"d{i}x{x}" for x in range(own // 3)), *(f"e{j}x{x}" for x in range(own - own // 3))])
    r = random.Random(5)
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_within_a_template_group(spark, k):
    texts = template_fixture()
    want = brute_components(texts, k)
    assert sum(not kept for *_, kept in want) == 100  # only the planted pairs are alike
    assert sorted(map(tuple, near_dedup.near_duplicates(frame(spark, texts), k).collect())) == want


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []
    df = frame(spark, ["a b c d e f", "a b c d e f", "z"])
    twice = near_dedup.near_duplicates(df.union(df)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in twice) == [(0, 0, True)] * 2 + [(1, 0, False)] * 2 + [(2, 2, True)] * 2
    nulls = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(nulls).collect()) == [("7", "7", True), ("None", "7", False), ("None", "None", True)]


def test_near_duplicates_of_rows_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words(7, 30))), (1, " ".join(base)), (6, " ".join([*base, "more"])), (None, " ".join(words(9, 50))), (5, " ".join([*words(9, 50), "x"])), (8, "alone here"), (8, None), (8, "alone here")]
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumn("_row", F.lit("x")).withColumn("row", F.lit(1))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted([("1", 26, "1", True), ("1", 56, "1", True), ("6", 57, "1", False), ("None", 46, "5", False), ("5", 47, "5", True), ("8", 1, "8", True), ("8", 0, "8", True), ("8", 1, "8", True)])
    one = near_dedup.deduplicate(df)
    assert one.columns == df.columns
    left = sorted((str(r.doc_id), str(r.text)[:10]) for r in one.collect())
    assert left == sorted([("1", texts[0][1][:10]), ("1", texts[1][1][:10]), ("5", texts[4][1][:10]), ("8", "alone here"), ("8", "None")])
    assert near_dedup.deduplicate(df.limit(0)).collect() == []


def test_near_duplicates_of_one_large_bucket(spark):
    """Thousands of texts that meet in the same bands, chained at just above 0.8, beside others at just below."""
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*base, *(f"t{i // 2}x{j}" for j in range(21 + 3 * (i % 2)))]) for i in range(3000)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    grams = lambda t: set(zip(*(t.split()[k:] for k in range(5)), strict=False))
    near = lambda i, j: 5 * len((a := grams(texts[i])) & (b := grams(texts[j]))) >= 4 * len(a | b)
    assert near(0, 1) and not near(0, 2) and not near(1, 2) and not near(1, 3)
    assert got == {i: i // 2 * 2 for i in range(3000)}


def test_super_minhash_is_the_sequential_one():
    m, seed = 16, 5
    values, first = textblocks.seeds(40, 77), np.array([0, 0, 1, 9, 40])
    sig = near_dedup.super_minhash(values, first, m, seed)
    steps = textblocks.seeds(m, seed + 1)
    for d, (a, b) in enumerate(itertools.pairwise(first)):
        want = [0xFFFFFFFF] * m
        for v in values[a:b]:
            state = textblocks.mix(np.array([v]) ^ textblocks.seeds(1, seed)[0])
            p = list(range(m))
            for rank in range(m):
                x = int(textblocks.mix(state + steps[rank])[0])
                k = rank + ((x >> 32) * (m - rank) >> 32)
                p[rank], p[k] = p[k], p[rank]
                want[p[rank]] = min(want[p[rank]], rank << 25 | x & 0x1FFFFFF)
        assert sig[d].tolist() == want


def test_super_minhash_estimates_jaccard():
    v = textblocks.seeds(1500, 78)
    sets = np.concatenate([v[:1000], v[200:1200]])
    errors = [abs((lambda s: (s[0] == s[1]).mean())(near_dedup.super_minhash(sets, np.array([0, 1000, 2000]), 128, s)) - 800 / 1200) for s in range(5, 25)]
    assert np.mean(errors) < 0.05


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 300)]
    want = {}
    for a, b in links:
        x, y = want.get(a, a), want.get(b, b)
        for n in {a, b, *want}:
            if want.get(n, n) in (x, y):
                want[n] = min(x, y)
    got = {n: t for n, t in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {n: t for n, t in want.items() if n != t}
    nodes, roots = union_find(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


# ---------------------------------------------------------------- decontamination


def brute_distance(item, text):
    best = len(item)
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
        best = min(row)
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    items = [words(100 + i, n, 5000) for i, n in enumerate([2, 5, 9, 18, 33, 50])]
    texts = list(ODD)
    for i, item in enumerate(items):
        for edits in (0, 0, 1, 2):
            w = list(item)
            for _ in range(edits if len(w) > 17 else 0):
                w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(words(r.random(), 40, 5000) + w + words(r.random(), 30, 5000)).title())
        texts.append(" ".join(item[: len(item) // 2]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, ""), (92, "!!!")], "item_id long, text string")
    docs = frame(spark, texts).withColumn("item_id", F.lit(5))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[a-z0-9\u0080-￿]+", (t or "").lower())
        for i, item in enumerate(items):
            if (n := brute_distance(item, w)) <= 0.2 * len(item):
                want[d, i] = n
    assert got == want
    clean = {x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    # a benchmark in parts gives the same
    parts = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs, bench, max_items=3).collect()}
    assert parts == want
    assert decontaminate.contaminated(frame(spark, []), bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_decontamination_of_items_cut_by_a_text(spark):
    """What a text is found to hold doesn't depend on the texts beside it, nor on partitions."""
    r = random.Random(11)
    for n, head, tail in ((50, 5, 5), (16, 2, 1), (30, 3, 3)):
        items = [(i, words(1000 * n + i, n, 3000)) for i in range(40)]
        texts = []
        for _, w in items:
            texts += [" ".join(words(r.random(), 60, 3000)), " ".join(w[head : n - tail]), " ".join(words(r.random(), 60, 3000))]
        want = {(i * 3 + 1, i): head + tail for i in range(40)}
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
        docs = frame(spark, texts)
        for df in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.xxhash64("doc_id")).repartition(50)):
            assert {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(df, bench).collect()} == want


@pytest.mark.parametrize("n", [14, 15, 17, 20, 24, 45])
def test_recall_by_length_of_item(n):
    r = random.Random(n)
    items = [(i, words(500 * n + i, n, 3000)) for i in range(50)]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in items], 0.2)
    texts = []
    for _, w in items:
        w = list(w)
        for p in r.sample(range(n), n // 5):
            w[p] = r.choice(["", "new", f"{w[p]} new"])
        texts.append(" ".join([*words(r.random(), 30, 3000), *w, *words(r.random(), 30, 3000)]))
    found = {m[:2] for m in index.matches(*textblocks.buffers(pa.array(texts)))}
    assert sum((i, i) in found for i in range(50)) >= 48


def test_walk_recall():
    r = random.Random(6)
    items = [(i, " ".join(words(500 + i, 40, 3000))) for i in range(60)]
    index = decontaminate.Index(items, 0.2)
    found = total = 0
    for share, least in ((0.05, 0.99), (0.1, 0.97)):
        found = total = 0
        for i, t in items:
            w = t.split()
            for _ in range(int(share * len(w))):
                p = r.randrange(len(w))
                w[p : p + 1] = r.choice([[], ["new"], [w[p], "new"]])
            text = " ".join(words(r.random(), 50, 3000) + w + words(r.random(), 50, 3000))
            total += 1
            found += any(m[1] == i for m in index.matches(*textblocks.buffers(pa.array([text]))))
        assert found / total >= least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=7), st.lists(st.integers(0, 4), max_size=12))
def test_edit_distance(item, text):
    assert decontaminate.edit_distance(np.array(item), np.array(text, int))[0] == brute_distance(item, text)


# ---------------------------------------------------------------- personal data


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789012345678900+..- ()@abé%\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token =", "a.b@c.de", "0123456789abcdef01234567", "10.1.2.3", "+1 202 555 0100", "202-555-0100", "@me", "x@y", "é", '"', "9" * 20, " " * 150, "Ab3" * 9]), max_size=9), st.sampled_from([" ", "", "\n"]))
def test_candidates_equal_brute_force(parts, gap):
    text = gap.join(parts)
    base = brute_spans(text)
    reach = lambda a, b: any(s < b and e > a for _, s, e in base)
    want = [(kind, *m.span()) for kind, p in pii._WIDE for m in p.finditer(text) if not reach(*m.span())]
    got = list(pii.candidates(text, base))
    assert [s for s, _, _ in got] == want
    assert [f[6] for _, _, f in got] == [int(reach(s - 200, e + 200)) for _, s, e in want]


def test_candidates_take_linear_time():
    text = "1.2.3.4 5.6.7.8 x@y " * 30_000
    assert len(list(pii.candidates(text, pii.base_spans(text)))) == 30_000


def test_base_spans_take_linear_time():
    for long in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "+1(" + "(" * 300_000):
        pii.base_spans(long)
        list(pii.candidates(long[:100_000], []))
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]


def test_personal_data(spark):
    secret = [f'bla token = "{hashlib.sha1(str(i).encode()).hexdigest()}" é blub' for i in range(40)]
    decoy = [f"foo {1234567890123450 + i} bar" for i in range(40)]
    texts = [*ODD, "é mail me: a.b@c.example.org, or +1 (974) 555-3436", "4111 1111 1111 1111 at 10.0.0.255", *secret, *decoy]
    docs = frame(spark, texts).withColumn("spans", F.lit("x"))
    model = pii.fit(docs)
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in pii.find(docs, model).collect()}
    n = len(ODD)
    assert len(got) == len(texts) and all(not got[i] for i in range(n))
    for i, t in enumerate(texts):
        fixed = [s for s in got[i] if s[0] in pii.KINDS[:4]]
        assert fixed == brute_spans(t or "")
    assert all(any(s[0] == "secret" for s in got[i]) for i in range(n + 2, n + 42))
    assert not any(s[0] not in pii.KINDS[:4] for i in range(n + 42, n + 82) for s in got[i])
    assert model.reliability["gazetteer"] > 0.8
    red = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert red[n].text == "é mail me: <EMAIL>, or <PHONE>" and red[n + 1].text == "<CARD> at <IP>" and red[0].text is None and red[3].spans == "x"
    assert "<SECRET>" in red[n + 2].text and red[n + 50].text == texts[n + 50]
    assert pii.fit(frame(spark, [])) is None and pii.find(frame(spark, []), None).collect() == []
    assert pii.replace("abcdef", [("email", 1, 4), ("ip", 2, 5)]) == "a<EMAIL>f"


# ---------------------------------------------------------------- media


def test_media_round_trip(spark):
    texts = [*ODD, "x" * 192, "y" * 193, "long é " * 30_000]
    rows = {r.doc_id: r for r in media.media_digests(frame(spark, texts).withColumn("feature", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        kind = ("wav", "bmp", "png")[zlib.crc32(payload) % 3]
        stored = media.store(payload, kind)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert "segments=1" in r.feature and f"medium={kind};" in r.feature and (f"actual={kind};" in r.feature) == (";at=0;" in r.feature)
    assert {";at=0;" in r.feature for r in rows.values()} == {True, False}  # some are carved
    a, b = rows[8].asDict(), rows[9].asDict()
    assert {k: v for k, v in a.items() if k != "doc_id"} == {k: v for k, v in b.items() if k != "doc_id"}


@pytest.mark.parametrize("kind", ["wav", "bmp", "png"])
def test_sniffing_confirms_and_carves(kind):
    auto = media.automaton()
    payload = media.payload_of(b"BM RIFF GIF89a text " * 40)
    blob = media.store(payload, kind)
    assert media.segments(blob, auto) == [(kind, 0, len(blob))] and media.read_back(blob, kind) == payload
    mixed = b"RIFF BM\x89PNG" + blob + b"junk" + blob + blob[:-7]
    found = media.segments(mixed, auto)
    assert [(k, n) for k, _, n in found if k == kind and n == len(blob)] == [(kind, len(blob))] * 2
    assert media.read_back(mixed[found[0][1] : found[0][1] + found[0][2]], kind) == payload
    assert media.segments(blob[:-1], auto) == [] or kind != "wav"


def test_other_formats():
    auto = media.automaton()
    import gzip

    z = gzip.compress(b"data " * 1000)
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(8) + b"\x00" + b"\x02\x02\x44\x01\x00" + b";"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
    assert media.segments(b"__" + z + gif + jpeg, auto) == [("gzip", 2, len(z)), ("gif", 2 + len(z), len(gif)), ("jpeg", 2 + len(z) + len(gif), len(jpeg))]


def test_declared_types_are_corrected(spark):
    blob = media.store(media.payload_of(b"abc"), "png")
    df = spark.createDataFrame([(1, bytearray(blob), "jpg"), (2, bytearray(b"zz" + blob), "jpg"), (3, None, "bin"), (4, bytearray(b""), None)], "id long, blob binary, declared string")
    got = {r.id: (r.declared, r.actual, [(m.type, m["at"], m.length) for m in r.media]) for r in media.sniff(df, ("id",)).collect()}
    assert got == {1: ("jpg", "png", [("png", 0, len(blob))]), 2: ("jpg", "jpg", [("png", 2, len(blob))]), 3: ("bin", "bin", []), 4: (None, None, [])}


def test_carving_gives_the_media(spark):
    a, b = (media.store(media.payload_of(t), k) for t, k in ((b"abc" * 99, "png"), (b"RIFF BM", "wav")))
    df = spark.createDataFrame([(1, bytearray(b"zz" + a + b"-" + b + a[:9]), "zip"), (2, None, "bin"), (3, bytearray(b), "png")], "id long, blob binary, declared string").withColumn("media", F.lit(1))
    got = sorted((r.id, r.actual, r.type, r["at"], bytes(r.medium)) for r in media.carve(df, ("id",)).collect())
    assert got == [(1, "zip", "png", 2, a), (1, "zip", "wav", 3 + len(a), b), (3, "wav", "wav", 0, b)]


def test_false_magic_bytes_take_linear_time():
    auto = media.automaton()
    for magic in (b"GIF89a1234567!aaaaaaa", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd1234", b"RIFFaaaaWAVE", b"BM" + b"a" * 60, b"\x89PNG\r\n\x1a\naaaa", b"\x1f\x8b\x08zzzzzzzz"):
        assert media.segments(magic * 100_000, auto) == []


# ---------------------------------------------------------------- language


def plain_states(p, text, d):
    """States of direction ``d`` in reading order, one number after the other."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(p["w"].shape[-1]), []
    for b in text if d == 0 else text[::-1]:
        z, r = (sigmoid(p["w"][g, d, b] + h @ p["u"][g, d]) for g in (0, 1))
        n = np.tanh(p["w"][2, d, b] + r * (h @ p["u"][2, d]))
        h = (1 - z) * n + z * h
        out.append(h)
    return np.array(out)


def random_network(hidden, classes, kind="f8"):
    rng = np.random.default_rng(1)
    sizes = {"w": (3, 2, 256, hidden), "u": (3, 2, hidden, hidden), "v": (2 * hidden, classes), "c": (classes,)}
    return {k: rng.normal(0, 0.5, s).astype(kind) for k, s in sizes.items()}


def test_states_are_those_of_a_gated_network():
    p = random_network(3, 2)
    x = np.random.default_rng(2).integers(0, 256, (5, 4))
    got = langid.states(p, x)
    for row in range(4):
        for d in (0, 1):
            np.testing.assert_allclose(got[:, d, row], plain_states(p, x[:, row], d))


def test_gradient():
    p = random_network(3, 2)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (5, 4))
    target = rng.normal(size=(5, 2, 4, 3))
    kept: list = []
    langid.states(p, x, kept)
    grad = langid.back(p, kept, target)
    loss = lambda: float((langid.states(p, x) * target).sum())
    for k, last in (("w", int(x[2, 1])), ("u", 1)):
        for at in itertools.product(range(3), range(2), [last], range(3)):
            old = p[k][at]
            p[k][at] = old + 1e-5
            up = loss()
            p[k][at] = old - 1e-5
            down = loss()
            p[k][at] = old
            assert math.isclose((up - down) / 2e-5, grad[k][at], rel_tol=1e-5, abs_tol=1e-7), (k, at)


def test_sample_of_languages_is_bounded(spark):
    texts = [" ".join(words(i, 40)) for i in range(400)]
    docs = frame(spark, texts).withColumn("doc_id", F.lit(7).cast("long"))
    seen = {}
    real, langid.train_network = langid.train_network, lambda x, y, n, **o: seen.update(rows=len(x)) or random_network(2, n, "f4")
    try:
        langid.fit(docs, per_language=10, windows=3)
        assert seen["rows"] == 2 * 10 * 3
        langid.fit(frame(spark, texts), per_language=10, windows=3)
        assert 0 < seen["rows"] <= 60
    finally:
        langid.train_network = real
    labels = spark.createDataFrame([(7, 1)], "doc_id long, label int")
    assert labelled_sample(docs, labels, 100, 5, 0).count() == 1


def test_language(spark):
    r = random.Random(2)
    parts = {"aa": "the and ing tion er st".split(), "bb": "der sch ung ein ich zu".split(), "cc": "é eau oi que ment è".split()}
    texts, langs = list(ODD), ["aa"] * len(ODD)
    for i in range(240):
        lang = list(parts)[i % 3]
        texts.append(" ".join("".join(r.choices(parts[lang], k=2)) for _ in range(r.randrange(8, 60))))
        langs.append(lang)
    docs = frame(spark, texts, lang=langs).withColumn("score", F.lit(9))
    model = langid.fit(docs, steps=120)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    held = [i for i in range(len(ODD), len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) >= 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[5].lang_pred != "und" and got[3].lang_pred in parts
    assert got[8].score == got[9].score and all(0 <= x.score <= 1 for x in got.values())
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {x.lang_pred for x in langid.identify(docs, None).collect()} == {"und"} and langid.identify(frame(spark, []), model).collect() == []


def test_pooling_covers_whole_texts():
    p = random_network(4, 2, "f4")
    model = langid.LanguageModel(("a", "b"), p)
    texts = ["", "x", "abc" * 50, "q" * langid.WINDOW, "tail é", "long " * 5000]
    got = model.documents(*textblocks.buffers(pa.array(texts)), block=2)
    for t, g in zip(texts, got, strict=True):
        b = t.encode()
        want = np.zeros(2)
        for a in range(0, min(len(b), 3 * langid.WINDOW) if len(t) > 5000 else len(b), langid.WINDOW):
            part = b[a : a + langid.WINDOW]
            w = part.ljust(langid.WINDOW)
            logit = plain_states(p, w, 0) @ p["v"][:4] + plain_states(p, w, 1)[::-1] @ p["v"][4:] + p["c"]
            e = np.exp(logit)
            want += (e / e.sum(axis=1, keepdims=True))[: len(part)].sum(axis=0)
        if len(t) <= 5000:
            np.testing.assert_allclose(g, want / max(1, len(b)), rtol=1e-4)
        else:
            assert math.isclose(g.sum(), 1, rel_tol=1e-4)


# ---------------------------------------------------------------- mixing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_sainte_lague(sources, seats):
    claims, most = [float(c) for c, _ in sources], [m for _, m in sources]
    want = [0] * len(claims)
    for _ in range(min(seats, sum(most))):
        i = max((i for i in range(len(claims)) if want[i] < most[i]), key=lambda i: (claims[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    got = mixing.sainte_lague(claims, seats, most)
    assert sum(got) == sum(want) and all(g <= m for g, m in zip(got, most, strict=True))
    if sum(most) > 10 * seats:
        quotient = lambda s: sorted((c / (2 * k + 1) for c, n in zip(claims, s, strict=True) for k in range(n)), reverse=True)
        assert quotient(got) == quotient(want)


def test_targets():
    t = mixing.targets([100, 1000, 0, 300], [3, 1, 2, 3], 2100, 2)
    assert t[2] == 0 and t[0] == 200 and t[3] == 600 and t[1] == 1300
    assert mixing.targets([10, 10], [3, 1], 30, 2) == [20, 10]


def walked(docs, weights=(3, 1, 2), share=1.5, cap=2, block=16):
    """Words taken of {source: [(row, size), ...] in their seeded order}, word by word, where each source is one shard."""
    sources = sorted(docs, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, n in docs[s][0]) for s in sources]
    want = mixing.targets(sizes, [weights[i % 3] for i in range(len(sources))], share * sum(sizes), cap)
    quota = mixing.share_out(want, round(sum(want)), [int(cap * n) for n in sizes], block)
    taken = {}
    for s, n, q in zip(sources, sizes, quota, strict=True):
        rows, begin = docs[s]
        circle = [r for r, size in rows for _ in range(size)]
        taken |= {r: 0 for r, _ in rows}
        for k in range(q):
            taken[circle[(begin + k) % n]] += 1
    return taken, dict(zip(sources, want, strict=True))


def test_mixture_equals_a_walk_over_words(spark):
    r = random.Random(9)
    texts = list(ODD) + [" ".join(words(i, r.randrange(1, 90))) for i in range(120)]
    source = [None if i % 11 == 0 else r.choice(["a", "é", "b", "Z"]) for i in range(len(texts))]
    docs = frame(spark, texts, source=source)
    got = {x.doc_id: x for x in mixing.mixture(docs, carry=("source",)).collect()}
    spots = docs.select("doc_id", "source", F.xxhash64("doc_id", "text", "source", F.lit(11)).alias("spot"), F.xxhash64("source", F.lit(0).cast("long"), F.lit(13).cast("long")).alias("b"))
    order = {}
    for x in spots.withColumn("at", F.xxhash64("spot", F.lit(12))).orderBy("at", "doc_id").collect():
        rows, _ = order.setdefault(x.source, ([], x.b))
        rows.append((x.doc_id, got[x.doc_id]["size"]))
    begin = {s: b % max(1, (n := sum(k for _, k in rows)) // 16) * 16 if (n := sum(k for _, k in rows)) else 0 for s, (rows, b) in order.items()}
    taken, want = walked({s: (rows, begin[s]) for s, (rows, _) in order.items()})
    assert {i: x.taken for i, x in got.items()} == taken
    assert all(math.isclose(x.target, want[x.source]) for x in got.values())


def test_mixture(spark):
    r = random.Random(8)
    texts = list(ODD) + [" ".join(words(i, r.randrange(1, 90))) for i in range(400)]
    source = [None if i % 11 == 0 else r.choice(["a", "a", "a", "é", "b", "Z"]) for i in range(len(texts))]
    docs = frame(spark, texts, source=source).withColumn("size", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("n", F.lit("n"))
    for shard in (100, 4_000_000):
        rows = mixing.mixture(docs, shard_words=shard, carry=tuple(docs.columns)).collect()
        again = mixing.mixture(docs.repartition(7), shard_words=shard, carry=tuple(docs.columns)).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
        assert len(rows) == len(texts) and list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars", "shard", "n", "size", "source_size", "target", "taken"]
        sizes, taken, target = {}, {}, {}
        for x in rows:
            assert x.text == texts[x.doc_id] and x.source == source[x.doc_id] and x.n == "n"
            assert x["size"] == len(re.findall(BLANKS, texts[x.doc_id] or "")) and 0 <= x.taken <= 2 * x["size"]
            sizes[x.source] = sizes.get(x.source, 0) + x["size"]
            taken[x.source] = taken.get(x.source, 0) + x.taken
            target[x.source] = x.target
        assert all(x.source_size == sizes[x.source] for x in rows)
        assert math.isclose(sum(target.values()), 1.5 * sum(sizes.values()))
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 16, (s, taken[s], target[s])
    assert mixing.mixture(frame(spark, [])).collect() == []
    assert [x.taken for x in mixing.mixture(frame(spark, [None, "", " "])).collect()] == [0, 0, 0]


def test_mixture_spreads_one_id_and_takes_repeated_rows(spark):
    texts = [" ".join(words(i, 40)) for i in range(300)]
    same = frame(spark, texts).withColumn("doc_id", F.lit(None).cast("long")).unionByName(frame(spark, ["a b c"] * 50).withColumn("doc_id", F.lit(3).cast("long")))
    plan = mixing.mixture(same, shard_words=500)
    rows = plan.collect()
    assert len(rows) == 350 and abs(sum(x.taken for x in rows) - 1.5 * sum(x["size"] for x in rows)) <= 16
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(same.repartition(5), shard_words=500).collect()))
    spot = same.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(25)).alias("s")).where("s is not null").distinct().count()
    assert spot > 20  # rows without an id lie in many shards


# ---------------------------------------------------------------- quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 1, 4, 9])
    score, pairs = rng.normal(size=9) * 2, rng.normal(size=(2, 2))
    good, pair = quality.marginals(score, pairs, first)
    for a, b in itertools.pairwise(first):
        total, want, want2 = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(sum(score[a + i] * s for i, s in enumerate(y)) + sum(pairs[s, t] for s, t in itertools.pairwise(y)))
            total += w
            want += w * np.array(y)
            for i, (s, t) in enumerate(itertools.pairwise(y), 1):
                want2[i, s, t] += w
        np.testing.assert_allclose(good[a:b], want / total)
        np.testing.assert_allclose(pair[a:b], want2 / total, atol=1e-12)


def labelled(spark, seed, bad):
    r = random.Random(seed)
    texts, labels = list(ODD), []
    for i in range(len(ODD), 300):
        w = words(seed + i, r.randrange(6, 120))
        y = int(r.random() < 0.7)
        texts.append(bad(w, r) if not y else ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)))
        labels.append((i, y))
    return frame(spark, texts).withColumn("score", F.lit(1)), spark.createDataFrame([*labels, labels[0], (3, None)], "doc_id long, label int"), dict(labels)


def accuracy(rows, labels, at):
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    got = {r.doc_id: r.score for r in rows}
    assert all(0 <= s <= 1 for s in got.values()) and got[8] == got[9]
    return np.mean([(got[d] >= at) == labels[d] for d in held])


def test_quality(spark):
    docs, labels, truth = labelled(spark, 1, lambda w, r: r.choice(["\n".join(w).upper() + "!!", " | ".join(w), (w[0] + " ") * len(w), "%%% ".join(w)]))
    field = quality.fit(docs, labels)
    rows = quality.quality(docs, field).collect()
    assert len(rows) == docs.count() and accuracy(rows, truth, 0.3) >= 0.95
    one = quality.fit(docs, labels.where("label = 1"))
    assert {r.score for r in quality.quality(docs, one).collect()} == {1.0}
    assert quality.quality(frame(spark, []), field).collect() == [] and quality.fit(frame(spark, []), labels.limit(0)).constant == 0.5


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, 2, lambda w, r: " ".join(w[: len(w) // 2] + r.choices(["idiot,", "Moron", "trash!"], k=4) + w[len(w) // 2 :]))
    labels = labels.withColumn("label", 1 - F.col("label"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert accuracy(rows, {d: 1 - y for d, y in truth.items()}, 0.5) >= 0.95 and len(rows) == docs.count()
    assert 0 < len(model.at) < 3000  # most coordinates have no weight
    kept = toxicity.toxicity(docs.drop("score"), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"] and kept.count() == docs.count()
    none = toxicity.fit(docs, labels.where("label = 1"))
    assert len(none.at) == 0 and toxicity.toxicity(frame(spark, []), model).collect() == []


def test_toxicity_features():
    buf, off = textblocks.buffers(pa.array(["One, two THREE four", "one", None, "two"]))
    doc, x = toxicity.features(buf, off, 40)
    assert np.bincount(doc, minlength=4).tolist() == [4 + 3 + 2, 1, 0, 1]
    own = lambda d: set(x[doc == d].tolist())
    assert own(1) < own(0) and own(3) < own(0) and not own(1) & own(3)


def test_ftrl_is_the_textbook_one():
    r = random.Random(1)
    rows = [(np.array(sorted(r.sample(range(16), 4))), r.randrange(2)) for _ in range(60)]
    got = toxicity.train_ftrl(rows, 4, alpha=0.5, beta=1.0, l1=0.2, l2=0.1, epochs=2, seed=3)
    z, n, order, seen = [0.0] * 16, [0.0] * 16, np.random.default_rng(3), 0.0
    rate = (sum(y for _, y in rows) + 0.5) / 61
    bias = math.log(rate / (1 - rate))
    weight = lambda i: 0.0 if abs(z[i]) <= 0.2 else -(z[i] - math.copysign(0.2, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1)
    for _ in range(2):
        for k in order.permutation(60):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
                z[i] += g - s * w[i]
                n[i] += g * g
            seen += g * g
            bias -= 0.1 * g / (1 + math.sqrt(seen))
    want = {i: weight(i) for i in range(16) if weight(i)}
    assert dict(zip(got.at.tolist(), got.weight.round(9).tolist(), strict=True)) == {i: round(w, 9) for i, w in want.items()}
