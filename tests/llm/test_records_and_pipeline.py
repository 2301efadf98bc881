"""Chat and WARC records against DuckDB, and the pipeline against its stages taken one by one."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arrayspark.llm import chat, decontaminate, near_dedup, pii, queries, toxicity, warc


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df)
    r = c.sql(sql)
    at = [r.columns.index(x) for x in sorted(r.columns)]
    return sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob|x\n", "é ñ"), (1, 3, "ann", None), (1, 3, "ann", "tie"), (1, 3, "ann", "tie"),
    (1, 64, "bob|x\n", "later"), (1, -1, "ann", "before"), (1, -64, "ann", "long before"), (1, -65, None, "longer"), (1, None, None, "no turn"), (2, 0, "system", "alone"), (3, 0, "user", ""), (None, 5, "user", "null conversation"), (None, 6, "assistant", "x" * 5000),
]


def test_chat_rotation(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(TURNS, schema)
    got = chat.rotate(df.withColumn("part", F.lit(1)).withColumn("perspective", F.lit("q")))
    pdf = pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert rows(got) == duck(chat.SQL, conversations=pdf)
    assert chat.rotate(spark.createDataFrame([], schema)).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in got.collect():  # the mask covers what the assistant says, and nothing else
        at, said = 0, []
        for run in r.mask.split(","):
            value, n = map(int, run.split("*"))
            if value:
                said.append(r.text[at : at + n])
            at += n
        assert at == len(r.text) and len(said) == r.text.count("<|assistant|>\n") and all(s.endswith(chat.END) for s in said)


PAGES = [
    (1, "http://a.example/x", '<!DOCTYPE html><html lang="fr"><head><title> A\n b </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- c --><p>Hello&nbsp;<b>w</b>&amp;lt;&#39;<br>x<a href="/y">y</a></body></html>'),
    (2, None, None), (3, "http://b", ""), (4, "http://c", "no tags a < b > c &quot;"), (5, "http://d", "<p>open <script>never closed"), (1, "http://a.example/x", "<p>again"), (6, "http://e", "<li>é</li>" * 3000),
]


def test_warc_derivatives(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame(PAGES, schema).withColumn("block", F.lit("b"))
    made = warc.derive(warc.responses(df, carry=("page_id",)), carry=("page_id",))
    want = duck(warc.SQL, pages=pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    assert rows(made) == want
    for packed in (False, True):  # by way of the bytes of WARC files, plain and packed
        files = warc.serialise(warc.as_records(warc.responses(df, carry=("page_id",)), ("page_id",)), ("page_id",), packed)
        assert rows(warc.derive(warc.parse(files, ("page_id",)), ("page_id",))) == want
    assert warc.derive(warc.responses(spark.createDataFrame([], schema))).collect() == []
    first = {r.record_type: r for r in made.collect() if r.target_uri == "http://a.example/x" and ("Hello" in r.block or "language: fr" in r.block)}
    assert first["conversion"].block == "A b\nHello w&lt;'\nxy"
    assert "title: A b\r\n" in first["metadata"].block and "outlink: /y\r\n" in first["metadata"].block and "source-header: HTTP/1.1 200 OK\r\n" in first["metadata"].block
    assert first["conversion"].refers_to == first["metadata"].refers_to != first["conversion"].record_id


def test_warc_files_round_trip(spark):
    import gzip

    make = lambda i, body, head="Content-Type: text/html", stated="": b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI: http://a\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n%sContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n%s\r\n\r\n%s\r\n\r\n" % (i, stated.encode(), len(head) + 21 + len(body), head.encode(), body)
    odd = b"\xff\xfe WARC/1.1\r\n\r\n\x00<p>b</p>"
    first = make(1, "<p>xé</p>".encode(), stated="WARC-Payload-Digest: sha1:ABC\r\n")
    second, latin = make(2, odd), make(3, b"<p>\xe9</p>", "Content-Type: text/html; charset=ISO-8859-1")
    other = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n"
    plain = other + first + second + latin
    packed = b"".join(map(gzip.compress, (other, first, second, latin)))
    files = [plain, packed, gzip.compress(plain), None, b"", b"no records", first[:150], b"junk" + other + latin[:-5]]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "file int, record binary")
    got = sorted((tuple(r) for r in warc.parse(df, ("file",)).collect()), key=str)
    for k in (0, 1, 2):
        a, b, c = [r for r in got if r[0] == k]
        assert a[1:] == ("<urn:uuid:1>", "http://a", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n", "<p>xé</p>".encode(), "sha1:ABC")
        assert (b[1], bytes(b[5])) == ("<urn:uuid:2>", odd) and b[6].startswith("sha256:") and bytes(c[5]) == b"<p>\xe9</p>"
    assert [(r[0], bytes(r[5])) for r in got if r[0] > 2] == [(7, b"<p>\xe9</p")]
    assert warc.records(df, ("file",)).where("file = 0").count() == 4
    made = warc.derive(warc.parse(df.where("file = 1")))
    text = {r.refers_to: r for r in made.collect() if r.record_type == "conversion"}
    assert [text[f"<urn:uuid:{k}>"].block for k in (1, 2, 3)] == ["xé", "\ufffd\ufffd WARC/1.1 \x00\nb", "é"] and text["<urn:uuid:1>"].payload_digest == "sha1:ABC"
    # what is written can be read: links, digests and blocks stay
    back = {r.record_id: r for r in warc.records(warc.serialise(made, gzip=True)).collect()}
    assert len(back) == 6
    for r in made.collect():
        b = back[r.record_id]
        assert (b.record_type, b.refers_to, b.target_uri, b.payload_digest, b.block_digest, bytes(b.block).decode()) == (r.record_type, r.refers_to, r.target_uri, r.payload_digest, r.block_digest, r.block)
    record = bytes(warc.serialise(made.where("record_type = 'conversion' and refers_to like '%1>'")).first().record)
    assert b"WARC-Refers-To: <urn:uuid:1>\r\n" in record and b"WARC-Payload-Digest: sha1:ABC\r\n" in record and record.endswith("Content-Length: 3\r\n\r\nxé\r\n\r\n".encode())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    r = random.Random(1)
    say = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    item = say(30)
    texts = [None, "", "short"] + [say(r.randrange(30, 120)) for _ in range(150)]
    toxic = list(range(10, 60, 2))
    for i in toxic:
        texts[i] += " you idiot moron trash"
    texts[70] = texts[71] + " tail"
    texts[72] = texts[73]
    texts[80] += " " + item
    texts[90] += " write to a.b@example.com or 10.1.2.3"
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(3)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, toxic


def test_pipeline_decisions(spark, corpus):
    d, texts, toxic = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d).cache()
        assert docs.columns == before.columns, name
        seen[name] = {r.doc_id for r in docs.collect()}
    clean = set(range(len(texts))) - set(toxic)
    assert seen["toxicity"] == clean
    assert seen["near_dedup"] == clean - {71, 73}
    assert seen["decontamination"] == clean - {71, 73, 80} == seen["pii"]
    new = {r.doc_id: r for r in docs.collect()}
    assert new[90].text.endswith("write to <EMAIL> or <IP>") and new[90].n_chars == len(new[90].text) and new[0].text is None
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in mixed} <= seen["pii"] and all(0 < r.taken <= 2 * r["size"] for r in mixed)
    total = sum(len((r.text or "").split()) for r in new.values())
    assert abs(sum(r.taken for r in mixed) - 1.5 * total) < 0.02 * total
    assert rows(corpus_pipeline.run(spark, d)) == rows(spark.createDataFrame(mixed, corpus_pipeline.STAGES[-1][1](spark, docs, d).schema))


def test_near_dedup_stage_within_a_template_group(spark):
    import random

    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(240)]
    texts = {i: " ".join([*base, *(f"d{i}x{j}" for j in range(40))]) for i in range(500)}
    for i in range(100):  # shares a third of the end of text i: above 0.8, where the passage alone is below
        texts[499 - i] = " ".join([*base, *(f"d{i}x{j}" for j in range(13)), *(f"e{i}x{j}" for j in range(27))])
    grams = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
    near = {j for j in grams for i in range(j) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])}
    assert near == set(range(400, 500))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(texts) - near


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    d, _, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if re.match(r"op([2-7]|9|10)_", q)))
def test_registered_queries_cover_all_rows(spark, corpus, name):
    d, texts, _ = corpus
    df = queries.QUERIES[name](spark, d)
    if name.startswith("op2_"):
        assert {(r.doc_id, r.item_id) for r in df.collect()} == {(80, 0)}
    else:
        assert sorted(r.doc_id for r in df.collect()) == list(range(len(texts)))


def test_stages_use_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    assert all(m for m in (toxicity.fit, near_dedup.near_duplicates, decontaminate.decontaminate, pii.redact))
