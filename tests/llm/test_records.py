"""Licences, token files, mixing, URL filters and archives."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprintmatch.llm import licenses as L
from imprintmatch.llm import mixing as X
from imprintmatch.llm import tokens as K
from imprintmatch.llm import url_filter as U
from imprintmatch.llm import warc as A

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_scan_equals_brute_force(spark, make_docs):
    rnd = random.Random(3)
    bits = ["MIT", "License", "license", "licenses", "Apache", "CC", "BY", "BY-NC", "cc-by", "GNU", "General", "Public", "\n", "é", "v3", "Released", "(c)", "_", "٣"]
    texts = [None, "", "MIT License mit license"] + [rnd.choice([" ", "-", ". "]).join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["mit license " * 30000]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(make_docs(texts)).collect()}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}


def test_expressions(spark, make_docs):
    assert L.to_postfix("MIT OR Apache-2.0 AND GPL-2.0+ WITH Classpath-exception-2.0") == ["MIT", "Apache-2.0", "GPL-2.0+", "Classpath-exception-2.0", "with", "and", "or"]
    assert L.permits("(MIT or GPL-3.0) and BSD-3-Clause", {"mit", "bsd"}) and not L.permits("MIT and GPL-3.0", {"mit"})
    for bad in ("MIT AND", "(MIT", "MIT)", "MIT BSD", "()", "AND MIT", "", "MIT (BSD)"):
        assert L.labels_of(bad) == set()
    row = L.scan_licenses(make_docs(["x\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0\ny"])).first()
    assert (row.base_labels, row.labels, row.score) == ("", "apache,gpl,mit", 1.0)
    assert L.scan_licenses(make_docs([])).collect() == []


ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "\n", "a\tb", "don't we'll 'sx 123 4!?", "a\u3000b", "a\0b", "a\nb c\nd.", "中文 字 a's é", "x <|endoftext|> y", "long " * 20000]


def test_tokens_round_trip(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(K.default_tokenizer())
    ids = random.Random(1).sample(range(1000), len(ODD))
    folder = f"file://{tmp_path}/t"
    got = {r.doc_id: r for r in K.token_files(make_docs(ODD, ids), folder).collect()}
    assert len(got) == len(ODD)
    at = 0
    for doc_id, text in sorted(zip(ids, ODD)):
        want = tok.encode(text or "", add_special_tokens=False).ids + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    full = {r.doc_id: r.ids for r in K.read_tokens(K.manifest_of(spark, folder), folder).collect()}
    assert full[ids[8]] == tok.encode(ODD[8], add_special_tokens=False).ids + [0]


def test_tokens_odd_rows(spark, make_docs, tmp_path):
    docs = make_docs(["a", "b", "c"], [2, 2, None])
    got = sorted((r.doc_id, r.start) for r in K.token_files(docs, f"file://{tmp_path}/u").collect())
    assert got == [(2, 0), (2, 2)]
    assert K.token_files(docs.limit(0), f"file://{tmp_path}/v").collect() == []


def fill(sizes, weights, cap=3):
    total, target = sum(sizes), [0.0] * len(sizes)
    capped = set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        free = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [cap * sizes[i] if i in capped else left * weights[i] / free for i in range(len(sizes))]
        new = {i for i in range(len(sizes)) if target[i] > cap * sizes[i]}
        if not new - capped:
            return target
        capped |= new


def test_mix(spark, make_docs):
    rnd = random.Random(8)
    sources = ["a", "Z", "é", None, "hot", "tiny", "none"]
    rows = []
    for i in range(3000):
        s = rnd.choice(sources[:4] + ["hot"] * 4)
        rows.append((i, " ".join("w" * rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 30))), s))
    rows += [(5000, "a b", "tiny"), (5001, None, "none"), (5002, "", "a"), (5003, "a\x85b\tc", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = X.mix_digest(docs.withColumn("size", F.lit("clash"))).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    order = sorted((s for s in sources if s is not None)) + [None]
    per = defaultdict(int)
    for i, _, s in rows:
        per[s] += size[i]
    target = dict(zip(order, fill([per[s] for s in order], [k % 3 + 1 for k in range(len(order))])))
    source_of = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per[s])
        assert r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in ("a", "Z", "é", None, "hot"):
        assert taken[s] == pytest.approx(target[s], rel=0.1)
    again = {r.doc_id: r.taken for r in X.mix_digest(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    copies = X.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert {r.doc_id: r["count"] * size[r.doc_id] for r in copies.groupBy("doc_id").count().collect() if size[r.doc_id]} == {k: v for k, v in again.items() if v}
    assert X.mix_digest(docs.limit(0)).collect() == []


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls(spark):
    rnd = random.Random(6)
    hosts = ["net", "a.net", "EXAMPLE.net", "b.example.net", "example.com", "x.Example.com", "org", "q.org", "dnet", "", "com", "a..net", "n" * 3000 + ".org"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/", "/de/y?z", "/fr/", "/fr/#a", "?q=/en/", "#/de/", "/EN/"]
    urls = [None, "", "net/", "http:/net/", "a://b://net/"] + [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (*U.RULES, *(U.Rule(rnd.choice(["block", "allow"]), f"h{i}.org", "/") for i in range(300)))
    for own in (U.RULES, rules):
        got = {r.page_id: tuple(r)[1:] for r in U.judge_urls(pages, own, bits_per_key=2).collect()}
        assert got == {i: judge(u, own) for i, u in enumerate(urls)}
    assert U.judge_urls(pages.limit(0)).collect() == []
    assert {r.verdict for r in U.judge_urls(pages, ()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key like '%7'")
    made = U.build_cascade(listed, universe, bits_per_key=3)
    assert len(made.levels) > 2
    wrong = universe.filter(made.contains(F.col("key")) != F.col("key").endswith("7"))
    assert wrong.count() == 0
    with pytest.raises(OverflowError):
        U.build_cascade(listed, universe, max_bits=64)


def test_archive(spark, tmp_path):
    big, small = "<p>ü\r\n\r\nWARC/1.1\r\n" + "x" * 1000, "same"
    rows = [(1, "u1", big), (7, None, big), (3, "u\r\n3", big), (4, "u4", small), (5, "u5", small), (6, "u6", None), (8, "u8", ""), (9, "u9", "y" * 999), (9, "u9", "y" * 999), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    A.write_archive(pages.withColumn("key", F.lit(1)), f"{tmp_path}/a")
    records = A.read_archive(spark, f"{tmp_path}/a")
    got = sorted((tuple(r) for r in A.archive_digest(records).collect()), key=repr)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 7
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=repr)
    stored = spark.read.schema(A.SCHEMA).parquet(f"{tmp_path}/a").filter("kind = 'payloads'")
    assert stored.count() == 4
    A.export_warc(records, f"{tmp_path}/w")
    back = {(bytes(r.header), bytes(r.block)) for r in A.import_warc(spark, f"{tmp_path}/w").collect()}
    assert back == {(bytes(r.header), b"" if r.record_type == "revisit" else bytes(r.payload)) for r in records.collect()}
    A.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert A.read_archive(spark, f"{tmp_path}/e").collect() == []


def test_archive_notices_a_changed_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    A.write_archive(pages, f"{tmp_path}/a")
    bad = spark.read.schema(A.SCHEMA).parquet(f"{tmp_path}/a").withColumn("payload", F.when(F.col("payload").isNotNull(), F.lit("abd").cast("binary")))
    bad.write.partitionBy("kind").parquet(f"{tmp_path}/b")
    with pytest.raises(Exception, match="not what was stored"):
        A.read_archive(spark, f"{tmp_path}/b").collect()
