import gzip
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tabulon.llm import langid, licenses, mixing, pii, queries, sketches, warc

SF = "/root/testdata/sf0.001"
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(d))) % 10 == 0


def valid(k, v):
    d = re.sub("[^0-9]", "", v)
    return k == "email" or k == "ip" and all(int(x) <= 255 for x in v.split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


def test_base_spans(spark):
    r = random.Random(5)
    parts = ["a", "@", ".", "1", "25", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "a@b.c", "_", "%", "é", "😀", "0000", "12345678", "x", "\n", "10.0.0.1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(1500)] + [(9001, None), (9002, ""), (9003, "1 " * 30000), (9004, "a" * 100000), (9005, "a@b" + ".c" * 30000), (9006, "a@b.co " * 500), (9007, "+1" + "(" * 20000)]
    got = {x.doc_id: x for x in pii.spans(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS terms")).collect()}
    for i, t in rows:
        assert [(k, v.start, v.end) for k in pii.PATTERNS for v in got[i][k]] == brute_spans(t), t


def test_revealing_terms_and_texts(spark):
    rows = [(i, f"some filler number{i} words secretcode near bob@example.com and more filler{i} here") for i in range(5)]
    rows += [(100 + i, f"some filler words near number and more here, nothing else {i}") for i in range(200)] + [(7, rows[0][1]), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pii_id", "1 AS h", "2 AS near")
    got = pii.spans(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        text = dict(rows)[x.doc_id] or ""
        assert {text[v.start : v.end] for v in x.terms} == ({"secretcode"} if x.doc_id < 8 else set())
    clean = {x.doc_id: x.text for x in pii.sanitised(docs).collect()}
    assert "bob@" not in clean[1] and "[EMAIL]" in clean[1] and "secretcode" not in clean[1] and "number1" in clean[1]
    assert clean[150] == dict(rows)[150] and clean[8] is None and pii.sanitised(docs).columns == docs.columns
    assert pii.spans(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).count() == 0


def test_op6_digest(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_pii"](spark, SF).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    k = sorted(got.columns)
    assert k == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[k].astype(object).where(f[k].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 300), r.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(7, None, "d"), (7, "", "d"), (5000, "w " * 20, "tiny"), (5000, "w " * 20, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.copies(docs).collect()))
    sizes, taken = {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.mix_size
        taken[x.source] = taken.get(x.source, 0) + x.mix_size * x.mix_copies
        assert 0 <= x.mix_copies <= 3
    targets = {x.source: x.mix_target for x in got}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 and all(t <= 3 * sizes[s] + 1e-6 for s, t in targets.items())
    for s in ("a", "b", "c", None):
        assert abs(taken[s] / targets[s] - 1) < 0.05
    level = {s: targets[s] / w for s, w in zip(["a", "b", "c", "d", "tiny", None], [5, 2, 1, 5, 2, 1], strict=True) if targets[s] < 3 * sizes[s] - 1e-6}
    assert max(level.values()) - min(level.values()) < 1e-6 * max(level.values())
    again = {(x.doc_id, x.text, x.source): x.mix_copies for x in got}
    wide = mixing.copies(docs.selectExpr("*", "1 AS mix_size", "2 AS size", "3 AS hash", "array(map('a', 1)) AS m"))
    assert wide.columns[-4:] == ["mix_size", "mix_source_size", "mix_target", "mix_copies"] and all(again[x[:3]] == x[-1] for x in wide.collect() if x[0] < 3000)
    assert mixing.copies(spark.createDataFrame([(1, "w " * 200_000, "s")], "doc_id long, text string, source string")).first().mix_copies == 1
    clashing = docs.selectExpr("*", "1 AS mix_size", "2 AS n", "3 AS words", "array(map('a', 1)) AS m")
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(clashing).count() == sum(x.mix_copies for x in got) and mixing.mixed(docs.limit(0)).count() == 0


def test_licences(spark):
    mit = licenses._MIT
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ;")), (3, "some text\nReleased under the MIT Licence\nmore\nLICENSED UNDER CC BY-NC 4.0!"), (4, None), (5, ""), (6, mit + " with a change"), (3, "x"), (7, "Copyright 1999 Me")]
    rows += [(8, "This file is licensed under the MIT License.\nReleased under the MIT License. See LICENSE for details."), (9, "x\n\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n\ny"), (10, "GNU GENERAL PUBLIC LICENSE Version 3"), (11, "long " * 400_000 + "\nSPDX-License-Identifier: LGPL-2.1-or-later"), (12, "the mit license is short\nnothing licensed under this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS unit", "3 AS found")
    got = sorted((r.doc_id, r.license_id, r.notices, r.n_notices) for r in licenses.license_scan(docs).collect() if r.license_id or r.n_notices)
    assert got == [(1, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "CC-BY-NC-4.0,MIT", 2), (8, None, "MIT", 2), (9, None, "Apache-2.0", 2), (10, None, "GPL-3.0", 1), (11, None, "LGPL-2.1", 1)]
    assert licenses.license_scan(docs.limit(0)).count() == 0
    known = [("A", "one two"), ("B", "Three, four"), ("A", "five")]
    texts = spark.createDataFrame([(1, "ONE two\nthree four\nfive"), (2, "five"), (2, "five"), (3, None)], "doc_id long, text string")
    a, b = (sorted(map(str, licenses.license_scan(texts, known=known, map_entries=n).collect())) for n in (10, 0))
    assert a == b and "notices='A,B', n_notices=3" in a[0] and len(a) == 4


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\nWARC/1.1\r\n\r\n", b"", b"plain", b"\n" * 10]
    data = warc.arc_header(version) + b"".join(warc.arc_bytes(warc.ArcRecord(f"http://h/{i} x", "1.2.3.4", "20010203040506", "text/html", b, version=version)) for i, b in enumerate(bodies))
    arcs = list(warc.parse_arc(data))
    assert [a.body for a in arcs[1:]] == bodies and arcs[0].url.startswith("filedesc:")
    records = [warc.to_warc(a) for a in arcs]
    assert [r.headers["WARC-Type"] for r in records] == ["warcinfo", "response", "resource", "resource", "resource"] and records[1].headers["WARC-Date"] == "2001-02-03T04:05:06Z"
    back = list(warc.parse_warc(b"".join(r.to_bytes() for r in records)))
    assert [r.block for r in back] == [r.block for r in records] and back[1].payload == b"<html>\n\nWARC/1.1\r\n\r\n" and back[1].headers == records[1].headers
    for broken in (data[:-30], b"no header line\n", data.replace(b" 5\n", b" 9999\n")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.parse_arc(broken))


def test_archives(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "u", big), (2, "u", "x" * 999), (4, "u", "x" * 999), (6, "u", None), (5, "again", big), (7, "u", "WARC/1.1\r\n\r\nnot a record\r\n\r\n" * 50), (None, "u", "y" * 2000), (8, "u", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS n")
    for versions in ((1,), (2,), (1, 2)):
        path = str(tmp_path / f"v{versions}")
        warc.write_legacy(pages.repartition(3), f"{path}/arc", versions=versions)
        warc.convert(spark, f"{path}/arc", f"{path}/warc")
        got = sorted((r.key or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, f"{path}/warc").collect())
        sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
        first = {big: 5, "y" * 2000: 8}
        want = sorted((i or -1, "revisit" if h in first and i != first[h] else "response", first[h] if h in first and i != first[h] else None, len((h or "").encode()), sha(h)) for i, _, h in rows)
        assert got == want
    arcs, warcs = ([gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "v(1, 2)" / kind).glob("*.gz"))] for kind in ("arc", "warc"))
    assert {a.split(b"\n")[1][:1] for a in arcs} == {b"1", b"2"} and all(a.startswith(b"filedesc://") for a in arcs)
    assert all(w.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and w.endswith(b"\r\n\r\n") for w in warcs)
    assert warc.archived(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_a_page_repeated_and_a_long_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    same, long = "s" * 1500, "<p>é</p>\n" * 300_000
    rows = [(i, "u", same) for i in range(700)] + [(9000, "u", long)]
    got = {r.key: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "x")).collect()}
    assert got[699].record_type == "response" and all(got[i].refers_to == 699 and got[i].payload_bytes == 1500 for i in range(699))
    assert got[9000].payload_bytes == len(long.encode()) and got[9000].payload_digest == hashlib.sha1(long.encode()).hexdigest()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").selectExpr("*", "1 AS p", "2 AS ll", "3 AS n0")
    truth = {r.doc_id: r.lang for r in held.collect()}
    got = {r.id: r.language for r in langid.document_languages(held, model, declared_col=None).collect()}
    assert sum(got[i] == truth[i] for i in truth) / len(truth) > 0.97
    odd = spark.createDataFrame([(1, None, "s", None), (2, "", None, None), (3, "12 $$ !!", None, None), (4, "the and of ation the", None, "en"), (4, "the and of ation the", None, "en")], "doc_id long, text string, source string, lang string")
    assert {r.id: r.rejected for r in langid.document_languages(odd, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert [r.doc_id for r in langid.identified(odd, model).collect()] == [4, 4] and langid.identified(odd.limit(0), model).count() == 0
    assert all(r.rejected for r in langid.document_languages(odd, langid.fit(docs.limit(0))).collect())


def test_fusion_by_brute_force(spark):
    r = random.Random(9)
    model = langid.TextModel(["aa", "bb", "cc"], np.zeros((langid.SLOTS, 3), np.float32))
    rows = [(i, r.randint(0, 5), [r.uniform(-4, 0) for _ in range(3)], r.choice(["x", "y", None]), r.choice(["h1", "h2", "h3", None]), r.choice(["aa", "zz", None])) for i in range(900)]
    rows = [(i, n, ll if n else [0.0] * 3, a, b, d) for i, n, ll, a, b, d in rows] + [(900, 3, [-1.0, -1.0, -1.0], "only", "me", "alone")]
    got = {x.id: x for x in langid.fuse(spark.createDataFrame(rows, "id long, n_grams long, ll array<double>, place_0 string, n string, times string"), model, ["place_0", "n"], ["times"]).collect()}
    e = {x[0]: np.exp(np.array(x[2]) - max(x[2])) for x in rows}
    p = {x[0]: e[x[0]] / e[x[0]].sum() if x[1] else np.zeros(3) for x in rows}

    def others(me, same):
        return sum((p[x[0]] for x in rows if same(x)), np.zeros(3)) - p[me[0]]

    lean = lambda n, above: (n + 8 * above) / (n.sum() + 8)
    for me in rows[::40] + rows[-1:]:
        everywhere = others(me, lambda x: True) + 1
        prior = everywhere / everywhere.sum()
        wide = lean(others(me, lambda x: x[3] == me[3]), prior)
        s = np.array(me[2]) + np.log(lean(others(me, lambda x: x[3:5] == me[3:5]), wide))
        if me[5] is not None:
            s += np.log(lean(others(me, lambda x: x[5] == me[5]), prior) / prior)
        post = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert abs(got[me[0]].posterior - post.max()) < 1e-9 and got[me[0]].rejected == (me[1] == 0 or post.max() < 0.5)
        assert got[me[0]].language == (None if got[me[0]].rejected else model.languages[int(post.argmax())])
    empty = spark.createDataFrame([], "id long, n_grams long, ll array<double>, host string")
    assert langid.fuse(empty, model, ["host"], []).count() == 0


def test_page_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    de = docs.where("lang = 'de'").first().text
    rows = [(i, f"https://h{i % 3}.site.de/x", f"<html LANG='de'><p>{de[:200]}</p></html>") for i in range(30)] + [(100, "https://h1.site.de/x", "<html><p>in</p></html>"), (101, None, None), (102, "nonsense", "<html lang=fr><script>the the</script></html>")]
    got = {r.page_id: r for r in langid.page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    long = spark.createDataFrame([(1, "https://a.b/de/", "<p>" + de * (2_000_000 // len(de)) + "</p>"), (2, "u", "")], "page_id long, url string, html string")
    assert [r.language for r in langid.page_languages(long, model).orderBy("page_id").collect()] == ["de", None]
    assert langid.page_languages(long.limit(0), model).count() == 0
    assert len(got) == len(rows) and got[3].language == "de" and got[100].language == "de" and got[101].rejected and got[102].rejected and got[3].markup == "de"


def test_unused_sketch_columns(spark):
    assert sketches.with_next(spark.createDataFrame([], "doc_id long, text string"), {"t": sketches.F.col("text")}).count() == 0
