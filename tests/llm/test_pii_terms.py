import random
import re

from tabulon.llm import pii


def terms(spark, rows):
    texts = dict(rows)
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {x.doc_id: [texts[x.doc_id][v.start : v.end] for v in x.terms] for x in got}


def corpus():
    return [(100 + i, "the filler words stand in all texts, here and there") for i in range(1)] + [(200 + i, f"the filler words stand in all texts, here and there, x{i % 150}") for i in range(600)]


def test_an_entity_of_one_text_has_terms(spark):
    got = terms(spark, [(1, "the filler words stand here, zephyrine bob@example.com and there"), *corpus()])
    assert "zephyrine" in got[1] and "the" not in got[1] and not any(got[i] for i in got if i != 1)


def test_terms_anywhere_short_and_with_digits(spark):
    far = "the filler words stand here and there " * 20
    text = f"Ann K7 {far} bob@example.com {far} ann, k7 {far}"
    got = terms(spark, [(i, f"{text} {far * i}") for i in range(5)] + corpus())
    for i in range(5):
        assert sorted(got[i]) == ["Ann", "K7", "ann", "k7"]
    clean = {x.doc_id: x.text for x in pii.sanitised(spark.createDataFrame([(i, f"{text} {far * i}") for i in range(5)] + corpus(), "doc_id long, text string")).collect()}
    assert "Ann" not in clean[0] and "k7" not in clean[0] and "[EMAIL]" in clean[0] and clean[200] == dict(corpus())[200]


def test_shares_by_brute_force(spark):
    from collections import Counter
    from math import log2

    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = [r.choice(vocabulary) for _ in range(r.randint(3, 25))]
        if i % 6 == 0:
            w += [r.choice(["a@b.com", "C@d.org", f"u{i}@e.net"]), *(["clue"] if i % 12 == 0 else [])]
        rows.append((i, " ".join(w)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, "")]
    texts = {t or "" for _, t in rows}
    words = {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts}
    held = {t: {m.lower() for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)} for t in texts}
    n, of_term, of_entity = len(texts), Counter(w for t in texts for w in words[t]), Counter(e for t in texts for e in held[t])
    both = Counter((e, w) for t in texts for e in held[t] for w in words[t])

    def share(e, w):
        p = of_entity[e] / n
        return log2((both[e, w] + 5 * p) / (of_term[w] + 5) / p) / -log2(p)

    F = pii.F
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.distinct_texts(docs, "text")
    hashes = {x.h: x.t for x in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    got = {(hashes[x.h], x.term): x.share for x in pii.disclosing(pii.stored(found, "texts"), generalise=0.3).collect()}
    want = {(t, w): max(share(e, w) for e in held[t]) for t in texts if held[t] for w in words[t]}
    want = {k: v for k, v in want.items() if v >= 0.3}
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert any(w == "clue" for _, w in got)


def test_what_terms_become(spark):
    text = "the filler words stand here, Zephyrine zeugma K7 4711 bob@example.com and there"
    rows = [(1, text), *corpus()]
    clean = {x.doc_id: x.text for x in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[1] == "the filler words stand here, [NAME] [WORD] [CODE] [NUMBER] [EMAIL] and there"
