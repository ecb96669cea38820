"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arrearium.llm import (
    bpe,
    chat_format,
    decontaminate,
    license_scan,
    line_dedup,
    near_dedup,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    url_filter,
)
from arrearium.llm.queries import ORACLE_SQL, QUERIES, tokenizer

P = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions under a pale moon and sing of old rivers that run to the sea "
LONG = "word " * 60_000
CLASH = "doc_id bigint, text string, source string, n_words string, kept string, score string, words string, node string, ids string, host string"


def docs_of(spark, rows, schema="doc_id bigint, text string, source string, lang string, n_chars bigint"):
    return spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], schema)


EDGES = [(1, None, "a"), (2, "", None), (3, P * 2, "a"), (3, P * 2, "a"), (4, P * 2, None), (None, P * 2, "a"), (None, None, None), (5, LONG, "b"), (6, "\n\n \t", "b"), (7, "x", "b"), (8, "Released under the MIT License.", "b")]


def clash(spark, rows):
    return spark.createDataFrame([(i, t, s, "w", "k", "s", "w", "n", "i", "h") for i, t, s in rows], CLASH)


VOCAB, PATTERN = tokenizer()
DOC_OPS = {
    "suffix": lambda d: suffix_dedup.suffix_dedup(d),
    "leaks": lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, P), (2, None), (None, "x y")], "item_id bigint, text string")),
    "clean": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([], "item_id bigint, text string")),
    "license": lambda d: license_scan.license_scan(d),
    "bpe": lambda d: bpe.bpe_digest(d, VOCAB, PATTERN),
    "ids": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, VOCAB, PATTERN), VOCAB, PATTERN),
    "quality": lambda d: quality_rules.quality_rules(d),
    "lines": lambda d: line_dedup.line_dedup(d),
    "near": lambda d: near_dedup.near_dedup(d),
    "copies": lambda d: near_dedup.drop_near_copies(d),
    "classifier": lambda d: quality_classifier.score(d, quality_classifier.fit(d, d.sparkSession.createDataFrame([(3, 1), (7, 0), (None, 1), (9, None)], "doc_id bigint, quality int"))),
}
FEWER = {"leaks", "copies"}


@pytest.mark.parametrize("name", DOC_OPS)
def test_edges(spark, name):
    op = DOC_OPS[name]
    for df in (docs_of(spark, EDGES), clash(spark, EDGES)):
        got = op(df).collect()
        assert len(got) == len(EDGES) or name in FEWER, name
    assert op(docs_of(spark, EDGES).limit(0)).count() == 0


def test_defined_results(spark):
    d = docs_of(spark, EDGES)
    n = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_dedup(d).collect()}
    assert n[1, 0] == (1, True) and n[4, n_words(P * 2)] == (3, False) and n[None, n_words(P * 2)] == (3, False)
    s = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.suffix_dedup(d).collect()}
    assert s[4, len(P * 2)].n_removed == len(P * 2) and s[1, 0].n_removed == 0 and s[3, len(P * 2)].n_removed == len(P)
    q = {r.doc_id: r for r in quality_rules.quality_rules(d).collect()}
    assert not q[1].kept and q[1].n_words == 0 and q[5].n_repeat_words == 60_000
    x = {r.doc_id: r for r in license_scan.license_scan(d).collect()}
    assert (x[8].n_base, x[8].first_word, x[8].labels, x[1].labels, x[1].score) == (1, 1, "mit", "", 0.0)


def n_words(t, k=5):
    w = t.split()
    return len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def test_suffix_brute_force(spark):
    rnd = random.Random(5)
    words = [rnd.choice(["alpha", "beta", "gamma", "delta", "öre", "zeta"]) + str(rnd.randrange(40)) for _ in range(300)]
    base = " ".join(words)
    rows = [(i, base[rnd.randrange(400) : rnd.randrange(600, 1600)] + (" new %d " % i) * rnd.randrange(30) + base[900:1300] * rnd.randrange(2), "a") for i in range(40)] + [(50, "a" * 400, "a"), (51, "ab" * 150, "a")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs_of(spark, rows), shard_bytes=1500).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_interleave_merge_equals_one_sort():
    rnd = random.Random(2)
    strings = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(100, 160))) for _ in range(30)] * 2
    groups = [(s, i, 0) for i, s in enumerate(strings)]
    a, b = suffix_dedup.repeats(groups, 100, 10**9), suffix_dedup.repeats(groups, 100, 700)
    assert [x.tolist() for x in a] == [x.tolist() for x in b] and len(a[0])


def near_brute(rows, k, percent=80):
    sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := (t or "").encode().lower().split()) else frozenset() for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            u = len(sets[a] & sets[b])
            if a < b and u and 100 * u >= percent * (len(sets[a]) + len(sets[b]) - u):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def near_rows(n=150, edits=6):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    return rows + [(1000 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60)), "b") for i in range(30)]


def test_near_dedup_brute_force(spark):
    """A large group of near copies, some linked only through others: small and large buckets."""
    rows = near_rows()
    want = near_brute(rows, 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(spark, rows), shingle=4).collect()}
    assert got == want and len(set(want.values())) > 31


def test_bpe_equals_library(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(VOCAB), special_tokens={})
    rnd = random.Random(3)
    texts = [P, "", "x" * 3000, "Żółć 日本語 😀 <|endoftext|>", "  \n\t 123456 it's", "".join(rnd.choice("abcé ") for _ in range(4000))] + ["".join(rnd.choice(["the", "ing", "ß", "aaaa"]) for _ in range(rnd.randrange(400))) for _ in range(20)]
    df = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    out = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df, VOCAB, PATTERN), VOCAB, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == enc.encode_ordinary(t) and bytes(out[i].decoded) == t.encode()
    assert all(r.exact for r in bpe.tokenize(df, VOCAB, PATTERN).collect())


def test_leaks_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: f"v{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 18, 8, 30])]
    rows, want = [], set()
    for i in range(60):
        body = [word() for _ in range(120)]
        if i % 3 == 0:
            k = i // 3 % len(items)
            part = items[k][1].split()
            if i % 2 and len(part) >= 25:
                part[6], part[17] = "changed", "also"
            body[50:50] = [w.upper() + "," for w in part]
            want.add((i, k))
        rows.append((i, " ".join(body), "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs_of(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == {i for i, _, _ in rows} - {i for i, _ in want}


def test_url_filter_brute_force(spark):
    rows = [
        (1, "https://good.org/x", '<a href="https://peer.net/">p</a> <a href="/own">o</a>'), (2, "http://Shop.COM/de/1?x", '<a href="//ring.net/a">r</a>'),
        (3, "http://ring.net/", '<a href="http://shop.com/de/">s</a><a href="http://shop.com/">s</a>'), (4, "http://peer.net/a", ""), (5, None, None), (6, "nothing", "<a href='x'>"),
        (7, "http://example.org/es/a", ""), (8, "http://sub.example.org/en/12", ""), (9, "http://example.org", ""), (10, "http://a.com/fr/", ""),
    ]
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("shop.com", "/de/1", "com/de/", "block")
    assert (out[7].rule, out[8].rule, out[9].rule, out[1].rule, out[10].rule) == ("example.org/es/", "example.org/en/1", None, "org/", "com/fr/")
    assert out[3].verdict == "block" and out[4].verdict == "allow" and out[5].verdict == "allow" and (out[6].host, out[6].path) == ("", "")
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "c", 1.0)]
    got = {r.host: r["rank"] for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0)], "host string, weight double"), tolerance=1e-9).collect()}
    rank, outs = {"a": 1.0}, defaultdict(float)
    for s, _, w in edges:
        outs[s] += w
    for _ in range(300):  # to convergence
        new = defaultdict(float, {"a": 0.15})
        for s, t, w in edges:
            new[t] += 0.85 * w / outs[s] * rank.get(s, 0)
        rank = dict(new)
    assert got == pytest.approx(rank, abs=1e-7)
    assert url_filter.url_filter(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_line_dedup_keeps_first(spark):
    rows = [(i, f"menu\nbody {i}\n menu2", "a") for i in range(10)] + [(20, "menu", "a"), (21, "menu", "b"), (22, None, "a")]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert out[0].text == "menu\nbody 0\n menu2" and out[5].text == "body 5" and out[20].emptied and out[21].text == "menu" and out[22].text is None
    salted = line_dedup.BROADCAST_LINES
    try:
        line_dedup.BROADCAST_LINES = -1
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()} == {k: v.text for k, v in out.items()}
    finally:
        line_dedup.BROADCAST_LINES = salted


def test_classifier_held_out(spark):
    q = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = q.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 80 and r["a"] >= 0.95


def test_chat_layouts(spark):
    texts = ["<|end|>\n", "a|>b<\\|", "<|user|>\n</s>[INST] ok", "", "plain"]
    rows = [(i, t, x) for i, x in enumerate(texts) for t in (0, 1)]
    df = spark.createDataFrame([(i, t, "user" if not t else "assistant", x, "extra") for i, t, x in rows] + [(9, None, None, None, "e")], "conv_id bigint, turn bigint, role string, text string, other string")
    out = chat_format.format_chat(chat_format.canonical_turns(df)).withColumn("back", chat_format.read_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    for i, x in enumerate(texts):
        assert [(t.role, t.text) for t in got[i].back] == [("user", x), ("assistant", x)] and got[i].loss == x
    assert got[9].loss == "" and len(got[9].back) == 1
    assert chat_format.canonical_turns(df.limit(0)).count() == 0
    lines = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"instruction":"q","input":"","output":"a","x":1}', '{"prompt":"q","response":"a"}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "{broken", None]
    j = chat_format.canonical_json(spark.createDataFrame(list(enumerate(lines)), "id int, body string"), "id", "body").collect()
    assert [r.layout for r in sorted(j)] == ["messages", "instruction", "prompt_response", "from_value", None, None]
    assert all([(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in j if r.layout)


def test_sql_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
