"""The dealt methods at work, against independent brute force, and the whole pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arrearium.llm import bpe, chat_format, decontaminate, near_dedup, quality_classifier, quality_rules, url_filter
from arrearium.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
VOCAB, PATTERN = tokenizer()


def docs_of(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# Byte-level BPE


def test_bpe_tree_carries_the_real_table():
    """On the whole real table most matches go through splits and joins, and ids are the library's."""
    import tiktoken

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    c = bpe.Codec(bpe.load_ranks(VOCAB), PATTERN)
    ids = [c.encode(t) for t in texts]
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    assert ids == enc.encode_ordinary_batch(texts)
    assert [c.decode(x) for x in ids] == [t.encode() for t in texts]
    distinct = {m for t in texts for m in c.find(t) if m.encode() not in c.ranks}
    assert c.joins == c.splits > len(distinct) / 2 > 10_000


def test_bpe_caches_change_nothing(monkeypatch):
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    want = [bpe.Codec(bpe.load_ranks(VOCAB), PATTERN).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 50)
    c = bpe.Codec(bpe.load_ranks(VOCAB), PATTERN)
    assert [c.encode(t) for t in texts] == want and max(len(c.pieces), len(c.halves), len(c.pairs)) <= 50


# Decontamination


def _patterns():
    """All minimal leaks as strings of matches and substitutions: first of long items, then of items shorter than 17 tokens."""
    found = []

    def grow(p, score):
        if sum(p) == decontaminate.MIN_TOKENS:
            found.append(p)
            return
        grow([*p, 1], score + 1)
        if score > decontaminate.PENALTY:
            grow([*p, 0], score - decontaminate.PENALTY)

    grow([1], 1)
    for n in range(decontaminate.SPAN, 17):
        for k in range(n - decontaminate.needed(n) + 1):
            for zeros in itertools.combinations(range(n), k):
                p = [0 if i in zeros else 1 for i in range(n)]
                if any(m >= decontaminate.needed(n) for _, _, m in decontaminate.segments(np.array(p, bool))):
                    found.append(p)
    return found


def test_masks_hit_every_leak():
    masks = [[i for i, c in enumerate(m) if c == "1"] + [len(m) - 1] for m in decontaminate.MASKS]
    patterns = _patterns()
    for p in patterns:
        assert any(all(p[at + i] for i in m) for m in masks for at in range(len(p) - m[-1])), p
    assert len(patterns) > 400


def _brute_leak(own: list[str], doc: list[str]) -> int:
    """Most matches of any segment, on any diagonal, whose every prefix and suffix scores above 0; 0 if none is a leak."""
    need, best = decontaminate.needed(len(own)), 0
    for shift in range(-len(own) + 1, len(doc)):
        same = [own[i] == doc[i + shift] for i in range(len(own)) if 0 <= i + shift < len(doc)]
        for a in range(len(same)):
            score = n = 0
            for b in range(a, len(same)):
                score, n = score + (1 if same[b] else -decontaminate.PENALTY), n + same[b]
                if score <= 0:
                    break
                if same[b] and n >= need:
                    tail = np.cumsum([1 if x else -decontaminate.PENALTY for x in same[a : b + 1][::-1]])
                    if tail.min() > 0:
                        best = max(best, n)
    return best


def test_leaks_equal_an_independent_matcher(spark):
    rnd = random.Random(21)
    word = lambda: f"v{rnd.randrange(40)}"  # noqa: E731  few words, so that chance hits abound
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([40, 17, 16, 13, 11, 10, 4, 30, 22])]
    rows = []
    for i in range(70):
        body = [word() for _ in range(rnd.randrange(5, 60))]
        part = list(items[i % len(items)][1])
        for k in range(len(part)):
            if rnd.random() < 0.1:
                part[k] = "other"
        cut = rnd.randrange(len(part))
        body[5:5] = part[cut:] if i % 3 == 0 else part
        rows.append((i, body))
    want = {(d, k) for d, body in rows for k, own in items if _brute_leak(own, body)}
    got = decontaminate.leaks(docs_of(spark, [(d, " ".join(b)) for d, b in rows]), spark.createDataFrame([(k, " ".join(w).upper() + ".") for k, w in items], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 25


def test_leaks_shuffled_joins(spark, monkeypatch):
    """Beyond the broadcast size the same rows come from shuffled joins; repeated items and null ids are defined."""
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item), (1, "other words here"), (None, item), (2, None)], "item_id bigint, text string")
    docs = docs_of(spark, [(1, "x " + item), (1, "y"), (None, item + " z"), (3, None), (4, "other words here"), (4, "other words here")])
    read = lambda: sorted(map(repr, decontaminate.leaks(docs, bench).collect()))
    small = read()
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    assert read() == small
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1, 20), (1, None, 20), (None, 1, 20), (None, None, 20), (4, 1, 3)}


# Near-duplicates


@pytest.mark.parametrize("bucket, rows", [(1, -1), (10**9, 500_000)])
def test_near_dedup_far_sides(spark, monkeypatch, bucket, rows):
    """Small and large buckets, broadcast and shuffled joins, salted shingles and pivots: one result."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    texts = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(50))) for i in range(8)] + [(200, None), (201, ""), (202, texts[3][1])]
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(near_dedup, "SHINGLE_SALT", 7)
    monkeypatch.setattr(near_dedup, "PIVOT_SALT", 5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(spark, texts), shingle=4).collect()}
    assert got == brute_components(texts, 4) and len(set(got.values())) > 12


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] & sets[b])
        if u and 100 * u >= percent * (len(sets[a]) + len(sets[b]) - u):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_repeated_rows_with_other_columns(spark):
    """Of rows that repeat id and text one stays, the same whatever the partitions."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, x) for x in "cab"] + [(2, "alone here " + text[::-1], "z")]
    for parts in (1, 5):
        d = docs_of(spark, rows, "doc_id bigint, text string, tag string").repartition(parts)
        assert sorted((r.doc_id, r.tag) for r in near_dedup.drop_near_copies(d).collect()) == [(1, "a"), (2, "z")]


# Chat layouts


def test_chat_clashing_columns(spark):
    """Columns of other layouts change nothing."""
    rows = [(1, 0, "user", "q", "p", "o", "s"), (1, 1, "assistant", "a", "p", "o", "s")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, prompt string, output string, system string")
    assert chat_format.select_mapping(d) == "turn_rows"
    assert [(t.role, t.text) for t in chat_format.canonical_turns(d).first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.select_mapping(d.select("conv_id"))


def test_chat_json_nulls_and_empties(spark):
    bodies = ['{"messages":[{"role":"user","content":null},{"role":"assistant","content":"a"}]}', '{"messages":[]}', '{"messages":[{"role":"user"},{"content":"c"}],"prompt":"x"}', '{"system":null,"prompt":"q","response":"a"}', "[1]", "{}"]
    got = {r.id: r for r in chat_format.canonical_json(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), "id", "body").collect()}
    turns = lambda i: None if got[i].turns is None else [(t.role, t.text) for t in got[i].turns]
    assert [got[i].layout for i in range(6)] == ["messages", "messages", "messages", "system_prompt_response", None, None]
    assert turns(0) == [("user", ""), ("assistant", "a")] and turns(1) == [] and turns(2) == [("user", ""), ("", "c")] and turns(3) == [("system", ""), ("user", "q"), ("assistant", "a")] and turns(4) is None


def test_chat_long_and_odd_texts(spark):
    odd = 'a"b\\c\n\t\u0001 </s>{"messages":1} ' * 2000
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd)] + [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}<|end|>") for i in range(300)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = chat_format.format_chat(chat_format.canonical_turns(d)).withColumn("back", chat_format.read_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[1].back] == [odd, odd] and got[1].loss == odd
    assert [t.text for t in got[2].back] == [f"t{i}<|end|>" for i in range(300)] and got[2].loss == "".join(f"t{i}<|end|>" for i in range(1, 300, 2))


# URL filters


def test_chain_of_hosts(spark):
    """Distrust travels over any number of hosts, here twelve, back along the links to a blocked page."""
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">n</a>') for i in range(12)] + [(12, "http://h12.net/", '<a href="http://bad.com/de/x">b</a>'), (13, "http://bad.com/de/x", None), (14, "http://fine.net/", "x" * 300_000), (15, None, '<a href="//fine.net/">f</a>')]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages).collect()}
    assert [k for k, v in sorted(got.items()) if v == "block"] == list(range(14))
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages.selectExpr("*", "'x' AS host", "'y' AS rule", "'z' AS verdict", "'t' AS trust")).collect()} == got


def test_verdicts_brute_force(spark):
    """Rules, links, ranks and verdicts of random pages against plain Python run to convergence."""
    rnd = random.Random(17)
    hosts = [f"{a}.{b}" for a in ("a", "b", "c", "d", "e", "f") for b in ("org", "com", "net")] + ["example.org"]
    paths = ["/", "/fr/1", "/de/2", "/es/3", "/en/12", ""]
    rows = []
    for i in range(60):
        links = "".join(f'<a class="x" href="{rnd.choice(["http://", "//", "HTTPS://"])}{rnd.choice(hosts)}{rnd.choice(paths)}">l</a>' if rnd.random() < 0.8 else '<a href="/own">o</a>' for _ in range(rnd.randrange(4)))
        rows.append((i, f"http://{rnd.choice(hosts).upper() if i % 5 == 0 else rnd.choice(hosts)}{rnd.choice(paths)}?q", links))

    def split(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u)
        return (m[1].lower(), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    edges, seeds = defaultdict(float), {"allow": defaultdict(float), "block": defaultdict(float)}
    for _, url, html in rows:
        host, path = split(url)
        if v := rule(host, path):
            seeds[v][host] += 1
        for href in re.findall(r'href="([^"]+)"', html):
            edges[host, split(href if "://" in href else ":" + href)[0] if "//" in href else host] += 1

    def rank(edges, seed):
        total, outs = sum(seed.values()), defaultdict(float)
        for (s, _), w in edges.items():
            outs[s] += w
        r = {h: w / total for h, w in seed.items()}
        for _ in range(300):
            new = defaultdict(float, {h: 0.15 * w / total for h, w in seed.items()})
            for (s, t), w in edges.items():
                new[t] += 0.85 * w / outs[s] * r.get(s, 0)
            r = new
        return r

    trust, distrust = rank(edges, seeds["allow"]), rank({(t, s): w for (s, t), w in edges.items()}, seeds["block"])
    close = {h for h in hosts if abs(trust.get(h, 0) - distrust.get(h, 0)) < 1e-5 and trust.get(h, 0) + distrust.get(h, 0) > 0}
    want = {i: rule(*split(u)) or ("block" if distrust.get(split(u)[0], 0) > trust.get(split(u)[0], 0) else "allow") for i, u, _ in rows}
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert not close and got == want and set(want.values()) == {"allow", "block"}


# Classifier


def test_classifier_whole_texts_and_repeats(spark):
    """What tells the classes apart stands after a long common beginning; repeated labelled rows don't weigh more."""
    rnd = random.Random(8)
    start = " ".join(f"c{rnd.randrange(300)}" for _ in range(2500))
    good, bad = [f"good{i}" for i in range(60)], [f"zq{i}#%" for i in range(60)]
    rows = [(i, start + " " + " ".join(rnd.choice(good if i % 2 else bad) for _ in range(1500))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id bigint, quality int")
    d = docs_of(spark, rows + rows[:20])
    out = quality_classifier.score(d, quality_classifier.fit(d, labels)).collect()
    assert len(out) == 80 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out if r.doc_id >= 40)
    once = quality_classifier.fit(docs_of(spark, rows), labels.distinct())
    assert quality_classifier.fit(d, labels)["w"] == pytest.approx(once["w"])


# Quality rules


def test_stop_words_by_language(spark):
    """The rule on stop words is for the languages whose words it knows."""
    text = " ".join(f"slovo{i}" for i in range(40))
    d = docs_of(spark, [(1, text, "en"), (2, text, "cs"), (3, text, None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(d).collect()} == {1: False, 2: True, 3: True}
    assert all(r.kept for r in quality_rules.quality_rules(d.drop("lang")).collect())


# Pipeline


def _words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def _quality(r):
    ws, t = _words(r["text"]), r["text"] or ""
    n = len(ws)
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(ws[i : i + 8])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    lines = [x for x in t.split("\n") if _words(x)]
    symbols, chars = sum(t.count(c) for c in quality_rules.SYMBOLS), sum(map(len, ws))
    stops = sum(w.lower() in set(quality_rules.STOP_WORDS) for w in ws)
    few = r["lang"] in quality_rules.LANGUAGES and stops / n < 0.01
    return not (symbols / n > 0.3 or not 1.5 <= chars / n <= 25 or (len(lines) - len(set(lines))) / max(len(lines), 1) > 0.5 or few)


def _lines(docs):
    pages, total, first = defaultdict(set), defaultdict(int), {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for k, r in enumerate(docs):
        total[r["source"]] += 1
        for x in {key(x) for x in r["text"].split("\n")} - {""}:
            pages[r["source"], x].add(k)
            first[r["source"], x] = min(first.get((r["source"], x), math.inf), r["doc_id"])
    out = []
    for r in docs:
        drop = lambda x, r=r: key(x) and len(p := pages[r["source"], key(x)]) >= 3 and len(p) > 0.1 * total[r["source"]] and first[r["source"], key(x)] != r["doc_id"]
        kept = "\n".join(x for x in r["text"].split("\n") if not drop(x))
        if kept == r["text"] or _words(kept):
            out.append(r | {"text": kept, "n_chars": len(kept)})
    return out


def test_pipeline_brute_force(spark):
    """The whole of run() against plain Python, stage by stage, on the smallest table."""
    import tiktoken

    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = _lines([r for r in docs if _quality(r)])
    component = brute_components([(r["doc_id"], r["text"]) for r in docs], 5)
    docs = [r for r in docs if component[r["doc_id"]] == r["doc_id"]]
    strip = decontaminate._STRIP.decode()
    toks = lambda t: [w.strip(strip) for w in (t or "").lower().split()]
    items = [toks(x["text"]) for x in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    grams = [{tuple(own[i : i + 4]) for i in range(len(own) - 3)} or {tuple(own)} for own in items]

    def leaks(t):
        w = toks(t)
        have = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        # A leak has four equal tokens in a row; the slow matcher only looks where one does.
        return any(own and (len(own) < 4 or g & have) and _brute_leak(own, w) for own, g in zip(items, grams))

    docs = [r for r in docs if not leaks(r["text"])]
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(VOCAB), special_tokens={})
    want = {r["doc_id"]: (r["lang"], r["source"], r["n_chars"], enc.encode_ordinary(r["text"])) for r in docs}
    got = {r.doc_id: (r.lang, r.source, r.n_chars, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(want)


def test_pipeline_edges(spark):
    """Nulls, repeats, empties and columns named like metrics pass the first four stages with their own values."""
    text = " ".join(f"the w{i} and" for i in range(30))
    rows = [(1, text, "en", "a", 5, 77, "own"), (1, text, "en", "a", 5, 77, "own"), (None, text[::-1] + " the of and", "en", None, None, None, None), (3, None, None, None, None, 1, "x"), (4, "", "en", "a", 0, 2, "y"), (5, "the of " * 30_000 + text, "en", "b", 1, 3, "z")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, kept string"
    for df in (docs_of(spark, rows, schema), docs_of(spark, [], schema)):
        docs, n = df, df.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        out = docs.collect()
        assert len(out) == (2 if n else 0)
        if n:
            assert {(r.doc_id, r.n_words, r.kept) for r in out} == {(1, 77, "own"), (None, None, None)}


def test_op10_and_op6_read_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert QUERIES["op6_chat_format"](spark, SF).count() == n + 1
    assert QUERIES["op10_quality_classifier"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
