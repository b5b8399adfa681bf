"""URL filter, phrase mining and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from flowsmith.llm import periodic, phrases, queries, urls


def as_table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- operator 11

URLS = [None, "", "no scheme casino win", "://", "http://", "HTTP://WWW.Free-Bets.Example.ORG", "http://a.example.net/en/x", "http://example.net/en",
        "http://example.net/en/", "http://a.net", "http://a.net/", "http://net/", "http://notexample.net/en/", "http://example.com/de/a?xxx",
        "http://badexample.com/de/a", "http://u.org/fr/porn", "http://u.org/fr?porn", "http://u.org/p#porn", "http://u.org/pornx", "http://u.org/xporn",
        "http://u.org/éporné", "http://u.org/xxx-xxx", "http://u.org/casino/casino", "http://u.org/casino_win", "http://u.org/casino/poker",
        "http://u.org/a://b.net/c", "http://u.org?x://b.net/", "http://a.NET:80/", "http://example.com/DE/", "http://K.org/fr/", "a\nporn://h/p\nq",
        "http://h/" + "casino" * 30_000, "http://h/" + "ads/" * 30_000, "porn", "http://u.org/sex-cam"]


def judged(url, rules, strict, soft, limit):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, act) for act, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]

    def times(t):
        return len(re.findall(f"(?<![a-z0-9])(?={re.escape(t)}(?![a-z0-9]))", low))
    n_strict, n_soft = sum(map(times, strict)), sum(times(t) > 0 for t in soft)
    rule, verdict = max(fit)[2:] if fit else (None, "block" if n_strict or n_soft >= limit else "allow")
    return host, path, rule, verdict, n_strict, n_soft


@pytest.mark.parametrize("strict, soft, limit", [(urls.STRICT, urls.SOFT, urls.SOFT_LIMIT), (("sex-cam", "porné"), ("casino", "casino/poker", "ads"), 1), ((), (), 2)])
def test_url_verdicts(spark, strict, soft, limit):
    rows = [(k if k else None, u, "h", 1) for k, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, n_soft int").repartition(3)
    got = urls.judge_urls(pages, strict=strict, soft=soft, soft_limit=limit).collect()
    assert len(got) == len(rows)
    want = Counter((k if k else None, *judged(u, urls.RULES, strict, soft, limit)) for k, u in enumerate(URLS) for _ in "12")
    assert Counter(map(tuple, got)) == want


def test_url_rules_longest_wins(spark):
    rules = [("block", "b.c", "/"), ("allow", "c", "/x/"), ("block", "a.b.c", ""), ("allow", "b.c", "/x/y"), ("block", "c", "/x/"), ("allow", "zz", "")]
    texts = ["http://b.c/", "http://c/x/", "http://a.b.c", "http://a.b.c/x/y", "http://q.zz?x", "http://zz", "http://azz/"]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(texts)), "page_id int, url string"), rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("b.c/", "block"), ("c/x/", "block"), ("a.b.c", "block"), ("b.c/x/y", "allow"), ("zz", "allow"),
                                                  ("zz", "allow"), (None, "allow")]
    with pytest.raises(ValueError):
        urls.judge_urls(spark.createDataFrame([(1, "x")], "page_id int, url string"), strict=("",))


def test_url_query_and_empty(spark, tmp_path):
    sf = as_table(spark, tmp_path, "pages", list(enumerate(URLS)), "page_id bigint, url string")
    got = queries.QUERIES["op11_url_filter"](spark, sf).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: judged(u, urls.RULES, urls.STRICT, urls.SOFT, 2) for k, u in enumerate(URLS)}
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


# ---- operator 12

def mined(docs, words, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for i in range(len(w)) for k in range(1, words + 1) if i + k <= len(w))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {(p[0], *p[1 + i:1 + i + m]): 0 for p in cand for m in range(2, len(p) - 1) for i in range(len(p) - m)}
    for p, a in cand.items():
        for m in range(2, len(p) - 1):
            for i in range(len(p) - m):
                q = (p[0], *p[1 + i:1 + i + m])
                inside[q] = max(inside[q], a)
    rows = {}
    for p, a in cand.items():
        if inside.get(p, 0) >= a:
            continue
        best = min((1000 * a * n[p[0]] // (f[p[:1 + k]] * f[(p[0], *p[1 + k:])]), k) for k in range(1, len(p) - 1))
        k = best[1]
        rows.setdefault(p[0], []).append((-best[0], -a, " ".join(p[1:]).encode(), f[p[:1 + k]], f[(p[0], *p[1 + k:])]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, found in rows.items() for r, x in enumerate(sorted(found)[:top]))


def phrase_docs(seed):
    rnd = random.Random(seed)
    docs = [(None, None), ("en", ""), ("en", " \t\n..,"), ("de", "x" * 50_000 + " y"), ("de", "a b " * 20_000)]
    bits = ["the", "The", "of", "a", "b", "c\x1cd", "é", "É", "new york", "new york city", "in the year of", "\x00", "red, red", "wine.", "\x0b", "汉 字", "long" * 7,
            "longlonglonglonglong1", "longlonglonglonglong2"]
    for _ in range(400):
        docs.append((rnd.choice(["en", "en", "fr", None, "und"]), rnd.choice([" ", "  ", "\t"]).join(rnd.choices(bits, k=rnd.randrange(1, 60)))))
    return docs


@pytest.mark.parametrize("words, least, top, block", [(5, 30, 25, 1 << 22), (3, 8, 2000, 300), (2, 300, 5, 2000)])
def test_phrases(spark, monkeypatch, words, least, top, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    docs = phrase_docs(words)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, a int, key string").repartition(5)
    got = sorted(map(tuple, phrases.mine_phrases(df, words, least, top).collect()))
    want = mined(docs, words, least, top)
    assert len(want) > 3 and got == want


def test_phrase_counters_fold(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FOLD", 2)
    docs = phrase_docs(9)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(9)
    assert sorted(map(tuple, phrases.mine_phrases(df, 4, 20, 50).collect())) == mined(docs, 4, 20, 50)


def test_phrase_hash_collision_takes_another_seed(spark, monkeypatch):
    real = phrases.vocabulary

    def collide(rows, seed):
        out = real(rows, seed)
        return out.withColumn("h", out.h % 2) if seed == 1 else out
    monkeypatch.setattr(phrases, "vocabulary", collide)
    docs = phrase_docs(3)
    assert sorted(map(tuple, phrases.mine_phrases(spark.createDataFrame(docs, "lang string, text string"), 3, 20, 50).collect())) == mined(docs, 3, 20, 50)


def test_phrase_query_exact_and_empty(spark, tmp_path):
    docs = [("en", "p q " * 3_000_00 + "."), ("en", "s t u. " * 150)] + phrase_docs(4)
    sf = as_table(spark, tmp_path, "documents", docs, "lang string, text string")
    assert sorted(map(tuple, queries.QUERIES["op12_phrase_mining"](spark, sf).collect())) == mined(docs, 5, 100, 2000)
    assert phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    big = spark.createDataFrame([("x", [1, 2], 9_000_000_000_000, )], "lang string, key array<bigint>, a bigint")
    vocab = spark.createDataFrame([("x", 1, "p", 9_000_000_000_001), ("x", 2, "q", 9_000_000_000_007), ("x", 3, "r", 3)], "lang string, h bigint, word string, n bigint")
    row = phrases.score_cuts(big, vocab).first()
    n = 9_000_000_000_001 + 9_000_000_000_007 + 3
    assert row.score == 1000 * 9_000_000_000_000 * n // (9_000_000_000_001 * 9_000_000_000_007)


# ---- operator 13

def runs_by_all_lags(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            if x + q - s >= max(24, 3 * q):
                found.setdefault((s, x + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def run_texts(seed, n=60, longest=1500):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w, goal = [], rnd.randrange(1, longest)
        while len(w) < goal:
            kind = rnd.randrange(5)
            letters = rnd.choice(["a", "ab", "abc", "abcdefgh", [f"w{i}" for i in range(3000)]])
            block = rnd.choices(letters, k=rnd.randrange(1, rnd.choice([4, 40, 400])))
            if kind == 1:
                block = ["a"] * rnd.randrange(1, 300) + block
            times = rnd.choice([1, 1, 2, 3, 4, 9]) if kind else 1
            w += (block * times)[rnd.randrange(len(block)):] if rnd.random() < .5 else block * times
        out.append([x.encode() for x in w])
    return out


@pytest.mark.parametrize("first", [2, 4, 8])
def test_runs_against_all_lags(first):
    texts = run_texts(first)
    got = periodic.runs_of(texts, first)
    assert got == [runs_by_all_lags(t) for t in texts]
    assert {q for r in got for _, _, q in r} - set(range(16 * first)), "a period beyond the first scale"


def test_runs_special_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 2000:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [[c.encode() for c in t] for t in (fib[-1], thue, thue * 3, "a" * 2000, ("a" * 90 + "b" * 9) * 12, "ab" * 11 + "a", "ab" * 12, "abc" * 7 + "ab", "")]
    for first in (2, 8):
        assert periodic.runs_of(texts, first) == [runs_by_all_lags(t) for t in texts]


def digests(i, words):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = runs_by_all_lags(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    text = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_run_query(spark, tmp_path, odd_docs, no_docs):
    rows = [(i, b" \t".join(t).decode()) for i, t in enumerate(run_texts(11, 40, 600))] + [(None, "a " * 50), (7, None), (8, ""), (9, " \n"), (None, None)]
    sf = as_table(spark, tmp_path, "documents", rows, "doc_id bigint, text string")
    got = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter((i, *digests(i, (t or "").encode().split())) for i, t in rows)
    odd = periodic.run_digests(periodic.collapse_runs(odd_docs)).collect()
    assert len(odd) == odd_docs.count() and {r.n_runs for r in odd if r.doc_id == 7} == {1}
    assert periodic.run_digests(periodic.collapse_runs(no_docs)).count() == 0


def test_pair_slots_grow_with_the_words(spark):
    """Rare pairs of a large corpus must not fill slots together; counters come through sparse or dense."""
    assert phrases.pair_slots(0) == phrases.PAIR_SLOTS and phrases.pair_slots(80_000_000) == 1 << 24
    assert phrases.pair_slots(10 ** 12) == phrases.MOST_PAIR_SLOTS
    rnd = np.random.default_rng(1)
    for share in (0.0, 0.01, 0.33, 0.34, 1.0):
        counters = ((rnd.random(phrases.CHUNK) < share) * rnd.integers(1, 255, phrases.CHUNK)).astype(np.uint8)
        raw = phrases._short(counters)
        assert (phrases._long(raw, phrases.CHUNK) == counters).all() and len(raw) <= phrases.CHUNK
    bits = rnd.random(1000) < 0.5
    assert (phrases._are_set(np.packbits(bits).tobytes(), np.arange(1000)) == bits).all()


def test_pair_counters_are_folded_in_steps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FOLD", 2)
    docs = [("en", "new york is big. " * 3)] * 40
    df = spark.createDataFrame(docs, "lang string, text string").repartition(7)
    assert sorted(map(tuple, phrases.mine_phrases(df, 3, 100, 50).collect())) == mined(docs, 3, 100, 50)
