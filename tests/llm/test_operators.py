"""Each operator against a brute-force version, on odd rows and on the driver's small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from flowsmith.llm import bm25, chat, exact, hpyp, mixing, ordinal, pieces, pii, simhash, wordpiece
from flowsmith.llm.components import components
from flowsmith.llm.queries import ORACLES, QUERIES
from flowsmith.plans.oracle import compare_frames, duckdb_connection, run_oracle

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# -- 1 ----------------------------------------------------------------------------------

def test_ordinal_separates_grades(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    ratings = ordinal.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    odd = ratings.filter("doc_id % 2 = 1")
    model = ordinal.train(docs, odd)
    assert list(model.thresholds) == sorted(model.thresholds)
    rest = ratings.filter("doc_id % 2 = 0").withColumnRenamed("grade", "rated")
    got = ordinal.grade_documents(docs, model).join(rest, "doc_id").toPandas()
    accept = got["tail_2"] >= model.cut
    assert accept[got["rated"] == 2].mean() > 0.93
    assert accept[got["rated"] == 0].mean() < 0.05 and accept[got["rated"] == 1].mean() < 0.5


def test_ordinal_gradient():
    """The fit lowers the loss and keeps rare chance words out."""
    rnd = random.Random(0)
    slots, grades = [], []
    for i in range(600):
        g = rnd.choice([0, 1, 2])
        slots.append(np.array(sorted({10 + g, 100 + rnd.randrange(5), 1000 + i})))
        grades.append(g)
    grades = np.array(grades)
    telling = ordinal.screen(slots, grades)
    assert set(np.flatnonzero(telling)) == {10, 11, 12}
    m = ordinal.fit([s[telling[s]] for s in slots], grades)
    tails = m.tails(np.array([m.weights[s].sum() for s in slots]))
    assert ((tails > 0.5).sum(axis=1) == grades).all()
    assert m.thresholds[0] < m.thresholds[1]


def test_ordinal_finds_words_of_a_small_grade():
    """Many words that each tell the small grade apart by about four standard errors, among many that do not."""
    rnd = np.random.default_rng(3)
    grades = np.repeat([1, 2], [40, 400])
    marks = rnd.random((440, 60)) < np.where(grades == 1, 0.2, 0.04)[:, None]
    slots = [np.concatenate((np.flatnonzero(m), 1000 + np.flatnonzero(rnd.random(200) < 0.1))) for m in marks]
    telling = ordinal.screen(slots, grades)
    assert telling[:60].sum() > 40 and telling[1000:].sum() < 5


def test_ordinal_cut_bounds_the_loss():
    rnd = np.random.default_rng(1)
    grades = np.repeat([0, 1, 2], [100, 100, 1000])
    tail = 1 / (1 + np.exp(-rnd.normal(np.array([-3.0, 0.5, 3.0])[grades])))
    cut = ordinal.best_cut(tail, grades)
    kept = tail >= cut
    assert 0.95 < kept[grades == 2].mean() and kept[grades == 1].mean() < 0.5 < (tail >= 0.5)[grades == 1].mean()
    assert ordinal.best_cut(tail[grades != 1], grades[grades != 1]) == 0.5
    assert ordinal.best_cut(tail[:110], grades[:110]) == 0.5
    model = ordinal.fit_with_cut([np.array([g, 10 + i % 7]) for i, g in enumerate(grades)], grades)
    assert model.cut == 0.5 and list(model.thresholds) == sorted(model.thresholds)


def test_ordinal_repeated_ids_count_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(100)] + [(i, f"text of {i}") for i in (2, 3, 4)], "doc_id bigint, text string").coalesce(1)
    ratings = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 2)], "doc_id bigint, grade int")
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda slots, grades, n_grades, f=ordinal.fit: seen.append(grades.tolist()) or f(slots, grades, n_grades))
    ordinal.train(docs, ratings, sample=4)
    assert sorted(seen[0]) == [0, 1, 2, 2]


def test_ordinal_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = ordinal.train(odd_docs, ordinal.graded(none))
    assert ordinal.grade_documents(odd_docs, model).count() == odd_docs.count()
    kept = ordinal.select_documents(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert ordinal.grade_documents(no_docs, model).count() == 0
    rated = spark.createDataFrame([(1, 0, None), (9, 1, 1), (None, 1, 0), (3, None, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert rows_of(ordinal.graded(rated), "doc_id", "grade") == [(1, 0), (6, 2), (9, 1)]
    assert ordinal.grade_documents(odd_docs, ordinal.train(odd_docs, ordinal.graded(rated))).count() == odd_docs.count()


# -- 2 ----------------------------------------------------------------------------------

def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["odd", "sf0.001"])
def test_simhash_matches_brute_force(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else documents(spark)
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps))), key=repr)
    assert rows_of(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want


def test_simhash_keeps_one_of_each_group(odd_docs, no_docs):
    kept = simhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    all_rows = odd_docs.collect()
    all_fps = [brute_fingerprint(r["text"]) for r in all_rows]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    groups = {min(j for j, g in enumerate(all_fps) if (f ^ g).bit_count() <= 3) for f in all_fps}
    assert len(rows) == len(groups)
    assert simhash.simhash_groups(no_docs).count() == 0 and simhash.keep_one_per_group(no_docs).count() == 0


def test_position_sets_cover_every_five():
    from itertools import combinations
    sets = simhash.position_sets()
    assert len(sets) == 14
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 5))


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    """With lists of at most 3 classes every level of the index is used."""
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(0, 6))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "LIST_CAP", 3)
    classes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components(simhash.links(classes)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    mine = [got.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[300] == got[200] == 200


# -- 3 ----------------------------------------------------------------------------------

def brute_chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def check_chats(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(formatted).collect()}
    assert got == brute_chats(rows)
    return formatted


def test_chat_round_trip(spark):
    check_chats(spark.read.parquet(f"{SF}/conversations.parquet"))


def test_chat_odd_rows(spark, monkeypatch):
    rnd = random.Random(2)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<", "[", "\\", "/s>", "x", "é😀", "\n", ""]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, 0, 1, 5000, 9000]), rnd.choice(["user", "assistant", None, "[/INST]"]),
             rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))]), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")
    formatted = check_chats(df)
    assert formatted.count() == 4                            # turn numbers far apart make no parts
    monkeypatch.setattr(chat, "RUN", 50)
    assert check_chats(df).filter("part <> 0").count() > 0   # conversations of more rows than a run
    monkeypatch.setattr(chat, "RUN", 4096)
    two = spark.createDataFrame([(1, 4095, "user", "a"), (1, 4096, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert [r["formatted"] for r in chat.format_chats(two).collect()] == ["<s>[INST]user[/INST]a</s>[INST]assistant[/INST]b</s>"]
    for r in formatted.collect():
        assert r["n_turns"] == len(chat.parse(r["formatted"]))
    assert chat.chat_digests(chat.format_chats(df.filter("false"))).count() == 0


def test_chat_pieces_of_a_large_part(monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 60)
    n = 30
    b = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * n), pa.array([True] * n), pa.array(["user", "assistant"] * (n // 2)),
                                    pa.array([f"text {i} </s>" for i in range(n)])], names=["conv_id", "part", "first", "role", "text"])
    got = [r for out in chat._parts(iter([b.slice(0, 7), b.slice(7)])) for r in out.to_pylist()]
    assert len(got) > 5 and [r["piece"] for r in got] == list(range(len(got)))
    turns = [t for r in got for t in chat.parse(r["formatted"])]
    assert turns == [(["user", "assistant"][i % 2], f"text {i} </s>") for i in range(n)]
    assert [r["formatted"].startswith("<s>") for r in got] == [True] + [False] * (len(got) - 1)
    assert all(len(r["formatted"]) <= 60 + 40 and r["n_turns"] == len(chat.parse(r["formatted"])) for r in got)
    said = [chat.unescape(r["formatted"][s:e]) for r in got for s, e in zip(r["loss_start"], r["loss_end"])]
    assert said == [f"text {i} </s>" for i in range(1, n, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_chat_batches_cut_anywhere_give_the_same_parts(monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(chat, "PART_BYTES", rnd.choice([40, 300, 1 << 20]))
    rows = []
    for c in [None, 1, 2, 3, 4, 5]:
        for p in sorted(rnd.sample(range(4), rnd.randint(1, 3))):
            rows += [(c, p, p == 0, rnd.choice(["user", "assistant", "é"]), rnd.choice(["", "x</s>", "汉字" * rnd.randint(1, 9)])) for _ in range(rnd.randint(1, 9))]
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()])],
                                       names=["conv_id", "part", "first", "role", "text"])
    cuts = [0, *sorted(rnd.randint(0, len(rows)) for _ in range(6)), len(rows)]
    one = [r for out in chat._parts(iter([whole])) for r in out.to_pylist()]
    many = [r for out in chat._parts(iter([whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])])) for r in out.to_pylist()]
    assert one == many
    at = 0
    for r in one:
        mine = rows[at:at + r["n_turns"]]
        at += r["n_turns"]
        assert {(x[0], x[1]) for x in mine} == {(r["conv_id"], r["part"])} and chat.parse(r["formatted"]) == [(x[3], x[4]) for x in mine]
        assert [chat.unescape(r["formatted"][s:e]) for s, e in zip(r["loss_start"], r["loss_end"])] == [x[4] for x in mine if x[3] == "assistant"]
    assert at == len(rows)


# -- 4 ----------------------------------------------------------------------------------

def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.mark.parametrize("chunk", [pieces.CHUNK, 301])
def test_pieces_match_the_library(spark, odd_docs, chunk):
    sp = library()
    for docs in (odd_docs, documents(spark)):
        got = pieces.decode_documents(pieces.encode_documents(docs, chunk=chunk)).collect()
        assert Counter(map(str, got)) == Counter(map(str, pieces.encode_documents(docs, chunk=chunk, decoded=True).collect()))
        want = sorted(((r["doc_id"], sp.encode(r["text"] or ""), r["text"] or "") for r in docs.collect()), key=repr)
        assert sorted(((r["doc_id"], list(r["token_ids"]), r["text"]) for r in got), key=repr) == want


def test_pieces_of_chunks_without_spaces():
    enc, sp, rnd = pieces.Encoder(pieces.load()), library(), random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("aabbcdetheinr12汉é😀.") for _ in range(rnd.randint(40, 120)))
        marked, c = pieces.marked(text), rnd.randint(17, 25)
        cut = [(max(0, a - enc.longest), a, min(a + c, len(marked))) for a in range(0, len(marked), c)]
        args = [(marked[lo:b + enc.longest], a - lo, b - lo) for lo, a, b in cut]
        states = pieces.border_states([enc.transfer(*x)[2] for x in args])
        ids = [int(i) for (t, a, b), (s, e) in zip(args, states) for i in enc.backtrace(t, a, b, enc.states(t, a)[s], enc.states(t, b)[e])]
        assert ids == sp.encode(text)


def test_transfer_matrices_combine_associatively():
    rnd = np.random.default_rng(1)
    a, b, c = (np.where(rnd.random(s) < 0.4, -np.inf, rnd.integers(-9, 0, s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


# -- 5 ----------------------------------------------------------------------------------

def test_mixing_counts_follow_poisson(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 10 < 8, 'a', if(id % 10 = 8, 'b', null)) as source", "'t' as text")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 2.0), ("unseen", 0.0)], "source string, weight double")
    got = mixing.mixed_rows(docs, weights).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] - 10_000) < 500 and abs(n["b"] - 10_000) < 500 and abs(n[None] - 20_000) < 700
    per = Counter(r["count"] for r in mixing.mixed_rows(docs.filter("source = 'b'"), weights, total=4000).groupBy("doc_id").count().collect())
    for k in (1, 2, 3):
        assert abs(per[k] / 4000 - math.exp(-1) / math.factorial(k)) < 0.03


def test_mixing_large_rate_and_odd_rows(spark, odd_docs, no_docs):
    weights = mixing.tempered_weights(odd_docs)
    got = mixing.mixed_rows(odd_docs, weights, total=30_000)
    assert got.columns == odd_docs.columns and abs(got.count() - 30_000) < 2000
    same = mixing.mix(odd_docs, weights, total=500)
    assert rows_of(same.drop("_row"), "copy", "place") == rows_of(mixing.mix(odd_docs.repartition(7), weights, total=500).drop("_row"), "copy", "place")
    assert mixing.mixed_rows(no_docs, mixing.tempered_weights(no_docs)).count() == 0
    assert mixing.mixed_rows(odd_docs, spark.createDataFrame([], "source string, weight double")).count() == 0


@pytest.mark.parametrize("rate", [0.0, 1e-9, 0.3, 7.5, 31.0, 499.0, 501.0, 600.0, 20_000.0])
def test_mixing_steps_are_the_poisson_distribution(spark, rate):
    """Below, at and beyond every rate the numbers drawn are the inverse of the distribution at u."""
    first, steps = mixing.poisson_steps(F.lit(rate))
    first, steps = spark.range(1).select(first, steps).first()
    want, k = [], 0
    while k <= rate + 12 * math.sqrt(rate) + 30:
        want.append(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0))
        k += 1
    want = np.cumsum(want)
    for u in [0.0, 1e-12, 1e-5, 0.1, 0.37, 0.5, 0.9, 0.9999, 1 - 1e-9]:
        below = sum(s <= u for s in steps)
        assert (first + below if below else first) == int((want <= u).sum()) or (u == 0.0 and first)


def test_mixing_of_a_small_source_equals_the_oracle(spark, tmp_path):
    """One row among so many that its rate is beyond 500."""
    sf = str(tmp_path)
    spark.range(700_000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "if(id = 7, 'tiny', 'large') as source", "1L as n_chars").write.parquet(
        f"{sf}/documents.parquet")
    got = QUERIES["op5_source_mixing"](spark, sf).filter("source = 'tiny'")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    want = con.execute(f"select * from ({ORACLES['op5_source_mixing']}) t where source = 'tiny'").df()
    assert got.count() == len(want) > 650 and set(got.toPandas()["place"]) == set(want["place"])


# -- 6 ----------------------------------------------------------------------------------

def brute_bm25(rows, queries, k):
    bags = [Counter((t or "").encode().lower().split()) for _, t in rows]
    n, mean = len(rows), sum(sum(b.values()) for b in bags) / max(len(rows), 1)
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = []
    for q, t in queries:
        want = Counter((t or "").encode().lower().split())
        scored = []
        for (i, _), bag in zip(rows, bags):
            norm = 1.2 * (1 - 0.75 + 0.75 * sum(bag.values()) / mean)
            s = sum(c * idf[w] * bag[w] * 2.2 / (bag[w] + norm) for w, c in want.items() if w in bag)
            if s > 0:
                scored.append((-round(s, 6), i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(32_768, 64, 8), (40, 8, 3)])
def test_bm25_matches_brute_force(spark, odd_docs, monkeypatch, sizes):
    monkeypatch.setattr(bm25, "SHARD_DOCS", sizes[0])
    monkeypatch.setattr(bm25, "BLOCK", sizes[1])
    for docs in (documents(spark), odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        queries = docs.filter("doc_id % 20 = 0")
        got = bm25.top_k(docs, queries, k=5, query_terms=1 << 20 if sizes[1] == 64 else 700)
        mine = sorted(((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect()), key=repr)
        want = brute_bm25(rows, [(r["doc_id"], r["text"]) for r in queries.collect()], 5)
        assert [x[:3] for x in mine] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in mine], [x[3] for x in want], atol=2e-6)


def test_bm25_pruning_keeps_results():
    """The documents that a shard returns hold the k best of full scoring, whatever is skipped."""
    rnd = np.random.default_rng(3)
    parts = []
    for _ in range(3):
        bags = [np.unique(rnd.zipf(1.3, 40) % 500, return_counts=True) for _ in range(100)]
        term = np.concatenate([b[0] for b in bags]).astype(np.int64)
        doc, tf = np.repeat(np.arange(100, dtype=np.int32), [len(b[0]) for b in bags]), np.concatenate([b[1] for b in bags])
        order = np.argsort(term, kind="stable")
        terms, df = np.unique(term, return_counts=True)
        parts.append({"ids": list(range(100)), "lengths": np.full(100, 40), "terms": terms, "df": df, "docs": doc[order], "tf": tf[order]})
    shard = bm25.Shard(parts, 40.0, np.arange(6))
    full, rare, common = [], [], []
    for _ in range(50):
        words = np.unique(rnd.zipf(1.3, 30) % 500)
        weight = rnd.random(len(words)) * 5
        score = np.zeros(300)
        for t, x in zip(words, weight):
            at = shard.places(np.array([t]))[0]
            if at >= 0:
                s, e = shard.first[at], shard.last[at]
                score[shard.doc[s:e]] += x * shard.impact[s:e]
        full.append(score)
        rare.append((shard.places(words[words >= 6]), weight[words >= 6]))
        common.append((words[words < 6], weight[words < 6]))
    for raised in (0.0, 0.9):
        floors = np.array([np.sort(f)[-5] * raised for f in full])
        for f, (score, doc) in zip(full, shard.best(rare, common, 5, floors)):
            best = np.sort(f)[::-1][:5]
            assert np.allclose(f[doc], score, atol=1e-8)
            assert np.allclose(np.sort(score)[::-1][:5], best[best > 0], atol=1e-8)


def test_bm25_index_in_small_row_groups(spark, monkeypatch):
    """A task that writes or reads the index holds a row group, which does not grow with the task's part of the table."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(bm25, "INDEX_BYTES", 1 << 16)
    docs = spark.range(5 * bm25.ROW_DOCS).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.lit("word")).alias("text")).coalesce(1)
    index = bm25.build_index(docs)
    sizes = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (p[len("file:"):] if p.startswith("file:") else p for p in index.inputFiles()))
             for i in range(f.metadata.num_row_groups)]
    assert sum(sizes) == 5 and max(sizes) == 1


def test_bm25_shard_lets_go_of_its_rows():
    """The index rows are freed before the arrays of the common words are made."""
    part = {"ids": [1, 2], "lengths": np.array([2, 1]), "terms": np.array([3, 7]), "df": np.array([2, 1]),
            "docs": np.array([0, 1, 0], np.int32), "tf": np.array([1, 70_000, 1], np.int32)}
    parts = [part]
    shard = bm25.Shard(parts, 1.5, np.array([3]))
    assert parts == [] and shard.tf.tolist() == [[1, 70_000]]
    assert bm25.Shard([part | {"tf": np.array([1, 9, 1], np.int32)}], 1.5, np.array([3])).tf.dtype == np.uint16


def test_bm25_word_keys_of_all_lengths():
    rnd = random.Random(2)
    words = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(70), *range(1, 40)]]
    got = bm25.word_keys(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert got.tolist() == [bm25.word_key(w) for w in words]


def test_bm25_postings_are_those_of_the_single_texts():
    rnd = random.Random(3)
    texts = ["", " ", "a", "x" * 40, *("".join(rnd.choice("aB é汉\x1c\x85\xa0\t\n\r\x0b\x0c") for _ in range(rnd.randrange(60))) for _ in range(200)), "\n"]
    n, held, keys, counts = bm25._batch_postings(texts)
    ends, cache = np.cumsum(held), bm25._Keys()
    for i, t in enumerate(texts):
        own = slice(ends[i] - held[i], ends[i])
        terms, tf, size = bm25._terms(t, cache)
        assert n[i] == size and dict(zip(keys[own].tolist(), counts[own].tolist())) == dict(zip(terms.tolist(), tf.tolist())), t


def test_bm25_rows_hold_similar_documents_and_few_are_scored_in_full(monkeypatch):
    """Texts of two vocabularies, mixed in the table, are apart in the index, and of thousands of documents a query scores few in full."""
    rnd = np.random.default_rng(5)
    n = 4 * bm25.ROW_DOCS
    texts = [" ".join(f"{'uv'[i % 2]}{w}" for w in rnd.zipf(1.2, 30) % 300) for i in range(n)]
    rows = list(bm25._index_rows(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["id", "text"])])))
    assert sorted(i for r in rows for i in r.column(0)[0].as_py()) == list(range(n))
    assert [len({i % 2 for i in r.column(0)[0].as_py()}) for r in rows] == [1, 1, 1, 1]
    held = Counter(t for r in rows for t, df in zip(r.column(2)[0].as_py(), r.column(3)[0].as_py()) for _ in range(df))
    asked = [(i, *bm25._terms(texts[i], bm25._Keys())) for i in range(0, 640, 10)]
    asked = [(i, sorted((t, c * math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)), held[t] * bm25.COMMON > n) for t, c in zip(k.tolist(), tf.tolist())))
             for i, k, tf, _ in asked]
    block = bm25._block(pa.table({"qid": [q for q, _ in asked], "query_id": [q for q, _ in asked],
                                  **{c: pa.array([[x[j] for x in w] for _, w in asked]) for j, c in enumerate(("terms", "weights", "common"))}}))
    scored, whole = [], bm25.Documents.scores
    monkeypatch.setattr(bm25.Documents, "scores", lambda self, weights, docs: scored.append(len(docs)) or whole(self, weights, docs))
    got = [x for b in bm25._search(SimpleNamespace(value=block), 10, 30.0)(iter(rows)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == 10 * len(asked) and sum(scored) < 40 * len(asked)
    bags = [Counter(t.encode().split()) for t in texts]
    for q, words in asked[:5]:
        weight, own = {t: w for t, w, _ in words}, [(bm25.word_key(w), w) for w in bags[q]]
        score = [sum(weight[t] * b[w] * 2.2 / (b[w] + 1.2) for t, w in own if w in b) for b in bags]
        assert np.allclose(sorted((s for i, _, _, s in got if i == q), reverse=True), sorted(score, reverse=True)[:10], atol=1e-6)


def test_bm25_equal_documents_have_equal_scores(spark):
    """Copies, among them more than k, are ranked by their ids wherever they are."""
    rows = [(i, f"the same words in {'every' if i % 3 else 'each'} copy") for i in range(90, 0, -1)] + [(100 + i, f"the other {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bm25.top_k(docs, docs.filter("doc_id in (3, 4)"), k=12).collect()}
    for q, like in ((3, [i for i in range(1, 91) if i % 3 == 0]), (4, [i for i in range(1, 91) if i % 3])):
        assert [got[q, r][0] for r in range(1, 13)] == like[:12] and len({got[q, r][1] for r in range(1, 13)}) == 1


def test_bm25_empty(no_docs, odd_docs):
    assert bm25.top_k(no_docs, no_docs).count() == 0
    assert bm25.top_k(odd_docs, no_docs).count() == 0


# -- 7 ----------------------------------------------------------------------------------

def brute_spans(t):
    out = []
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn or k == 3 and 9 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_base_spans_match_plain_patterns():
    rnd = random.Random(5)
    bits = ["a@", "b.c", "@", ".", "1", "25", ".4.", "300", "+1", "-", " ", "(", ")", "4111", "1111", "x@y.z", "é", "%", "a", "0.0.0.1", "99", "@b.co"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_personal_data_of_all_documents(spark, odd_docs, no_docs):
    for docs in (documents(spark, "/root/testdata/sf0.01"), odd_docs):
        got = rows_of(pii.find_personal_data(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
        want = []
        for r in docs.collect():
            spans = brute_spans(r["text"] or "")
            n = Counter(k for k, _, _ in spans)
            want.append((r["doc_id"], n[0], n[1], n[2], n[3], hashlib.sha256(pii.written(spans).encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert pii.find_personal_data(no_docs).count() == 0


def test_label_model_learns_reliabilities():
    """A noisy labeler loses against three good ones; the classifier follows the label model."""
    rnd, counts, truth = random.Random(4), Counter(), defaultdict(Counter)
    for _ in range(20_000):
        y = rnd.random() < 0.4
        votes = [(1 if y else -1) * (1 if rnd.random() < a else -1) for a in (0.95, 0.9, 0.9, 0.5, 0.85)]
        code = pii._pattern(pii.PHONE, votes, 0)
        counts[code] += 1
        truth[code][y] += 1
    soft = pii.reliabilities(counts)
    score = pii.span_classifier(counts, soft)
    right = sum(truth[c][(score[c] >= 0.5)] for c in counts) / 20_000
    assert right > 0.96
    assert all(pii.unpattern(c)[0] == pii.PHONE for c in counts)


def test_added_spans_never_overlap_base():
    found = pii.candidates("call (456) 555-2186 now, or +1 456 555 2186, mail joe at mail dot com password=abcdef1234")
    spans = pii.added(found, {c: 0.9 for _, _, _, c, _ in found})
    assert {"phone", "email", "secret"} <= {pii.KINDS[k] for k, _, _ in spans}
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_other_kinds_are_found():
    cases = {"pay to IBAN DE89 3704 0044 0532 0130 00 today": ("iban", "DE89 3704 0044 0532 0130 00"), "konto GB82WEST12345698765432.": ("iban", "GB82WEST12345698765432"),
             "her ssn 078-05-1120 is old": ("national", "078-05-1120"), "from Maria Lopez, with love": ("person", "Maria Lopez"),
             "dear John Q. Public": ("person", "John Q. Public")}
    for t, want in cases.items():
        found = [(pii.KINDS[k], t[s:e]) for k, s, e, _, base in pii.candidates(t) if not base]
        assert want in found, (t, found)
    strict = lambda t, kind: [pii.unpattern(c)[1][0] for k, _, _, c, _ in pii.candidates(t) if k == kind]
    assert strict("DE89370400440532013000", pii.IBAN) == [1] and strict("DE88370400440532013000", pii.IBAN) == [-1]
    assert strict("078-05-1120", pii.NATIONAL) == [1] and strict("666-05-1120", pii.NATIONAL) == [-1]
    assert not any(k == pii.PERSON for k, *_ in pii.candidates("The Cat sat, Maria lopez and maria Lopez"))
    codes = [c for t in cases for _, _, _, c, _ in pii.candidates(t)]
    assert all(0 <= c < pii.PATTERNS and 0 <= pii.before_class(c) < pii.BEFORE for c in codes)


def test_classifier_learns_the_word_before():
    """Votes tell nothing apart, the word before the span does."""
    votes = [-1, 1, 0, 0, 1]
    counts = {pii._pattern(pii.PHONE, votes, 0, b): 500 for b in (3, 7)}
    soft = {c: 0.95 if pii.before_class(c) == 3 else 0.05 for c in counts}
    score = pii.span_classifier(counts, soft)
    assert all((score[c] > 0.7) == (pii.before_class(c) == 3) for c in counts)


def test_all_spans_match_a_plain_run(spark):
    """Candidates, EM, classifier and choice in one process give the spans of the Spark job."""
    rows = [(r["doc_id"], r["text"] or "") for r in documents(spark).collect()]
    rows += [(-1, "call (456) 555-2186 or Maria Lopez, IBAN DE89 3704 0044 0532 0130 00, password=abcdef1234"), (-2, "ssn 078-05-1120, joe at mail dot com")]
    found = {i: pii.candidates(t) for i, t in rows}
    counts = Counter(c for f in found.values() for _, _, _, c, _ in f)
    scores = pii.span_classifier(counts, pii.reliabilities(counts))
    want = {i: pii.written(pii.added(f, scores)) for i, f in found.items()}
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == want
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert all(int(a[2]) <= int(b[1]) or {a[0], b[0]} <= set(pii.KINDS[:4]) for a, b in zip(spans, spans[1:])) and len(spans) == r["n_spans"]
        base = [x for x in pii.written(brute_spans(dict(rows)[r["doc_id"]])).split(",") if x]
        assert set(base) <= set(r["spans"].split(","))


def test_secrets_need_no_digit():
    for t in ("the password=swordfish is old", "secret:correcthorsebattery", "key ABCDEFGHIJKLMNOPQRST here", "sk-" + "a" * 20):
        assert [c[0] for c in pii.candidates(t)] == [pii.SECRET], t


def test_long_candidates_are_whole():
    for secret in ("token=" + "eyJ0.x_" * 100, "password:" + "p" * 129, "ghp_" + "a1" * 200, "sk-" + "b2" * 200):
        t = f"use {secret} now"
        assert [(k, t[s:e]) for k, s, e, _, _ in pii.candidates(t)] == [(pii.SECRET, secret)]
    for local, domain in (("ann." * 30 + "x", "mail"), ("joe", "m" * 70)):
        t = f"write {local} at {domain} dot com, or bob [at] a.b (at) mail dot co dot uk"
        found = [t[s:e] for k, s, e, _, _ in pii.candidates(t) if k == pii.EMAIL]
        assert found == [f"{local} at {domain} dot com", "a.b (at) mail dot co dot uk"]
    rnd = random.Random(6)
    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?[(\[ ]at[)\] ] ?[A-Za-z0-9-]+(?: ?[(\[ ]dot[)\] ] ?[A-Za-z0-9-]{2,})+")
    for _ in range(20_000):
        t = "".join(rnd.choice(["a", "b.", " ", " at ", "(at)", " dot ", "[dot]", "com", "-", "at", "dot", "%x"]) for _ in range(rnd.randint(0, 14)))
        assert pii._spelled(t) == [m.span() for m in plain.finditer(t)], t


# -- 8 ----------------------------------------------------------------------------------

def brute_base(rows):
    tokens = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in tokens]
    c = Counter(w for (_, t), h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))
                   for (d, t), h in zip(tokens, held)), key=repr)


@pytest.mark.parametrize("block", [hpyp.BLOCK_TOKENS, 500])
def test_language_scores_base(spark, odd_docs, block):
    for docs in (documents(spark), odd_docs):
        got = hpyp.language_scores(docs, block_tokens=block).collect()
        mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
        want = brute_base(docs.collect())
        assert [x[:5] for x in mine] == [x[:5] for x in want]
        assert np.allclose([x[5] for x in mine], [x[5] for x in want], rtol=1e-9, atol=1e-5)
        assert all(r["score"] < 0 for r in got)


def test_language_scores_do_not_depend_on_blocks(spark, no_docs):
    docs = documents(spark)
    a = {r["doc_id"]: r["score"] for r in hpyp.language_scores(docs).collect()}
    b = {r["doc_id"]: r["score"] for r in hpyp.language_scores(docs.repartition(5), block_tokens=3000).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 * abs(a[k]) for k in a)
    assert hpyp.language_scores(no_docs).count() == 0


def test_language_model_beats_the_unigram(spark):
    got = {r["held_out"]: r for r in hpyp.perplexity(hpyp.language_scores(documents(spark, "/root/testdata/sf0.1"))).collect()}
    assert got[True]["perplexity"] < got[True]["base_perplexity"]


def test_language_model_uses_the_whole_word_before(spark):
    """'united' and 'red' end alike, but other words follow them."""
    rows = [(i, "united states " * 20 + "red apple " * 20) for i in range(20) if not hpyp.held_out(i)]
    tests = [(1000 + i, t) for i in range(40) if hpyp.held_out(1000 + i) for t in ("united states", "red states")]
    got = hpyp.language_scores(spark.createDataFrame(rows + tests, "doc_id bigint, text string").repartition(3)).collect()
    held = sorted(r["score"] for r in got if r["held_out"])
    assert held and held[len(held) // 2] - held[len(held) // 2 - 1] > 1


def plain_seat(customers, base, discount, key):
    """Tables of one dish, customers one by one (up to EXACT seated, then in steps), with the operator's random numbers."""
    if not customers:
        return 0
    tables, seated = 1.0, 1
    while seated < customers:
        step = 1 if seated < hpyp.EXACT else seated // 16
        n = min(step, customers - seated)
        p = base / (seated + (n - 1) / 2 - discount * tables + base)
        k = np.array([key], np.uint64)
        tables += hpyp.opened(np.array([float(n)]), np.array([p]), k, seated)[0] if step > 1 else hpyp._uniform(k, seated)[0] < p
        seated += step
    return min(tables, customers)


def test_language_model_contexts_do_not_depend_on_the_size(spark):
    """A word stays a context however much other text there is."""
    rows = [(i, "united states " * 5 + "red apple " * 5) for i in range(6) if not hpyp.held_out(i)]
    rows += [(3000 + i, "lorem ipsum " * 60_000) for i in range(4) if not hpyp.held_out(3000 + i)]
    asked = next(i for i in range(9000, 9100) if hpyp.held_out(i))
    got = hpyp.language_scores(spark.createDataFrame(rows + [(asked, t) for t in ("united states", "red states")], "doc_id bigint, text string")).collect()
    high, low = sorted((r["score"] for r in got if r["doc_id"] == asked), reverse=True)
    assert high > low + 0.5


def test_language_scores_need_little_disk(spark, monkeypatch):
    """No table of the scores takes a key for each (word, context) pair however many buckets there are, and what was used is deleted."""
    rnd, made = random.Random(5), []
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.5))}" for _ in range(400))) for i in range(150)]
    write = hpyp.materialize

    def measured(df, **options):
        out = write(df, **options)
        made.append((out.agg(F.sum(F.length("data"))).first()[0], out.inputFiles()))
        return out

    monkeypatch.setattr(hpyp, "materialize", measured)
    monkeypatch.setattr(hpyp, "BUCKET_BYTES", 30_000)
    got = hpyp.language_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    pairs = len({p for _, t in rows for p in zip(t.split(), t.split()[1:])})
    left = [os.path.exists(f.removeprefix("file://")) for _, files in made for f in files]
    print(f"{pairs} pairs, {[n for n, _ in made]} bytes, {sum(left)} of {len(left)} files left")
    assert len(got) == 150 and max(n for n, _ in made) < 10 * pairs and sum(left) < len(left) / 4


def plain_scores(rows, burn_in, samples):
    """doc_id -> score, word by word in dictionaries; and P(. | word before) for checking sums."""
    D, S = hpyp.DISCOUNT, hpyp.STRENGTH
    key = lambda w: int(np.uint64(hpyp.word_key(w) & (1 << 64) - 1))
    mix = lambda x: int(hpyp._mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    docs = [(i, (t or "").encode().lower().split() + [hpyp.END_WORD], hpyp.held_out(i)) for i, t in rows]
    pairs = [(u, w, h) for _, ws, h in docs for u, w in zip([hpyp.START_WORD, *ws], ws)]
    count = Counter(w for _, w, h in pairs if not h)
    size = sum(len((t or "").encode()) for _, t in rows)
    contexts = {w for w, c in count.items() if c >= hpyp.LEAST_USES * math.sqrt(size / hpyp.WORD_BYTES)} | {hpyp.START_WORD}
    end = lambda u: hpyp.START if u == hpyp.START_WORD else u[-1]
    c3, direct, uses = Counter(), Counter(), Counter()
    for u, w, h in pairs:
        if not h and u in contexts:
            c3[u, w] += 1
            uses[u] += 1
        elif not h:
            direct[end(u), w] += 1
    v = len(count)

    def lower(t3):
        out = Counter(direct)
        for (u, w), t in t3.items():
            out[end(u), w] += t
        return {k: x for k, x in out.items() if x}

    def upper(c2, t2, t1=None, t0=None):
        c1 = Counter()
        for (b, w), t in t2.items():
            c1[hpyp.CLASS[b], w] += t
        t1 = {k: t1(k, c) if t1 else 1 for k, c in c1.items()}
        c0 = Counter()
        for (_, w), t in t1.items():
            c0[w] += t
        return c2, t2, c1, t1, c0, {w: t0(w, c) if t0 else 1 for w, c in c0.items()}

    def totals(state):
        c2, t2, c1, t1, c0, t0 = state
        by = lambda x: (lambda g: [g.update({k[0]: c}) for k, c in x.items()] and g or g)(Counter())
        return by(c2), by(t2), by(c1), by(t1), sum(c0.values()), sum(t0.values())

    def parents(state, T):
        c2, t2, c1, t1, c0, t0 = state
        C2, T2, C1, T1, C0, T0 = T
        p0 = lambda w: (max(c0.get(w, 0) - D[0] * t0.get(w, 0), 0) + (S[0] + D[0] * T0) / (v + 1)) / (S[0] + C0)
        p1 = lambda k, w: (c1.get((k, w), 0) - D[1] * t1.get((k, w), 0) + (S[1] + D[1] * T1[k]) * p0(w)) / (S[1] + C1[k])
        p2 = lambda b, w: (c2.get((b, w), 0) - D[2] * t2.get((b, w), 0) + (S[2] + D[2] * T2[b]) * p1(hpyp.CLASS[b], w)) / (S[2] + C2[b])
        return p0, p1, p2

    t3 = {k: 1 for k in c3}
    state = upper(lower(t3), {k: 1 for k in lower(t3)})
    kept = []
    for number in range(burn_in + samples + 1):
        T = totals(state)
        tables = Counter()
        for (u, w), t in t3.items():
            tables[u] += t
        if number > burn_in:
            kept.append((dict(t3), tables, parents(state, T)[2]))
        salt = (number + 1) * 0xD1B54A32D192ED03
        p0, p1, p2 = parents(state, T)
        t3 = {(u, w): 1 if c == 1 else plain_seat(c, (S[3] + D[3] * tables[u]) * p2(end(u), w), D[3], mix(key(w) + mix(key(u) + 3001)) + salt & (1 << 64) - 1)
              for (u, w), c in c3.items()}
        c2 = lower(t3)
        t2 = {(b, w): plain_seat(c, (S[2] + D[2] * T[1][b]) * p1(hpyp.CLASS[b], w), D[2], mix(key(w) + b + 1) + salt & (1 << 64) - 1) for (b, w), c in c2.items()}
        state = upper(c2, t2, lambda k, c: plain_seat(c, (S[1] + D[1] * T[3][k[0]]) * p0(k[1]), D[1], mix(key(k[1]) + int(k[0]) + 1001) + salt & (1 << 64) - 1),
                      lambda w, c: plain_seat(c, (S[0] + D[0] * T[5]) / (v + 1), D[0], mix(key(w) + 2001) + salt & (1 << 64) - 1))

    def p(u, w):
        own = sum(c3.get((u, w), 0) - D[3] * t.get((u, w), 0) for t, _, _ in kept) / len(kept)
        up = sum((S[3] + D[3] * tables[u]) * p2(end(u), w) for _, tables, p2 in kept) / len(kept)
        return (own + up) / (S[3] + uses[u])

    return {i: sum(math.log10(p(u, w)) for u, w in zip([hpyp.START_WORD, *ws], ws)) for i, ws, _ in docs}, p, count


@pytest.mark.parametrize("burn_in, samples, block", [(1, 2, 1_500_000), (0, 1, 150)])
def test_language_scores_match_a_plain_model(spark, burn_in, samples, block):
    rnd = random.Random(7)
    words = ["the", "The", "of", "cat", "dog.", "x1", "é", "sat", "on", "mat!", "new", "york", *[f"w{i}" for i in range(60)]]
    rows = [(i, " ".join(rnd.choices(words, [90, 5, 60, 30, 20, 9, 5, 9, 9, 9, 20, 20, *[1] * 60], k=rnd.randint(0, 60)))) for i in range(90)] + [(200, None), (201, "")]
    want, p, count = plain_scores(rows, burn_in, samples)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hpyp.language_scores(df, burn_in=burn_in, samples=samples, block_tokens=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 3e-5 * max(1, abs(want[i])) for i in want)
    for u in (b"the", b"w3", hpyp.START_WORD, b"never"):       # a context, two that are none, the start
        assert abs(sum(p(u, w) for w in count) + p(u, b"an unknown word") - 1) < 1e-9


def test_packed_arrays_come_back():
    rnd = np.random.default_rng(4)
    arrays = {"a": np.array([], np.int64), "b": np.sort(rnd.integers(-(1 << 63), (1 << 63) - 1, 1000)), "c": np.arange(70_000, dtype=np.int32)[::-1].copy(),
              "d": rnd.random(17).astype(np.float32), "e": np.array([-(1 << 63), (1 << 63) - 1, 0]), "f": np.array([1], np.int8), "g": rnd.random(3)}
    got = hpyp.unpack(hpyp.pack(arrays))
    assert list(got) == list(arrays) and all(got[k].dtype == v.dtype and (got[k] == v).all() for k, v in arrays.items())


def test_pitman_yor_sums_to_one():
    rnd = np.random.default_rng(0)
    words = np.sort(rnd.integers(-(1 << 62), 1 << 62, 300))
    table = rnd.poisson(0.02, (300, hpyp.CONTEXTS)) + (rnd.random((300, hpyp.CONTEXTS)) < 0.01) * 40
    of, ctx = np.nonzero(table)
    history = []
    for _ in range(4):
        for r in hpyp._seated(words, np.bincount(of, minlength=300), ctx, table[of, ctx], history):
            pass
        history.append(r.totals())
    t = hpyp.Totals(history[-1])
    seen = np.unique(of)
    for c in (0, 97, hpyp.START):
        p = r.probability(t, np.arange(300), np.full(300, c))
        unseen = p[np.setdiff1d(np.arange(300), seen)]
        # an unknown word has the probability of a word never seated
        empty = (t.open2[c] / (hpyp.STRENGTH[2] + t.c2[c])) * (t.open1[hpyp.CLASS[c]] / (hpyp.STRENGTH[1] + t.c1[hpyp.CLASS[c]])) * (
            t.open0 * t.uniform / (hpyp.STRENGTH[0] + t.c0))
        assert np.allclose(unseen, empty)
        assert abs(p[seen].sum() + empty - 1) < 1e-9


def test_seating_matches_the_chinese_restaurant():
    """Mean number of tables against a plain simulation."""
    n, base, d = 200, 3.0, 0.5
    keys = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mine = hpyp.seat(np.full(4000, float(n)), np.full(4000, base), d, hpyp._mix(keys)).mean()
    rnd, tables = np.random.default_rng(1), np.ones(4000)
    for i in range(1, n):
        tables += rnd.random(4000) < base / (i - d * tables + base)
    assert abs(mine - tables.mean()) < 0.05 * tables.mean()


@pytest.mark.parametrize("base, d", [(0.3, 0.8), (3.0, 0.8), (50.0, 0.6)])
def test_seating_in_steps_is_close_to_one_by_one(monkeypatch, base, d):
    """The steps beyond EXACT customers change the mean number of tables by under 1 %, its spread by under 15 %."""
    keys = hpyp._mix(np.arange(3000, dtype=np.uint64))
    steps = hpyp.seat(np.full(3000, 1500.0), np.full(3000, base), d, keys)
    monkeypatch.setattr(hpyp, "EXACT", 1 << 40)
    single = hpyp.seat(np.full(3000, 1500.0), np.full(3000, base), d, keys)
    print(f"base {base}, discount {d}: means {steps.mean():.3f} {single.mean():.3f}, deviations {steps.std():.3f} {single.std():.3f}")
    assert abs(steps.mean() / single.mean() - 1) < 0.01 and abs(steps.std() / single.std() - 1) < 0.15


# -- 9 ----------------------------------------------------------------------------------

def greedy(word, names, longest):
    i = n = 0
    while i < len(word):
        for e in range(min(len(word), i + longest), i, -1):
            if word[i:e] in names:
                n, i = n + 1, e
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_automaton_matches_greedy():
    rnd = random.Random(3)
    for _ in range(200):
        names = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 14))}
        a = wordpiece.Automaton(names)
        for _ in range(30):
            w = "".join(rnd.choice("abcéx") for _ in range(rnd.randint(0, 14)))
            assert a.count(w) == greedy(w, names, 6)


def test_token_counts(spark, odd_docs, no_docs):
    names = pieces.load().ids
    for docs in (odd_docs, documents(spark)):
        want = []
        for r in docs.collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            once = Counter(words)
            want.append((r["doc_id"], len(words), sum(c * greedy("▁" + w, names, 16) for w, c in once.items())))
        assert rows_of(wordpiece.token_counts(docs), "doc_id", "n_words", "n_tokens") == sorted(want, key=repr)
    assert wordpiece.token_counts(no_docs).count() == 0


# -- 10 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("capacity", [exact.CAPACITY, 2])
def test_exact_groups_match_brute_force(spark, odd_docs, capacity):
    for docs in (odd_docs, documents(spark)):
        by = defaultdict(list)
        for r in docs.collect():
            by[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
        want = []
        for norm, rows in by.items():
            rows.sort(key=lambda x: x[:3])
            want += [(x[3], rows[0][3], len(rows), i == 0, hashlib.sha256(norm.encode()).hexdigest()) for i, x in enumerate(rows)]
        got = exact.exact_groups(docs, capacity=capacity)
        assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
        assert capacity > 2 or got.select("bucket").distinct().count() > 3


def test_exact_drop_keeps_one(odd_docs, no_docs):
    kept = exact.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", r["text"] or "") for r in odd_docs.collect()})
    assert exact.drop_exact_duplicates(no_docs).count() == 0 and exact.exact_groups(no_docs).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    index = spark.range(3000).selectExpr("xxhash64(id) as key", "cast(id as string) as sha").unionAll(
        spark.range(50).selectExpr("5L as key", "concat('x', id) as sha"))
    depth, leaves = exact.build_directory(index, 20)
    sizes = exact.with_bucket(index, (depth, leaves)).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 3050
    assert sorted(r["count"] for r in sizes)[-2] <= 20 and max(r["count"] for r in sizes) >= 50
    assert sum(2.0 ** -d for _, d in leaves) == 1.0


# -- queries ----------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    ok, msg = compare_frames(QUERIES[name](spark, SF).toPandas(), run_oracle(duckdb_connection(SF), ORACLES[name]))
    assert ok, msg


def test_chat_query_has_the_planted_conversation(spark):
    r = QUERIES["op3_chat_formatting"](spark, SF).filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P

    from flowsmith.llm.common import materialize
    docs = documents(spark)
    good = materialize(P.quality(spark, docs, SF))
    assert good.columns == docs.columns and good.join(docs, "doc_id", "left_anti").count() == 0
    once = materialize(P.exact_dedup(spark, good, SF))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in good.collect():
        k = (-len(r["text"] or ""), r["doc_id"])
        best[norm(r["text"])] = min(best.get(norm(r["text"]), k), k)
    assert {r["doc_id"] for r in once.collect()} == {k[1] for k in best.values()}
    near = materialize(P.near_dedup(spark, once, SF))
    rows = once.collect()
    roots = brute_components([r["doc_id"] for r in rows], [brute_fingerprint(r["text"]) for r in rows])
    assert {r["doc_id"] for r in near.collect()} == set(roots)
    mixed = materialize(P.mix_sources(spark, near, SF))
    assert mixed.columns == docs.columns
    encoded = P.encode(spark, mixed, SF).collect()
    sp, texts = library(), {r["doc_id"]: r["text"] for r in near.collect()}
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed.collect())
    assert all(list(r["token_ids"]) == sp.encode(texts[r["doc_id"]]) for r in encoded)


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as P
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in P.STAGES:
            now = stage(spark, now, SF)
            assert name == "encode" or now.columns == docs.columns
            now.count()
