"""Phrases (collocations) of 2 to ``WORDS`` words by top-order marginalisation.

A text is cut into pieces at punctuation and into words.  Each word position gives one row with lead columns w1 to w5, the words
that follow within the piece, padded with NULL: the longest window only.  Windows are counted, then one ROLLUP over the
columns sums the counts of successively shorter prefixes, so no n-gram of any length is exploded.  A candidate is held against its
cuts (first k words, rest) by exact decimal arithmetic.

Words are hashed to 64 bits by numpy; that no two words share a hash is checked over the whole vocabulary, and another seed is taken
if two do.  Two filters of a fixed size keep rows out of the shuffle that no frequent phrase can contain, so results do not change: a bitmap of the
hash slots of frequent words, and one of pair slots whose summed count reaches the least frequency (a slot counts at least
as much as each of its pairs).  The pair slots grow with the number of words, about one for ``SLOT_WORDS`` of them up to ``MOST_PAIR_SLOTS``, so
that rare pairs do not fill slots together.  A window ends where either fails.

Scale: three maps over the texts; shuffles of the vocabulary per block, of the one-byte pair counters that each task used (added up in groups of 256
tasks, over again until one is left) and of windows.  A language or a word with a third of all rows is combined in the map before
each shuffle; joins on words rely on AQE's splitting.  The best ``top`` are cut per language before any task holds a language.

NULL texts count as empty and give no words; a NULL language is ``und``; repeated rows count again; empty tables give no row; ids
and other columns are ignored.  Ties rank by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

WORDS = 5
LEAST = 100                  # occurrences of a candidate
TOP = 2000
BLOCK_BYTES = 1 << 22
WORD_SLOTS, PAIR_SLOTS, MOST_PAIR_SLOTS = 1 << 23, 1 << 22, 1 << 26
SLOT_WORDS = 8
CHUNK = 1 << 16              # pair slots in one row
FOLD = 256                   # rows of counters that one task adds up

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of some texts: hash, begin and size in ``data``, joined (the next word follows in the same piece)."""

    def __init__(self, texts: list[str], seed: int):
        self.data = ("\n".join(texts) + "\n").encode("utf-8", "replace").translate(_LOWER)
        byte = np.frombuffer(self.data + b"\n" * 8, np.uint8)
        kind = _CLASS[byte]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False))
        self.begin, self.size = edge[0::2], edge[1::2] - edge[0::2]
        piece = np.cumsum(kind == 2)[self.begin]
        self.joined = np.zeros(len(self.begin), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]
        eight = np.ndarray(len(byte) - 7, "<u8", byte, strides=(1,))       # the eight bytes from each position on
        self.hash = _mixed(self.size.astype(np.uint64) + np.uint64(seed << 32))
        rest = np.arange(len(self.begin))
        for done in range(0, int(self.size.max(initial=0)), 8):
            rest = rest[self.size[rest] > done]
            part = eight[self.begin[rest] + done] & _KEEP[np.minimum(self.size[rest] - done, 8)]
            self.hash[rest] = _mixed(self.hash[rest] ^ part)

    def text(self, k: int) -> str:
        return self.data[self.begin[k]:self.begin[k] + self.size[k]].decode("utf-8", "replace")


def _blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, Words]]:
    """(language, words) of documents of one language, up to about BLOCK_BYTES characters at a time."""
    held: dict[str, tuple[list, list]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts, size = held.setdefault(lang, ([], [0]))
            texts.append(text)
            size[0] += len(text)
            if size[0] >= BLOCK_BYTES:
                yield lang, Words(held.pop(lang)[0], seed)
            elif len(held) > 64:                                          # many languages: the fullest goes
                most = max(held, key=lambda k: held[k][1][0])
                yield most, Words(held.pop(most)[0], seed)
    for lang, (texts, _) in held.items():
        yield lang, Words(texts, seed)


def _lang_seed(lang: str) -> np.uint64:
    import zlib

    return np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _word_slot(lang: str, h: np.ndarray) -> np.ndarray:
    return (_mixed(h ^ _lang_seed(lang)) % np.uint64(WORD_SLOTS)).astype(np.int64)


def _pair_slot(lang: str, a: np.ndarray, b: np.ndarray, slots: int) -> np.ndarray:
    return (_mixed(_mixed(a ^ _lang_seed(lang)) + b) % np.uint64(slots)).astype(np.int64)


def pair_slots(words: int) -> int:
    """Slots for the pairs of a corpus of so many words, a power of two."""
    return min(max(PAIR_SLOTS, 1 << max(0, -(-words // SLOT_WORDS) - 1).bit_length()), MOST_PAIR_SLOTS)


def _bits(slots) -> np.ndarray:
    return np.unpackbits(np.frombuffer(slots, np.uint8)).view(bool)


def _are_set(bitmap, slots: np.ndarray) -> np.ndarray:
    """Which slots are set in a bitmap."""
    return (np.frombuffer(bitmap, np.uint8)[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def _short(counters: np.ndarray) -> bytes:
    """The counters of a chunk, or, where that is shorter, the places and values of those that are not 0."""
    at = np.flatnonzero(counters)
    return counters.tobytes() if 3 * len(at) >= len(counters) else at.astype("<u2").tobytes() + counters[at].tobytes()


def _long(raw: bytes, chunk: int) -> np.ndarray:
    if len(raw) == chunk:
        return np.frombuffer(raw, np.uint8)
    n, out = len(raw) // 3, np.zeros(chunk, np.uint8)
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, np.uint8, n, 2 * n)
    return out


def vocabulary(rows: DataFrame, seed: int) -> DataFrame:
    """lang, h, word, n of every word."""
    def run(batches):
        for lang, w in _blocks(batches, seed):
            h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(list(map(w.text, first.tolist())), pa.string()),
                 pa.array(n.astype(np.int64))], names=["lang", "h", "word", "n"])

    return rows.mapInArrow(run, "lang string, h bigint, word string, n bigint").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))


def _checked_vocabulary(rows: DataFrame) -> tuple[DataFrame, int]:
    """The vocabulary and a seed under which no two words share a hash."""
    for seed in range(1, 9):
        words = materialize(vocabulary(rows, seed))
        if words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter("a != b").isEmpty():
            return words, seed
    raise RuntimeError("two words share a hash under every seed")


def _word_filter(words: DataFrame, least: int) -> bytes:
    """Bitmap of the slots of words with at least ``least`` occurrences; its size is fixed."""
    def run(batches):
        bits = np.zeros(WORD_SLOTS, bool)
        for b in batches:
            for lang, h in b.to_pandas().groupby("lang")["h"]:
                bits[_word_slot(lang, h.to_numpy().view(np.uint64))] = True
        for k in range(0, WORD_SLOTS, CHUNK):
            if bits[k:k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([np.packbits(bits[k:k + CHUNK]).tobytes()])],
                                                 names=["chunk", "bits"])

    found = words.filter(F.col("n") >= least).select("lang", "h").mapInArrow(run, "chunk int, bits binary")
    return _folded(found, lambda a, b: a | b, lambda total: total, WORD_SLOTS // 8, CHUNK // 8)


def _pair_filter(rows: DataFrame, seed: int, least: int, frequent, slots: int) -> bytes:
    """Bitmap of the pair ``slots`` that count at least ``least`` pairs of frequent words (counters stop at ``full``)."""
    full = min(least, 255)

    def run(batches):
        from_words = _bits(frequent.value)
        count = np.zeros(slots, np.uint8)
        for lang, w in _blocks(batches, seed):
            ok = from_words[_word_slot(lang, w.hash)]
            at = np.flatnonzero(w.joined[:-1] & ok[:-1] & ok[1:])
            slot, n = np.unique(_pair_slot(lang, w.hash[at], w.hash[at + 1], slots), return_counts=True)
            count[slot] = np.minimum(count[slot] + n, full)
        for k in range(0, slots, CHUNK):
            if count[k:k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK], pa.int32()), pa.array([_short(count[k:k + CHUNK])])],
                                                 names=["chunk", "bits"])

    found = rows.mapInArrow(run, "chunk int, bits binary")
    return _folded(found, lambda a, b: np.minimum(a.astype(np.uint16) + b, full).astype(np.uint8), lambda total: np.packbits(total >= full),
                   slots // 8, CHUNK)


def _folded(rows: DataFrame, add, finish, size: int, chunk: int) -> bytes:
    """The rows (chunk, bits) that each task made added up, at most FOLD tasks' rows of a chunk at once, then what ``finish`` makes of each chunk
    as ``size`` bytes."""
    def summed(table: pa.Table) -> np.ndarray:
        total = np.zeros(chunk, np.uint8)
        for raw in table.column("bits"):
            total = add(total, _long(raw.as_py(), chunk))
        return total

    def run(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(2, "bits", pa.array([_short(summed(table))]))

    def last(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).select(["chunk"]).append_column("bits", pa.array([finish(summed(table)).tobytes()]))

    rows = materialize(rows.select("chunk", F.spark_partition_id().alias("part"), "bits"))
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FOLD:
        parts = -(-parts // FOLD)
        rows = materialize(rows.withColumn("part", F.expr(f"cast(pmod(part, {parts}) as int)"))
                           .groupBy("chunk", "part").applyInArrow(run, "chunk int, part int, bits binary"))
    out = bytearray(size)
    for r in rows.groupBy("chunk").applyInArrow(last, "chunk int, bits binary").collect():      # some KB for each chunk
        at = r["chunk"] * len(r["bits"])
        out[at:at + len(r["bits"])] = r["bits"]
    return bytes(out)


def windows(rows: DataFrame, seed: int, words: int, frequent, pairs, slots: int) -> DataFrame:
    """lang, w1 to w5: for each position whose pair passes the filters the words from there to the end of the piece or filter."""
    names = [f"w{k}" for k in range(1, words + 1)]

    def run(batches):
        word_bits = _bits(frequent.value)
        for lang, w in _blocks(batches, seed):
            ok = word_bits[_word_slot(lang, w.hash)]
            on = np.zeros(len(ok) + words, bool)                          # the next word goes on the window
            on[:len(ok) - 1] = w.joined[:-1] & ok[:-1] & ok[1:]
            at = np.flatnonzero(on)
            on[at] = _are_set(pairs.value, _pair_slot(lang, w.hash[at], w.hash[at + 1], slots))
            at = np.flatnonzero(on)
            if not len(at):
                continue
            signed = np.concatenate([w.hash, np.zeros(words, np.uint64)]).view(np.int64)
            cols, live = [pa.array(signed[at])], np.ones(len(at), bool)
            for k in range(1, words):
                live = live & on[at + k - 1]
                cols.append(pa.array(signed[at + k], mask=~live))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *cols], names=["lang", *names])

    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{n} bigint" for n in names))


def count_phrases(seen: DataFrame, words: int, least: int) -> DataFrame:
    """lang, key (hashes of the words), a: phrases of at least two words with ``least`` occurrences, from the windows."""
    names = [f"w{k}" for k in range(1, words + 1)]
    counted = seen.groupBy("lang", *names).agg(F.count(F.lit(1)).alias("c"))
    sums = counted.rollup("lang", *names).agg(F.sum("c").alias("a"), F.grouping_id().alias("level"))
    last = F.lit(False)
    for k in range(2, words + 1):                          # the columns after w_k are summed up, and the window reaches w_k
        last = last | ((F.col("level") == (1 << (words - k)) - 1) & F.col(f"w{k}").isNotNull())
    return sums.filter(last & (F.col("a") >= least)).select(
        "lang", F.filter(F.array(*names), lambda x: x.isNotNull()).alias("key"), "a")


def score_cuts(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, key, a, l, r, n, score by the lowest-scoring cut, ties to the shortest first part."""
    parts = phrases.unionByName(vocabulary.select("lang", F.array("h").alias("key"), F.col("n").alias("a")))
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    cuts = (phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("key") - 1)))
            .withColumn("first", F.slice("key", F.lit(1), F.col("cut")))
            .withColumn("rest", F.slice("key", F.col("cut") + 1, F.size("key"))))
    cuts = (cuts.join(parts.select("lang", F.col("key").alias("first"), F.col("a").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("key").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(total, "lang"))
    exact = "cast({} as decimal(38, 0))"
    score = F.expr(f"({exact.format('1000')} * {exact.format('a')} * {exact.format('n')}) div ({exact.format('l')} * {exact.format('r')})")
    best = cuts.groupBy("lang", "key", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "key", "a", "n", "best.l", "best.r", "best.score")


def drop_contained(scored: DataFrame, phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Without the phrases that a longer one with at least ``percent`` % of their occurrences contains."""
    longer = phrases.filter(F.size("key") > 2).select(
        "lang", "a", "key", F.explode(F.sequence(F.lit(2), F.size("key") - 1)).alias("size"))
    longer = longer.select("lang", "a", "key", "size", F.explode(F.sequence(F.lit(1), F.size("key") - F.col("size") + 1)).alias("at"))
    inside = longer.groupBy("lang", F.slice("key", F.col("at"), F.col("size")).alias("key")).agg(F.max("a").alias("over"))
    return (scored.join(inside, ["lang", "key"], "left")
            .filter(F.col("over").isNull() | (100 * F.col("over").cast("decimal(38,0)") < percent * F.col("a").cast("decimal(38,0)"))).drop("over"))


def mine_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    vocab, seed = _checked_vocabulary(rows)
    frequent = sc.broadcast(_word_filter(vocab, least))
    slots = pair_slots(vocab.agg(F.sum("n")).first()[0] or 0)
    pairs = sc.broadcast(_pair_filter(rows, seed, least, frequent, slots))
    phrases = materialize(count_phrases(windows(rows, seed, words, frequent, pairs, slots), words, least))
    scored = drop_contained(score_cuts(phrases, vocab), phrases)

    def ranked(df, rank, *more):
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), *more)
        return df.withColumn("rank", rank().over(order)).filter(F.col("rank") <= top)

    best = materialize(ranked(scored, F.rank))             # with all that tie for the last place
    spelled = (best.select("lang", "key", F.posexplode("key").alias("at", "h")).join(vocab.select("lang", "h", "word"), ["lang", "h"])
               .groupBy("lang", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
                                           .alias("phrase")))
    named = best.drop("rank").join(spelled, ["lang", "key"])
    return ranked(named, F.row_number, F.asc("phrase")).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
