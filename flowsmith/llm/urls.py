"""URL filter by a weighted vocabulary, with host and path rules before it.

The lower-cased URLs of an Arrow batch lie one after the other in one byte buffer; an Aho-Corasick automaton of all terms
reads it once.  A hit counts where it lies inside one URL and neither neighbour is an ASCII letter or digit (numpy checks all
hits together).  One strict term, or ``soft_limit`` different soft terms, rejects the URL.  A rule (action, host, path) that fits
goes first: it holds for its host and all subdomains where the path starts with the rule's; of several the longest wins.

One map over the table, no shuffle.  Terms and rules are arguments of the caller (at most ``MOST`` entries each), so what the
tasks receive has a fixed bound.  A NULL URL counts as empty: no host, no path, no rule, allowed.  A URL without ``://`` has an empty
host and path, but its terms count.  Repeated rows each give a row, a NULL id is kept, empty tables stay empty, other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The rules of the production query (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The vocabulary of the production query.  One strict term rejects a URL.
STRICT = ("adult", "bukkake", "camgirl", "camgirls", "creampie", "fetish", "gangbang", "hentai", "hookup", "milf", "nsfw", "porn", "porno", "pornos",
          "pornstar", "sexcam", "sexcams", "sexchat", "spam", "warez", "xvideos", "xxx")
# Two different soft terms reject it.
SOFT = ("ad", "ads", "affiliate", "bet", "bets", "betting", "bingo", "bonus", "camera", "cams", "casino", "casinos", "cheap", "click",
        "clickbait", "coupon", "crack", "cracked", "dating", "deals", "download", "erotic", "escort", "escorts", "free", "gamble", "gambling",
        "girls", "hacked", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "nudes", "payday", "pharma", "pharmacy", "pills",
        "poker", "popup", "promo", "replica", "seo", "sex", "sexy", "singles", "slot", "slots", "sponsored", "streaming", "teen",
        "teens", "torrent", "torrents", "track", "tracker", "tracking", "viagra", "wager", "webcam", "win", "winner")
SOFT_LIMIT = 2

MOST = 1_000_000
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_INSIDE = np.zeros(256, bool)                      # bytes that continue a word
_INSIDE[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class UrlJudge:
    """The automaton and the rules, built once per worker."""

    def __init__(self, rules, strict, soft):
        import ahocorasick

        self.terms = sorted({_ascii_lower(t) for t in (*strict, *soft)})
        hard = {_ascii_lower(t) for t in strict}
        self.strict = np.array([t in hard for t in self.terms], bool)
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            raw = t.encode("utf-8").decode("latin-1")          # one character per byte, as the text is read
            self.automaton.add_word(raw, (k, len(raw)))
        if self.terms:
            self.automaton.make_automaton()
        self.rules: dict[str, list] = {}
        for action, host, path in rules:
            self.rules.setdefault(_ascii_lower(host), []).append((path, action, host + path))
        for fits in self.rules.values():
            fits.sort(key=lambda r: (-len(r[0]), r[1] != "block"))

    def hits(self, urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per URL: occurrences of strict terms, different soft terms."""
        n = len(urls)
        none = np.zeros(n, np.int64)
        if not self.terms or not n:
            return none, none.copy()
        raw = [u.encode("utf-8", "surrogatepass").lower() for u in urls]
        start = np.zeros(n + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=start[1:])
        joined = b"".join(raw)
        found = [(end + 1, *value) for end, value in self.automaton.iter(joined.decode("latin-1"))]
        if not found:
            return none, none.copy()
        end, term, size = np.array(found, np.int64).T
        begin = end - size
        at = np.searchsorted(start, begin, side="right") - 1
        byte = np.frombuffer(joined, np.uint8)
        left = (begin == start[at]) | ~_INSIDE[byte[begin - 1]]
        right = (end == start[at + 1]) | ~_INSIDE[byte[np.minimum(end, len(byte) - 1)]]
        whole = (end <= start[at + 1]) & left & right
        at, term = at[whole], term[whole]
        hard = self.strict[term]
        pairs = np.unique(at[~hard] * len(self.terms) + term[~hard])
        return np.bincount(at[hard], minlength=n), np.bincount(pairs // len(self.terms), minlength=n)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits; of equally long ones that of the longer host."""
        best, length = None, -1
        while True:
            for want, action, rule in self.rules.get(host, ()):
                if path.startswith(want):
                    if len(rule) > length:
                        best, length = (action, rule), len(rule)
                    break
            dot = host.find(".")
            if dot < 0:
                return best
            host = host[dot + 1:]


def parts(url: str) -> tuple[str, str]:
    """Host (lower-cased) and path of a URL."""
    m = _PARTS.search(url)
    return (_ascii_lower(m[1]), m[2]) if m else ("", "")


_KEPT: dict = {}


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, n_strict (occurrences), n_soft (different terms)."""
    rules, strict, soft = tuple(map(tuple, rules)), tuple(strict), tuple(soft)
    if max(len(rules), len(strict) + len(soft)) > MOST or not all((*strict, *soft)):
        raise ValueError(f"at most {MOST} rules and terms, and no empty term")
    shared = pages.sparkSession.sparkContext.broadcast((rules, strict, soft))
    rows = pages.select(F.col(id_col).alias("page_id"), whole_text(url_col).alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _KEPT:
            _KEPT.clear()
            _KEPT[shared.value] = UrlJudge(*shared.value)
        judge = _KEPT[shared.value]
        for b in batches:
            urls = b.column(1).to_pylist()
            n_strict, n_soft = judge.hits(urls)
            split = [parts(u) for u in urls]
            ruled = [judge.rule(*s) for s in split]
            own = np.where((n_strict > 0) | (n_soft >= soft_limit), "block", "allow").tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()),
                 pa.array([r and r[1] for r in ruled], pa.string()), pa.array([r[0] if r else o for r, o in zip(ruled, own)], pa.string()),
                 pa.array(n_strict.astype(np.int64)), pa.array(n_soft.astype(np.int64))],
                names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict bigint, n_soft bigint")
