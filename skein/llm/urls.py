"""URL filters: host and path rules, and gradient-boosted trees on lexical features for all other URLs."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, table
from .trees import Ensemble, boost

_LOWER = {c: c + 32 for c in range(65, 91)}
#: (verdict, host and path): fixed values of the task.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
BLOCK = 0.5
#: Words of the labelled sample: usual in addresses of spam, and of ordinary sites.
BAD_WORDS = ("cheap", "pills", "casino", "bets", "free", "win", "spam", "adult", "ads", "track", "loan", "xxx", "bonus", "slots", "viagra", "farm", "deal", "prize", "click",
             "cash", "poker", "dating", "hot", "crypto", "gift", "login", "verify", "secure", "update", "rx", "replica", "warez", "jackpot", "lottery", "payday", "escort", "forex",
             "torrent", "keygen", "hookup", "giveaway", "roulette", "cams")
GOOD_WORDS = ("garden", "library", "weather", "history", "kitchen", "travel", "science", "school", "music", "river", "museum", "planet", "daily", "market", "health", "forest",
              "news", "city", "university", "journal", "open", "data", "art", "film", "green", "street", "north", "house", "research", "society", "blog", "docs")
#: Suffixes of the sample, and how many times as often ordinary and spam addresses have them.
SUFFIXES = {"com": (8, 6), "net": (3, 3), "org": (4, 1), "edu": (2, 0), "de": (2, 1), "fr": (1, 1), "info": (1, 3), "biz": (0, 3), "top": (0, 2), "xyz": (1, 3), "ru": (1, 2)}
#: Letters at the end of a word of the host whose statistics are kept, besides those of the last label.
ENDING = 4
FEATURES = ("length", "host_length", "path_length", "query_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "hyphens", "parameters",
            "longest_label", "suffix_rate", "ending_rate")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: min((k for k in map(path.find, "?#") if k >= 0), default=len(path))]


class RuleIndex:
    """Rules by host. A URL looks up its host and each parent of it, so the cost doesn't depend on the number of hosts."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append(("/" + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict; of equally long ones the first in code point order."""
        labels, best = host.split("."), None
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = (rule, verdict)
        return best or (None, None)


def _bytes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and where each value starts and ends."""
    ends = np.cumsum([len(v) for v in values], dtype=np.int64) if values else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[end] - total[start]


def _entropy(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(start)), end - start)
    key, n = np.unique(row * 256 + data, return_counts=True)
    share = n / (end - start)[key >> 8]
    return -np.bincount(key >> 8, weights=share * np.log2(share), minlength=len(start))


def _parts(data: np.ndarray, start: np.ndarray, end: np.ndarray, mark: int) -> np.ndarray:
    """Parts that are not empty between marks."""
    inside = data != mark
    first = np.zeros(len(data), bool)
    first[start[end > start]] = True
    return _count(inside & (first | np.concatenate([[True], ~inside[:-1]])[: len(data)]), start, end)


def _endings(host: str) -> set[str]:
    """The last letters of the words of a host, without its last label."""
    return {w[-ENDING:] for w in re.split(r"[^a-z]+", host.rpartition(".")[0]) if len(w) > 1 and w not in ("www", "example")}


class SuffixStatistics:
    """Smoothed shares of bad hosts by last label and by endings of words, from labelled URLs."""

    def __init__(self, sample, weight: float = 4.0):
        self.rates: dict[str, tuple[float, float]] = {}
        self.weight = weight
        for host, bad in sample:
            for key in (f".{host.rpartition('.')[2]}", *_endings(host)):
                k, n = self.rates.get(key, (0.0, 0.0))
                self.rates[key] = (k + bad, n + 1)

    def rate(self, key: str) -> float:
        k, n = self.rates.get(key, (0.0, 0.0))
        return (k + 0.5 * self.weight) / (n + self.weight)

    def of(self, host: str) -> tuple[float, float]:
        """Rates of the last label and of the worst ending; 0.5 is unknown."""
        seen = [r for r in map(self.rate, _endings(host)) if r != 0.5]
        return self.rate(f".{host.rpartition('.')[2]}"), max(seen, default=0.5)


def lexical_rows(urls: list[str], hosts: list[str], paths: list[str], queries: list[str], suffixes: SuffixStatistics) -> np.ndarray:
    """FEATURES of URLs, a row each; characters are counted as UTF-8 bytes."""
    if not urls:
        return np.zeros((0, len(FEATURES)))
    u, h, p, q = (_bytes([x.encode() for x in part]) for part in (urls, hosts, paths, queries))
    size = lambda x: (x[2] - x[1]).astype(float)
    digits = lambda x: _count((x[0] >= 48) & (x[0] <= 57), x[1], x[2]) / np.maximum(size(x), 1)
    known = {host: (max(map(len, host.split("."))), *suffixes.of(host)) for host in set(hosts)}
    longest, rate, ending = (np.array(x, float) for x in zip(*map(known.__getitem__, hosts)))
    return np.stack([size(u), size(h), size(p), size(q), _count(h[0] == 46, h[1], h[2]) + 1.0, _parts(*p, 47), digits(u), digits(h), _entropy(*u), _entropy(*h),
                     _count(h[0] == 45, h[1], h[2]), _parts(*q, 38), longest, rate, ending], 1).astype(float)


def lexical(url: str | None, suffixes: SuffixStatistics) -> list[float]:
    """FEATURES of one URL."""
    return lexical_rows([url or ""], *([x] for x in pieces(url)), suffixes)[0].tolist()


@lru_cache(4)
def labelled_urls(bad_words: tuple[str, ...] = BAD_WORDS, good_words: tuple[str, ...] = GOOD_WORDS, seed: int = 17) -> tuple[tuple[str, int], ...]:
    """The labelled sample (url, 1 if bad), made by rule from a seed and two lists of words. Both kinds have every trait, in other shares: bad
    hosts more often join words by hyphens, have digits or random letters, rarer suffixes, deeper and longer paths and more
    parameters; ordinary hosts have hyphens, digits, invented names and tracking parameters too."""
    r, out = random.Random(seed), []
    suffixes = list(SUFFIXES)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    name = lambda: "".join(r.choice("bdfgjkmpvz") + r.choice("aeiou") + r.choice(("", "", *"bdgkmpvz")) for _ in range(r.randint(2, 4)))
    for _ in range(3000):
        for bad in (0, 1):
            words = [r.choice(bad_words if r.random() < (0.93 if bad else 0.02) else good_words) for _ in range(r.choice((1, 2, 2, 3) if bad else (1, 1, 2)))]
            if r.random() < (0.03 if bad else 0.45):
                words = [name()]
            elif bad and r.random() < 0.15:
                words = [pick(string.ascii_lowercase + string.digits, r.randint(7, 14))]
            label = ("-" if r.random() < (0.7 if bad else 0.35) else "").join(words) + (str(r.randint(1, 999)) if r.random() < (0.25 if bad else 0.05) else "")
            middle = r.choice(("", "example.", "example.", "co.")) if r.random() < 0.5 else ""
            host = r.choice(("", "www.", "blog.", "m.", "shop.")) + label + "." + middle + r.choices(suffixes, [x[bad] for x in SUFFIXES.values()])[0]
            depth = r.choice((0, 1, 2, 2, 2, 3, 4, 6) if bad else (0, 1, 1, 2, 2, 2, 3, 4))
            path = "".join("/" + r.choice((lambda: r.choice(good_words), lambda: r.choice(("en", "de", "fr", "es", "it")), lambda: str(r.randint(1, 60000)),
                           lambda: pick(string.ascii_letters + string.digits, r.randint(8, 24) if bad else r.randint(4, 9))))() for _ in range(depth))
            path += r.choice(("", "", "/", ".html"))
            count = r.choice((0, 0, 1, 2, 4, 6) if bad else (0, 0, 0, 1, 1, 2, 3))
            query = "&".join(f"{r.choice(('page', 'ref', 'id', 'utm_source', 'q', 'aff', 'sid'))}={pick(string.ascii_lowercase + string.digits, r.randint(1, 12 if bad else 6))}" for _ in range(count))
            out.append((f"{r.choice(('http', 'https'))}://{host}{path}{'?' + query if query else ''}{r.choice(('', '', '', '#top'))}", bad))
    return tuple(out)


def pieces(url: str | None) -> tuple[str, str, str]:
    """Host, path and query, as the JVM's URL pattern gives them."""
    m = re.match(URL, url or "")
    return (m[1].translate(_LOWER), m[2], m[3] or "") if m else ("", "", "")


def train(sample=None) -> tuple[Ensemble, SuffixStatistics]:
    """Trees and suffix statistics from labelled URLs (url, 1 if bad). For training, the statistics of a row come from the
    other half of the sample, so that the trees don't trust them more than new hosts deserve."""
    sample = sample or labelled_urls()
    parts = [pieces(u) for u, _ in sample]
    halves = [[(parts[i][0], b) for i, (_, b) in enumerate(sample) if i // 2 % 2 != k] for k in (0, 1)]
    x = np.zeros((len(sample), len(FEATURES)))
    for k, half in enumerate(halves):
        at = [i for i in range(len(sample)) if i // 2 % 2 == k]
        x[at] = lexical_rows([sample[i][0] for i in at], *(list(c) for c in zip(*[parts[i] for i in at])), SuffixStatistics(half))
    return boost(x, np.array([b for _, b in sample]), trees=80, depth=4), SuffixStatistics([(p[0], b) for p, (_, b) in zip(parts, sample)])


def filter_urls(pages: DataFrame, rules=RULES, sample=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id_col, host, path, rule, score, verdict (allow or block).

    The longest rule that fits decides; a rule fits its host and all subdomains if the path starts with the rule's. Else
    the trees decide from lexical features. A null URL, or one without ://, has an empty host and path and no rule. Ids
    are not interpreted: null, repeated ones and repeated rows give a row each. A very long URL is one row's bytes in
    numpy, a few times its length. No rows give none. Other columns are not looked at. One pass, no shuffle.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((*train(sample), RuleIndex(rules)))  # some thousand nodes, endings and rules
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(url, URL, k)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), ascii_lower(part(1)).alias("host"), part(2).alias("path"), part(3).alias("query"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, suffixes, index = shared.value
        for b in batches:
            urls, hosts, paths, queries = (b.column(c).to_pylist() for c in ("url", "host", "path", "query"))
            found = [index.find(h, p) for h, p in zip(hosts, paths)]
            score = trees.scores(lexical_rows(urls, hosts, paths, queries, suffixes))
            verdict = [v or ("block" if s >= BLOCK else "allow") for (_, v), s in zip(found, score)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), pa.array([r for r, _ in found], pa.string()), pa.array(score), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "score", "verdict"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, score double, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
