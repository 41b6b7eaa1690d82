"""Secret scans: candidate strings, and a random forest that removes false positives.

The forest looks at a candidate's length, character transitions and dictionary coverage, at the path it was found under
and at the neighbouring words. Dictionary and transitions come from the corpus that is scanned. The forest learns from
labelled findings; the default ones are made by rule.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, per_text, table
from .trees import Ensemble, forest

#: A run of key characters, of at least 8 if a digit is among them, of at least 20 if it is letters only. A name before
#: `=` is not part of it.
RUN = re.compile(r"(?<![A-Za-z0-9_+/~.@-])(?:(?=[A-Za-z_+/~.-]*[0-9])[A-Za-z0-9_+/~.-]{8,}={0,2}|[A-Za-z]{20,})(?![A-Za-z0-9_@])")
#: What is assigned to a name with a credential word: any 6 characters or more without white space, quotes and separators.
ASSIGNED = re.compile(
    r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer|[_-]key)[a-z0-9_.-]{0,20}[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}([\"'`]?)([^\s\"'`,;<>()]{6,})"
)
#: The password of a user in a URL: what lies between the first colon after `://` and an @ before any slash.
IN_URL = re.compile(r"://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{3,})@")
#: A text without any of these has nothing for ASSIGNED.
HINTS = ("token", "secret", "passw", "pwd", "key", "auth", "credential", "bearer")
#: Neighbouring words: so many on each side, looked for in the nearest SPAN characters; a word that the span cuts is left out.
NEAR, SPAN = 6, 120
#: The corpus's most frequent words make the dictionary and the letter transitions.
DICTIONARY = 20_000
WORD_SIZE = (3, 20)
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
SECRET = 0.5
GOOD_WORDS = frozenset(("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "credential", "credentials", "auth", "authorization", "bearer", "private", "access"))
BAD_WORDS = frozenset(("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "version", "example", "sample", "placeholder", "http", "https", "build", "revision",
                       "hash", "isbn", "order", "invoice", "phone", "card", "etag", "dummy", "fake", "changeme", "docs"))
#: Usual words of code and prose that every dictionary has.
WORDS = ("the", "and", "for", "that", "with", "this", "from", "have", "not", "are", "you", "your", "here", "test", "example", "sample", "value", "name", "file", "path",
         "user", "mail", "com", "net", "org", "www", "http", "index", "page", "version", "release", "build", "data", "table", "string", "number", "config", "default",
         "service", "server", "client", "module", "package", "function", "class", "object", "key", "token", "secret", "change", "place", "holder", "insert", "none", "null",
         "true", "false", "password", "prompt", "input", "environment", "variable", "get", "set", "new", "old", "required", "missing")
FEATURES = ("length", "transitions", "coverage", "entropy", "digit_share", "upper_share", "lower_share", "hex_share", "dots", "dashes", "classes_changed", "longest_letters",
            "known_prefix", "path_depth", "path_test", "near_good", "near_bad", "assigned", "quoted", "digits_only", "distinct_share", "before_at")
#: Published starts of key formats.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "eyJ", "AIza", "glpat-", "SG.", "npm_")
_KIND = np.zeros(256, np.int8)
for _k, _chars in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_HEX = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefABCDEF"])
_LETTERS = re.compile("[A-Za-z]+")


class Lexicon:
    """A dictionary, and the log-probabilities of letter pairs in its words."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(counts) | frozenset(WORDS)
        pairs = np.full((27, 27), 0.2)
        for w in self.words:
            x = np.frombuffer(w.encode(), np.uint8).astype(np.int64) - 97
            if len(x) > 1 and x.min() >= 0 and x.max() < 26:
                np.add.at(pairs, (x[:-1], x[1:]), 1 + np.log1p(counts.get(w, 0)))
        self.steps = np.log(pairs / pairs.sum(1, keepdims=True))
        self.steps[26, :] = self.steps[:, 26] = -6.0  # to and from what is not a letter

    def covered(self, run: str) -> int:
        """Letters of a run that dictionary words cover, longest words first from the left."""
        run, i, out = run.lower(), 0, 0
        while i < len(run):
            for n in range(min(WORD_SIZE[1], len(run) - i), WORD_SIZE[0] - 1, -1):
                if run[i : i + n] in self.words:
                    out, i = out + n, i + n
                    break
            else:
                i += 1
        return out


def lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """The DICTIONARY words of ASCII letters that are most frequent in all texts, ties in order of the alphabet.

    Every task counts its words, HELD_WORDS distinct ones at a time; only counts move, and the driver gets the top.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w.decode(), n) for w, n in seen.items() if WORD_SIZE[0] <= len(w) <= WORD_SIZE[1] and w.isalpha()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        def some(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            for t in texts:
                seen.update((t or "").encode().lower().translate(None, b".,!?;:()").split())
                if len(seen) > HELD_WORDS:
                    yield out()

        yield from per_text(some)(batches)
        yield out()

    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()
    return Lexicon(dict(zip(top["word"].to_pylist(), top["n"].to_pylist())))


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", text).lower())


def neighbours(before: str, after: str) -> list[str]:
    """The NEAR whole words on each side, names being split at capitals and marks."""
    if len(before) >= SPAN:  # what the span cuts is no word
        before = before[-SPAN:].partition(" ")[2]
    if len(after) >= SPAN:
        after = after[:SPAN].rpartition(" ")[0]
    return _words(before)[-NEAR:] + _words(after)[:NEAR]


def describe(value: str, before: str = "", after: str = "", path: str | None = None, lex: Lexicon | None = None) -> list[float]:
    """FEATURES of a candidate; a very long one takes a few numpy arrays of its length."""
    lex, path = lex or _plain(), (path or "").lower()
    x = np.frombuffer(value.encode(), np.uint8)
    kinds, n = _KIND[x], len(x)
    share = np.bincount(kinds, minlength=4) / n
    letter = np.where(kinds >= 2, (x | 32).astype(np.int64) - 97, 26)
    steps = lex.steps[letter[:-1], letter[1:]]
    times = np.unique(x, return_counts=True)[1] / n
    runs = _LETTERS.findall(value)
    near, back = neighbours(before, after), before.rstrip(" \"'`")
    return [n, float(steps.mean()) if n > 1 else 0.0, sum(map(lex.covered, runs)) / n, float(-(times * np.log2(times)).sum()), share[1], share[2], share[3], float(_HEX[x].mean()),
            value.count("."), value.count("-"), float((kinds[1:] != kinds[:-1]).sum()) / n, max(map(len, runs), default=0), value.startswith(PREFIXES), path.count("/"),
            any(w in path for w in ("test", "example", "doc", "fixture")), sum(w in GOOD_WORDS for w in near), sum(w in BAD_WORDS for w in near), back[-1:] in ("=", ":"),
            before[-1:] in ("'", '"'), value.isdigit(), len(times) / n, after[:1] == "@"]


@lru_cache(1)
def _plain() -> Lexicon:
    return Lexicon({})


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) of candidates, in order; where two overlap, a password in a URL goes before an assigned value, and
    that before a run."""
    found = [m.span(1) for m in IN_URL.finditer(text)] if "://" in text else []
    inner, low = list(found), text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGNED.finditer(text):
            a, z = m.span(2)
            if not m[1]:  # not quoted: marks after it belong to the sentence
                z = a + len(m[2].rstrip(".,:!?]}"))
            if z - a >= 6 and not any(a < y and x < z for x, y in inner):
                found.append((a, z))
    taken, k = sorted(found), 0
    for m in RUN.finditer(text):
        a, z = m.start(), m.start() + len(m[0].rstrip("."))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if z - a >= 8 and not (k < len(taken) and taken[k][0] < z):
            found.append((a, z))
    return sorted(found)


@lru_cache(1)
def labelled_findings() -> tuple[tuple[str, str, str, str, int], ...]:
    """The labelled sample (value, before, after, path, 1 if a secret), made by rule from a fixed seed. Values alone don't
    tell the two kinds apart: the same hexadecimal digits are a secret after `token =` and none after `commit`."""
    r, out = random.Random(11), []
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, hexa, key = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + "234567"
    words = lambda n: " ".join(r.choice(WORDS[:52]) for _ in range(n))
    name = lambda: r.choice(("token", "api_key", "apiKey", "secret", "client_secret", "password", "DB_PASSWORD", "auth", "access_key", "private_key", "Authorization: Bearer"))
    assign = lambda: f"{words(r.randint(0, 4))} {name()}{r.choice([' = ', ': ', '=', ':', ' => '])}{r.choice(['', chr(34), chr(39)])}"
    plain = lambda: f"{words(r.randint(1, 5))} {r.choice(['id', 'ref', 'no', 'name', 'file', 'see', 'at', 'x'])}{r.choice([' ', ': ', ' = ', '='])}"
    tail = lambda: r.choice(["", '" ', "' ", "\n", " "]) + words(r.randint(0, 4))
    known = lambda: r.choice(("AKIA" + pick(key, 16), "ASIA" + pick(key, 16), "ghp_" + pick(alnum, 36), "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), "sk_live_" + pick(alnum, 24),
                              "glpat-" + pick(alnum, 20), "AIza" + pick(alnum + "_-", 35), "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40)))
    phrase = lambda: r.choice(WORDS[:52]) + r.choice(["", "_", "-"]) + r.choice(WORDS[:52])
    spoken = lambda n: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "t")) for _ in range(n))
    for _ in range(200):
        path = r.choice(["src0", "src/app/config.py", "deploy/prod.env", "notes", "", "test/data.txt", "docs/a.md"])
        digest = pick(hexa, r.choice([32, 40, 64]))
        note = f"{words(3)} {r.choice(['commit', 'sha1', 'md5', 'checksum', 'digest', 'hash', 'revision', 'etag', 'build'])}{r.choice([' ', ': ', ' = ', '='])}"
        out += [
            (known(), r.choice([words(4) + " ", words(2) + "\n", assign()]), tail(), path, 1),
            (pick(hexa, r.choice([32, 40, 64])), assign(), tail(), path, 1),
            (pick(alnum, r.randint(16, 48)), assign(), tail(), path, 1),
            (pick(alnum + "+/", r.choice([40, 43])) + r.choice(["", "="]), assign(), tail(), path, 1),
            (pick(alnum, r.randint(6, 12)), assign(), tail(), path, 1),
            (pick(string.ascii_letters + "!#%&*@$", r.randint(8, 20)), assign(), tail(), path, 1),
            (r.choice(WORDS[:52]) + pick(string.digits, r.randint(2, 4)) + r.choice(["!", "x", "#", pick(string.ascii_letters, 2)]), f"{words(2)} {r.choice(['password', 'passwd', 'pwd'])}{r.choice([' = ', ': ', '='])}" + r.choice(["", '"']), tail(), path, 1),
            (pick(string.ascii_letters, r.randint(20, 40)), assign(), tail(), path, 1),
            ("".join(r.choice(WORDS[:52]) for _ in range(r.randint(3, 4))), f"{words(r.randint(0, 3))} {r.choice(['password', 'passwd', 'pwd', 'passphrase password', 'DB_PASSWORD'])}{r.choice([' = ', ': ', '='])}{r.choice(['', chr(34)])}", tail(), path, 1),
            (r.choice([pick(alnum + "!$%-_", r.randint(6, 16)), r.choice(WORDS[:52]) + pick(string.digits, 3)]), f"{words(2)} {r.choice(['postgres', 'mysql', 'amqp', 'https', 'redis', 'ftp'])}://{r.choice(['', 'app', r.choice(WORDS[:52])])}:", f"@{r.choice(WORDS[:52])}.{r.choice(['internal', 'example.com', 'local:5432'])}/{r.choice(WORDS[:52])}", path, 1),
            ("".join(r.choice(WORDS[:52]) for _ in range(r.randint(2, 5))), f"{r.choice(['', words(2) + ' '])}{r.choice(['password', 'Password', 'pwd'])}{r.choice([': ', '='])}", tail(), path, 1),
            (spoken(r.randint(3, 7)), assign(), tail(), path, 1),
            (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", words(2) + " at ", f":{r.randint(10, 59)}:{r.randint(10, 59)}.{r.randint(100, 999)}Z {words(1)}", path, 0),
            (f"{r.choice(WORDS)[:3].upper()}-{r.randint(1990, 2030)}-{pick(string.digits, 6)}", r.choice([plain(), words(3) + " "]), tail(), path, 0),
            (f"{r.choice(WORDS)}/{r.choice(WORDS)}{r.randint(1, 9)}/{phrase()}.{r.choice(['md', 'txt', 'py'])}", r.choice(["see ", words(2) + " in ", plain()]), tail(), path, 0),
            (spoken(10) + "ly", r.choice([plain(), words(4) + " "]), tail(), path, 0),
            (f"{r.randint(1000, 9999)}/{phrase()}{r.choice(['', '/', '.html', str(r.randint(1, 99))])}", f"{words(2)} {r.choice(['http', 'https', 'ws'])}://{r.choice(WORDS[:52])}{r.choice(['', '.example.com'])}:", tail(), path, 0),
            (r.choice(["password", "pass", "changeme", "<password>", "xxxx", "secret", "${PASSWORD}", "your_password"]), f"{words(2)} {r.choice(['postgres', 'mysql', 'https', 'ftp'])}://{r.choice(['user', 'name', 'username'])}:", f"@{r.choice(['localhost', 'host', 'example.com'])}/{words(1)}", path, 0),
            (digest, note, tail(), path, 0),
            ("-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), r.choice([words(3) + " uuid ", plain()]), tail(), path, 0),
            (pick(string.digits, r.choice([8, 10, 13, 16, 18])), r.choice([plain(), words(4) + " "]), tail(), path, 0),
            (f"{r.choice(WORDS)}{r.randint(0, 99)}.{r.choice(WORDS)}.example.{r.choice(['com', 'net', 'org'])}", words(3) + " ", tail(), path, 0),
            (f"{phrase()}-{r.randint(1, 99)}-{phrase()}", r.choice([plain(), assign()]), tail(), path, 0),
            (f"{phrase()}{r.choice(['_', ''])}{r.choice(WORDS)}{r.randint(1, 999)}", r.choice([plain(), words(4) + " "]), tail(), path, 0),
            (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", words(3) + " ", tail(), path, 0),
            (f"v{r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}-{r.choice(WORDS)}.{pick(string.digits, 8)}", words(3) + " version ", tail(), path, 0),
            (r.choice(["x" * r.randint(6, 30), "x" * r.randint(8, 20) + pick(string.digits, 4), "*" * r.randint(6, 12), "0" * 16, "changeme", "placeholder", "your_" + phrase(), "${" + phrase().upper() + "}",
                       "<" + phrase() + ">", "none", "required", "optional", "disabled", "your_api_key", "os.environ", "get_" + phrase() + "_value", "insert-your-" + phrase() + "-here"]), assign(), tail(), path, 0),
            (known()[:12] + "EXAMPLE" + pick(key, 4), f"{words(2)} example {name()} = ", " sample placeholder", r.choice(["docs/a.md", "test/example.md"]), 0),
            ("".join(r.choice(WORDS[:52]) for _ in range(r.randint(4, 6))), r.choice([plain(), words(4) + " "]), tail(), path, 0),
        ]
    return tuple(x for x in out if len(x[0]) >= 6 or "://" in x[1])


def train(findings=None, lex: Lexicon | None = None) -> Ensemble:
    """A forest from labelled findings (value, text before, text after, path, 1 if a secret)."""
    rows = findings or labelled_findings()
    return forest(np.array([describe(*x[:4], lex) for x in rows], float), np.array([x[4] for x in rows]))


def scan_secrets(
    docs: DataFrame, model: tuple[Ensemble, Lexicon] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", show: bool = False
) -> DataFrame:
    """One row per candidate: id_col, start (code points from 0), length, value_sha256, score, secret; `value` too if show.

    Candidates are runs of key characters, and whatever is assigned to a name with a credential word; the forest says which
    of them are secrets. Whole texts are searched. A null or empty text has no candidates, a null path is empty; null and
    repeated ids and repeated rows give rows of their own; no rows give none. Very long texts are searched in place; a very
    long candidate is described by a few arrays of its length. Other columns are not looked at. Without a model, one pass
    counts the corpus's words for the dictionary; then one pass without a shuffle. Values are given as SHA-256 so that the
    result isn't itself a leak.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        lex = lexicon(docs, text_col)
        model = train(None, lex), lex
    shared = spark.sparkContext.broadcast(model)  # some thousand nodes and DICTIONARY words
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{path_col}`").cast("string").alias("p")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )

    def find(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        trees, lex = shared.value
        out, x = [], []
        for i, t in zip(ids, texts):
            for a, z in candidates(t or ""):
                x.append(describe(t[a:z], t[max(0, a - SPAN) : a], t[z : z + SPAN], i["p"], lex))
                out.append((i["i"], a, z - a, hashlib.sha256(t[a:z].encode()).hexdigest(), t[a:z]))
        if out:
            score = trees.scores(np.array(x, float))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(score), pa.array(score >= SECRET), pa.array(cols[4])],
                names=[id_col, "start", "length", "value_sha256", "score", "secret", "value"])

    found = rows.mapInArrow(per_text(find), f"`{id_col}` long, start long, length long, value_sha256 string, score double, secret boolean, value string")
    return found if show else found.drop("value")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
