"""Language ID by cross-parsing entropy.

For each language, a suffix automaton of a sample of its labelled text gives the longest match from any point of a
document. A document is parsed greedily into phrases that occur in the sample; the language that needs the fewest
phrases, normalised by the bits that name one, wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, held, release, table

#: Bound of the training sample: so many documents and folded characters per language, chosen by hash over all rows.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 20_000
#: Texts are parsed in lanes of so many characters side by side, then corrected where a phrase goes on from one lane into
#: the next; so the parse is that of whole texts. At most CHUNK characters are held at once, longer texts in turns.
LANE, CHUNK = 512, 1_000_000
#: Symbols: no letter, and a letter that is in no sample, so in none of them can it continue or begin a match.
BREAK, UNSEEN = 0, 1
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """The folded samples by language; workers build the automata from them once."""

    samples: tuple[tuple[str, str], ...]

    @property
    def languages(self) -> list[str]:
        return [lang for lang, _ in self.samples]


def train(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from the rows where `labelled` holds and id, text and language are not null.

    All rows compete for the sample by a hash of the id: the smallest SAMPLE_DOCS of each of 256 parts of a language, then
    of 16 parts, then of the language; so the last step has at most 16 times SAMPLE_DOCS rows of a language. No labelled rows give a model without languages. Rows repeated
    or with equal ids count as often as they come, up to the bound; of each text at most SAMPLE_CHARS characters are
    learned from. A language takes about 1 MB in the driver and each worker, so labels should be languages.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), labelled.alias("ok"))
    docs = docs.filter("ok and id is not null and lang is not null and text is not null").withColumn("r", F.xxhash64("id"))
    rows = docs.select("id", "lang", "r")
    for parts in (256, 16, 1):
        nth = F.row_number().over(Window.partitionBy("lang", F.pmod("r", F.lit(parts))).orderBy("r", "id"))
        rows = rows.withColumn("k", nth).filter(F.col("k") <= SAMPLE_DOCS)
    chosen = rows.select("id", "lang").distinct()  # SAMPLE_DOCS rows a language
    texts = docs.join(F.broadcast(chosen), ["id", "lang"]).withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).select("lang", "r", "text").distinct()
    got: dict[str, list[tuple[int, str]]] = {}
    for lang, r, text in texts.collect():
        got.setdefault(lang, []).append((r, text))
    share = {lang: max(1, SAMPLE_CHARS // len(x)) for lang, x in got.items()}
    samples = []
    for lang in sorted(got):
        chosen, left = sorted(set(got[lang])), SAMPLE_CHARS
        out = [t[: share[lang]] for _, t in chosen]
        left -= sum(map(len, out))
        for _, t in chosen:  # short documents leave room for more of the long ones
            out.append(t[share[lang] : share[lang] + max(0, left)])
            left -= len(out[-1])
        samples.append((lang, " ".join(out)))
    return LanguageModel(tuple(samples))


def _automaton(codes: list[int]) -> list[dict[int, int]]:
    """Edges of the suffix automaton by state; the root is 0."""
    link, length, nxt, last = [-1], [0], [{}], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class _Lanes:
    """Texts that follow each other in `codes`, cut into lanes of LANE symbols: one column a lane, the longest first."""

    ENTRY, NONE = -2, -1

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        count = (sizes + LANE - 1) // LANE
        owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[owner] + nth * LANE
        long = np.minimum(LANE, np.cumsum(sizes)[owner] - start)
        order = np.argsort(-long, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(nth > 0, np.concatenate([[self.NONE], place[:-1]]), self.NONE)
        before[0] = self.ENTRY
        after = np.where(np.concatenate([nth[1:] > 0, [False]]), np.concatenate([place[1:], [self.NONE]]), self.NONE)
        self.owner, self.long, self.before, self.after = owner[order], long[order], before[order], after[order]
        self.texts, self.last, rows = len(sizes), int(place[-1]), int(long.max())
        self.alive = (len(order) - np.searchsorted(self.long[::-1], np.arange(rows), side="right")).tolist()
        self.codes = np.zeros((rows, len(order)), np.int32)
        for j, n in enumerate(self.alive):
            self.codes[j, :n] = codes.take(start[order[:n]] + j)


class _Machine:
    """An automaton in two flat arrays, for an alphabet of any size: the edge of a state by a symbol lies at the state's
    base plus the symbol, with the state's number beside the target to tell whose it is. Without an edge a phrase ends,
    and the symbol begins the next one."""

    def __init__(self, edges: list[dict[int, int]], symbols: int):
        self.first = np.full(symbols, 1, np.int64)  # (state << 1) | 1: a phrase begins
        for c, to in edges[0].items():
            self.first[c] = to << 1 | 1
        total = sum(map(len, edges[1:]))
        size = 1 << max(10, (2 * total).bit_length())
        self.mask, self.table, self.base = size - 1, np.full(size, -1, np.int64), np.zeros(len(edges), np.int64)
        random, one = np.random.default_rng(5), []
        for state in sorted(range(1, len(edges)), key=lambda s: -len(edges[s])):
            if len(edges[state]) < 2:
                one += [state] * len(edges[state])
                continue
            c = np.fromiter(edges[state], np.int64)
            while True:  # at most half full, the states with most edges first
                at = (int(random.integers(size)) + c) & self.mask
                if (self.table[at] < 0).all():
                    break
            self._put(state, at, c, np.fromiter(edges[state].values(), np.int64))
        free = np.flatnonzero(self.table < 0)[: len(one)]
        states = np.array(one, np.int64)
        pairs = np.array([next(iter(edges[s].items())) for s in one], np.int64).reshape(-1, 2)
        self._put(states, free, pairs[:, 0], pairs[:, 1])

    def _put(self, state, at, c, to) -> None:
        self.table[at] = state << 32 | to << 1
        self.base[state] = (at - c)[0] & self.mask if np.isscalar(state) else (at - c) & self.mask

    def step(self, states: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(next state << 1) | 1 if a phrase begins with this symbol."""
        found = self.table.take((self.base.take(states) + c) & self.mask)
        return np.where(found >> 32 == states, found & 0xFFFFFFFF, self.first.take(c))

    def parse(self, lanes: _Lanes, entry: int) -> tuple[np.ndarray, int]:
        """Phrases that begin in each text, and the last state. The first text is entered in state `entry`, the others at
        the root."""
        states = np.where(lanes.before == _Lanes.ENTRY, entry, 0)
        seen = np.zeros(lanes.codes.shape, np.int32)
        for j, n in enumerate(lanes.alive):
            seen[j, :n] = to = self.step(states[:n], lanes.codes[j, :n])
            states = to >> 1
        # a lane goes on from where the one before it ends, until it is in the state that was found from the root
        todo = np.flatnonzero(lanes.before >= 0)
        while len(todo):
            last = lanes.before[todo]
            now, j, moved = seen[lanes.long[last] - 1, last] >> 1, 0, []
            left, now = todo[now > 0], now[now > 0]  # else the root was right
            while len(left):
                to = self.step(now, lanes.codes[j, left])
                same = to >> 1 == seen[j, left] >> 1
                seen[j, left] = to
                j += 1
                ends = ~same & (j >= lanes.long[left])
                moved.append(lanes.after[left[ends]])
                left, now = left[~same & ~ends], (to >> 1)[~same & ~ends]
            todo = np.concatenate(moved) if moved else np.zeros(0, np.int64)
            todo = todo[todo >= 0]
        return np.bincount(lanes.owner, weights=(seen & 1).sum(0), minlength=lanes.texts), int(seen[lanes.long[lanes.last] - 1, lanes.last] >> 1)


class Parser:
    """The automata of a model, and the table from code points to symbols."""

    def __init__(self, model: LanguageModel):
        found = sorted({ch.lower()[:1] for _, text in model.samples for ch in set(text) if ch.isalpha()})
        own = {ch: i + 2 for i, ch in enumerate(found)}
        self.symbol = np.zeros(0x110000, np.int32)
        for cp in range(0x110000):
            if unicodedata.category(chr(cp))[0] == "L":
                self.symbol[cp] = own.get(chr(cp).lower()[:1], UNSEEN)
        self.machines, self.scale = [], []
        for _, text in model.samples:
            codes = self.codes(text).tolist()
            self.machines.append(_Machine(_automaton(codes), len(own) + 2))
            # a phrase names a place in the sample or one of all letters, so a tiny sample doesn't make phrases cheap
            self.scale.append(np.log2(max(len(codes), len(own)) + 2))

    def codes(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases by text and language, and whether a text has a letter."""
        out, lettered = np.zeros((len(texts), len(self.machines))), np.zeros(len(texts), bool)
        entry = [0] * len(self.machines)
        for goes_on, run in _runs(texts):
            codes = self.codes("".join(part for _, part in run))
            owner, sizes = np.array([i for i, _ in run]), np.array([len(part) for _, part in run], np.int64)
            letters = np.concatenate([[0], np.cumsum(codes != BREAK)])
            ends = np.cumsum(sizes)
            np.logical_or.at(lettered, owner, letters[ends] > letters[ends - sizes])
            lanes = _Lanes(codes, sizes)
            for k, m in enumerate(self.machines):
                count, entry[k] = m.parse(lanes, entry[k] if goes_on else 0)
                np.add.at(out[:, k], owner, count)
        return out * np.array(self.scale), lettered


def _runs(texts: list[str]) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """Lists of (text number, part) of at most CHUNK characters, and whether the first part continues the one before."""
    run, held, goes_on = [], 0, False
    for i, t in enumerate(texts):
        while held + len(t) > CHUNK:
            if run and len(t) <= CHUNK:  # the next run holds it whole
                yield goes_on, run
                run, held, goes_on = [], 0, False
                continue
            run.append((i, t[: CHUNK - held]))
            t = t[CHUNK - held :]
            yield goes_on, run
            run, held, goes_on = [], 0, True
        if t:
            run.append((i, t))
            held += len(t)
    if run:
        yield goes_on, run


def _parser(model: LanguageModel) -> Parser:
    return held(model, lambda: Parser(model))


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    whole = [t or "" for t in texts]
    if not model.samples:
        return [UNKNOWN] * len(whole), np.zeros(len(whole))
    cost, lettered = _parser(model).phrases(whole)
    best = cost.argmin(1)  # ties: the first language in code point order
    low = cost[np.arange(len(whole)), best]
    second = np.partition(cost, 1, axis=1)[:, 1] if cost.shape[1] > 1 else low
    score = np.where(lettered & (second > 0), 1 - low / np.maximum(second, 1e-9), 0.0)
    if cost.shape[1] == 1:
        score = np.where(lettered, 1.0, 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of docs, and the predicted language and score (0 to 1; how many fewer phrases than the second best).

    A null text, one without a letter, or a model without languages gives `und` and 0. Ties go to the first language in
    code point order. An input column named as an output is replaced; other columns may have any names. Repeated rows
    are predicted one by one. Whole texts are parsed, CHUNK characters at a time, so that beyond its own characters a
    very long text takes no more memory. One pass over the rows, without a shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # SAMPLE_CHARS characters a language
    keep = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = rows.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, scores, size = [], [], [], 0
            for t in b.column(keep.index(text_col)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= 4_000_000:
                    x, y = predict(shared.value, texts)
                    langs, scores, texts, size = langs + x, [*scores, y], [], 0
            x, y = predict(shared.value, texts)
            scores = np.concatenate([*scores, y])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs + x, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang_out, score_out])
        release()

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that have a language at all (not `und`), with all their columns. Null, empty and letterless texts go;
    null and repeated ids are rows like others. Columns may have any names; no rows give none."""
    lang, score = fresh(docs, "lang_found", "lang_score")
    found = identify(docs, train(docs, ~held_out(id_col), id_col, text_col, lang_col), text_col, lang, score)
    return found.filter(F.col(lang) != UNKNOWN).drop(lang, score)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
