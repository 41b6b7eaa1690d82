"""Near-duplicate stage and links against brute force."""

import corpus_pipeline
from skein.llm import ngram_jaccard

from .test_llm import TEXTS, WORD, LOWER, word_run


def brute_sets(texts, words):
    out = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    return out


def brute_links(texts, words, num, den):
    s = brute_sets(texts, words)
    return {(a, b) for a in s for b in s if a < b and s[a] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])}


def near_texts():
    """Copies of a text of 150 words with 1 to 12 words changed: similarities from below 0.5 to above 0.9."""
    w = word_run(21, 150).split()
    return TEXTS + [(300 + i, " ".join("z%d" % i if k % (150 // (1 + i % 12)) == 70 % (150 // (1 + i % 12)) else x for k, x in enumerate(w))) for i in range(30)]


def kept(texts, links):
    comp = {i: i for i, _ in texts}
    for _ in texts:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i for i in comp if comp[i] == i}


def test_stage_takes_five_words_and_eight_tenths(spark):
    texts = near_texts()
    want = kept(texts, brute_links(texts, 5, 8, 10))
    assert want != kept(texts, brute_links(texts, 3, 9, 10))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()} == want


def test_width_and_threshold_are_parameters(spark):
    texts = near_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for words, num, den in ((1, 7, 10), (5, 8, 10)):
        got = ngram_jaccard.ngram_jaccard(df, words=words, num=num, den=den).collect()
        assert {r["doc_id"] for r in got if r["doc_id"] == r["component_id"]} == kept(texts, brute_links(texts, words, num, den))
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in brute_sets(texts, words).items()}


def test_links_between_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)  # groups of near copies are dealt over several blocks
    w = word_run(31, 300).split()
    texts = near_texts() + [(500 + i, " ".join(w[:i] + [f"z{i}"] + w[i + 1 :])) for i in range(0, 80, 2)]
    texts += [(None, texts[-1][1]), (501, texts[-1][1] + " end"), (1, texts[-1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for words, num, den in ((3, 9, 10), (5, 8, 10)):
        rows, links = ngram_jaccard.ngram_links(df, words=words, num=num, den=den)
        rows, links = rows.collect(), [tuple(r) for r in links.collect()]
        numbered = [(k, t) for k, (_, t) in enumerate(texts)]
        sets, want = brute_sets(numbered, words), brute_links(numbered, words, num, den)
        times = [sum(k in p for p in want) for k, _ in numbered]
        assert sorted((r[0] or 0, r[1], r[3]) for r in rows) == sorted((i or 0, len(sets[k]), times[k]) for k, (i, _) in enumerate(texts))
        assert len(links) == len(set(links)) == len({frozenset((frozenset(sets[a]), frozenset(sets[b]))) for a, b in want if sets[a] != sets[b]})
        assert all(a < b for a, b in links) and {x for p in links for x in p} <= {r["class_id"] for r in rows}
        assert len({r["class_id"] for r in rows}) == len({frozenset(x) for x in sets.values()})
