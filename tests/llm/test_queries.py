"""The registered queries over the smallest driver tables: against SQL, or against plain Python over every row."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skein.llm import chat, language_id, mixing, packing, quality, queries, secrets, urls

from .test_llm import LOWER, plain_statistics
from .test_near_copies import brute_links, kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(t)[:-8]} as select * from read_parquet('{t}')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select * from documents").fetchdf()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


def test_op2(spark, docs):
    got = language_id.op2_language_id(spark, SF).toPandas().set_index("doc_id")
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), ~language_id.held_out())
    want, score = language_id.predict(model, [t if isinstance(t, str) else None for t in docs.text])
    assert len(got) == len(docs) and set(want) <= {*model.languages, "und"}
    for i, lang, s in zip(docs.doc_id, want, score):
        assert got.lang_pred[i] == lang and got.score[i] == pytest.approx(s) and got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op3(spark, docs):
    got = packing.op3_packing(spark, SF).toPandas()
    inner = packing.tokenizer(packing.TOKENIZER).inner
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array([*inner.encode(t if isinstance(t, str) else "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == list(mine.ids_crc32)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_op5(spark, docs):
    got = secrets.op5_secret_scan(spark, SF).toPandas()
    want = set()
    for i, t in zip(docs.doc_id, docs.text):
        want |= {(i, a, z - a, hashlib.sha256(t[a:z].encode()).hexdigest()) for a, z in secrets.candidates(t if isinstance(t, str) else "")}
    assert set(zip(got.doc_id, got.start, got.length, got.value_sha256)) == want and len(got) == len(want)
    # what the tables plant: an assigned token is a secret, a bare number is none
    text = dict(zip(docs.doc_id, docs.text))
    for i, a, n, secret in zip(got.doc_id, got.start, got.length, got.secret):
        value, before = text[i][a : a + n], text[i][max(0, a - 12) : a]
        if re.search(r'(?i)token = "$', before) and re.fullmatch("(?i)[0-9a-f]{40}", value):
            assert secret
        if value.isdigit():
            assert not secret


def test_op7(spark, con):
    got = urls.op7_url_filter(spark, SF).toPandas()
    pages = con.execute("select page_id, url from pages").fetchdf()
    model, suffixes = urls.train()
    index = urls.RuleIndex(urls.RULES)
    want = {}
    for i, u in zip(pages.page_id, pages.url):
        host, path = urls.split_url(u)
        rule, verdict = index.find(host, path)
        want[i] = (host, path, rule, verdict or ("block" if model.scores(np.array([urls.lexical(u, suffixes)]))[0] >= 0.5 else "allow"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.itertuples()} == want and len(got) == len(pages)


def test_op8(spark, docs):
    got = quality.op8_quality(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        n, chars, symbols, dup, repeat = plain_statistics(t if isinstance(t, str) else None) if not isinstance(t, str) or len(t) < 20_000 else quality.statistics(t)[:5]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        failed = n < 10 or 100 * repeat > 20 * n
        assert r.base_failed == failed and r.kept == (not failed and not r.bad >= 0.5)


def test_pipeline(spark, con, docs):
    got = corpus_pipeline.run(spark, SF).toPandas()
    texts = {i: t for i, t in zip(docs.doc_id.tolist(), docs.text) if isinstance(t, str) and any(c.isalpha() for c in t)}
    norm = {i: t.translate(LOWER) for i, t in texts.items()}
    single = {max(j for j in norm if norm[j] == t) for t in set(norm.values())}
    one = kept([(i, texts[i]) for i in sorted(single)], brute_links([(i, texts[i]) for i in sorted(single)], 5, 8, 10))
    con.execute("create or replace table chosen as select * from documents where doc_id in (select unnest(?))", [sorted(one)])
    taken = con.execute(mixing.OP10_SQL.replace("FROM documents", "FROM chosen")).fetchdf()
    uses = {int(i): int(round(t / s)) for i, s, t in zip(taken.doc_id, taken["size"], taken.taken) if s}
    assert all(i in uses for i in one)
    inner = packing.tokenizer(packing.TOKENIZER).inner
    want = {i: n * (len(inner.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in uses.items() if n}
    assert got.groupby("doc_id").length.sum().to_dict() == want


def test_chat_of_one_long_conversation(spark):
    """A conversation over many partitions: its spans go on from part to part."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </turn>" * (t % 5)) for t in range(500)] + [(2, 0, "assistant", "x")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
        again = chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    turns = sorted((r for r in formatted if r["conv"] == 1), key=lambda r: r["nth"])
    assert [r["nth"] for r in turns] == list(range(500)) and [r["turn"] for r in turns] == list(range(500))
    assert [r["start"] for r in turns] == [0, *np.cumsum([len(r["ids"]) for r in turns])[:-1]]
    loss = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert next(r["loss_sha256"] for r in again if r["conv"] == 1) == hashlib.sha256(loss.encode()).hexdigest()
