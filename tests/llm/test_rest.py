"""The other operators and the pipeline against plain versions, round trips and held-out rows."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import plain_llm as plain
import pytest
from compare import connect, differences
from tokenizers import Tokenizer

from leadtide.llm import curriculum, decontaminate, language, queries, token_count, token_pack, url_cascade

TOKEN = re.compile(r"[^\W_]+")


def planted():
    rng = random.Random(8)
    texts = {i: " ".join(plain.words(rng, 80)) for i in range(40)}
    items = {k: plain.words(rng, 13 + 7 * k) for k in range(6)} | {6: plain.words(rng, 7), 7: ["a", "few"], 8: None}
    for k in range(6):
        part = items[k][3 * k : 3 * k + 13]
        for replaced in range(4):  # up to two are found, three are not
            w = list(part)
            for p in rng.sample(range(13), replaced):
                w[p] = "zzz"
            texts[50 + 10 * k + replaced] = " ".join([*plain.words(rng, 20), *w, *plain.words(rng, 20)])
    texts[200] = "Before, " + " ".join(items[6]).upper() + "! after"
    texts[201] = " ".join(items[6][:6])
    items[9] = plain.words(rng, 300)
    for k in range(40):  # windows across the edges of blocks, in texts of several blocks
        part = items[9][7 * k : 7 * k + 13 - (k % 8 == 7)]
        texts[300 + k] = " ".join([*plain.words(rng, 45 + 2 * k), *part, *plain.words(rng, k // 8)])
    texts |= {202: None, 203: "", 204: "!!", 205: " ".join(items[0])}
    return texts, {k: v and " ".join(v) for k, v in items.items()}


def test_decontamination_equals_all_windows(spark):
    texts, items = planted()
    rows = [(i, t, None, None, None, 1, 1, 1) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[5], (None, items[0], None, None, None, 1, 1, 1)], plain.DOCS)
    bench = spark.createDataFrame([*items.items(), (0, items[0]), (None, texts[3])], "item_id bigint, text string")
    tokens = {i: TOKEN.findall((t or "").lower()) for i, t in texts.items()}
    item_tokens = {k: TOKEN.findall((t or "").lower()) for k, t in items.items()}
    want = {(i, k) for i, t in tokens.items() for k, x in item_tokens.items() if plain.holds(t, x)}
    got = [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()]
    want |= {(i, None) for i, t in tokens.items() if plain.holds(t, tokens[3])}
    want |= {(None, k) for k, x in item_tokens.items() if plain.holds(item_tokens[0], x)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 20
    shuffled = decontaminate.matches(docs, bench, broadcast_seeds=0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == want and shuffled.count() == len(want)
    bad = {i for i, _ in want}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted([*(i for i in texts if i not in bad), *([rows[5][0]] if rows[5][0] not in bad else [])])
    assert left.filter("doc_id IS NULL").count() == 1
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_masks_meet_every_choice_of_two():
    """Some mask at some place avoids any two replaced tokens."""
    window = range(decontaminate.WINDOW)
    for a in window:
        for b in window:
            assert any(
                not {a, b} & {p + at for p in mask}
                for mask in decontaminate.MASKS
                for at in range(decontaminate.WINDOW - mask[-1])
            ), (a, b)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_check_sql(spark, folder, name):
    con = connect(folder)
    assert differences(queries.QUERIES[name](spark, folder), con, queries.ORACLES[name]) is None


def test_mix_of_odd_rows(spark):
    rows = plain.rows(plain.corpus())
    docs = spark.createDataFrame(rows, plain.DOCS)
    got = curriculum.assign(docs, bucket_rows=16).collect()
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert r["size"] == len(plain.split(r["row"].text))
        assert 0 <= r.copies <= 3 and len(r.positions) == r.copies
        s = by_source.setdefault(r["row"].source, [r.source_size, r.target, 0, 0])
        s[2] += r["size"] * r.copies
        s[3] += r["size"]
    assert sum(s[3] for s in by_source.values()) == pytest.approx(sum(s[1] for s in by_source.values()))
    longest = max(r["size"] for r in got)
    for size, target, taken, own in by_source.values():
        assert size == own and target <= 3 * size and abs(taken - target) <= longest
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in curriculum.assign(docs).collect())
    assert curriculum.mix(docs.limit(0)).count() == 0


def test_bits_round_trip():
    rng = np.random.default_rng(4)
    for width in (1, 3, 8, 13, 16, 17, 32):
        ids = rng.integers(0, 1 << width, 1001).astype(np.uint32)
        packed = token_pack.pack(ids, width)
        assert len(packed) == -(-1001 * width // 8)
        for a, b in ((0, 1001), (0, 0), (7, 8), (500, 777), (1000, 1001)):
            assert np.array_equal(token_pack.unpack(packed, width, a, b), ids[a:b])
    assert token_pack.bit_width(49408) == 16 and token_pack.bit_width(2) == 1


def encoded(texts, end):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts.items()}


def test_tokens_read_back(spark):
    texts = plain.corpus()
    rows = [(i, t, None, None, None, 1, 1, 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows[::-1], plain.DOCS).repartition(5)
    want = encoded(texts, 1)
    got = token_pack.read_documents(spark, token_pack.write(docs, queries.tokenizer_path(), 1)).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    start = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        ids = want[r.doc_id]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc), r
        start += len(ids)
    odd = spark.createDataFrame([rows[0], rows[0], (None, *rows[1][1:])], plain.DOCS)
    assert token_pack.read_documents(spark, token_pack.write(odd, queries.tokenizer_path(), 1)).count() == 3
    assert token_pack.read_documents(spark, token_pack.write(docs.limit(0), queries.tokenizer_path(), 1)).count() == 0


def test_separator_scan(spark):
    rng = np.random.default_rng(6)
    schema = "file int, block int, payload binary"
    ids = {f: rng.integers(0, 5 if f else 40, 200 * f + 37).astype(np.uint16) for f in range(4)}
    ids[4] = np.array([9, 9, 9], np.uint16)
    ids[5] = np.empty(0, np.uint16)
    ids[6] = np.array([1, 2, 3, 4] * 30, np.uint16)  # no separator
    rows, want, base = [], [], 0
    for f, x in ids.items():
        x = np.where(x == 3, 9, x).astype(np.uint16) if f < 4 else x
        cuts = sorted(rng.integers(0, len(x) + 1, 5).tolist())
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)])):
            rows.append((f, k, x[a:b].astype("<u2").tobytes()))
        at = 0
        ends = [*(np.flatnonzero(x == 9) + 1).tolist()]
        if len(x) > (ends[-1] if ends else 0):
            ends.append(len(x))
        for number, e in enumerate(ends):
            want.append((f, number, base + at, e - at, bool(x[e - 1] == 9)))
            at = e
        base += len(x)
    blocks = spark.createDataFrame(rows, schema)
    got = sorted((r.file, r.number, r.start, r.n_tokens, r.ended) for r in token_count.count_tokens(blocks, 9).collect())
    assert got == sorted(want)
    assert token_count.count_tokens(blocks.limit(0), 9).count() == 0


def test_counts_of_written_files(spark):
    texts = plain.corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 1, 1) for i, t in texts.items()], plain.DOCS)
    path = token_count.write_flat(docs, queries.tokenizer_path(), queries.SEPARATOR)
    got = {r.doc_id: r.n_tokens for r in token_count.count_documents(spark, path, queries.SEPARATOR).collect()}
    assert got == {i: len(x) for i, x in encoded(texts, queries.SEPARATOR).items()}


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.NET/en/x?q", "https://a.example.net/en/",
        "http://example.net/en", "http://xexample.net/de/", "http://net/", "http://net", "http://net?x/",
        "ftp://example.com/de/a#b", "http://www.EXAMPLE.com/DE/", "http://w.org/fr/", "http://org/fr/?",
        "http://a://b.net/", "x://net/a" + "/b" * 3000, "http://" + "a." * 60 + "net/",
    ]
    rows = [(i, u, "mine", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([*rows, rows[4], (None, urls[4], None, None)], "page_id bigint, url string, rule string, key int")
    got = url_cascade.judge(pages, queries.URL_RULES)
    assert got.count() == len(rows) + 2
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.sql(queries.ORACLES["op9_url_filter"]).fetchall()
    columns = ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(str(x) for x in r)
    have = [tuple(r[c] for c in columns) for r in got.collect()]
    assert {key(r) for r in have} == {tuple("None" if v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in want if r[0] is not None and r[0] == r[0]} | {key(r) for r in have if r[0] is None}
    assert url_cascade.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_cascade.judge(pages, []).filter("rule IS NULL AND verdict = 'allow'").count() == pages.count()


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("cast(id AS string) AS key")
    listed = universe.filter("crc32(key) % 3 = 0")
    levels = url_cascade.build(listed, universe)
    assert len(levels) > 1
    wrong = universe.selectExpr(f"{url_cascade.member(levels, 'key')} AS inside", "crc32(key) % 3 = 0 AS listed")
    assert wrong.filter("inside != listed").count() == 0


def test_language_of_held_out_rows(spark, folder):
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    rows = queries.op10_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_odd_rows(spark):
    label = "lang string, text string"
    train = spark.createDataFrame(
        [("en", "the cat sat with the other cats then"), ("de", "der schöne Hund und die Katze schlafen nicht"), (None, "x"), ("en", None)], label
    )
    texts = [None, "", "12 !", "the other cat", "die schöne Katze", "the cat then " * 50000 + "und"]
    docs = spark.createDataFrame([(i, t, 7, "mine") for i, t in enumerate(texts)] + [(None, texts[3], 7, "x")] * 2, "doc_id bigint, text string, row int, score string")
    got = language.predict(docs, train)
    assert got.columns == ["doc_id", "text", "row", "lang_pred", "score"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert [found[i] for i in range(3)] == [("und", 0.0)] * 3
    assert [found[i][0] for i in (3, 4, 5, None)] == ["en", "de", "en", "en"]
    assert all(0 <= s <= 1 for _, s in found.values()) and got.count() == 8
    assert {r.lang_pred for r in language.predict(docs, train.limit(0)).collect()} == {"und"}
    assert language.predict(docs.limit(0), train).count() == 0


def test_mixed_texts_hold_both_languages(spark):
    """Halves of two languages share the proportions."""
    names, table = language.train(
        spark.createDataFrame(
            [("en", "the cat sat with the other cats then there " * 20), ("de", "der schöne hund und die katze schlafen nicht " * 20)], "lang string, text string"
        )
    )
    model = np.ascontiguousarray(table.T)
    pi = language.mixtures(["the cat sat with the other cats der hund und die katze schlafen nicht"], model)[0]
    assert names == ["de", "en"] and min(pi) > 0.25 and abs(pi.sum() - 1) < 1e-6
