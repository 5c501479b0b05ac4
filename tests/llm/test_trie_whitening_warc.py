"""Prefix trie, whitening and WARC records against plain versions, with odd rows."""

import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from leadtide.llm import prefix_trie, queries, warc, whitening

# ---- prefix trie


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, role, key, text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def total(node):
        size = len(node[-1][1].encode()) if node else 0
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * size
        for child in list(children[node]):
            more = total(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    rows = []
    for node, convs in members.items():
        leaves, saved = total(node)
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        rows.append(
            (min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def conversations(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, n):
        if c % 11 == 3:
            continue
        for k in range(rng.randrange(0, 12)):  # few different turns, so that many are shared
            text = rng.choice(["", "yes", "no", "ünï", None]) if rng.random() < 0.6 else "hello"
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", "user", None, "bot"]), text))
    rows += [(500 + i, k, "user", f"turn {k}") for i in range(40) for k in range(3)]  # copies
    rows += [(700, k, "user", f"turn {k}") for k in range(300)]  # a long one
    rows += [(6000 + 5000 * i, 0, "user", "far apart") for i in range(4)]
    rows += [(None, 0, "user", "no conversation"), rows[0], rows[0]]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_the_trie_query_with_ties(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(conversations(6), SCHEMA).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert differences(queries.op11_prefix_trie(spark, str(tmp_path)), con, queries.ORACLES["op11_prefix_trie"]) is None


def found_nodes(paths, shard_turns):
    rows = prefix_trie.nodes(paths, shard_turns).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("seed, shard_turns", [(1, 400_000), (2, 60), (3, 17), (4, 5)])
def test_trie_equals_plain_trie(spark, seed, shard_turns):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", base int, path string")
    paths = prefix_trie.rebuilt(table)
    assert found_nodes(paths, shard_turns) == plain_nodes(plain_rebuilt(rows))


def test_trie_of_copies_chains_and_nothing(spark):
    rows = [(i, k, "user", "same") for i in range(60) for k in range(50)]
    table = spark.createDataFrame(rows, SCHEMA)
    paths = prefix_trie.as_paths(prefix_trie.turn_paths(table))
    for shard_turns in (400_000, 100):
        assert found_nodes(paths, shard_turns) == plain_nodes({i: [("user", "same")] * 50 for i in range(60)})
    assert prefix_trie.nodes(prefix_trie.rebuilt(table.limit(0))).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.nodes(prefix_trie.rebuilt(only_null)).count() == 0


def test_findclose_matches_a_stack():
    rng = random.Random(7)
    for n in (1, 2, 63, 64, 65, 500, 4000):
        bits, depth, left = [1], 1, n - 1
        while left or depth > 1:
            if left and (depth == 1 or rng.random() < 0.55):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        bits.append(0)
        stack, want = [], {}
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                want[stack.pop()] = at
        opening = np.array(sorted(want))
        got = prefix_trie.Parentheses(np.array(bits, np.uint8)).findclose(opening)
        assert got.tolist() == [want[o] for o in opening.tolist()]


# ---- whitening


def plain_whitening(vectors):
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in vectors.items()}
    different = np.array(sorted(set(map(tuple, x.values()))), np.float64)
    n, s = len(different), [int(c) for c in different.sum(0)]
    centred = different - different.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
        out[i] = deviation, (np.array(v) - np.array(s) / n) @ basis / np.sqrt(np.maximum(values, 1e-300))
    return n, out, values / values.sum()


def vectors(dim, n, seed=3):
    rng = np.random.default_rng(seed)
    spread = np.linspace(1, 3, dim)
    rows = {i: [float(c) for c in rng.normal(size=dim) * spread] for i in range(n)}
    return rows | {n + i: rows[0] for i in range(30)}  # many copies of one


@pytest.mark.parametrize("dim", [1, 2, 5, 20])
def test_whitening_equals_plain_eigenvectors(spark, dim):
    rows = vectors(dim, 200)
    odd = [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, []), (905, [1.0] * (dim + 1))]
    table = spark.createDataFrame(
        [(i, v, 1, "a", "b") for i, v in [*rows.items(), *odd, (7, rows[7])]],
        "vec_id bigint, embedding array<float>, n int, row string, x string",
    )
    single = {i: [float(np.float32(c)) for c in v] for i, v in rows.items()}
    n, want, explained = plain_whitening(single)
    got = whitening.whiten(table, ["vec_id", "n"]).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    k = min(dim, 16)
    assert len(got) == (len(rows) + 1) * k
    signs = {}
    for r in got:
        deviation, whitened = want[r.vec_id]
        assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        truth = whitened[r.component - 1]
        if abs(truth) > 1e-6:
            signs.setdefault(r.component, np.sign(truth * r.whitened))
        assert r.whitened * signs.get(r.component, 1) == pytest.approx(truth, abs=1e-7)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema), ["vec_id"]).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema), ["vec_id"]).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema), ["vec_id"]).count() == 0
    # One dimension repeats another and one is constant: two components are left.
    rows = [(i, [float(i % 7), float(i % 7), 5.0, float(i % 3)]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, schema), ["vec_id"])
    assert {r.component for r in got.collect()} == {1, 2}
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], schema)
    assert whitening.whiten(far, ["vec_id"]).filter("deviation IS NOT NULL").count() > 0


def test_leading_components_of_hard_matrices():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    blocks = np.zeros((40, 40))
    blocks[:20, :20] = blocks[20:, 20:] = np.cov(rng.normal(size=(50, 20)).T)
    hard = [
        np.eye(20), np.diag(np.arange(1.0, 30)), np.ones((8, 8)), blocks, turn @ np.diag([5.0] * 10 + [1.0] * 30) @ turn.T,
        turn @ np.diag(10.0 ** -np.arange(40)) @ turn.T, np.cov(rng.normal(size=(5, 40)).T) * 1e20,
    ]
    for a in hard:
        values, vectors = whitening.leading_components(a, 16)
        true = np.linalg.eigvalsh(a)[::-1][: len(values)]
        assert np.abs(values - true).max() <= 1e-13 * true[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * true[0]
    assert len(whitening.leading_components(np.zeros((5, 5)), 16)[0]) == 0


# ---- WARC

PAGES = "page_id bigint, url string, html string, payload string, record_id int, value string"


def pages():
    rng = random.Random(2)
    long = "".join(rng.choice("abcdé\n\r<> ") for _ in range(5000))
    rows = [
        (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, "<p>one</p>"), (3, None, "<p>one</p>"),
        (4, "http://c/\r\nX: y", None), (5, "http://d/", ""), (6, "http://e/é", "WARC/1.1\r\nContent-Length: 7\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
        (7, "http://f/", long), (8, "http://f/", long), (8, "http://g/", long), (9, "h", "x" * 64), (10, "i", "x" * 65), (11, "j", "x" * 63),
        (None, "k", "<p>one</p>"), (None, "k", "only here"), (None, "l", "twice"), (None, "l", "twice"), (-5, "m", "minus"), (12, "n", "\n"),
        (13, "o", "0\r\n\r\n"), (14, "p", "z" * 200_000),
    ]
    return [(*r, "a", 1, "b") for r in rows]


def plain_records(rows, at_least):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    holder = {}
    for r in rows:
        payload = r[2] or ""
        if payload not in holder or order(r) > order(holder[payload]):
            holder[payload] = r
    out, seen = [], set()
    for r in rows:
        payload = (r[2] or "").encode()
        first = holder[r[2] or ""]
        revisit = len(payload) >= at_least and not (order(r) == order(first) and payload not in seen)
        if order(r) == order(first):
            seen.add(payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((r[0], len(payload), digest, "revisit" if revisit else "response", first[0] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, at_least", [(64, 0), (1 << 16, 0), (7, 11)])
def test_archives_give_back_the_pages(spark, chunk, at_least):
    rows = pages()
    path = warc.write(spark.createDataFrame(rows, PAGES), chunk=chunk, at_least=at_least)
    got = warc.read_pages(spark, path, chunk).collect()
    assert all(r.verified for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_records(rows, at_least)
    chunks = warc.read_chunks(spark, path, chunk).collect()
    assert len({r.record_id for r in chunks}) == len(rows)
    payloads, ids = defaultdict(list), {}
    for r in sorted(chunks, key=lambda r: (r.file, r.record, r.chunk)):
        assert len(r.data) <= chunk and r.chunk == len(payloads[r.record_id])
        payloads[r.record_id].append(bytes(r.data))
        assert r.bytes_so_far == sum(map(len, payloads[r.record_id])) and r.last == (r.payload_digest is not None)
        ids[r.record_id] = r
    whole = [b"".join(v) for k, v in payloads.items() if ids[k].record_type == "response"]
    responses = [r for r in plain_records(rows, at_least) if r[3] == "response"]
    assert sorted(map(len, whole)) == sorted(r[1] for r in responses)
    assert {r.refers_to for r in chunks if r.refers_to} <= {k for k, r in ids.items() if r.record_type == "response"}


def test_archives_are_warc_files(spark):
    rows = pages()
    path = warc.write(spark.createDataFrame(rows, PAGES), chunk=100)
    n = 0
    for name in glob.glob(f"{path}/part-*.gz"):
        data = gzip.open(name).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            lines = head.split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines[1:])
            assert lines[0] == b"WARC/1.1" and fields[b"WARC-Type"] in (b"response", b"revisit")
            size = int(fields[b"Content-Length"])
            assert data[size : size + 4] == b"\r\n\r\n"
            data, n = data[size + 4 :], n + 1
    assert n == len(rows)


def test_foreign_archives(spark, tmp_path):
    def record(kind, block, content_type, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", f"Content-Type: {content_type}", f"Content-Length: {len(block)}", *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    raw = bytes(range(256)) * 40
    data = record("warcinfo", b"a: b\r\n", "application/warc-fields")
    data += record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n\r\n" + raw, "application/http; msgtype=response", "WARC-Target-URI: u")
    data += record("resource", raw, "image/png") + record("resource", b"", "text/plain")
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data[:700]) + gzip.compress(data[700:]))
    (tmp_path / "two.warc").write_bytes(data)
    rows = warc.read_chunks(spark, str(tmp_path), 1000).orderBy("file", "record", "chunk").collect()
    for name in ("one.warc.gz", "two.warc"):
        mine = [r for r in rows if r.file.endswith(name)]
        whole = defaultdict(bytes)
        for r in mine:
            whole[r.record] += bytes(r.data)
        assert whole == {0: b"a: b\r\n", 1: raw, 2: raw, 3: b""}
        assert [r.payload_digest for r in mine if r.record == 1][-1] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    (tmp_path / "three.warc").write_bytes(data[:-300])
    with pytest.raises(Exception, match="the file ends in a block"):
        warc.read_chunks(spark, str(tmp_path / "three.warc")).collect()


def test_empty_table_gives_no_records(spark):
    path = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read_pages(spark, path).count() == 0


def test_queries_of_the_three(spark, folder):
    assert queries.op12_whitening(spark, folder).filter("identity_error > 0.0001").count() == 0
    assert queries.op13_warc(spark, folder).filter(F.col("record_type").isNull()).count() == 0
