"""URL rules by a cascade of Bloom filters.

A rule names a host and the start of a path. The candidate keys of a URL are its host
and all domains above it, each with every path start whose length some rule has; a rule
fits a URL if and only if its key is among them.

Level 1 of a cascade encodes the listed keys. Level 2 encodes the keys of the corpus that
level 1 lets through by mistake, level 3 the listed keys that level 2 lets through, and so
on until a level makes no mistake. The corpus's complete key universe takes part in the
building, so membership of any of its keys is exact: the number of levels a key passes in
a row is odd for listed keys and even for others. URLs are judged by bit tests alone,
without a join.

Sizes: level 1 has enough bits that about as many keys pass by mistake as are listed, which
takes 1.44 * log2(universe / listed) bits a listed key; each later level halves the rest.
So a cascade is bounded by the rule list, times a logarithm, and not by the corpus.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.workspace import store

HASHES = 3
WORD_BITS = 63  # of a long, the sign left alone
MAX_RULES = 1_000_000
MAX_LEVELS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> tuple[str, str]:
    """SQL of host and path: empty where the URL is null or has no ``://``."""
    rest = f"coalesce(CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) END, '')"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return host, path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions held in ``words``."""

    bits: int
    words: tuple[int, ...]
    seed: int


def _positions(key: str, bits: int, seed: int) -> list[str]:
    return [f"pmod(xxhash64({key}, {seed * HASHES + i}), {bits})" for i in range(HASHES)]


def _fill(keys: DataFrame, bits: int, seed: int) -> Level:
    """The filter of ``keys`` (column ``key``); bits are combined before the shuffle."""
    n_words = bits // WORD_BITS + 1
    words = (
        keys.selectExpr(f"explode(array({', '.join(_positions('key', bits, seed))})) AS at")
        .groupBy(F.expr(f"at div {WORD_BITS}").cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, int(at % {WORD_BITS}))")).alias("value"))
    )
    held = [0] * n_words
    for row in words.collect():  # at most n_words rows, bounded by the rule list
        held[row["word"]] = row["value"]
    return Level(bits, tuple(held), seed)


def _passes(level: Level, key: str) -> str:
    words = f"from_json('{json.dumps(list(level.words))}', 'array<bigint>')"
    tests = [
        f"(shiftright({words}[int(({at}) div {WORD_BITS})], int(({at}) % {WORD_BITS})) & 1) = 1"
        for at in _positions(key, level.bits, level.seed)
    ]
    return "(" + " AND ".join(tests) + ")"


def member(levels: list[Level], key: str) -> str:
    """SQL: whether ``key``, of the universe the cascade was built for, is listed."""
    out = "false"
    for number in range(len(levels), 0, -1):
        inside = "true" if number % 2 else "false"
        deeper = out if number < len(levels) else inside
        out = f"(CASE WHEN {_passes(levels[number - 1], key)} THEN {deeper} ELSE {'false' if number % 2 else 'true'} END)"
    return out


def build(listed: DataFrame, universe: DataFrame, seed: int = 1) -> list[Level]:
    """The cascade of ``listed`` keys, exact on ``universe`` (both with a column ``key``).

    ``listed`` and what passes the first level are small; they are written once.
    """
    listed = listed.select("key").distinct()
    n_listed = listed.count()
    if n_listed > MAX_RULES:
        raise ValueError(f"{n_listed} keys, more than {MAX_RULES}")
    if not n_listed:
        return []
    others = universe.select("key").distinct()
    n_others = max(1, others.count())
    rate = min(0.5, n_listed / n_others)
    inside, outside = listed, others.join(F.broadcast(listed), "key", "left_anti")
    levels: list[Level] = []
    n_inside = n_listed
    while n_inside:
        bits = max(64, math.ceil(-HASHES * n_inside / math.log(1 - rate ** (1 / HASHES))))
        levels.append(_fill(inside, bits, seed + len(levels)))
        if len(levels) > MAX_LEVELS:
            raise RuntimeError("a key passes every level")
        wrong = store(outside.filter(_passes(levels[-1], "key")), "cascade")
        inside, outside = wrong, inside
        n_inside = wrong.count()
        rate = 0.5
    return levels


def candidates(host: str, path: str, lengths: list[int]) -> str:
    """SQL: all keys of a URL, longest first."""
    labels = f"split({host}, '[.]')"
    hosts = (
        f"transform(sequence(1, size({labels})), "
        f"i -> array_join(slice({labels}, i, size({labels})), '.'))"
    )
    cuts = f"filter(array({', '.join(map(str, lengths))}), n -> n <= char_length({path}))"
    keys = f"flatten(transform({hosts}, h -> transform({cuts}, n -> concat(h, substring({path}, 1, n)))))"
    return (
        f"array_sort(array_distinct({keys}), (x, y) -> CASE WHEN char_length(x) != char_length(y) "
        "THEN char_length(y) - char_length(x) WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END)"
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (block or allow, host, path start); hosts are lower case. The longest key
    wins; of equally long ones the first by code point. A page without a rule gets
    ``default``. A null URL, or one without ``://``, has an empty host and path and fits no
    rule. Input columns of the four names are replaced; repeated rows are judged alike; an
    empty table gives an empty table. Long URLs only have longer keys: the number of keys of
    a URL is labels times rule path lengths.
    """
    spark: SparkSession = pages.sparkSession
    if any(verdict not in ("allow", "block") for verdict, _, _ in rules):
        raise ValueError("a rule allows or blocks")
    named = {host + path: verdict for verdict, host, path in rules}
    if len(named) != len({(h, p) for _, h, p in rules}) or any("/" in h for _, h, _ in rules):
        raise ValueError("hosts hold no slash, and no rule is given twice")
    host, path = parse(f"`{url}`")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not rules:
        return pages.selectExpr(*[f"`{c}`" for c in kept], f"{host} AS host", f"{path} AS path", "cast(null AS string) AS rule", f"'{default}' AS verdict")
    lengths = sorted({len(path_start) for _, _, path_start in rules})
    universe = (
        pages.selectExpr(f"{host} AS host", f"{path} AS path")
        .distinct()
        .selectExpr(f"explode({candidates('host', 'path', lengths)}) AS key")
    )
    listed = spark.createDataFrame([(k, v) for k, v in named.items()], "key string, verdict string")
    rule_levels = build(listed, universe, seed=1)
    block_levels = build(listed.filter("verdict = 'block'"), listed, seed=1001)
    found = f"filter({candidates('host', 'path', lengths)}, k -> {member(rule_levels, 'k')})"
    return (
        pages.selectExpr(*[f"`{c}`" for c in kept], f"{host} AS host", f"{path} AS path")
        .selectExpr("*", f"get({found}, 0) AS rule")
        .selectExpr(
            "*",
            f"CASE WHEN rule IS NULL THEN '{default}' WHEN {member(block_levels, 'rule')} "
            "THEN 'block' ELSE 'allow' END AS verdict",
        )
    )
