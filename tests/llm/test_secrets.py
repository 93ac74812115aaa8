"""Spans of the fixed kinds against Python's patterns; the battery on tokens made at random."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from clientele.llm import randomness
from clientele.session import scratch_dir
from tests.llm.data import CLASHES, DOCS, empty_documents, odd_documents, prose

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def scanned(spark, texts: list):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    found = randomness.scan_secrets(spark.createDataFrame(rows, DOCS), scratch_dir(spark, "secrets-test")).collect()
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}


def test_fixed_kinds(spark):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(9000)]
    texts = ["token=token:abcdefgh password = \"ab\" api_key:'0123456789'", "ToKeN==abcdefgh secret: short passwd=" + "x" * 50_000,
             "AKIAAKIAAKIA1234 AKIA123 xAKIA0123456789ABz", "0" * 31 + " " + "a" * 32 + "G" + "f" * 33, "api-key=12345678 apikey=1234567",
             "é\U0001F600 secret=\U0001F600 token=中abcdefgh token:äöü secret='abcdefgh'" + hexes[0],
             " ".join(hexes), "token" * 3000 + " " * 3000 + "=abcdefgh", "ſecret=abcdefgh passwordabcdefgh", "a" * 200_000, prose(4, 30_000)]
    for i, spans in scanned(spark, texts).items():
        assert [s for s in spans if s[1] < 3] == plain(texts[i]), i


def test_battery(spark):
    """Random tokens of every longer encoding are found, words and identifiers are not."""
    rng = random.Random(5)
    signs = {"hex": "0123456789abcdef", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": randomness.ENCODINGS[5][2]}
    made = [" ".join(["see", "".join(rng.choice(signs[k]) for _ in range(n)) + "=" * (k == "base64")]) for k in signs for n in (64, 88) for _ in range(20)]
    words = [prose(i, 12).replace(" ", sep) for i in range(60) for sep in ("_", "-", "")]
    words += ["/usr/lib/python/site-packages/numpy/core/include", "a" * 90, "ab" * 40, "0123456789" * 6, "=" * 80, "HelloWorldThisIsACamelCaseName" * 2]
    found = scanned(spark, made + words)
    hits = [[s for s in found[i] if s[1] == 3] for i in range(len(made))]
    assert all(h in ([], [(4, 3, len(t))]) for h, t in zip(hits, made, strict=True))
    assert sum(map(bool, hits[:40])) >= 34 and sum(map(bool, hits[40:])) >= 78       # of 40 hexadecimal, of 80 others
    assert sum(s[1] == 3 for i in range(len(made), len(found)) for s in found[i]) <= 2
    assert scanned(spark, words)


def test_level_grows_with_length(spark):
    rng = random.Random(6)
    lengths = (24, 48, 96, 192)
    tokens = ["".join(rng.choice(randomness.ENCODINGS[5][2]) for _ in range(n)) for n in lengths for _ in range(20)]
    rows = spark.createDataFrame([(tokens,)], "t array<string>").select(randomness.levels(F.col("t")).alias("m")).first()
    means = [sum(m["level"] for m in rows["m"][20 * i:20 * i + 20]) for i in range(len(lengths))]
    assert means == sorted(means)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = randomness.scan_secrets(docs, scratch_dir(spark, "secrets-test")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count() and len(CLASHES) and sum(r["doc_id"] is None for r in rows) == 2
    for r in rows:
        if r["doc_id"] is not None:
            assert [tuple(s) for s in r["spans"] if s["kind"] < 3] == plain(texts[r["doc_id"]])
    assert randomness.scan_secrets(empty_documents(spark), scratch_dir(spark, "secrets-test")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = randomness._search(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
