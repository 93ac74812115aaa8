"""Archives, token files, packing and chats: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientele.llm import chat, files, packing, queries, tokencount, warc
from tests.llm.data import TOKENIZER, empty_documents, odd_documents, prose

LIBRARY = Tokenizer.from_file(TOKENIZER)
PAGES = "page_id long, url string, html string"


def pages(spark):
    big, text = prose(1, 20_000), prose(2, 60)
    rows = [(i, f"http://x/{i}\r\nInjected: 1", text) for i in (7, 3, 5)] + [(3, "http://again", text)]
    rows += [(8, None, None), (9, "http://e", ""), (10, "u", "short"), (11, "u", "short"), (12, "http://b", big), (13, "http://c", big),
             (None, "http://n", text), (14, "http://é中", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9)]
    return rows, spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("kind", F.lit(1))


def test_archives_come_back_whole(spark, tmp_path):
    rows, frame = pages(spark)
    manifest = warc.write_warc(frame, str(tmp_path / "w"), str(tmp_path / "d"), 3, file_bytes=4000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    for r in manifest.collect():
        assert hashlib.sha256(open(tmp_path / "w" / r["file"], "rb").read()).hexdigest() == r["sha256"]
    got = warc.resolved(warc.read_warc(spark, str(tmp_path / "w")), str(tmp_path / "r")).collect()
    assert all(r["intact"] for r in got)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (i or 0, len((t or "").encode()), sha(t)) for i, _, t in rows)
    kinds = {(r["page_id"], r["url"]): (r["record_type"], r["refers_to"]) for r in got}
    assert sum(k == ("response", None) for (i, _), k in kinds.items() if i == 3) == 1
    assert {k for (i, _), k in kinds.items() if i in (5, 7)} == {("revisit", 3)}
    assert {k for (i, _), k in kinds.items() if i in (8, 9, 10, 11, 12, 14)} == {("response", None)}
    assert [k for (i, _), k in kinds.items() if i == 13] == [("revisit", 12)]


def test_archives_are_the_same_each_time(spark, tmp_path):
    _, frame = pages(spark)
    found = []
    for name in ("a", "b"):
        warc.write_warc(frame.repartition(4), str(tmp_path / name), str(tmp_path / f"{name}d"), 2)
        found.append({n: open(tmp_path / name / n, "rb").read() for n, _ in files.sizes(str(tmp_path / name), ".gz")})
    assert found[0] == found[1]


def test_archives_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Rows of one page_id and url with unlike html, copies, and rows without page_id."""
    rows = [(1, "u", prose(i, 40)) for i in range(50)] + [(i % 7 or None, f"u{i % 3}", prose(i % 5, 40)) for i in range(120)]
    found = []
    for name, seed in (("a", 1), ("b", 2), ("c", 3)):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, PAGES).repartition(seed)
        warc.write_warc(frame, str(tmp_path / name), str(tmp_path / f"{name}d"), 4, file_bytes=3000)
        found.append({n: open(tmp_path / name / n, "rb").read() for n, _ in files.sizes(str(tmp_path / name), ".gz")})
    assert found[0] == found[1] == found[2]
    # more than one shard holds the rows of page 1, which are dealt by digest
    assert len({n[:11] for n in found[0]}) == 4


def test_no_page_no_archive(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.write_warc(none, str(tmp_path / "w"), str(tmp_path / "d"), 2).count() == 0
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "w")), str(tmp_path / "r")).count() == 0


def test_a_failed_attempt_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), files.committed(str(tmp_path), "x.ids") as out:
        out.write(b"half")
        raise RuntimeError
    assert files.sizes(str(tmp_path), ".ids") == []
    with files.committed(str(tmp_path), "x.ids") as out:
        out.write(b"whole")
    files.drop_temporary(str(tmp_path))
    assert files.sizes(str(tmp_path), ".ids") == [("x.ids", 5)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    flat = {f"part-{i}.ids": [rng.choice([0, 1, 2, 9]) for _ in range(n)] for i, n in enumerate((0, 1, 2, 50, 51))}
    flat["part-9.ids"] = [9, 9, 9]
    for name, ids in flat.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    expected = []
    for name, ids in flat.items():
        start = k = 0
        for at, i in enumerate(ids):
            if i == 9:
                expected.append((name, k, start, at - start, True))
                start, k = at + 1, k + 1
        if start < len(ids):
            expected.append((name, k, start, len(ids) - start, False))
    got = tokencount.scan_separators(spark, str(tmp_path), 9, block_tokens=block).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_no_file_no_count(spark, tmp_path):
    assert tokencount.scan_separators(spark, str(tmp_path / "none"), 9).count() == 0
    tokencount.write_token_files(empty_documents(spark), str(tmp_path), TOKENIZER, queries.EOD).count()
    assert tokencount.scan_separators(spark, str(tmp_path), queries.EOD).count() == 0


def test_token_counts_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    listing = tokencount.write_token_files(docs, str(tmp_path), TOKENIZER, queries.EOD).collect()
    counts = {(r["file"], r["ordinal"]): r for r in tokencount.scan_separators(spark, str(tmp_path), queries.EOD).collect()}
    LIBRARY.encode_special_tokens = True
    expected = sorted((r["doc_id"] or 0, len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert all(r["closed"] for r in counts.values())
    assert sorted((r["doc_id"] or 0, counts[r["file"], r["ordinal"]]["n_tokens"]) for r in listing) == expected


def check_packing(rows, texts):
    """Pieces cover every document once, sequences are gapless and not too long."""
    LIBRARY.encode_special_tokens = False
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, text in texts:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at, stop, k = 0, len(ids) % 2048 or 2048, 0
        while at < len(ids):
            want.setdefault(i, []).append((k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at, stop, k = stop, stop + 2048, k + 1
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(p[2] for held in want.values() for p in held)


def test_packing_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    rows = packing.packed_documents(docs, TOKENIZER, str(tmp_path / "p")).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.packed_documents(empty_documents(spark), TOKENIZER, str(tmp_path / "e")).count() == 0


def test_packing_is_tight(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    sequences, tokens = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sequences <= 1.01 * tokens / 2048 + 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(0, 99))
def test_evolution_keeps_every_piece(lengths, seed):
    lengths = np.array(lengths)
    first = packing._first(lengths, np.argsort(-lengths, kind="stable"), 64)
    other = packing._first(lengths, np.arange(len(lengths)), 64)
    evolved = packing._evolve([first, other], lengths, 64, seed, 4, 3)
    assert all(len(bins) == len(lengths) and np.bincount(bins, lengths).max() <= 64 for bins in evolved)
    assert packing._worth(evolved[0], lengths, 64) <= packing._worth(first, lengths, 64)


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string, formatted string"


def test_folding_of_events(spark):
    rows = [(1, 1, 1, "message", "user", "hi", "x"), (1, 3, 2, "message", "assistant", "", "x"), (1, 5, 2, "delta", "assistant", "lo", "x"),
            (1, 4, 2, "delta", "assistant", "hel", "x"), (1, 6, 2, "regenerate", None, None, "x"), (1, 7, 2, "delta", None, "new ", "x"),
            (1, 8, 2, None, None, "one", "x"), (1, 9, 1, "edit", "user", "hello?", "x"), (1, 10, 3, "message", None, None, "x"),
            (None, 1, 1, "message", "assistant", "\\</turn>\\", "x"), (2, None, None, "delta", "assistant", "a", "x"),
            (2, None, None, "delta", "assistant", "a", "x")]
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, EVENTS))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hello?"), ("assistant", "new one"), ("", "")]
    assert got[1]["loss_texts"] == ["new one"] and got[None]["loss_texts"] == ["\\</turn>\\"]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "aa")]
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("role", ["r" * 100_000, ":" * 100_000, "\\" * 100_000, "a\n: " * 30_000])
def test_long_roles_and_texts(spark, role):
    text = "### </turn>\n" * 20_000
    rows = [(1, 1, role, text), (1, 2, "assistant", text)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.read_chats(chat.format_chats(queries.conversation_events(frame))).first()
    assert [tuple(t) for t in read["turns"]] == [(role, text), ("assistant", text)] and read["loss_texts"] == [text]


def test_many_deltas(spark):
    rows = [(1, i, 1, "message" if i == 0 else "regenerate" if i == 5 else "delta", "assistant", f"{i},") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")
    assert chat.fold_messages(frame).first()["text"] == "".join(f"{i}," for i in range(6, 20_000))


def test_control_strings_come_back(spark):
    signs = ["\\", "#", "##", "### ", "</turn>", "<\\/turn>", "</turn>\n", ": ", ":", "user", "\n", "", "### assistant: ", "中", "\U0001F600", "$1"]
    rng = random.Random(4)
    rows = [(c, t, "".join(rng.choices(signs, k=3)) if rng.random() < 0.3 else rng.choice(["user", "assistant"]),
             "".join(rng.choices(signs, k=rng.randint(0, 9)))) for c in range(40) for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(queries.conversation_events(frame))
    for r in chat.read_chats(made).collect():
        mine = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["loss_texts"] == [text for role, text in mine if role == "assistant"]
    for r in made.collect():
        for s in r["loss_spans"]:
            assert "</turn>" not in r["formatted"][s["start"]:s["start"] + s["length"]]
            assert r["formatted"][s["start"] + s["length"]:].startswith("</turn>\n")
