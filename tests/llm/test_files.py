"""Token files, token counts and archives: exact round trips and the libraries' own results."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import plain
from recollect.llm import codec, counts, files, token_files, tokens, warc

ODD = [
    None, "", " \n", "it's don't I'LL we've", "<|endoftext|>a b<|startoftext|>", "x\x1cy　z", "étude É ﬁ ǅ İstanbul é",
    "abc123 4th 12,5 a.b c-d --", "日本語 テスト", "ß ẞ µ ª ÿ÷×", "🙂🙂 a", "''s 'st", "..!! ?\"( )*&^ @@ ~~", "THE the The, the.",
    "\x00 \x85  a", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_ids_are_the_librarys(library):
    got = tokens.encoder(tokens.tokenizer_path()).encode(ODD)
    for text, ids in zip(ODD, got):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    e = tokens.encoder(tokens.tokenizer_path())
    want = [e._tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    assert e.count(texts) == [len(x) for x in want]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [f"abc{k} defg, hij klm{k % 5}. qrs" for k in range(50)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_what_is_remembered_has_a_size(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1 << 16)
    e = tokens.WordEncoder(tokens.tokenizer_path())
    rng = np.random.default_rng(5)
    for signs in ("abcdefghij", "0123456789"):  # parts and words that are left whole
        for _ in range(300):
            e.count(["".join(rng.choice(list(signs), 1000))])
    for memory in (e._words, e._parts):
        assert sum(len(k) + len(v) for d in (memory.now, memory.older) for k, v in d.items()) < 3 << 16


def test_whole_tokens_are_proved(library):
    e = tokens.encoder(tokens.tokenizer_path())
    assert len(e.whole) > 10_000
    for text, ids in list(e.whole.items())[::500]:
        assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


# -- codes --------------------------------------------------------------------------


def best_lengths(counts, limit):
    """Cost of optimal lengths below a limit, by trying all that fill the code space."""
    n = len(counts)
    best = [None]

    def go(k, lengths, room):
        if k == n:
            if room >= 0:
                cost = sum(c * x for c, x in zip(counts, lengths))
                best[0] = cost if best[0] is None else min(best[0], cost)
            return
        for x in range(1, limit + 1):
            if room - 2 ** (limit - x) >= 0:
                go(k + 1, [*lengths, x], room - 2 ** (limit - x))

    go(0, [], 2**limit)
    return best[0]


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_lengths_are_optimal(limit):
    rng = np.random.default_rng(limit)
    for n in (2, 3, 5, 6):
        c = rng.integers(1, 200, size=n)
        lengths = codec.code_lengths(c, limit)
        assert lengths.max() <= limit
        assert int((c * lengths).sum()) == best_lengths(c.tolist(), limit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), min_size=1, max_size=6))
def test_blocks_come_back(docs):
    flat = np.array([i for d in docs for i in d], dtype=np.int64)
    book = codec.Codebook(codec.code_lengths(np.bincount(flat, minlength=301)))
    names = [None if k == 1 else k - 2 for k in range(len(docs))]
    block = codec.pack_block(book, names, [np.array(d, "<u4").tobytes() for d in docs])
    again, lens, ids = codec.unpack_block(codec.Codebook.load(book.dump()), block)
    assert again == names and lens.tolist() == [len(d) for d in docs] and ids.tolist() == flat.tolist()


def test_more_ids_than_the_limit_has_codes():
    c = np.ones(70, dtype=np.int64)
    assert codec.code_lengths(c, 4).max() == 7


def test_damage_is_noticed():
    book = codec.Codebook(codec.code_lengths(np.array([5, 3, 1])))
    block = bytearray(codec.pack_block(book, [1], [np.zeros(100, "<u4").tobytes()]))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        codec.unpack_block(book, bytes(block))


def test_token_files(docs, widened, empty, scratch, library, monkeypatch):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    encoded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    monkeypatch.setattr(token_files, "BLOCK_IDS", 2000)
    got = token_files.token_files(docs, scratch).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i is None, i or 0, len(x), crc(x)) for i, x in encoded
    )
    place, at = {}, 0
    for i, x in encoded:  # an id's documents stand together, in some fixed order
        place.setdefault(i, at)
        at += len(x)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [i for i, _ in rows]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    assert {r["doc_id"]: r["start"] for r in reversed(ordered)} == place
    assert plain(token_files.token_files(widened, scratch), "doc_id", "start", "ids_crc32") == plain(
        token_files.token_files(docs, scratch), "doc_id", "start", "ids_crc32"
    )
    assert token_files.token_files(empty, scratch).count() == 0


def test_counts(docs, widened, empty, library):
    want = [
        (r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048)
        for r in docs.collect()
    ]
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert plain(counts.token_counts(docs), *columns) == sorted(map(repr, want))
    assert plain(counts.token_counts(widened), *columns) == sorted(map(repr, want))
    assert counts.token_counts(empty).count() == 0


# -- archives -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


@pytest.fixture
def pages(spark):
    big = "<p>" + "shared payload " * 20
    rows = [
        (1, "http://a.example/1", "<p>small"), (2, "http://a.example/2", "<p>small"), (9, "http://b.example/", big),
        (5, "http://a.example/5\r\nX: y", big), (7, None, big), (7, None, big), (3, "http://c.example", None), (4, "", ""),
        (None, "http://n.example", big), (None, "http://n.example", "only here " * 20), (6, "u", "é" * 50), (8, "u", "é" * 50),
        (10, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (11, "u", "x" * 300_000),
    ]
    return spark.createDataFrame(rows, PAGES)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        refers = first.get(h) if first.get(h) != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 1000])
def test_archives(pages, scratch, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    assert plain(warc.archived(pages, scratch), *COLUMNS) == expected([tuple(r) for r in pages.collect()])


def test_archives_wide_and_empty(pages, scratch):
    wide = pages.select("*", *[F.lit("x").alias(c) for c in ("row", "digest", "size", "first", "payload", "n")])
    assert plain(warc.archived(wide, scratch), *COLUMNS) == expected([tuple(r)[:3] for r in pages.collect()])
    assert warc.archived(pages.limit(0), scratch).count() == 0


def test_normalised_archive_holds_the_same_bytes(spark, pages, scratch):
    folder = files.shared_folder(spark, "test")
    whole = scratch.keep(warc.write_archives(warc.with_records(pages, scratch).coalesce(1), folder))
    before = {r["file"] for r in whole.collect()}
    after = scratch.keep(warc.normalise(whole)).collect()
    for old, r in zip(sorted(before), sorted(after)):
        stream, packed = gzip.decompress(files.read(old)), files.read(r["file"])
        assert gzip.decompress(packed) == stream
        entries = warc.read_index(files.read(r["index"]))
        assert len(entries) == r["n"] and sum(n for _, n in entries) == len(packed)
        one = [zlib.decompress(packed[a : a + n], 31) for a, n in entries]
        assert b"".join(one) == stream and all(x.startswith(b"WARC/1.1\r\n") for x in one)


def test_streams_of_many_members_and_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    records = [warc.record(k, k, "u", b"p" * k * 50, "d", k * 50, None) for k in range(6)]
    data = b"".join(map(warc.member, records[:3])) + warc.member(b"".join(records[3:]))
    assert list(warc.split_records(warc.inflated(io.BytesIO(data)))) == records


def test_cut_off_records_are_noticed():
    data = warc.record(1, 1, "u", b"payload", "d", 7, None)
    with pytest.raises(ValueError):
        list(warc.split_records([data[:-9]]))


def test_references_name_records_and_the_index_names_pages(spark, pages, scratch):
    folder = files.shared_folder(spark, "test")
    whole = scratch.keep(warc.write_archives(warc.with_records(pages, scratch), folder))
    names, refers, paged = set(), [], []
    for r in scratch.keep(warc.normalise(whole)).collect():
        packed, index = files.read(r["file"]), files.read(r["index"])
        found = [warc.parse(zlib.decompress(packed[a : a + n], 31)) for a, n in warc.read_index(index)]
        names |= {x["record_id"] for x in found if x["type"] == "response"}
        refers += [x["refers_to_record"] for x in found if x["type"] == "revisit"]
        paged += list(zip(warc.indexed_pages(index), (x["page_id"] for x in found)))
    assert refers and set(refers) <= names
    assert len(paged) == pages.count() and all(a == b for a, b in paged)


@pytest.mark.parametrize("lost", [1, 8, 9, 40])
def test_cut_off_streams_are_noticed(lost):
    data = warc.member(b"".join(warc.record(k, k, "u", b"p" * 500, "d", 500, None) for k in range(6)))
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflated(io.BytesIO(data[:-lost]))))


def tasks_with_rows(df):
    return sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_archives_are_dealt_to_many_tasks(spark, pages, scratch, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    folder = files.shared_folder(spark, "test")
    many = pages.where("page_id is not null").withColumn("page_id", F.col("page_id") * 10)
    for k in range(1, 4):
        many = many.union(pages.where("page_id is not null").withColumn("page_id", F.col("page_id") * 10 + k))
    whole = scratch.keep(warc.write_archives(warc.with_records(many, scratch), folder))
    n = whole.count()
    assert n > 40 and tasks_with_rows(warc.normalise(whole)) >= n // 2
    assert tasks_with_rows(warc.read_archives(scratch.keep(warc.normalise(whole)))) >= n // 2


def test_blocks_are_dealt_to_many_tasks_and_found_again(spark, docs, scratch):
    folder = files.shared_folder(spark, "test")
    ids = scratch.keep(token_files.tokenized(docs, tokens.tokenizer_path()))
    blocks = scratch.keep(token_files.write_files(ids, folder, scratch, block_ids=300))
    assert tasks_with_rows(token_files.read_files(blocks, 2)) >= blocks.count() // 4 >= 4
    again = token_files.find_blocks(spark, folder, scratch)
    assert plain(token_files.read_files(again), "doc_id", "start", "n_tokens", "ids") == plain(
        token_files.read_files(blocks), "doc_id", "start", "n_tokens", "ids"
    )
