"""BPE, packing, line dedup, transport streams and fingerprints against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from caseloom.llm import bpe, lines, packing, spotsigs, transport

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
TOKENIZER = bpe.tokenizer(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def order(row):
    return tuple((x is None, str(x)) for x in row)


# ---- BPE ----------------------------------------------------------------------------------------


def split_ids(texts):
    tok = TOKENIZER
    hashes, offsets, words = tok.split_words(texts)
    flat, sizes = tok.ids(list(words.values()))
    ids = dict(zip(words, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)) if words else {}
    return [[i for h in hashes[a:b].tolist() for i in ids[h]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'stdmrvle \n\t1½éÉΣİ’—_ſ")), max_size=30), max_size=4))
def test_words_are_cut_as_the_library_does(texts):
    assert split_ids(texts) == [library_ids(t) for t in texts]


def test_special_tokens_and_contractions():
    texts = ["a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>", "It's the dogs' 're 'side we'll I'M 's's", "x'", "", "<|endoftext|>'s"]
    assert split_ids(texts) == [library_ids(t) for t in texts]


def test_encode_and_decode_equal_the_library(docs):
    got = bpe.decode(bpe.encode(docs, PATH), PATH, out="back").collect()
    want = [(r.doc_id, library_ids(r.text), LIBRARY.decode(library_ids(r.text), skip_special_tokens=False)) for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids), r.back) for r in got), key=order) == sorted(want, key=order)


def test_digests_and_chunks(docs, none, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 20)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(bpe.encode(docs, PATH), PATH).collect()}
    assert got == {(r.doc_id, len(library_ids(r.text)), hashlib.sha256(" ".join(map(str, library_ids(r.text))).encode()).hexdigest()) for r in docs.collect()}
    assert bpe.digests(bpe.encode(none, PATH), PATH).count() == 0


# ---- packing ------------------------------------------------------------------------------------


def test_differencing_keeps_sums():
    r = random.Random(2)
    for _ in range(60):
        sizes = np.array([r.randint(1, 2047) for _ in range(r.randint(1, 60))])
        k = r.randint(1, 9)
        place, sums = packing.differencing(sizes, k)
        assert sorted(np.bincount(place, weights=sizes, minlength=len(sums))) == sorted(sums)
        assert len(sums) == min(len(sizes), k)


def test_differencing_beats_dealing_in_turn():
    sizes = np.random.default_rng(3).integers(1, 500, 400)
    place, sums = packing.differencing(sizes, 50)
    assert sums.max() - sums.min() <= 20


def test_windows_rise_until_they_fit():
    place = packing.windows(np.array([2000, 2000, 100, 100]), 2048)
    assert np.bincount(place, weights=[2000, 2000, 100, 100]).max() <= 2048
    assert len(packing.windows(np.zeros(0, np.int64), 2048)) == 0


def test_every_id_is_packed_once(docs, none):
    rows = packing.pack(docs, PATH).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (i, text), n in texts.items():
        ids = np.array([*library_ids(text), 1], "<u4")
        whole = len(ids) - len(ids) % 2048
        for a, size in [*((x, 2048) for x in range(0, whole, 2048)), *((x, 512) for x in range(whole, len(ids), 512))]:
            want[i, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes()), len(ids)] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, PATH).count() == 0


# ---- lines --------------------------------------------------------------------------------------


def brute_lines(texts, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in set(ks) if k)
    return [(len(ks), sum(n[k] >= least for k in ks), None if t is None else "\n".join(x for x, k in zip(t.split("\n"), ks, strict=True) if n[k] < least))
            for t, ks in zip(texts, keys, strict=True)]


@pytest.mark.parametrize("least,batches,fanout", [(1, 1, 2), (3, 4, 2), (3, 5, 3), (10, 3, 2)])
def test_repeated_lines_go(spark, least, batches, fanout):
    r = random.Random(least)
    texts = [None, "", "\n\n"] + ["\n".join(r.choice(["Same", " same\t", "É x", "other %d" % r.randint(0, 6), "", "  "]) for _ in range(r.randint(1, 8))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int").repartition(6)
    got = sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in lines.dedup_lines(df, min_docs=least, batches=batches, fanout=fanout).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_lines(texts, least))]


def test_line_dedup_of_awkward_rows(docs, none):
    got = lines.dedup_lines(docs, min_docs=3)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_lines([r.text for r in rows], 3), strict=True)]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=order) == sorted(want, key=order)
    assert lines.dedup_lines(none).count() == 0


def test_runs_settle_and_compact(spark):
    index = lines.LineRuns(spark, min_docs=2, fanout=2)
    key = lambda x: bytes([x]) * 16
    for batch in ([(key(1), 2), (key(2), 1)], [(key(1), 9), (key(2), 1)], [(key(3), 1)], [(key(2), 5)]):
        index.add(spark.createDataFrame(batch, "key binary, n long"))
    assert [len(x) for x in index.levels] == [0, 0, 1]
    counts = {bytes(r.key): r.n for r in index.runs()[0].collect()}
    assert counts[key(1)] == 2  # the later ones met a settled key
    assert {bytes(r.key) for r in index.settled().collect()} == {key(1), key(2)}
    index.drop()


# ---- transport streams --------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.integers(1, 400), st.integers(16_000, 17_000), st.integers(130_000, 134_000)), st.integers(0, 9))
def test_streams_give_back_their_payload(size, seed):
    payload = random.Random(seed).randbytes(size)
    media = transport.mux(payload)
    got = transport.demux(media)
    assert len(media) % 188 == 0 and got["payload"] == payload and got["errors"] == 0
    assert got["pts"] == [i * transport.TICKS for i in range(-(-size // transport.UNIT))]
    assert len(got["random_access"]) == -(-len(got["pts"]) // transport.RANDOM_EVERY)


def test_damage_is_seen():
    media = bytearray(transport.mux(bytes(5000)))
    lost = bytes(media[:188 * 5] + media[188 * 6:])
    with pytest.raises(ValueError, match="incomplete"):
        transport.demux(lost)
    media[188 * 5 + 3] ^= 1
    assert transport.demux(bytes(media))["errors"] == 2
    media[0] = 0
    with pytest.raises(ValueError, match="sync"):
        transport.demux(bytes(media))


def test_stored_texts(docs, none):
    got = transport.read(transport.store(docs)).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(transport.mux(payload)).hexdigest()))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got), key=order) == sorted(want, key=order)
    assert transport.read(transport.store(none)).count() == 0


# ---- fingerprints -------------------------------------------------------------------------------


def test_likeness_and_pruning():
    a, b = np.arange(10, dtype=np.uint32), np.arange(5, 25, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 5 / 25 and spotsigs.likeness(a, b, 0.8) == 0.0
    assert spotsigs.likeness(a, a, 0.8) == 1.0 and spotsigs.likeness(a[:0], a[:0]) == 1.0 and spotsigs.likeness(a, a[:0]) == 0.0
    for n in range(1, 200):
        for m in range(n, 200):
            if n >= 0.8 * m:
                assert spotsigs.length_class(m) - spotsigs.length_class(n) <= 1


def test_signatures_follow_their_anchors():
    one, = spotsigs.signatures(["the quick brown fox"])
    same, more, none_ = spotsigs.signatures(["The quick, brown!", "x the quick brown fox jumps", None])
    assert set(same) <= set(one) and set(same) <= set(more) and not len(none_)


def brute_spots(text):
    """Signatures written out as tuples of words: an anchor and the two content words after it."""
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hashes = {w: int(spotsigs.word_hashes(pa.array([w]), breaks=spotsigs.MARKS)[0][0]) for w in set(words)}
    out = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1:] if x not in spotsigs.ANCHORS][:2]
        if (w in spotsigs.ANCHORS or hashes[w] % 6 == 0) and len(content) == 2:
            out.add((w, *content))
    return out or {(w,) for w in words}


def test_fingerprints_equal_sets_of_word_tuples():
    r = random.Random(4)
    plain = ["".join(r.choice("abcdeghkmoprsty\u00fc7") for _ in range(r.randint(2, 7))) for _ in range(150)]
    texts = [None, "", "the", "the of and", "..."]
    for _ in range(60):
        words = [r.choice(spotsigs.ANCHORS).title() if r.random() < 0.3 else r.choice(plain) for _ in range(r.randint(1, 120))]
        texts.append("".join(w + r.choice([" ", ", ", "\n", "-"]) for w in words))
        texts.append(" ".join(words[:r.randint(1, len(words))] + r.choices(plain, k=r.randint(0, 9))))
    want, got = [brute_spots(t) for t in texts], spotsigs.signatures(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, x in enumerate(want):
        for j, y in enumerate(want):
            alike = len(x & y) / len(x | y) if x | y else 1.0
            assert spotsigs.likeness(got[i], got[j]) == alike
            assert spotsigs.likeness(got[i], got[j], 0.8) == (alike if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) else 0.0)


@pytest.mark.parametrize("parts", [1, 3])
def test_edited_texts(docs, none, parts):
    rows = [r for r in docs.collect()]
    h = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), h[r.text], r.text or ""))
    want = []
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = r.text or "", after.text or ""
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        x, y, z = spotsigs.signatures([a, edited, b])
        want.append((r.doc_id, len(a), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.written(x), spotsigs.likeness(x, y), spotsigs.likeness(x, z)))
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = spotsigs.edited_likeness(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got), key=order) == sorted(want, key=order)
    assert spotsigs.edited_likeness(none).count() == 0


def test_lone_document_follows_itself(spark):
    row, = spotsigs.edited_likeness(spark.createDataFrame([(1, "the cat sat on the mat again")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"the cat sat on" + b"the cat sat on").hexdigest() and row.near_next == 1.0


def test_lines_are_split_a_few_texts_at_a_time():
    import pyarrow as pa

    from caseloom.llm import lines

    texts = [f"line {i}\nb" for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500), pa.int64()), pa.array(texts)], ["text_id", "text"])
    out = list(lines._link_keys([batch]))
    assert max(b.num_rows for b in out) <= 2 * lines.ROWS and sum(b.num_rows for b in out) == 5000
