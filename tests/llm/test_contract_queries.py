"""The op queries over whole tables, against brute force or SQL."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quietlake.llm import queries, simple8b, telephony

from .conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_byte_bpe(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(coder.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_telephony(spark, texts):
    for r in queries.op4_telephony(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = telephony.wav(payload, 7, 8000, 8)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_jaccard(spark, texts):
    sets = {}
    for i, t in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_secret_scan(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table with secrets of every kind
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
    patterns = [
        ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    seen = 0
    for r in queries.op8_secret_scan(spark, sf).collect():
        spans, counts = [], []
        for k, (kind, pattern, group, least) in enumerate(patterns):
            found = [m for m in pattern.finditer(texts[r["doc_id"]]) if len(m[group]) >= least]
            counts.append(len(found))
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in found]
        base = [s for *_, s in sorted(spans)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == base
        seen += len(base)
    assert seen


@pytest.fixture(scope="module")
def word_ids(texts):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(texts)
    return {i: e.ids for i, e in zip(order, coder.encode_batch([texts[i] for i in order], add_special_tokens=False), strict=True)}


def test_packing(spark, word_ids):
    rows = queries.op7_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == word_ids.keys()
    for i, own in by_doc.items():
        ids = np.array(word_ids[i] + [0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == want
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_simple8b(spark, word_ids):
    start = 0
    rows = queries.op10_simple8b(spark, SF).orderBy("doc_id").collect()
    assert len(rows) == len(word_ids)
    for r in rows:
        ids = np.array(word_ids[r["doc_id"]] + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def _held_out(spark, name, label):
    marks = dict(duckdb.sql(f"select doc_id, {label} from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    return [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]


def test_quality_on_held_out_rows(spark):
    pairs = _held_out(spark, "op5_quality", "quality")
    assert np.mean([p == y for p, y in pairs]) > 0.97


def test_toxicity_on_held_out_rows(spark):
    pairs = _held_out(spark, "op1_toxicity", "toxic")
    assert np.mean([p == y for p, y in pairs]) > 0.9 and np.mean([y for p, y in pairs if p]) > 0.9


def test_simple8b_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 119, 120, 255, 256, 257, 3000):
        for top in (1, 2, 7, 50_000, 2**32, 2**60, 2**63):
            ids = rng.integers(0, top, n).astype(np.uint64)
            ids[rng.random(n) < 0.3] = 0
            if n > 2 and top == 2**63:
                ids[1] = 2**64 - 1
            raw = simple8b.encode(ids)
            assert (simple8b.decode(raw) == ids).all()
            for b in range(-(-n // simple8b.BLOCK)):
                assert (simple8b.decode(raw, b) == ids[b * 256 : b * 256 + 256]).all()
    with pytest.raises(ValueError):
        simple8b.decode(b"nonsense")


def test_simple8b_is_small():
    assert len(simple8b.encode(np.zeros(4096, np.uint64))) < 700 and len(simple8b.encode(np.arange(4096) % 16)) < 4096


def test_mulaw_and_alaw_tables():
    mulaw, alaw = telephony.mulaw_table(), telephony.alaw_table()
    assert (mulaw[0], mulaw[0x7F], mulaw[0x80], mulaw[0xFF]) == (-32124, 0, 32124, 0)
    assert (alaw[0xD5], alaw[0x55], alaw[0x2A], alaw[0xAA]) == (8, -8, -32256, 32256)
    assert len(set(mulaw.tolist())) == 255 and len(set(alaw.tolist())) == 256


def test_adpcm_against_one_sample_at_a_time():
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (7, 36), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for block, samples in zip(blocks.tolist(), got.tolist(), strict=True):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        want = [value]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                change = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
                value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
                index = max(0, min(88, index + telephony.INDEX_CHANGES[nibble & 7]))
                want.append(value)
        assert samples == want
    assert telephony.resample(np.array([0, 10, 20]), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20] and telephony.resample(np.array([0, 10, 20, 30]), 8000, 4000).tolist() == [0, 20]
