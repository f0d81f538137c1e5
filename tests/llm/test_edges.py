"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math
import random
import re
import string
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quietlake.llm import byte_bpe, common, exact_dedup, jaccard_join, license_scan, packing, quality, secret_scan, simple8b, telephony, toxicity, word_tokens

from .conftest import SCHEMA, odd_rows

ROWS = odd_rows()
MODEL = word_tokens.read_model(public_tokenizers.path("word_bpe_49k.json"))
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)


EVERY = sorted((i is None, i) for i, *_ in ROWS)


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 15)] + [(None, 1, None), (3, None, 1), (99, 1, 0), (1, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers(odd, empty, marks):
    for run in (toxicity.toxicity, quality.quality):
        rows = run(odd, marks).collect()
        assert _ids(rows) == EVERY and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] is not None for r in rows)
        assert run(empty, marks).count() == 0
        for few in (marks.limit(0), marks.filter("quality = 1 and toxic = 1")):
            assert len(run(odd, few).collect()) == len(ROWS)


def test_repeated_ids_do_not_lengthen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(3, "three"), (4, None), (6, "six")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] * 20 + [(1, 1), (3, 1), (4, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 3, 4, 6)}
    got = sorted((r["id"], r["label"]) for r in common.training_rows(docs, labels, "toxic", 2).collect())
    assert got == [x for x in [(1, 1), (3, 1), (4, 0), (6, 0)] if not fold[x[0]]]
    assert len(common.training_rows(docs, labels, "toxic", 1).collect()) <= 2


def test_toxicity_scores_against_brute_force(spark, odd, marks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("n_chars > 0 and doc_id <> 6 and doc_id <> 7"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model["buckets"], model["weights"], strict=True))
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None)
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect() if r["doc_id"] is not None)
    want = []
    for i, text in texts:
        lowered, seen = f" {text.lower()} ", set()
        for n in toxicity.ORDERS:
            for at in range(len(lowered) - n + 1):
                h = 0
                for c in lowered[at : at + n]:
                    h = (h * 0x01000193 + ord(c) * 0x9E3779B1) % 2**32
                seen.add(((h ^ (h >> 15)) * 0x85EBCA6B % 2**32) >> (32 - toxicity.BITS))
        z = model["bias"] + sum(weight.get(b, 0.0) for b in seen)
        want.append((i, 1 / (1 + math.exp(-z))))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in sorted(got)], [s for _, s in sorted(want)], atol=1e-9)


def test_quality_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def numbers(t):
        if not t:
            return [0.0] * len(quality.STATS)
        kinds = dict.fromkeys(quality.STATS[4:14], 0)
        for c in t:
            kind = "upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digits" if "0" <= c <= "9" else "blanks" if c in " \t\r" else "newlines" if c == "\n" else "stops" if c in ".,;:'\"-()" else "marks" if c in "!?" else "bars" if c == "|" else "other_letters" if ord(c) >= 128 else "symbols"
            kinds[kind] += 1
        words, lines, n = t.split(), t.split("\n"), len(t)
        w = max(1, len(words))
        starts = sum("A" <= c <= "Z" for k, c in enumerate(t) if k == 0 or t[k - 1] in " \n")
        shares = [kinds[k] / n for k in quality.STATS[4:14]]
        return [n, len(words), sum(map(len, words)) / w, n / len(lines), *shares, max(map(t.count, "#$%&*@~^")) / n, len(set(words)) / w, len(set(lines)) / len(lines), starts / w, sum(len(x) <= 3 for x in words) / w, sum(len(x) >= 12 for x in words) / w]

    for r in quality.score(docs, model).collect():
        x, z = np.array(numbers(texts[r["doc_id"]]), np.float32), model["bias"]
        for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            z += leaf[node - len(feature)]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_accepted_keeps_all_columns(odd, empty, marks):
    model = quality.train(odd, marks)
    assert quality.accepted(odd, model, 0.0).columns == odd.columns and quality.accepted(odd, model, 0.0).count() == len(ROWS)
    assert quality.accepted(empty, model).count() == 0


def test_byte_bpe(odd, empty):
    rows = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert _ids(rows) == EVERY
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    lost = odd.select(F.lit(1).alias("doc_id"), F.lit(np.array([999_999, 0], "<u4").tobytes()).alias("ids")).limit(1)
    assert bytes(byte_bpe.decode(lost, RANKS).first()["decoded"]) == b"!"


def test_byte_bpe_over_many_blocks(odd, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", 3)
    block = byte_bpe._blocks
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b c d", None, "e"])], names=["i", "t"])
    monkeypatch.setattr(byte_bpe, "task_id", lambda: 0)
    assert [b.ids for _, b in block([batch], public_tokenizers.PATTERN)] == [[1], [2, 3]]


def test_byte_bpe_passes_over_the_texts_once(spark, odd, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    odd.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for docs, reuse, shared in ((stored, "true", True), (stored, "false", False), (odd, "true", False)):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        rows = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
        try:
            before = seen.value
            assert byte_bpe._shares_exchange(rows) == shared
            got = byte_bpe.decode(byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN), RANKS).collect()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert seen.value - before == len(ROWS) and sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t, *_ in ROWS)


def test_license_scan(spark, odd, empty):
    rows = license_scan.license_scan(odd).collect()
    assert _ids(rows) == EVERY and all(r["n_base"] == 0 and r["first_word"] is None and r["score"] == 0 and r["labels"] == "" for r in rows)
    assert license_scan.license_scan(empty).count() == 0
    text = "x Apache-LICENSE, apache license version 2 0! GNU General Public License CC BY-NC 4.0 mit license"
    r = license_scan.license_scan(spark.createDataFrame([(1, text), (2, "license mit"), (3, "the mit license " * 3000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["n_words"], r[0]["n_base"], r[0]["first_word"], r[0]["last_word"], r[0]["base_labels"]) == (19, 5, 1, 17, "apache,cc-by,gpl,mit")
    assert "cc-by-nc" in r[0]["labels"] and r[1]["n_base"] == 0 and r[2]["n_base"] == 3000 and 0 < r[0]["score"] <= 1


def test_telephony(spark, odd, empty):
    stored = telephony.store(odd)
    rows = telephony.decode(stored).collect()
    assert _ids(rows) == EVERY and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert all(telephony.parse_wav(bytes(r["pcm"]))[:4] == (1, 16000, 2, 16) and len(telephony.parse_wav(bytes(r["pcm"]))[4]) == 4 * r["payload_bytes"] for r in rows)
    same = [r["feature"] for r in rows if r["doc_id"] == 9]
    assert len(set(same)) == 2 and telephony.decode(telephony.store(empty)).count() == 0
    raw = spark.createDataFrame([(1, bytearray(range(256)) * 9)], "doc_id long, b binary")
    assert telephony.decode(telephony.store(raw, bytes_col="b")).first()["n_bytes"] == 2304
    bad = [bytearray(b"RIFFnope"), None, bytearray(telephony.wav(b"1234", 1, 8000, 16)), bytearray(telephony.wav(b"12345", 0x11, 8000, 4, 36)), bytearray(telephony.wav(b"1234", 7, 8000, 8)[:30])]
    for media in bad:
        with pytest.raises(Exception, match="media of id 5"):
            telephony.decode(spark.createDataFrame([(5, 1, media)], "doc_id long, n_bytes long, media binary")).collect()


def test_license_scan_of_whole_notices_against_sql(spark, tmp_path):
    rng, docs = random.Random(8), []
    for i, (text, *_) in enumerate(license_scan.TEMPLATES * 3):
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(["x", "license", "the", "cc"])
        cut = words[rng.choice([0, 0, 2]) :]
        docs.append((i, rng.choice(["", "// ", "Foo bar. "]) + rng.choice([" ", "\n * ", ", "]).join(w.upper() if rng.random() < 0.2 else w for w in cut)))
    docs += [(900, " ".join(t for t, *_ in license_scan.TEMPLATES)), (901, "cc by " * 50), (902, ""), (903, None), (904, "GNU general PUBLIC license")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(license_scan.oracle_sql())
    got = license_scan.license_scan(df).select(*want.columns)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall()) and {x for r in rows for x in r[6].split(",")} >= {"gpl", "lgpl", "agpl", "apache", "mit", "bsd", "isc", "mpl", "epl", "zlib", "bsl", "cc-by-nc", "unlicense"}


def _adpcm(block: bytes) -> list[int]:
    """Brute force: one IMA ADPCM block, nibble by nibble."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value + (-change if nibble & 8 else change)))
            index = max(0, min(88, index + telephony.INDEX_CHANGES[nibble & 7]))
            out.append(value)
    return out


def _ulaw(code: int) -> int:
    code = ~code & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return -size if code & 128 else size


def _alaw(code: int) -> int:
    code ^= 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = size if exponent == 0 else (size + 256) << (exponent - 1)
    return size if code & 128 else -size


def test_telephony_features_and_pcm_against_brute_force(spark):
    rng = random.Random(5)
    block = 36
    rms = lambda x: int(math.sqrt(sum(v * v for v in x) / len(x))) if x else 0
    files = [("mulaw", 7, telephony.wav(rng.randbytes(576 * n), 7, 8000, 8)) for n in (1, 3)] + [("alaw", 6, telephony.wav(rng.randbytes(1001), 6, 8000, 8)), ("adpcm", 0x11, telephony.wav(rng.randbytes(block * 7), 0x11, 8000, 4, block)), ("mulaw", 7, telephony.wav(b"", 7, 8000, 8)), ("mulaw", 7, telephony.wav(rng.randbytes(50), 7, 11025, 8))]
    df = spark.createDataFrame([(i, 0, bytearray(f)) for i, (*_, f) in enumerate(files)], "doc_id long, n_bytes long, media binary").coalesce(1)
    for r in telephony.decode(df).collect():
        name, form, raw = files[r["doc_id"]]
        _, rate, _, _, data = telephony.parse_wav(raw)
        samples = [v for i in range(0, len(data), block) for v in _adpcm(data[i : i + block])] if form == 0x11 else [(_ulaw if form == 7 else _alaw)(c) for c in data]
        pcm = b""
        for k in range(len(samples) * 16000 // rate):
            left, part = divmod(k * rate, 16000)
            right = min(left + 1, len(samples) - 1)
            pcm += ((samples[left] * (16000 - part) + samples[right] * part) // 16000).to_bytes(2, "little", signed=True)
        assert bytes(r["pcm"]) == telephony.wav(pcm, 1, 16000, 16)
        blocks = [v for i in range(0, len(data) // block * block, block) for v in _adpcm(data[i : i + block])]
        other = f"alaw_rms={rms([_alaw(c) for c in data])};adpcm_rms={rms(blocks)};" if form == 7 else ""
        crossed = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert r["feature"] == f"{name}_rms={rms(samples)};peak={max(map(abs, samples), default=0)};crossings={crossed};{other}pcm_crc32={zlib.crc32(pcm)}"


def test_exact_dedup(odd, empty):
    rows = exact_dedup.exact_dedup(odd, block_bytes=16).collect()
    assert _ids(rows) == EVERY
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups: dict = {}
    for i, t, *_ in ROWS:
        groups.setdefault(hashlib.sha256((t or "").translate(fold).encode()).hexdigest(), []).append(i)
    for r in rows:
        own = groups[r["text_sha256"]]
        known = [i for i in own if i is not None]
        assert r["group_size"] == len(own) and r["keep_id"] == (max(known) if known else None)
    assert sum(r["kept"] for r in rows) == len(groups) and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_hot_texts(spark):
    """Long lists of references to one block, in the first and in later rounds, travel apart from it."""
    texts = {i: ["", "Notice ", "long " * 40, f"own {i}"][min(i % 7, 3)] for i in range(6000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    rows = exact_dedup.exact_dedup(docs, block_bytes=16).collect()
    groups: dict = {}
    for i, t in texts.items():
        groups.setdefault(t.lower(), []).append(i)
    assert len(rows) == 6000 and all((r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), r["doc_id"] == max(g)) for r in rows for g in [groups[texts[r["doc_id"]].lower()]])
    grouped = docs.selectExpr("doc_id as uid", "doc_id", "text").mapInArrow(exact_dedup._blocks(4096), "key binary, ticket long, uid array<long>, doc_id array<long>, sha array<string>, n array<int>, idx array<int>")
    assert grouped.filter("ticket is not null and key is null and size(uid) >= 256").count() > 0
    assert grouped.filter("key is not null").selectExpr("max(size(uid))").first()[0] < 256


def test_jaccard(spark, odd, empty):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert _ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 9)}
    assert (got[1]["component_id"], got[2]["component_id"]) == (1, 1) and (got[11]["component_id"], got[12]["component_id"]) == (11, 11) and got[6]["component_id"] == got[6]["doc_id"]
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == got[5]["n_shingles"] == 0 and got[3]["component_id"] == 3
    assert [r["first"] for r in rows if r["doc_id"] == 1] == [True] and sum(r["first"] for r in rows if r["doc_id"] == 9) == 2
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_chains_and_stars(spark):
    """Variants of a text, some too far from the others, chains of links, and a hot passage: every link counts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, rows = [word() for _ in range(120)], []
    passage = [word() for _ in range(60)]
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            own[at] = word()
        rows.append(own[: rng.choice([120, 118, 110])])
    chain = [word() for _ in range(100)]
    for i in range(12):
        rows.append(chain[i * 4 :] + [f"c{j}" for j in range(i * 4)])
    rows += [passage + [word() for _ in range(rng.choice([5, 14, 15, 16, 60]))] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(5)
    sets = [{tuple(r[j : j + 5]) for j in range(len(r) - 4)} for r in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 1 < len(set(got.values())) < len(rows)


def test_steps_that_the_driver_would_plan_again_are_stored(spark, odd, monkeypatch):  # round 3, pipeline: the driver's memory
    plan = exact_dedup.exact_dedup(odd, block_bytes=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "ticket" not in plan, plan

    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words)] + [" ".join([*words[: 6 * i], f"other{i}", *words[6 * i + 1 :]]) for i in range(1, 12)]
    docs = spark.createDataFrame(list(enumerate([*texts, "one two three four five six", "far from all others, this one"])), "doc_id long, text string")
    followed, real = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda edges: followed.append(edges.count()) or real(edges))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict.fromkeys(range(12), 0) | {12: 12, 13: 13}
    # links with the centre are followed once, and what is left joins components only
    assert followed[0] == 11 and followed[1:] == [0]


def test_packing(odd, empty):
    rows = packing.pack_documents(odd, MODEL, capacity=64, keep_ids=True).collect()
    whole = {(r["doc_id"], r["piece"]) for r in rows}
    assert {i for i, _ in whole} == {i for i, *_ in ROWS} and all(1 <= r["length"] <= 64 and len(r["ids"]) == 4 * r["length"] for r in rows)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and packing.pack_documents(empty, MODEL).count() == 0


def _pairs(sizes, room):
    """The fewest sequences where no three pieces fit into one (else 0): the longest stands beside the shortest if that fits."""
    if not sizes or 3 * min(sizes) <= room:
        return 0
    order, used = sorted(sizes), 0
    while order:
        longest = order.pop()
        if order and longest + order[0] <= room:
            order.pop(0)
        used += 1
    return used


def test_packing_plans_use_every_piece():
    rng = np.random.default_rng(2)
    for sizes in ([64] * 9, [1] * 500, [33] * 100, rng.integers(1, 65, 3000).tolist(), rng.integers(30, 36, 1000).tolist(), []):
        histogram = dict(zip(*np.unique(sizes, return_counts=True), strict=True)) if sizes else {}
        plan = packing.plan({int(k): int(v) for k, v in histogram.items()}, 64)
        used: dict = {}
        for repeats, content in plan:
            assert sum(length * each for length, each in content) <= 64
            for length, each in content:
                used[length] = used.get(length, 0) + repeats * each
        assert used == {int(k): int(v) for k, v in histogram.items()}
        bound = max(-(-sum(sizes) // 64), sum(s > 32 for s in sizes), _pairs(sizes, 64))
        assert sum(r for r, _ in plan) <= 1.03 * bound + 1


def test_secret_scan(spark, odd, empty):
    weights = secret_scan.train(odd)
    rows = secret_scan.secret_scan(odd, weights=weights).collect()
    assert _ids(rows) == EVERY and secret_scan.secret_scan(empty).count() == 0
    texts = ["secret=token:abcdef", "é PassWord = 'abc-def.9' AKIA" + "Q" * 16 + " " + "0" * 24, "token: ab", "ſecret=abcdefgh", "id Zx9Qk2LmP0vTr8WsYb3N getUserAccountByIdentifier", "password=" + "deadbeef" * 40 + " x " * 200 + "api_key:zzzzzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in secret_scan.secret_scan(df, weights=weights).collect()}
    assert got[0] == [] and got[2] == [] and got[3] == []
    assert got[1] == [("assign", "PassWord = 'abc-def.9"), ("access", "AKIA" + "Q" * 16), ("hex", "0" * 24)]
    assert got[4] == [("markov", "Zx9Qk2LmP0vTr8WsYb3N")] and [k for k, _ in got[5]] == ["assign", "hex", "assign"]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, weights=weights).collect()}
    assert clean[1] == "é [SECRET]' [SECRET] [SECRET]" and clean[0] == texts[0] and "deadbeef" not in clean[5] and clean[5].endswith("[SECRET]")
    kept = secret_scan.redact(odd, weights=weights)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) and kept.filter("text is null").count() == 2


def test_secret_scan_keeps_models_spans_that_go_beyond_a_pattern(spark):
    key, secret, digest = "AKIA" + "Q7XZ" * 4, "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEYq", "0123456789abcdef01234567"
    texts = [f"x {key}/{secret} y", f"x {digest}.{secret} y", f"x {key} y", f"x token={secret} y", f"x {secret}/{key} y"]
    weights = [3000] * len(secret_scan.ALPHABET) ** 2  # all runs look random
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in secret_scan.secret_scan(df, weights=weights).collect()}
    assert got[0] == [("access", key), ("markov", f"{key}/{secret}")] and got[1] == [("hex", digest), ("markov", f"{digest}.{secret}")]
    assert got[2] == [("access", key)] and got[3] == [("assign", f"token={secret}")] and got[4] == [("markov", f"{secret}/{key}"), ("access", key)]
    assert {r["text"] for r in secret_scan.redact(df, weights=weights).collect()} == {"x [SECRET] y"}


def test_many_spans_have_right_places(spark):
    text = " ".join(f"é{i} token={i:06d}" for i in range(700))
    spans = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), weights=[0] * len(secret_scan.ALPHABET) ** 2).first()["base"]
    assert len(spans) == 700 and all(text[s["start"] : s["end"]] == f"token={i:06d}" for i, s in enumerate(spans))


def test_many_spans_are_quick_to_place_and_replace(spark):
    text = " ".join(f"é{i} token={i:06d} {'qZ7x' * 5}{i}" for i in range(5000))
    df, weights = spark.createDataFrame([(1, text)], "doc_id long, text string"), [3000] * len(secret_scan.ALPHABET) ** 2
    began = time.time()
    spans = secret_scan.secret_scan(df, weights=weights).first()["spans"]
    assert time.time() - began < 15 and len(spans) == 10_000
    assert [text[s["start"] : s["end"]] for s in spans] == [x for i in range(5000) for x in (f"token={i:06d}", f"{'qZ7x' * 5}{i}")]
    assert secret_scan.redact(df, weights=weights).first()["text"] == " ".join(f"é{i} [SECRET] [SECRET]" for i in range(5000))


@pytest.fixture(scope="module")
def trained(spark):
    return secret_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def _markov(text, weights, least=1750):
    """Brute force: maximal runs of 16 or more token characters whose mean weight is high enough."""
    n, spans = len(secret_scan.ALPHABET), []
    for m in re.finditer(r"[A-Za-z0-9+/=_.-]+", text):
        codes = [secret_scan.ALPHABET.index(c) for c in m[0]]
        if len(codes) >= 16 and sum(weights[a * n + b] for a, b in zip(codes, codes[1:])) >= least * (len(codes) - 1):
            spans.append(("markov", m.start(), m.end()))
    return spans


def test_markov_spans_against_brute_force(spark, trained):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng, keys = random.Random(3), string.ascii_letters + string.digits + "+/"
    made = [(-i, f"é {''.join(rng.choices(keys, k=rng.choice([15, 16, 24, 40])))} x-{'ab.' * 6} {''.join(rng.choices('Zz9', k=18))}") for i in range(1, 200)]
    found = 0
    for r in secret_scan.secret_scan(docs.unionByName(spark.createDataFrame(made, "doc_id long, text string")), weights=trained).join(docs.unionByName(spark.createDataFrame(made, "doc_id long, text string")), "doc_id").collect():
        base = [(s["start"], s["end"]) for s in r["base"]]
        inside = lambda a, b: all(any(x <= i < y for x, y in base) for i in range(a, b))
        want = [s for s in _markov(r["text"] or "", trained) if not inside(s[1], s[2])]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"] == want
        found += len(want)
    assert found > 100


def test_ordinary_tokens_are_no_secrets(spark, trained):
    ordinary = ["------------------", "................", "0000000000000000", "1234567890123456", "2024-01-01T00.00.00", "3.14159265358979", "getUserAccountByIdentifier", "MAX_CONNECTION_TIMEOUT", "/usr/local/lib/python/site-packages", "org.apache.spark.sql.catalyst", "__________________"]
    rng = random.Random(4)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=20)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([" ".join(ordinary), " ".join(keys)])), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(df, weights=trained).collect()}
    assert got[0] == [] and len(got[1]) >= 190


def test_secrets_by_kind(spark, trained):
    """Recall by the kind of key, and no hit in names that look odd; README has the figures."""
    rng = random.Random(12)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = {"base62": lower + upper + digits, "base64": lower + upper + digits + "+/", "hex upper": "0123456789ABCDEF", "hex lower": "0123456789abcdef", "lower": lower, "lower digits": lower + digits, "upper": upper, "base32": upper + "234567"}
    keys = {kind: ["".join(rng.choices(a, k=rng.randint(16, 64))) for _ in range(200)] for kind, a in alphabets.items()}
    keys["uuid"] = [re.sub("(.{8})(.{4})(.{4})(.{4})(.{12})", r"\1-\2-\3-\4-\5", "".join(rng.choices("0123456789abcdef", k=32))) for _ in range(200)]
    odd = [
        "qwertyuiopasdfghjkl", "RTX4090_SUPER_16GB_GDDR6X", "i18n_l10n_a11y_k8s_e2e", "zxcvbnmasdfghjkl", "abcdefghijklmnopqrstuvwxyz", "getUserAccountByIdentifier", "com.example.project.module", "src/main/java/App.java", "internationalization",
        "AbstractSingletonProxyFactoryBean", "node_modules/lib/index.js", "HTTPSConnectionPool", "utf8_general_ci_ai_ks_ws", "x86_64-unknown-linux-gnu", "libstdc++.so.6.0.29", "Donaudampfschifffahrtsgesellschaft", "ISBN978-3-16-148410-0",
        "v2.1.0-rc.1+build.5114f85", "MAX_BUFFER_SIZE_IN_BYTES", "intel_core_i7-12700K", "SELECT_COUNT_DISTINCT_X", "cuda11.8-cudnn8-devel-ubuntu22.04",
    ]
    rows = [(i, " ".join(k)) for i, k in enumerate(keys.values())] + [(-1, " ".join(odd))]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"), weights=trained).collect()}
    recall = {kind: sum(s["kind"] == "markov" or s["kind"] == "hex" for s in spans[i]) / 200 for i, kind in enumerate(keys)}
    least = {"upper": 0.85, "uuid": 0.8}
    assert spans[-1] == [] and all(r >= least.get(kind, 0.93) for kind, r in recall.items()), recall


def test_simple8b_files(odd, empty):
    files = simple8b.file_rows(odd, MODEL)
    rows = simple8b.read_digests(files).collect()
    assert _ids(rows) == EVERY
    ordered = sorted(rows, key=lambda r: (r["start"]))
    assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(i for i, *_ in ROWS if i is not None) and ordered[0]["doc_id"] is None
    start = 0
    for r in ordered:
        assert r["start"] == start
        start += r["n_tokens"]
    assert simple8b.write_and_read(empty, MODEL).count() == 0


def test_pieces_give_the_library_s_ids():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(MODEL)
    texts = [chr(c) * 2 + "." for c in range(33, 0x250)] + ["It's we'll I'D.", "a.b, c..", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "", None, "İstanbul ǅ ŉ ß ſtraße.", "é ́x", "a\tb\r\nc\x1cd", "日本語 テスト。", "Σίσυφος ΣΑΣ.", "x" * 4000]
    ids, counts = word_tokens.encode_texts(MODEL, texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_stages(spark, sf, tmp_path):
    extra = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"row": F.lit("x"), "score": F.lit(1.5), "spans": F.lit("s"), "a": F.lit(None).cast("long")})
    more = extra.unionByName(spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    docs = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert corpus_pipeline.packing(spark, docs, sf).select("doc_id").distinct().count() > 0
    nothing = spark.createDataFrame([], more.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_license_words_fold_ascii_letters_only(spark):
    """Letters that Unicode lowers to ASCII ones (the Kelvin sign, the dotted I) make other words, in every indexed word, and lose no place beside them."""
    idf = dict.fromkeys(license_scan._vocabulary(license_scan.TEMPLATES, license_scan.BASE), 1.0)
    passages = [license_scan._passage(p, [p], label) for p, label in license_scan.BASE] + [license_scan._passage(*t) for t in license_scan.TEMPLATES]
    odd = {letter: other for letter, other in (("k", "\u212a"), ("i", "\u0130"), ("s", "\u017f"))}
    words = [w.replace(a, b) for w in {*license_scan._vocabulary(license_scan.TEMPLATES, license_scan.BASE), *license_scan._index(passages, idf)} for a, b in odd.items() if a in w]
    docs = [(i, f"MIT License of any {w} under {w.upper()}") for i, w in enumerate(words)] + [(-1, " ".join(words) + " apache\u0130 apache license"), (-2, "m\u0130t license m\u0131t license gnu general public l\u0130cense")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    want = con.sql(license_scan.oracle_sql())
    got = license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).select(*want.columns)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert sorted(map(str, (tuple(r) for r in rows.values()))) == sorted(map(str, want.fetchall()))
    assert all(rows[i]["n_base"] == 1 for i in range(len(words))) and rows[-2]["n_base"] == 0 and rows[-1]["base_labels"] == "apache"


def test_simple8b_deals_out_a_hot_id(spark):
    """An id that most rows have stands in several shards, in order with the others."""
    docs = spark.createDataFrame([(5, f"text number {i} of many") for i in range(300)] + [(i, "x") for i in (1, 9, None)], "doc_id long, text string").repartition(3)
    files = simple8b.file_rows(docs, MODEL)
    assert files.filter("array_contains(doc_ids, 5)").select("shard").distinct().count() > 1
    rows = sorted(simple8b.read_digests(files).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == [None, 1] + [5] * 300 + [9] and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:-1])
