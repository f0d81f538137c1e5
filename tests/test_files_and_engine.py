import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietlake.config import Settings
from quietlake.engine import Engine, main
from quietlake.operators import content, occurrence
from quietlake.operators.egress import cap_output, contained, plain, protected_forms
from quietlake.operators.masking import dictionary_entries
from quietlake.sources import files, sinks
from quietlake.streaming import incremental

CSV = "user_id,name,kana,mail,tel,plan,amount\n1234,高橋 美咲,たかはし みさき,Misaki@corp.jp,090-1111-2222,pro,10\n1235,佐藤 蓮,さとう れん,ren@corp.jp,090-3333-4444,free,20\n1236,鈴木 凛,すずき りん,rin@corp.jp,080-5555-6666,pro,30\n"


@pytest.fixture()
def engine(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "customers.csv").write_text(CSV, encoding="utf-8")
    (box / "sjis.csv").write_bytes("氏名;件数\n髙橋;3\n".encode("cp932"))
    (box / "notes.bin").write_bytes(b"\0\1")
    (box / ".hidden.csv").write_text("a\n1\n")
    return Engine(spark, {"v": spark.range(3).toDF("x")}, Settings(inbox=str(box), result_bytes=2000, string_max=32))


def test_describe_files(engine):
    out = engine.files_describe()
    by_id = {f["id"]: f for f in out["files"]}
    assert len(by_id) == 3
    one = by_id[files.file_id("customers.csv")]
    assert [c["type"] for c in one["columns"]] == ["int", "text", "text", "text", "text", "text", "int"] and one["rows_estimate"] == 3 and one["delimiter"] == ","
    assert [c["name"] for c in by_id[files.file_id("sjis.csv")]["columns"]] == ["氏名", "件数"] and "note" in by_id[files.file_id("notes.bin")]
    assert "美咲" not in json.dumps(out, ensure_ascii=False) and "customers" not in json.dumps(out)
    assert files.list_inbox(engine.spark, "/nowhere/at/all").count() == 0


def test_fixtures_and_masked_lines(engine, spark):
    assert len(engine.fixture_make(files.file_id("customers.csv"), 7)["rows"]) == 7 and engine.fixture_make("v")["ok"] and not engine.fixture_make("w")["ok"]
    engine.entries = dictionary_entries(spark.createDataFrame([("P1", ["高橋 美咲"], [], [], [])], "id string, names array<string>, emails array<string>, phones array<string>, ids array<string>"))
    out = engine.read_masked(files.file_id("customers.csv"), 2)
    assert out["line_count"] == 2 and "[P1_NAME]" in out["lines"][1] and "Misaki@" not in out["lines"][1]
    assert not engine.read_masked("00000000")["ok"] and not engine.read_masked(files.file_id("notes.bin"))["ok"]


def test_analyses(engine):
    fid = files.file_id("customers.csv")
    run = lambda fn: engine.run_analysis(fn, [fid])
    good = run(lambda d: {"by_plan": d.load(fid).groupBy("plan").agg(F.sum("amount").alias("s")).orderBy("plan"), "p": float("nan")})
    assert good["result"] == {"by_plan": [{"plan": "free", "s": 20}, {"plan": "pro", "s": 40}], "p": None}
    for leak in ("高橋美咲", "タカハシミサキ", "tel: 09011112222", "MISAKI@CORP.JP", "高 橋 美 咲"):
        assert "protected" in run(lambda d, leak=leak: (d.load(fid), {"x": leak})[1])["error"], leak
    assert "too large" in run(lambda d: list(range(5000)))["error"]
    engine.settings.string_max = 64
    assert "blobs" in run(lambda d: {"b": "QUJD" * 15})["error"]
    assert run(lambda d: None)["error"] and "ValueError" in run(lambda d: int("高橋"))["error"] and "高橋" not in str(run(lambda d: int("高橋")))
    assert not engine.run_analysis(lambda d: 1, ["nope"])["ok"]


def test_plain_and_cap():
    assert plain({"a" * 70: "b" * 70, "n": [1, True, None, b"x", {1}]}) == {"a" * 64: "b" * 64 + "…", "n": [1, True, None, "[bytes withheld]", [1]]}
    deep = cur = []
    for _ in range(9):
        cur.append([])
        cur = cur[0]
    assert "[nested too deep]" in json.dumps(plain(deep))
    small = cap_output({"ok": True, "rows": [["x" * 50]] * 2000}, 5000)
    assert small["truncated"] and len(json.dumps(small)) <= 5000 < len(json.dumps(small | {"rows": small["rows"] + [["x" * 50]] * 2})) and small["rows_dropped"] == 2000 - len(small["rows"])
    assert "fits" in cap_output({"ok": True, "x": "y" * 10_000}, 5000)["note"]


def test_containment(spark):
    values = spark.createDataFrame([("高橋 美咲",), ("ab",), ("123456",), ("090-1111-2222",), (None,), ("  ",)], "value string")
    forms = protected_forms(values)
    assert {"ab", "123456"}.isdisjoint(r["form"] for r in forms.collect())
    texts = spark.createDataFrame([(1, "高橋　美咲です"), (2, "harmless"), (3, "a 0901111 and 2222 b"), (4, ""), (5, None)], "k int, t string")
    for bits in (None, 8, 1 << 15):  # filters that let everything pass change nothing
        assert {r["key"] for r in contained(texts, forms, "k", "t", bits).collect()} == {"1", "3"}
    assert contained(texts, forms.limit(0), "k", "t").count() == 0 and contained(texts.limit(0), forms, "k", "t").count() == 0


def test_occurrences_against_a_search(spark, monkeypatch):
    """Every form of every length, at the edges of steps too, and once however often it stands there."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abé日\U0001f600 ", k=n))
    texts = [(str(i), word(rng.choice([0, 3, 40, 200, 700]))) for i in range(60)]
    forms = {t[a : a + n] for _, t in texts for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 90) for a in rng.sample(range(max(1, len(t))), min(2, max(1, len(t))))} - {""}
    forms |= {word(n) for n in range(1, 60)}
    want = {(k, f) for k, t in texts for f in forms if f in t}
    frame = spark.createDataFrame([(k, [t, t[:50]]) for k, t in texts], "key string, views array<string>")
    got = occurrence.occurring(frame, spark.createDataFrame([(f,) for f in forms], "form string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # the same in one process with steps that are shorter than the forms, and filters that hold what they have to and little more
    monkeypatch.setattr(occurrence, "STEP", 64)
    filters = [np.zeros(1 << 16, np.uint8) for _ in range(2)]
    for batch in occurrence._form_slots(1 << 19)([pa.RecordBatch.from_pydict({"form": sorted(forms)})]):
        for which, slot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            filters[which][slot >> 3] |= 1 << (slot & 7)
    shared = type("Shared", (), {"value": (*filters, sorted({len(f) for f in forms}))})
    found = {r for b in occurrence._candidates(shared)([pa.RecordBatch.from_pydict({"key": [k for k, _ in texts], "views": [[t] for _, t in texts]})]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert want <= found and len(found) < 1.2 * len(want)


def test_containment_of_forms_that_share_their_beginning(spark):
    forms = spark.range(20_000).select(F.format_string("Supplier#%09d", "id").alias("form"))
    texts = spark.createDataFrame([(1, "from Supplier#000000007 and Supplier#000019999, Supplier#000000007"), (2, "Supplier#000020000"), (3, None)], "k int, t string")
    assert {r["key"]: r["hits"] for r in contained(texts, forms, "k", "t").collect()} == {"1": 2}


def test_blocks(spark):
    blocks = [{"type": "text", "text": "a"}, {"type": "image", "data": 1}, {"type": "thinking", "text": "t"}, {"type": "tool_result", "content": [{"type": "text", "text": "b"}, {"type": "image"}]}, {"type": "tool_result", "content": "c"}, {"type": "tool_result", "content": [{"type": "audio"}]}]
    df = spark.createDataFrame([(json.dumps(blocks),), (json.dumps([{"type": "image"}]),)], "c string")
    got = df.select(content.block_texts(F.col("c")).alias("t"), content.apply_texts(F.col("c"), F.array(F.lit("A"), F.lit(None))).alias("w"), content.blocked_content(F.col("c")).alias("x")).collect()
    assert got[0]["t"] == ["a", "b", "c"] and got[0]["w"]["dropped"] == 3 and got[1]["t"] == []
    out = json.loads(got[0]["w"]["content"])
    assert [b["type"] for b in out] == ["text", "thinking", "tool_result", "tool_result", "tool_result"] and out[0]["text"] == "A" and out[2]["content"][0]["text"] == "b" and out[4]["content"][0]["text"] == content.DROPPED
    assert json.loads(got[1]["w"]["content"]) == [{"type": "text", "text": content.DROPPED}] and json.loads(got[0]["x"])[0]["text"] == content.BLOCKED
    args = spark.createDataFrame([('{"tool": "x", "q": {"a": 1}, "consent": true}',)], "e string").select(content.tool_args(F.col("e"))).first()[0]
    assert json.loads(args) == {"q": {"a": 1}}


def test_transcripts_and_streams(spark, tmp_path):
    lines = [
        {"message": {"content": "mail a@b.co.jp"}},
        {"message": {"content": [{"type": "text", "text": "c@d.co.jp"}, {"type": "tool_result", "content": "e@f.co.jp"}, {"type": "tool_result", "content": [{"type": "text", "text": "g@h.co.jp"}, {"type": "image"}]}, {"type": "thinking", "text": "no@no.co.jp"}]}},
        {"toolUseResult": {"x": "i@j.co.jp"}},
    ]
    box = tmp_path / "t"
    box.mkdir()
    (box / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n[1]\n")
    texts = files.transcript_texts(spark.read.text(str(box)).withColumn("file", F.lit("a")))
    assert sorted(r["text"] for r in texts.collect()) == sorted(["mail a@b.co.jp", "c@d.co.jp", "e@f.co.jp", "g@h.co.jp", '{"x":"i@j.co.jp"}'])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    incremental.scan_stream(spark, str(box), out, mark).awaitTermination()
    assert [(r["kind"], r["n"]) for r in spark.read.parquet(out).collect()] == [("EMAIL", 5)]
    (box / "b.jsonl").write_text(json.dumps(lines[0]))
    incremental.scan_stream(spark, str(box), out, mark).awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 5]
    by_file, code = sinks.report(spark.read.parquet(out))
    assert code == 1 and len(by_file) == 2


def test_masking_stream_keeps_its_tokens(spark, tmp_path):
    source, vault = tmp_path / "s", str(tmp_path / "vault")
    for i, mails in enumerate(["a@b.co.jp c@d.co.jp", "c@d.co.jp e@f.co.jp"]):
        spark.createDataFrame([(i, mails)], "k int, t string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k int, t string").parquet(str(source))
        incremental.mask_stream(stream, "k", "t", str(tmp_path / "o"), vault, str(tmp_path / "c"), b"k" * 32).awaitTermination()
    got = {r["key"]: r["text"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: "[EMAIL_1] [EMAIL_2]", 1: "[EMAIL_2] [EMAIL_3]"}


def test_weekly_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' as occurred_at, 'a' as event_type, 1L as user_id union all select timestamp'2024-01-07 23:00:00', 'a', 2L union all select timestamp'2024-01-08 00:00:00', 'a', 1L").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("occurred_at timestamp, event_type string, user_id long").parquet(str(tmp_path / "e"))
    query = incremental.weekly_stream(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n_events"] for r in spark.table("weekly").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", "x y")], "p string, q string")
    with pytest.raises(ValueError):
        sinks.write_safe(df, [], str(tmp_path / "x.csv"), "s")
    done = sinks.write_safe(df, [("p", "keep"), ("q", "keep"), ("r", "drop")], str(tmp_path / "x.tsv"), "s.csv")
    assert done["rows"] == 2 and done["columns"][2] == {"name": "r", "action": "drop"}
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "x.tsv"), sep="\t", header=True).na.fill("").collect()) == [("a", ""), ("b", "x y")]
    persons = spark.createDataFrame([("P1", ["高橋"], [], [], [], 1)], "id string, names array<string>, emails array<string>, phones array<string>, ids array<string>, position int")
    sinks.write_dictionary(persons, str(tmp_path / "d.json"), "now")
    assert (tmp_path / "d.json").stat().st_mode & 0o777 == 0o600 and files.read_dictionary(spark, str(tmp_path / "d.json")).first()["names"] == ["高橋"]
    assert files.read_dictionary(spark, str(tmp_path / "none.json")).count() == 0


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    for name, coding in (("a", "cp932"), ("b", "euc_jp"), ("c", "utf-8")):
        # the name's last bytes in EUC-JP are none of cp932
        name_ = "高橋" + b"\xeb\xa1".decode("euc_jp")
        body = "id,n\n" + "".join(f"{i},abc\n" for i in range(30_000)) + "30000,髙橋 美咲\n" * (coding != "euc_jp") + f"30001,{name_}\n"
        (tmp_path / f"{name}.csv").write_bytes(body.encode(coding))
        table, _ = files.read_delimited(spark, str(tmp_path / f"{name}.csv"))
        assert table.filter(F.col("n") == name_).count() == 1 and table.count() >= 30_001
        assert files.survey_lines(spark, str(tmp_path / f"{name}.csv")) == ({"cp932": "cp932", "euc_jp": "euc_jp", "utf-8": "utf-8-sig"}[coding], False)
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert files.survey_lines(spark, str(tmp_path / "q.csv"))[1]
    assert sorted(r["b"] for r in files.read_delimited(spark, str(tmp_path / "q.csv"))[0].collect()) == ["x\ny", "z"]
    assert files.head_lines(spark, str(tmp_path / "a.csv"), 2) == ["id,n", "0,abc"] and len(files.head_lines(spark, str(tmp_path / "a.csv"), 999)) == 200
    assert files.head_bytes(spark, str(tmp_path / "q.csv"), 3) == b"a,b"


def test_database_and_its_dictionary(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(3, "鈴木 凛"), (1, "佐藤 蓮"), (2, " ")], "ID int, NM string")
    rows.write.format("jdbc").options(url=url, dbtable="people", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    read = lambda q: files.jdbc(spark, url, q)
    assert sorted(r["ID"] for r in read("select ID from people where ID > 1;").collect()) == [2, 3]
    for change in ("delete from people", "drop table people", "insert into people values (4, 'x')"):
        with pytest.raises(Exception):
            read(change).collect()
    assert read("select ID from people").count() == 3
    monkeypatch.setattr(spark, "stop", lambda: None)
    query = "select ID, NM from people"
    assert main(["dictionary", url, "--query", query, "--id", "ID", "--names", "NM", "--out", str(tmp_path / "d.json")]) == 0
    assert [(r["id"], r["names"], r["ids"]) for r in files.read_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("P1", ["佐藤 蓮"], ["1"]), ("P2", [], ["2"]), ("P3", ["鈴木 凛"], ["3"])]
    assert main(["scan", str(tmp_path / "nowhere")]) == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.md").write_text("write to x@y.co.jp")
    assert main(["scan", str(tmp_path / "s"), "--dictionary", str(tmp_path / "d.json")]) == 1


def test_loading(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    spark.range(2).write.parquet(str(tmp_path / "a.parquet"))
    assert [files.load(spark, str(tmp_path / f"a.{s}")).count() for s in ("tsv", "jsonl", "json", "parquet")] == [1, 2, 2, 2]
    with pytest.raises(ValueError):
        files.load(spark, "x.doc")
    assert files.encoding_of("あ".encode("euc_jp")) in ("cp932", "euc_jp") and files.encoding_of(b"\x81") == "utf-8"
    table, sep = files.read_delimited(spark, str(tmp_path / "a.tsv"))
    assert sep == "\t" and table.collect()[0].asDict() == {"x": "1", "y": "2"}


def test_malformed_blocks_are_withheld(spark):
    deep = cur = []
    for _ in range(5):
        cur.append({"type": "tool_result", "content": []})
        cur = cur[0]["content"]
    cur.append({"type": "text", "text": "inner"})
    given = [json.dumps(deep), '[{"type": "text", "text": "secret"', "secret", '{"type": "text", "text": "secret"}', '["secret"]', '[{"type": "tool_result", "content": ["secret"]}]', None, "[]", "[" * 100_000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "k int, c string")
    rows = df.select("k", content.block_texts(F.col("c")).alias("t"), content.apply_texts(F.col("c"), F.array(F.lit("A")))["content"].alias("w"), content.blocked_content(F.col("c")).alias("x")).orderBy("k").collect()
    assert rows[0]["t"] == ["inner"] and "inner" not in rows[0]["w"] and '"A"' in rows[0]["w"] and rows[7]["w"] == "[]" and rows[6]["w"] is None
    for k in (1, 2, 3, 4, 5, 8):
        assert rows[k]["t"] is None and all("secret" not in rows[k][c] and content.BLOCKED in rows[k][c] for c in "wx"), k


def test_no_trace_is_left(engine, spark, tmp_path):
    """No text that a tool has stored on its way is there after it, nor after one that failed."""
    from pathlib import Path

    from quietlake.storage import scratch, shared_dir, written

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in shared.glob("quietlake-*")}
    assert engine.read_masked(files.file_id("customers.csv"), 3)["ok"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("to misaki@corp.jp")
    assert main(["scan", str(tmp_path / "x")]) == 1
    assert not engine.run_analysis(lambda d: written(spark.range(1), "here").selectExpr("raise_error('x')").collect())["ok"]
    with scratch(spark), scratch(spark):
        written(spark.range(1), "inner")
    assert {p.name for p in shared.glob("quietlake-*")} == before


def test_large_tables_are_no_result(engine):
    assert "error" in engine.run_analysis(lambda d: engine.spark.range(10_001))
