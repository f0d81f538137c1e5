"""Delimited files: whole headers, quoted line feeds over many splits, encodings, against Python's csv."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quietlake.engine import main
from quietlake.sources import delimited, files


def _expected(text: str, sep: str = ",") -> list[tuple]:
    csv.field_size_limit(1 << 40)
    header, *rows = [r for i, r in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=sep)) if r or i == 0]
    return [tuple([*r, *[""] * len(header)][: len(header)]) for r in rows]


def _rows(table):
    return [tuple(r)[:-1] for r in table.orderBy("__at").collect()]


def _read(spark, path):
    return files.read_delimited(spark, str(path), place="__at")


def test_state_of_lines():
    """The state after each line is that of a character-by-character reading."""

    def slow(line, state):
        where = "quoted" if state else "start"
        for c in line:
            if where == "quoted":
                where = "closed" if c == '"' else where
            elif where == "closed" and c == '"':
                where = "quoted"
            elif c == ",":
                where = "start"
            elif where == "start" and c == '"':
                where = "quoted"
            else:
                where = "plain"
        return int(where == "quoted")

    rng, quotes = random.Random(1), delimited.Quotes(",")
    for _ in range(20_000):
        line = "".join(rng.choices('",a ', k=rng.randint(0, 12)))
        for state in (0, 1):
            assert quotes.after(line, state) == slow(line, state), (line, state)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_feeds_over_many_splits(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(delimited, "LEAST_SPLIT", 211)
    monkeypatch.setattr(delimited, "LARGEST_SPLIT", 211)
    rng = random.Random(seed)
    cell = lambda: rng.choice(["x", "", 'say "hi"', "two\nlines", "a,b", '5" pipe', "日本\n語", "long " * 60 + "\n" + "y" * 300, '"', "\n\n"])
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    writer.writerow(["a", "b\nc" if seed % 2 else "b", "d" * (250 if seed == 3 else 1)])
    for _ in range(60):
        writer.writerow([cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))])
    text = out.getvalue() + ('7" loose,x,y\n"open at the end,\nz' if seed == 2 else "")
    (tmp_path / "t.csv").write_text(text, encoding="utf-8", newline="")
    table, sep = _read(spark, tmp_path / "t.csv")
    assert sep == "," and _rows(table) == _expected(text)
    inner = delimited._fixed_cuts(spark, len(text.encode()))
    assert inner.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 15


def test_wide_headers_and_free_names(spark, tmp_path):
    names = [f"column_{i}" for i in range(9000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(9000))) + "\n")
    table, _ = files.read_delimited(spark, str(tmp_path / "wide.csv"))
    assert table.columns == names
    row = table.select("column_0", "column_8999").first()
    assert tuple(row) == ("0", "8999")
    (tmp_path / "same.csv").write_text('a,a,a_1\n1,2,3\n"4",5\n')
    table, _ = _read(spark, tmp_path / "same.csv")
    assert table.columns == ["a", "a_1_", "a_1", "__at"] and _rows(table) == [("1", "2", "3"), ("4", "5", "")]
    assert files.free_names(["x", "x", "x", "x_1_", "x_2"]) == ["x", "x_1", "x_2_", "x_1_", "x_2"]


def test_headers_without_an_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"never,closed\n1,2\n')
    with pytest.raises(ValueError, match="no end"):
        files.read_delimited(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("")
    assert files.read_delimited(spark, str(tmp_path / "b.csv"))[0].columns == []
    (tmp_path / "c.csv").write_text("only,header")
    table, _ = files.read_delimited(spark, str(tmp_path / "c.csv"))
    assert table.columns == ["only", "header"] and table.count() == 0


@pytest.mark.parametrize(("encoding", "text"), [("cp932", '氏名|件数\n髙橋|3\n"改\n行"|4\nソ表|5\n'), ("euc_jp", "氏名,件数\n高橋,3\n"), ("utf-8-sig", "氏名,件数\n高橋,3\n"), ("utf-8", "a,b\r1,2\r3,4\r")])
def test_encodings_and_feeds(spark, tmp_path, encoding, text):
    (tmp_path / "t.csv").write_bytes(text.encode(encoding))
    before = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    table, sep = _read(spark, tmp_path / "t.csv")
    assert _rows(table) == _expected(text, sep) and not table.columns[0].startswith("﻿")
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == before


def test_another_cut_is_an_error():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"x"]), pa.array([5], pa.int64())], names=["line", "start"])
    with pytest.raises(RuntimeError, match="cut in another way"):
        list(delimited._records([batch], ",", "utf-8", "\n", {0: delimited.Split(0, None, False)}))


PERSON = {"id": "P1", "names": ["Takahashi Misaki"], "emails": [], "phones": [], "ids": []}


@pytest.mark.parametrize("damage", [lambda t: t[:-1], lambda t: t[:-2], lambda t: "", lambda t: "{}", lambda t: '{"persons": null}', lambda t: '{"persons": "x"}', lambda t: t.replace("]", "", 1)])
def test_damaged_dictionaries_are_errors(spark, tmp_path, capsys, damage):
    """Nothing that can't be read whole may look as if no person were known."""
    box, dictionary = tmp_path / "box", tmp_path / "d.json"
    box.mkdir()
    (box / "a.txt").write_text("met Takahashi Misaki today")
    dictionary.write_text(damage(json.dumps({"generated": "x", "persons": [PERSON]})))
    assert main(["scan", str(box), "--dictionary", str(dictionary)]) == 2
    assert "Takahashi" not in capsys.readouterr().err


def test_exit_codes(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"generated": "x", "persons": [PERSON]}))
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.txt").write_text("met Takahashi Misaki today")
    assert main(["scan", str(tmp_path / "box"), "--dictionary", str(tmp_path / "d.json")]) == 1
    assert main(["scan", str(tmp_path / "nowhere")]) == 2
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("nothing here")
    assert main(["scan", str(tmp_path / "none")]) == 0
    assert main(["scan", str(tmp_path / "none"), "--since", "no date"]) == 2


def test_dictionary_tool_keeps_the_files_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "LEAST_SPLIT", 64)
    monkeypatch.setattr(delimited, "LARGEST_SPLIT", 64)
    rows = [(f"u{i}", f'Name\n"{i}" of many') for i in range(25)]
    with open(tmp_path / "p.csv", "w", newline="") as f:
        csv.writer(f).writerows([("uid", "full"), *rows])
    assert main(["dictionary", str(tmp_path / "p.csv"), "--out", str(tmp_path / "d.json"), "--id", "uid", "--names", "full"]) == 0
    persons = json.loads((tmp_path / "d.json").read_text())["persons"]
    assert [(p["id"], p["ids"][0], p["names"][0]) for p in persons] == [(f"P{i}", *r) for i, r in enumerate(rows, 1)]


def test_white_space_of_any_kind(spark):
    from quietlake.operators.deidentify import safe_pseudo, year_of

    got = spark.createDataFrame([("\t",), ("　 ",), ("\x1c2020-01-02",), ("\t1999/3/4　",), ("x",)], "v string").select(safe_pseudo(F.col("v"), b"k").alias("p"), year_of(F.col("v")).alias("y")).collect()
    assert [(bool(r["p"]), r["y"]) for r in got] == [(False, ""), (False, ""), (True, "2020"), (True, "1999"), (True, "")]
