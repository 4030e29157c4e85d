"""Large JSON arrays cut by byte ranges, against the parser of the standard library."""

import json
import random

import pytest

from loomline.sources import json_arrays


def made(rng, deep=0):
    kind = rng.randrange(7 if deep < 4 else 4)
    if kind < 2:
        return "".join(rng.choice('ab"\\{}[],: é\U0001f600\n') for _ in range(rng.randrange(30)))
    if kind < 4:
        return rng.choice([1, -2.5, True, None, "\\", '\\"', "}", "]"])
    return [made(rng, deep + 1) for _ in range(rng.randrange(5))] if kind == 4 else {made_key(rng): made(rng, deep + 1) for _ in range(rng.randrange(5))}


def made_key(rng):
    return "".join(rng.choice('kl"\\}{ ') for _ in range(rng.randrange(1, 5)))


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Ranges of 600 bytes and steps of 64, so strings, escapes and elements lie across both."""
    names = {"spark.sql.files.maxPartitionBytes": "600b", "spark.sql.files.openCostInBytes": "1b"}
    for name, value in names.items():
        spark.conf.set(name, value)
    monkeypatch.setattr(json_arrays, "STEP", 64)
    yield
    for name in names:
        spark.conf.unset(name)


def check(found, files):
    rows = {}
    for r in found.collect():
        assert r.path == f"$[{r.ordinal}]"
        name = r.file.rsplit("/", 1)[1]
        data = files[name]
        assert data[r.offset : r.offset + r.bytes] == r.value.encode()
        assert r.ordinal not in rows.setdefault(name, {})
        rows[name][r.ordinal] = json.loads(r.value)
    return rows


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_elements_of_random_arrays(spark, tmp_path, monkeypatch, small_ranges, broadcast):
    monkeypatch.setattr(json_arrays, "BROADCAST_RANGES", broadcast)
    rng = random.Random(5)
    wanted = {f"{k}.json": [made(rng) for _ in range(n)] for k, n in enumerate((0, 1, 40, 150))}
    files = {name: json.dumps(v, ensure_ascii=k % 2 == 0, indent=(None, 2, None, 1)[k]).encode() for k, (name, v) in enumerate(wanted.items())}
    files["1.json"] = b"\xef\xbb\xbf" + files["1.json"] + b"\n"
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    assert json_arrays.pieces(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
    rows = check(json_arrays.elements(spark, str(tmp_path)), files)
    assert rows == {name: dict(enumerate(v)) for name, v in wanted.items() if v}
    assert json_arrays.faults(spark, str(tmp_path)).isEmpty()


def test_one_element_across_many_ranges(spark, tmp_path, small_ranges):
    value = [{"a": ["}" * 40 + '"' * 3 + "\\" * 5] * 200}, 2, "}{" * 3000, {}]
    (tmp_path / "a.json").write_text(json.dumps(value))
    rows = check(json_arrays.elements(spark, str(tmp_path)), {"a.json": json.dumps(value).encode()})
    assert rows == {"a.json": dict(enumerate(value))}


def test_files_that_are_cut_off_or_hold_no_array(spark, tmp_path, small_ranges):
    whole = json.dumps([{"k": "v" * 90, "n": [n]} for n in range(30)])
    texts = {"cut.json": whole[:-100], "open.json": whole[:-1], "brace.json": whole[:-1] + "}", "object.json": '{"a": [1, 2]}', "word.json": "x", "empty.json": "", "blank.json": " \n", "none.json": " [ \n ] ", "two.json": "[1,[2]] [3]\n", "fine.json": whole}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    assert {r.file.rsplit("/", 1)[1]: r.fault for r in json_arrays.faults(spark, str(tmp_path)).collect()} == {
        "cut.json": "unbalanced", "open.json": "unbalanced", "object.json": "not_an_array", "word.json": "not_an_array", "blank.json": "not_an_array"
    }
    rows = check(json_arrays.elements(spark, str(tmp_path)), {k: v.encode() for k, v in texts.items()})
    assert set(rows) == {"cut.json", "open.json", "brace.json", "two.json", "fine.json"}
    assert rows["two.json"] == {0: 1, 1: [2], 2: 3} and len(rows["fine.json"]) == 30 and len(rows["open.json"]) == 29
    assert all(value == json.loads(whole)[k] for name in ("cut.json", "open.json", "brace.json") for k, value in rows[name].items() if k < 29)


def walk(value, path):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}[{json.dumps(k)}]")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, f"{path}[{k}]")
    else:
        yield path, value


def test_scalars_of_elements(spark, tmp_path, small_ranges):
    rng = random.Random(8)
    value = [made(rng) for _ in range(80)]
    data = json.dumps(value, indent=1).encode()
    (tmp_path / "a.json").write_bytes(data)
    found = sorted(json_arrays.leaves(json_arrays.elements(spark, str(tmp_path))).collect(), key=lambda r: r.offset)
    assert [(r.path, json.loads(data[r.offset : r.offset + r.bytes])) for r in found] == list(walk(value, "$"))
    names = {str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
    assert [r.kind for r in found] == [names[type(v)] for _, v in walk(value, "$")]


def test_written_arrays_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(n, json.dumps({"n": n, "t": '}"'})) for n in range(50)], "n long, text string")
    json_arrays.write(rows, str(tmp_path / "out"), "n", "text", share=7)
    found = json_arrays.elements(spark, str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["n"] for r in found.collect()) == list(range(50))
    assert found.select("file").distinct().count() > 3
