import json
import zipfile

import pytest

from loomline.functions import canonical
from loomline.operators import archives, audits, imports, upkeep
from loomline.sources import containers, provider_exports


def test_zip_entries_and_refusals(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("conversations.json", "[]")
        z.writestr("../up.json", "x")
        z.writestr("big.bin", b"0" * 5000)
        z.writestr("lzma.bin", b"1", compress_type=zipfile.ZIP_LZMA)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    found = {r.name: r for r in containers.zip_entries(spark, str(tmp_path), 1000).collect()}
    assert bytes(found["conversations.json"].content) == b"[]"
    assert {k: r.refused for k, r in found.items()} == {"conversations.json": None, "../up.json": "path", "big.bin": "size", "lzma.bin": "method", None: "archive"}


def test_stream_records():
    found = list(containers.records("id: 7\ndata: a\ndata: b\n\n: note\n\nevent: x\rdata\r\rdata: cut"))
    assert found == [("message", "a\nb", "7"), ("x", "", None)]
    assert list(containers.records("")) == []


def test_canonical_json():
    assert canonical.sorted_json('{"b": [1, {"z": 1, "a": "é"}], "a": null}') == '{"a":null,"b":[1,{"a":"é","z":1}]}'
    assert canonical.sorted_json("{") is None and canonical.sorted_json(None) is None
    assert canonical.sorted_json('{"title": 1, "x": {"title": 2}}', canonical.MUTABLE) == '{"x":{"title":2}}'


def test_provider_files(spark, tmp_path):
    lists = [{"uuid": "t", "chat_messages": [{"uuid": "a", "sender": "human", "text": "old"}, {"uuid": "b", "sender": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "other"}], "created_at": "bad"}]}]
    (tmp_path / "conversations-1.json").write_text(json.dumps(lists))
    (tmp_path / "users.json").write_text("[{}]")
    rows = {r.node: r for r in provider_exports.message_lists(provider_exports.conversations(spark, str(tmp_path))).collect()}
    assert (rows["a"].role, rows["a"].parent, rows["a"].text) == ("user", None, "old")
    assert (rows["b"].parent, rows["b"].inferred, rows["b"].text, rows["b"].created_ms) == ("a", True, "x", None)


def test_structural_chains_and_loops(spark):
    nodes = spark.createDataFrame([("r", None, True), ("s", "r", True), ("a", "s", False), ("t", "a", True), ("u", "t", True), ("b", "u", False), ("c", "gone", False), ("x", "y", True), ("y", "x", True), ("d", "x", False)], "node string, parent string, structural boolean")
    assert {r.node: r.parent for r in imports.lift_over_structural(nodes).collect()} == {"a": None, "b": "a", "c": None, "d": None}
    codes = {(r.node, r.code) for r in imports.warnings(nodes).collect()}
    assert ("c", "missing_parent") in codes and {n for n, c in codes if c == "cyclic_parent"} == {"x", "y", "d"}


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    folder = str(tmp_path / "out")
    archives.export({"notes": df, "more": df.where("id = 1")}, folder)
    assert {r.collection: r.outcome for r in archives.verify(spark, folder).collect()} == {"notes": "ok", "more": "ok"}
    spark.createDataFrame([("extra",)], "value string").write.mode("append").text(f"{folder}/records/collection=more")
    assert {r.collection: r.outcome for r in archives.verify(spark, folder).collect()} == {"notes": "ok", "more": "changed"}


@pytest.mark.parametrize("affects, finding", [("[1]", None), ("[]", None), ("[2]", "sync_affects_missing"), ("{}", "sync_affects_malformed"), ("?", "sync_affects_malformed"), (None, "sync_affects_malformed")])
def test_affected(spark, affects, finding):
    log = spark.createDataFrame([(5, affects)], "id long, affects string")
    found = [r.finding for r in audits.affected(log, spark.createDataFrame([(1,)], "id long")).collect()]
    assert found == ([finding] if finding else [])


def test_dirty_ignores_other_fields(spark):
    a = spark.createDataFrame([(1, "t", 1), (2, None, 1)], "id long, title string, size int")
    b = spark.createDataFrame([(1, "t", 2), (2, "n", 1), (3, None, 1)], "id long, title string, size int")
    assert {r.id: r.change for r in upkeep.dirty(a, b, "document").collect()} == {2: "changed", 3: "created"}
