"""State over runs, what is said of files, totals that follow a stream, and free text."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from scansmith import export
from scansmith.functions import text as T
from scansmith.operators import findings as R
from scansmith.plans import folder
from scansmith.plans.scan import ScanOptions, scan
from scansmith.sources import files as S
from scansmith.sources import state as K
from scansmith.streaming import incremental as I


def numbers(spark, path):
    return K.KeyedState(spark, str(path), "key string, n bigint", lambda t: t.groupBy("key").agg(F.sum("n").alias("n")))


def test_state_is_one_row_a_key_at_any_version(spark, tmp_path):
    state = numbers(spark, tmp_path / "s")
    assert state.version() == -1 and state.read().count() == 0
    draw, expected = random.Random(3), {}
    for k in range(24):
        rows = {draw.choice("abcdefgh"): draw.randrange(9) for _ in range(draw.randrange(4))}
        assert state.add(spark.createDataFrame(list(rows.items()), "key string, n bigint").coalesce(1)) == k
        for key, n in rows.items():
            expected[key] = expected.get(key, 0) + n
        if k % 5 == 0 or k == 23:
            assert sorted(map(tuple, state.read().collect())) == sorted(expected.items())
        names = os.listdir(tmp_path / "s")
        assert sum(n.startswith("v-") and n.endswith(".json") for n in names) <= 2
        assert sum(n.startswith("t-") for n in names) <= 2 * (K.MOST_DELTAS + 1) + 1
        assert len(state._manifest(k)["tables"]) <= K.MOST_DELTAS + 1


def test_a_version_counts_once_and_a_failed_one_not_at_all(spark, tmp_path):
    state = numbers(spark, tmp_path)
    row = spark.createDataFrame([("a", 2)], "key string, n bigint")
    assert state.add(row, 4) == 4 and state.add(row, 4) == 4 and state.add(row, 3) == 4
    with pytest.raises(Exception, match="lost"):
        state.add(row.withColumn("n", F.raise_error(F.lit("lost")).cast("bigint")))
    assert state.version() == 4 and state.read().first() == ("a", 2)
    with pytest.raises(Exception, match="[Ee]xist"):  # another writer was first
        state._commit(4, [])
    assert state.read().first() == ("a", 2) and not [n for n in os.listdir(tmp_path) if n.startswith(".") and not n.endswith(".crc")]
    assert state.add(row) == 5 and state.read().first() == ("a", 4)
    assert state.add(row) == 6 and sum(n.startswith("t-") for n in os.listdir(tmp_path)) == 3  # that of the failed run is gone


def test_folder_state_stays_small_and_runs_tell_of_files(spark, tmp_path, monkeypatch):
    root, out, cache = (tmp_path / x for x in ("root", "out", "cache"))
    root.mkdir()
    monkeypatch.setattr(S, "MAX_FILE_BYTES", 200)
    (root / "a.js").write_bytes(b'x="/admin"')
    (root / "bad.js").write_bytes(b'x="/lo\xffgin"')
    (root / "big.js").write_bytes(b'x="/token"' + b" " * 200)
    run = lambda: folder.scan_run(spark, str(root), str(out), ScanOptions(categories=("endpoints",)), cache=str(cache))
    found, told = run()
    assert sorted(r["value"] for r in found.collect()) == ["/admin", "/login"]
    assert told == {"run": 0, "files": 3, "bytes": 10 + 11 + 210, "too_large": 1, "no_text": 1}
    name = lambda p: p.rsplit("/", 1)[1]
    assert {(name(r["path"]), r["error"]) for r in folder.rejects(spark, str(out), 0).collect()} == {("bad.js", S.NO_TEXT), ("big.js", S.TOO_LARGE)}
    assert json.loads("".join(export.json_report(found, export.metadata("t", run=told))))["meta"]["run"]["too_large"] == 1
    for k in range(1, 12):
        (root / "a.js").write_text(f'x="/admin/{k}"; x="/login"')
        found, told = run()
        assert sorted(r["value"] for r in found.collect()) == [f"/admin/{k}", "/login"] and told["run"] == k and told["files"] == 2  # the large one is told of again
    tables = folder.checksums(spark, str(cache))._manifest(11)["tables"]
    assert len(tables) <= K.MOST_DELTAS + 1
    assert {name(r["path"]) for r in folder.remembered(spark, str(cache)).collect()} == {"a.js", "bad.js"}
    assert run()[1]["files"] == 1 and folder.checksums(spark, str(cache)).version() == 11


def test_text_of_bytes(spark):
    rows = spark.createDataFrame([(b"a\xffb\r\nc",), ("� é\r".encode(),), (b"",), (None,)], "content binary")
    assert [r[0] for r in rows.select(S.decoded(F.col("content"))).collect()] == ["ab\nc", "� é\n", "", None]


def test_manifests_that_are_none(spark):
    texts = [("ok", '{"name":"n","dependencies":{"a":"1"}}'), ("bad", "{not json"), ("list", "[]"), ("number", "3"), ("shape", '{"name":"m","dependencies":[1]}'), ("empty", ""), ("null", None), ("bare", "{}")]
    df = spark.createDataFrame(texts, "path string, text string")
    assert {r["path"]: (r["name"], r["dependencies"]) for r in S.manifests(df).collect()} == {"ok": ("n", {"a": "1"}), "shape": ("m", {}), "bare": ("unknown", {})}
    errors = {r["path"]: r["error"] for r in S.manifest_errors(df).collect()}
    assert errors == dict.fromkeys(("bad", "list", "number", "empty", "null"), "no JSON object") | {"shape": "a field of another shape"}


def test_totals_follow_a_stream(spark, tmp_path):
    src, out, state, totals = (str(tmp_path / x) for x in ("src", "out", "state", "totals"))
    os.mkdir(src)
    texts = {f"f{k}.js": f'x="/admin"; fetch("/api/v{k % 3}/users/"); m="ops@acme{k % 2}.io"' for k in range(9)}
    for k, (name, text) in enumerate(texts.items()):
        with open(f"{src}/{name}", "w") as f:
            f.write(text)
        if k % 4 == 0:
            I.scan_stream(spark, src, out, state, totals=totals).awaitTermination()
    whole = scan(S.documents(S.script_files(spark, src)))
    own = I.running(spark, totals)
    columns = ["category", "value", "source", "line", "type", *R.INSERTION]
    assert sorted(map(repr, I.running_findings(own).select(columns).collect())) == sorted(map(repr, R.deduplicate(whole).select(columns).collect()))
    n = {r["category"]: r["n"] for r in R.category_totals(whole).collect()}
    kept = {r["category"]: r["n"] for r in R.category_totals(R.deduplicate(whole)).collect()}
    assert {r["category"]: (r["n"], r["kept"]) for r in I.running_totals(own).collect()} == {c: (n[c], kept[c]) for c in n}
    last = own.version()
    assert I.follow(own, spark.read.parquet(f"{out}/batch={last}"), last) == last  # a batch repeated after a restart
    assert {r["category"]: r["n"] for r in I.running_totals(own).collect()} == n


def test_free_text_redaction(spark):
    draw = random.Random(5)
    heads = ["ghp_", "gho_", "sk_live_", "pk_live_", "sk_test_", "AKIA", "xoxb-", "xox-", "eyJ", "sk-", "Bearer ", "Bearer  \t", "Bearer", "akia"]
    texts = ["".join(draw.choice([draw.choice(heads), "".join(draw.choices("aZ9_-./+=", k=draw.randrange(12))), draw.choice([" ", "\n", "é", '"'])]) for _ in range(draw.randrange(12))) for _ in range(1500)]
    texts += ["", None, "AKIA" + "B" * 8, "AKIA" + "B" * 9, "sk-" + "c" * 8, "x" * 100_000 + "ghp_" + "d" * 100_000]
    show = lambda m: m[0][:2] + "..." + m[0][-2:] if len(m[0]) <= 12 else m[0][:4] + "..." + m[0][-4:]
    plain = lambda t: None if t is None else re.sub(T.SECRET_LIKE, show, t)
    out = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.redacted_text(F.col("t")).alias("t"), T.script_string(F.col("t")).alias("js")).collect()
    assert [r["t"] for r in sorted(out)] == [plain(t) for t in texts]
    assert sum(plain(t) != t for t in texts) > 300


def test_script_strings(spark):
    s = "a\\b'c\"d\n\r</script>"
    assert spark.range(1).select(T.script_string(F.lit(s))).first()[0] == "a\\\\b\\'c\\\"d\\n\\r\\x3c/script\\x3e"
