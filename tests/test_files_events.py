import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sieveline.functions import rules
from sieveline.operators import events, images
from sieveline.operators.control import verdict, with_control
from sieveline.plans.sweep import Options, report, scan, totals, trouble
from sieveline.sources import config, files, sessions
from sieveline.sources.state import State

KEY = "ghp_" + "a" * 36
BEGIN = "-----BEGIN PRIVATE KEY-----"


@pytest.fixture
def folder(tmp_path):
    def put(name, content, age=1000):
        p = tmp_path / "d" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content.encode() if isinstance(content, str) else content)
        os.utime(p, (time.time() - age,) * 2)
        return str(p)

    put.root, put.state = str(tmp_path / "d"), str(tmp_path / "state" / "s.json")
    return put


def run(spark, put, rule_list=None, write=True, roots=None, **more):
    o = Options(write=write, state_path=put.state, **more)
    results, errors = scan(spark, roots or [put.root], rule_list or rules.rule_set(), o)
    return {r["path"].removeprefix(put.root + "/"): r for r in results.collect()}, results, errors


def test_outcomes_in_order(spark, folder):
    folder("a.txt", f"x {KEY}\n"), folder("b.jsonl", json.dumps({"t": KEY}) + "\n"), folder("c.json", '{"a":1}\n{"b":"' + KEY + '"}')
    folder("clean.txt", "nothing"), folder("bad.txt", b"\xff\xfe"), folder("live.txt", KEY, 5), folder("future.txt", KEY, -5000), folder(".git/x", KEY), folder("orphan.txt", BEGIN), folder("both.txt", f"{KEY}\n{BEGIN}")
    os.symlink(folder.root + "/a.txt", folder.root + "/link.txt")
    got, results, errors = run(spark, folder, exclude=("*/.git/*",), roots=[folder.root, folder.root + "/no"])
    told = {k: r["skip_reason"] or r["outcome"] for k, r in got.items()}
    assert told == {"a.txt": "redacted", "b.jsonl": "redacted", "c.json": "redacted", "clean.txt": "clean", "bad.txt": "read_error", "live.txt": "possibly_live", "future.txt": "redacted", ".git/x": "excluded", "orphan.txt": "redacted", "both.txt": "redacted"}
    assert open(folder.root + "/a.txt").read() == "x [REDACTED-github-pat]\n" and open(folder.root + "/live.txt").read() == KEY
    assert errors == [(folder.root + "/no", "path does not exist")]
    lines, bad = report(results, errors, True)
    assert bad and "2 file(s) with unresolved markers" in lines[-1] and any("bad.txt skipped (read error)" in x for x in lines)
    again, _, _ = run(spark, folder, exclude=("*/.git/*",), live_window_s=0)
    told = {k: r["skip_reason"] or r["outcome"] for k, r in again.items()}
    assert told["a.txt"] == told["clean.txt"] == "unchanged" and told["orphan.txt"] == told["both.txt"] == "redacted"
    assert again["orphan.txt"]["from_state"] and not again["both.txt"]["from_state"] and again["orphan.txt"]["summary"]["orphan_begin"] == 1
    # other rules: what was kept for want of resolution is read again, clean stamps stand
    third, _, _ = run(spark, folder, [*rules.rule_set(), rules.simple("custom", "zzz")], live_window_s=0)
    assert not third["orphan.txt"]["from_state"] and third["clean.txt"]["skip_reason"] == "unchanged"


def test_dry_run_and_validation(spark, folder):
    folder("a.txt", KEY), folder("v.json", '{"a": "q"}'), folder("l.jsonl", '{"a": "q"}\n{"b": 1}')
    breaking = [rules.literal("bad", '"q"', "q"), *rules.rule_set()]
    got, results, _ = run(spark, folder, breaking, write=False)
    assert got["a.txt"]["outcome"] == "redacted" and not got["a.txt"]["written"] and open(folder.root + "/a.txt").read() == KEY
    assert got["v.json"]["outcome"] == "validation_failed" and got["l.jsonl"]["unsafe_lines"] == [1]
    assert trouble(totals(results, False)).first()["trouble"]
    assert "a.txt" not in str(State.load(folder.state, rules.fingerprint(breaking, True)).files)
    two, _, _ = run(spark, folder, [rules.simple("x", "zzz")], roots=[folder.root + "/a.txt", folder.root + "/a.txt"])
    assert len(two) == 1


def test_rewrite_refuses_a_changed_file(tmp_path):
    p = tmp_path / "f"
    p.write_text("old")
    os.chmod(p, 0o640)
    s = os.stat(p)
    assert files.replace_file(str(p), "new", s.st_mtime_ns - 1, s.st_size) is None
    assert files.replace_file(str(p), "new", s.st_mtime_ns, s.st_size, lambda phase: phase == "written" and p.write_text("grown!")) is None
    assert p.read_text() == "grown!" and os.listdir(tmp_path) == ["f"]
    s = os.stat(p)
    stamp = files.replace_file(str(p), "new", s.st_mtime_ns, s.st_size)
    assert p.read_text() == "new" and stamp == (os.stat(p).st_mtime_ns, 3) and os.stat(p).st_mode & 0o777 == 0o640


def test_state_file(tmp_path):
    p = str(tmp_path / "x" / "s.json")
    s = State("r1")
    s.record("/a", 1, 2)
    s.record("/b", 1, 2, {"orphan_begin": 1})
    s.save(p)
    assert State.load(p, "r1").files == s.files and set(State.load(p, "r2").files) == {"/a"}
    open(p, "w").write("{torn")
    assert State.load(p, "r1").files == {}


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[patterns]\ncustom = ["ok-[0-9]+", "(", "(?=x)y"]\n')
    some, problems = config.custom_rules(str(p))
    assert [(r.id, r.pattern) for r in some] == [("custom", "ok-[0-9]+")]
    assert [x.split("position ")[1][0] for x in problems] == ["2", "3"] and not any("(?=" in x for x in problems)
    assert config.custom_rules(str(tmp_path / "none"))[1] and config.custom_rules(str(tmp_path))[0] == []
    p.write_text("not toml [")
    assert "does not parse" in config.custom_rules(str(p))[1][0]


def event(response, **more):
    return json.dumps({"tool_response": response} | more)


def test_events(tmp_path):
    some = rules.secret_rules()
    pem = BEGIN + "\n{0}" + "A" * 64 + "\n{0}" + "B" * 64 + "\n{0}abc=\n{0}-----END PRIVATE KEY-----"
    r = events.filter_event(event({"stdout": KEY, "base64": KEY, "l": [1, None, {"k": KEY}]}), some)["hookSpecificOutput"]
    assert r["updatedToolOutput"] == {"stdout": "[REDACTED-github-pat]", "base64": KEY, "l": [1, None, {"k": "[REDACTED-github-pat]"}]} and "github-pat: 2" in r["additionalContext"]
    for prefix in ("", "12: ", "   7\t", "+", "# ", "f.txt:3:"):
        got = events.filter_event(event({"stdout": f"x {pem.format(prefix)}\nrest"}), some)
        assert got["hookSpecificOutput"]["updatedToolOutput"]["stdout"] == "x [REDACTED-private-key]\nrest", prefix
    escaped = pem.format("").replace("\n", "\\n")
    assert "[REDACTED-private-key]" in events.filter_event(event({"stdout": escaped}), some)["hookSpecificOutput"]["updatedToolOutput"]["stdout"]
    for clean in ({"stdout": "plain"}, {"stdout": BEGIN + "\nonly prose here"}, {"isImage": True, "stdout": KEY}, {"type": "image", "stdout": KEY}):
        assert events.filter_event(event(clean), some) is None
    assert events.filter_event(event({"isImage": "true", "stdout": KEY}), some)
    for bad in ("x", "[]", "{}", '{"tool_response": null}'):
        with pytest.raises(events.BadEvent):
            events.filter_event(bad, some)
    assert events.filter_event(event("plain"), some, problems=("p is off",))["hookSpecificOutput"]["additionalContext"] == "p is off"
    (tmp_path / events.MARKER).write_text("")
    assert events.filter_event(event(KEY, cwd=str(tmp_path / "sub")), some) is None
    assert events.filter_event(event(KEY, cwd=str(tmp_path), tool_input={"file_path": "/elsewhere/x"}), some)


def test_saved_copy(tmp_path):
    p = tmp_path / "projects" / "s" / "tool-results" / "o.txt"
    p.parent.mkdir(parents=True)
    p.write_bytes(b"\xff " + KEY.encode())
    r = events.filter_event(event({"stdout": "plain", "persistedOutputPath": str(p)}), rules.secret_rules(), str(tmp_path))["hookSpecificOutput"]
    assert KEY not in p.read_text() and "updatedToolOutput" not in r
    out = tmp_path / "o.txt"
    out.write_text(KEY)
    r = events.filter_event(event({"persistedOutputPath": str(out)}), rules.secret_rules(), str(tmp_path))["hookSpecificOutput"]
    assert "outside" in r["additionalContext"] and out.read_text() == KEY


def test_long_key_bodies_are_found_in_linear_time():
    body = "\n".join(["A" * 64] * 20_000)
    began = time.time()
    r = events.filter_event(event(f"{BEGIN}\n{body}\n-----END PRIVATE KEY-----"), rules.secret_rules())
    assert r["hookSpecificOutput"]["updatedToolOutput"] == "[REDACTED-private-key]" and time.time() - began < 20


def test_stream(spark, tmp_path):
    from sieveline.streaming import events as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(event(KEY) + "\nnope\n")
    got = []
    q = stream.run(stream.replies(stream.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "cp"), lambda df, _: got.extend(df.collect()))
    q.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text(event("plain") + "\n")
    q.processAllAvailable()
    q.stop()
    assert [(r["reply"] is not None, r["error"] is not None) for r in got] == [(True, False), (False, True), (False, False)]


def record(data, stamp="2024-01-01T00:00:00Z", **more):
    return json.dumps({"timestamp": stamp, "c": [{"type": "base64", "media_type": "image/png", "data": data}], "file": {"type": "image/png", "base64": data}} | more)


DATA = "ab/c" * 60


def test_image_lines(spark):
    old, young = record(DATA), record(DATA, "2030-01-01T00:00:00")
    cut = 1_800_000_000.0
    plan = images.planned(old, cut, 0)
    assert plan == images.Plan(frozenset([DATA]), 2, 2 * (len(DATA) - len(images.PLACEHOLDER)), 0) and images.planned(young, cut, 0).young == 2
    new = images.stripped(old, plan.due)
    assert new.count(images.PLACEHOLDER) == 2 and DATA not in new
    assert images.stripped(old.replace("/", "\\/"), plan.due) == new.replace("/", "\\/").replace(images.PLACEHOLDER.replace("/", "\\/"), images.PLACEHOLDER)
    assert images.planned("{broken", cut, 0) == images.Plan() and images.planned(new, cut, 0).fields == 0
    assert [p for p, _ in images.images_in(json.loads(old))] == [("file", "base64"), ("c", 0, "data")]
    with pytest.raises(ValueError):
        images.stripped(record(DATA, note=DATA), plan.due)
    assert images.seconds_of({"timestamp": "bad"}, 7.0) == 7.0 and images.seconds_of([], 8.0) == 8.0 and images.seconds_of({"timestamp": 5}, 9.0) == 9.0
    rows = images.strip_records(spark.createDataFrame([(old,), (young,), ("plain",), (None,), (record(DATA, note=DATA),)], "line string"), cut).collect()
    assert [r["fields"] for r in rows] == [2, 0, 0, 0, 0] and rows[1]["young"] == 2 and rows[4]["error"] and rows[3]["line"] is None


def test_image_sweep(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text(record(DATA) + "\nplain\n" + record(DATA, "2999-01-01T00:00:00Z") + "\n")
    os.utime(p, (time.time() - 9000,) * 2)
    rows, state = images.sweep_transcripts(spark, [str(tmp_path)], [])
    assert rows[0]["fields"] == 2 and rows[0]["young"] == 2 and state["files"] == {} and p.read_text().count("\n") == 3
    q = tmp_path / "u.jsonl"
    q.write_text("plain\n")
    os.utime(q, (time.time() - 9000,) * 2)
    _, state = images.sweep_transcripts(spark, [str(q)], [])
    assert list(state["files"]) == [str(q)] and images.sweep_transcripts(spark, [str(q)], [], state=state)[0] == []
    with pytest.raises(ValueError):
        images.sweep_transcripts(spark, [], [], max_age_h=float("nan"))
    r = tmp_path / "v.jsonl"
    r.write_text(record(DATA) + "\n" + record(DATA, note=DATA) + "\n")
    os.utime(r, (time.time() - 9000,) * 2)
    before = r.read_text()
    rows, _ = images.sweep_transcripts(spark, [str(r)], [])
    assert rows[0]["error"] and r.read_text() == before and sorted(os.listdir(tmp_path)) == ["t.jsonl", "u.jsonl", "v.jsonl"]
    assert images.image_report(rows)[1].startswith("images: ! ") and images.image_report([], (0, 0)) == [] and len(images.image_report([], dry_run=True)) == 1
    d = tmp_path / "cache" / "sub"
    d.mkdir(parents=True)
    for name in ("a.PNG", "b.txt"):
        (d / name).write_text("x")
    (d / "deep").mkdir()
    (d / "deep" / "c.jpg").write_text("yy")
    for f in (d / "a.PNG", d / "deep" / "c.jpg"):
        os.utime(f, (1, 1))
    assert images.sweep_cache(str(tmp_path / "cache"), time.time(), time.time(), [], dry_run=True) == (2, 3) and (d / "a.PNG").exists()
    assert images.sweep_cache(str(tmp_path / "cache"), time.time(), time.time(), []) == (2, 3) and os.listdir(d) == ["b.txt"]
    left = tmp_path / f".x.jsonl.{'a1' * 16}.tmp"
    left.write_text("")
    os.utime(left, (1, 1))
    assert images.reap(str(tmp_path), time.time(), [], "y.jsonl") == 0 and images.reap(str(tmp_path), time.time(), []) == 1


def test_sessions(tmp_path):
    sid = "0123abcd-4567"
    home = tmp_path / "projects" / "slug"
    (home / sid).mkdir(parents=True)
    (home / f"{sid}.jsonl").write_text("")
    (home / "other.jsonl").write_text("")
    (tmp_path / "image-cache" / sid).mkdir(parents=True)
    layout = sessions.Layout(str(tmp_path))
    payload = {"hook_event_name": "Stop", "session_id": sid, "transcript_path": str(home / f"{sid}.jsonl")}
    _, got, records = sessions.session_paths(payload, layout)
    assert got == sid and {k for k, p in records if p == str(home / f"{sid}.jsonl")} == {"T", "J"} and ("C", str(tmp_path / "image-cache" / sid)) in records and not any("other" in p for _, p in records)
    for bad in ([], {"hook_event_name": "Start"}, payload | {"session_id": sid + "\n"}, payload | {"session_id": "../x"}):
        with pytest.raises(ValueError):
            sessions.session_paths(bad, layout)
    (home / layout.marker).write_text("")
    assert {k for k, _ in sessions.session_paths(payload, layout)[2]} == {"C", "R"}
    (tmp_path / "projects" / "work[1]" / ".git").mkdir(parents=True)
    found = sessions.exclude_globs([str(tmp_path / "projects")], layout.marker)
    assert f"{tmp_path}/projects/slug/*" in found and f"{tmp_path}/projects/work[[]1[]]/*" in found and len(found) == len(sessions.NEVER) + 2
    with sessions.single_flight(str(tmp_path / "lock")), pytest.raises(sessions.Busy), sessions.single_flight(str(tmp_path / "lock")):
        pass
    assert [sessions.bounded_int(x, 50, 7) for x in ("08", "99", "x", "", "1234567")] == [8, 50, 7, 7, 7]


def test_control(spark):
    df = spark.createDataFrame([(KEY,), ("plain",)], "text string")
    left, told = with_control(spark, df, rules.rule_set())
    assert left.count() == 2 and tuple(verdict(told).first()) == (True, 1, 1, "findings")
    assert verdict(with_control(spark, df.where("text = 'plain'"), rules.rule_set())[1]).first()["outcome"] == "clean"
    assert verdict(with_control(spark, df, rules.rule_set("infra"))[1]).first()["outcome"] == "control_failed"


def test_kinds(spark):
    some = [("a.jsonl", "x"), ("b.json", "{}"), ("c.json", "{}\n[]\n"), ("d.json", "x"), ("e.JSON", "{}"), ("/x.json/f", "{}"), (".json", "{}")]
    got = [r[0] for r in spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(some)], "i int, p string, t string").orderBy("i").select(files.detected_kind(F.col("p"), F.col("t"))).collect()]
    assert got == ["jsonl", "json", "jsonl", "text", "text", "text", "text"]
