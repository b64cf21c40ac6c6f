"""Command lines, and the orchestration of session and full sweeps."""

import io
import json
import os
import time

import pytest

from sieveline import __main__ as cli
from sieveline import version
from sieveline.functions import rules
from sieveline.plans import session as S
from sieveline.sources import sessions

KEY = "ghp_" + "a1B2" * 9
SID = "0123abcd-4567"


@pytest.fixture
def place(tmp_path, monkeypatch):
    """A folder of sessions with a secret in one transcript, and a state folder of its own."""
    home = tmp_path / "root" / "projects" / "slug"
    home.mkdir(parents=True)
    (home / f"{SID}.jsonl").write_text(json.dumps({"t": KEY}) + "\n")
    os.utime(home / f"{SID}.jsonl", (1, 1))
    monkeypatch.setenv("XDG_STATE_HOME", str(tmp_path / "state"))
    return tmp_path


def run(args, monkeypatch, capsys, stdin=""):
    monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    code = cli.main([str(a) for a in args])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_sweep_command(spark, place, monkeypatch, capsys):
    f = place / "a.txt"
    f.write_text(f"key {KEY}\n")
    os.utime(f, (1, 1))
    assert run(["sweep"], monkeypatch, capsys)[0] == 64
    assert run(["sweep", f, "--exclude", "[x"], monkeypatch, capsys)[0] == 1
    code, out, _ = run(["sweep", f], monkeypatch, capsys)
    assert code == 0 and "[dry-run] 1 redaction(s)" in out and KEY in f.read_text()
    code, out, _ = run(["sweep", f, "--write"], monkeypatch, capsys)
    assert code == 0 and "[written]" in out and f.read_text() == "key [REDACTED-github-pat]\n"
    code, _, err = run(["sweep", place / "none"], monkeypatch, capsys)
    assert code == 1 and "none" in err


def test_filter_command(place, monkeypatch, capsys):
    code, out, _ = run(["filter"], monkeypatch, capsys, json.dumps({"tool_response": {"stdout": KEY}}))
    assert code == 0 and json.loads(out)["hookSpecificOutput"]["updatedToolOutput"] == {"stdout": "[REDACTED-github-pat]"}
    assert run(["filter"], monkeypatch, capsys, json.dumps({"tool_response": {"stdout": "plain"}})) == (0, "", "")
    code, out, err = run(["filter"], monkeypatch, capsys, "{" + KEY)
    assert code == 1 and not out and err and KEY not in err
    bad = place / "c.toml"
    bad.write_text("patterns = 3")
    code, out, _ = run(["filter", "--config", bad], monkeypatch, capsys, json.dumps({"tool_response": "plain"}))
    assert code == 0 and "custom patterns are off" in out


def test_images_command(spark, place, monkeypatch, capsys):
    t = place / "t.jsonl"
    t.write_text(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "m": {"type": "base64", "media_type": "image/png", "data": "abcd" * 60}}) + "\n")
    os.utime(t, (1e9, 1e9))
    with pytest.raises(SystemExit):
        run(["images", "--max-age-hours", "nan"], monkeypatch, capsys)
    capsys.readouterr()
    assert run(["images", "--scoped"], monkeypatch, capsys) == (0, "", "")
    code, out, _ = run(["images", "--transcript", t, "--dry-run"], monkeypatch, capsys)
    assert code == 0 and "images [dry-run]: 1 payload(s) in 1 transcript(s)" in out and "abcd" * 60 in t.read_text()
    code, out, _ = run(["images", "--transcript", t], monkeypatch, capsys)
    assert code == 0 and out.startswith("images: 1 payload(s)") and "abcd" * 60 not in t.read_text()
    os.utime(t, (1e9, 1e9))
    assert run(["images", "--transcript", t], monkeypatch, capsys) == (0, "", "")


def test_session_command(spark, place, monkeypatch, capsys):
    monkeypatch.setenv("SIEVELINE_SETTLE_SECS", "0")
    t = place / "root" / "projects" / "slug" / f"{SID}.jsonl"
    event = lambda name: json.dumps({"hook_event_name": name, "session_id": SID})
    code, out, _ = run(["session", "--root", place / "root"], monkeypatch, capsys, event("Stop"))
    assert code == 0 and "1 total redaction(s)" in json.loads(out)["systemMessage"] and KEY not in t.read_text()
    os.utime(t, (1, 1))
    assert run(["session", "--root", place / "root"], monkeypatch, capsys, event("Stop"))[:2] == (0, "")
    code, out, _ = run(["session", "--root", place / "root"], monkeypatch, capsys, "{}")
    assert code == 0 and "nothing was swept" in json.loads(out)["systemMessage"]
    t.write_text(json.dumps({"t": KEY}) + "\n")
    os.utime(t, (1, 1))
    code, out, _ = run(["session", "--root", place / "root", "--all"], monkeypatch, capsys)
    assert code == 0 and "1 total redaction(s)" in out and "1 file(s) with matches" in out
    monkeypatch.setenv("SIEVELINE_LOCK_WAIT_SECS", "0")
    with sessions.single_flight(str(place / "state" / "sieveline" / "sweep.lock"), 0, "pid 1 test"):
        code, out, err = run(["session", "--root", place / "root", "--all"], monkeypatch, capsys)
        assert code == 75 and "pid 1 test" in err
        assert run(["session", "--root", place / "root"], monkeypatch, capsys, event("Stop"))[:2] == (0, "")


def test_last_pass_is_logged_and_the_log_rotates(spark, place):
    payload, layout, state = {"hook_event_name": "SessionEnd", "session_id": SID}, sessions.Layout(str(place / "root")), str(place / "s")
    slept = []
    told = S.session_sweep(spark, payload, layout, state, True, S.Waits(5, 0, 5), slept.append)
    assert told.found and slept == [5, 6]
    S.log_run(state, "one", told, 0)
    log = os.path.join(state, "sweep.log")
    with open(log, "a") as f:
        f.write("x" * S.LOG_BYTES)
    S.log_run(state, "two", told, 0)
    S.log_run(state, "three", S.Told(), 0)
    with open(log) as f, open(f"{log}.1") as g:
        assert f.read().startswith("1970-01-01T00:00:00Z two\n") and g.read().startswith("1970-01-01T00:00:00Z one\n")
    with sessions.single_flight(os.path.join(state, "sweep.lock")):
        assert "not swept" in S.session_sweep(spark, payload, layout, state, True, S.Waits(0, 0, 5)).lines[0]


def test_a_newer_run_takes_over_and_paths_are_looked_up_again(spark, place):
    payload, layout, state = {"hook_event_name": "Stop", "session_id": SID}, sessions.Layout(str(place / "root")), str(place / "s")
    t = place / "root" / "projects" / "slug" / f"{SID}.jsonl"
    told = S.session_sweep(spark, payload, layout, state, waits=S.Waits(0, 0, 5), sleep=lambda _: S.claim(os.path.join(state, "sessions", SID)))
    assert told == S.Told() and KEY in t.read_text()

    def swap(_):
        other = place / "other"
        t.rename(other)
        t.symlink_to(other)

    S.session_sweep(spark, payload, layout, state, waits=S.Waits(0, 0, 5), sleep=swap)
    assert KEY in (place / "other").read_text()


def test_outcomes(spark, place, monkeypatch):
    assert [S.outcome(*x) for x in ((True, False, 0, 0), (False, True, 3, 0), (True, True, 1, 1), (True, True, 0, 1), (True, True, 0, 0))] == ["unfinished", "control_failed", "findings", "root_errors", "clean"]
    root, work = str(place / "root"), str(place / "w")
    told = S.text_half(spark, [root], [], str(place / "st.json"), 5, work, rules.rule_set("infra"))
    assert told.control_failed and told.code == 1 and told.lines[0].startswith("CONTROL FAILED")
    told = S.text_half(spark, [str(place / "none")], [], str(place / "st.json"), 5, work)
    assert told.code == 1 and "not every place" in told.lines[0] and "none" in told.lines[1]
    monkeypatch.setattr(S, "scan", lambda *a: 1 / 0)
    told = S.text_half(spark, [root], [], str(place / "st.json"), 5, work)
    assert told.code == 1 and "did not finish (ZeroDivisionError)" in told.lines[0] and os.listdir(work) == []


def test_idle_sessions_are_forgotten(tmp_path):
    for n in ("old", "new"):
        (tmp_path / n).mkdir()
    os.utime(tmp_path / "old", (1, 1))
    S.forget_idle(str(tmp_path), time.time())
    assert os.listdir(tmp_path) == ["new"]


def test_revision(tmp_path):
    assert version.revision(str(tmp_path)) == "unknown"
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "packed-refs").write_text(f"# x\n{'ab' * 20} refs/heads/main\n")
    assert version.revision(str(tmp_path)) == "ab" * 6
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("cd" * 20 + "\n")
    assert version.revision(str(tmp_path)) == "cd" * 6
    (tmp_path / ".git" / "HEAD").write_text("ef" * 20)
    assert version.revision(str(tmp_path)) == "ef" * 6 and version.stamp(str(tmp_path)) == f"{version.VERSION} ({'ef' * 6})"
    some = rules.rule_set()
    assert rules.fingerprint(some, True, "1") != rules.fingerprint(some, True, "2")
