"""Command line: python -m sieveline sweep | filter | images | session."""

from __future__ import annotations

import argparse
import json
import math
import os
import sys

from sieveline.sources.state import default_path

USAGE, TROUBLE = 64, 1
#: Most characters of a payload that are read.
PAYLOAD = 1 << 20


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sieveline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _age(text: str) -> float:
    x = float(text)
    if not math.isfinite(x) or x < 0:
        raise argparse.ArgumentTypeError("must be a finite number, 0 or more")
    return x


def parser() -> argparse.ArgumentParser:
    from sieveline.functions.rules import SETS
    from sieveline.version import stamp

    top = argparse.ArgumentParser(prog="sieveline", description="Redacts secrets and identifiers of infrastructure in files, events and sessions.")
    top.add_argument("--version", action="version", version=f"sieveline {stamp()}")
    of = top.add_subparsers(dest="command", required=True)
    p = of.add_parser("sweep", help="files and folders: report what would change, or rewrite them")
    p.add_argument("paths", nargs="*")
    p.add_argument("--write", action="store_true", help="rewrite files; without it nothing is changed")
    p.add_argument("--config", help="TOML file with custom rules")
    p.add_argument("--state-dir", help="folder of the state that lets unchanged files be passed over")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--live-window-secs", type=_age, default=300.0, help="pass over files changed within so many seconds")
    p.add_argument("--patterns", choices=SETS, default="secrets")
    p = of.add_parser("filter", help="one tool-result event on standard input; prints the reply if there is one")
    p.add_argument("--config")
    p.add_argument("--root", default=os.environ.get("SIEVELINE_ROOT"), help="folder under whose projects saved copies lie")
    p = of.add_parser("images", help="inline images of transcripts and images of caches")
    p.add_argument("--transcript", action="append", default=[], metavar="PATH")
    p.add_argument("--image-dir", action="append", default=[], metavar="PATH")
    p.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("--max-age-hours", type=_age, default=24.0)
    p.add_argument("--live-window-secs", type=_age, default=300.0)
    p.add_argument("--state-file")
    p.add_argument("--root", default=os.environ.get("SIEVELINE_ROOT"), help="folder whose projects and image-cache are swept where no path is given")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--scoped", action="store_true", help="only the paths given; none given means none")
    p = of.add_parser("session", help="a session's files, by an event on standard input; or every place with --all")
    p.add_argument("--all", action="store_true")
    p.add_argument("--root", required=True, help="folder that holds sessions")
    p.add_argument("--scratch", help="shared scratch folder")
    return top


def sweep(a) -> int:
    from sieveline.functions.globs import glob_expression
    from sieveline.functions.rules import includes_keys, rule_set
    from sieveline.plans.sweep import Options, report, scan
    from sieveline.sources.config import custom_rules

    if not a.paths:
        print("sieveline: name at least one path", file=sys.stderr)
        return USAGE
    try:
        for g in a.exclude:
            glob_expression(g)
    except ValueError as e:
        print(f"sieveline: {e}", file=sys.stderr)
        return TROUBLE
    rules = rule_set(a.patterns)
    if a.config:
        more, problems = custom_rules(a.config)
        rules += more
        for p in problems:
            print(f"sieveline: {p}", file=sys.stderr)
    state = os.path.join(a.state_dir, "watermark.json") if a.state_dir else default_path()
    results, errors = scan(_spark(), a.paths, rules, Options(a.write, tuple(a.exclude), a.live_window_secs, state, includes_keys(a.patterns)))
    lines, trouble = report(results, errors, a.write)
    wrong = {f"{p}: {m}" for p, m in errors}
    for x in lines:
        print(x, file=sys.stderr if x in wrong else sys.stdout)
    return TROUBLE if trouble else 0


def filter_one(a) -> int:
    from sieveline.functions.rules import secret_rules
    from sieveline.operators.events import BadEvent, filter_event
    from sieveline.sources.config import custom_rules

    more, problems = custom_rules(a.config) if a.config else ([], [])
    problems = [f"sieveline filter: {'; '.join(problems)}; the built-in rules still ran."] if problems else []
    try:
        reply = filter_event(sys.stdin.read(), [*secret_rules(), *more], a.root, tuple(problems))
    except (BadEvent, UnicodeDecodeError) as e:  # no output and a failure: the caller withholds the result
        print(f"sieveline filter: {e if isinstance(e, BadEvent) else 'the payload is not UTF-8'}", file=sys.stderr)
        return TROUBLE
    if reply is not None:
        print(json.dumps(reply, ensure_ascii=False))
    return 0


def images(a) -> int:
    from sieveline.plans.session import image_half

    at = lambda name: [p for p in ([os.path.join(a.root, name)] if a.root else []) if os.path.isdir(p)]
    transcripts, caches = a.transcript, a.image_dir
    if not a.scoped:
        transcripts, caches = transcripts or at("projects"), caches or at("image-cache")
    state = a.state_file or os.path.join(os.path.dirname(default_path()), "images.json")
    told = image_half(_spark(), transcripts, caches, a.exclude, state, a.max_age_hours, a.live_window_secs, a.dry_run, a.verbose)
    print("\n".join(told.lines), end="\n" if told.lines else "")
    return TROUBLE if any("did not finish" in x for x in told.lines) else 0  # a bad file is told, and does not fail the rest


def session(a) -> int:
    from sieveline.plans.session import FULL, LAST, TURN, Waits, full_sweep, log_run, session_sweep, system_message
    from sieveline.sources.sessions import EVENTS, Layout, bounded_int

    layout, state = Layout(a.root, a.scratch), os.path.dirname(default_path())
    settle, lock = (os.environ.get(f"SIEVELINE_{x}_SECS", "") for x in ("SETTLE", "LOCK_WAIT"))
    if a.all:
        told = full_sweep(_spark(), layout, state, Waits(0, bounded_int(lock, 3600, int(FULL.lock)), FULL.live))
        print("\n".join(told.lines), end="\n" if told.lines else "", file=sys.stderr if told.code == 75 else sys.stdout)
        return told.code
    if sys.stdin.isatty():
        print("sieveline session: an event is read from standard input; --all sweeps every place", file=sys.stderr)
        return USAGE
    try:
        payload = json.loads(sys.stdin.read(PAYLOAD))
    except ValueError:
        payload = None
    last = isinstance(payload, dict) and payload.get("hook_event_name") == EVENTS[1]
    wait = bounded_int(settle, 600, int(TURN.settle))
    told = session_sweep(_spark(), payload, layout, state, last, LAST if last else Waits(wait, bounded_int(lock, 3600, int(TURN.lock)), wait))
    if last:  # nobody reads the output of a session's last pass
        log_run(state, f"session {payload.get('session_id')} {EVENTS[1]}", told)
    elif message := system_message(told):
        print(message)
    return TROUBLE if told.control_failed else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return {"sweep": sweep, "filter": filter_one, "images": images, "session": session}[a.command](a)


if __name__ == "__main__":
    sys.exit(main())
