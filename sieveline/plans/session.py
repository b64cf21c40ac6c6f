"""Sweeps of sessions and of all places where texts gather: lock, known positive, both halves, outcome, and who is told."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveline.functions.globs import absolute_glob
from sieveline.functions.rules import Rule, rule_set
from sieveline.operators.control import KEYS
from sieveline.operators.images import image_report, reap, sweep_cache, sweep_transcripts
from sieveline.plans.sweep import Options, report, scan, totals
from sieveline.sources.sessions import Busy, Layout, exclude_globs, session_paths, single_flight, sink_paths

#: Exit codes; size at which the log is rotated; days after which a session's state goes.
OK, TROUBLE, BUSY, LOG_BYTES, IDLE_DAYS = 0, 1, 75, 1 << 20, 7
OLD = 1_577_836_800


@dataclass(frozen=True)
class Waits:
    """Seconds: before a run, for the lock, and within which a changed file counts as live."""

    settle: float = 30
    lock: float = 120
    live: float = 300


#: A turn's end, a session's last pass, and a run over everything.
TURN, LAST, FULL = Waits(30, 120, 30), Waits(5, 900, 5), Waits(0, 60, 300)


@dataclass
class Told:
    """What a run has to say, its exit code, and whether it found something."""

    lines: list[str] = field(default_factory=list)
    code: int = OK
    control_failed: bool = False
    found: bool = False


def outcome(control_ok: bool, finished: bool, concerns: int, errors: int) -> str:
    """control_failed, unfinished, findings, root_errors or clean: the first that holds. A run that proves nothing is never clean."""
    if not finished:
        return "unfinished"
    if not control_ok:
        return "control_failed"
    return "findings" if concerns else "root_errors" if errors else "clean"


def text_half(spark: SparkSession, roots: list[str], excludes: list[str], state_path: str, live: float, work: str, rules: list[Rule] | None = None) -> Told:
    """Redacts the texts under the roots, with a file of known keys among them that must come out without a key."""
    if not roots:
        return Told()
    folder = os.path.join(work, f"control-{uuid.uuid4().hex}")
    control = os.path.join(folder, "known-positive.txt")
    told, rules = Told(), rule_set("secrets") if rules is None else rules
    try:
        os.makedirs(folder)
        with open(control, "w", encoding="utf-8") as f:
            f.write("\n".join(KEYS) + "\n")
        os.utime(control, (OLD, OLD))
        results, errors = scan(spark, [*roots, control], rules, Options(write=True, exclude=tuple(excludes), live_window_s=live, state_path=state_path))
        mine = results.where(F.col("path") != control)
        lines, trouble = report(mine, errors, True)
        total = totals(mine, True).first()
        concerns = sum(total[c] for c in ("redactions", "validation_failures", "unsafe_line_files", "key_concern_files", "not_written_files"))
        with open(control, encoding="utf-8") as f:
            left = f.read()
        kind = outcome(not any(k in left for k in KEYS), True, concerns, len(errors))
        told.found, told.control_failed = total["redactions"] > 0, kind == "control_failed"
        told.code = TROUBLE if trouble or told.control_failed else OK
        summary, problems = lines[-1], [f"{p}: {m}" for p, m in errors]
        if kind == "control_failed":
            told.lines = ["CONTROL FAILED: keys that must be found were not, so this run proves nothing and all it covered counts as unswept.", summary]
        elif kind == "findings":
            told.lines = [summary, *problems]
        elif kind == "root_errors":
            told.lines = ["the text sweep ended, but not every place could be read:", *problems]
    except Exception as e:  # whatever stopped it, what it covered is not known to be swept
        told.lines, told.code = [f"the text sweep did not finish ({type(e).__name__}); places may be swept in part."], TROUBLE
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return told


def load_image_state(path: str) -> dict:
    """The state of earlier image sweeps; an absent or torn file is an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
    except (OSError, ValueError):
        return {}
    return state if isinstance(state, dict) and isinstance(state.get("files", {}), dict) else {}


def save_image_state(path: str, state: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(state, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def image_half(spark: SparkSession, transcripts: list[str], caches: list[str], excludes: list[str], state_path: str, max_age_h: float = 24, live: float = 300, dry_run: bool = False, each: bool = False) -> Told:
    """Strips images from transcripts and deletes those of caches. One bad file does not stop the rest, and is told."""
    if not (transcripts or caches):
        return Told()
    try:
        globs, now = [absolute_glob(g) for g in excludes], time.time()
        rows, state = sweep_transcripts(spark, transcripts, globs, max_age_h, live, dry_run, load_image_state(state_path), now)
        reaped, gone = 0, [0, 0]
        if not dry_run:
            reaped = sum(reap(t, now, globs) if os.path.isdir(t) else reap(os.path.dirname(t), now, globs, os.path.basename(t)) for t in transcripts)
        for root in (os.path.abspath(os.path.expanduser(c)) for c in caches):
            n, size = sweep_cache(root, now - max_age_h * 3600, now - live, globs, dry_run)
            gone = [gone[0] + n, gone[1] + size]
        if not dry_run:
            save_image_state(state_path, state)
    except Exception as e:
        return Told([f"images: did not finish ({type(e).__name__}); payloads may remain."], TROUBLE)
    lines = image_report(rows, tuple(gone), reaped, dry_run, each)
    return Told(lines, TROUBLE if any(r["error"] is not None for r in rows) else OK, found=len(lines) > 0)


def both(text: Told, image: Told) -> Told:
    return Told([*text.lines, *image.lines], max(text.code, image.code), text.control_failed, text.found or image.found)


def full_sweep(spark: SparkSession, layout: Layout, state: str, waits: Waits = FULL) -> Told:
    """Every place where texts gather, by hand or on a schedule. BUSY if another run holds the lock; TROUBLE for anything short of a whole sweep."""
    try:
        with single_flight(os.path.join(state, "sweep.lock"), waits.lock, f"pid {os.getpid()} full sweep"):
            sinks = sink_paths(layout)
            excludes = exclude_globs([p for p in sinks if os.path.isdir(p)], layout.marker)
            caches = [p for p in (layout.at("image-cache"),) if os.path.isdir(p)]
            transcripts = [p for p in (layout.at("projects"), layout.scratch) if p and os.path.isdir(p)]
            text = text_half(spark, sinks, excludes, os.path.join(state, "watermark.json"), waits.live, state)
            return both(text, image_half(spark, transcripts, caches, excludes, os.path.join(state, "images.json"), live=waits.live))
    except Busy as e:
        return Told([f"another sweep holds the lock ({e}); this one did not run."], BUSY)
    except OSError as e:
        return Told([f"the lock could not be taken ({e.strerror}); nothing was swept."], TROUBLE)


def claim(folder: str) -> Callable[[], bool]:
    """Makes this run its session's newest; what is returned tells whether it still is."""
    os.makedirs(folder, exist_ok=True)
    token, at = uuid.uuid4().hex, os.path.join(folder, "latest")
    temp = f"{at}.{token}"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(token)
    os.replace(temp, at)

    def newest() -> bool:
        try:
            with open(at, encoding="utf-8") as f:
                return f.read() == token
        except OSError:
            return False

    return newest


def forget_idle(folder: str, now: float) -> None:
    """Deletes the state of sessions that were idle for IDLE_DAYS; one that resumes is read once more."""
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        p = os.path.join(folder, name)
        if os.path.isdir(p) and now - os.stat(p).st_mtime > IDLE_DAYS * 86400:
            shutil.rmtree(p, ignore_errors=True)


def session_sweep(spark: SparkSession, payload, layout: Layout, state: str, last: bool = False, waits: Waits | None = None, sleep: Callable[[float], None] = time.sleep) -> Told:
    """What belongs to one session, after its files have settled. Stands down for a newer run of the session, which covers the same; paths are
    looked up again under the lock, as they may have changed while it waited. A busy lock is told only by the last pass, which none follows.
    """
    waits = waits or (LAST if last else TURN)
    try:
        _, sid, _ = session_paths(payload, layout)
    except ValueError as e:
        return Told([f"{e}; nothing was swept."])
    folder = os.path.join(state, "sessions", sid)
    newest = claim(folder)
    sleep(waits.settle)
    try:
        with single_flight(os.path.join(state, "sweep.lock"), waits.lock, f"pid {os.getpid()} session {sid}"):
            if not newest():
                return Told()
            try:
                records = session_paths(payload, layout)[2]
            except ValueError as e:
                return Told([f"{e}; nothing was swept."])
            of = lambda kind: [p for k, p in records if k == kind]
            os.utime(folder)
            forget_idle(os.path.dirname(folder), time.time())
            for d in of("O"):
                reap(d, time.time(), [], f"{sid}.jsonl")
            excludes = exclude_globs(of("R"), layout.marker)
            text = text_half(spark, of("T"), excludes, os.path.join(folder, "watermark.json"), waits.live, state)
            if last and text.found and (of("J") or of("C")):
                sleep(waits.live + 1)  # the rewrites are live now, and no later run looks at them
            image = image_half(spark, of("J"), of("C"), excludes, os.path.join(folder, "images.json"), live=waits.live)
            return both(text, image)
    except Busy as e:
        return Told([f"the lock stayed busy ({e}); the session's last writes were not swept."] if last else [])


def system_message(told: Told) -> str | None:
    """A turn's report as JSON for its host, or None where there is nothing to say."""
    return json.dumps({"systemMessage": "\n".join(told.lines)}) if told.lines else None


def log_run(folder: str, title: str, told: Told, now: float | None = None) -> None:
    """Appends a report to the log of runs. One rotation at LOG_BYTES keeps it bounded without losing what came before."""
    if not told.lines:
        return
    os.makedirs(folder, exist_ok=True)
    log = os.path.join(folder, "sweep.log")
    if os.path.exists(log) and os.path.getsize(log) > LOG_BYTES:
        os.replace(log, f"{log}.1")
    when = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
    with open(log, "a", encoding="utf-8") as f:
        f.write("\n".join([f"{when} {title}", *told.lines]) + "\n")
