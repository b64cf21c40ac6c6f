"""What release of the rules this is."""

from __future__ import annotations

import os
import re

VERSION = "0.2"
UNKNOWN = "unknown"
#: Fixed value: characters of a commit's name that are kept.
SHORT = 12


def revision(root: str | None = None) -> str:
    """The commit of the checkout that holds this package, from git's own files; unknown where there is none, as in an installed copy."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) if root is None else root

    def content(*names: str) -> str:
        try:
            with open(os.path.join(root, ".git", *names), encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return ""

    head = content("HEAD").strip()
    if head.startswith("ref: "):
        ref = head[5:]
        packed = re.search(rf"^([0-9a-f]+) {re.escape(ref)}$", content("packed-refs"), re.M)
        head = content(*ref.split("/")).strip() or (packed[1] if packed else "")
    return head[:SHORT] if re.fullmatch(r"[0-9a-f]{40,64}", head) else UNKNOWN


def stamp(root: str | None = None) -> str:
    """Release and revision: rules of another release or commit are other rules."""
    return f"{VERSION} ({revision(root)})"
