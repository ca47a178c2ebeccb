"""Globs compiled to Java regular expressions, on the driver."""

from __future__ import annotations

import re

def expand_braces(glob: str) -> list[str]:
    """``a{b,c}`` as its alternatives; braces without a comma stand for themselves."""
    depth, start = 0, -1
    for i, c in enumerate(glob):
        if c == "{":
            if not depth:
                start, cuts = i, [i]
            depth += 1
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if not depth and len(cuts) > 1:
                cuts.append(i)
                return [x for a, b in zip(cuts, cuts[1:], strict=False) for x in expand_braces(glob[:start] + glob[a + 1 : b] + glob[i + 1 :])]
    return [glob]


def _segment(part: str) -> str:
    out, i = "" if part.startswith(".") else r"(?!\.)" if part[:1] in "*?[" else "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[i + 2 :]:
            end = part.index("]", i + 2)
            inner = part[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    if part and set(part) <= {"*"}:
        out = r"(?!\.)[^/]+"
    return out


def glob_regex(glob: str) -> str:
    """Case-insensitive expression for whole paths: ``*`` within a segment, ``**`` across segments, neither matching a leading dot."""
    found = []
    for one in expand_braces(glob):
        parts, out = one.split("/"), ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                out += r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)" if last else r"(?:(?!\.)[^/]+/)*"
            else:
                out += _segment(part) + ("" if last else "/")
        found.append(out)
    return "(?i)^(?:" + "|".join(found) + ")$"


def any_glob(globs) -> str:
    """One expression for any of the globs; no glob matches nothing."""
    return "(?i)" + ("|".join(glob_regex(g)[4:] for g in globs) if globs else r"(?!)")


#: Letters that expressions take for equal; others keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a name's beginning that serve as a key; of a path's end or beginning, at most.
HEAD, LITERAL = 3, 24


def glob_key(glob: str) -> tuple[str, str]:
    """A kind and a key that every path which a glob (without braces) matches has: its whole path, its name, an ending after a dot of its name, a folder above it, or its name's beginning; ("any", "") where the glob tells none."""
    parts = glob.translate(str.maketrans(UPPER, LOWER)).split("/")
    wild = [any(c in "*?[" for c in p) for p in parts]
    last = parts[-1]
    if not any(wild):
        return "path", "/".join(parts)
    if not wild[-1]:
        return "name", last
    tail = re.split(r"[*?\]]", last)[-1]
    if "." in tail:
        return "ending", tail.partition(".")[2]
    if not wild[0]:
        return "folder", "/".join(parts[: wild.index(True)])
    head = re.split(r"[*?\[]", last)[0]
    return ("head", head[:HEAD]) if len(head) >= HEAD else ("any", "")


def literal_key(glob: str) -> tuple[str, str]:
    """As ``glob_key``, but where that tells no whole path or name, what the path ends with ("tail") or begins with ("start") before any wildcard, if the glob tells it: the longer one."""
    kind, key = glob_key(glob)
    if kind in ("path", "name"):
        return kind, key
    parts = glob.translate(str.maketrans(UPPER, LOWER)).split("/")
    tail = re.split(r"[*?\]]", parts[-1])[-1]
    first = next(i for i, p in enumerate(parts) if any(c in "*?[" for c in p))
    start = "/".join([*parts[:first], re.split(r"[*?\[]", parts[first])[0]])
    found = ("tail", tail[-LITERAL:]) if len(tail) >= len(start) else ("start", start[:LITERAL])
    return found if found[1] else (kind, key)
