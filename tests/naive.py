"""Slow, plain Python versions of the operators, to compare results with."""

from __future__ import annotations

import posixpath
import re


def lines_of(text):
    return text.count("\n") + (not text.endswith("\n"))


def hits(path, text, pattern, case=False):
    """(path, lineno, line) of every occurrence, found by trying every position."""
    if not pattern:
        return []
    low = text if case else text.lower()
    needle = pattern if case else pattern.lower()
    found = []
    for at in range(len(low)):
        if low.startswith(needle, at):
            start = text.rfind("\n", 0, at) + 1
            end = text.find("\n", at)
            line = text[start:] if end < 0 else text[start:end]
            found.append((path, 1 + text.count("\n", 0, at), line))
    return found


def is_binary(content):
    sample = content[:8192]
    odd = [byte for byte in sample if byte < 32 and byte not in b"\t\n\r"]
    return b"\0" in sample or len(odd) > 0 and len(odd) / len(sample) > 0.30


_TOKENS = {"*": "[^/]*", "?": "[^/]"}


def rules_of(text, base=""):
    """(negate, compiled regex) of the usable rules of an ignore file."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        negate = line[0] == "!"
        body = line[1:].lstrip() if negate else line
        source = body.strip("/")
        if not source or set("[]") & set(source):
            continue
        body_regex = re.sub(
            r"(?s)\*\*/?|\\.|.",
            lambda m: ".*" if m[0].startswith("**") else _TOKENS.get(m[0]) or re.escape(m[0][-1]),
            source,
        )
        at_base = body.rstrip("/").startswith("/") or "/" in source
        head = "^" + (re.escape(base + "/") if base else "") if at_base else "(^|/)"
        tail = "/" if body.endswith("/") else "($|/)"
        rules.append((negate, re.compile(head + body_regex + tail)))
    return rules


def hidden(path, is_dir, stack):
    """Whether the rules of ``stack``, shallowest set first, hide a path."""
    for form in [path] + [path + "/"] * is_dir:
        for rules in stack:
            verdicts = [negate for negate, regex in rules if regex.search(form)]
            if verdicts:
                return not verdicts[-1]
    return False


def walk(files, extra=(), names=(".gitignore", ".quarryignore")):
    """{path: "pruned" | "ignored" | "kept"} of relative paths, given {path: text}."""

    def sets_of(directory):
        found = [files.get(posixpath.join(directory, name)) for name in names]
        return [rules_of(text or "", directory) for text in found]

    first, second = sets_of("")
    top = [first, *(rules_of(pattern) for pattern in extra), second]
    result = {}
    for path in files:
        parts = path.split("/")
        stack, state = list(top), "kept"
        for depth in range(1, len(parts)):
            directory = "/".join(parts[:depth])
            if hidden(directory, True, stack):
                state = "pruned"
                break
            stack += sets_of(directory)
        if state == "kept" and hidden(path, False, stack):
            state = "ignored"
        result[path] = state
    return result
