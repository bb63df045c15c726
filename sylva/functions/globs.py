"""Glob patterns compiled to Java regular expressions.

Rules are tiny (tens of rows), so each pattern is translated once on the
driver into an anchored regex literal; Spark then evaluates it with
``rlike`` inside whole-stage codegen (a literal pattern is compiled once per
task, never per row).

Pattern language (per path segment, ``/`` is the separator):

* ``*``   any run of characters inside one segment (possibly empty)
* ``?``   exactly one character inside one segment
* ``[..]`` one character from a set; ``!`` or ``^`` first negates; ``x-y`` is
  a range unless ``y`` closes the set; the first member is always literal, so
  ``[]]`` holds ``]``; a set never matches ``/``
* ``**``  as a whole segment: zero or more directories
* with ``match_hidden=False`` a leading ``*``/``?`` of a segment (and ``**``)
  does not match a name starting with ``.``; a set does
* with ``glob_on=False`` everything except a whole-segment ``**`` is literal

Unclosed sets are literal text: ``[]`` and ``[!]``/``[^]`` without a closing
bracket mean the literal ``[]``, ``!`` and ``^``; any other unclosed ``[`` is a
literal ``[`` after which matching goes on (later wildcards still count).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

GLOBSTAR = "**"

# Characters that keep their literal meaning unescaped in a Java regex.
_PLAIN = re.compile(r"[A-Za-z0-9_ ]")


def _lit(ch: str) -> str:
    """Escape one character for a Java regex (outside or inside a class)."""
    if _PLAIN.fullmatch(ch) or ord(ch) > 127:
        return ch
    return "\\" + ch


def literal_regex(text: str) -> str:
    return "".join(_lit(c) for c in text)


def contains_wildcard(pattern: str) -> bool:
    """True if ``pattern`` holds ``*``, ``?`` or a bracket set that closes.

    A ``[`` only counts when some ``]`` follows at least two characters later
    (the first member of a set is literal, so ``[]`` alone is no set).
    """
    for i, ch in enumerate(pattern):
        if ch in "*?":
            return True
        if ch == "[" and "]" in pattern[i + 2:]:
            return True
    return False


def _char_set(members: str, negate: bool) -> str:
    """Regex for a closed bracket set whose members text is ``members``."""
    parts = []
    i = 0
    n = len(members)
    while i < n:
        if i + 2 < n and members[i + 1] == "-":
            lo, hi = members[i], members[i + 2]
            if lo <= hi:  # reversed ranges hold nothing
                parts.append(_lit(lo) + "-" + _lit(hi))
            i += 3
        else:
            parts.append(_lit(members[i]))
            i += 1
    body = "".join(parts)
    if negate:
        return "[^/" + body + "]"
    if not body:
        return "(?!)"
    return "(?!/)[" + body + "]"


def segment_regex(seg: str, match_hidden: bool = True, glob_on: bool = True) -> str:
    """Regex for one pattern segment (no separators inside)."""
    if not glob_on:
        return literal_regex(seg)
    out = []
    if not match_hidden and seg[:1] in ("*", "?"):
        out.append(r"(?!\.)")
    i = 0
    n = len(seg)
    while i < n:
        ch = seg[i]
        if ch == "*":
            while i < n and seg[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if ch == "?":
            out.append("[^/]")
            i += 1
            continue
        if ch == "[":
            j = i + 1
            negate = j < n and seg[j] in "!^"
            if negate:
                j += 1
            if j >= n:  # "[" or "[!" ends the segment: literal text
                out.append(literal_regex(seg[i:]))
                break
            close = seg.find("]", j + 1)
            if close < 0:
                if seg[j] == "]":
                    # "[]..." is a literal "[]"; "[!]..." / "[^]..." a literal "!" / "^"
                    out.append(_lit(seg[j - 1]) if negate else r"\[\]")
                    i = j + 1
                else:
                    out.append(r"\[")
                    i += 1
                continue
            out.append(_char_set(seg[j:close], negate))
            i = close + 1
            continue
        out.append(_lit(ch))
        i += 1
    return _linear(out)


def _linear(parts: list[str]) -> str:
    """Join the parts so that failing matches stay cheap: between two stars the first
    place that fits is as good as any later one, so it is taken atomically."""
    chunks = [[]]
    for p in parts:
        if p == "[^/]*":
            chunks.append([])
        else:
            chunks[-1].append(p)
    head, *rest = ["".join(c) for c in chunks]
    if not rest:
        return head
    return head + "".join(f"(?>[^/]*?{c})" for c in rest[:-1]) + "[^/]*" + rest[-1]


def _collapse(segs: list[str]) -> list[str]:
    out: list[str] = []
    for s in segs:
        if s == GLOBSTAR and out and out[-1] == GLOBSTAR:
            continue
        out.append(s)
    return out


# A ``**`` runs over characters, each tested by a look-ahead, and not over
# segments: loops over one character are no recursion in Java's matcher, however
# deep a path is.


def _dirs(match_hidden: bool, lazy: bool = False) -> str:
    """Any number of directories, each with its separator."""
    bad = "[/]" if match_hidden else "[./]"  # what no segment starts with
    q = "?" if lazy else ""
    return f"(?:(?!{bad})(?:(?!/{bad}).)*{q}/)?{q}"


def _names(match_hidden: bool) -> str:
    """One or more names joined by separators."""
    bad = "[/]" if match_hidden else "[./]"
    return f"(?!{bad})(?:(?!/(?:{bad}|\\z)).)+"


def segments_regex(segs: list[str], match_hidden: bool = True, glob_on: bool = True,
                   globstar_hidden: bool | None = None) -> str:
    """Unanchored regex for a list of segments joined by ``/``.

    Whole-segment ``**`` is zero or more directories in the middle and one or
    more names at the end (the base itself is not matched by a trailing ``**``).
    Between two ``**`` the first place that fits is as good as any later one
    (what the first could step over, the second can), so it is taken atomically.
    """
    hidden = match_hidden if globstar_hidden is None else globstar_hidden
    chunks: list[list[str]] = [[]]
    for seg in _collapse(segs):
        if seg == GLOBSTAR:
            chunks.append([])
        else:
            chunks[-1].append(segment_regex(seg, match_hidden, glob_on))
    head, *rest = ["/".join(c) for c in chunks]
    if not rest:
        return head
    lead = head + "/" if chunks[0] else ""
    middle = "".join(f"(?>{_dirs(hidden, lazy=True)}{c}/)" for c in rest[:-1])
    return lead + middle + (_dirs(hidden) + rest[-1] if chunks[-1] else _names(hidden))


def glob_regex(pattern: str, match_hidden: bool = True, glob_on: bool = True,
               globstar: bool = False) -> str:
    """Anchored regex: the whole text must match the pattern, segment for segment.

    Without ``globstar`` a ``**`` segment is just a run of stars (one segment).
    """
    segs = pattern.split("/")
    if globstar:
        body = segments_regex(segs, match_hidden, glob_on)
    else:
        body = "/".join(segment_regex(s, match_hidden, glob_on) for s in segs)
    return r"(?s)\A" + body + r"\z"


def ignore_regex(pattern: str, match_hidden: bool = True, glob_on: bool = True) -> str:
    """Anchored regex that is true when an absolute path or one of its ancestors
    matches an ignore pattern.

    A relative ignore matches at any depth, an absolute one from the root; the
    root itself is no segment. ``p/**`` ignores everything below ``p`` but not
    ``p``. ``**`` inside an ignore has no hidden-name test.
    """
    pattern = pattern.rstrip("/") or "/"
    if pattern.startswith("/"):
        segs = pattern.split("/")[1:]
        lead = "/"
    else:
        segs = [GLOBSTAR] + pattern.split("/")
        lead = "/"
    segs = _collapse(segs)
    if segs == [GLOBSTAR] or segs == [""]:
        return r"(?s)\A/.+\z" if segs == [GLOBSTAR] else r"(?s)\A/.*\z"
    body = segments_regex(segs, match_hidden, glob_on, globstar_hidden=True)
    return r"(?s)\A" + lead + body + r"(?:/.*)?\z"


def any_of(regexes: list[str]) -> str | None:
    """One alternation for a fixed set of anchored regexes (None when empty)."""
    if not regexes:
        return None
    if len(regexes) == 1:
        return regexes[0]
    return "(?s)" + "|".join("(?:" + r.replace("(?s)", "", 1) + ")" for r in regexes)


@dataclass(frozen=True)
class AddPattern:
    """Compiled ``add`` pattern: the read prefix and the regex for full paths."""

    read_prefix: str
    regex: str
    literal_prefix: str


def compile_add(pattern: str, match_hidden: bool = True, glob_on: bool = True) -> AddPattern:
    """Compile an absolute, normal ``add`` pattern.

    A last segment without wildcards (or any pattern with globbing off) names
    an entry that is taken together with everything below it. The read prefix
    is the longest wildcard-free run of leading directories; when everything
    below the last name is implied, the prefix stops one segment before the
    first wildcard segment so that name stays part of the relative path.
    """
    assert pattern.startswith("/"), pattern
    segs = [s for s in pattern.split("/")[1:] if s != ""]
    implied = not segs or not glob_on or not contains_wildcard(segs[-1])
    if implied:
        segs = segs + [GLOBSTAR]
    segs = _collapse(segs)
    i = 0
    while i + 1 < len(segs) and not contains_wildcard(segs[i]):
        if implied and contains_wildcard(segs[i + 1]):
            break
        i += 1
    prefix = "/" + "/".join(segs[:i])
    rest = segs[i:]
    if implied and len(rest) > 1 and rest[-1] == GLOBSTAR:
        # the named entry itself, then anything below it
        body = segments_regex(rest[:-1], match_hidden, glob_on)
        body += "(?:/" + _names(match_hidden) + ")?"
    else:
        body = segments_regex(rest, match_hidden, glob_on)
    head = "" if prefix == "/" else literal_regex(prefix)
    regex = r"(?s)\A" + head + "/" + body + r"\z"
    lit_prefix = prefix if prefix == "/" else prefix + "/"
    return AddPattern(prefix, regex, lit_prefix)
