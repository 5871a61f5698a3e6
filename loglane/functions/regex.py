"""RE2 pattern and replacement text, rewritten for Spark's Java regex functions.

Users write patterns in RE2 syntax. Spark runs them with ``java.util.regex``, which differs in a
few places, so pattern *strings* are rewritten once on the driver; no row is touched here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket class names of RE2 and what Java calls them.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}

# Java's own \b knows more letters than ASCII; its \w does not.
_EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
_NO_EDGE = r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"

_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_GROUP_NAME = re.compile(r"\?P?<([A-Za-z_]\w*)>")
_FLAGS = re.compile(r"\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])")
_UNICODE_CLASS = re.compile(r"([pP])(?:\{(\^?)(\w+)\}|(\w))")


@dataclass(frozen=True)
class Pattern:
    """A pattern in RE2 syntax (``source``) and the same in Java syntax (``java``)."""

    source: str
    java: str
    groups: int
    names: dict[str, int] = field(hash=False)
    # Whether it can match the empty text.
    nullable: bool = False

    @property
    def replacing(self) -> str:
        """The Java pattern for replacing all matches.

        RE2 refuses an empty match where the match before ended, and goes on behind the next character; Java does
        neither. The match is taken as it is (no other is tried), and it must not end where the last one did, unless
        at the beginning of the text. No match begins between the two halves of a character.
        """
        return rf"(?![\uDC00-\uDFFF])(?>{self.java})(?:\A|(?!\G))" if self.nullable else self.java


class _Rewriter:
    def __init__(self, source: str) -> None:
        self.source = source
        self.at = 0
        self.out: list[str] = []
        self.groups = 0
        self.names: dict[str, int] = {}
        # (?m) holds until its group closes, so the setting is a stack.
        self.multiline = [False]
        self.can_repeat = False
        # Whether an earlier alternative, the atoms so far, and the last atom can be empty, for each open group.
        self.empty_before, self.empty_so_far = [False], [True]
        self.empty_atom = True

    def fail(self, why: str) -> None:
        raise ValueError(f"invalid pattern {self.source!r}: {why}")

    def take(self, regex: re.Pattern) -> re.Match | None:
        m = regex.match(self.source, self.at)
        if m:
            self.at = m.end()
        return m

    def atom(self, text: str, can_be_empty: bool = False) -> None:
        self.out.append(text)
        self.can_repeat = True
        self.next_atom(can_be_empty)

    def next_atom(self, can_be_empty: bool) -> None:
        self.empty_so_far[-1] &= self.empty_atom
        self.empty_atom = can_be_empty

    def end_alternatives(self) -> bool:
        """Whether the innermost open group can be empty, when it ends."""
        return self.empty_before.pop() | (self.empty_so_far.pop() & self.empty_atom)

    def run(self) -> Pattern:
        src = self.source
        while self.at < len(src):
            ch = src[self.at]
            if ch == "\\":
                begin = self.at
                text = self.escape(in_class=False)
                literal = src.startswith("\\Q", begin)
                if literal and len(text) > 2:
                    # A repetition after a quoted literal is one of its last character.
                    self.next_atom(False)
                self.atom(text, src[begin + 1] in "bBAz" or (literal and not text))
            elif ch == "[":
                self.atom(self.bracket())
            elif ch == "(":
                self.open_group()
            elif ch == ")":
                if len(self.multiline) == 1:
                    self.fail("unexpected )")
                self.multiline.pop()
                self.at += 1
                empty, self.empty_atom = self.end_alternatives(), True
                self.atom(")", empty)
            elif ch in "*+?":
                self.repeat(ch)
            elif ch == "{":
                m = self.take(_REPEAT)
                if m is None:
                    self.at += 1
                    self.atom(r"\{")
                else:
                    self.counted(m)
            else:
                self.at += 1
                self.plain(ch)
        if len(self.multiline) != 1:
            self.fail("missing )")
        # (?d): only \n ends a line, as in RE2.
        return Pattern(src, "(?d)" + "".join(self.out), self.groups, self.names, self.end_alternatives())

    def plain(self, ch: str) -> None:
        multi = self.multiline[-1]
        if ch == "^":
            self.out.append(r"(?<![^\n])" if multi else r"\A")
        elif ch == "$":
            self.out.append(r"(?=\n|\z)" if multi else r"\z")
        elif ch == "|":
            self.out.append("|")
            self.can_repeat = False
            self.empty_before[-1] |= self.empty_so_far[-1] & self.empty_atom
            self.empty_so_far[-1] = self.empty_atom = True
            return
        else:
            self.out.append("\\" + ch if ch in "]}" else ch)
        self.can_repeat = True
        self.next_atom(ch in "^$")

    def suffix(self, text: str) -> None:
        if not self.can_repeat:
            self.fail(f"missing argument to repetition operator {text}")
        if self.source[self.at : self.at + 1] == "?":
            text += "?"
            self.at += 1
        nxt = self.source[self.at : self.at + 1]
        if nxt and (nxt in "*+?" or _REPEAT.match(self.source, self.at)):
            self.fail(f"invalid nested repetition operator {text}{nxt}")
        self.out.append(text)
        self.can_repeat = False

    def repeat(self, ch: str) -> None:
        self.at += 1
        self.suffix(ch)
        self.empty_atom |= ch in "*?"

    def counted(self, m: re.Match) -> None:
        low, high = int(m[1]), int(m[3]) if m[3] else None
        if max(low, high or 0) > 1000 or (high is not None and high < low):
            self.fail(f"invalid repeat count {m[0]}")
        self.suffix(m[0])
        self.empty_atom |= low == 0

    def enter(self) -> None:
        """The atoms of a group are counted apart."""
        self.next_atom(True)
        self.empty_before.append(False)
        self.empty_so_far.append(True)

    def open_group(self) -> None:
        self.at += 1
        self.can_repeat = False
        if self.source[self.at : self.at + 1] != "?":
            self.groups += 1
            self.multiline.append(self.multiline[-1])
            self.enter()
            self.out.append("(")
            return
        named = self.take(_GROUP_NAME)
        if named:
            if named[1] in self.names:
                self.fail(f"duplicate group name {named[1]}")
            self.groups += 1
            self.names[named[1]] = self.groups
            self.multiline.append(self.multiline[-1])
            self.enter()
            self.out.append("(")
            return
        flags = self.take(_FLAGS)
        if flags is None:
            self.fail("lookaround and other (? forms are not supported")
        on, off, end = flags[1], (flags[2] or "")[1:], flags[3]
        bad = set(on + off) - set("ims")
        if bad or not (on or off or end == ":"):
            self.fail(f"unsupported flag(s) {''.join(sorted(bad))}")
        multi = (self.multiline[-1] or "m" in on) and "m" not in off
        # ^ and $ are already rewritten, so (?m) itself is not passed on; i folds Unicode case.
        keep_on = on.replace("m", "").replace("i", "iu")
        keep_off = off.replace("m", "").replace("i", "iu")
        text = "?" + keep_on + ("-" + keep_off if keep_off else "")
        if end == ":":
            self.multiline.append(multi)
            self.enter()
            self.out.append("(" + text + ":")
        else:
            self.multiline[-1] = multi
            if text != "?":
                self.out.append("(" + text + ")")

    def escape(self, in_class: bool) -> str:
        src = self.source
        ch = src[self.at + 1 : self.at + 2]
        if not ch:
            self.fail("trailing backslash")
        if ch == "Q" and not in_class:
            end = src.find("\\E", self.at)
            literal = src[self.at + 2 : end if end >= 0 else len(src)]
            self.at = end + 2 if end >= 0 else len(src)
            return "".join(quote_char(c) for c in literal)
        if ch in "pP":
            self.at += 1
            m = self.take(_UNICODE_CLASS)
            if m is None:
                self.fail("invalid character class")
            name = m[3] or m[4]
            negate = (m[1] == "P") != (m[2] == "^")
            name = name if len(name) <= 2 else "Is" + name
            return ("\\P{" if negate else "\\p{") + name + "}"
        if ch == "x":
            m = re.compile(r"\\x(?:[0-9A-Fa-f]{2}|\{[0-9A-Fa-f]+\})").match(src, self.at)
            if m is None:
                self.fail("invalid \\x escape")
            self.at = m.end()
            return m[0]
        self.at += 2
        if ch == "v":
            return r"\x0B"
        if ch == "0":
            return r"\x00"
        if ch in "bB" and not in_class:
            return _EDGE if ch == "b" else _NO_EDGE
        if ch.isalnum() and ch not in ("dDwWsSafntr" if in_class else "dDwWsSafntrAzbB"):
            self.fail(f"invalid escape sequence \\{ch}")
        if ch in "sS":
            # RE2's \s has no vertical tab.
            negate = ch == "S"
            if in_class:
                return r"\t\n\f\r " if not negate else r"[^\t\n\f\r ]"
            return r"[^\t\n\f\r ]" if negate else r"[\t\n\f\r ]"
        return "\\" + ch

    def bracket(self) -> str:
        src = self.source
        self.at += 1
        parts = ["["]
        if src[self.at : self.at + 1] == "^":
            parts.append("^")
            self.at += 1
        first = True
        while True:
            if self.at >= len(src):
                self.fail("missing closing ]")
            ch = src[self.at]
            if ch == "]" and not first:
                self.at += 1
                parts.append("]")
                return "".join(parts)
            first = False
            if ch == "[":
                m = self.take(_POSIX)
                if m is None:
                    parts.append(r"\[")
                    self.at += 1
                elif m[2] not in POSIX_CLASSES:
                    self.fail(f"invalid character class {m[0]}")
                else:
                    cls = POSIX_CLASSES[m[2]]
                    parts.append(cls.swapcase() if m[1] and cls == r"\w" else cls.replace("p{", "P{") if m[1] else cls)
            elif ch == "\\":
                parts.append(self.escape(in_class=True))
            else:
                # & and ] have a meaning in Java classes that they do not have in RE2.
                parts.append("\\" + ch if ch in "]&^" else ch)
                self.at += 1


def quote_char(ch: str) -> str:
    return ch if ch.isalnum() or ch.isspace() or ord(ch) > 127 else "\\" + ch


def quote(text: str) -> str:
    """A pattern that matches ``text`` literally, valid in both syntaxes."""
    return "".join(quote_char(c) for c in text)


@lru_cache(maxsize=1024)
def translate(pattern: str) -> Pattern:
    """Check an RE2 pattern and rewrite it for Spark; ``ValueError`` if RE2 would reject it."""
    if not isinstance(pattern, str):
        raise ValueError(f"pattern must be text, got {pattern!r}")
    return _Rewriter(pattern).run()


_CLASS = re.compile(r"\[\^?\]?(?:\[:\^?[a-z]+:\]|\\.|[^\]\\])*\]", re.S)
_TIMES = re.compile(r"(\*|\?|\+|\{(\d+)(?:,\d*)?\})\??")


def _group_end(source: str, at: int) -> int:
    """Where the group that opens at ``at`` ends."""
    depth = 0
    while True:
        skip = _CLASS.match(source, at) if source[at] == "[" else None
        if source.startswith(r"\Q", at):
            end = source.find(r"\E", at)
            at = end + 2 if end >= 0 else len(source)
        elif skip:
            at = skip.end()
        else:
            depth += (source[at] == "(") - (source[at] == ")")
            at += 2 if source[at] == "\\" else 1
            if not depth:
                return at


def required_literals(pattern: str) -> list[str]:
    """Texts of which every match has one: the longest plain run of each alternative; none if an alternative has none.

    Found in the pattern's outermost level; what ignores case, and what a repetition can leave out, does not count.
    """
    longest = [max(runs, key=len) for runs in required_runs(pattern)]
    return longest if all(longest) else []


def required_runs(pattern: str) -> list[list[str]]:
    """The plain runs of each alternative, in order, each of which a match of that alternative has; see ``required_literals``."""
    translate(pattern)
    if re.search(r"\(\?[a-zA-Z]*i", pattern):
        return []
    alternatives, runs, run, at = [], [], "", 0

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at < len(pattern):
        ch, text = pattern[at], None
        if ch == "|":
            ended()
            alternatives.append(runs)
            runs, at = [], at + 1
            continue
        if ch in "^$" or pattern[at : at + 2] in (r"\b", r"\B", r"\A", r"\z"):
            # Takes no character, so the run goes on.
            text, at = "", at + (2 if ch == "\\" else 1)
        elif ch == "(":
            at = _group_end(pattern, at)
        elif ch == "[":
            at = _CLASS.match(pattern, at).end()
        elif pattern.startswith(r"\Q", at):
            end = pattern.find(r"\E", at)
            text, at = pattern[at + 2 : end if end >= 0 else None], end + 2 if end >= 0 else len(pattern)
        elif ch == "\\":
            # Escaped signs stand for themselves; letters and digits are classes, codes or controls.
            nxt = pattern[at + 1]
            text = None if nxt.isalnum() else nxt
            at += 2
            if nxt in "pPx" and pattern[at : at + 1] == "{":
                at = pattern.index("}", at) + 1
            elif nxt == "x":
                at += 2
            elif nxt in "pP":
                at += 2 if pattern[at] == "^" else 1
        else:
            text, at = (None if ch == "." else ch), at + 1
        times = _TIMES.match(pattern, at)
        if times:
            at = times.end()
            optional = times[1] in ("*", "?") or times[2] == "0" or (times[2] or "1").strip("0") == ""
            # Only the last character is repeated; another round of it need not follow.
            run += (text or "")[: -1 if optional and text else None]
            ended()
        elif text is None:
            ended()
        else:
            run += text
    ended()
    alternatives.append(runs)
    return alternatives


def translate_replacement(template: str, pattern: Pattern) -> str:
    """Rewrite a replacement template (``$1``, ``${name}``, ``$$``) for ``regexp_replace``.

    An unknown group is empty; ``$1x`` is the group *named* ``1x``.
    """
    out = []
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)|(\\)|(\$)|(.)", template, re.S | re.A):
        name = m[1] or m[2]
        if m[0] == "$$" or m[4]:
            out.append(r"\$")
        elif name:
            index = int(name) if name.isdigit() else pattern.names.get(name, -1)
            if 0 <= index <= pattern.groups:
                out.append(f"${index}")
        elif m[3]:
            out.append(r"\\")
        else:
            # A digit right after a group number would be read as part of it.
            after_group = bool(out) and out[-1].startswith("$") and m[5].isdigit()
            out.append("\\" + m[5] if after_group else m[5])
    return "".join(out)


def literal_replacement(text: str) -> str:
    return text.replace("\\", r"\\").replace("$", r"\$")


def matches(text: Column, pattern: str) -> Column:
    """True where the pattern is found; null text matches nothing."""
    return F.coalesce(text.rlike(translate(pattern).java), F.lit(False))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


def replace_all(text: Column, pattern: str, template: str) -> Column:
    p = translate(pattern)
    return F.regexp_replace(text, F.lit(p.replacing), F.lit(translate_replacement(template, p)))
