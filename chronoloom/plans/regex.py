"""Regular expressions of matchers, from the RE2 dialect to Java's.

A matcher's pattern must match a whole value. Spark runs java.util.regex, which takes most of RE2's
syntax but means other things by some of it, and takes constructs that RE2 refuses. This module reads a
pattern by RE2's grammar and writes it in Java's. What RE2 refuses raises Refused; the caller then
compares the value with the pattern's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_REPEAT = 1_000
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "word": "w", "xdigit": "XDigit"}
_SPACE = r"\t\n\f\r "
_CONTROL = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>")


class Refused(ValueError):
    """The pattern isn't RE2."""


@dataclass(frozen=True)
class Translated:
    """java: a pattern for rlike that matches whole values. literals: all values that can match, if
    they are few and plain. prefix, suffix, inner: what any match starts with, ends with or contains."""

    java: str
    literals: tuple[str, ...] | None = None
    prefix: str = ""
    suffix: str = ""
    inner: str = ""


def translate(pattern: str) -> Translated:
    java = rf"(?d)\A(?:{_Reader(pattern).read()})\z"
    parts = pattern.split("|")
    if all(p == "" or _plain(p) for p in parts):
        return Translated(java, tuple(dict.fromkeys(parts)))
    ahead, behind = re.fullmatch(r"([\w /:@,=-]+)\.[*+].*", pattern, re.S), re.fullmatch(r".*\.[*+]([\w /:@,=-]+)", pattern, re.S)
    around = re.fullmatch(r"\.[*+]([\w /:@,=-]+)\.[*+]", pattern, re.S)
    if "|" in pattern or "(?" in pattern:
        return Translated(java)
    return Translated(java, None, ahead[1] if ahead else "", behind[1] if behind else "", around[1] if around else "")


def _plain(text: str) -> bool:
    return not re.search(r"[\\.+*?()|\[\]{}^$]", text)


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i, self.names = pattern, 0, set()
        self.multiline = [False]

    def read(self) -> str:
        out = self.alternatives()
        if self.i < len(self.p):
            raise Refused("unexpected )")
        return out

    def at(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def alternatives(self) -> str:
        out, repeatable = [], False
        while self.i < len(self.p) and not self.at(")"):
            c = self.p[self.i]
            if c == "|":
                self.i += 1
                out.append("|")
                repeatable = False
            elif c in "*+?" or (c == "{" and _REPEAT.match(self.p, self.i)):
                if not repeatable:
                    raise Refused("nothing to repeat")
                out.append(self.repetition())
                repeatable = False
            else:
                out.append(self.piece(c))
                repeatable = out[-1] != ""
        return "".join(out)

    def repetition(self) -> str:
        m = _REPEAT.match(self.p, self.i)
        text = m[0] if m else self.p[self.i]
        if m:
            low, high = int(m[1]), int(m[3]) if m[3] else int(m[1])
            if max(low, high) > MAX_REPEAT or high < low:
                raise Refused("bad repeat count")
        self.i += len(text)
        if self.at("?"):
            self.i += 1
            text += "?"
        return text

    def piece(self, c: str) -> str:
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == "\\":
            return self.escape(False)
        self.i += 1
        if c == "$":
            return "$" if self.multiline[-1] else r"\z"
        if c == "^":
            return "^" if self.multiline[-1] else r"\A"
        return "\\{" if c == "{" else c

    def group(self) -> str:
        opening = "("
        self.multiline.append(self.multiline[-1])
        if flags := _FLAGS.match(self.p, self.i):
            self.i = flags.end()
            on, off = flags[1], flags[2]
            if (off is not None and not off) or len(set(on)) < len(on) and flags[3] == ")":
                raise Refused("bad flags")
            if "m" in on:
                self.multiline[-1] = True
            if "m" in (off or ""):
                self.multiline[-1] = False
            java = on.replace("U", "").replace("i", "iu") + (f"-{off.replace('U', '').replace('i', 'iu')}" if off and off != "U" else "")
            if flags[3] == ")":
                scoped = self.multiline.pop()
                self.multiline[-1] = scoped
                return f"(?{java})" if java else ""
            opening = f"(?{java}:"
        elif named := _NAMED.match(self.p, self.i):
            if named[1] in self.names:
                raise Refused("repeated name")
            self.names.add(named[1])
            self.i = named.end()
        elif self.at("(?"):
            raise Refused("unknown group")
        else:
            self.i += 1
        inside = self.alternatives()
        if not self.at(")"):
            raise Refused("missing )")
        self.i += 1
        self.multiline.pop()
        return f"{opening}{inside})"

    def escape(self, in_class: bool) -> str:
        if self.i + 1 >= len(self.p):
            raise Refused("trailing \\")
        c = self.p[self.i + 1]
        self.i += 2
        if c in "pP":
            return self.unicode_class(c)
        if c == "x":
            return self.code()
        if c in "01234567":
            digits = re.compile("[0-7]{1,2}").match(self.p, self.i)
            if c != "0" and not digits:
                raise Refused("back reference")
            more = digits[0] if digits else ""
            self.i += len(more)
            return rf"\x{{{int(c + more, 8):x}}}"
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "s":
            return _SPACE if in_class else f"[{_SPACE}]"
        if c == "S":
            return f"[^{_SPACE}]"
        if c in "dDwW":
            return f"\\{c}"
        if in_class:
            if c.isascii() and c.isalnum():
                raise Refused(f"bad escape \\{c}")
            return f"\\{c}" if c.isascii() else c
        if c == "Q":
            end = self.p.find("\\E", self.i)
            text = self.p[self.i :] if end < 0 else self.p[self.i : end]
            self.i = len(self.p) if end < 0 else end + 2
            return re.sub(r"[^A-Za-z0-9_]", lambda m: rf"\x{{{ord(m[0]):x}}}", text)
        if c in "AzbB":
            return f"\\{c}"
        if c.isascii() and not c.isalnum():
            return f"\\{c}"
        raise Refused(f"bad escape \\{c}")

    def code(self) -> str:
        m = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.p, self.i)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise Refused("bad \\x")
        self.i = m.end()
        return rf"\x{{{m[1] or m[2]}}}"

    def unicode_class(self, letter: str) -> str:
        m = re.compile(r"\{(\^?)([A-Za-z_]+)\}|([A-Z])").match(self.p, self.i)
        if not m:
            raise Refused("bad class")
        self.i = m.end()
        name = m[2] or m[3]
        negated = (letter == "P") != bool(m[1])
        if name == "Any":
            return r"[^\x{0}-\x{10FFFF}]" if negated else r"[\x{0}-\x{10FFFF}]"
        return rf"\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def char_class(self) -> str:
        self.i += 1
        out = "["
        if self.at("^"):
            self.i += 1
            out = "[^"
        first, low = True, None
        while first or not self.at("]"):
            if self.i >= len(self.p):
                raise Refused("missing ]")
            posix = re.compile(r"\[:(\^?)([a-z]+):\]").match(self.p, self.i)
            c = self.p[self.i]
            if posix:
                if posix[2] not in _POSIX:
                    raise Refused("bad class")
                self.i = posix.end()
                name = _POSIX[posix[2]]
                piece = (f"\\{'W' if posix[1] else 'w'}" if name == "w" else rf"\{'P' if posix[1] else 'p'}{{{name}}}")
                low = None
            elif c == "\\":
                piece = self.escape(True)
                low = None
            else:
                self.i += 1
                if c == "-" and low is not None and self.i < len(self.p) and not self.at("]"):
                    high = self.p[self.i]
                    if high != "\\" and high < low:
                        raise Refused("bad range")
                    piece, low = "-", None
                    out += piece
                    first = False
                    continue
                piece = f"\\{c}" if c in "[]&^-~" else c
                low = c
            out += piece
            first = False
        self.i += 1
        return out + "]"
