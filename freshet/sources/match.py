"""Include and exclude patterns for relative paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_braces(pattern: str) -> list[str]:
    """`a{b,c}d` as `abd` and `acd`, nested ones too."""
    depth = 0
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                begin, cuts = i, [i]
            depth += 1
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                cuts.append(i)
                options = [pattern[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
                return [x for o in options for x in expand_braces(pattern[:begin] + o + pattern[i + 1 :])]
    return [pattern]


def glob_regex(pattern: str) -> str:
    """A regular expression, for Python and Java alike, that a whole path must fit. `*` crosses `/`; `**/` may be nothing."""
    out = []
    for p in expand_braces(pattern):
        i, text = 0, ""
        while i < len(p):
            if p.startswith("**/", i):
                text, i = text + "(?:.*/)?", i + 3
            elif p[i] == "*":
                while i < len(p) and p[i] == "*":
                    i += 1
                text += ".*"
            elif p[i] == "?":
                text, i = text + ".", i + 1
            elif p[i] == "[" and "]" in p[i + 2 :]:
                j = p.index("]", i + 2)
                body = p[i + 1 : j].replace("\\", "\\\\")
                text, i = text + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
            else:
                text, i = text + re.escape(p[i]), i + 1
        out.append(text)
    return "(?s)^(?:" + "|".join(out) + ")$"


@dataclass(frozen=True)
class PatternMatcher:
    """A file is in if any include pattern fits (or there are none) and it is not excluded; it is excluded if an exclude pattern fits and no `!` pattern does."""

    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def _split(self) -> tuple[list[str], list[str]]:
        return [p for p in self.excluded if not p.startswith("!")], [p[1:] for p in self.excluded if p.startswith("!")]

    def column(self, path: Column) -> Column:
        """The same as a filter on a column of paths."""
        fits = lambda some: path.rlike("|".join(f"(?:{glob_regex(p)})" for p in some)) if some else F.lit(False)
        out, back = self._split()
        return (fits(self.included) if self.included else F.lit(True)) & ~(fits(out) & ~fits(back))

    def is_file_included(self, path: str) -> bool:
        fits = lambda some: any(re.match(glob_regex(p), path) for p in some)
        out, back = self._split()
        return (not self.included or fits(self.included)) and not (fits(out) and not fits(back))

    def is_dir_included(self, path: str) -> bool:
        """Whether a folder is worth listing: not excluded, or a `!` pattern fits it or could fit something in it."""
        out, back = self._split()
        hit = lambda p: any(re.match(glob_regex(g), p) for g in out)
        if not hit(path):
            return True
        spared = lambda p: any(re.match(glob_regex(g), p) for g in back)
        return spared(path) or spared(f"{path}/__probe__") or any(e.startswith(f"{path}/") for g in back for e in expand_braces(g))


MATCH_ALL = PatternMatcher()
