r"""Include / exclude globs and the hidden rule as Spark predicates.

Globs follow the conventions of ignore-file overrides: a pattern without a
slash matches the base name at any depth, a slash anchors it at the root, ``*``
and ``?`` stay inside one path component, ``**`` crosses components, ``{a,b}``
and ``[a-z]`` work as usual, a leading ``!`` excludes, a trailing ``/`` matches
directories only, matching ignores ASCII case, and the last matching glob wins. A
directory that is excluded takes everything below it with it.

Every glob becomes one regular expression on the driver. The expressions use
only syntax that Java and Python share, because the listing tasks prune
directories with the same patterns that the JVM filter applies.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a path component that starts with a dot.
_HIDDEN_COMPONENT = r"(^|/)\."


@dataclass(frozen=True)
class Glob:
    regex: str
    exclude: bool
    dir_only: bool


def _char_class(text: str, start: int) -> tuple[str, int] | None:
    """Translate the class opening at ``start``; None when it is not closed."""
    end = start + 1
    negated = end < len(text) and text[end] in "!^"
    end += negated
    body_start = end
    while end < len(text) and (text[end] != "]" or end == body_start):
        end += 1
    if end >= len(text):
        return None
    body = re.sub(r"([\\\[\]&^~])", r"\\\1", text[body_start:end])
    return f"[{'^' if negated else ''}{body}]", end + 1


def glob_body(text: str) -> str:
    """Regular expression for the part of a glob after flags are removed."""
    out: list[str] = []
    depth, i = 0, 0
    while i < len(text):
        at_component = i == 0 or text[i - 1] == "/"
        if at_component and text.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif at_component and text[i:] == "**":
            out.append(".*")
            i += 2
        elif text[i] == "*":
            out.append("[^/]*")
            i += 1 + (text[i + 1 : i + 2] == "*")
        elif text[i] == "?":
            out.append("[^/]")
            i += 1
        elif text[i] == "[":
            translated = _char_class(text, i)
            if translated is None:
                raise ValueError(f"unclosed character class in glob {text!r}")
            out.append(translated[0])
            i = translated[1]
        elif text[i] == "{":
            out.append("(?:")
            depth += 1
            i += 1
        elif text[i] == "}" and depth:
            out.append(")")
            depth -= 1
            i += 1
        elif text[i] == "," and depth:
            out.append("|")
            i += 1
        elif text[i] == "\\":
            if i + 1 == len(text):
                raise ValueError(f"dangling escape in glob {text!r}")
            out.append(re.escape(text[i + 1]))
            i += 2
        else:
            out.append(re.escape(text[i]))
            i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {text!r}")
    return "".join(out)


def parse_glob(pattern: str) -> Glob | None:
    """One glob, or None for a blank line or a comment."""
    text = pattern if pattern.endswith("\\ ") else pattern.rstrip()
    if not text or text.startswith("#"):
        return None
    exclude = text.startswith("!")
    text = text[1:] if exclude else text
    anchored = text.startswith("/")
    text = text.lstrip("/") if anchored else text
    dir_only = text.endswith("/")
    text = text.rstrip("/") if dir_only else text
    if not anchored and "/" not in text and not text.startswith("**/"):
        text = "**/" + text
    if text.endswith("/**"):
        text += "/*"
    return Glob(f"(?is)^{glob_body(text)}(?!.)", exclude, dir_only)


def parse_globs(patterns: Sequence[str]) -> list[Glob]:
    """Parse on the driver, so that a bad glob fails the run before it starts."""
    globs = [g for g in map(parse_glob, patterns) if g is not None]
    for glob in globs:
        re.compile(glob.regex)
    return globs


def _last_match(path: Column, globs: Sequence[Glob], is_dir: bool) -> Column:
    """'keep' or 'drop' by the last glob that matches, NULL when none does."""
    verdict = F.lit(None).cast("string")
    for glob in globs:
        if is_dir or not glob.dir_only:
            verdict = F.when(path.rlike(glob.regex), F.lit("drop" if glob.exclude else "keep")).otherwise(verdict)
    return verdict


def is_hidden(rel_path: Column) -> Column:
    return rel_path.rlike(_HIDDEN_COMPONENT)


def _dir_is_pruned(rel_dir: Column, globs: Sequence[Glob], ignore_hidden: bool) -> Column:
    hidden = F.startswith(F.substring_index(rel_dir, "/", -1), F.lit(".")) if ignore_hidden else F.lit(False)
    verdict = _last_match(rel_dir, globs, is_dir=True)
    return F.coalesce(verdict == "drop", hidden)


def keeps_file(rel_path: Column, patterns: Sequence[str] = (), ignore_hidden: bool = False) -> Column:
    """Predicate on the relative path of a file: does the scan emit it?"""
    globs = parse_globs(patterns)
    if not globs:
        return ~is_hidden(rel_path) if ignore_hidden else F.lit(True)

    includes = any(not g.exclude for g in globs)
    verdict = _last_match(rel_path, globs, is_dir=False)
    unmatched = F.lit(not includes)
    if ignore_hidden and not includes:
        unmatched = ~F.startswith(F.substring_index(rel_path, "/", -1), F.lit("."))
    keep = F.coalesce(verdict == "keep", unmatched)

    # Only exclusions and the hidden rule can remove a directory above a file.
    if ignore_hidden or any(g.exclude for g in globs):
        parts = F.split(rel_path, "/")
        depths = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda d: d < F.size(parts))
        above = F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/"))
        keep = keep & ~F.exists(above, lambda d: _dir_is_pruned(d, globs, ignore_hidden))
    return keep


def dir_pruner(globs: Sequence[Glob], ignore_hidden: bool):
    """The directory rule as a plain function, for use inside listing tasks."""
    rules = [(re.compile(g.regex, re.ASCII), g.exclude) for g in globs]

    def pruned(rel_dir: str) -> bool:
        verdicts = [exclude for regex, exclude in rules if regex.search(rel_dir)]
        if verdicts:
            return verdicts[-1]
        return ignore_hidden and rel_dir.rsplit("/", 1)[-1].startswith(".")

    return pruned

