"""Secret scans: base patterns, plus assignments found by a lexer.

The lexer reads source and configuration syntax (``name = "literal"``,
``name: literal``, ``name: type = "literal"``, ``export NAME=literal``, JSON members,
``.env`` lines, form data, XML attributes and elements, ``table["name"] = "literal"``,
``#define NAME "literal"``, defaults as in ``getenv("NAME", "literal")``) into pairs of a
name and a literal. Strings may have prefixes, three quotes or backticks. A literal may be a concatenation of quoted strings and names, and
a name on the right-hand side (also ``$NAME`` and ``${NAME}``, in quotes too) is
replaced by the constant last assigned to it in the same text. A PEM block is one
literal, also over several lines. Every literal is scored by how sensitive its target
name is and how random it looks; private keys score by their frame, values of several
words by the name alone. A pair of at least the threshold adds a span for each of the
literal's parts (of kind ``lexed``), also at the place a constant was defined if only
its use has a sensitive name. No length is limited: signs are met from left to right,
and what a sign's target or value takes is read once.

The base spans are those of three fixed patterns, and stay as they are; a lexed
span is added only where no base span covers it.

Defined results. Null text counts as empty and has no spans. Offsets are code
points, the end exclusive. Whole texts are scanned, one at a time; memory is
bounded by the longest text. Repeated rows get equal results. Only ``doc_id`` and
``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed patterns of the contract, in the order the kinds are listed; letters of the
# keywords in either case, ASCII only.
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs shorter than 16 fail; requiring 16 finds the same maximal runs, faster.
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "lexed")

# Words that make a target name sensitive, and how much; parts of names.
_SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "pass": 1, "secret": 3, "token": 2, "apikey": 3, "credential": 3,
    "credentials": 3, "private": 1, "auth": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "encryption": 1, "bearer": 2, "cookie": 1,
}
_HARMLESS = {"public", "example", "placeholder", "id", "name", "file", "path", "url", "count", "length", "type", "hash", "sum"}
THRESHOLD = 3.0
_SHORTEST = 8

_QUOTED = (
    r"""(?:[rRbBfFuU]{1,2}(?=["']))?(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}"""
    r"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\\n]*+(?:\\.[^`\\\n]*+)*+`)"""
)
_FRAME = re.compile(r"""[A-Za-z]*+(?:"{3}|'{3}|["'`])""")
# Prose has few assignment signs, so they are found first.
_SIGN = re.compile(r"(?<![:=!<>])(?::=|=>|[:=])(?![=:])")
_BLANKS = " \t"
_NAMED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_FIRST = re.compile(r"[0-9.-]*")
# A bare value ends before an equals sign with more behind it and before the next name of form data,
# so no two values take the same text.
_BARE = r"(?:[A-Za-z0-9_$+/.~!@%^*-]|&(?![A-Za-z0-9_.-]*+=))++=*+"
_USE = r"\$\{[A-Za-z_][A-Za-z0-9_]*+\}|\$?[A-Za-z_][A-Za-z0-9_$]*+(?:\.[A-Za-z_][A-Za-z0-9_$]*+)*+(?![A-Za-z0-9_$+/.=~!@%^&*(\[-])"
_OPERAND = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<use>{_USE})")
_VALUE = re.compile(rf"(?P<quoted>{_QUOTED})|(?P<use>\$\{{[A-Za-z_][A-Za-z0-9_]*+\}})|(?P<bare>{_BARE})")
_JOIN = re.compile(r"[ \t]*+[+.][ \t]*+")
_OPEN = re.compile(r"""[ \t]*+["']""")
_SPACE = re.compile(r"[ \t]*+")
_INSERTED = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*+)\}|([A-Za-z_][A-Za-z0-9_]*+))")
# Between a name and the sign of its value: a type, its brackets taken out of the second pattern.
_TYPED = re.compile(r"""[ \t]*+([A-Za-z_$][^=:"'\n;{}()]*+)=(?![=>])""")
_TYPE = re.compile(r"[\w$.]++[?!]?(?:[ \t]*+[|&][ \t]*+[\w$.]++[?!]?)*+[ \t]*+")
# Names with a literal that no sign of assignment stands between.
_DEFINE = re.compile(r"^[ \t]*+#[ \t]*+define[ \t]++([A-Za-z_]\w*+)[ \t]++(?=[\"'A-Za-z0-9])", re.M)
_DEFAULT = re.compile(r"""\b(?:get\w*+|env|environ|property|setdefault)\([ \t]*+(["'])([A-Za-z_][\w.-]*+)\1[ \t]*+,(?=[ \t]*+["'`])""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)>([^<>\n]++)(?=</\1>)")
_PEM = re.compile(r"""[ \t]*+(?:[|>][+-]?[ \t]*+\n[ \t]*+)?["'`]*+(?=-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY)""")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]++ )*?PRIVATE KEY[A-Z ]*+-----")
_PEM_BEGIN = re.compile("-----BEGIN ")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,.-]*+")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = []
    for match in _ASSIGN.finditer(text):
        if match.end(2) - match.start(2) >= _LEAST["assign"]:
            found.append((match.start(), match.end(), "assign"))
    if "AKIA" in text:
        for match in _ACCESS.finditer(text):
            if match.end() - match.start() >= _LEAST["access"]:
                found.append((match.start(), match.end(), "access"))
    for match in _HEX_LONG.finditer(text):
        found.append((match.start(), match.end(), "hex"))
    found.sort(key=lambda span: (span[0], KINDS.index(span[2])))
    return found


def name_score(name: str) -> float:
    parts = [part.lower() for part in _PARTS.findall(name)]
    score = sum(_SENSITIVE.get(part, 0) for part in parts)
    score += sum(2 for pair in zip(parts, parts[1:]) if pair in (("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key")))
    return score - 2 * sum(part in _HARMLESS for part in parts)


class Literal:
    """What scoring needs of a string, and where its parts stand: (start, end), or
    the literals it was put together from. Its size does not grow by concatenation."""

    __slots__ = ("text", "size", "key", "places", "_counts")

    def __init__(self, text: str = "", places: tuple = ()):
        self.text, self.size, self.places, self._counts = text, len(text), places, None
        self.key = "-----BEGIN" in text and _KEY_BLOCK.search(text) is not None

    @property
    def counts(self) -> Counter:
        """Its characters, counted when a sensitive name or a concatenation asks."""
        if self._counts is None:
            self._counts = Counter(self.text)
        return self._counts

    def __add__(self, other: Literal) -> Literal:
        both = Literal(places=(self, other))
        both._counts, both.size, both.key = self.counts + other.counts, self.size + other.size, self.key or other.key
        return both

    def score(self) -> float:
        """Randomness: bits per character, with credit for mixed character classes.
        Private keys have the threshold; several words have none, so that the name decides."""
        if self.key:
            return THRESHOLD
        if self.size < _SHORTEST or len(self.counts) < 5:
            return -3.0
        if any(map(str.isspace, self.counts)):
            return 0.0
        bits = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        kinds = any(map(str.isdigit, self.counts)) + any(map(str.islower, self.counts)) + any(map(str.isupper, self.counts))
        return (bits - 3.0) + (kinds - 2) * 0.5 + (0.5 if self.size >= 16 else 0.0)


def _target(text: str, sign: int) -> str | None:
    """The name before a sign: bare, quoted, or the last subscript of a table."""

    def name_before(end: int) -> tuple[str, int]:
        begin = end
        while begin and text[begin - 1] in _NAMED:
            begin -= 1
        return text[begin + _FIRST.match(text, begin, end).end() - begin : end], begin

    end = sign
    while end and text[end - 1] in _BLANKS:
        end -= 1
    if end and text[end - 1] == "]":
        end -= 1
        quote = text[end - 1] if end and text[end - 1] in "\"'" else ""
        name, begin = name_before(end - len(quote))
        if text[begin - len(quote) - 1 : begin] != "[" + quote:
            return None
        return name or name_before(begin - len(quote) - 1)[0] or None
    if end and text[end - 1] in "\"'":
        end -= 1
    return name_before(end)[0] or None


def _inside(match: re.Match) -> tuple[int, int]:
    """Where the text between the quotes stands."""
    frame = _FRAME.match(match.string, match.start("quoted"))
    return frame.end(), match.end("quoted") - len(frame.group().lstrip("rRbBfFuU"))


def _operand(match: re.Match, constants: dict[str, Literal]) -> Literal | None:
    """A quoted string with the names inserted into it, or the constant that is named."""
    if match["quoted"] is None:
        name = match["use"]
        return constants.get(name) or constants.get(name.strip("${}"))
    start, end = _inside(match)
    inner = match.string[start:end]
    made = Literal(inner, ((start, start + len(inner)),))
    used = [constants[m[1] or m[2]] for m in _INSERTED.finditer(inner) if (m[1] or m[2]) in constants]
    if used and not _INSERTED.sub("", inner):
        made = used.pop(0)
    for literal in used:
        made = made + literal
    return made


def _value(text: str, at: int, constants: dict[str, Literal], blocks: dict[int, int]) -> Literal | None:
    if framed := _PEM.match(text, at):
        begin = framed.end()
        if begin in blocks:
            return Literal(text[begin : blocks[begin]], ((begin, blocks[begin]),))
    at = _SPACE.match(text, at).end()
    match = _OPERAND.match(text, at)
    literal = match and _operand(match, constants)
    joined, run = False, _inside(match) if match and match["quoted"] is not None else None
    while match and (sign := _JOIN.match(text, match.end())) and (following := _OPERAND.match(text, sign.end())):
        joined, match = True, following
        more = _operand(match, constants)
        if match["quoted"] is None:
            run = None
        elif run and literal and more and literal.places == (run,) and len(more.places) == 1 and isinstance(more.places[0], tuple):
            # Neighbouring quoted strings have one span.
            run = (run[0], _inside(match)[1])
            literal = literal + more
            literal.places = (run,)
            continue
        else:
            run = _inside(match)
        literal = literal + more if literal and more else literal or more
    if literal and (joined or match["quoted"] is not None or match["use"]):
        return literal
    match = _VALUE.match(text, at)
    if not match or match["bare"] is None:
        return None
    bare = match["bare"].rstrip(".")
    start = match.start("bare")
    return constants.get(bare) or constants.get(bare.lstrip("$")) or Literal(bare, ((start, start + len(bare)),))


def _annotated(text: str, at: int) -> int | None:
    """Where the value starts if a type stands between the colon at ``at`` and it."""
    match = _TYPED.match(text, at)
    if not match:
        return None
    depth, outside = 0, []
    for c in match[1]:
        depth += c in "[<"
        if not depth:
            outside.append(c)
        depth -= c in "]>" and depth > 0
    return match.end() if not depth and _TYPE.fullmatch("".join(outside)) else None


def pairs(text: str) -> list[tuple[str, Literal]]:
    """(name, literal) in order; names on the right become constants."""
    constants: dict[str, Literal] = {}
    begins = [match.start() for match in _PEM_BEGIN.finditer(text)]
    blocks: dict[int, int] = {}  # where private keys that end before the next begins start and end
    for at, end in {bisect.bisect_left(begins, m.start()) - 1: m for m in reversed([*_PEM_END.finditer(text)])}.items():
        if at >= 0 and _PEM_BODY.fullmatch(text, begins[at], end.start()):
            blocks[begins[at]] = end.end()
    found, typed = [], {}
    marked = [kind for kind, mark in ((_DEFINE, "define"), (_DEFAULT, "("), (_ELEMENT, "</")) if mark in text]
    others = [m for kind in marked for m in kind.finditer(text)]
    for sign in heapq.merge(_SIGN.finditer(text), sorted(others, key=re.Match.end), key=re.Match.end):
        if sign.re is not _SIGN:
            name = sign[2] if sign.re is _DEFAULT else sign[1]
            if sign.re is _ELEMENT:
                literal = Literal(sign[2], (sign.span(2),))
            else:
                literal = _value(text, sign.end(), constants, blocks)
            if literal and literal.size:
                constants[name] = literal
                found.append((name, literal))
            continue
        name = _target(text, sign.start())
        if name and sign.group() == ":" and (begin := _annotated(text, sign.end())):
            typed[begin] = name
            if _OPEN.match(text, begin):
                continue
        literal = (name or sign.end() in typed) and _value(text, sign.end(), constants, blocks)
        if not literal or not literal.size:
            continue
        for target in (typed.pop(sign.end(), None), name):
            if target:
                constants[target] = literal
                found.append((target, literal))
    return found


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    if not any(mark in text for mark in ("=", ":", "#", "</", "(")):
        return []
    found, met = set(), set()
    for name, literal in pairs(text):
        named = name_score(name)
        if named > 0 and named + literal.score() >= THRESHOLD:
            todo = [literal]
            while todo:
                part = todo.pop()
                if isinstance(part, tuple):
                    found.add((*part, "lexed"))
                elif id(part) not in met:
                    met.add(id(part))
                    todo.extend(part.places)
    return sorted(found)


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added): all spans of a text; added ones lie in no base span."""
    text = text or ""
    base = base_spans(text)
    # How far the base spans reach that start at or before each of them.
    starts, reach = [b[0] for b in base], [0, *accumulate((b[1] for b in base), max)]
    added = [s for s in lexed_spans(text) if reach[bisect.bisect_right(starts, s[0])] < s[1]]
    return base, added


def _spell(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        for text in batch.column("text"):
            base, added = spans(text.as_py())
            kinds = Counter(span[2] for span in base)
            everything = sorted(base + added, key=lambda span: (span[0], KINDS.index(span[2])))
            row = (kinds["assign"], kinds["access"], kinds["hex"], _spell(base), _spell(everything))
            for column, value in zip(columns, row):
                column.append(value)
        kinds_of = [pa.int64()] * 3 + [pa.string()] * 2
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds_of)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): one row per document."""
    rows = docs.select(F.col("doc_id"), F.col("text"))
    out = T.StructType(
        [rows.schema["doc_id"]]
        + [T.StructField(name, T.LongType()) for name in ("n_assign", "n_access", "n_hex")]
        + [T.StructField(name, T.StringType()) for name in ("base", "spans")]
    )
    return rows.mapInArrow(_scan, out)


def located_secrets(docs: DataFrame) -> DataFrame:
    """One row per secret: doc_id, kind, start, end."""
    each = F.explode(F.filter(F.split("spans", ","), lambda s: s != "")).alias("span")
    found = scan(docs).select("doc_id", each)
    part = F.split("span", ":")
    return found.select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
