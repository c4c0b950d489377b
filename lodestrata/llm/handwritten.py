"""Source files that nobody wrote by hand in the project: generated, minified, copied in, or data saved as code.

Each file is lexed by the rules of its language, whole, and its code is emitted again in a canonical layout: one statement
a line, blanks between words, around operators and after commas. Held against the original layout,

* a canonical form of many times the lines and blanks marks a minified file;
* statements that follow one another in perfect uniformity, the same but for counters and names in order, mark a generated
  one (people vary, and do not sort); the chance that hands would have written them so is put as bits of evidence;
* literals that take most of the code mark data.

Only where the layout is silent, marks in comments and annotations decide, then folders and names. The text of a third
party's source looks like anybody's; it is known by the mark at its head or by its folder.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import spread

# Comment syntax by file ending.
C_LIKE = ("java", "kt", "kts", "scala", "cs", "js", "jsx", "ts", "tsx", "mjs", "c", "h", "cc", "cpp", "go", "rs", "swift", "groovy")
HASH = ("py", "rb", "sh", "yaml", "yml", "toml", "lock", "cfg", "ini", "pl", "r", "properties")
CSS = ("css", "scss", "less")
SQL = ("sql", "lua", "hs")
MARKUP = ("md", "txt", "rst", "html", "xml")
#: Languages of settings, whose lines are all alike by nature.
SETTINGS = ("yaml", "yml", "toml", "cfg", "ini", "properties", "lock")
#: Bits of evidence from which on a stretch of statements was not typed, and its groups; a few are typed like that, too.
UNIFORM, UNIFORM_GROUPS = 9.0, 7
#: Bits that a counter going on by the same step gives.
STEP_BITS = 3.0
#: Statements of the groups that are held against each other, at most.
PERIODS = 8
#: Literals from which on, with their share of the code, a file is data.
DATA_LITERALS, DATA_SHARE = 60, 0.3
#: Characters of literals from which on, with their share of the code, a file is data.
DATA_CHARS, DATA_CHARS_SHARE = 600, 0.8
#: Statements a line, and share of the canonical blanks, from which on or below which a file of statements is minified.
MINIFIED_EXPANSION, MINIFIED_BLANKS, MINIFIED_STATEMENTS = 3.0, 0.5, 12

_STRINGS = r"""\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?"""
_REST = r"(?P<num>\#[0-9a-fA-F]{3,8}\b|0[xXbB][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?\w*)|(?P<word>[^\W\d]\w*)|(?P<space>\s+)|(?P<sign>.)"


def _lexer(*comments: str) -> re.Pattern:
    comment = "|".join(comments)
    return re.compile(rf"(?P<comment>{comment})|(?P<str>{_STRINGS})|{_REST}" if comments else rf"(?P<str>{_STRINGS})|{_REST}")


_BLOCK, _SLASHES, _POUND, _DASHES = r"/\*[\s\S]*?(?:\*/|\Z)", r"//[^\n]*", r"\#[^\n]*", r"--[^\n]*"
LEXERS = (
    {e: _lexer(_BLOCK, _SLASHES) for e in C_LIKE}
    | {e: _lexer(_POUND) for e in HASH}
    | {e: _lexer(_BLOCK) for e in CSS}
    | {e: _lexer(_BLOCK, _DASHES) for e in SQL}
    | {e: _lexer(r"<!--[\s\S]*?(?:-->|\Z)") for e in MARKUP}
    | {"php": _lexer(_BLOCK, _SLASHES, _POUND)}
)
PLAIN = _lexer(_BLOCK, _SLASHES, _POUND)

# What generators write at the head of their output, and third parties at the head of theirs.
GENERATED = re.compile(
    r"""(?ix) ^ (?:
      (?:this\ )? code\ (?:was\ |is\ )?(?:automatically\ |auto-?)?generated\ (?:by|from|with)\b
    | auto-?generated\ (?:by|from|with|file|code)\b | automatically\ generated\b
    | </?auto-?generated\b | @generated\b(?=\W*(?:$|from|by|with|<|\w+<))
    | generated\ (?:\d{4}-\d\d-\d\d|by|with|from|using|on\ \d)\b
    | (?:this|the)\ (?:file|code|class|source|module|script)\ (?:was|is|has\ been)\ (?:\w+\ ){0,2}?(?:generated|(?:created|produced|made|written)\ by\ (?:the|a)\ [\w-]+\ (?:compiler|generator|tool))
    | machine-?\ ?(?:made|generated|written)\ by\b
    | (?:ce\ )?fichier\ (?:a\ été\ )?(?:auto)?généré\b | (?:diese\ datei|dieser\ code)\ wurde\ (?:automatisch\ )?(?:erzeugt|generiert|erstellt)
    | (?:este\ )?(?:archivo|fichero|arquivo|código)\ (?:fue\ |foi\ )?(?:auto)?(?:generado|gerado)\b
    | (?:written|updated|maintained)\ by\ the\ [\w-]+,\ run\b
    | (?:do\ not|don't)\ (?:edit|modify|change)\b.{0,60}\b(?:generated|overwritten)
    )"""
)
THIRD_PARTY = re.compile(
    r"""(?ix) ^ (?:
      @(?:license|preserve)\ +(?P<a>[\w.@/-]+)
    | !?\s*(?P<b>[\w.@/-]+)\ +v?\d+\.\d+[\w.+-]*\ +[|–-]\ .*(?:licen[cs]e|contributors|copyright|\(c\)|https?://)
    | this\ file\ is\ part\ of\ (?:the\ )?(?P<c>[\w-]+)\b
    | (?:copied|vendored|imported|taken|adapted|forked|borrowed)\ (?:verbatim\ |unchanged\ )?from\ (?:the\ )?(?P<d>[\w./@-]+)\ .*\b(?:revision|commit|version|release|upstream|v?\d+\.\d+)
    )"""
)
ANNOTATION = re.compile(r"(?:@(?:[\w.]+\.)?Generated\s*\(|\[(?:[\w.]+\.)?GeneratedCode(?:Attribute)?\s*\()")
# Folders and file names by convention.
GENERATED_PATH = re.compile(
    r"(?:^|/)(?:generated(?:[-_](?:src|sources?|code))?|(?:src|source)s?[-_]gen|gen/src|autogen|__generated__)/"
    r"|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|\.g\.(?:ts|cs|dart|js)$|\.designer\.(?:cs|js|vb|ts)$|\.gen(?:erated)?\.\w+$"
    r"|(?:^|/)(?:package-lock\.json|yarn\.lock|[\w.-]+\.lock|[\w.-]*-lock\.(?:ya?ml|json)|go\.sum)$",
    re.IGNORECASE,
)
THIRD_PARTY_PATH = re.compile(
    r"(?:^|/)(?:vendors?|third[-_]?party|3rdparty|node_modules|bower_components|deps|extern(?:al)?|ext|shaded|repack(?:aged)?|contrib)/[^/]+/",
    re.IGNORECASE,
)
MINIFIED_PATH = re.compile(r"\.min\.(?:js|css|mjs)$", re.IGNORECASE)


@dataclass
class Lexed:
    """What the tokens of a file say."""

    #: Text of each comment, and whether only the package, imports and the like stand before it.
    comments: list[tuple[bool, str]] = field(default_factory=list)
    #: The canonical form: its statements, each a list of tokens; long literals are cut in it.
    statements: list[list[str]] = field(default_factory=list)
    code_lines: int = 0
    code_chars: int = 0
    literal_chars: int = 0
    literals: int = 0
    #: Places inside lines where the canonical form has a blank, and how many of them have one in the original.
    blanks: int = 0
    blanks_there: int = 0

    def canonical(self) -> str:
        """The canonical form as text."""
        return "\n".join(emitted(x) for x in self.statements)


#: Tokens that the canonical form has blanks around, and those it has one after.
_SPACED = frozenset("= + - * / % < > & | ? : == != <= >= += -= *= /= |= &= && || -> =>".split())
_AFTER = frozenset(",;")


def _blank_between(a: str, b: str) -> bool:
    """Whether the canonical form has a blank between two tokens."""
    if a in _AFTER or a in _SPACED or b in _SPACED or b == "{":
        return True
    return (a[-1].isalnum() or a[-1] == "_") and (b[0].isalnum() or b[0] in "_\"'")


def emitted(tokens: list[str]) -> str:
    """A statement in canonical layout."""
    out = tokens[:1]
    for a, b in zip(tokens, tokens[1:], strict=False):
        out += [" ", b] if _blank_between(a, b) else [b]
    return "".join(out)


def decode(content: bytes) -> str:
    """The text of a file: by its byte order mark, else UTF-8, else as Windows-1252, which takes any byte."""
    if content[:3] == b"\xef\xbb\xbf":
        content = content[3:]
    elif content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


_HEAD = re.compile(r"(?:import|using|use|package|namespace|include|require|from|module)\b")


def lex(text: str, ending: str) -> Lexed:
    """The tokens of a text, and its canonical form.

    A statement ends at ``;``, at braces, and at a line's end outside of parentheses.
    """
    out = Lexed()
    statement: list[str] = []
    depth, head, spaced = 0, True, False
    lines_with_code, line = set(), 0

    def end() -> None:
        nonlocal statement, head
        if statement:
            out.statements.append(statement)
            if head and not _HEAD.match(statement[0]):
                head = len(statement) == 1 and not statement[0][0].isalnum() or statement[0] in ("<", "?", "php")
            statement = []

    for m in LEXERS.get(ending, PLAIN).finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "space":
            breaks = s.count("\n")
            line += breaks
            spaced = True
            if breaks and not depth:
                end()
            continue
        if kind == "comment":
            out.comments.append((head and not statement, s))
            line += s.count("\n")
            spaced = True
            continue
        if statement and line in lines_with_code and _blank_between(statement[-1], s):
            out.blanks += 1
            out.blanks_there += spaced
        spaced = False
        lines_with_code.add(line)
        line += s.count("\n")
        size = len(s)
        out.code_chars += size
        if kind == "num" or kind == "str":
            # prose in a string is no data: words apart by blanks
            if kind == "num" or size <= 16 or s.count(" ") * 24 < size:
                out.literal_chars += size
                out.literals += 1
            statement.append(s if size < 40 else s[:39] + s[-1])
            continue
        statement.append(s)
        if s in "([":
            depth += 1
        elif s in ")]":
            depth = max(0, depth - 1)
        elif s in "{}":
            depth = 0
            end()
        elif s == ";" and not depth:
            end()
    end()
    out.code_lines = len(lines_with_code)
    return out


def _comment_lines(comment: str) -> Iterator[str]:
    for x in comment.splitlines():
        x = re.sub(r"^[\s/*#!<-]*(?<!<)(?=<auto)|^\s*(?:/\*+!?|//+!?|\*+(?!/)|#+\s*!?|--+|<!--)\s*", "", x)
        x = re.sub(r"\s*(?:\*+/|-->)\s*$", "", x).strip()
        if x:
            yield x


def _own(name: str, path: str) -> bool:
    """Whether ``name`` is the project of ``path`` itself."""
    project = re.split(r"[\W_]+", path.split("/")[0].lower())
    return bool(set(re.split(r"[\W_]+", name.lower())) & set(filter(None, project)))


_PIECES = re.compile(r"0[xX][0-9a-fA-F]+|\d+|[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+|[^\w\s]|_")
_NO_PIECE = re.compile(r"(?:import|using|use|package|namespace|include|require)\b|[{}()\[\];\s]*$")
_WORD, _NUMBER = "w", "n"


def _pieces(statement: list[str]) -> tuple[str, list[str]] | None:
    """The kinds of the pieces of a statement as one text, and the pieces; None for what people repeat, too."""
    text = emitted(statement)
    if _NO_PIECE.match(text):
        return None
    pieces = _PIECES.findall(text)
    return "".join([_WORD if x[0].isalpha() else _NUMBER if x[0].isdigit() else x for x in pieces]), pieces


def _number(x: str) -> int:
    if not x.isascii():
        return 0  # digits of other scripts count nothing
    return int(x, 16) if x[:2] in ("0x", "0X") else int(x[:18])


def uniformity(statements: list[list[str]]) -> float:
    """Bits of evidence that the most uniform stretch of statements was not typed.

    Groups of one to PERIODS statements are held against the group before. A stretch goes on while all statements have the
    same layout, numbers go on by the same step (or double), and names are the same but for one, which comes later in the
    alphabet each time. That k names come in order by chance has log2(k!) bits; each step of counters has STEP_BITS.
    Stretches of fewer than UNIFORM_GROUPS groups are none.
    """
    rows = [x for x in map(_pieces, statements) if x]
    ids: dict[str, int] = {}
    shapes = [ids.setdefault(k, len(ids)) for k, _ in rows]
    best = 0.0
    for period in range(1, min(PERIODS, len(rows) // 2) + 1):
        equal = [x == y for x, y in zip(shapes, shapes[period:], strict=False)]
        at = 0
        while at < len(equal):
            if not equal[at]:
                at += 1
                continue
            end = at
            while end < len(equal) and equal[end]:
                end += 1
            for first in range(at, min(at + period, end)):
                best = max(best, _gone_on([p for _, p in rows[first : end + period]], period))
            at = end
    return best


def _gone_on(rows: list[list[str]], period: int) -> float:
    """The most bits of a stretch of whole groups; see :func:`uniformity`."""
    groups = [[x for row in rows[i : i + period] for x in row] for i in range(0, len(rows) - period + 1, period)]
    best = bits = 0.0
    size, last = 1, {}
    for a, b in zip(groups, groups[1:], strict=False):
        steps, words, good = {}, {}, True
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x == y:
                continue
            if x[0].isdigit() and y[0].isdigit():
                m, n = _number(x), _number(y)
                # the first step sets it; a double may begin at one
                steps[i] = n - m
                good &= n == 2 * m > 0 or (last[i] == n - m if i in last else n > m)
            else:
                pair = (x.lower(), y.lower())
                words[pair] = words.get(pair, 0) + 1
        key, times = max(words.items(), key=lambda e: e[1], default=(None, 0))
        ordered = times > 0 and key[0] < key[1] and (len(words) == 1 or times > 1 and sum(words.values()) - times < 2)
        if not (good and steps and len(words) < 3 or not steps and ordered):
            bits, size, last = 0.0, 1, {}
            continue
        size += 1
        bits += (STEP_BITS if steps else 0.0) + (math.log2(size) if ordered else 0.0)
        last = steps
        if size >= UNIFORM_GROUPS:
            best = max(best, bits)
    return best


def by_layout(seen: Lexed, ending: str) -> str | None:
    """What the literals and the canonical form say."""
    if ending in MARKUP or not seen.code_chars:
        return None
    share = seen.literal_chars / seen.code_chars
    if (seen.literals >= DATA_LITERALS and share >= DATA_SHARE) or (seen.literal_chars >= DATA_CHARS and share >= DATA_CHARS_SHARE):
        return "data: literals"
    statements = len(seen.statements)
    expansion, there = statements / max(1, seen.code_lines), seen.blanks_there / max(1, seen.blanks)
    if statements >= MINIFIED_STATEMENTS and expansion >= MINIFIED_EXPANSION and there <= MINIFIED_BLANKS:
        return "minified: layout"
    if ending not in SETTINGS and uniformity(seen.statements) >= UNIFORM:
        return "generated: layout"
    return None


def _by_content(path: str, text: str) -> str | None:
    """What the tokens, the layout and the comments of a file say."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    seen = lex(text, ending)
    if found := by_layout(seen, ending):
        return found
    for head, comment in seen.comments:
        for x in _comment_lines(comment):
            if GENERATED.search(x):
                return "generated: comment"
            m = THIRD_PARTY.search(x) if head else None
            if m and not _own(next(filter(None, m.groups()), ""), path):
                return "third party: comment"
    if ending not in MARKUP and ANNOTATION.search("".join(t if t[0] not in "\"'`" else '""' for x in seen.statements for t in x)):
        return "generated: annotation"
    return None


def reason(path: str, content: bytes | None) -> str | None:
    """Why nobody wrote the file by hand in this project, or None if somebody did, as far as can be seen.

    The content speaks first; where it says nothing, folders and names that tools and copies have by convention do.
    """
    found = _by_content(path, decode(content)) if content else None
    if found:
        return found
    if GENERATED_PATH.search(path):
        return "generated: path"
    if THIRD_PARTY_PATH.search(path):
        return "third party: path"
    if MINIFIED_PATH.search(path):
        return "minified: path"
    return None


def not_handwritten(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files of ``path, content`` that nobody wrote by hand in this project.

    ``reason`` begins with ``generated``, ``minified``, ``third party`` or ``data``. Defined cases: null and empty contents
    are judged by their path alone, and no cases for being empty; contents of any encoding are read; a null path gives
    no row; repeated rows give repeated rows; no rows give no rows; further columns are ignored.
    """
    rows = files.where(F.col("path").isNotNull()).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, why = [], []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                r = reason(p, c)
                if r:
                    paths.append(p)
                    why.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(why, pa.string())], ["path", "reason"])

    return spread(rows).mapInArrow(run, "path string, reason string")


def named_files(commit_parts: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """``path, reason, commit_rows, snippet_rows``: the same over every file that any of the tables names.

    Files that are gone are judged by their path. The counts are what statistics lose by leaving the file out.
    """
    def named(rows: DataFrame, count: str) -> DataFrame:
        return rows.where(F.col("file").isNotNull()).groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias(count))

    counts = named(commit_parts, "commit_rows").join(named(snippets, "snippet_rows"), "path", "full_outer")
    # contents are judged where they are read; only the paths that are there and the reasons meet the counts
    there = files.where(F.col("path").isNotNull()).select("path").distinct()
    gone = counts.join(there, "path", "left_anti").select("path", F.lit(None).cast("binary").alias("content"))
    why = not_handwritten(files).unionByName(not_handwritten(gone))
    return why.join(counts, "path", "left").select(
        "path", "reason", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("commit_rows", "snippet_rows")]
    )
