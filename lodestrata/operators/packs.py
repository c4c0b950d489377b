"""What is looked for in source files: patterns by language, and the extractors for Java and C#.

A pattern works on bytes; each of its named groups is a snippet of the type of that name.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate, islice

# Names of the types of snippets.
DECLARATIONS = "modularity__component__declarations"
IMPORTS = "modularity__component__imports"
ABSTRACT = "modularity__types__abstract"
TYPES = "modularity__types__total"
FILES = "complexity__files"

# Patterns by language.
REGEX_PACKS: dict[str, tuple[str, list[str]]] = {
    "scala": (
        "**/*.scala",
        [
            r"package (?P<modularity__component__declarations>[a-z0-9_.]*)",
            r"import (?P<modularity__component__imports>[a-z0-9_.]*)\.[A-Z]",
            r"((abstract.*class)|trait).*(?P<modularity__types__abstract>\w+)",
            r"(class|trait).*(?P<modularity__types__total>\w+)",
            r"object (?P<modularity__types__total>\w+)",
        ],
    ),
    "kotlin": (
        "**/*.kt",
        [
            r"package (?P<modularity__component__declarations>.*)",
            r"import (?P<modularity__component__imports>.*)\.\w+\n",
            r"((abstract.*class)|interface).*(?P<modularity__types__abstract>\w+)",
            r"(class|interface).*(?P<modularity__types__total>\w+)",
        ],
    ),
    "php": (
        "**/*.php",
        [
            r"namespace (?P<modularity__component__declarations>.*);",
            r"(use|import) (?P<modularity__component__imports>.*)\\.*;",
            r"(abstract class|interface|trait) (?P<modularity__types__abstract>\w+)",
            r"(class|interface|trait) (?P<modularity__types__total>\w+)",
        ],
    ),
}

# Beginnings of Java imports that are left out by default; each is a pattern, so its dots match anything.
JAVA_IGNORED = (
    "org.slf4j", "org.apache.commons", "org.apache.log4j", "java", "javax", "org.springframework", "org.hibernate",
    "org.apache.http", "com.fasterxml.jackson", "org.junit", "com.google", "org.jboss", "lombok",
)

#: One snippet: type, first byte, byte after the last, value.
Found = tuple[str, int, int, bytes]

_SKIP = re.compile(
    rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|@?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?", re.DOTALL
)


def blanked(source: bytes) -> bytes:
    """``source`` with comments and strings turned to blanks, so every offset stays."""
    return _SKIP.sub(lambda m: re.sub(rb"[^\n]", b" ", m.group()), source)


def by_patterns(source: bytes, patterns: list[re.Pattern], limit: int | None = None) -> Iterator[Found]:
    """Every named group of every match, or of the first ``limit`` matches of each pattern."""
    for p in patterns:
        for m in islice(p.finditer(source), limit):
            for name in p.groupindex:
                if m.group(name) is not None:
                    yield name, m.start(name), m.end(name), m.group(name)


def compiled(patterns: list[str]) -> list[re.Pattern]:
    """Patterns for bytes. Lookaround and back references are refused, as the matching engine of the original has none."""
    for p in patterns:
        if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", p):
            raise ValueError(f"lookaround and back references are not supported: {p}")
    return [re.compile(p.encode("utf-8")) for p in patterns]


_NAME = rb"[A-Za-z_$][\w$]*"
_J_PACKAGE = re.compile(rb"^(?:\xef\xbb\xbf)?[ \t]*package\s+((?:%s\s*\.\s*)+%s)\s*;" % (_NAME, _NAME), re.MULTILINE)
_J_IMPORT = re.compile(rb"^(?:\xef\xbb\xbf)?[ \t]*import\s+(static\s+)?((?:%s\s*\.\s*)*%s)\s*(\.\s*\*)?\s*;" % (_NAME, _NAME), re.MULTILINE)
_J_TYPE = re.compile(rb"((?:@%s(?:\.%s)*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s+|\b(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*)(?<![\w$.@])(class|interface|record)\s+(%s)" % (_NAME, _NAME, _NAME))
_J_ANNOTATION = re.compile(rb"@(%s)\b\s*(\([^()]*(?:\([^()]*\)[^()]*)*\))?" % _NAME)
_J_METHOD = re.compile(
    rb"((?:@%s(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s+)*)((?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*)(?:<[^;{}()]*>\s*)?(%s(?:\s*\.\s*%s)*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*)\s+(%s)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:throws\s+[^;{}]+)?(?=[{;])"
    % (_NAME, _NAME, _NAME, _NAME)
)
_J_FIELD = re.compile(
    rb"(?<=[{};])\s*((?:@%s(?:\s*\([^()]*\))?\s+|(?:public|protected|private|static|final|transient|volatile)\s+)*)(%s(?:\s*\.\s*%s)*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*)\s+(%s)\s*(?==[^=]|;|,)"
    % (_NAME, _NAME, _NAME, _NAME)
)
_KEYWORDS = frozenset(b"return throw new else case package import goto yield assert break continue instanceof do record class interface enum".split())

# Annotations by what they count as.
_CLASS_STATS = {
    "java__spring__controllers": ("Controller", "RestController"),
    "java__spring__services": ("Service",),
    "java__spring__repositories": ("Repository",),
    "java__spring__components": ("Component",),
    "java__spring__configurations": ("Configuration",),
    "java__spring__beans": ("Component", "Service", "Repository", "Controller", "RestController", "Configuration"),
    "java__jpa__entities": ("Entity",),
}
_CLASS_SNIPPETS = {
    "java__spring__controller": "java__spring__controllers",
    "java__spring__service": "java__spring__services",
    "java__spring__repository": "java__spring__repositories",
    "java__spring__component": "java__spring__components",
    "java__spring__configuration": "java__spring__configurations",
    "java__spring__bean": "java__spring__beans",
    "java__jpa__entity": "java__jpa__entities",
}
_MAPPINGS = {"GetMapping": "get", "PutMapping": "put", "PostMapping": "post", "DeleteMapping": "delete", "PatchMapping": "patch"}


def _depths(code: bytes) -> tuple[list[int], list[int]]:
    """Where each brace is, and how many are open after it."""
    braces = [(m.start(), 1 if m.group() == b"{" else -1) for m in re.finditer(rb"[{}]", code)]
    return [at for at, _ in braces], list(accumulate(x for _, x in braces))


def java(source: bytes, ignored: tuple[str, ...] = JAVA_IGNORED) -> tuple[list[Found], list[tuple[str, int]]]:
    """Snippets and counts of a Java file.

    The value of an import is its package: the name without its last part, or all of it before ``.*``; of a static import the
    class. Class annotations count classes and interfaces by their role, method annotations request mappings.
    """
    code = blanked(source)
    skip = re.compile(f"^(?:{'|'.join(ignored)})".encode()) if ignored else None
    out: list[Found] = []
    stats: dict[str, int] = {}

    def add(kind: str, m: re.Match, group: int) -> None:
        out.append((kind, m.start(group), m.end(group), source[m.start(group) : m.end(group)]))

    for m in _J_PACKAGE.finditer(code):
        add(DECLARATIONS, m, 1)
    for m in _J_IMPORT.finditer(code):
        name = m.group(2)
        end = m.end(2) if m.group(3) else m.start(2) + name.rfind(b".")
        if not (skip and skip.match(name)) and b"." in name:
            out.append(("java__import_declaration", m.start(2), m.end(2), name))
        value = code[m.start(2) : end]
        # a wildcard keeps a dotted name whole; another import needs one before its last part
        if (b"." in name if m.group(3) else b"." in value) and not (skip and skip.match(value)):
            out.append((IMPORTS, m.start(2), end, value))
    for m in _J_TYPE.finditer(code):
        kind, modifiers = m.group(2), m.group(1)
        plain = _J_ANNOTATION.sub(b" ", modifiers)
        add(TYPES, m, 3)
        if kind == b"interface" or kind == b"class" and re.search(rb"\babstract\b", plain):
            add(ABSTRACT, m, 3)
        add(f"java__{kind.decode()}__declaration", m, 3)
        add("java__type__declaration", m, 3)
        if kind == b"class":
            stats["java__class__declarations"] = stats.get("java__class__declarations", 0) + 1
        if kind != b"record":
            names = [a.group(1).decode() for a in _J_ANNOTATION.finditer(modifiers)]
            for stat, wanted in _CLASS_STATS.items():
                hits = sum(n in wanted for n in names)
                if hits:
                    stats[stat] = stats.get(stat, 0) + hits
            for snippet, stat in _CLASS_SNIPPETS.items():
                for _ in [n for n in names if n in _CLASS_STATS[stat]]:
                    add(snippet, m, 3)
    for m in _J_METHOD.finditer(code):
        if m.group(3).split()[0] in _KEYWORDS or m.group(4) in _KEYWORDS:
            continue
        add("java__method_declaration", m, 4)
        stats["java__method_declarations"] = stats.get("java__method_declarations", 0) + 1
        for a in _J_ANNOTATION.finditer(m.group(1)):
            name, args = a.group(1).decode(), (a.group(2) or b"").decode("utf-8", "replace")
            keys = []
            if name == "RequestMapping" or name in _MAPPINGS:
                keys.append("total")
            if name in _MAPPINGS:
                keys.append(_MAPPINGS[name])
            if name == "RequestMapping" and (v := re.search(r"\bmethod\s*=\s*([\w.]+)", args)):
                keys += [x for x in ("get", "put", "post", "delete", "patch") if x.upper() in v.group(1)]
            for x in keys:
                stat = f"java__spring__request_mappings__{x}"
                stats[stat] = stats.get(stat, 0) + 1
    braces, depths = _depths(code)
    for m in _J_FIELD.finditer(code):
        first = m.group(2).split()[0]
        before = bisect.bisect_left(braces, m.start(3))
        if first in _KEYWORDS or not before or depths[before - 1] != 1:
            continue
        add("java__field__declaration", m, 3)
        stats["java__field__declarations"] = stats.get("java__field__declarations", 0) + 1
    out.sort(key=lambda f: (f[1], f[0]))
    return out, sorted(stats.items())


_C_NAMESPACE = re.compile(rb"\bnamespace\s+(%s(?:\s*\.\s*%s)*)\s*(?=\{)" % (_NAME, _NAME))
_C_USING = re.compile(rb"^(?:\xef\xbb\xbf)?[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(%s)\s*=\s*)?(%s(?:\s*\.\s*%s)*)\s*;" % (_NAME, _NAME, _NAME), re.MULTILINE)
_C_TYPE = re.compile(rb"((?:\b(?:public|protected|private|internal|static|sealed|abstract|partial|readonly|ref|unsafe|new)\s+)*)(?<![\w$.@])(class|struct|interface|record(?:\s+(?:class|struct))?)\s+(%s)(?=\s*[<:({;]|\s+where\b)" % _NAME)


def csharp(source: bytes) -> tuple[list[Found], list[tuple[str, int]]]:
    """Snippets of a C# file: block namespaces, using directives (of an alias the name it stands for), and types."""
    code = blanked(source)
    out: list[Found] = []

    def add(kind: str, m: re.Match, group: int) -> None:
        out.append((kind, m.start(group), m.end(group), source[m.start(group) : m.end(group)]))

    for m in _C_NAMESPACE.finditer(code):
        add(DECLARATIONS, m, 1)
    for m in _C_USING.finditer(code):
        add(IMPORTS, m, 2)
    for m in _C_TYPE.finditer(code):
        add(TYPES, m, 3)
        if m.group(2) == b"interface" or m.group(2) == b"class" and b"abstract" in m.group(1).split():
            add(ABSTRACT, m, 3)
    out.sort(key=lambda f: (f[1], f[0]))
    return out, []
