"""Texts decoded with the wrong character encoding: found, and restored where that is possible.

The words of a line with anything but ASCII are rewritten by each chain of mistakes that could have made them: the chains
are searched by cost, steps of different character sets one upon another included, until no step changes a word any more.
Every version of every word is compressed with the Zstandard dictionaries of the line's language and of English. The
description of a line is its chain, its compressed words, and what their characters beyond ASCII cost by their frequency
in the language (a compressor of bytes prices a new character like a common one). The shortest description wins, and the
line stays as it is unless a chain saves more than it costs; what is won is examined again until nothing saves.

What a word can become and its compressed size are kept by word, so the work grows with the different words, not with the
text. Dictionaries and frequencies come from all texts of every language; every text is examined, whole.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import spread

#: Texts per language of a sample, at most, its most languages, and the characters of its longest text; see :func:`sampled`.
SAMPLE_TEXTS, SAMPLE_LANGUAGES, SAMPLE_LENGTH = 3000, 32, 20_000
#: Characters of a language that a task trains on, about; and the dictionaries of parts of a language that are merged at once.
AT_ONCE, MERGED = 32_000_000, 32
#: Bytes of the pieces that the contents of dictionaries are cut to where they are merged: about a line.
PIECE = 64
#: Bytes of a dictionary, and the level of compression.
DICTIONARY_BYTES, LEVEL = 96_000, 12
#: Bytes that a chain costs: the first mistake, and each further one. A line is changed when it saves more.
CHAIN_COST, STEP_COST = 2.0, 1.0
#: Steps of a chain that are searched at once.
DEPTH = 4
#: Bytes that must be saved beyond the cost of the chain.
LEAST_SAVED = 0.25
#: Share of a language's texts in which a character must be, for a text with it to be trained on.
RARE = 0.006
#: Share of a language's texts from which on a character is so common that it is no sign of a mistake.
COMMON = 0.1
#: Texts that must hold it for that, as a few texts may all be garbled.
LEAST_TEXTS = 20
#: Characters beyond ASCII that a language has as single bytes in what is compressed, at most.
PAGE = 120
#: What counts the texts themselves among the characters.
TEXTS = "texts"
#: Bytes that the assumption of a lost character costs.
LOST_COST = 5.0

# Names of character sets. UTF-8 read as one of these, and one set read as another.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r")
SET_READ_AS = (
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1251"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("cp1250", "cp1252"),
    ("iso8859_2", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
)
#: Sets of more than one byte a character, read as one with a byte a character.
WIDE_READ_AS = (("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("gbk", "cp1252"), ("big5", "cp1252"), ("euc_kr", "cp1252"))
UNKNOWN = "�"
#: The step that takes back characters written as entities or escapes.
WRITTEN = "written as codes"
#: Words, lines and versions that a task remembers.
REMEMBERED = 200_000
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
#: The last three numbers of the tables of a trained dictionary.
_TABLES_END = b"".join(x.to_bytes(4, "little") for x in (1, 4, 8))
#: Letters of two scripts side by side.
_MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});")
_ESCAPE = re.compile(r"\\u00([0-9a-fA-F]{2})|\\x([0-9a-fA-F]{2})")
#: A word of a few odd characters between quotation marks: an example, not a mistake.
_EXAMPLE = re.compile(r"[(\[]?[“„«\"'`‘][^\x00-\x7f]{1,6}[”“»\"'`’][.,;:!?)\]]*")
# The ranges of the bytes of UTF-8 sequences.
UTF8_SEQUENCES = (
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
)


def _bytes_of(charset: str) -> dict[str, int]:
    """The byte of each character beyond ASCII; bytes that the set leaves open stand for the control of that number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    # a control character of the upper half is a byte that was passed through
    return {chr(b): b for b in range(128, 160)} | out if charset == "cp1252" else out


def _sequences(table: dict[str, int]) -> str:
    """A pattern for UTF-8 sequences whose bytes are written as the characters of ``table``."""

    def one(low: int, high: int) -> str:
        inside = "".join(re.escape(c) for c, b in table.items() if low <= b <= high)
        return f"[{inside}]" if inside else "(?!)"

    return "|".join("".join(one(*r) for r in ranges) for ranges in UTF8_SEQUENCES)


class Mistakes:
    """The mistakes of decoding, each with a function that takes it back, and the chains of them."""

    def __init__(self):
        self.bytes = {c: _bytes_of(c) for c in {*UTF8_READ_AS, *(b for _, b in SET_READ_AS)}}
        self.sequences = {c: re.compile(_sequences(self.bytes[c])) for c in UTF8_READ_AS}
        self.any_sequence = re.compile("|".join(_sequences(self.bytes[c]) for c in ("cp1252", "mac_roman", "cp437", "cp850")))
        self.swap = {}
        for right, wrong in SET_READ_AS:
            back = {b: bytes([b]).decode(right, "ignore") for b in range(128, 256)}
            self.swap[right, wrong] = {ord(c): back[b] for c, b in self.bytes[wrong].items() if back[b] and back[b] != c}
        self.charset = {f"utf-8 as {c}": c for c in UTF8_READ_AS}
        self.swapped = {f"{a} as {b}": (a, b) for a, b in SET_READ_AS}
        self.costs: dict[tuple[str, ...], float] = {}
        self.wide = {f"{a} as {b}": (a, b) for a, b in WIDE_READ_AS}

    def utf8(self, text: str, charset: str) -> str:
        """``text`` with each sequence that is UTF-8 read as ``charset`` read as UTF-8; the rest as it is."""
        table = self.bytes[charset]
        return self.sequences[charset].sub(lambda m: bytes(table[c] for c in m.group()).decode("utf-8"), text)

    def wider(self, text: str, right: str, wrong: str) -> str:
        """``text`` with its bytes in ``wrong`` read as ``right``, if they can be."""
        table = self.bytes[wrong]
        try:
            return bytes([ord(c) if c < "\x80" else table[c] for c in text]).decode(right)
        except (KeyError, UnicodeDecodeError):
            return text

    def back(self, text: str, step: str) -> str:
        """``text`` with one mistake taken back."""
        if step in self.wide:
            return self.wider(text, *self.wide[step])
        if step in self.charset:
            return self.utf8(text, self.charset[step])
        if step in self.swapped:
            return text.translate(self.swap[self.swapped[step]])
        return decoded_codes(text)

    def cost(self, chain: tuple[str, ...]) -> float:
        """Bytes that a chain costs: each step, each kind of step but the commonest, and wide sets twice, as they fit most bytes.

        Codes are seen, so they cost nothing.
        """
        known = self.costs.get(chain)
        if known is None:
            steps = [x for x in chain if x != WRITTEN]
            more = len(steps) - 1 + len(set(steps) - {f"utf-8 as {UTF8_READ_AS[0]}"}) + sum(x in self.wide for x in steps)
            known = self.costs[chain] = CHAIN_COST + STEP_COST * more if steps else 0.0
        return known

    def mixed(self, chain: tuple[str, ...]) -> bool:
        """Whether a chain is both of one set read as another and of UTF-8."""
        if len(chain) < 2:
            return False
        swaps = sum(x in self.swapped or x in self.wide for x in chain)
        return 0 < swaps < len(chain) - (chain[0] == WRITTEN)

    def chains(self, text: str) -> dict[tuple[str, ...], str]:
        """The chains that change ``text``, cheapest first, and what each makes of it.

        A chain has DEPTH steps at most, and one set read as another once, as what is won is examined again. Of the longer
        chains with one result the cheapest is kept.
        """
        found: dict[tuple[str, ...], str] = {}
        seen, queue = {text}, [(0.0, 0, (), text)]
        if (written := decoded_codes(text)) != text:
            queue.append((0.0, 1, (WRITTEN,), written))
            seen.add(written)
        number = 2
        while queue:
            _, _, chain, now = heapq.heappop(queue)
            if chain and chain != (WRITTEN,):
                found[chain] = now
            odd = {ord(c) for c in _BEYOND_ASCII.findall(now)}
            if not odd or len(chain) - (WRITTEN in chain) >= DEPTH:
                continue
            steps = [x for x, c in self.charset.items() if self.sequences[c].search(now)]
            if not any(x in self.swapped or x in self.wide for x in chain):
                steps += self.wide
                steps += [x for x, pair in self.swapped.items() if not self.swap[pair].keys().isdisjoint(odd)]
            for step in steps:
                then = self.back(now, step)
                if then != now and (then not in seen or not chain):
                    seen.add(then)
                    number += 1
                    heapq.heappush(queue, (self.cost((*chain, step)), number, (*chain, step), then))
        return found


def _odd(word: str) -> bool:
    """Whether a mistake can be in a word: it has more than ASCII, or codes of such characters, and is no example."""
    return (not word.isascii() and not _EXAMPLE.fullmatch(word)) or _coded(word)


def _coded(word: str) -> bool:
    return ("&" in word or "\\" in word) and decoded_codes(word) != word


def decoded_codes(text: str) -> str:
    """``text`` with the entities and escapes of characters beyond ASCII as characters."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), _ENTITY.sub(_entity, text)) if "&" in text or "\\" in text else text


def _entity(m: re.Match) -> str:
    c = html.unescape(m.group())
    return c if len(c) == 1 and ord(c) > 127 else m.group()


class Page:
    """The characters of a language as bytes: ASCII, the most frequent others, and one byte for any of the rest.

    A compressor of UTF-8 takes two right characters for longer than a wrong one, whatever their frequencies. In the page of
    the language each is one byte, and only the prices tell a rare one from a common one.
    """

    def __init__(self, counts: dict[str, int]):
        most = sorted(counts, key=lambda c: (-counts[c], c))[:PAGE]
        self.table = codecs.charmap_build("".join(map(chr, range(128))) + "".join(most) + "\ufffe" * (128 - len(most)))

    def encode(self, text: str) -> bytes:
        return codecs.charmap_encode(text, "lodestrata.other", self.table)[0]


def _other(e: UnicodeEncodeError) -> tuple[bytes, int]:
    return b"\xff" * (e.end - e.start), e.end


codecs.register_error("lodestrata.other", _other)


def _kind(c: str) -> float:
    """Bytes more that a character nobody uses costs, if there are more of its kind than of those with two bytes in UTF-8."""
    return 0.0 if c < "\u0800" else 0.63 if c < "\U00010000" else 1.14


class Examiner:
    """Finds and restores garbled text by description length.

    ``models``: dictionary and character counts by language; the dictionary is empty where a language has none.
    """

    def __init__(self, models: dict[str, tuple[bytes, dict[str, int]]]):
        import zstandard

        self.mistakes = Mistakes()
        self.press, self.price, self.unseen, self.page = {}, {}, {}, {}
        for lang, (data, counts) in models.items():
            total = sum(counts.values()) + 1
            self.price[lang] = {c: -math.log2((n + 0.1) / (total + 100)) / 8 for c, n in counts.items()}
            self.page[lang] = Page(counts)
            self.unseen[lang] = -math.log2(0.1 / (total + 100)) / 8
            if not data:
                continue
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.press[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        #: By language: words in its page, and what chains make of words in it.
        self.pages: dict[str, dict[str, tuple[bytes, float]]] = {lang: {} for lang in models}
        self.made: dict[str, dict[str, list[tuple[tuple[str, ...], bytes, float]]]] = {lang: {} for lang in models}
        self.lines: dict[tuple[str, str | None], tuple[float, str, str, bool]] = {}
        self.found: dict[str, dict[tuple[str, ...], str]] = {}
        self.split: dict[str, tuple[frozenset[tuple[str, ...]], frozenset[tuple[str, ...]]]] = {}

    def languages(self, lang: str | None) -> Sequence[str]:
        """Languages a text is held against: its own and English, or all if its own is not known.

        A language without a dictionary has the prices of its own characters, and is compressed with every dictionary.
        """
        if lang in self.press:
            return (lang, "en") if "en" in self.press and lang != "en" else (lang,)
        return (lang, *self.press) if lang in self.price else tuple(self.press)

    def chains(self, word: str) -> dict[tuple[str, ...], str]:
        """What each chain makes of a word; see :meth:`Mistakes.chains`."""
        known = self.found.get(word)
        if known is None:
            if len(self.found) > REMEMBERED:
                self.found.clear()
            known = self.found[word] = self.mistakes.chains(word)
        return known

    def kinds(self, word: str) -> tuple[frozenset[tuple[str, ...]], frozenset[tuple[str, ...]]]:
        """The chains of a word, those that are mixed apart."""
        known = self.split.get(word)
        if known is None:
            chains = self.mistakes.chains(word)
            mixed = frozenset(c for c in chains if self.mistakes.mixed(c))
            if len(self.split) > REMEMBERED:
                self.split.clear()
            known = self.split[word] = frozenset(chains) - mixed, mixed
        return known

    def version(self, text: str, chain: tuple[str, ...]) -> str:
        """``text`` with the mistakes of a chain taken back in each word, as far as they are there."""
        if " " in text:
            return " ".join([self.version(w, chain) for w in text.split(" ")])
        if not _odd(text):
            return text
        known = self.chains(text)
        out = known.get(chain)
        if out is None:
            out = text
            for step in chain:
                out = self.mistakes.back(out, step)
            known[chain] = out
        return out

    def written(self, word: str, lang: str) -> tuple[bytes, float]:
        """A word in the page of a language, and the price of its characters beyond ASCII."""
        known = self.pages[lang].get(word)
        if known is None:
            price, unseen = self.price[lang], self.unseen[lang]
            known = self.page[lang].encode(word), sum([price.get(c) or unseen + _kind(c) for c in _BEYOND_ASCII.findall(word)])
            if len(self.pages[lang]) > REMEMBERED:
                self.pages[lang].clear()
            self.pages[lang][word] = known
        return known

    def versions(self, word: str, lang: str) -> list[tuple[tuple[str, ...], bytes, float]]:
        """What each chain makes of a word in the page of a language, and the difference of the prices."""
        known = self.made[lang].get(word)
        if known is None:
            price = self.written(word, lang)[1]
            coded = self.written(decoded_codes(word), lang)[1] if _coded(word) else price
            known = [(c, data, p - (coded if c[0] == WRITTEN else price)) for c, v in self.chains(word).items() for data, p in [self.written(v, lang)]]
            if len(self.made[lang]) > REMEMBERED:
                self.made[lang].clear()
            self.made[lang][word] = known
        return known

    def length(self, text: str, langs: Sequence[str]) -> float:
        """Bytes that a text takes in the language in which it takes the least: compressed, and its characters' prices."""
        words = [self.written(w, x) for x in langs for w in [text]]
        sizes = {x: len(self.press[x].compress(w[0])) for x, w in zip(langs, words, strict=True) if x in self.press}
        least = min(sizes.values(), default=len(text))
        return min([sizes.get(x, least) + w[1] for x, w in zip(langs, words, strict=True)] or [least + 2.0 * len(_BEYOND_ASCII.findall(text))])

    def line(self, text: str, lang: str | None) -> tuple[float, str, str, bool]:
        """Bytes saved, chain, restored line, and whether it is restored; 0, '' and the line itself if it is best as it is."""
        known = self.lines.get((text, lang))
        if known is not None:
            return known
        langs = self.languages(lang)
        names: list[str] = []
        saved, now = 0.0, text
        while True:
            # what is won is examined again: another mistake may be in other words, or below the first
            chain, gain = self.best(now, langs)
            if not chain:
                break
            saved += gain
            names += chain
            now = self.version(now, chain)
        whole = bool(names) and UNKNOWN not in now and not self.left(text, now, langs)
        if not names and UNKNOWN in text and (gain := self.lost(text, langs)) > LEAST_SAVED:
            saved, names = gain, ["lost"]
        if len(self.lines) > REMEMBERED:
            self.lines.clear()
        out = self.lines[text, lang] = (saved, ", ".join(names), now, whole)
        return out

    def best(self, text: str, langs: Sequence[str]) -> tuple[tuple[str, ...], float]:
        """The chain with the shortest description of a line, and the bytes it saves; without a chain if none saves enough.

        A chain of one set read as another and of UTF-8 is about all words of the line or none: a word that only one of the
        steps changes holds characters that text in UTF-8 cannot leave.
        """
        words = text.split(" ")
        coded = "&" in text or "\\" in text
        odd = [i for i, w in enumerate(words) if (coded or not w.isascii()) and _odd(w)]
        known = [self.kinds(w) for w in {words[i] for i in odd}]
        chains = set().union(*[k for k, _ in known])
        if all(m for _, m in known):
            chains |= frozenset.intersection(*[m for _, m in known]) if known else set()
        if not chains:
            return (), 0.0
        with_codes = coded and any(c[0] == WRITTEN for c in chains)
        longer = {c for c in chains if len(c) > 1}
        if not langs:
            return self.best_plain(text, chains)
        plain = [w.encode("ascii", "ignore") for w in words]
        # bytes of the line as it is and with its codes as characters, and of each version, in the language with the least
        now = written = float("inf")
        least = dict.fromkeys(chains, now)
        for lang in langs:
            size = self.sizes_in(lang, langs)
            data, price = plain.copy(), 0.0
            for i in odd:
                data[i], p = self.written(words[i], lang)
                price += p
            now = min(now, size(b" ".join(data)) + price)
            if with_codes:
                # a character takes fewer bytes than its code, which is nothing that a mistake explains
                decoded, coded = plain.copy(), 0.0
                for i in odd:
                    decoded[i], p = self.written(decoded_codes(words[i]), lang)
                    coded += p
                written = min(written, size(b" ".join(decoded)) + coded)
            changes: dict[tuple[str, ...], list[tuple[int, bytes, float]]] = {c: [] for c in chains}
            for i in odd:
                for c, x, p in self.versions(words[i], lang):
                    if c in changes:
                        changes[c].append((i, x, p))
            for chain, changed in changes.items():
                if chain in longer:
                    # a word that only some of the steps change
                    there = {i for i, _, _ in changed}
                    for i in odd:
                        if i not in there and (other := self.version(words[i], chain)) != words[i]:
                            x, p = self.written(other, lang)
                            changed.append((i, x, p - self.written(decoded_codes(words[i]) if chain[0] == WRITTEN else words[i], lang)[1]))
                parts = data.copy()
                total = coded if chain[0] == WRITTEN else price
                for i, x, p in changed:
                    parts[i] = x
                    total += p
                # versions that differ in rare characters only are the same bytes
                least[chain] = min(least[chain], size(b" ".join(parts)) + total)
        best, most = (), LEAST_SAVED
        # of chains that save the same the cheapest, then the first in the alphabet
        for chain, length in sorted(least.items(), key=lambda e: (self.mistakes.cost(e[0]), e[0])):
            gain = (written if chain[0] == WRITTEN else now) - length - self.mistakes.cost(chain)
            if gain > most:
                best, most = chain, gain
        return best, most if best else 0.0

    def sizes_in(self, lang: str, langs: Sequence[str]) -> Callable[[bytes], int]:
        """The compressed size by the dictionary of a language, or the least of all if it has none; each text once."""
        by = [self.press[lang]] if lang in self.press else [self.press[x] for x in langs if x in self.press]
        seen: dict[bytes, int] = {}

        def size(data: bytes) -> int:
            known = seen.get(data)
            if known is None:
                known = seen[data] = min([len(p.compress(data)) for p in by], default=len(data))
            return known

        return size

    def best_plain(self, text: str, chains: Iterable[tuple[str, ...]]) -> tuple[tuple[str, ...], float]:
        """The same without any model: lengths are those of the plain text."""
        now = self.length(text, ())
        gains = {c: now - self.length(self.version(text, c), ()) - self.mistakes.cost(c) for c in chains if c[0] != WRITTEN}
        best = max(gains, key=gains.get, default=())
        return (best, gains[best]) if best and gains[best] > LEAST_SAVED else ((), 0.0)

    def left(self, before: str, after: str, langs: Sequence[str]) -> bool:
        """Whether a restored line holds signs of wrong decoding still: sequences of a mistake, or characters nobody uses."""
        changed = " ".join([y for x, y in zip(before.split(" "), after.split(" "), strict=True) if x != y])
        known = set().union(*(self.price[x] for x in langs))
        return not looks_right(changed, self.mistakes, known) or bool(langs) and not known.issuperset(_BEYOND_ASCII.findall(changed))

    def lost(self, text: str, langs: Sequence[str]) -> float:
        """Bytes saved if the unknown characters of a line were what the language has most often in such places."""
        if re.search(rf"\w{UNKNOWN}|{UNKNOWN}\w", text):
            return 10.0
        now = self.length(text, langs)
        price = min((self.unseen[x] for x in self.unseen), default=0.0)
        gain = max(now - self.length(text.replace(UNKNOWN, c), langs) for c in "–—’…“”")
        return gain - text.count(UNKNOWN) * price - LOST_COST

    def text(self, text: str | None, lang: str | None) -> tuple[str, str, bool] | None:
        """Chains, restored text and whether all of it could be restored; None for a text that was decoded rightly."""
        if not text or not (_BEYOND_ASCII.search(text) or "&" in text or "\\" in text):
            return None
        lines, names, whole = text.split("\n"), [], True
        for i, line in enumerate(lines):
            if line.isascii() and "&" not in line and "\\" not in line:
                continue
            _, name, restored, complete = self.line(line, lang)
            if name:
                names.append(name)
                whole &= complete
                lines[i] = restored
        if not names:
            return None
        return "; ".join(dict.fromkeys(names)), "\n".join(lines), whole


def looks_right(text: str, mistakes: Mistakes, common: Container[str] = ()) -> bool:
    """Whether a text is without a sign of wrong decoding: sequences of ``common`` characters alone are none."""
    if UNKNOWN in text or "&#" in text:
        return False
    if text.isascii():
        return True
    if _MIXED.search(text):
        return False
    return all(c in common for m in mistakes.any_sequence.finditer(text) for c in m.group())


def statistics(documents: DataFrame) -> dict[str, Known]:
    """What is :class:`Known` of the characters of every language, over all its texts.

    The texts that hold each character are counted first, to know the common ones; then, of the texts without a sign of wrong
    decoding, the texts and the occurrences. Each map task sums up its rows, so a row per task, language and character is
    shuffled, and one per language and character goes to the driver.
    """
    rows = documents.where(F.col("lang").isNotNull() & (F.col("text") != "")).select("lang", "text")
    each = F.array_distinct(F.split(F.regexp_replace("text", r"[\x00-\x7f]+", ""), ""))
    held = rows.select("lang", F.explode(F.array_append(each, F.lit(TEXTS))).alias("c")).where(F.col("c") != "")
    texts_with: dict[str, dict[str, int]] = {}
    for r in held.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n")).collect():
        texts_with.setdefault(r["lang"], {})[r["c"]] = r["n"]
    common = {lang: common_characters(counts) for lang, counts in texts_with.items()}
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mistakes, found = Mistakes(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if looks_right(text, mistakes, shared.value[lang]):
                    tally(found.setdefault(lang, {}), text)
        flat = [(lang, c, *n) for lang, counts in found.items() for c, n in counts.items()]
        columns = zip(*flat, strict=True) if flat else ((), (), (), ())
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["lang", "c", "texts", "n"])

    counted = spread(rows).mapInArrow(run, "lang string, c string, texts long, n long")
    right: dict[str, dict[str, tuple[int, int]]] = {}
    for r in counted.groupBy("lang", "c").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n")).collect():
        right.setdefault(r["lang"], {})[r["c"]] = (r["texts"], r["n"])
    return {lang: known_of(common[lang], right.get(lang, {})) for lang in common}


@dataclass(frozen=True)
class Known:
    """Of a language: characters in many texts, characters in few right texts, and the occurrences of all others."""

    common: frozenset[str]
    rare: frozenset[str]
    counts: dict[str, int]


def common_characters(texts_with: dict[str, int]) -> frozenset[str]:
    return frozenset(c for c, n in texts_with.items() if c != TEXTS and n >= max(LEAST_TEXTS, COMMON * texts_with[TEXTS]))


def tally(counts: dict[str, tuple[int, int]], text: str) -> None:
    """Adds the characters of a text to the texts that hold each, and to its occurrences; TEXTS stands for the text itself."""
    for c, n in (Counter(_BEYOND_ASCII.findall(text)) | {TEXTS: 1}).items():
        texts, sum_ = counts.get(c, (0, 0))
        counts[c] = texts + 1, sum_ + n


def known_of(common: frozenset[str], right: dict[str, tuple[int, int]]) -> Known:
    """One set read as another leaves letters that few texts of the language have: they do not count."""
    texts = right.get(TEXTS, (0, 0))[0]
    rare = frozenset(c for c, (n, _) in right.items() if n < RARE * texts)
    return Known(common, rare, {c: n for c, (_, n) in right.items() if c != TEXTS and c not in rare})


def known_of_texts(texts: Sequence[str]) -> Known:
    """The :func:`statistics` of texts of one language that are at hand."""
    held, right, mistakes = {TEXTS: (0, 0)}, {}, Mistakes()
    for t in texts:
        tally(held, t)
    common = common_characters({c: n for c, (n, _) in held.items()})
    for t in texts:
        if looks_right(t, mistakes, common):
            tally(right, t)
    return known_of(common, right)


def train(samples: dict[str, list[str]]) -> dict[str, tuple[bytes, dict[str, int]]]:
    """The models of an :class:`Examiner` from texts by language that are at hand."""
    known = {lang: known_of_texts(texts) for lang, texts in samples.items()}
    return {lang: (data, known[lang].counts) for lang, texts in samples.items() if (data := dictionary(texts, known[lang]))}


def dictionary(texts: Iterable[str], known: Known) -> bytes:
    """A dictionary of the texts of one language without a sign of wrong decoding and without rare characters."""
    mistakes = Mistakes()
    clean = (t for t in texts if looks_right(t, mistakes, known.common) and known.rare.isdisjoint(t))
    page = Page(known.counts)
    # the trainer looks at eight bytes at a time
    lines = [page.encode(x) for t in clean for x in t.split("\n") if len(x) > 7]
    return trained(lines, min(DICTIONARY_BYTES, max(1024, sum(map(len, lines)) // 8)))


def trained(lines: list[bytes], size: int) -> bytes:
    """A dictionary of all the lines: none is kept back to test it."""
    import zstandard

    try:
        data = zstandard.train_dictionary(size, lines, split_point=1.0, d=8, steps=4).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        data = b"".join(lines)[-DICTIONARY_BYTES:]
    return data if len(data) >= 8 else b""


def merged(parts: Sequence[bytes]) -> bytes:
    """One dictionary of those of the parts of a language: what many of them hold is kept first."""
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return parts[0] if parts else b""
    # a trained dictionary has its tables first, which end with the numbers 1, 4 and 8
    ends = [p.find(_TABLES_END, 0, 512) for p in parts]
    texts = [p[at + len(_TABLES_END) :] if at >= 0 else p for p, at in zip(parts, ends, strict=True)]
    return trained([x for t in texts for i in range(0, len(t), PIECE) if len(x := t[i : i + PIECE]) > 7], max(map(len, parts)))


def sampled(documents: DataFrame, per_language: int = SAMPLE_TEXTS) -> DataFrame:
    """``lang, text``: about ``per_language`` texts of each of the most frequent languages, the same ones for the same table.

    For a look at a large table; no model comes from it (see :func:`fitted`). Its texts have 40 to SAMPLE_LENGTH characters
    and are whole; they are chosen by a hash of id and text.
    """
    size = F.length("text")
    rows = documents.where(F.col("lang").isNotNull() & (size > 40) & (size <= SAMPLE_LENGTH))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGUAGES).collect()
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    take = F.lit(False)
    for r in counts:
        share = min(1.0, per_language / r["count"])
        take = take | ((F.col("lang") == r["lang"]) & (chance < int(1_000_000 * share) + 1))
    return rows.where(take).select("lang", "text")


def fitted(documents: DataFrame, at_once: int = AT_ONCE) -> dict[str, tuple[bytes, dict[str, int]]]:
    """The models of an :class:`Examiner`: a dictionary and the counts of characters of each language, from all its texts.

    A task trains on all texts of a language, or of one of its parts by hash where it has more than ``at_once`` characters;
    the dictionaries of the parts are merged, MERGED at once, until there is one. So neither the order of the rows nor their
    partitions matter. DICTIONARY_BYTES of each language go to the driver.
    """
    known = statistics(documents)
    shared = documents.sparkSession.sparkContext.broadcast(known)
    rows = documents.where(F.col("lang").isNotNull() & (F.col("text") != "")).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    parts = {r["lang"]: -(-r["n"] // at_once) for r in sizes if r["n"] > at_once}
    many = F.create_map(*[F.lit(x) for e in parts.items() for x in e]) if parts else None
    part = F.pmod(F.xxhash64("doc_id", "text"), F.coalesce(many[F.col("lang")], F.lit(1))) if parts else F.lit(0)

    def train_one(pdf: pd.DataFrame) -> pd.DataFrame:
        lang = pdf["lang"].iloc[0]
        data = dictionary(sorted(pdf["text"]), shared.value[lang])
        return pd.DataFrame({"lang": [lang], "part": [pdf["part"].iloc[0]], "data": [data]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        data = merged(list(pdf.sort_values("part")["data"]))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "part": [pdf["part"].iloc[0] // MERGED], "data": [data]})

    kinds = "lang string, part long, data binary"
    found = rows.select("lang", "text", part.cast("long").alias("part")).groupBy("lang", "part").applyInPandas(train_one, kinds)
    most = max(parts.values(), default=1)
    while most > 1:
        found = found.groupBy("lang", F.floor(F.col("part") / MERGED).alias("of")).applyInPandas(merge, kinds)
        most = -(-most // MERGED)
    out = {lang: (b"", k.counts) for lang, k in known.items() if k.counts}
    return out | {r["lang"]: (bytes(r["data"]), known[r["lang"]].counts) for r in found.collect() if r["data"]}


def garbled(documents: DataFrame, models: dict[str, tuple[bytes, dict[str, int]]] | None = None) -> DataFrame:
    """``doc_id, chain, restored``: the texts that were decoded wrongly, wholly or in part.

    ``chain`` names the mistakes, ``restored`` is the text without them, or null where characters are lost.

    Defined cases: null, empty and ASCII-only texts without codes of characters are no cases; odd characters quoted as an
    example are none; a null or unknown ``lang`` is held against every dictionary; without any text to train on,
    lengths are those of the plain bytes; repeated rows give repeated rows; no rows give no rows.
    """
    docs = documents.select("doc_id", "text", "lang")
    if models is None:
        models = fitted(docs)
    # DICTIONARY_BYTES, or an eighth of its texts, and a number per character of each language
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Examiner(shared.value).text
        for batch in batches:
            at, chains, texts = [], [], []
            for i, (t, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                found = look(t, lang)
                if found:
                    at.append(i)
                    chains.append(found[0])
                    texts.append(found[1] if found[2] else None)
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(chains, pa.string()), pa.array(texts, pa.string())], ["doc_id", "chain", "restored"]
            )

    return spread(docs).mapInArrow(run, f"doc_id {kind}, chain string, restored string")
