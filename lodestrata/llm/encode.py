"""Encoding of texts with a public byte-level BPE tokenizer, by dynamic programming over prefixes.

A sequence of tokens is the BPE encoding of its bytes exactly if each token alone and each pair of neighbours are, and
each prefix of a text has exactly one last token. So for every prefix, in order, the tokens that end there are taken from
an Aho-Corasick automaton of the vocabulary, and the one kept that is compatible with the last token of the prefix before
it. Following the kept tokens back from the end gives the ids. This is linear in the text, where merging by rank is not.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import spread

#: Where the vocabularies are; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that the caches of one worker hold before they are emptied; a bound on memory, without influence on results.
CACHE = 300_000


def read_ranks(path: str) -> bytes:
    return Path(path).read_bytes()


class PrefixEncoder:
    """Encodes pieces of text into token ids. ``ranks``: the content of a ``.tiktoken`` file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.token = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.ends = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first. Only for a token or two."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def stands_alone(self, i: int) -> bool:
        known = self.alone.get(i)
        if known is None:
            known = self.alone[i] = self.merged(self.token[i]) == [i]
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``a`` followed by ``b`` is how their bytes are encoded."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece that the pattern has cut out."""
        done = self.pieces.get(text)
        if done is not None:
            return done
        data = text.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None and self.stands_alone(whole):
            ids: tuple[int, ...] = (whole,)
        else:
            n = len(data)
            last, size = [-1] * (n + 1), [0] * (n + 1)
            for end, (length, token) in self.ends.iter(data.decode("latin-1")):
                end += 1
                if last[end] >= 0:
                    continue
                start = end - length
                before = last[start]
                if (before >= 0 and self.compatible(before, token)) if start else self.stands_alone(token):
                    last[end], size[end] = token, length
            back, at = [], n
            while at:
                back.append(last[at])
                at -= size[at]
            ids = tuple(reversed(back))
        if len(text) <= 64:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and ``''`` give none."""
        if not text:
            return []
        piece = self.piece
        return [i for part in self.split(text) for i in piece(part)]


def encoder_for(df: DataFrame, path: str):
    """A function for the workers that gives their encoder, made once per worker from the broadcast vocabulary.

    The broadcast is the vocabulary file, below 1 MB whatever the corpus.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def get() -> PrefixEncoder:
        kept = globals().setdefault("_ENCODERS", {})
        if path not in kept:
            kept[path] = PrefixEncoder(shared.value)
        return kept[path]

    return get


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each text exactly as it is, without special tokens.

    Spellings of special tokens are ordinary text. Defined cases: empty and null texts give an empty list, never null;
    a null id is kept; repeated rows give repeated rows; texts of any length are encoded whole; no rows give no rows;
    further columns are ignored.
    """
    docs = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    get = encoder_for(docs, vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = get().encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return spread(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, text_column: str = "text") -> DataFrame:
    """``documents`` without its text and with ``n_tokens``, the number of ids of the text (0 for null and ``''``)."""
    get = encoder_for(documents, vocabulary)
    rest = [f for f in documents.schema.fields if f.name != text_column]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "n_tokens long"])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = get()
        split, piece = e.split, e.piece
        for batch in batches:
            n = [sum(len(piece(p)) for p in split(t)) if t else 0 for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64())], [*names, "n_tokens"])

    return spread(documents).mapInArrow(run, schema)
