"""Texts as token ids of a public byte-level BPE tokenizer, and back.

A text is split by the vocabulary's pattern and each piece is encoded from left to right: for
every prefix of a piece exactly one token can end it, namely one that may follow the token that
ends the rest of the prefix (two tokens may stand side by side if merging their bytes gives these
two again).  A token goes out as soon as no longer continuation can change it: once the chains of
all prefix ends that a later token may start from share it.  So a piece of any length is encoded
in constant memory.  The vocabulary is read by the driver and sent to the executors, about 3 MB.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; every function takes another place.
VOCABULARIES = "/opt/tokenizers"
#: Pieces kept with their ids, and the longest that are kept (characters).
CACHE, CACHED_LENGTH = 200_000, 48
#: Tokens held before they are passed on in a batch.
OUT_TOKENS = 1 << 20

#: The pattern that splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """The merges in order and the ids of all tokens, of a byte-level vocabulary file."""
    model = json.loads(Path(folder, f"{name}.json").read_text(encoding="utf-8"))["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return merges, {raw(t): i for t, i in model["vocab"].items()}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token's end that can still change it.

    What lies to the right can prevent a merge only by a merge of higher rank whose left part is
    the end of the token (or an end of that end), and such a merge can itself be prevented in the
    same way by one of still higher rank.  The longest such chain, in bytes, bounds the reach.
    """
    right: dict[bytes, bytes] = {}
    reach_by_left: dict[bytes, int] = {}
    most = 1
    for u, v in merges:  # by falling priority, so all that may prevent this merge came before
        right.setdefault(u + v, v)
        end, further = v, 0
        while True:
            further = max(further, reach_by_left.get(end, 0))
            if end not in right:
                break
            end = right[end]
        reach = len(v) + further
        reach_by_left[u] = max(reach_by_left.get(u, 0), reach)
        most = max(most, reach)
    return most + max((len(u) + len(v) for u, v in merges), default=1)


class Encoder:
    """Encodes bytes as they come; the ids are those that merging the whole piece would give."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.ids, self.ranks = ids, {pair: i for i, pair in enumerate(merges)}
        self.longest = max(map(len, ids))
        self.lookahead = sufficient_lookahead(merges)
        self.pattern = regex.compile(PATTERN)
        ends: dict[bytes, set[int]] = {}
        for token in ids:
            ends.setdefault(token[-2:], set()).add(len(token))
            ends.setdefault(token[-1:], set()).update([1] * (len(token) == 1))
        self.lengths = {end: sorted(n, reverse=True) for end, n in ends.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, for two tokens at a time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether token b may follow token a."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            known = self.pairs[(a, b)] = self.merged(a + b) == [a, b]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that comes in chunks, each as soon as it is settled."""
        before: bytes | None = None  # the last token that went out
        held, last = b"", [0]  # bytes not yet out; for each of their prefixes, the length of its last token
        for chunk in chunks:
            for at in range(0, len(chunk), self.lookahead):
                held += chunk[at : at + self.lookahead]
                for end in range(len(last), len(held) + 1):
                    last.append(self._last(held, last, end, before))
                settled = self._settled(last)
                if settled:
                    out = self._chain(held, last, settled)
                    yield from (self.ids[t] for t in out)
                    before, held, last = out[-1], held[settled:], [0, *last[settled + 1 :]]
        yield from (self.ids[t] for t in self._chain(held, last, len(held)))

    def _last(self, held: bytes, last: list[int], end: int, before: bytes | None) -> int:
        tail = held[max(0, end - 2) : end]
        for n in self.lengths.get(tail, ()) if len(tail) == 2 else ():
            if n <= end and (token := held[end - n : end]) in self.ids and self._may_end(held, last, end - n, token, before):
                return n
        return 1  # a single byte always is a token

    def _may_end(self, held: bytes, last: list[int], start: int, token: bytes, before: bytes | None) -> bool:
        if start == 0:
            return before is None or self.fits(before, token)
        return self.fits(held[start - last[start] : start], token)

    def _settled(self, last: list[int]) -> int:
        """The furthest prefix end that every later token's chain goes through."""
        n = len(last) - 1
        fringe = set(range(max(0, n - self.longest + 1), n + 1))
        while len(fringe) > 1:
            top = max(fringe)
            fringe.remove(top)
            fringe.add(top - last[top] if top else 0)
        return fringe.pop()

    @staticmethod
    def _chain(held: bytes, last: list[int], end: int) -> list[bytes]:
        out = []
        while end:
            out.append(held[end - last[end] : end])
            end -= last[end]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; NULL and '' have none.  Special tokens' strings are ordinary text."""
        out: list[int] = []
        cache = self.cache
        for piece in self.pattern.findall(text) if text and len(text) < 1 << 20 else (m.group() for m in self.pattern.finditer(text or "")):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.stream([piece.encode("utf-8")]))
                if len(piece) <= CACHED_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out


class Decoder:
    """Turns ids into text as they come: a state machine over UTF-8, which holds at most one unfinished character."""

    def __init__(self, ids: dict[bytes, int]):
        self.tokens = {i: t for t, i in ids.items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.tokens[i]):
                yield piece
        if rest := machine.decode(b"", True):
            yield rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary) -> Encoder:
    """One encoder for each Python worker."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*vocabulary.value)
    return _ENCODERS[key]


def _mapped(documents: DataFrame, doc_id: str, text: str, vocabulary: str, folder: str, counts: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, folder))
    key = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)

        def batch_of(docs: list[int], rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64() if counts else pa.list_(pa.int32()))], names=["doc_id", "n" if counts else "ids"])

        for batch in batches:
            docs, rows, held = [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(value.as_py())
                docs.append(doc)
                rows.append(len(ids) if counts else ids)
                held += len(ids) * (not counts)
                if held >= OUT_TOKENS:
                    yield batch_of(docs, rows)
                    docs, rows, held = [], [], 0
            yield batch_of(docs, rows)

    return documents.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"doc_id long, {'n long' if counts else 'ids array<int>'}")


def encoded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, ids of every row; NULL and empty texts give the empty list."""
    return _mapped(documents, doc_id, text, vocabulary, folder, False)


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, n: the number of tokens of every row."""
    return _mapped(documents, doc_id, text, vocabulary, folder, True)


def decoded(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id, text of every row of ids; NULL and empty lists give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, folder)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [decoder.decode(value.as_py() or []) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long"), F.col(ids).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
