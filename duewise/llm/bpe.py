"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

``lexicon_words`` counts the pieces of every text and keeps the most frequent ones (the cut is found in the cluster; only the
words kept, a bounded number, reach the driver); ``Lexicon.build`` encodes them by
exact merging and compiles them into a minimal acyclic automaton, suffixes shared, whose paths number the words in order
(each arc knows how many words lie before it); that number leads to the word's ids. The bytes are broadcast (their size is
bounded by the number of words), written by each Python worker to a file of its own, memory-mapped and unlinked.
A piece outside the lexicon is merged exactly, so the ids never depend on which words are frequent.

The vocabulary is read on the driver from a path given as a parameter and sent along; executors need no such file.

Edge cases: null and empty texts give no ids and an empty decoded text; repeated rows are encoded each on their own; special
tokens in a text become their ids, as the library does by default; an empty table gives an empty result; ``encode`` carries
all other columns along and renames its own on a clash.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from duewise.llm.common import fresh, frugal, table, written

#: How this kind of vocabulary cuts a normalised text into pieces, and what it takes for white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")
WORD_END = "</w>"
STOPS = frozenset(".,;:!?")

LEXICON_WORDS = 150_000
MEMO = 60_000
#: Chunks of texts that a task counts before it sends its counts on.
COUNTED = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file; picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece by exact merging, lowest rank first and leftmost among equals."""
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += WORD_END
        if len(parts) > 500:
            return self.merge_long(parts)
        get, none = self.ranks.get, 1 << 60
        ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), none)
        return [self.ids[p] for p in parts if p in self.ids]

    def merge_long(self, parts: list[str]) -> list[int]:
        """The same with one pass for each rank: no token is made before a merge that needs it, so a pass may take all places."""
        while len(parts) > 1:
            best = min(self.ranks.get(pair, 1 << 60) for pair in zip(parts, parts[1:], strict=False))
            if best == 1 << 60:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and self.ranks.get((parts[k], parts[k + 1])) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ids[p] for p in parts if p in self.ids]


class Lexicon:
    """A minimal acyclic automaton over UTF-8 bytes, laid out flat: it is searched where it lies, in a memory map.

    Layout: six uint32 counts, then first arc of each state, arc targets, words before each arc, first id of each word, ids
    (uint16 pairs kept as uint32), whether each state ends a word, and the arcs' bytes.
    """

    HEAD = struct.Struct("<4I")

    def __init__(self, data):
        view = memoryview(data)
        states, arcs, words, ids = self.HEAD.unpack_from(view, 0)
        at = self.HEAD.size

        def section(n: int, kind: str = "I", width: int = 4):
            nonlocal at
            part = view[at : at + n * width]
            at += n * width
            return part.cast(kind) if kind != "B" else part

        self.first, self.target, self.before = section(states + 1), section(arcs), section(arcs)
        self.start, self.ids = section(words + 1), section(ids)
        self.final = section(states, "B", 1)
        self.labels, self.labels_at, self.data = section(arcs, "B", 1), at - arcs, data

    @classmethod
    def build(cls, entries: dict[str, list[int]]) -> bytes:
        """Bytes of the automaton of ``entries`` (piece to ids), by adding the words in byte order and merging equal states."""
        words = sorted((w.encode(), ids) for w, ids in entries.items() if w)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                state, parent = path.pop(), path[-1]
                key = (final[state], tuple(arcs[state].items()))
                known = register.setdefault(key, state)
                if known != state:
                    arcs[parent][last[len(path) - 1]] = known

        for word, _ in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            settle(same)
            for b in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][b] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        settle(0)
        order, place = [0], {0: 0}
        for s in order:
            for t in arcs[s].values():
                if t not in place:
                    place[t] = len(order)
                    order.append(t)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for t in arcs[s].values() if t not in count]
            if todo:
                stack.extend(todo)
            else:
                count[stack.pop()] = final[s] + sum(count[t] for t in arcs[s].values())
        first, target, before, labels = [0], [], [], []
        for s in order:
            n = int(final[s])
            for b, t in sorted(arcs[s].items()):
                labels.append(b)
                target.append(place[t])
                before.append(n)
                n += count[t]
            first.append(len(labels))
        starts = np.cumsum([0, *(len(ids) for _, ids in words)])
        flat = [i for _, ids in words for i in ids]
        u4 = lambda x: np.asarray(x, "<u4").tobytes()
        return b"".join([cls.HEAD.pack(len(order), len(labels), len(words), len(flat)), u4(first), u4(target), u4(before), u4(starts), u4(flat), bytes(final[s] for s in order), bytes(labels)])

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The same, memory-mapped from a file that is unlinked at once and so vanishes with the process."""
        handle, name = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(handle, "r+b") as f:
                f.write(data)
                f.flush()
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        finally:
            os.unlink(name)

    def find(self, piece: str) -> list[int] | None:
        """Ids of ``piece``, or None if it isn't in the lexicon."""
        state, number, base = 0, 0, self.labels_at
        for b in piece.encode():
            k = self.data.find(bytes((b,)), base + self.first[state], base + self.first[state + 1]) - base
            if k < 0:
                return None
            number += self.before[k]
            state = self.target[k]
        return self.ids[self.start[number] : self.start[number + 1]].tolist() if self.final[state] else None


def normal(text: str) -> str:
    """NFC, then each character lower-cased on its own (no rule for final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def chunks(text: str) -> list[str]:
    """The normalised text cut at white space; no piece spans a cut."""
    text = normal(text)
    return text.split() if not ODD_SPACES.search(text) else [x for x in SPACES.split(text) if x]


class Codec:
    """Encodes and decodes in one Python worker; what a piece gives is remembered: lexicon words for good, others up to MEMO."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, tuple[str, str]] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None

    def piece(self, piece: str) -> tuple[str, str]:
        """Ids and tokens of a piece, both joined by blanks."""
        if (got := self.memo.get(piece)) is None:
            if len(self.memo) >= MEMO + len(self.known):
                self.memo.clear()
                self.memo.update(self.known)
            found = self.lexicon.find(piece)
            ids = self.vocabulary.merge(piece) if found is None else found
            got = self.memo[piece] = " ".join(map(str, ids)), " ".join(map(self.vocabulary.tokens.__getitem__, ids))
            if found is not None:
                self.known[piece] = got
        return got

    def chunk(self, chunk: str) -> tuple[str, str]:
        """The same of a chunk; most that aren't one piece are a word seen before and a stop after it."""
        if chunk[-1] in STOPS and chunk[-2:-1].isalpha() and (word := self.memo.get(chunk[:-1])) and word[0]:
            found = [word, self.piece(chunk[-1])]
        else:
            found = [self.piece(p) for p in PIECES.findall(chunk)]
        return " ".join([x for x, _ in found if x]), " ".join([y for x, y in found if x])

    def text(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, decimal ids and decoded text (both joined by blanks) of a whole text."""
        text = text or ""
        get, chunk, found = self.memo.get, self.chunk, []
        parts = self.special.split(text) if self.special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                found.append((str(self.vocabulary.special[part]), part))
            else:
                found += [get(c) or chunk(c) for c in chunks(part)]
        ids = " ".join([x[0] for x in found if x[0]])
        return ids.count(" ") + 1 if ids else 0, ids, " ".join([x[1] for x in found if x[0]])


_codecs: dict[str, Codec] = {}


def codec_of(name: str, sent) -> Codec:
    """This worker's codec for a broadcast vocabulary and lexicon; the worker's next tasks find it with what it remembers."""
    if name not in _codecs:
        _codecs.clear()
        vocabulary, lexicon = sent.value
        _codecs[name] = Codec(vocabulary, Lexicon.mapped(lexicon))
    return _codecs[name]


def lexicon_words(texts: DataFrame, size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of all of ``texts`` (its one column): all that stand more than once and as often as some count, at most ``size``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            n: Counter[str] = Counter()
            while seen:
                c, k = seen.popitem()
                for p in PIECES.findall(c):
                    n[p] += k
            return pa.RecordBatch.from_pydict({"piece": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks(text.as_py() or ""))
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    counts = written(texts.mapInArrow(frugal(counted), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1"))
    return [r["piece"] for r in counts.filter(F.col("n") >= least_count(counts, size)).orderBy("piece").collect()]


def least_count(counts: DataFrame, size: int) -> int:
    """The smallest count ``n`` that at most ``size`` rows reach: its magnitude by a histogram, then halving."""
    sizes = {r["bits"]: r["count"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}
    for bits in sorted(sizes, reverse=True):
        if sizes[bits] > size:
            break
        size -= sizes[bits]
    else:
        return 1
    low, high = 1 << bits - 1, 1 << bits
    while high - low > 1:
        half = (low + high) // 2
        low, high = (low, half) if counts.filter((F.col("n") >= half) & (F.col("n") < 1 << bits)).count() <= size else (half, high)
    return high


def as_array(ids: str) -> np.ndarray:
    return np.array(ids.split(), np.int32)


class Operator:
    """Encoder and decoder of whole columns of text, fitted to the frequent words of ``docs``."""

    def __init__(self, docs: DataFrame, path: str, *, text: str = "text", words: int = LEXICON_WORDS):
        self.vocabulary = Vocabulary(path)
        entries = {w: self.vocabulary.merge(w) for w in lexicon_words(docs.select(text), words)}
        self.lexicon, self.column = Lexicon.build(entries), text
        self.name = hashlib.sha256(self.lexicon + json.dumps(self.vocabulary.ids).encode()).hexdigest()
        self.sent = docs.sparkSession.sparkContext.broadcast((self.vocabulary, self.lexicon))

    def each(self, docs: DataFrame, fields: dict[str, tuple[str, object]], keep: list[str]) -> DataFrame:
        """``keep`` of ``docs`` and, by name in ``fields``, a type and what to make of a text's (n, ids, tokens)."""
        sent, name, column, make = self.sent, self.name, self.column, {k: f for k, (_, f) in fields.items()}
        out = T.StructType([docs.schema[c] for c in keep] + [T.StructType.fromDDL(f"x {t}")[0] for t, _ in fields.values()])
        for f, field in zip(out.fields[len(keep) :], fields, strict=True):
            f.name = field
        out = T.StructType(out.fields)
        kinds = [f.dataType for f in out.fields[len(keep) :]]
        source = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{column}`").alias("t"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = codec_of(name, sent)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):  # so that few decoded texts are held at once
                    part = batch.slice(at, 256)
                    rows = [codec.text(t.as_py()) for t in part.column(len(keep))]
                    made = [pa.array([f(*r) for r in rows], to_arrow_type(t)) for f, t in zip(make.values(), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *make])

        return source.mapInArrow(frugal(run), out)

    def encode(self, docs: DataFrame) -> DataFrame:
        """``docs`` with token_ids (array of int) and decoded (text), under other names if those are taken."""
        ids, decoded = fresh("token_ids", docs.columns), fresh("decoded", docs.columns)
        return self.each(docs, {ids: ("array<int>", lambda n, ids, tokens: as_array(ids)), decoded: ("string", lambda n, ids, tokens: tokens)}, docs.columns)

    def digests(self, docs: DataFrame) -> DataFrame:
        """Of each row: doc_id, number of ids, and SHA-256 of its ids and of its decoded text."""
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return self.each(docs, {"n_tokens": ("long", lambda n, ids, tokens: n), "ids_sha256": ("string", lambda n, ids, tokens: sha(ids)), "decoded_sha256": ("string", lambda n, ids, tokens: sha(tokens))}, ["doc_id"])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of ids and decoded text of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Operator(docs, vocabulary_path()).digests(docs)
