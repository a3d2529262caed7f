"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

1. Words of all documents, as they stand between white space, are counted (each task counts its own texts, Spark adds
   up the counts) and ``lexicon_size`` frequent ones are encoded once, by merges.
2. They are compiled into a minimal acyclic automaton with shared suffixes. Every arc knows how many words come
   before it, so a walk adds up to the word's number, and the number points at the word's ids: a transducer from
   bytes to ids. The file is put into the shared folder, fetched once per executor and memory-mapped by its tasks.
3. Tasks split texts, look words up in the automaton and merge unseen words exactly by rank. The lexicon therefore
   changes the speed only, never an id. Ids of recent chunks are remembered in tables of bounded bytes.

The vocabulary file is of the kind "BPE with word ends": composed characters, lower case per character, white space
dropped, words by the file's own pattern, bytes written as the visible characters of byte-level BPE, and no decoder,
so that decoding joins the token strings with blanks. Special tokens inside a text are recognised as such.

Defined results: null and empty texts have no tokens (and decode to the empty text); a word of any length is merged
exactly; a character without an entry in Python's Unicode tables is a symbol; repeated rows and null ids give a row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgealign.llm.blocks import table
from judgealign.llm.store import Scratch
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

LEXICON_SIZE = 32768
#: Longer words are left to the merges; bounds the automaton.
LEXICON_BYTES = 64
#: Words of more characters are merged with a heap.
LONG = 48
#: Chunks that a task remembers before it starts over, the bytes they may take, and the longest one it remembers.
REMEMBERED, ROOM, KEPT = 250_000, 64 << 20, 256
#: Single marks behind a word of letters: two words whatever the pattern says of longer marks.
ENDINGS = frozenset(",.;:!?")
#: Characters that Python's ``split`` takes for white space and the vocabulary's pattern does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The visible character of each byte in byte-level BPE: printable Latin-1 itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Tokens, merge ranks, special tokens and the word pattern of a vocabulary file, as plain values to send to tasks."""
    with open(path, encoding="utf-8") as text:
        file = json.load(text)
    model = file["model"]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    return {
        "ids": model["vocab"],
        "end": model["end_of_word_suffix"],
        "ranks": {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])},
        "special": special,
        "tokens": {v: k for k, v in model["vocab"].items()} | {v: k for k, v in special.items()},
        "pattern": file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


class Vocabulary:
    """The rules of a vocabulary file over the plain values that :func:`read_vocabulary` returns."""

    def __init__(self, plain: dict):
        self.ids: dict[str, int] = plain["ids"]
        self.end: str = plain["end"]
        self.ranks: dict[tuple, int] = plain["ranks"]
        #: What may follow a token with the rank of the pair, and the token of each rank.
        self.after: dict[str, dict[str, int]] = {token: {} for token in self.ids}
        self.joined: list[str] = []
        for (left, right), rank in self.ranks.items():
            self.after[left][right] = rank
            self.joined.append(left + right)
        self.special: dict[str, int] = plain["special"]
        self.tokens: dict[int, str] = plain["tokens"]
        self.words = regex.compile(plain["pattern"])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: What all special tokens begin with: a chunk without it holds none.
        self.mark = os.path.commonprefix(list(self.special))
        self.space = regex.compile(r"[\p{White_Space}]+")
        self.visible = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})

    def pieces(self, segment: str) -> list[str]:
        """Words of a text without special tokens, each as visible characters."""
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment)
        # lower case per character: the final sigma is the one letter whose lower case depends on its neighbours
        normal = "".join(c.lower() for c in segment) if "\u03a3" in segment else segment.lower()
        if normal.isalpha():
            words = [normal]
        elif normal[-1:] in ENDINGS and normal[:-1].isalpha():
            words = [normal[:-1], normal[-1]]
        else:
            words = self._words(normal)
        return [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.visible) for w in words]

    def _words(self, normal: str) -> list[str]:
        """Matches of the file's pattern; characters that Python does not know are neither letters nor numbers."""
        if normal.isascii():
            return self.words.findall(normal)
        shown = "".join("\u00a6" if unicodedata.category(c) == "Cn" else c for c in normal)
        return [normal[m.start() : m.end()] for m in self.words.finditer(shown)]

    def merge(self, piece: str) -> list[int]:
        """Ids of one word: the lowest rank first, the leftmost of equal ones first."""
        parts = [*piece[:-1], piece[-1] + self.end]
        return [self.ids[p] for p in (self._merge_long(parts) if len(parts) > LONG else self._merge_short(parts))]

    def _merge_short(self, parts: list[str]) -> list[str]:
        """Merge the best pair until none is left; the ranks of all neighbours stand in a list."""
        after, none, joined = self.after, len(self.joined), self.joined
        ranks = [after[a].get(b, none) for a, b in pairwise(parts)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = joined[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[parts[i - 1]].get(parts[i], none)
            if i < len(ranks):
                ranks[i] = after[parts[i]].get(parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and links, for words of any length."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(parts)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]

    def encode_chunk(self, chunk: str, known: Remembered) -> bytes:
        """Ids (little-endian, 32 bits) of a text without white space, by merges; ``known`` keeps merged words."""
        coded = []
        for part in self.cut.split(chunk) if self.cut and self.mark in chunk else (chunk,):
            if part in self.special:
                coded.append(pack([self.special[part]]))
                continue
            for piece in self.pieces(part):
                found = known.get(piece)
                if found is None:
                    found = known.keep(piece, pack(self.merge(piece)))
                coded.append(found)
        return coded[0] if len(coded) == 1 else b"".join(coded)


class Remembered(dict):
    """Ids of recent words within bounds: long words are not kept, and a full table begins anew."""

    held = 0

    def keep(self, word: str, coded: bytes) -> bytes:
        if len(word) <= KEPT:
            self.held += 4 * len(word) + len(coded)
            if self.held > ROOM or len(self) >= REMEMBERED:
                self.clear()
                self.held = 4 * len(word) + len(coded)
            self[word] = coded
        return coded


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer over the sorted words, as bytes.

    Words are added in order; when the next word leaves a path, the states of that path are final and are replaced
    by an equal state where one exists. Layout: counts, per state the first arc and whether a word ends there, per
    arc its target and number of words before it, then per word where its ids begin, the ids, the labels of the arcs,
    and a bitmap of word hashes.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def settle(open_state: dict) -> int:
        key = (open_state["ends"], tuple(open_state["arcs"]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path = [{"ends": False, "arcs": []}]
    last = b""
    order = sorted(words)
    for word in [*order, None]:
        shared = 0
        if word is not None:
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
        while len(path) - 1 > shared:
            done = path.pop()
            path[-1]["arcs"].append((last[len(path) - 1], settle(done)))
        if word is not None:
            path.extend({"ends": False, "arcs": []} for _ in word[shared:])
            path[-1]["ends"] = True
            last = word
    root = settle(path[0])
    below = []
    for ends, arcs in states:
        below.append(int(ends) + sum(below[t] for _, t in arcs))
    first, labels, targets, skips = [0], [], [], []
    for ends, arcs in states:
        ahead = int(ends)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(ahead)
            ahead += below[target]
        first.append(len(labels))
    begins = np.cumsum([0, *(len(words[w]) for w in order)])
    # a bit per hash of a word: most words that are not in the lexicon are told by one look
    bits = np.zeros(1 << max(3, (32 * len(order)).bit_length()), np.uint8)
    bits[[zlib.crc32(w) % len(bits) for w in order]] = 1
    head = struct.pack("<5I", root, len(states), len(labels), len(order), len(bits))
    arrays = (first, [int(e) for e, _ in states], targets, skips, begins, [i for w in order for i in words[w]])
    return head + b"".join(np.asarray(a, dtype="<u4").tobytes() for a in arrays) + bytes(labels) + np.packbits(bits, bitorder="little").tobytes()


class Lexicon:
    """Read access to a compiled lexicon, in a memory-mapped file or in bytes."""

    def __init__(self, data: mmap.mmap | bytes):
        self.root, n, m, k, self.n_bits = struct.unpack_from("<5I", data, 0)
        view, at = memoryview(data), 20

        def part(count: int) -> memoryview:
            nonlocal at
            at += 4 * count
            return view[at - 4 * count : at].cast("I")

        self.first, self.ends, self.target, self.skip, self.begin = part(n + 1), part(n), part(m), part(m), part(k + 1)
        self.ids = at
        part(self.begin[k])
        self.data, self.labels, self.bits = data, at, at + m

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word (little-endian, 32 bits), None if it is not in the lexicon."""
        place = zlib.crc32(word) % self.n_bits
        if not self.data[self.bits + (place >> 3)] >> (place & 7) & 1:
            return None
        state, number, find, base = self.root, 0, self.data.find, self.labels
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + self.first[state], base + self.first[state + 1])
            if arc < 0:
                return None
            number += self.skip[arc - base]
            state = self.target[arc - base]
        return self.data[self.ids + 4 * self.begin[number] : self.ids + 4 * self.begin[number + 1]] if self.ends[state] else None


class Encoder(Remembered):
    """Ids, as little-endian bytes, of chunks without white space."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.merged = Remembered()

    def __missing__(self, chunk: str) -> bytes:
        coded = self.lexicon.get(chunk.encode()) if self.lexicon else None
        if coded is None:
            coded = self.vocabulary.encode_chunk(chunk, self.merged)
        return self.keep(chunk, coded)

    def encode(self, text: str) -> bytes:
        """All ids of a text."""
        chunks = self.vocabulary.space.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words between white space, short enough for the lexicon, with their counts, as often as the table of a task is full."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    words: Counter = Counter()
    held = 0
    for batch in batches:
        for scalar in batch.column("text"):
            text = scalar.as_py() or ""
            words.update(text.split())
            held += len(text)
            if len(words) > REMEMBERED or held > ROOM:
                yield _short(schema, words)
                words.clear()
                held = 0
    yield _short(schema, words)


def _short(schema: pa.Schema, words: Counter) -> pa.RecordBatch:
    kept = [(w, n) for w, n in words.items() if len(w.encode()) <= LEXICON_BYTES]
    return table(schema, word=[w for w, _ in kept], n=[n for _, n in kept])


def frequent_words(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` frequent words, counted over all texts: the top ones of each of many hash parts.

    Every part gives its share, so what reaches the driver is bounded by ``size`` and no task sorts all words.
    """
    counts = docs.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    parts = max(1, size // 128)
    dealt = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "word"))
    return dealt.withColumn("place", place).filter(F.col("place") <= -(-size // parts)).select("word")


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_SIZE) -> bytes:
    """Compile the frequent words of all texts."""
    words, known = [row["word"] for row in frequent_words(docs, size).collect()], Remembered()
    return compile_lexicon({w.encode(): np.frombuffer(vocabulary.encode_chunk(w, known), "<u4").tolist() for w in words if not ODD_SPACE.search(w)})


_CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _encode(vocabulary, file: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(vocabulary.value), Lexicon.open(SparkFiles.get(file)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, decoded = [], []
                for text in part.column("text"):
                    code = coder.encode(text.as_py() or "")
                    codes.append(code)
                    decoded.append(hashlib.sha256(coder.decode(np.frombuffer(code, "<u4").tolist()).encode()).hexdigest())
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                ends, flat = np.zeros(len(codes) + 1, np.int32), np.zeros(0, np.int32)
                if keep_ids:
                    ends[1:], flat = np.cumsum(sizes), np.frombuffer(b"".join(codes), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                digests = [hashlib.sha256(c).hexdigest() for c in codes]
                yield table(_CODES, doc_id=part.column("doc_id"), n_tokens=sizes, ids=ids, ids_sha256=digests, decoded_sha256=decoded)

    return run


def encode_documents(
    docs: DataFrame, tokenizer_path: str, lexicon_size: int = LEXICON_SIZE, keep_ids: bool = True, scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` per document; the last is of the text decoded from the ids.

    Without ``keep_ids`` the digests are all that leaves the tasks, and ``ids`` is missing.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "bpe")
    plain = read_vocabulary(tokenizer_path)
    vocabulary, shared = Vocabulary(plain), spark.sparkContext.broadcast(plain)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = build_lexicon(texts, vocabulary, lexicon_size)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(scratch.put(name, data))
    schema = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    coded = texts.mapInArrow(_encode(shared, name, keep_ids), schema)
    return coded if keep_ids else coded.drop("ids")


def _decode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(vocabulary.value), None)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` from rows with ``doc_id`` and ``ids``; null ids decode to the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    return coded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, text string")
