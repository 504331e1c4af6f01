"""BPE encoding and decoding, with the encodings of shared word prefixes computed once.

The encoding of a word's prefix is fixed by its last token: the rest is the encoding of the prefix
without that token. Token ``t`` is the last one exactly if it may follow the last token before it,
that is, if merging the two side by side from single symbols gives the same two back. The distinct
words of a chunk of texts, sorted, are the depth-first order of their trie; the states (last token
starts) of the path to the current node stay, so a prefix that several words share is worked out once.

Rows: a null text counts as empty, an empty text has no tokens. Repeated rows, equal ids and null
ids are kept as they are; texts of any length are encoded whole. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable
from hashlib import sha256
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtide.llm.common import per_chunk, per_value, struct_of, worker_state

CACHED = 150_000  # words, and the same again of older ones, that a worker remembers (some 60 MB)
PAIRS = 100_000  # pairs of tokens that it remembers (some 15 MB)
NEVER = 1 << 30
SPLITS = 2000  # sets of characters beyond ASCII whose patterns are kept
NO_CHARACTERS: frozenset[str] = frozenset()
LETTERS_OR_DIGITS = (r"[\p{L}]+", r"[\p{N}]")
ID = np.dtype("<i4")


def load_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file (word-end BPE over byte symbols), at most a few MB."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"ids": model["vocab"], "merges": merges, "end": model["end_of_word_suffix"],
            "pattern": split["pattern"]["Regex"],
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def letters_first(pattern: str) -> str:
    """The alternatives of a pattern, those of letters and digits before those that start with an apostrophe; the same matches."""
    parts = pattern.split("|")
    first = [p for p in parts if p in LETTERS_OR_DIGITS]
    if not all(p in first or p[0] == "'" or p.startswith("[^") for p in parts):
        return pattern
    return "|".join(first + [p for p in parts if p not in first])


class PrefixEncoder:
    """Encodes words (strings of byte symbols) into token ids."""

    def __init__(self, vocabulary: dict):
        self.ids, self.end = vocabulary["ids"], vocabulary["end"]
        self.tokens = {n: t for t, n in self.ids.items()}
        self.rank = {pair: n for n, pair in enumerate(vocabulary["merges"])}
        self.inner, self.final = self.lengths(False), self.lengths(True)
        self.follows: dict[int, bool] = {}  # of two tokens: whether they stay two
        self.edges: tuple[dict, dict] = ({}, {})  # left and right edges of tokens, at most one of each a token

    def lengths(self, final: bool) -> dict[str, list[int]]:
        """Which lengths tokens have that end with given three symbols, longest first, then 2 and 1."""
        found: dict[str, set[int]] = {}
        for token in self.ids:
            if (token.endswith(self.end) and token != self.end) == final:
                body = token[: -len(self.end)] if final else token
                found.setdefault(body[-3:], {1, 2}).add(len(body))
        return {tail: sorted(sizes, reverse=True) for tail, sizes in found.items()}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def halves(self, token: str) -> tuple[str, str] | tuple[()] | None:
        """The two that the last merge of a token joins; () for a symbol, None if its symbols merge to something else."""
        parts, last = self.symbols(token), ()
        while len(parts) > 1:
            order = [self.rank.get(pair, NEVER) for pair in zip(parts, parts[1:])]
            least = min(order)
            if least == NEVER:
                return None
            best = order.index(least)
            last = (parts[best], parts[best + 1])
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
        return last

    def edge(self, token: str, side: int) -> list[tuple[str, int]] | None:
        """What stands at a token's left (0) or right (1) edge while it is merged, each with the rank of its end."""
        found = self.edges[side].get(token)
        if found is None and token not in self.edges[side]:
            pair = self.halves(token)
            if pair == ():
                found = [(token, NEVER)]
            elif pair is not None and (inner := self.edge(pair[side], side)) is not None:
                found = [*inner[:-1], (pair[side], self.rank[pair]), (token, NEVER)]
            self.edges[side][token] = found
        return found

    def stay_two(self, before: int, token: int) -> bool:
        """Whether no merge joins the pieces at the border of two tokens while both are merged; of equal ranks the left one is first."""
        right = self.edge(self.tokens[token], 0)
        if right is None or before < 0:
            return right is not None
        left = self.edge(self.tokens[before], 1)
        i = j = 0
        while left is not None:
            (a, end_a), (b, end_b) = left[i], right[j]
            joined = self.rank.get((a, b), NEVER)
            if joined < end_a and joined <= end_b:
                return False
            if end_a == end_b == NEVER:
                return True
            i, j = (i + 1, j) if end_a <= end_b else (i, j + 1)
        return False

    def may_follow(self, before: int, token: int) -> bool:
        """Whether two tokens side by side stay two tokens (``before`` is -1 at a word's start)."""
        key = (before + 1 << 32) + token
        known = self.follows.get(key)
        if known is None:
            known = self.stay_two(before, token)
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            self.follows[key] = known
        return known

    def last_token(self, word: str, depth: int, states: list, end: str) -> tuple[int, int]:
        """Start and id of the last token of ``word[:depth]``; states has those of shorter prefixes."""
        sizes = self.final if end else self.inner
        for size in sizes.get(word[max(0, depth - 3):depth], (2, 1)):
            start = depth - size
            if start >= 0:
                token = self.ids.get(word[start:depth] + end)
                if token is not None and self.may_follow(states[start][1], token):
                    return start, token
        raise ValueError(f"no token ends {word[:depth]!r}")

    def encode_all(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of each distinct word, by a depth-first walk over their trie."""
        found: dict[str, tuple[int, ...]] = {}
        states, path = [(0, -1)], ""  # states[d]: start and id of the last token of path[:d]
        for word in sorted(words):
            shared = min(len(commonprefix((path, word))), len(states) - 1, len(word))
            del states[shared + 1:]
            for depth in range(shared + 1, len(word)):
                states.append(self.last_token(word, depth, states, ""))
            path = word
            upto, token = self.last_token(word, len(word), states, self.end)
            ids = [token]
            while upto:
                upto, token = states[upto]
                ids.append(token)
            found[word] = tuple(ids[::-1])
        return found


class TextEncoder:
    """Whole texts into ids: special tokens, normalising, splitting, then words by their trie."""

    def __init__(self, vocabulary: dict):
        self.words = PrefixEncoder(vocabulary)
        self.pattern = letters_first(vocabulary["pattern"])
        self.splits: dict[frozenset[str], re.Pattern | regex.Pattern] = {}
        self.special = vocabulary["special"]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.table = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words of one stretch without special tokens, normalised as the tokenizer file says."""
        if text.isascii():
            return self.split(NO_CHARACTERS).findall(text.lower())
        # letters are lowered one by one, so a final sigma is no special case
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.split(frozenset([c for c in set(text) if c > "\x7f"])).findall(text)

    def split(self, others: frozenset[str]) -> re.Pattern | regex.Pattern:
        """The pattern for texts of ASCII and the given characters, with its classes spelled out, which is quicker."""
        found = self.splits.get(others)
        if found is None:
            if len(self.splits) >= SPLITS:
                self.splits.clear()
            own = {kind: "".join([re.escape(c) for c in sorted(others) if regex.match(kind, c)]) for kind in (r"\p{L}", r"\p{N}", r"\s")}
            plain = self.pattern
            for kind, ascii_part in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9"), (r"\s", r"\s")):
                plain = plain.replace(kind, ascii_part + own[kind])
            found = self.splits[others] = regex.compile(self.pattern) if r"\p" in plain else re.compile(plain, re.ASCII)
        return found

    def plan(self, text: str) -> list[list[str] | int]:
        """Stretches of words, with the ids of special tokens between them."""
        parts, upto = [], 0
        for m in self.at_special.finditer(text):
            parts += [self.pieces(text[upto:m.start()]), self.special[m.group()]]
            upto = m.end()
        return [*parts, self.pieces(text[upto:])]

    def symbols_of(self, words: list[str]) -> list[str]:
        """The words with each byte's stand-in; visible ASCII stands for itself."""
        table = self.table
        return [w if w.isascii() and w.isprintable() else "".join([table[b] for b in w.encode("utf-8")]) for w in words]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, by their trie."""
        symbols = self.symbols_of(words)
        found = self.words.encode_all(symbols)
        return [np.array(found[s], ID).tobytes() for s in symbols]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered; they are remembered from now on."""
        fresh = {w: ids for w in words if (ids := self.older.get(w)) is not None}
        new = [w for w in words if w not in fresh]
        fresh.update(zip(new, self.ids_of(new)))
        if len(self.known) + len(fresh) > CACHED:
            self.known, self.older = {}, self.known
        self.known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the words that are new in the texts are worked out together."""
        get = self.known.get
        drafts, missing = [], set()
        for text in texts:
            parts = []
            for part in self.plan(text):
                found = [np.array([part], ID).tobytes()] if isinstance(part, int) else list(map(get, part))
                if None in found:
                    missing.update([w for w, ids in zip(part, found) if ids is None])
                    parts.append((part, found))
                else:
                    parts.append((None, b"".join(found)))
            drafts.append(parts)
        fresh = self.learn(missing)
        return [np.frombuffer(b"".join([
            found if words is None else b"".join([fresh[w] if ids is None else ids for w, ids in zip(words, found)])
            for words, found in parts]), ID) for parts in drafts]


class Decoder:
    """Ids into text: tokens joined by one space; ids that are no tokens are left out."""

    def __init__(self, vocabulary: dict):
        named = {n: t for part in ("ids", "special") for t, n in vocabulary[part].items()}
        self.tokens = np.array([named.get(n) for n in range(max(named, default=-1) + 1)], object)

    def decode(self, ids: np.ndarray) -> str:
        own = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join([t for t in self.tokens[own].tolist() if t is not None])


def encode(docs: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def make():
        encoder = worker_state(key, lambda: TextEncoder(shared.value))
        return lambda texts: encoder.encode([text or "" for text in texts])

    ids = per_chunk(docs.sparkSession, make, "array<int>", pa.list_(pa.int32()), key)
    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode(spark: SparkSession, vocabulary: dict) -> Callable[..., Column]:
    """A column function from token ids to text."""
    shared, key = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def make():
        decoder = worker_state(key, lambda: Decoder(shared.value))
        return lambda ids: None if ids is None else decoder.decode(np.array([-1 if n is None else n for n in ids], np.int64))

    return per_value(spark, make, "string", pa.string(), key)


def digests(encoder: TextEncoder, decoder: Decoder, texts: list[str]) -> list[dict]:
    """Number and digest of each text's ids, and the digest of what these ids decode to."""
    found = []
    for ids in encoder.encode(texts):
        decimal = " ".join(map(str, ids.tolist()))
        found.append({"n_tokens": len(ids), "ids_sha256": sha256(decimal.encode()).hexdigest(),
                      "decoded_sha256": sha256(decoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()})
    return found


def token_digests(docs: DataFrame, vocabulary: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): counts and digests of the ids and of what they decode to.

    A text is encoded and its ids decoded in one call, so neither ids nor decoded texts leave the worker.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def make():
        encoder, decoder = worker_state(key, lambda: (TextEncoder(shared.value), Decoder(shared.value)))
        return lambda texts: digests(encoder, decoder, [text or "" for text in texts])

    kind = struct_of(n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())
    found = per_chunk(docs.sparkSession, make, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>", kind, key)
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("digests")).select(F.col(id_col), "digests.*")
