"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word is encoded left to right. An Aho-Corasick automaton over the vocabulary gives the longest token that starts at
each position; a token may follow another only if merging in rank order could leave exactly these two side by side
(``PairTable``). Where no token fits, the last one is taken back and a shorter one tried; positions found to lead
nowhere are not entered again, so the work is linear in the word. The result equals that of applying merges in rank
order. Tokens that do not encode to themselves are never produced by merging and stay out of the automaton.

The vocabulary file has byte-level BPE with a mark at the end of each word: text is composed (NFC), lower-cased,
split by a pattern, white space dropped. Special tokens in the text are cut out first and keep their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.util import held, lean, table

#: Distinct words whose ids a worker remembers, in two generations of half as many, and the longest such word.
MEMORY, LONGEST_KEPT = 250_000, 64
#: Words of a text encoded at once, so that one text with many different words doesn't outgrow the memory.
WORDS = 1 << 15
#: Stands for the end-of-word mark inside the automaton; no byte maps to it.
END = "\uffff"
#: Ids are gathered from offset tables in runs of this many, so memory does not follow the text.
RUN = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for letters from U+0100 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


class PairTable:
    """Which tokens may stand side by side: filled as pairs come up, bounded, and emptied when full."""

    def __init__(self, parts: dict[int, tuple[int, int]], rank: dict[int, int], merged: dict[tuple[int, int], int]):
        self.parts, self.rank, self.merged, self.known = parts, rank, merged, {}
        self.spines: tuple[dict, dict] = ({}, {})

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces of a token at its right (side 1) or left (side 0) end, each with the rank at which it is used up."""
        out = self.spines[side].get(token)
        if out is None:
            out, until, at = [], float("inf"), token
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.rank[at], self.parts[at][side]
            self.spines[side][token] = out
        return out

    def __call__(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            ok = self.known[key] = self._fits(left, right)
        return ok

    def _fits(self, left: int, right: int) -> bool:
        ends, merged, rank = self.spine(right, 0), self.merged, self.rank
        for a, until_a in self.spine(left, 1):
            for b, until_b in ends:
                # Merges of one rank go from left to right: at equal rank the left token's own merge comes first, the right one's last.
                if (a, b) in merged and (m := rank[merged[a, b]]) < until_a and m <= until_b:
                    return False
        return True


class Codec:
    def __init__(self, path: str):
        import ahocorasick

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.letters = dict(enumerate(byte_letters()))
        inner = lambda token: token.removesuffix(mark) + END if mark and token.endswith(mark) else token
        self.mark = END if mark else ""
        self.ids = {inner(token): k for token, k in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        parts, rank, merged = {}, {}, {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (inner(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token, pair_ids = self.ids[a + b], (self.ids[a], self.ids[b])
            if token in parts or any(x in parts and rank[x] >= k for x in pair_ids):
                raise ValueError("the merges do not build each token once, from tokens built before it")
            parts[token], rank[token], merged[pair_ids] = pair_ids, k, token
        self.fits = PairTable(parts, rank, merged)
        self.units = {t for t, k in self.ids.items() if k not in parts}
        #: The next shorter vocabulary token that a token begins with, by id (-1: none).
        self.shorter: dict[int, int] = {}
        self.length = {k: len(t) for t, k in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token in sorted(self.ids, key=lambda t: (len(t), t)):
            k = self.ids[token]
            if k in parts and not self._whole(token, k):
                continue
            cut = len(token) - 1
            while cut > 0 and (self.ids.get(token[:cut]) is None or self.ids[token[:cut]] not in self.shorter):
                cut -= 1
            self.shorter[k] = self.ids[token[:cut]] if cut else -1
            self.automaton.add_word(token, (k, len(token)))
        self.automaton.make_automaton()
        size = max([*self.ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for token, k in [*vocab.items(), *self.special.items()]:
            names[k] = token
        self.pieces = OffsetTable([(x + " ").encode() for x in names])
        self.numbers = OffsetTable([b"%d " % k for k in range(size)])
        self.code, self.width = ("H", np.uint16) if size <= 1 << 16 else ("I", np.uint32)
        # A contraction can begin only where a run of letters or a digit can't, so the order of these three is free.
        self.split = regex.compile(r"\p{L}+|\p{N}|'(?:[stmd]|re|ve|ll)|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.split_ascii = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\x20\x09-\x0da-z0-9]+").findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, token: str, k: int) -> bool:
        """Whether a token encodes to itself: its two parts do, and they may stand side by side until they merge."""
        a, b = self.fits.parts[k]
        if not all(x in self.shorter or x not in self.fits.parts for x in (a, b)):
            return False
        limit, ends = self.fits.rank[k], self.fits.spine(b, 0)
        return not any(
            (m := self.fits.merged.get((x, y))) is not None and m != k and self.fits.rank[m] < min(until_x, limit) and self.fits.rank[m] <= min(until_y, limit)
            for x, until_x in self.fits.spine(a, 1)
            for y, until_y in ends
        )

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters with its end mark."""
        n = len(word)
        longest = [-1] * n
        span = [0] * n
        for end, (k, size) in self.automaton.iter(word):
            start = end - size + 1
            if size > span[start]:
                longest[start], span[start] = k, size
        at, out, dead, fits, shorter, length = 0, [], bytearray(n + 1), self.fits, self.shorter, self.length
        k = longest[0]
        while True:
            while k >= 0 and (dead[at + length[k]] or (out and not fits(out[-1], k))):
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at += length[k]
                if at == n:
                    return out
                k = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no encoding of {word[:40]!r}")
                k = out.pop()
                at -= length[k]
                k = shorter[k]

    def _ids_of(self, piece: str) -> bytes:
        # Printable ASCII stands for itself in byte letters.
        word = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.code, self.encode_word(word + self.mark)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        out, known = [], self.known
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append(array(self.code, [self.special[part]]).tobytes())
                continue
            every = self.pieces_of(part)
            for begin in range(0, len(every), WORDS):
                pieces = every[begin : begin + WORDS] if len(every) > WORDS else every
                new = set(pieces).difference(known)
                if new:
                    if len(known) + len(new) > MEMORY // 2:
                        # The words of late stay at hand: those met again move over, the others go at the next turn.
                        self.older, self.known = known, {}
                        known, new = self.known, set(pieces)
                    long = {}
                    for x in new:
                        ids = self.older.get(x) or self._ids_of(x)
                        (known if len(x) <= LONGEST_KEPT else long)[x] = ids
                    if long:
                        out.append(b"".join(long[x] if x in long else known[x] for x in pieces))
                        continue
                out.append(b"".join(map(known.__getitem__, pieces)))
        return np.frombuffer(b"".join(out), self.width)

    def pieces_of(self, part: str) -> list[str]:
        """The pieces of a text without special tokens: composed, lower-cased, split."""
        if part.isascii():
            return self.split_ascii(part.lower())
        if any(c > "\u0557" and unicodedata.category(c) == "Cn" for c in set(part)):
            # Python, the regex package and the library know different editions of Unicode: the library decides.
            part = self.library.normalizer.normalize_str(part)
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        # lower() looks around a capital sigma; the library maps each letter for itself.
        return self.split(part.replace("Σ", "σ").lower())

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by one space, in UTF-8."""
        return b"".join(self.pieces.runs(ids))[:-1]


class OffsetTable:
    """Strings end to end with their offsets; runs() yields the bytes of a sequence of them."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def runs(self, ids: np.ndarray):
        for begin in range(0, len(ids), RUN):
            part = ids[begin : begin + RUN]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            yield self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[part] - ends + sizes, sizes)].tobytes()


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, into: str = "ids", path: str | None = None) -> DataFrame:
    """docs with an array of token ids (a column named like into is replaced, all others pass through). Null or empty
    text has no ids; special tokens in a text keep their ids; very long texts are encoded whole, one at a time. Repeated
    rows get equal ids; an empty table gives an empty one. Nothing is shuffled."""
    path = path or default_vocabulary()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @lean
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return _lists([c.encode(t.as_py() or "") for t in texts])

    return docs.withColumn(into, encode(F.col("text")))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def decode_ids(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the decoded text of an array of token ids (a column named like into is replaced, all others pass
    through); null or no ids decode to an empty text, long arrays in runs. Repeated rows get equal texts; an empty table
    gives an empty one. Nothing is shuffled."""
    path = path or default_vocabulary()

    @F.arrow_udf(T.StringType())
    @lean
    def decode(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(np.asarray(r.values)).decode() if r.is_valid and len(r) else "" for r in rows], pa.string())

    return docs.withColumn(into, decode(F.col(ids)))


PAIR_TYPE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def with_round_trip(docs: DataFrame, into: str = "bpe", path: str | None = None) -> DataFrame:
    """docs with a struct (ids, decoded), what encode_texts and decode_ids give in the same cases, made by one worker."""
    path = path or default_vocabulary()

    @F.arrow_udf(PAIR_TYPE)
    @lean
    def both(texts: pa.Array) -> pa.Array:
        c = codec(path)
        ids = [c.encode(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([_lists(ids), pa.array([c.decode(x).decode() if len(x) else "" for x in ids], pa.string())], ["ids", "decoded"])

    return docs.withColumn(into, both(F.col("text")))


DIGEST_TYPE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def with_digests(docs: DataFrame, into: str = "bpe", path: str | None = None) -> DataFrame:
    """docs with a struct (n_tokens, ids_sha256, decoded_sha256): text encoded, ids decoded, both digested where they
    are made, so neither leaves the worker. Null text counts as empty; see encode_texts for all other cases."""
    path = path or default_vocabulary()

    @F.arrow_udf(DIGEST_TYPE)
    @lean
    def digests(texts: pa.Array) -> pa.Array:
        c, rows = codec(path), ([], [], [])
        for t in texts:
            ids = c.encode(t.as_py() or "")
            rows[0].append(len(ids))
            rows[1].append(_digest(c.numbers.runs(ids)))
            rows[2].append(_digest(c.pieces.runs(ids)))
        return pa.StructArray.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], [f.name for f in DIGEST_TYPE.fields])

    return docs.withColumn(into, digests(F.col("text")))


def _digest(runs) -> str:
    """SHA-256 of runs of bytes without the last byte, the separator after the last item."""
    out, held = hashlib.sha256(), b""
    for run in runs:
        out.update(held)
        held = run
    out.update(held[:-1])
    return out.hexdigest()


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """One row for each row of documents, in the cases of with_digests."""
    return with_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
