"""Byte-level BPE: an exact encoder in linear time, and a decoder by offset table.

Encoding. An Aho-Corasick automaton over all token byte strings gives the longest token that begins
at a byte. The encoder takes that token if it may stand after the previous one, else the next
shorter token that is a prefix of it, and steps back when none fits. Two tokens may stand side by
side exactly when merging their joined bytes leaves the border between them; a memo keeps the answer
for each pair. A byte position found to be a dead end isn't tried again, so time is linear.

Decoding. All token bytes lie in one array; a second array holds where each token begins. The bytes
of a document are gathered from it by index arithmetic.

Texts are split as the tokenizer file says (special tokens, then the byte-level pattern). Words recur,
so encoded words are kept in a dictionary of bounded size in each Python worker; its bound changes the
speed only.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, text_or_empty

#: Fixed value: the split pattern of byte-level tokenizers, with white space as Unicode has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same split for whole texts, without stepping back: of a run of white space before a word the last
#: character alone is left over by the lookahead.
WHOLE_SPLIT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++\z|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}"
LONG_SPACE = re.compile(r"\s{1000}")

#: Words of an encoder's dictionary, and the longest word that is kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 48

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a file of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tables of one tokenizer file, and the backtracking encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        of_text = lambda s: bytes(letters[c] for c in s)
        vocab = {of_text(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        # An order of their own: the 256 bytes first, then tokens as the merges make them.
        self.tokens = [bytes([b]) for b in range(256)]
        self.parts = [(b, b) for b in range(256)]
        order = {t: k for k, t in enumerate(self.tokens)}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = of_text(left), of_text(right)
            if a + b not in order:
                order[a + b] = len(self.tokens)
                self.tokens.append(a + b)
                self.parts.append((order[a], order[b]))
            self.merged.setdefault((order[a], order[b]), order[a + b])
        self.ids = [vocab[t] for t in self.tokens]
        self.sizes = [len(t) for t in self.tokens]
        self.longest = max(self.sizes)
        self.fits: dict[tuple[int, int], bool] = {}

        # Offset table for decoding, by public id.
        by_id = {i: t for t, i in zip(self.tokens, self.ids)} | {i: s.encode() for s, i in self.special.items()}
        top = max(by_id) + 1
        rows = [by_id.get(i, b"") for i in range(top)]
        self.blob = np.frombuffer(b"".join(rows), np.uint8)
        self.width = np.array([len(r) for r in rows], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.decimal = [str(i) for i in range(top)]

    @cached_property
    def shorter(self) -> list[int]:
        """For each token the next shorter one that is a prefix of it, or -1."""
        order = {t: k for k, t in enumerate(self.tokens)}
        return [next((order[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in order), -1) for t in self.tokens]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Longest matches among the bytes of all tokens."""
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(self.tokens):
            found.add_word(t.decode("latin-1"), k)
        found.make_automaton()
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together leaves the border between them.

        Both are undone step by step, the later merge first; a merge across the border that comes
        before the merge just undone would have happened instead.
        """
        found = self.fits.get((left, right))
        if found is None:
            a, b, before, found = left, right, len(self.tokens), True
            while True:
                if self.merged.get((a, b), before) < before:
                    found = False
                    break
                # The left token is the later one, unless it is a byte.
                if a > b and a >= 256:
                    before, a = a, self.parts[a][1]
                elif b >= 256:
                    before, b = b + 1, self.parts[b][0]
                elif a >= 256:
                    before, a = a, self.parts[a][1]
                else:
                    break
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[left, right] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Public ids of one pre-token.

        Tokens of which each may follow the one before are the merges' result, whichever way they were
        found. So the longest matches from left to right are tried first, and where a pair of them
        doesn't fit, the search goes on from there and steps back. A step reads no more of the piece than
        the longest token has bytes, and no byte position is a dead end twice.
        """
        text, find, fits = piece.decode("latin-1"), self.automaton.iter_long, self.fits
        tokens = [token for _, token in find(text)]
        for good, pair in enumerate(zip(tokens, tokens[1:]), 1):
            fit = fits.get(pair)
            if not (self.may_follow(*pair) if fit is None else fit):
                break
        else:
            return [self.ids[t] for t in tokens]
        size, sizes, shorter, longest = len(piece), self.sizes, self.shorter, self.longest
        out, dead, token = tokens[:good], set(), tokens[good]
        at = sum(map(sizes.__getitem__, out))
        while at < size:
            end = at + sizes[token]
            if end not in dead and (not out or self.may_follow(out[-1], token)):
                out.append(token)
                at = end
                if at < size:
                    token = next(find(text[at : at + longest]))[1]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: the token before must be a shorter one
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return [self.ids[t] for t in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of public ids."""
        if not len(ids):
            return b""
        width = self.width[ids]
        ends = np.cumsum(width)
        shift = np.repeat(self.begin[ids] - (ends - width), width)
        return self.blob[shift + np.arange(ends[-1])].tobytes()


class Kept(dict):
    """A dictionary that makes missing entries, and begins anew when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers.

    ``merger``: "backtracking" (this module's) or "library" (tiktoken over the same merges and split, for
    operators that only need the ids; texts with a very long run of white space, which its pattern can't
    hold, go by this module's). Both give the same ids.
    """

    def __init__(self, path: str, merger: str = "backtracking"):
        self.bpe = Bpe(path)
        self.split = regex.compile(SPLIT)
        # White space other than single blanks and line ends: such a text goes by the pattern as a whole.
        self.odd_space = re.compile(r"[^\S \n]|\s\s")
        self.pieces = Kept(self.merge)
        self.words = Kept(self.word)
        self.core = None
        if merger == "library":
            import tiktoken

            self.core = tiktoken.Encoding("tidemark", pat_str=WHOLE_SPLIT, mergeable_ranks={t: k for k, t in enumerate(self.bpe.tokens)}, special_tokens={})
            self.by_rank = np.array(self.bpe.ids, "<u4")

    def merge(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """A word and the blank before it; letters alone are one pre-token."""
        if word.isascii() and word.isalpha():
            return self.merge(" " + word)
        return self.by_pattern(word if word[:1] == "\n" else " " + word)

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def plain(self, text: str) -> bytes:
        """A text without special tokens. No pre-token crosses the blank before a word, so words stand alone."""
        if self.core is not None and not LONG_SPACE.search(text):
            return self.by_rank[np.array(self.core.encode_ordinary(text), np.int64)].tobytes()
        if self.odd_space.search(text):
            return self.by_pattern(text)
        first, *words = text.replace("\n", " \n").split(" ")
        if words and not words[-1]:  # a blank at the end of the text
            return self.by_pattern(first) + b"".join(map(self.words.__getitem__, words[:-1])) + self.by_pattern(" ")
        return self.by_pattern(first) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        special = self.bpe.special_pattern
        if special is None or not special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.bpe.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


@lru_cache(maxsize=2)
def encoder(name: str, merger: str = "backtracking") -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    return Encoder(tokenizer_path(name), merger)


def encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, ids array<int>`` of whole texts.

    A null text counts as empty and gives no ids; repeated rows give repeated rows; other columns are
    not read, so their names don't matter; an empty table gives an empty table.
    """

    def run(doc_ids, texts, name):
        enc = encoder(name)
        return {"doc_id": doc_ids, "ids": [np.frombuffer(enc.encode(t), "<u4").astype(np.int32) for t in texts]}

    return map_batches(docs.select("doc_id", text_or_empty()), run, "doc_id long,ids array<int>", tokenizer)


def decode(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text, bytes that aren't UTF-8 the replacement mark."""

    def run(doc_ids, ids, name):
        bpe = encoder(name).bpe
        return {"doc_id": doc_ids, "text": [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in ids]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long,text string", tokenizer)


def digest_round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Encode and decode each text in one pass over the table, and return digests of both."""

    def run(doc_ids, texts, name):
        enc, n, ids_sha, text_sha = encoder(name), [], [], []
        decimal = enc.bpe.decimal
        for text in texts:
            ids = np.frombuffer(enc.encode(text), "<u4")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
            text_sha.append(hashlib.sha256(enc.bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return {"doc_id": doc_ids, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    schema = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"
    return map_batches(docs.select("doc_id", text_or_empty()), run, schema, tokenizer)
