"""Byte-pair encoding and decoding by a prefix-sharing trie traversal.

The last token of a word's encoding is the only token t that ends the word such that t may follow
the last token of what stands before it: the pair is encoded as just these two tokens. So a prefix
needs no more state than its last token. The candidates are the tokens that end there, found by an
automaton over the vocabulary. The distinct words of a batch, sorted, are a trie walked
depth first: the path of last tokens is kept, each word goes on from the prefix that it shares with
the word before, and a prefix that many words share is encoded once. Whether two tokens may follow
each other is found once by merging their bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm import _spark, tokens

#: Fixed value: how byte-level tokenizers split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder(tokens.Encoder):
    """units() by the trie walk; decode() by the tokens' bytes."""

    most = 350_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        model, before = about["model"], about.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or about.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or a prefix space is encoded here")
        letters = tokens.byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.rank = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[raw[a], raw[b]] = k
        self.added = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.follows: dict[int, bool] = {}
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        self._suffixes()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        super().__init__()

    def merged(self, word: bytes) -> list[bytes]:
        """Plain byte-pair encoding: the pair of the lowest rank is merged, the leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _suffixes(self) -> None:
        """States for the longest end of what was read that begins some token (breadth first, with fallbacks)."""
        self.goto: dict[int, int] = {}
        self.fall, self.token_at = [0], [-1]
        for token, i in self.ids.items():
            state = 0
            for byte in token:
                to = self.goto.get(state << 8 | byte)
                if to is None:
                    to = self.goto[state << 8 | byte] = len(self.fall)
                    self.fall.append(0)
                    self.token_at.append(-1)
                state = to
            self.token_at[state] = i
        below: dict[int, list[tuple[int, int]]] = {}
        for edge, to in self.goto.items():
            below.setdefault(edge >> 8, []).append((edge & 255, to))
        level = [to for _, to in below.get(0, ())]
        while level:
            deeper = []
            for state in level:
                for byte, to in below.get(state, ()):
                    back = self.fall[state]
                    while back and (back << 8 | byte) not in self.goto:
                        back = self.fall[back]
                    self.fall[to] = self.goto.get(back << 8 | byte, 0)
                    deeper.append(to)
            level = deeper
        self.moves = dict(self.goto)
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.fall)
        self.ends[0] = ()

    def _move(self, state: int, byte: int) -> int:
        start = state
        while (to := self.goto.get(state << 8 | byte)) is None and state:
            state = self.fall[state]
        to = self.moves[start << 8 | byte] = to or 0
        return to

    def _ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """(id, length) of the tokens that end here, the longest first; those whose own bytes encode otherwise are never made."""
        chain, at = [], state
        while self.ends[at] is None:
            chain.append(at)
            at = self.fall[at]
        got = self.ends[at]
        for at in reversed(chain):
            i = self.token_at[at]
            if i >= 0 and self.merged(self.bytes_of[i]) == [self.bytes_of[i]]:
                got = ((i, len(self.bytes_of[i])), *got)
            self.ends[at] = got
        return got

    def _may_follow(self, before: int, token: int) -> bool:
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        a, b = self.bytes_of[before], self.bytes_of[token]
        got = self.follows[before << 32 | token] = self.merged(a + b) == [a, b]
        return got

    def words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct words."""
        moves, ends, follows, lengths = self.moves, self.ends, self.follows, self.lengths
        out, path = {}, b""
        states, last = [0], [-1]
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                to = moves.get(state << 8 | byte)
                state = self._move(state, byte) if to is None else to
                found = ends[state]
                for token, length in self._ends(state) if found is None else found:
                    if length == end:
                        break
                    before = last[end - length]
                    ok = follows.get(before << 32 | token)
                    if ok or (ok is None and self._may_follow(before, token)):
                        break
                else:
                    raise ValueError("the vocabulary has no token for a byte")
                last.append(token)
                states.append(state)
            path, at, ids = word, len(word), []
            while at:
                ids.append(last[at])
                at -= lengths[last[at]]
            out[word] = ids[::-1]
        return out

    def units(self, units: list[str]) -> list[bytes]:
        pieces = []
        for unit in units:
            unit, own = unit.removeprefix("\0"), []
            for part in self.special.split(unit) if any(t in unit for t in self.added) else [unit]:
                if part in self.added:
                    own.append(part)
                elif part:
                    own += [w.encode() for w in self.split.findall(part)]
            pieces.append(own)
        distinct = {w for own in pieces for w in own if isinstance(w, bytes)}
        of = {w: np.array(got, "<u4").tobytes() for w, got in self.words(list(distinct)).items()}
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        return [b"".join([special[w] if isinstance(w, str) else of[w] for w in own]) for own in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encoded(docs: DataFrame, tokenizer: str = tokens.DEFAULT_TOKENIZER, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary, decoded) of every whole text of docs (doc_id, text).

    ids: little-endian unsigned 32-bit integers; decoded: their text. A null text is empty. Rows with
    equal or null doc_ids stay as they are. With digests, ids_text holds the decimal ids joined by
    commas in place of the ids.
    """
    where = tokens.tokenizer_path(tokenizer)
    schema = "doc_id long, n_tokens long, " + ("ids_text string" if digests else "ids binary") + ", decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        decimal = {i: str(i) for i in enc.bytes_of}
        for part, texts in tokens.text_groups(batches, "text", 1 << 20):
            got = enc.encode(texts)
            shown = [",".join(map(decimal.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in got] if digests else got
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(shown, pa.string() if digests else pa.binary()), pa.array([enc.decode(x) for x in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_text" if digests else "ids", "decoded"],
            )

    return _spark.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, schema)
