"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the merge list produces. It starts with one
state that has an arc for each base symbol, and takes one gadget for each merge (u, v), in order:

    the state that u-arcs lead to is copied without its v-arc, and u-arcs lead to the copy from then on;
    wherever a u-arc and then a v-arc could be followed, a uv-arc leads to where the v-arc led.

All arcs of one token lead to one state, so the arcs are kept as `after[token]`, and a state as the copy it was made
from, the token whose arcs it takes and the last gadget that touched it. Whether an arc leaves a state is worked out
from that record when it is first met and kept in a table. A word's encoding is the one path whose labels spell it;
for each prefix there is one, so a left-to-right pass finds it without search. Decoding gives out the arc labels.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import give_back

# How the tokenizer file cuts words; a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = b".,;:!?*#$%&|()-+/"  # ASCII signs but for the apostrophe and what special tokens are made of
START = 0  # the state before the first token
KEPT_RUNS, KEPT_WORDS = 400_000, 60_000  # twice as many encodings are kept by a worker at most
LONG_WORD = 64  # bytes; longer words are not kept
KEPT_ARCS = 400_000  # arcs that a worker keeps worked out


def byte_letters() -> dict[int, str]:
    """A visible letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class Automaton:
    """Compiled merges: tokens are ids of `vocab`, rank is a merge's place in the list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        n = max(vocab.values()) + 1
        self.left, self.right, self.made = [-1] * n, [-1] * n, [-1] * n
        self.after = [START] * n  # token -> state that its arcs lead to
        # Per state: the state it was copied from before its own gadgets, its token, its last gadget.
        self.base, self.owner, self.touched = [START], [-1], [-1]
        self.rank: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            u, v = vocab[a], vocab[b]
            self._gadget(rank, u, v, vocab[a + b])
        # How far the longest label with these first three letters reaches.
        self.reach: dict[str, int] = {}
        for label in vocab:
            length = len(label.removesuffix(end))
            self.reach[label[:3]] = max(length, self.reach.get(label[:3], 3))
        self._arcs: dict[int, bool] = {}
        self._tokens = n

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        self.rank[u, v] = rank
        target, old = self.after[v], self.after[u]
        # A copy of a copy for the same token records the first base only: its gadgets are found by rank.
        self.base.append(self.base[old] if self.owner[old] == u else old)
        self.owner.append(u)
        self.touched.append(rank)
        self.after[u] = len(self.owner) - 1
        self.left[uv], self.right[uv], self.made[uv] = u, v, rank
        self.after[uv] = target

    def arc(self, state: int, token: int) -> bool:
        """Whether `state` has an arc for `token`."""
        key = state * self._tokens + token
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > KEPT_ARCS:
                self._arcs.clear()
            found = self._arcs[key] = self._arc(state, token)
        return found

    def _arc(self, state: int, token: int) -> bool:
        # The arc was made from the arc of the token's left part, if that was still there when it was made.
        until = len(self.rank)
        while token >= 0:
            at = state
            while at != START:
                taken = self.rank.get((self.owner[at], token))
                if taken is not None and taken <= self.touched[at] and taken <= until:
                    return False
                at = self.base[at]
            until, token = self.made[token], self.left[token]
        return True

    def encode(self, letters: str) -> list[int]:
        """Tokens of one word, given as byte letters; its last symbol carries the end mark.

        Long labels are tried first. A position from which the end was not reached is never entered again: the path to
        it is the only one, so each position is left for good at most once.
        """
        n, vocab, after, reach, end = len(letters), self.vocab, self.after, self.reach.get, self.end
        whole = vocab.get(letters + end)
        if whole is not None and self.arc(START, whole):
            return [whole]
        found: list[int] = []
        ends = [0]
        dead: set[int] = set()
        stop = n
        while ends[-1] < n:
            i = ends[-1]
            state = after[found[-1]] if found else START
            j = min(stop, i + reach(letters[i : i + 3], 2))
            while j > i:
                token = vocab.get(letters[i:j]) if j < n else vocab.get(letters[i:] + end)
                if token is not None and j not in dead and self.arc(state, token):
                    break
                j -= 1
            if j > i:
                found.append(token)
                ends.append(j)
                stop = n
            else:
                dead.add(i)
                stop = ends.pop()
                found.pop()
        return found


class Kept(dict):
    """Encodings a worker has at hand, made when first asked for. Two generations: frequent ones stay, and there are at
    most twice `most`. A long key is not kept."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONG_WORD:
            self[key] = found
        return found

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Tokenizer:
    """Word-level BPE as a tokenizer file describes it: composed, lower-cased, white space dropped."""

    def __init__(self, path: str, kept_runs: int = KEPT_RUNS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = spec["model"]
        self.end = self.model["end_of_word_suffix"] or ""
        self.dtype = "<i4"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        # Whether the pattern keeps letters together and other signs together, which short cuts stand on.
        self.plain = split["pattern"]["Regex"] == WORD_PATTERN
        self.letters = byte_letters()
        self.letter_of = [self.letters[b] for b in range(256)]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.runs, self.forms = Kept(self._run, kept_runs), Kept(self._word, KEPT_WORDS)

    @cached_property
    def raw_id(self) -> list[bytes]:
        """The bytes of each id."""
        return [i.tobytes() for i in np.arange(len(self.labels), dtype=self.dtype)]

    @cached_property
    def automaton(self) -> Automaton:
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.model["merges"]]
        return Automaton(self.model["vocab"], merges, self.end)

    @cached_property
    def labels(self) -> list[str]:
        found = {i: t for t, i in self.model["vocab"].items()} | {i: t for t, i in self.special.items()}
        return [found.get(i, "") for i in range(max(found) + 1)]

    def _run(self, raw: bytes) -> bytes:
        """Ids, in bytes, of a run without ASCII white space. No word crosses white space, so runs are encoded
        one by one."""
        # Letters, then signs without an apostrophe: two words, as the pattern would cut them.
        letters = raw.rstrip(SIGNS)
        if letters.isalpha() and self.plain:
            if len(letters) < len(raw):
                return self.runs[letters] + self.forms[raw[len(letters) :].decode()]
            return self._word(letters.lower().decode())
        text, found = raw.decode("utf-8"), []
        if self.plain and text.isalpha() and is_normalized("NFC", text):
            small = text.replace("Σ", "σ").lower()
            if small.isalpha():
                return self.forms[small]
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                found.append(self.raw_id[self.special[part]])
                continue
            # Letter by letter, so a final sigma is no special case.
            part = part.lower() if part.isascii() else normalize("NFC", part).replace("Σ", "σ").lower()
            found += map(self.forms.__getitem__, self.words.findall(part))
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letter_of[b] for b in word.encode("utf-8")])
        return b"".join(map(self.raw_id.__getitem__, self.tokens(letters)))

    def tokens(self, letters: str) -> list[int]:
        return self.automaton.encode(letters)

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text, each in the bytes of `dtype`."""
        ids = b"".join(map(self.runs.__getitem__, text.encode("utf-8").split())) if text else b""
        self.runs.turn()
        self.forms.turn()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)

    def decode(self, ids: list[int]) -> str:
        """The labels of the path, one space between two; special tokens are given out like the others."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, kept_runs: int = KEPT_RUNS) -> Tokenizer:
    """Compiled once in each worker, from a file that every worker has."""
    return Tokenizer(path, kept_runs)


def _coded(batch: pa.RecordBatch, at: int, path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], pa.ListArray]]:
    """Parts of a batch with the ids of their texts, which are in column `at`."""
    tool = tokenizer(path)
    for first in range(0, batch.num_rows, 250):
        part = batch.slice(first, 250)
        coded = [tool.encode(t.as_py()) for t in part.column(at)]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
        yield part, coded, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded).astype(np.int32)))


def encode_decode(docs: DataFrame, path: str, kept_runs: int = KEPT_RUNS) -> DataFrame:
    """doc_id, source, n_tokens, ids (array of int) and decoded (string) of each row of (doc_id, source, text).

    The whole text is encoded as the tokenizer file at `path` says, without added special tokens; `decoded` is made
    from `ids` alone. Null and empty texts have no ids and decode to the empty string; rows that repeat are encoded
    like any other; an empty table gives no rows; other columns are ignored. No shuffle: a row's work needs the row only.
    A worker keeps at most twice `kept_runs` encodings at hand; fewer need less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tool = tokenizer(path, kept_runs)
        for batch in batches:
            for first in range(0, batch.num_rows, 250):
                part = batch.slice(first, 250)
                coded = [tool.encode(t.as_py()) for t in part.column(2)]
                sizes = [len(c) for c in coded]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(coded).astype(np.int32)))
                decoded = pa.array([tool.decode(c.tolist()) for c in coded], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), ids, decoded], NAMES)

    source = F.col("source") if "source" in docs.columns else F.lit(None)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, source string, n_tokens long, ids array<int>, decoded string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
