"""Byte-pair encoding by an automaton compiled from a public vocabulary's merge list.

The automaton reads tokens; its language is the set of correct tokenizations, of which every
byte string has exactly one. It starts as one state with an arc to itself for each byte. Each
merge (a, b) -> c is compiled, in order, by a gadget:

* c leads to a state that is a copy of b's state as it is at that moment;
* from a's state the arc b is cut, for a followed by b would have merged;
* wherever the arc a is still allowed, a new arc c is allowed.

All arcs labelled a lead to one state, so a state is named by its last token, and copies are
kept by reference and moment (the number of the merge) instead of as 50k x 50k table rows: an
arc is looked up through the gadgets once and then stays in the transition table. To encode a
word, the table is walked from the start over the trie of token spellings; as the automaton is
deterministic and every prefix has one accepted path, each position is reached by one arc.
Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framelake.tables import spread

#: Fixed value: how the byte-level vocabularies split a text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and arcs that are kept; beyond that they are forgotten, which costs time only.
CACHE_WORDS = 400_000
CACHE_ARCS = 4_000_000
CACHE_WORD_LETTERS = 64
#: A moment after all merges.
NEVER = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where a public vocabulary lies: ``folder``, else FRAMELAKE_TOKENIZERS, else the installed package."""
    folder = folder or os.environ.get("FRAMELAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabulary files: printable ones for themselves, others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class MergeAutomaton:
    """Deterministic automaton of correct tokenizations; see the module."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """labels: token id -> bytes; merges: (a, b, c) in order."""
        self.labels = labels
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born = dict.fromkeys(labels, -1)
        self.cut: dict[tuple[int, int], int] = {}
        self._fresh()
        for moment, (a, b, c) in enumerate(merges):
            self._gadget(moment, a, b, c)
        self.trie: dict = {}
        usable = {i for i, label in labels.items() if len(label) == 1} | set(self.left)
        for i in usable:
            node = self.trie
            for byte in labels[i]:
                node = node.setdefault(byte, {})
            node[-1] = i

    def _fresh(self) -> None:
        self.table: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(WORDS).findall

    def _gadget(self, moment: int, a: int, b: int, c: int) -> None:
        if not self.arc(a, b):  # cut off by earlier merges: this one never happens
            return
        self.table.clear()
        self.cut[a, b] = moment
        if c not in self.left:  # a spelling that is merged in two ways is reached first by the earlier one
            self.left[c], self.right[c], self.born[c] = a, b, moment

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "words", "split")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    @classmethod
    def load(cls, path: str) -> MergeAutomaton:
        """From a vocabulary file with ``model.vocab`` and ``model.merges`` in byte letters."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_letters()
        vocab = model["vocab"]
        labels = {i: bytes(byte[ch] for ch in spelling) for spelling, i in vocab.items() if all(ch in byte for ch in spelling)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in the state after ``state``: the gadgets applied backwards in time."""
        key = (state, token)
        known = self.table.get(key)
        if known is None:
            p, y, now = state, token, NEVER
            while True:
                if self.cut.get((p, y), now) < now:
                    known = False
                    break
                born_p, born_y = self.born[p], self.born[y]
                if born_p < 0 and born_y < 0:
                    known = True
                    break
                if born_p > born_y:  # p's state is a copy of its right part's at that moment
                    now, p = born_p, self.right[p]
                else:  # y was allowed wherever its left part was at that moment, after the cut
                    now, y = born_y + 1, self.left[y]
            if len(self.table) > CACHE_ARCS:
                self.table.clear()
            self.table[key] = known
        return known

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        trie, arc = self.trie, self.arc
        for j in range(n):
            state, node = last[j], trie
            for i in range(j, n):
                node = node.get(word[i])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[i + 1] < 0 and (state < 0 or arc(state, token)):
                    last[i + 1], size[i + 1] = token, i + 1 - j
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens (their strings are ordinary text); none for null and empty."""
        ids: list[int] = []
        if text:
            words = self.words
            for word in self.split(text):
                found = words.get(word)
                if found is None:
                    found = self.encode_word(word.encode("utf-8"))
                    if len(word) <= CACHE_WORD_LETTERS:
                        if len(words) > CACHE_WORDS:
                            words.clear()
                        words[word] = found
                ids += found
        return ids

    def decode(self, ids) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", errors="replace")


def encode_texts(docs: DataFrame, automaton: MergeAutomaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: one narrow pass. The automaton's size is the vocabulary's, whatever the data's."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = docs.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(docs.select(key, text)).mapInArrow(walk, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, automaton: MergeAutomaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = docs.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    return spread(docs.select(key, text)).mapInArrow(walk, f"`{key}` {kind}, n_tokens int")


def decode_ids(rows: DataFrame, automaton: MergeAutomaton, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the labels of each row's ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for batch in batches:
            texts = pa.array([None if i is None else decode(i) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(walk, f"`{key}` {kind}, text string")
