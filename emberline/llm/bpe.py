"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state in which every byte loops. Each merge
(u, v) -> w, in order of rank, puts in a gadget: the state that u leads to is copied without its
v arc, all u arcs go to the copy, and w arcs run beside them to where v led. After the last merge
the automaton accepts exactly the token strings that BPE produces. As all arcs with one label lead
to one state, a state is named by the last token. Copies share structure: the state of token a is
the list of v arcs that merges (a, v) took away, and below it the state of a's right part as it
was when a was made. An arc b out of the state of a is missing if a gadget took it away, or took
the left part from which the arc was made; that is looked up along the two spines and kept in the
transition table.

Encoding follows the automaton's arcs over the bytes of a pre-split word. As several arcs' labels can be prefixes of what
is left, it is a longest-match search with retreat over the transition table, not a walk that reads each byte
once: it takes the longest arc whose label the rest of the word starts with, then shorter ones. One token string at most reaches each position, so a
position that no arc leads on from is dead for good and is tried once. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import regex

#: Fixed values of byte-level BPE vocabularies: white space, the pre-split pattern, printable bytes.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], specials: dict[str, int]):
        symbols = byte_symbols()
        self.label: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocab.items() if all(c in symbols for c in s)}
        self.label.update((i, s.encode()) for s, i in specials.items())
        self.specials = dict(specials)
        self._special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self._split = regex.compile(PRE_SPLIT)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {vocab[c]: -1 for c in symbols if c in vocab}
        self.gadgets: dict[int, dict[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in self.born and v in self.born and w not in self.born and self._open(u, v):
                self.gadgets.setdefault(u, {})[v] = rank
                self.left[w], self.right[w], self.born[w] = u, v, rank
        self.by_label = {self.label[t]: t for t in self.born}
        self.trie: dict[int, dict] = {}
        for s, t in self.by_label.items():
            node = self.trie
            for b in s:
                node = node.setdefault(b, {})
            node[-1] = t
        self.shorter = {t: next((self.by_label[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.by_label), -1) for s, t in self.by_label.items()}
        self.table: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        return cls(held["model"]["vocab"], merges, {t["content"]: t["id"] for t in held["added_tokens"]})

    def _open(self, a: int, b: int) -> bool:
        """Is there an arc b out of the state of a, by the gadgets so far?"""
        until_a = None
        while True:
            taken = self.gadgets.get(a)
            if taken:
                t, until_b = b, None
                while True:
                    rank = taken.get(t)
                    if rank is not None and (until_a is None or rank < until_a) and (until_b is None or rank <= until_b):
                        return False
                    if t not in self.left:
                        break
                    t, until_b = self.left[t], self.born[t]
            if a not in self.right:
                return True
            a, until_a = self.right[a], self.born[a]

    def arc(self, a: int, b: int) -> bool:
        key = a << 20 | b
        held = self.table.get(key)
        if held is None:
            if len(self.table) > 1_000_000:  # the table is a cache of arcs; it can be built again
                self.table.clear()
            held = self.table[key] = self._open(a, b)
        return held

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        whole = self.by_label.get(word)
        if whole is not None:
            return [whole]
        n, arc, shorter, label = len(word), self.arc, self.shorter, self.label
        ids: list[int] = []
        dead = None  # positions that no path goes on from
        at, t = 0, self._longest_arc(word, 0)
        while True:
            end = at + len(label[t])
            if not ids or arc(ids[-1], t):
                if dead is None or end not in dead:
                    ids.append(t)
                    if end == n:
                        return ids
                    at, t = end, self._longest_arc(word, end)
                    continue
            t = shorter[t]
            while t < 0:
                dead = dead or set()
                dead.add(at)
                t = ids.pop()
                at -= len(label[t])
                t = shorter[t]

    def _longest_arc(self, word: bytes, at: int) -> int:
        """The longest label that the rest of the word starts with."""
        node, found = self.trie, -1
        for b in word[at:]:
            node = node.get(b)
            if node is None:
                break
            found = node.get(-1, found)
        return found

    def words(self, text: str) -> Iterable[str]:
        return self._split.findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens' strings in it become those tokens."""
        ids, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            ids += [t for w in self.words(text[at : m.start()]) for t in self.encode_word(w.encode())]
            ids.append(self.specials[m[0]])
            at = m.end()
        return ids + [t for w in self.words(text[at:]) for t in self.encode_word(w.encode())]

    def decode(self, ids: Iterable[int]) -> str:
        label = self.label
        return b"".join([label[i] for i in ids]).decode("utf-8", "replace")
