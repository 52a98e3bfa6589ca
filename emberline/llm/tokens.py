"""Whole texts to token ids, as the tokenizers library gives them.

AutomatonIds encodes with the merge automaton and keeps a bounded cache of words. BytePairIds and
WordEndIds run the same merges through tiktoken's table; texts with characters outside a plain
repertoire go to the tokenizers library as they are. Tests compare all three with the library.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from emberline.llm.bpe import PRE_SPLIT, MergeAutomaton, byte_symbols

WORDS = 600_000
_PLAIN = r"\x20-\x7e\n\tÀ-ÖØ-öø-ÿ"
_unusual = re.compile(f"[^{_PLAIN}]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The pre-split pattern of byte-level BPE for texts of the plain repertoire alone.
_plain_split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[ \n\t]+(?![^ \n\t])|[ \n\t]+")


class AutomatonIds:
    """Pre-split words of texts to (ids as little-endian unsigned 32-bit bytes, decimal ids)."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.held: dict[str, tuple[bytes, str]] = {}

    def cut(self, text: str) -> list[str]:
        special = self.automaton._special
        split = self.automaton.words if _unusual.search(text) else _plain_split.findall
        if not (special and "<|" in text and special.search(text)):
            return split(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split(text[at:])

    def _learn(self, words: set[str]) -> None:
        encode, specials, held = self.automaton.encode_word, self.automaton.specials, self.held
        for w in words:
            ids = [specials[w]] if w in specials else encode(w.encode("utf-8", "surrogatepass"))
            held[w] = array("I", ids).tobytes(), ",".join(map(str, ids))

    def batch(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """For each text the pairs of its words."""
        for text in texts:
            words = self.cut(text)
            out: list[tuple[bytes, str]] = []
            for i in range(0, len(words), WORDS // 2):
                part = words[i : i + WORDS // 2] if len(words) > WORDS // 2 else words
                missing = set(part).difference(self.held)
                if len(self.held) + len(missing) > WORDS:
                    self.held.clear()
                    missing = set(part)
                self._learn(missing)
                out += map(self.held.__getitem__, part)
            yield out


def plain_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _vocab(path: str) -> tuple[dict[str, int], dict[str, int], bool]:
    """Vocabulary, special tokens, and whether merges run in the order of their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab = held["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in held["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in held["model"]["merges"]]
    return vocab, specials, made == sorted(set(made))


class BytePairIds:
    """Byte-level BPE ids of a text as a numpy array."""

    def __init__(self, path: str):
        import tiktoken

        vocab, self.specials, ordered = _vocab(path)
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in s): i for s, i in vocab.items() if s not in self.specials}
        self.fast = tiktoken.Encoding("byte_level", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens=self.specials) if ordered else None
        self.library = plain_tokenizer(path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _unusual.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


class WordEndIds:
    """Ids of a vocabulary with word ends, lower case, white space dropped, as a numpy array.

    In the plain repertoire a text is put in lower case, and spaces are set around what the pattern
    splits, so that each word ends with one space, which stands for the word end in the table."""

    _apart = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        import tiktoken

        vocab, specials, ordered = _vocab(path)
        symbols = byte_symbols()
        ranks = {}
        for s, i in vocab.items():
            if s not in specials:
                end = s.endswith("</w>")
                ranks[bytes(symbols[c] for c in s.removesuffix("</w>")) + b" " * end] = i
        ordered = ordered and not any(b" " in s[:-1] for s in ranks if s != b"  ")  # no word holds a space
        self.fast = tiktoken.Encoding("word_end", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.library = plain_tokenizer(path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or "<|" in text or _unusual.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        spaced = self._apart.sub(r" \g<0> ", text.lower().replace("\n", " ").replace("\t", " ")) + " "
        return self.fast.encode_to_numpy(spaced, disallowed_special=()).astype("<u4", copy=False)


_made: dict[tuple[type, str], object] = {}


def held(kind: type, path: str):
    """One encoder of a kind for each Python worker, kept between tasks."""
    if (kind, path) not in _made:
        _made[kind, path] = AutomatonIds(MergeAutomaton.from_file(path)) if kind is AutomatonIds else kind(path)
    return _made[kind, path]


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc32_of(id_bytes: bytes) -> int:
    return zlib.crc32(id_bytes)
