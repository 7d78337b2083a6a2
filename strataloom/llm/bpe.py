"""Public tokenizer files as fast encoders whose results equal those of the files' own library."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: Unicode White_Space; str.split() also splits at U+001C..U+001F, which tokenizers take as symbols.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD = re.compile("[\x1c-\x1f]")
CACHED = 250_000


@lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _raw(token: str) -> bytes:
    return bytes(map(_letters().__getitem__, token))


class ByteBpe:
    """A byte-level BPE file with the usual English pattern: ids of whole texts."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {_raw(t): i for t, i in file["model"]["vocab"].items() if t not in self.special}
        self.engine = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)._core_bpe

    def ids(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids; special strings in the text are their own ids."""
        return np.frombuffer(self.engine.encode_to_tiktoken_buffer(text, set(self.special)), dtype="<u4")


class WordBpe:
    """A BPE file with word ends, lower case and no white space: exact token counts at every prefix of a text.

    Tokens never cross a word, so a prefix has the tokens of the words before it and those of its last word's prefix. Within a
    word a dynamic programme over bytes gives the counts of all prefixes at once: of the tokens that may end at a place, one only
    is compatible with the last token of the prefix before it. The counts of a stretch without white space are its table;
    n_tokens, truncation and budgets are all read from tables, and no text is encoded.
    """

    END = b"\xff"  # never part of UTF-8

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + self.END: 256 + b for b in range(256)}
        for i, pair in enumerate(file["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = left + right
            raw = _raw(whole[:-4]) + self.END if whole.endswith("</w>") else _raw(whole)
            ranks.setdefault(raw, 512 + i)
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.engine = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = regex.compile("|".join(sorted((regex.escape(t["content"]) for t in file["added_tokens"]), key=len, reverse=True)))
        self.words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{WHITE}\\p{{L}}\\p{{N}}]+")
        self.space = re.compile(f"[{WHITE}]+")
        self.ink = re.compile(f"[^{WHITE}]+")
        self.cache: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay what they are side by side."""
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self.engine.encode_single_piece(left + right) == [self.ranks[left], self.ranks[right]]
            if len(self.pairs) < CACHED:
                self.pairs[left, right] = ok
        return ok

    def word_prefixes(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a lower-cased word, taken as a whole word: entry i is that of the first i bytes."""
        last, opened, closed = [b""], [0], [0]
        for i in range(1, len(word) + 1):
            for end, counts in ((b"", opened), (self.END, closed)):
                for j in range(max(0, i - self.longest), i):
                    token = word[j:i] + end
                    if token in self.ranks and (not j or self._fit(last[j], token)):
                        counts.append(opened[j] + 1)
                        if not end:
                            last.append(token)
                        break
                else:
                    raise ValueError("no token ends here")
        return closed

    def word_end(self, word: bytes) -> int:
        """The last entry of word_prefixes: the programme over the prefixes that go on, then the one token that may end the word."""
        ranks, fit, longest = self.ranks, self._fit, self.longest
        if word + self.END in ranks:
            return 1
        last, opened = [b""], [0]
        for i in range(1, len(word)):
            for j in range(max(0, i - longest), i):
                token = word[j:i]
                if token in ranks and (not j or fit(last[j], token)):
                    opened.append(opened[j] + 1)
                    last.append(token)
                    break
        for j in range(max(1, len(word) - longest), len(word)):
            token = word[j:] + self.END
            if token in ranks and fit(last[j], token):
                return opened[j] + 1
        raise ValueError("no token ends here")

    def _plain(self, low: str) -> list[int]:
        """Tokens of each prefix, by characters, of a normalised stretch without white space."""
        out, before = [], 0
        for word in self.words.findall(low):
            raw = word.encode()
            counts = self.word_prefixes(raw)
            if word[0] == "'" and len(word) == 3 and word[1:].isalpha():
                counts[2] = counts[1] + self.word_prefixes(raw[1:2])[1]  # 'r is no word of its own
            if len(raw) == len(word):
                out.extend([before + c for c in counts[1:]])
            else:
                at = 0
                for c in word:
                    at += len(c.encode())
                    out.append(before + counts[at])
            before = out[-1]
        return out

    def _total(self, text: str) -> int:
        total, ends = 0, self.ends
        for word in self.words.findall(self.normal(text)):
            n = ends.get(word)
            if n is None:
                n = self.word_end(word.encode())
                if len(ends) < CACHED and len(word) <= 32:
                    ends[word] = n
            total += n
        return total

    def _segment(self, text: str) -> list[int]:
        low = self.normal(text)
        if text.isascii() or len(low) == len(text) and low == "".join([self.normal(c) for c in text]):
            return self._plain(low)
        # characters that join: what a prefix looks like depends on where it ends
        return [self._total(text[:i]) for i in range(1, len(text) + 1)]

    def _ends(self, piece: str) -> int:
        """Tokens of a stretch without white space; the special strings in it count one each."""
        parts = self.special.split(piece) if "<|" in piece else [piece]
        return len(parts) - 1 + sum(map(self._total, parts))

    def table(self, piece: str) -> list[int]:
        """Tokens of each prefix of a stretch without white space, by characters."""
        out, before, at = [], 0, 0
        for m in self.special.finditer(piece) if "<|" in piece else ():
            text, special = piece[at : m.start()], m.group()
            counts = self._segment(text)
            out.extend([before + c for c in counts])
            out.extend([before + self._total(text + special[:j]) for j in range(1, len(special))])
            before += (counts[-1] if counts else 0) + 1
            out.append(before)
            at = m.end()
        out.extend([before + c for c in self._segment(piece[at:])])
        return out

    def piece(self, piece: str) -> int:
        """Tokens of a stretch without white space: the end of its table, which is kept for short ones."""
        n = self.cache.get(piece)
        if n is None:
            n = self._ends(piece)
            if len(self.cache) < CACHED and len(piece) <= 32:
                self.cache[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return [p for p in self.space.split(text) if p] if ODD.search(text) else text.split()

    def steps(self, text: str) -> list[int]:
        """Tokens of each stretch between white space; their running sum is the count at the stretch's end."""
        get, piece = self.cache.get, self.piece
        return [n if (n := get(p)) is not None else piece(p) for p in self.split(text)]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text: entry i is that of the first i + 1 characters."""
        out, before = np.zeros(len(text), np.int32), 0
        at = 0
        for m in self.ink.finditer(text):
            out[at : m.start()] = before
            out[m.start() : m.end()] = self.table(m.group())
            out[m.start() : m.end()] += before
            before, at = int(out[m.end() - 1]), m.end()
        out[at:] = before
        return out

    def longest_prefix(self, text: str, steps: list[int], budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens, which ends in the stretch that goes over the budget.

        steps are those of the text; the counts at the ends of stretches only grow.
        """
        done = 0
        for m, n in zip(self.ink.finditer(text), steps, strict=True):
            if done + n > budget:
                return m.start() + max([0, *(i for i, c in enumerate(self.table(m.group()), 1) if done + c <= budget)])
            done += n
        return len(text)
