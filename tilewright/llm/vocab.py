"""A byte-pair vocabulary read from a tokenizer file, and when two tokens may stand side by side.

The encoding of a text under ranked merges has a local description: a sequence
of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs.  Two neighbours are, if no merge crosses the border between
them before the tokens on both sides are complete.  So the encoding of a prefix
is fixed by its last token together with an earlier prefix, which both the
token-counting transducer and the trie encoder use.
"""

from __future__ import annotations

import functools
import json
import re

#: Rank of what never merges.
NEVER = 1 << 60
UNKNOWN = NEVER + 1


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable letters by which tokenizer files write single bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocab:
    """Tokens, merges and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = spec["model"]["vocab"]
        raw = {i: bytes(letters[c] for c in text) for text, i in ids.items()}
        self.size = max([*ids.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * self.size
        for i, b in raw.items():
            self.bytes_of[i] = b
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank.setdefault(a << 20 | b, rank)
            parts.setdefault(whole, (a, b, rank))
        # For each token, what stands at its right and left border as its merges go back, each
        # with the rank of the merge that takes it in.
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for i in raw:
            for side, table in ((1, self.right), (0, self.left)):
                spine, t, taken = [], i, NEVER
                while True:
                    spine.append((t, taken))
                    if t not in parts:
                        break
                    t, taken = parts[t][side], parts[t][2]
                table[i] = spine
        self._threats_of: dict[int, dict[int, int]] = {}
        self._after: dict[int, list[tuple[int, int]]] = {}
        for key, rank in self.rank.items():
            self._after.setdefault(key >> 20, []).append((key & 0xFFFFF, rank))
        # Tokens that their own bytes never encode to are left out.
        self.token_of: dict[bytes, int] = {}
        whole_ok: dict[int, bool] = {}
        for i in sorted(raw, key=lambda i: len(raw[i])):
            if i not in parts:
                ok = len(raw[i]) == 1
            else:
                a, b, rank = parts[i]
                ok = whole_ok.get(a, False) and whole_ok.get(b, False) and not self._crossed(a, b, rank)
            whole_ok[i] = ok
            if ok:
                self.token_of[raw[i]] = i
        self.longest = max(map(len, self.token_of))
        self._pairs: dict[int, bool] = {}

    @functools.cached_property
    def beginnings(self) -> dict[bytes, int]:
        """For all bytes that are or begin tokens: twice the token plus one (0 if none), plus 1 if longer tokens begin so."""
        out = {t[:k]: 1 for t in self.token_of for k in range(1, len(t))}
        for t, i in self.token_of.items():
            out[t] = out.get(t, 0) | (i + 1) << 1
        return out

    def threats(self, a: int) -> dict[int, int]:
        """Tokens that something at the right border of ``a`` merges with, each with the lowest such rank."""
        known = self._threats_of.get(a)
        if known is None:
            known = {}
            for r, taken in self.right[a]:
                for l, m in self._after.get(r, ()):
                    if m < taken and m < known.get(l, NEVER):
                        known[l] = m
            self._threats_of[a] = known
        return known

    def _crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        threats = self.threats(a)
        return any(m is not None and m <= taken and m < before for l, taken in self.left[b] for m in (threats.get(l),))

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a b`` is the encoding of its own bytes."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 300_000:
                self._pairs.clear()
            known = self._pairs[key] = not self._crossed(a, b)
        return known


@functools.cache
def load(path: str) -> Vocab:
    """The vocabulary of a file; once for each Python process."""
    return Vocab(path)


def split_special(texts: list[str], specials: dict[str, int]) -> tuple[list[str], list[tuple[int, int]]]:
    """Cut texts at special strings, the earliest and then longest match first.

    Returns segments and for each (text number, id of the special token that
    follows it, or -1 where the text ends).
    """
    segments: list[str] = []
    after: list[tuple[int, int]] = []
    mark = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
    for k, text in enumerate(texts):
        at = 0
        for found in mark.finditer(text):
            segments.append(text[at : found.start()])
            after.append((k, specials[found[0]]))
            at = found.end()
        segments.append(text[at:])
        after.append((k, -1))
    return segments, after
